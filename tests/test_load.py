import json
import os
import shutil
from datetime import date, datetime
from pathlib import Path

import pytest
from conftest import record, write_log
from pyspark.sql import functions as F

from logsluice.__main__ import main
from logsluice.functions.names import snake_case
from logsluice.functions.paths import ACCOUNT_LAYOUT
from logsluice.operators.flatten import as_text, flatten, to_lake_rows, to_lake_rows_by_folder
from logsluice.functions.timeparts import utc_instant
from logsluice.plans import catalog, derived, jobs
from logsluice.schemas import LAKE_KEYS, RECORD, lake_schema, leaf_paths, record_schema
from logsluice.session import settings
from logsluice.sources.audit import NO_RECORDS, NOT_JSON, UNREADABLE, explode_records, read_days, read_envelopes, with_folder_keys
from logsluice.sources.lake import read_lake, write_lake
from logsluice.streaming import ledger, loads
from logsluice.streaming.ingest import ingest
from logsluice.streaming.loads import quarantined_files, taken_files

# Columns of the output table.
FLAT_COLUMNS = """
event_version user_identity_type user_identity_principal_id user_identity_arn
user_identity_account_id user_identity_access_key_id
user_identity_session_context_attributes_mfa_authenticated
user_identity_session_context_attributes_creation_date
user_identity_session_context_session_issuer_type
user_identity_session_context_session_issuer_principal_id
user_identity_session_context_session_issuer_arn
user_identity_session_context_session_issuer_account_id
user_identity_session_context_session_issuer_user_name
user_identity_session_context_session_issuer_web_id_federation_data
user_identity_invoked_by user_identity_user_name event_time event_source event_name aws_region
source_ip_address user_agent request_id event_id event_type recipient_account_id
request_parameters api_version response_elements error_code error_message read_only
vpc_endpoint_id additional_event_data service_event_details management_event shared_event_id
resources
""".split()


def records(spark, root):
    return explode_records(read_envelopes(spark, ACCOUNT_LAYOUT.glob(root)))


def by_id(frame, *columns):
    return {r["event_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


def test_names_follow_the_rule():
    assert sorted(snake_case(p) for p in leaf_paths(RECORD)) == sorted(FLAT_COLUMNS)
    assert snake_case("sourceIPAddress") == "source_ip_address"
    assert snake_case("a.requestID") == "a_request_id"


def test_envelopes_skip_digests_and_keep_every_record(spark, tree):
    assert {r["eventID"] for r in records(spark, tree).collect()} == {"e1", "e2", "e3", "e4", "e5"}
    everything = explode_records(read_envelopes(spark, tree))
    assert everything.count() == 5


def test_free_form_fields_keep_their_json(spark, tree):
    rows = by_id(
        flatten(records(spark, tree)),
        "request_parameters",
        "resources",
        "user_identity_session_context_session_issuer_web_id_federation_data",
    )
    assert rows["e1"] == (
        '{"bucket":"b","n":1}',
        '[{"arn":"arn:b","accountId":"012345678901","type":"Bucket"}]',
        '{"provider":"idp"}',
    )
    assert rows["e2"][0] is None


def test_conversions_give_null_for_bad_text(spark, tree):
    rows = by_id(flatten(records(spark, tree)), "event_time", "read_only", "management_event")
    assert rows["e3"] == (None, True, False)
    assert rows["e2"][1] is None
    assert str(rows["e4"][0]) == "2024-01-29 05:00:00"


def test_keys_come_from_event_time(spark, tree):
    rows = by_id(to_lake_rows(records(spark, tree)), *LAKE_KEYS)
    assert rows["e1"] == ("012345678901", "store", "GetObject", "eu-west-1", 2024, 1, 29, 23)
    assert rows["e2"][4:] == (2024, 1, 30, 0)
    assert rows["e3"][4:] == (None, None, None, None)
    assert rows["e4"][1] is None


def test_keys_do_not_depend_on_the_session_zone(spark, tree):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        rows = by_id(to_lake_rows(records(spark, tree)), *LAKE_KEYS)
        assert rows["e1"][4:] == (2024, 1, 29, 23)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_folder_keys_win_in_the_partitioned_load(spark, tmp_path):
    root = str(tmp_path / "logs")
    write_log(
        f"{root}/777777777777/CloudTrail/eu-north-1/2024/01/30", "a", [record("e1")]
    )
    rows = to_lake_rows_by_folder(with_folder_keys(records(spark, root)))
    assert by_id(rows, "account_id", "region", "aws_region") == {
        "e1": ("777777777777", "eu-north-1", "eu-west-1")
    }


def test_other_spelling_of_a_key(spark, tmp_path):
    root = str(tmp_path / "logs")
    other = record("e1")
    other["sharedEventId"] = other.pop("sharedEventID")
    write_log(f"{root}/1/CloudTrail/r/2024/01/30", "a", [other])
    write_log(f"{root}/1/CloudTrail/r/2024/01/30", "b", [record("e2"), {**other, "eventID": "e3"}])
    assert by_id(flatten(records(spark, root)), "shared_event_id") == {"e1": ("se1",), "e2": ("se2",), "e3": ("se1",)}
    schema = record_schema({"sharedEventID": "sharedEventId"})
    frame = explode_records(read_envelopes(spark, ACCOUNT_LAYOUT.glob(root), schema))
    assert by_id(flatten(frame, schema), "shared_event_id")["e1"] == ("se1",)


@pytest.fixture()
def broken(tmp_path):
    """A good file among such that hold no records, with names that globs and URLs give a meaning to."""
    folder = tmp_path / "logs/a+b%2/CloudTrail/r/2024/01/30"
    write_log(folder, "good [1] {x}", [record("e1", "2024-01-30T05:00:00")])
    write_log(folder, "empty", [])
    write_log(folder, "other", [record("x")], key="Entries")
    (folder / "cut.json").write_text('{"Records": [{"eventID": ')
    whole = Path(write_log(folder, "torn", [record(f"t{n}") for n in range(200)])).read_bytes()
    (folder / "torn.json.gz").write_bytes(whole[: len(whole) // 2])
    return str(tmp_path / "logs")


def test_bad_files_are_set_aside_and_the_rest_is_loaded(spark, broken, tmp_path):
    dest = str(tmp_path / "lake")
    report = jobs.backfill(spark, broken, dest)
    assert (report.files, report.records, report.problems) == (5, 1, 3)
    found = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in quarantined_files(spark, dest).collect()}
    assert found == {"other.json.gz": NO_RECORDS, "cut.json": NOT_JSON, "torn.json.gz": UNREADABLE}
    assert [r["event_id"] for r in read_lake(spark, dest).collect()] == ["e1"]
    assert jobs.backfill(spark, broken, dest).files == 0
    by_month = str(tmp_path / "by_month")
    jobs.backfill_month(spark, broken, by_month, 2024, 1)
    assert [r["account_id"] for r in read_lake(spark, by_month).collect()] == ["a+b%2"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_times_without_a_zone_are_utc(spark, zone):
    texts = ["2024-01-30T05:00:00", "2024-01-30 05:00:00.5", "2024-01-30", "2024-01-30T05:00:00Z", "2024-01-30T05:00:00+02:00", "5 o'clock", None]
    with settings(spark, spark__sql__session__timeZone=zone):
        rows = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r[0] for r in rows.select(F.unix_micros(utc_instant(F.col("t")))).collect()]
    day, hour = 1_706_572_800 * 10**6, 3600 * 10**6
    assert got == [day + 5 * hour, day + 5 * hour + 500_000, day, day + 5 * hour, day + 3 * hour, None, None]


def test_nested_columns_to_text(spark):
    frame = spark.sql("SELECT named_struct('a', 1) AS s, array(1, 2) AS l, 7 AS n")
    assert as_text(frame, "s", "l", "n").first().asDict() == {"s": '{"a":1}', "l": "[1,2]", "n": "7"}


def test_lake_round_trip_keeps_zeros_and_nulls(spark, tree, tmp_path):
    dest = str(tmp_path / "lake")
    rows = to_lake_rows(records(spark, tree))
    write_lake(rows, dest)
    lake = read_lake(spark, dest)
    assert lake.schema == lake_schema()
    columns = lake.columns
    assert sorted(map(str, lake.collect())) == sorted(map(str, rows.select(*columns).collect()))
    assert by_id(lake, "account_id")["e1"] == ("012345678901",)
    day = lake.where((F.col("year") == 2024) & (F.col("day") == 30))
    assert {r["event_id"] for r in day.collect()} == {"e2", "e5"}
    assert "PartitionFilters: [isnotnull(year" in day._jdf.queryExecution().toString()


def test_empty_input_writes_no_rows(spark, tree, tmp_path):
    dest = str(tmp_path / "lake")
    write_lake(to_lake_rows(records(spark, tree)).limit(0), dest)
    assert read_lake(spark, dest).count() == 0


def test_backfill_is_idempotent_and_takes_only_new_files(spark, tree, tmp_path):
    dest = str(tmp_path / "lake")
    jobs.backfill(spark, tree, dest)
    assert read_lake(spark, dest).count() == 5
    jobs.backfill(spark, tree, dest)
    assert read_lake(spark, dest).count() == 5
    folder = f"{tree}/111111111111/CloudTrail/us-east-1/2024/01/30"
    write_log(folder, "late", [record("e6", "2024-01-29T23:00:00Z")])
    jobs.backfill(spark, tree, dest)
    rows = read_lake(spark, dest)
    assert sorted(r["event_id"] for r in rows.collect()) == ["e1", "e2", "e3", "e4", "e5", "e6"]
    wrong = rows.where(
        (F.year("event_time") != F.col("year")) | (F.hour("event_time") != F.col("hour"))
    )
    assert wrong.count() == 0


def test_old_files_survive_small_batches(spark, tree, tmp_path):
    """Batches smaller than the backlog, over files far older than the newest one."""
    files = sorted(str(p) for p in Path(tree).rglob("*.json.gz"))
    for age, path in enumerate(files):
        os.utime(path, (1.7e9 - age * 1e7,) * 2)
    dest = str(tmp_path / "lake")
    jobs.backfill(spark, tree, dest, batch_files=1)
    assert spark.read.parquet(f"{dest}/_loads").count() > 3
    old = write_log(
        f"{tree}/111111111111/CloudTrail/us-east-1/2024/01/02", "x", [record("old", "2024-01-02T00:00:00Z")]
    )
    os.utime(old, (1.0e9, 1.0e9))
    jobs.backfill(spark, tree, dest, batch_bytes=1)
    ids = sorted(r["event_id"] for r in read_lake(spark, dest).collect())
    assert ids == ["e1", "e2", "e3", "e4", "e5", "old"]


@pytest.fixture()
def lake_of(spark, tmp_path):
    """A lake's folder and a table over it."""
    dest, name = str(tmp_path / "lake"), f"lake_{abs(hash(str(tmp_path)))}"
    catalog.create_lake_table(spark, name, dest)
    yield dest, name
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("step", ["write_lake", "add_files", "finish"])
def test_an_interrupted_load_is_repeated_and_counts_once(spark, tree, lake_of, monkeypatch, step):
    dest, name = lake_of

    def ids(rows):
        return sorted(r["event_id"] for r in rows.select("event_id").collect())

    jobs.backfill_month(spark, tree, dest, 2024, 1)
    assert catalog.publish_loads(spark, name, dest) == 1
    before = ids(spark.table(name))
    write_log(f"{tree}/012345678901/CloudTrail/eu-west-1/2024/01/30", "later", [record("e6", "2024-01-30T23:00:00Z"), record("e7", None)])
    with monkeypatch.context() as patched:
        where = loads if step == "write_lake" else ledger
        real = getattr(where, step)

        def breaks(*args, **options):
            if step == "write_lake":  # the rows are there, what follows isn't
                real(*args, **options)
            raise RuntimeError("lost")

        patched.setattr(where, step, breaks)
        with pytest.raises(RuntimeError, match="lost"):
            jobs.incremental(spark, tree, dest, date(2024, 1, 30))
    assert spark.read.parquet(dest).count() == 7
    assert catalog.publish_loads(spark, name, dest) == 0
    assert ids(read_lake(spark, dest)) == ids(spark.table(name)) == before
    report = jobs.incremental(spark, tree, dest, date(2024, 1, 30))
    assert report.records == 2 and catalog.publish_loads(spark, name, dest) == 1
    assert ids(read_lake(spark, dest)) == ids(spark.table(name)) == ids(spark.read.parquet(dest)) == [*before, "e6", "e7"]
    assert len(list(Path(dest).glob("load_id=*"))) == 2 and not list(Path(dest).glob("_started/*"))


def test_a_load_that_ended_is_not_undone(spark, tree, tmp_path, monkeypatch):
    dest = str(tmp_path / "lake")
    with monkeypatch.context() as patched:
        patched.setattr(ledger.store, "remove", lambda *_: None)  # broken off between the last step and its mark
        jobs.incremental(spark, tree, dest, date(2024, 1, 30))
    assert len([p for p in Path(dest).glob("_started/*") if not p.name.startswith(".")]) == 1
    assert ledger.undo_broken(spark, dest) == [] and read_lake(spark, dest).count() == 5


def test_a_table_is_published_twice_without_harm(spark, tree, lake_of):
    dest, name = lake_of
    jobs.incremental(spark, tree, dest, date(2024, 1, 30))
    assert jobs.publish(spark, name, dest) == 1
    shutil.rmtree(catalog.published_folder(dest, name))  # as if broken off before it was noted
    assert jobs.publish(spark, name, dest) == 1 and jobs.publish(spark, name, dest) == 0
    assert spark.table(name).count() == 5


def test_keys_of_any_text_are_published(spark, lake_of):
    dest, name = lake_of
    odd = ["a+b%2 c", "x/y", "é:z", "p=q", None, "it's", "100%25", "__x"]
    texts = [F.col("v") if f.name in LAKE_KEYS[:3] else F.lit(None) for f in lake_schema().fields]
    rows = spark.createDataFrame([(v,) for v in odd], "v string").select(
        *[text.cast(f.dataType).alias(f.name) for text, f in zip(texts, lake_schema().fields)]
    )
    ledger.start(spark, dest, "0123")
    write_lake(rows, dest, load="0123")
    ledger.finish(spark, dest, "0123", 1, len(odd))
    assert catalog.publish_loads(spark, name, dest) == 1
    for shown in (spark.table(name), read_lake(spark, dest)):
        assert sorted(str(r[0]) for r in shown.select(LAKE_KEYS[0]).collect()) == sorted(map(str, odd))
        assert {tuple(r) for r in shown.select(*LAKE_KEYS[:3]).collect()} == {(v, v, v) for v in odd}


def test_only_the_days_asked_for_are_listed(spark, tree, tmp_path):
    dest = str(tmp_path / "lake")
    jobs.backfill(spark, tree, dest)
    assert taken_files(spark, dest).count() == 4
    files = taken_files(spark, dest, ["2024-01-30", "2031-01-01"])
    assert files.count() == 2
    listed = [f for f in files.inputFiles() if "/_files/" in f]
    old = spark.createDataFrame([(f"f{n}", f"2001-01-{n:02d}") for n in range(1, 20)], "path string, day string")
    ledger.add_files(old.select("path", F.lit(None).cast("string").alias("problem"), F.lit(1).cast("long").alias("records"), F.lit("x").alias("load_id"), "day"), dest)
    assert [f for f in taken_files(spark, dest, ["2024-01-30"]).inputFiles() if "/_files/" in f] == listed
    assert taken_files(spark, dest, ["2031-01-01"]).count() == 0


@pytest.mark.parametrize("broken", [False, True])
def test_small_files_of_the_ledger_are_merged(spark, tree, tmp_path, monkeypatch, broken):
    dest = str(tmp_path / "lake")
    monkeypatch.setattr(ledger, "MERGE_AT", 2)
    if broken:  # the old files stay where they are
        real = ledger.store.remove
        monkeypatch.setattr(ledger.store, "remove", lambda spark, path: None if path.endswith(".parquet") else real(spark, path))
    folder = f"{tree}/012345678901/CloudTrail/eu-west-1/2024/01/30"
    for n in range(5):
        write_log(folder, f"more{n}", [record(f"m{n}", "2024-01-30T01:00:00Z")])
        jobs.incremental(spark, tree, dest, date(2024, 1, 30))
    assert sorted(r["event_id"] for r in read_lake(spark, dest).collect()) == sorted(["e1", "e2", "e3", "e4", "e5", *[f"m{n}" for n in range(5)]])
    assert taken_files(spark, dest).count() == 9 and ledger.complete_loads(spark, dest).count() == 5
    kept = len(list(Path(dest).glob("_files/day=2024-01-30/*.parquet"))), len(list(Path(dest).glob("_loads/*.parquet")))
    assert broken or max(kept) <= 3
    assert jobs.incremental(spark, tree, dest, date(2024, 1, 30)).files == 0


def test_table_over_a_loaded_lake(spark, tree, lake_of):
    dest, name = lake_of
    jobs.incremental(spark, tree, dest, date(2024, 1, 30))
    catalog.publish_loads(spark, name, dest)
    rows = spark.table(name)
    assert [c.name for c in spark.catalog.listColumns(name) if c.isPartition] == ["load_id", *LAKE_KEYS]
    assert sorted(map(str, rows.select(*lake_schema().fieldNames()).collect())) == sorted(map(str, read_lake(spark, dest).collect()))
    day = rows.where("day = 29")
    assert day.count() == 2 and "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().toString()


def test_command_line(spark, tree, tmp_path):
    dest = str(tmp_path / "lake")
    main(["incremental-lookback", "--root", tree, "--dest", dest, "--as-of", "2024-01-30", "--days", "3"])
    assert read_lake(spark, dest).count() == 5
    with pytest.raises(SystemExit):
        main(["backfill", "--root", tree])


def test_different_loads_share_one_lake(spark, tree, tmp_path):
    dest = str(tmp_path / "lake")
    old = f"{tree}/111111111111/CloudTrail/us-east-1"
    write_log(f"{old}/2023/12/05", "o", [record("old", "2023-12-05T01:00:00Z")])
    write_log(f"{old}/2024/01/22", "w", [record("week", "2024-01-22T01:00:00Z")])
    as_of = date(2024, 1, 30)

    def ids():
        return sorted(r["event_id"] for r in read_lake(spark, dest).collect())

    jobs.incremental(spark, tree, dest, as_of)
    assert ids() == ["e1", "e2", "e3", "e4", "e5"]
    jobs.incremental_lookback(spark, tree, dest, as_of, days=8)
    assert ids() == ["e1", "e2", "e3", "e4", "e5", "week"]
    jobs.backfill_month(spark, tree, dest, 2023, 12)
    assert ids() == ["e1", "e2", "e3", "e4", "e5", "old", "week"]
    jobs.backfill(spark, tree, dest)
    jobs.incremental(spark, tree, dest, as_of)
    assert ids() == ["e1", "e2", "e3", "e4", "e5", "old", "week"]


def test_split_between_runs_gives_the_same_lake(spark, tree, tmp_path):
    whole, stepwise = str(tmp_path / "whole"), str(tmp_path / "steps")
    jobs.backfill(spark, tree, whole)
    for day in (date(2024, 1, 29), date(2024, 1, 31)):
        jobs.incremental(spark, tree, stepwise, day)
    assert sorted(map(str, read_lake(spark, whole).collect())) == sorted(
        map(str, read_lake(spark, stepwise).collect())
    )


def test_no_matching_folder_is_an_empty_load(spark, tree, tmp_path):
    dest = str(tmp_path / "lake")
    jobs.incremental(spark, tree, dest, date(2030, 1, 1))
    jobs.backfill(spark, tree, dest)
    assert read_lake(spark, dest).count() == 5


def test_read_days(spark, tree):
    rows = read_days(spark, tree, [date(2024, 1, 29)])
    assert {r["eventID"] for r in rows.collect()} == {"e3", "e4"}
    nothing = read_days(spark, tree, [date(2031, 1, 1)])
    assert nothing.count() == 0 and to_lake_rows(nothing).count() == 0


def test_hot_partition_is_split_between_writers(spark, tmp_path):
    """One account with nearly all rows gets several files, the others one each."""
    hot = F.when(F.col("id") % 50 == 0, F.col("id") % 3 + 1).otherwise(0).cast("string")
    rows = spark.range(0, 60000, numPartitions=8).select("id", F.uuid().alias("text"), hot.alias("account"))
    with settings(
        spark,
        spark__sql__adaptive__advisoryPartitionSizeInBytes="200k",
        spark__sql__shuffle__partitions="4",
    ):
        write_lake(rows, str(tmp_path / "lake"), ["account"])
    files = {
        a: len(list((tmp_path / "lake" / f"account={a}").glob("*.parquet"))) for a in ("0", "1", "2", "3")
    }
    assert files["0"] > 3 and files["1"] == files["2"] == files["3"] == 1
    assert spark.read.parquet(str(tmp_path / "lake")).count() == 60000


def test_streamed_load_splits_a_hot_partition_too(spark, tmp_path):
    inbox, dest = str(tmp_path / "in"), str(tmp_path / "lake")
    rows = spark.range(0, 60000, numPartitions=8).select("id", F.uuid().alias("text"), F.lit("a").alias("account"))
    rows.write.parquet(inbox)
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="200k"):
        ingest(spark.readStream.schema(rows.schema).parquet(inbox), dest, ["account"])
    assert len(list((tmp_path / "lake/account=a").glob("*.parquet"))) > 3
    assert spark.read.parquet(dest).count() == 60000


def test_derived_logs_are_full_before_a_folder_gets_another(spark, tmp_path, monkeypatch):
    """Ids far apart, repeated ones and ones without a user or ``props``: each record once, in as few files as its folder needs."""
    monkeypatch.setattr(derived, "RECORDS_PER_FILE", 20)
    ids = [5000 * n for n in range(100)] * 2
    rows = [(i, datetime(2024, 1, 1, 3), None if n % 50 == 7 else n % 2, "view", 1.0, None if n % 50 == 9 else '{"k": 5}') for n, i in enumerate(ids)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    root = derived.log_tree(spark, str(tmp_path))
    # As text, whose lines are files here; digests are copies.
    logs = spark.read.text(root).where("type = 'CloudTrail'").select("accountid", "region", "value").collect()
    per_folder = {}
    for account, region, text in logs:
        per_folder.setdefault((account, region), []).append([int(r["eventID"]) for r in json.loads(text)["Records"]])
    assert sorted(i for files in per_folder.values() for f in files for i in f) == sorted(ids) and len(per_folder) == 4
    needed = {folder: -(-sum(map(len, files)) // 20) for folder, files in per_folder.items()}
    assert all(len(files) <= needed[folder] for folder, files in per_folder.items()) and max(map(len, per_folder.values())) > 2
