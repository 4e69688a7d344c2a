import re
from datetime import date

import pytest
from conftest import record, write_log
from pyspark.sql import functions as F

from logsluice.functions.paths import ACCOUNT_LAYOUT, DELIVERED_KEYS, HIVE_LAYOUT
from logsluice.functions.timeparts import from_day
from logsluice.operators import partitions as P
from logsluice.plans import catalog, jobs
from logsluice.schemas import DELIMITED_PRICES
from logsluice.session import settings
from logsluice.sources.audit import lookback, month_slice, scan_table
from logsluice.sources.lake import read_lake
from logsluice.sources.manifest import file_manifest, leaf_prefixes


@pytest.fixture()
def database(spark, tmp_path):
    name = f"db_{abs(hash(str(tmp_path)))}"
    catalog.create_database(spark, name, str(tmp_path / "db"))
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def locations(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "location string")


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_leaf_prefixes_leave_out_digests_and_inner_folders(spark, tree):
    write_log(f"{tree}/012345678901", "stray", [record("x")])
    found = [r["location"] for r in leaf_prefixes(file_manifest(spark, tree)).collect()]
    short = sorted(f.split("/logs/")[1] for f in found)
    assert short == [
        "012345678901/CloudTrail/eu-west-1/2024/01/29/",
        "012345678901/CloudTrail/eu-west-1/2024/01/30/",
        "111111111111/CloudTrail/us-east-1/2024/01/30/",
    ]


def test_manifest_reads_no_contents(spark, tree):
    assert "ReadSchema: struct<path:string>" in plan(file_manifest(spark, tree))


def test_path_values_from_the_right_with_or_without_slash(spark):
    frame = locations(
        spark,
        "s3://b/prefix/logs/012345678901/CloudTrail/eu-west-1/2018/05/23/",
        "s3://b/1/CloudTrail/us-east-1/2018/05/23",
        "s3://b/1/CloudTrail/2018/05/23/",
        "s3://b/1/CloudTrail/us-east-1/2018/5/23/",
    )
    parsed = P.parse_locations(frame)
    good = [tuple(r)[1:] for r in P.well_formed(parsed).orderBy("accountid").collect()]
    assert good == [
        ("012345678901", "CloudTrail", "eu-west-1", "2018", "05", "23"),
        ("1", "CloudTrail", "us-east-1", "2018", "05", "23"),
    ]
    # A missing level would shift all six values if parts were only counted.
    assert P.quarantined(parsed).count() == 2


def test_candidates_are_today_and_yesterday_without_a_join(spark):
    pairs = spark.createDataFrame([("1", "eu"), ("1", "us"), ("2", "eu")], "account string, region string")
    frame = P.candidates(pairs, date(2024, 3, 1))
    assert frame.count() == 6
    assert {r["day"] for r in frame.collect()} == {date(2024, 3, 1), date(2024, 2, 29)}
    assert "Join" not in plan(frame)
    folders = P.candidate_locations(pairs, date(2024, 3, 1), "s3://b/logs/")
    assert "s3://b/logs/2/CloudTrail/eu/2024/02/29/" in {r[0] for r in folders.collect()}


def test_new_partitions_and_reconcile(spark):
    found = locations(spark, "a", "b", "c")
    before = locations(spark, "b", "x", "b")
    new = P.new_partitions(found, before)
    assert sorted(r[0] for r in new.collect()) == ["a", "c"]
    assert "BroadcastHashJoin" in plan(new)
    good = P.reconcile(before, new, locations(spark, "a", "b", "c", "x"))
    assert good.first().asDict() == {"expected": 4, "actual": 4, "ok": True}
    bad = P.reconcile(before, new, locations(spark, "a", "b", "x"))
    assert bad.first().asDict() == {"expected": 4, "actual": 3, "ok": False}


def test_register_scan_and_prune(spark, tree, database):
    table = f"{database}.logs"
    catalog.create_partitioned_log_table(spark, table, tree)
    report = jobs.register_partitions(spark, tree, table)
    assert report.first().asDict() == {"expected": 3, "actual": 3, "ok": True}
    again = jobs.register_partitions(spark, tree, table)
    assert again.first().asDict() == {"expected": 3, "actual": 3, "ok": True}

    rows = scan_table(spark, table)
    assert {r["eventID"] for r in rows.collect()} == {"e1", "e2", "e3", "e4", "e5"}
    assert {r["accountid"] for r in rows.collect()} == {"012345678901", "111111111111"}

    month = month_slice(rows, 2024, 1)
    assert month.count() == 5
    assert month_slice(rows, 2023, 12).count() == 0
    week = lookback(rows, date(2024, 1, 31), 1)
    assert {r["eventID"] for r in week.collect()} == {"e1", "e2", "e5"}
    for frame in (month, week):
        assert "PartitionFilters: []" not in plan(frame)
    assert lookback(rows, date(2024, 2, 6)).count() == 3


def test_register_recent_adds_two_days_per_known_pair(spark, tree, database):
    table = f"{database}.logs"
    catalog.create_partitioned_log_table(spark, table, tree)
    jobs.register_recent(spark, tree, table, date(2024, 1, 30))
    keys = catalog.registered_partitions(spark, table)
    assert keys.count() == 4
    report = jobs.register_recent(spark, tree, table, date(2024, 1, 31))
    assert report.first().asDict() == {"expected": 4, "actual": 4, "ok": True}
    assert catalog.registered_partitions(spark, table).count() == 6
    # A day without any folder still gets its partitions, and reads as no rows.
    report = jobs.register_recent(spark, tree, table, date(2024, 5, 1))
    assert report.first()["ok"] and report.first()["actual"] == 4
    assert catalog.registered_partitions(spark, table).count() == 10
    assert scan_table(spark, table).count() == 5


def test_register_recent_knows_quiet_accounts(spark, tree, database):
    table = f"{database}.quiet"
    catalog.create_partitioned_log_table(spark, table, tree)
    write_log(f"{tree}/222222222222/CloudTrail/eu-west-3/2020/01/01", "q", [record("q")])
    jobs.register_recent(spark, tree, table, date(2024, 1, 30))
    keys = catalog.registered_partitions(spark, table)
    assert {(r["accountid"], r["region"], r["day"]) for r in keys.where("accountid = '222222222222'").collect()} == {
        ("222222222222", "eu-west-3", "29"), ("222222222222", "eu-west-3", "30")}


def test_plus_in_a_partition_value(spark, tmp_path, database):
    root, table = str(tmp_path / "logs"), f"{database}.plus"
    write_log(f"{root}/a+b c/CloudTrail/eu/2024/01/30", "a", [record("e1")])
    catalog.create_partitioned_log_table(spark, table, root)
    for _ in range(2):
        report = jobs.register_partitions(spark, root, table).first()
        assert report.asDict() == {"expected": 1, "actual": 1, "ok": True}
    assert catalog.registered_partitions(spark, table).first()["accountid"] == "a+b c"
    named = locations(spark, "s3://b/accountid=a+b%20c%2Fd/type=CloudTrail/region=r/year=2024/month=01/day=02/")
    assert P.parse_locations(named, HIVE_LAYOUT).first()["accountid"] == "a+b c/d"


def test_lookback_drops_incomplete_dates(spark):
    rows = [("2024", "01", "30"), ("2024", None, "30"), ("2024", None, None), (None, None, None), ("2024", "__HIVE_DEFAULT_PARTITION__", "30")]
    frame = spark.createDataFrame(rows, "year string, month string, day string")
    assert [tuple(r) for r in lookback(frame, date(2024, 1, 31)).collect()] == [rows[0]]


def test_lookback_asks_for_its_days_only(spark, tree, database):
    for day in ("2023/12/31", "2024/02/01", "2024/02/02"):
        write_log(f"{tree}/012345678901/CloudTrail/eu-west-1/{day}", "z", [record(f"z{day}")])
    table = f"{database}.logs"
    catalog.create_partitioned_log_table(spark, table, tree)
    jobs.register_partitions(spark, tree, table)
    recent = lookback(spark.table(table), date(2024, 2, 2), 3)
    with settings(spark, spark__sql__maxMetadataStringLength="1000"):
        physical = plan(recent).split("== Physical Plan ==")[1]
    found = physical.split("PartitionFilters: [")[1].split("]")[0]
    assert all(re.search(rf"{key}#\d+ (>|>=|=) ", found) for key in ("year", "month", "day")), found
    assert "\nFilter" not in physical  # all of it is decided by partitions
    assert sorted(f.split("eu-west-1/")[-1][:10] for f in recent.inputFiles() if "eu-west-1" in f) == ["2024/01/30", "2024/02/01", "2024/02/02"]
    # Without the date, which no metastore knows, the same partitions are asked for.
    text = spark.table(table).where(from_day(date(2024, 1, 30)))
    assert sorted(text.inputFiles()) == sorted(recent.inputFiles())


def test_many_partitions_take_several_statements(spark, database):
    table = f"{database}.many"
    catalog.create_partitioned_log_table(spark, table, "/nowhere")
    frame = spark.range(250).select(
        F.format_string(
            "/nowhere/it's %d/CloudTrail/r/2024/01/01/", "id"
        ).alias("location")
    )
    sent = catalog.add_partitions(spark, table, P.parse_locations(frame, ACCOUNT_LAYOUT))
    assert sent == 250
    back = catalog.registered_partitions(spark, table)
    assert back.columns == list(DELIVERED_KEYS)
    assert back.count() == 250
    assert back.where(F.col("accountid").startswith("it's ")).count() == 250


def test_flat_table(spark, tree, database):
    table = f"{database}.flat"
    catalog.create_flat_log_table(spark, table, tree)  # digests lie below it, too
    assert {r["eventID"] for r in scan_table(spark, table).collect()} == {"e1", "e2", "e3", "e4", "e5"}


def test_ddl_and_multi_row_insert(spark, database):
    catalog.create_database(spark, database)
    assert database in {r[0] for r in spark.sql("SHOW DATABASES").collect()}
    spark.sql(f"CREATE TABLE {database}.people (id INT, first_name STRING, last_name STRING) USING parquet")
    for _ in range(2):
        spark.sql(
            f"INSERT INTO {database}.people VALUES (1, 'Ada', 'L'), (2, 'Alan', 'T'), (3, 'Grace', 'H')"
        )
    assert spark.table(f"{database}.people").count() == 6
    assert catalog.preview(spark, f"{database}.people").count() == 6


def test_convert_flat_table_to_a_lake_table(spark, tree, database, tmp_path):
    flat, lake, dest = f"{database}.flat2", f"{database}.lake", str(tmp_path / "lake")
    catalog.create_flat_log_table(spark, flat, f"{tree}/*/CloudTrail/*")
    jobs.convert_table(spark, flat, dest)
    catalog.create_lake_table(spark, lake, dest)
    catalog.publish_loads(spark, lake, dest)
    rows = {r["event_id"]: r for r in spark.table(lake).collect()}
    assert len(rows) == 5 and rows["e1"]["account_id"] == "012345678901"
    hits = catalog.endpoint_access(spark, lake)
    assert [r["event_id"] for r in hits.collect()] == ["e4"]


@pytest.mark.parametrize("kind", ["flat", "partitioned"])
def test_tables_are_converted_a_month_at_a_time(spark, tree, database, tmp_path, monkeypatch, kind):
    write_log(f"{tree}/012345678901/CloudTrail/eu-west-1/2023/12/31", "z", [record("e0", "2023-12-31T10:00:00Z")])
    name, dest = f"{database}.sliced_{kind}", str(tmp_path / "lake")
    if kind == "flat":
        catalog.create_flat_log_table(spark, name, tree)
    else:
        catalog.create_partitioned_log_table(spark, name, tree)
        jobs.register_partitions(spark, tree, name)
    slices = []
    real = jobs.list_files
    monkeypatch.setattr(jobs, "list_files", lambda spark, paths: slices.append(real(spark, paths).select("path").collect()) or real(spark, paths))
    assert jobs.convert_table(spark, name, dest).records == 6
    assert len(slices) == 2 and all(len({r["path"].split("/")[-4] + r["path"].split("/")[-3] for r in s}) == 1 for s in slices)
    assert sorted(r["event_id"] for r in read_lake(spark, dest).collect()) == ["e0", "e1", "e2", "e3", "e4", "e5"]
    assert jobs.convert_table(spark, name, dest).files == 0


def test_price_table_preview(spark, database, tmp_path):
    names = DELIMITED_PRICES.fieldNames()
    row = ["1" if f.dataType.typeName() != "string" else "x" for f in DELIMITED_PRICES.fields]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.csv").write_text("|".join(names) + "\n" + ("|".join(row) + "\n") * 12)
    catalog.create_price_table(spark, f"{database}.prices", str(tmp_path / "p"))
    rows = catalog.preview(spark, f"{database}.prices").collect()
    assert len(rows) == 10 and rows[0]["sku"] == "x" and rows[0]["memory"] == 1.0
