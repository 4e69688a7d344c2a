import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.operators.alarms import threshold_alarm
from logsluice.operators.health import calculated_health, k_of_n, latest_status
from logsluice.operators.runs import failure_runs
from logsluice.schemas import METRIC_POINT, PROBE
from logsluice.plans import derived
from logsluice.sources.logs import tail_text
from logsluice.sources import following
from logsluice.streaming.alarms import alarm_stream, correct_alarms, fan_out, read_alarms, read_delivered, watch_late_points
from logsluice.streaming.health import KEY_GROUPS, _entries, _store
from logsluice.streaming.runs import read_health, read_runs, watch_failure_runs, watch_k_of_n

START = datetime(2024, 1, 1)
KEYS, ORDER = ["endpoint", "checker_region"], ["ts", "probe_id"]


def at(seconds):
    return START + timedelta(seconds=seconds)


def points(spark, *rows):
    return spark.createDataFrame([(at(s), "FailedInvocations", r, v) for s, r, v in rows], METRIC_POINT)


def probes(rng, n, first=0, ends=None):
    """Mostly one hot endpoint, with long runs of failures and some equal timestamps."""
    rows, state = [], True
    for i in range(first, first + n):
        if rng.random() < 0.02:
            state = not state
        endpoint = rng.choice(["hot"] * 8 + ["b", "c", None])
        healthy = rng.choice([state, state, state, True]) if endpoint != "c" else False
        rows.append((i, at(i // 3 * 10), endpoint, rng.choice(["eu", "us"]), healthy))
    return rows


def expected_runs(rows):
    """Brute force: walk each key in order."""
    out, now = {}, {}
    for probe_id, ts, endpoint, region, healthy in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (endpoint, region)
        now[key] = 0 if healthy else now.get(key, 0) + 1
        out[probe_id] = now[key]
    return out


def test_alarm_windows(spark):
    frame = threshold_alarm(
        points(spark, (0, "a", 1.0), (299, "a", 2.0), (300, "a", 0.5), (10, "b", 0.0), (20, "b", 0.0))
    )
    assert [tuple(r) for r in frame.collect()] == [("a", at(0), at(300), 3.0)]
    lower = threshold_alarm(points(spark, (300, "a", 0.5)), threshold=0.5)
    assert lower.first()["window_start"] == at(300)


def test_health(spark):
    rows = [
        (1, at(0), "e1", "eu", False), (2, at(5), "e1", "eu", True),
        (3, at(0), "e2", "eu", True), (4, at(5), "e2", "eu", False),
        (5, at(0), "e3", "eu", True),
    ]
    status = latest_status(spark.createDataFrame(rows, PROBE), ["endpoint"])
    assert {tuple(r) for r in status.collect()} == {("e1", True), ("e2", False), ("e3", True)}
    tree = spark.createDataFrame(
        [("p", "e1", 2), ("p", "e2", 2), ("p", "e3", 2), ("q", "e2", 1), ("q", "unseen", 1)],
        "parent string, child string, threshold int",
    )
    health = {r["parent"]: (r["healthy_children"], r["healthy"]) for r in calculated_health(status, tree).collect()}
    assert health == {"p": (2, True), "q": (0, False)}
    children = status.withColumn("parent", F.lit("p"))
    assert k_of_n(children, "parent", 3).first()["healthy"] is False


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_latest_status_breaks_ties_and_hashes(spark, kind):
    rng = random.Random(3)
    moments = [START + timedelta(microseconds=n) for n in (-1, 0, 1, 59_999_999, 86_400_000_000)]
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)]
    rows = [(i, rng.choice(moments), "e", "eu", rng.random() < 0.5) for i in ids]
    frame = spark.createDataFrame(rows, PROBE).withColumn("ts", F.col("ts").cast(kind))
    frame = frame.withColumn("bucket", F.pmod("probe_id", F.lit(40)))
    status = latest_status(frame, ["bucket"])
    wanted = {}
    for probe_id, ts, _, _, healthy in sorted(rows, key=lambda r: (r[1], r[0])):
        wanted[probe_id % 40] = healthy
    assert {r["bucket"]: r["healthy"] for r in status.collect()} == wanted
    assert "SortAggregate" not in status._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bucket", ["minute", "hour", "day", "year"])
def test_failure_runs_match_brute_force(spark, bucket):
    rows = probes(random.Random(7), 4000)
    frame = spark.createDataFrame(rows, PROBE).repartition(5)
    runs = failure_runs(frame, KEYS, ORDER, ~F.col("healthy"), threshold=3, bucket=bucket).collect()
    wanted = expected_runs(rows)
    assert {r["probe_id"]: r["run"] for r in runs} == wanted
    assert all(r["unhealthy"] == (r["run"] >= 3) for r in runs)
    assert len(runs) == len(rows)


def test_failure_runs_of_null_keys_and_times(spark):
    rows = [(n, at(n) if n > 2 else None, None if n % 2 else "e", "eu", False) for n in range(8)]
    runs = failure_runs(spark.createDataFrame(rows, PROBE), KEYS, ORDER, ~F.col("healthy"), bucket="minute")
    assert {r["probe_id"]: r["run"] for r in runs.collect()} == {n: n // 2 + 1 for n in range(8)}


def test_failure_runs_shuffle_whole_rows_once(spark):
    frame = spark.createDataFrame(probes(random.Random(1), 100), PROBE).withColumn("wide", F.lit("x"))
    text = failure_runs(frame, KEYS, ORDER, ~F.col("healthy"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and text.count("Exchange hashpartitioning") <= 4
    assert len([x for x in text.split("Exchange ") if "wide" in x.split("Exchange")[0]]) <= 2


def test_failure_runs_carry_on(spark):
    rows = probes(random.Random(5), 900)
    wanted = expected_runs(rows)
    cut = rows[450][1]
    early, late = [r for r in rows if r[1] <= cut], [r for r in rows if r[1] > cut]
    first = failure_runs(spark.createDataFrame(early, PROBE), KEYS, ORDER, ~F.col("healthy"))
    state = first.groupBy(*KEYS).agg(F.max_by("run", F.struct(*ORDER)).alias("run"))
    second = failure_runs(
        spark.createDataFrame(late, PROBE), KEYS, ORDER, ~F.col("healthy"), carry=state
    )
    assert {r["probe_id"]: r["run"] for r in second.collect()} == {r[0]: wanted[r[0]] for r in late}


def end_of(ts, minutes=1):
    """The end of the slice that a time is in."""
    step = timedelta(minutes=minutes)
    return START + ((ts - START) // step + 1) * step


def test_watch_failure_runs_equals_batch(spark, tmp_path):
    """Three deliveries, overlapping in time by less than the delay, and rows far too late or without a time."""
    rows = probes(random.Random(9), 1500)
    wanted = expected_runs(rows)
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "watch")
    # Three probes share ten seconds; shuffling within 60 rows moves a row by 200 s at most.
    mixed = [r for i in range(0, 1500, 60) for r in random.Random(i).sample(rows[i : i + 60], 60)]
    deliveries = [mixed[:490], mixed[490:1010], mixed[1010:] + [(9999, at(1), "hot", "eu", False), (9998, None, "hot", "eu", False)]]

    def run():
        stream = spark.readStream.schema(PROBE).parquet(inbox)
        watch_failure_runs(stream, root, KEYS, ORDER, ~F.col("healthy"), threshold=2, delay="10 minutes", bucket="1 minute")

    for delivery in deliveries:
        spark.createDataFrame(delivery, PROBE).write.mode("append").parquet(inbox)
        run()
    run()
    done = read_runs(spark.createDataFrame([], PROBE), root).collect()
    closed = max(end_of(r[1]) for r in rows) - timedelta(minutes=10)
    assert {r["probe_id"]: r["run"] for r in done} == {r[0]: wanted[r[0]] for r in rows if end_of(r[1]) <= closed}
    assert len(done) == len({r["probe_id"] for r in done}) and all(r["unhealthy"] == (r["run"] >= 2) for r in done)
    assert {r["probe_id"] for r in spark.read.parquet(f"{root}/missed/late").collect()} == {9999, 9998}
    # What waits is in the state, and comes out when its time has come.
    spark.createDataFrame([(7777, at(99_999), "b", "eu", True)], PROBE).write.mode("append").parquet(inbox)
    run()
    done = read_runs(spark.createDataFrame([], PROBE), root).collect()
    assert {r["probe_id"]: r["run"] for r in done} == wanted and len(done) == len(rows)


def test_only_touched_states_change(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "watch")
    quiet = [(n, at(n), f"quiet{n}", "eu", False) for n in range(40)]
    for some in (quiet + [(900, at(500), "busy", "eu", True)], [(901, at(510), "busy", "eu", False), (902, at(900), "busy", "eu", False)]):
        spark.createDataFrame(some, PROBE).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(PROBE).parquet(inbox)
        query = watch_failure_runs(stream, root, KEYS, ORDER, ~F.col("healthy"), delay="1 minute", bucket="1 minute")
    updated = [[o["numRowsUpdated"] for o in p["stateOperators"]] for p in query.recentProgress]
    assert sum(map(sum, updated)) < 40, updated
    runs = {r["probe_id"]: r["run"] for r in read_runs(spark.createDataFrame([], PROBE), root).collect()}
    assert runs == {**{n: 1 for n in range(40)}, 900: 0, 901: 1}


def test_k_of_n_stream_equals_batch(spark, tmp_path):
    rows = [r for r in probes(random.Random(5), 900) if r[2]]
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "watch")
    for some in (rows[:300], rows[300:500], rows[500:]):
        spark.createDataFrame(some, PROBE).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(PROBE).parquet(inbox)
        watch_k_of_n(stream, root, ["endpoint"], ["checker_region"], ORDER, ~F.col("healthy"), k=2, threshold=2, delay="5 minutes", bucket="1 minute")
    closed = max(end_of(r[1]) for r in rows) - timedelta(minutes=5)
    runs, last = expected_runs(rows), {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if end_of(r[1]) <= closed:
            last[r[2:4]] = (runs[r[0]] < 2, end_of(r[1]))
    wanted = {}
    for (endpoint, _), (healthy, end) in last.items():
        n, up, at_ = wanted.get(endpoint, (0, 0, end))
        wanted[endpoint] = (n + 1, up + healthy, max(at_, end))
    got = {r["endpoint"]: r for r in read_health(spark.createDataFrame([], PROBE), root, ["endpoint"]).collect()}
    assert {e: (r["children"], r["healthy_children"], r["at"].replace(tzinfo=None)) for e, r in got.items()} == wanted
    assert all(r["healthy"] == (r["healthy_children"] >= 2) for r in got.values())


def many_keys(spark, inbox):
    """Two children of each of 2,000 parents, more than there are groups of keys, and a probe that closes their slice."""
    some = [(2 * n + c, at(n % 50), f"p{n}", r, (n + c) % 3 > 0) for n in range(2000) for c, r in enumerate(("eu", "us"))]
    spark.createDataFrame([*some, (9999, at(900), "late", "eu", True)], PROBE).write.mode("append").parquet(inbox)
    return spark.readStream.schema(PROBE).parquet(inbox), some


def calls(query):
    """State entries that each operator wrote, rows that wait for the end of their slice aside."""
    return [
        sum(p["stateOperators"][k]["numRowsUpdated"] for p in query.recentProgress)
        for k, o in enumerate(query.lastProgress["stateOperators"]) if o["operatorName"].startswith("transformWithState")
    ]


def test_k_of_n_calls_states_by_groups_of_keys(spark, tmp_path):
    stream, some = many_keys(spark, str(tmp_path / "inbox"))
    root = str(tmp_path / "watch")
    query = watch_k_of_n(stream, root, ["endpoint"], ["checker_region"], ORDER, ~F.col("healthy"), delay="1 minute", bucket="1 minute")
    assert len(calls(query)) == 2 and all(0 < n <= KEY_GROUPS < 2000 for n in calls(query))
    got = {r["endpoint"]: r["healthy_children"] for r in read_health(spark.createDataFrame([], PROBE), root, ["endpoint"]).collect()}
    assert got == {f"p{n}": (n % 3 > 0) + ((n + 1) % 3 > 0) for n in range(2000)}


def test_failure_runs_call_states_by_groups_of_keys(spark, tmp_path):
    stream, some = many_keys(spark, str(tmp_path / "inbox"))
    root = str(tmp_path / "watch")
    query = watch_failure_runs(stream, root, KEYS, ORDER, ~F.col("healthy"), delay="1 minute", bucket="1 minute")
    assert len(calls(query)) == 1 and 0 < calls(query)[0] <= KEY_GROUPS < 4000
    got = {r["probe_id"]: r["run"] for r in read_runs(spark.createDataFrame([], PROBE), root).collect()}
    assert got == expected_runs(some)


def test_kept_entries_are_appended_and_written_anew_when_outdated():
    class Kept(list):
        get, written = list.copy, 0

        def appendList(self, new):
            self += new
            self.written += sum(len(keys) for keys, *_ in new)

        def put(self, new):
            self.clear()
            self.appendList(new)

    state, rng, wanted = Kept(), random.Random(3), {}
    changes = 0
    for _ in range(500):
        changed = {f"k{k}": (rng.randrange(9), rng.randrange(9)) for k in rng.sample(range(40), rng.randrange(4))}
        wanted.update(changed)
        changes += len(changed)
        known, stored = _entries(state)
        _store(state, known, stored, changed)
        known, stored = _entries(state)
        assert known == wanted and stored <= 2 * len(wanted)
    assert state.written <= 3 * changes


def test_a_larger_table_makes_more_logs(spark, tmp_path, monkeypatch):
    """A task writes one log, so that one must not grow with the table; those of the second half go on from the first."""
    texts, folder = str(tmp_path), tmp_path / "logs"
    rows = [(n, f"line {n} {random.Random(n).random()}") for n in range(3000)]
    spark.createDataFrame([*rows, (9999, None)], "doc_id long, text string").repartition(3).write.parquet(f"{texts}/documents.parquet")
    monkeypatch.setattr(derived, "LOG_BYTES", 8000)
    sizes, seen = [], []
    for half in range(2):
        derived.grow_log(spark, texts, folder.as_uri(), half)
        logs = sorted(p for p in folder.iterdir() if not p.name.startswith("."))
        seen.append({p.name.removesuffix(".1"): p.read_text() for p in logs})
        sizes.append(max(p.stat().st_size for p in logs))
    assert len(seen[1]) > 2 * derived.LOG_FILES and sizes[1] < sum(map(len, seen[1].values())) / derived.LOG_FILES / 2
    assert sorted("".join(seen[1].values()).splitlines()) == sorted(text for _, text in rows)
    assert all(seen[1][name].startswith(text) for name, text in seen[0].items())


def test_alarm_stream_fans_out_closed_windows(spark, tmp_path):
    inbox, sinks = str(tmp_path / "inbox"), [str(tmp_path / "mail"), str(tmp_path / "queue")]
    frame = points(spark, (0, "a", 1.0), (200, "a", 1.0), (400, "b", 2.0), (90000, "a", 5.0))
    frame.write.parquet(inbox)
    stream = alarm_stream(spark.readStream.schema(METRIC_POINT).parquet(inbox))
    for _ in range(2):
        fan_out(stream, sinks, str(tmp_path / "checkpoint"))
    wanted = {r for r in map(tuple, threshold_alarm(frame).collect()) if r[2] <= at(90000 - 86400)}
    assert len(wanted) == 2
    for sink in sinks:
        got = spark.read.parquet(sink).drop("batch_id").collect()
        assert {tuple(r) for r in got} == wanted and len(got) == 2


def test_late_points_are_kept(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "late")
    alarms = str(tmp_path / "alarms")

    def run():
        stream = spark.readStream.schema(METRIC_POINT).parquet(inbox)
        watch_late_points(stream, root)
        fan_out(alarm_stream(stream), [alarms], str(tmp_path / "checkpoint"))

    # The second delivery holds a point of a window that is final by then, and one of a window that is not.
    for some in ([(0, "a", 1.0), (90000, "a", 2.0)], [(10, "b", 5.0), (80000, "b", 7.0)], [(200_000, "c", 1.0)]):
        points(spark, *some).write.mode("append").parquet(inbox)
        run()
    late = [(r["rule"], r["value"]) for r in spark.read.schema(METRIC_POINT).parquet(f"{root}/late/*").collect()]
    assert late == [("b", 5.0)]
    assert ("b", 5.0) not in {(r["rule"], r["total"]) for r in spark.read.parquet(alarms).collect()}
    replay(f"{root}/_checkpoint")
    run()
    assert spark.read.parquet(f"{root}/late/*").count() == 1


def replay(checkpoint):
    """Make the last batch look uncommitted, as after a crash between its writes and its commit."""
    folder = os.path.join(checkpoint, "commits")
    last = max(int(n) for n in os.listdir(folder) if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        path = os.path.join(folder, name)
        if os.path.exists(path):
            os.remove(path)


def test_fan_out_repeats_a_half_delivered_batch_once(spark, tmp_path):
    inbox, good, bad = (str(tmp_path / n) for n in ("inbox", "good", "bad"))
    frame = points(spark, (0, "a", 1.0), (90000, "a", 5.0))
    frame.write.parquet(inbox)
    stream = spark.readStream.schema(METRIC_POINT).parquet(inbox)
    (tmp_path / "bad").write_text("a file where a folder should be")
    with pytest.raises(StreamingQueryException):
        fan_out(stream, [good, bad], str(tmp_path / "checkpoint"))
    assert spark.read.parquet(good).count() == 2
    os.remove(bad)
    fan_out(stream, [good, bad], str(tmp_path / "checkpoint"))
    assert [spark.read.parquet(p).count() for p in (good, bad)] == [2, 2]


def test_watch_failure_runs_survives_a_replay(spark, tmp_path):
    rows = probes(random.Random(4), 300)
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "watch")

    def run():
        stream = spark.readStream.schema(PROBE).parquet(inbox)
        watch_failure_runs(stream, root, KEYS, ORDER, ~F.col("healthy"), delay="0 seconds", bucket="1 minute")

    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, PROBE).write.mode("append").parquet(inbox)
        run()
        replay(f"{root}/_checkpoint_runs")
        replay(f"{root}/missed/_checkpoint")
        run()
    late = [r["probe_id"] for r in spark.read.schema(PROBE).parquet(f"{root}/missed/late/*").collect()]
    taken = [r for r in rows if r[0] not in late]
    done = {r["probe_id"]: r["run"] for r in read_runs(spark.createDataFrame([], PROBE), root).collect()}
    assert done == expected_runs(taken) and len(late) < 20


def test_corrected_alarms_equal_the_batch(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "alarms")
    parts = [[(0, "a", 0.4), (90_000, "a", 2.0), (10, None, 3.0)], [(20, "a", 0.7), (80_000, "b", 7.0)], [(90_010, "a", 1.0), (25, "a", 0.0)]]
    versions = []
    for some in parts:
        points(spark, *some).write.mode("append").parquet(inbox)
        correct_alarms(spark.readStream.schema(METRIC_POINT).parquet(inbox), root)
        alarms = read_alarms(spark, root, METRIC_POINT["rule"], T.DoubleType())
        versions.append({(r["rule"], r["window_start"]): r["version"] for r in alarms.collect()})
    replay(f"{root}/_checkpoint")
    correct_alarms(spark.readStream.schema(METRIC_POINT).parquet(inbox), root)
    whole = threshold_alarm(points(spark, *[p for part in parts for p in part]))
    got = read_alarms(spark, root, METRIC_POINT["rule"], T.DoubleType()).drop("version")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    first = ("a", at(0))
    assert first not in versions[0] and versions[1][first] == 1 and versions[2][first] == 2 and versions[2][("b", at(79_800))] == 1


def test_readers_see_a_batch_when_all_sinks_have_it(spark, tmp_path):
    inbox, good, bad, checkpoint = (str(tmp_path / n) for n in ("inbox", "good", "bad", "checkpoint"))

    def seen(sink):
        return sorted(r["value"] for r in read_delivered(spark, sink, checkpoint, METRIC_POINT).collect())

    points(spark, (0, "a", 1.0)).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(METRIC_POINT).parquet(inbox)
    assert seen(good) == []
    fan_out(stream, [good, bad], checkpoint)
    os.rename(bad, f"{bad}.aside")
    (tmp_path / "bad").write_text("a file where a folder should be")
    points(spark, (10, "a", 2.0)).write.mode("append").parquet(inbox)
    with pytest.raises(StreamingQueryException):
        fan_out(stream, [good, bad], checkpoint)
    assert spark.read.parquet(good).count() == 2 and seen(good) == [1.0]
    os.remove(bad)
    os.rename(f"{bad}.aside", bad)
    fan_out(stream, [good, bad], checkpoint)
    assert seen(good) == seen(bad) == [1.0, 2.0]


def test_tail_text(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "access.log.1").write_text("GET /a\nx error:invalid-request y\n")
    for flag, wanted in ((True, 1), (False, 2)):
        name = f"tail_{wanted}"
        query = (
            tail_text(spark, str(folder), flag)
            .writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert spark.table(name).count() == wanted


def test_growing_logs_are_followed(spark, tmp_path, monkeypatch):
    folder, out = tmp_path / "log", str(tmp_path / "out")
    folder.mkdir()
    log = folder / "access.log"

    def run():
        query = (
            tail_text(spark, str(folder)).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(r["value"] for r in spark.read.schema("value string").parquet(out).collect())

    log.write_text("one\ntwo\nhalf a li")
    assert run() == ["one", "two"]
    assert run() == ["one", "two"]
    with log.open("a") as f:
        f.write("ne\n\nthree\n")
    wanted = ["", "half a line", "one", "three", "two"]
    assert run() == wanted
    with log.open("a") as f:
        f.write("four\n")
    log.rename(folder / "access.log.1")  # rotated with a line that has not been read
    log.write_text("new one\n")
    (folder / "_other").write_text("hidden\n")
    wanted = sorted([*wanted, "four", "new one"])
    assert run() == wanted
    (folder / "access.log.1").rename(folder / "access.log.2")
    log.rename(folder / "access.log.1")
    log.write_text("x\n")
    assert run() == sorted([*wanted, "x"])
    log.write_text("cut off\n")
    assert run() == sorted([*wanted, "x", "cut off"])


def test_splits_of_a_log_have_each_line_once(tmp_path, monkeypatch):
    lines = ["", "a", "bb" * 40, "é" * 3, "c", "d" * 200, "", "e"] * 7
    (tmp_path / "log").write_text("".join(f"{x}\n" for x in lines) + "no end")
    for split, chunk in ((1, 7), (3, 1), (50, 16), (10_000, 5)):
        monkeypatch.setattr(following, "SPLIT", split)
        monkeypatch.setattr(following, "CHUNK", chunk)
        follower = following._Follower(str(tmp_path))
        got = [v for part in follower.partitions({}, follower.latestOffset()) for b in follower.read(part) for v in b.column(0).to_pylist()]
        assert got == lines
