"""Failure runs and calculated health on a stream, kept in Spark's state store.

Rows wait in an aggregate by probe key and time slice until the watermark passes the end of their slice. What is carried on is kept
by groups of keys, as a call to the state costs more than what is done with a row: for each probe key the run with which it leaves its
last slice, and for each parent how many children it has and how many of them are healthy. Of the groups that closed slices touch, entries
that became others are appended; a group is written anew when half of its entries are outdated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle

from logsluice.functions.timeparts import instant
from logsluice.streaming.alarms import DELIVERY_DELAY

#: The state store these operators need, as a session setting.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: How rows are written to the state and read again, to the microsecond.
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}
_RUNS = "_key string, _end timestamp, rows array<string>, runs array<long>, entering long"
_HEALTH = "_parent string, _end timestamp, children long, healthy_children long"
#: Groups of keys whose state is called for together; a task holds the closed slices of one group at a time.
KEY_GROUPS = 1024


def _entries(state: ListState) -> tuple[dict[str, tuple], int]:
    """The newest entry of each key of a group, and how many are stored."""
    known, stored = {}, 0
    for keys, *values in state.get():
        known.update(zip(keys, zip(*values)))
        stored += len(keys)
    return known, stored


def _store(state: ListState, known: dict[str, tuple], stored: int, changed: dict[str, tuple]) -> None:
    if changed:
        known.update(changed)
        anew = stored + len(changed) > 2 * len(known)
        entries = known if anew else changed
        packed = [(list(entries), *map(list, zip(*entries.values())))]
        state.put(packed) if anew else state.appendList(packed)


class _Runs(StatefulProcessor):
    """The run with which each key of a group leaves its last closed slice."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getListState("runs", "keys array<string>, runs array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, stored = _entries(self._last)
        changed = {}
        for name, slices in groupby(sorted(map(tuple, rows), key=lambda r: r[1:3]), key=lambda r: r[1]):
            kept = known.get(name)
            entering = kept and kept[0]
            for _, _, end, held, failed in slices:
                runs, run = [], entering or 0
                for one in failed:
                    run = run + 1 if one else 0
                    runs.append(run)
                yield Row(_key=name, _end=end, rows=held, runs=runs, entering=entering)
                entering = run
            if kept != (entering,):
                changed[name] = (entering,)
        _store(self._last, known, stored, changed)

    def close(self) -> None:
        pass


class _Parents(StatefulProcessor):
    """How many children each parent of a group has, and how many of them are healthy."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sums = handle.getListState("sums", "parents array<string>, children array<long>, healthy array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, stored = _entries(self._sums)
        changed = {}
        for name, changes in groupby(sorted(map(tuple, rows), key=lambda r: r[1:3]), key=lambda r: r[1]):
            n, up = known.get(name, (0, 0))
            for end, together in groupby(changes, key=lambda r: r[2]):
                for _, _, _, more, more_up in together:
                    n, up = n + more, up + more_up
                yield Row(_parent=name, _end=end, children=n, healthy_children=up)
            if known.get(name) != (n, up):
                changed[name] = (n, up)
        _store(self._sums, known, stored, changed)

    def close(self) -> None:
        pass


def _by_group(frame: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """What ``processor`` makes of rows whose first columns are ``key`` and the end of a slice."""
    group = F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)).alias("_group")
    return frame.select(group, "*").groupBy("_group").transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName="_end"
    )


def _in_slices(
    probes: DataFrame, keys: list[str], order: list[str], failed: Column | str, delay: str, bucket: str, with_rows: bool = True
) -> DataFrame:
    """Closed slices of each key with the run of each of their rows, and the run with which the key enters, NULL in its first slice.

    Without rows, ``rows`` holds as many NULLs.
    """
    ts, *tie = order
    failed = F.col(failed) if isinstance(failed, str) else failed
    at = instant(probes, ts)
    slices = F.window(at, bucket)
    rows = (
        probes.where(F.col(ts).isNotNull())
        .select(
            F.to_json(F.struct(*[F.col(k) for k in keys]), _JSON).alias("_key"), slices["end"].alias("_end"),
            F.unix_micros(at).alias("_at"), (F.coalesce(F.col(tie[0]).cast("long"), F.lit(0)) if tie else F.lit(0).cast("long")).alias("_tie"),
            F.coalesce(failed, F.lit(False)).alias("_failed"), (F.to_json(F.struct("*"), _JSON) if with_rows else F.lit(None).cast("string")).alias("_row"),
        )
        # A slice is closed when a time of ``delay`` after its end has been seen, at the coarseness of slices.
        .withWatermark("_end", delay)
    )
    held = F.sort_array(F.collect_list(F.struct("_at", "_tie", "_failed", "_row")))
    closed = rows.groupBy("_key", "_end").agg(held.alias("_held"))
    return _by_group(closed.select("_key", "_end", "_held._row", "_held._failed"), "_key", _Runs(), _RUNS)


def failure_run_stream(
    probes: DataFrame, keys: list[str], order: list[str], failed: Column | str = "failed", threshold: int = 1,
    delay: str = DELIVERY_DELAY, bucket: str = "1 hour",
) -> DataFrame:
    """``failure_runs`` on a stream: rows with ``run`` and ``unhealthy``, once their slice of ``bucket`` is closed.

    A slice is closed as soon as a row came whose own slice ends ``delay`` later or more; what comes for
    it afterwards is left out (``late_probes`` keeps that). ``order`` is a time and, if times are not unique, one whole number. The session needs the
    settings ``STORE``.
    """
    closed = _in_slices(probes, keys, order, failed, delay, bucket)
    each = closed.select(F.explode(F.arrays_zip("rows", "runs")).alias("_x"))
    return each.select(F.from_json("_x.rows", probes.schema, _JSON).alias("_row"), F.col("_x.runs").alias("run")).select(
        "_row.*", "run", (F.col("run") >= threshold).alias("unhealthy")
    )


def k_of_n_stream(
    probes: DataFrame, parent: list[str], child: list[str], order: list[str], failed: Column | str = "failed", k: int = 2,
    threshold: int = 1, delay: str = DELIVERY_DELAY, bucket: str = "1 hour",
) -> DataFrame:
    """Health of each parent at the end of every closed slice in which one of its children was probed.

    A child is healthy while its failure run is below ``threshold``; a parent while ``k`` or more of the children known
    by then are. The last row of a parent is what ``k_of_n`` gives for all closed slices. This reads what
    ``failure_run_stream`` counts, in the same query, with a state of its own.
    """
    closed = _in_slices(probes, [*parent, *child], order, failed, delay, bucket, with_rows=False)
    key = T.StructType([probes.schema[c] for c in (*parent, *child)])
    new = F.col("entering").isNull()
    healthy, was = F.element_at("runs", -1) < threshold, ~new & (F.col("entering") < threshold)
    changes = closed.withColumn("_k", F.from_json("_key", key, _JSON)).select(
        F.to_json(F.struct(*[F.col(f"_k.{c}").alias(c) for c in parent]), _JSON).alias("_parent"), "_end",
        new.cast("long").alias("_new"), (healthy.cast("long") - was.cast("long")).alias("_up"),
    )
    changed = _by_group(changes, "_parent", _Parents(), _HEALTH)
    parents = T.StructType([probes.schema[c] for c in parent])
    return changed.select(
        F.from_json("_parent", parents, _JSON).alias("_p"), F.col("_end").alias("at"), "children", "healthy_children",
        (F.col("healthy_children") >= k).alias("healthy"),
    ).select("_p.*", "at", "children", "healthy_children", "healthy")
