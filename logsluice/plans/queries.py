"""Queries over the star-schema tables, one or more for each operator of the package."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.paths import HIVE_LAYOUT, LOG_FOLDER, folder_of, is_digest
from logsluice.functions.rules import event_pattern, failure_notice, json_paths
from logsluice.functions.text import is_noise, not_blank, without_prefix, zero_pad
from logsluice.functions.urls import before_first_dot, url_after, url_host
from logsluice.operators import partitions as P
from logsluice.operators.alarms import threshold_alarm
from logsluice.operators.availability import lookup, only_available, unpivot_matrix
from logsluice.operators.flatten import as_text, flatten, to_lake_rows
from logsluice.operators.health import calculated_health, k_of_n, latest_status
from logsluice.operators.runs import failure_runs
from logsluice.plans import catalog, derived, jobs
from logsluice.plans.derived import table
from logsluice.schemas import MATRIX_KINDS, lake_schema
from logsluice.session import at_end, scratch
from logsluice.sources.audit import (
    explode_records,
    lookback,
    month_slice,
    read_days,
    read_envelopes,
    scan_table,
)
from logsluice.sources.lake import read_lake, write_lake
from logsluice.sources.logs import tail_text
from logsluice.sources.manifest import file_manifest, leaf_prefixes
from logsluice.sources.matrix import read_matrix
from logsluice.sources.tables import read_delimited, read_price_list
from logsluice.streaming import ledger, loads
from logsluice.streaming.alarms import alarm_stream, correct_alarms, fan_out, read_alarms, read_delivered, watch_late_points
from logsluice.streaming.ingest import ingest
from logsluice.streaming.runs import read_health, read_runs, watch_failure_runs, watch_k_of_n

Query = Callable[[SparkSession, str], DataFrame]

EVENTS_AS_OF = date(2024, 1, 30)
AUDIT_AS_OF = date(2024, 2, 10)
AUDIT_MONTH = (2024, 2)
EVENT_KEYS = ("event_type", "year", "month", "day")
NOISE = ("the the", "an.")

_queries: dict[str, Query] = {}


def query(function: Query) -> Query:
    _queries[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_queries)


# --- projections -------------------------------------------------------------------------------


@query
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return derived.with_parts(events, "ts").drop("ts")


@query
def service_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = url_host("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", host.alias("host"), before_first_dot(host).alias("service")
    )


@query
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        url_host("url").alias("host"),
        url_after("url", "example.").alias("path"),
        without_prefix("url", "https://").alias("bare"),
    )


@query
def padded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    month = F.month("o_orderdate")
    return orders.select(
        "o_orderkey",
        zero_pad(month).alias("month"),
        F.format_string("(year == '%d' and month == '%s')", F.year("o_orderdate"), zero_pad(month)).alias("slice"),
        F.element_at(F.split("o_orderpriority", "-"), -1).alias("priority"),
    )


@query
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = json_paths("props", {"k": "$.k"})["k"]
    return table(spark, sf_dir, "events").select(
        "event_id", text.alias("k_text"), text.try_cast("int").alias("k")
    )


@query
def flatten_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested record with typed leaves, and text that does not convert."""
    nested = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("eventID"),
        F.struct(
            F.col("user_id").cast("string").alias("userName"),
            F.struct(
                F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("eventTime"),
                F.col("event_type").alias("eventSource"),
            ).alias("sessionContext"),
        ).alias("userIdentity"),
        (F.col("event_type") == "view").cast("string").alias("readOnly"),
        F.col("event_type").alias("managementEvent"),
        "value",
    )
    types = {
        "userIdentity.sessionContext.eventTime": "timestamp_ntz",
        "userIdentity.sessionContext.eventSource": "double",
        "userIdentity.userName": "bigint",
        "readOnly": "boolean",
        "managementEvent": "boolean",
    }
    return _flags_as_text(flatten(nested, nested.schema, types), "management_event")


def _flags_as_text(rows: DataFrame, *columns: str) -> DataFrame:
    """Flags that may be NULL, which two engines hand over differently unless they are text."""
    return rows.withColumns({c: F.col(c).cast("string") for c in columns})


@query
def nested_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested columns that leave as JSON text, next to one that is no struct at all."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.struct("user_id", "event_type").alias("who"),
        F.array("event_id", "user_id").alias("ids"),
        F.col("user_id").alias("plain"),
    )
    return as_text(events, "who", "ids", "plain")


@query
def alert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(event_pattern({"event_type": ["error"]}))
    detail = F.struct(F.struct(F.col("user_id").cast("string").alias("pipeline")).alias("detail"))
    return events.select("event_id", failure_notice(F.to_json(detail)).alias("message"))


# --- filters -----------------------------------------------------------------------------------


@query
def not_blank_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URL has a fragment; the text is wrapped in the white space that must not count."""
    fragment = F.concat(F.lit("\t "), F.split_part("url", F.lit("#"), F.lit(2)), F.lit(" \r\n"))
    pages = table(spark, sf_dir, "pages").select("page_id", fragment.alias("fragment"))
    return pages.where(not_blank("fragment"))


@query
def event_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern over a nested event: one source, two names, one state."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("source"),
        F.struct(
            F.get_json_object("props", "$.k").alias("jobName"),
            F.when(F.col("value") > 20, F.lit("FAILED")).otherwise("SUCCEEDED").alias("state"),
        ).alias("detail"),
    )
    pattern = {"source": ["error", "click"], "detail": {"jobName": ["1", "2", "3"], "state": ["FAILED"]}}
    return events.where(event_pattern(pattern)).select("event_id", "source", "detail.jobName")


@query
def month_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return month_slice(derived.day_keys(orders, "o_orderdate"), 1997, 5).drop("o_orderdate")


@query
def lookback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return lookback(derived.day_keys(events, "ts"), EVENTS_AS_OF).select("event_id", "ts")


@query
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of both log kinds, with digests left out."""
    folder = F.when(F.col("o_orderstatus") == "F", F.lit(f"{LOG_FOLDER}-Digest")).otherwise(LOG_FOLDER)
    path = F.concat_ws("/", F.lit("logs"), "o_custkey", folder, "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    return orders.where(~is_digest("path"))


@query
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return lines.where(~is_noise("line", NOISE))


# --- joins, sets, aggregates, limits -----------------------------------------------------------


@query
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account and region seen in the events, for two days."""
    events = table(spark, sf_dir, "events")
    pairs = events.select(F.col("user_id").alias("account"), F.col("event_type").alias("region"))
    days = P.candidates(pairs.distinct(), EVENTS_AS_OF)
    return days.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of orders; those of status P lack a level and must come out empty, not shifted."""
    folder = F.when(F.col("o_orderstatus") != "P", F.lit(LOG_FOLDER))
    location = F.concat_ws(
        "/", F.lit("s3://logs"), F.lpad(F.col("o_custkey").cast("string"), 12, "0"), folder,
        F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(""),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", location.alias("location"))
    return P.parse_locations(orders)


def _document_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("location")),
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("location")),
    )


@query
def new_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.new_partitions(*_document_sets(spark, sf_dir))


@query
def union_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, registered = _document_sets(spark, sf_dir)
    return found.unionByName(registered).distinct()


@query
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, registered = _document_sets(spark, sf_dir)
    return P.reconcile(registered, P.new_partitions(found, registered), found)


@query
def k_of_n_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is healthy when the last value of two or more of the event types is at least 20."""
    events = table(spark, sf_dir, "events").withColumn("ok", F.col("value") >= 20)
    latest = latest_status(events, ["user_id", "event_type"], tie="event_id", healthy="ok")
    return k_of_n(latest, "user_id", 2)


@query
def health_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region is healthy when two or more of its nations have a rich customer."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("r_name").alias("parent"), F.col("n_nationkey").alias("child"), F.lit(2).alias("threshold")
    )
    customer = table(spark, sf_dir, "customer")
    status = customer.groupBy(F.col("c_nationkey").alias("endpoint")).agg(
        (F.max("c_acctbal") >= 9900).alias("healthy")
    )
    return calculated_health(status, tree)


@query
def matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nested maps per event, opened into one row per cell."""
    flags = F.transform_values(F.from_json("props", "MAP<STRING, INT>"), lambda _, v: v >= 50)
    matrix = table(spark, sf_dir, "events").select(
        "event_id",
        F.create_map("event_type", flags).alias("by_type"),
        F.create_map(F.lit("value"), F.create_map(F.lit("above"), F.col("value") > 20)).alias("by_value"),
    )
    return unpivot_matrix(matrix, keep=("event_id",))


def _wanted_and_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders by their customer's nation and segment, and which such cells are available."""
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("service")
    )
    cells = customer.groupBy("region", "service").agg((F.max("c_acctbal") >= 9500).alias("available"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    wanted = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return wanted.select("o_orderkey", "region", "service"), cells


@query
def available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only_available(*_wanted_and_cells(spark, sf_dir), ["region", "service"])


@query
def availability_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(*_wanted_and_cells(spark, sf_dir), ["region", "service"])


@query
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(10)


# --- windows -----------------------------------------------------------------------------------


def _cents(column: str) -> Column:
    """Two decimals, summed exactly."""
    return F.col(column).cast("decimal(18,2)")


@query
def alarm_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    alarms = threshold_alarm(table(spark, sf_dir, "events"), rule="event_type", value=_cents("value"))
    return alarms.withColumn("total", F.col("total").cast("double"))


@query
def alarm_5min_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed windows of the same alarm on a stream, each delivered to two tables."""
    folder = scratch(spark, "alarms")
    sinks = {name: f"{folder}/{name}" for name in ("mail", "queue")}

    def take(events: DataFrame) -> None:
        alarms = alarm_stream(events, rule="event_type", value=_cents("value"))
        fan_out(alarms, sinks.values(), f"{folder}/checkpoint")

    derived.delivered(spark, sf_dir, take)
    schema = T.StructType.fromDDL("event_type string, window_start timestamp, window_end timestamp, total decimal(28,2)")
    first, second = (
        read_delivered(spark, path, f"{folder}/checkpoint", schema).withColumn("sink", F.lit(name)) for name, path in sinks.items()
    )
    return _alarm_view(first.unionByName(second))


def _alarm_view(alarms: DataFrame) -> DataFrame:
    return alarms.withColumns(
        {
            "window_start": F.col("window_start").cast("timestamp_ntz"),
            "window_end": F.col("window_end").cast("timestamp_ntz"),
            "total": F.col("total").cast("double"),
        }
    )


@query
def corrected_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarm by all points of three deliveries, those that came weeks late included."""
    root = scratch(spark, "corrected")
    derived.delivered(spark, sf_dir, lambda events: correct_alarms(events, root, rule="event_type", value=_cents("value")))
    alarms = read_alarms(spark, root, T.StructField("event_type", T.StringType()), T.DecimalType(28, 2))
    return _alarm_view(alarms.drop("version"))


@query
def failure_notices_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream that fit a pattern, as notices in two tables."""
    folder = scratch(spark, "notices")
    sinks = {name: f"{folder}/{name}" for name in ("mail", "queue")}

    def take(events: DataFrame) -> None:
        detail = F.struct(F.struct(F.col("event_type").alias("pipeline")).alias("detail"))
        failed = events.where(event_pattern({"event-type": ["error", "purchase"]}))
        fan_out(failed.select("event_id", failure_notice(F.to_json(detail)).alias("message")), sinks.values(), f"{folder}/checkpoint")

    derived.delivered(spark, sf_dir, take)
    schema = T.StructType.fromDDL("event_id long, message string")
    first, second = (
        read_delivered(spark, path, f"{folder}/checkpoint", schema).withColumn("sink", F.lit(name)) for name, path in sinks.items()
    )
    return first.unionByName(second)


@query
def late_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that came after their window was final."""
    root = scratch(spark, "late")
    derived.delivered(spark, sf_dir, lambda events: watch_late_points(events, root))
    schema = table(spark, sf_dir, "events").schema
    return spark.read.schema(schema).parquet(f"{root}/late/*")


def _probes(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))


@query
def failure_runs_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _probes(table(spark, sf_dir, "events"))
    return failure_runs(probes, ["user_id"], ["ts", "event_id"], threshold=2)


@query
def failure_runs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream: days before that of the newest row are closed."""
    root = scratch(spark, "failure_runs")

    def take(events: DataFrame) -> None:
        watch_failure_runs(_probes(events), root, ["user_id"], ["ts", "event_id"], threshold=2, bucket="1 day")

    derived.delivered(spark, sf_dir, take)
    return read_runs(_probes(table(spark, sf_dir, "events")), root)


@query
def k_of_n_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k_of_n_health`` on the stream: whether the last value of two or more event types is at least 20, by all closed days."""
    root = scratch(spark, "k_of_n")

    def probes(events: DataFrame) -> DataFrame:
        return events.select("event_id", "user_id", "event_type", "ts", (F.col("value") < 20).alias("failed"))

    def take(events: DataFrame) -> None:
        watch_k_of_n(probes(events), root, ["user_id"], ["event_type"], ["ts", "event_id"], bucket="1 day")

    derived.delivered(spark, sf_dir, take)
    health = read_health(probes(table(spark, sf_dir, "events")), root, ["user_id"])
    return health.withColumn("at", F.col("at").cast("timestamp_ntz"))


# --- readers -----------------------------------------------------------------------------------


@query
def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_delimited(spark, derived.delimited_files(spark, sf_dir))


@query
def price_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = read_price_list(spark, derived.price_list_files(spark, sf_dir))
    return prices.withColumn("priceperunit", F.col("priceperunit").try_cast("double"))


@query
def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text logs that grow and are rotated between two runs, followed as a stream, noise dropped, into a table."""
    folder, logs = scratch(spark, "tail"), scratch(spark, "logs")
    for half in range(2):
        derived.grow_log(spark, sf_dir, logs, half)
        lines = tail_text(spark, logs).where(~is_noise("value", NOISE))
        ingest(lines.withColumn("n_chars", F.length("value")), folder, keys=())
    return spark.read.schema("value STRING, n_chars INT").parquet(folder)


# --- the audit pipeline ------------------------------------------------------------------------


def _comparable(rows: DataFrame) -> DataFrame:
    """Instants as UTC wall clock without a zone, whatever the session's zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instants = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return rows.withColumns(
        {c: F.timestamp_add("MICROSECOND", F.unix_micros(c), epoch) for c in instants}
    )


@query
def audit_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip envelopes from delivery folders, exploded, flattened and typed."""
    files = read_envelopes(spark, HIVE_LAYOUT.glob(derived.log_tree(spark, sf_dir)))
    return _flags_as_text(_comparable(flatten(explode_records(files))), "management_event")


@query
def audit_two_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the folders of today and yesterday are listed."""
    root = derived.log_tree(spark, sf_dir)
    days = P.recent_days(AUDIT_AS_OF)
    return _lake_view(to_lake_rows(read_days(spark, root, days, HIVE_LAYOUT)))


@query
def endpoint_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_envelopes(spark, HIVE_LAYOUT.glob(derived.log_tree(spark, sf_dir)))
    to_lake_rows(explode_records(files)).createOrReplaceTempView("audit_rows")
    return _lake_view(catalog.endpoint_access(spark, "audit_rows"))


def _lake_view(rows: DataFrame) -> DataFrame:
    """All columns of lake rows, comparable between engines."""
    return _flags_as_text(_comparable(rows.select(*lake_schema().fieldNames())), "management_event")


def _loaded(spark: SparkSession, load: Callable[[str], object]) -> DataFrame:
    """Run a load twice into a fresh lake: the second run must add nothing."""
    dest = scratch(spark, "lake")
    load(dest)
    load(dest)
    return _lake_view(read_lake(spark, dest))


@query
def job_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = derived.log_tree(spark, sf_dir)
    return _loaded(spark, lambda dest: jobs.backfill(spark, root, dest, HIVE_LAYOUT))


@query
def job_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = derived.log_tree(spark, sf_dir)
    return _loaded(
        spark,
        lambda dest: jobs.backfill_month(spark, root, dest, *AUDIT_MONTH, HIVE_LAYOUT),
    )


@query
def job_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = derived.log_tree(spark, sf_dir)
    return _loaded(spark, lambda dest: jobs.incremental(spark, root, dest, AUDIT_AS_OF, HIVE_LAYOUT))


@query
def empty_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without folders load nothing and leave the lake as it is, before and after days that have some."""
    root, dest = derived.log_tree(spark, sf_dir), scratch(spark, "lake")
    for day in (date(1999, 1, 1), AUDIT_AS_OF, date(2099, 1, 1)):
        jobs.incremental(spark, root, dest, day, HIVE_LAYOUT)
    return _lake_view(read_lake(spark, dest))


@query
def job_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = derived.log_tree(spark, sf_dir)
    return _loaded(
        spark,
        lambda dest: jobs.incremental_lookback(spark, root, dest, AUDIT_AS_OF, 7, HIVE_LAYOUT),
    )


@query
def ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in turn, streamed into a partitioned lake, each time twice."""
    dest = scratch(spark, "events_lake")

    def take(events: DataFrame) -> None:
        for _ in range(2):
            ingest(derived.with_parts(events, "ts", "year", "month", "day"), dest, EVENT_KEYS)

    derived.delivered(spark, sf_dir, take)
    return _event_lake(spark, sf_dir, dest)


@query
def partition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch write by event-time partition, and the whole of it read back."""
    return _event_lake(spark, sf_dir, _written_events(spark, sf_dir))


@query
def partition_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lake, read by partition keys: half a month."""
    lake = _event_lake(spark, sf_dir, _written_events(spark, sf_dir))
    return lake.where((F.col("month") == 1) & (F.col("day") >= 15))


def _written_events(spark: SparkSession, sf_dir: str) -> str:
    dest = scratch(spark, "events_lake")
    events = table(spark, sf_dir, "events")
    write_lake(derived.with_parts(events, "ts", "year", "month", "day"), dest, EVENT_KEYS)
    return dest


def _event_lake(spark: SparkSession, sf_dir: str, dest: str) -> DataFrame:
    shape = derived.with_parts(table(spark, sf_dir, "events"), "ts", "year", "month", "day")
    return read_lake(spark, dest, shape.schema)


# --- catalog -----------------------------------------------------------------------------------


@query
def manifest_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf folders found by listing, with the values their paths carry."""
    leaves = leaf_prefixes(file_manifest(spark, derived.log_tree(spark, sf_dir)))
    return P.parse_locations(leaves, HIVE_LAYOUT).drop("location")


@query
def registered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per partition of the registered table."""
    records = scan_table(spark, derived.log_table(spark, sf_dir))
    return records.groupBy("accountid", "region", "year", "month", "day").agg(F.count("*").alias("records"))


#: A catalog table knows one spelling of this key only; all other columns are as the loads have them.
OTHER_IN_TABLES = "shared_event_id"


@query
def table_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = scan_table(spark, derived.log_table(spark, sf_dir))
    return _lake_view(to_lake_rows(month_slice(records, *AUDIT_MONTH))).drop(OTHER_IN_TABLES)


@query
def table_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = scan_table(spark, derived.log_table(spark, sf_dir))
    return _lake_view(to_lake_rows(lookback(records, AUDIT_AS_OF))).drop(OTHER_IN_TABLES)


@query
def lake_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat table over the whole tree, digests and all, converted, as a lake table."""
    owner, tag = derived.database(spark, sf_dir), scratch(spark, "x")[-8:]
    flat, dest = f"{owner}.flat_{tag}", scratch(spark, "lake")
    catalog.create_flat_log_table(spark, flat, derived.log_tree(spark, sf_dir))
    jobs.convert_table(spark, flat, dest, HIVE_LAYOUT)
    spark.sql(f"DROP TABLE {flat}")
    return _lake_view(_as_table(spark, sf_dir, dest))


@query
def loaded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table over a lake that two loads have filled, in days that overlap; before and after them one broke off."""
    root, dest = derived.log_tree(spark, sf_dir), scratch(spark, "lake")

    def broken_off(load: str) -> None:
        ledger.start(spark, dest, load)
        write_lake(to_lake_rows(read_days(spark, root, [AUDIT_AS_OF], HIVE_LAYOUT)), dest, load=load)

    broken_off("first")
    jobs.incremental(spark, root, dest, AUDIT_AS_OF, HIVE_LAYOUT)
    jobs.incremental(spark, root, dest, AUDIT_AS_OF + timedelta(days=1), HIVE_LAYOUT)
    broken_off("last")
    return _lake_view(_as_table(spark, sf_dir, dest))


def _as_table(spark: SparkSession, sf_dir: str, dest: str) -> DataFrame:
    name = f"{derived.database(spark, sf_dir)}.lake_{scratch(spark, 'x')[-8:]}"
    catalog.create_lake_table(spark, name, dest)
    catalog.publish_loads(spark, name, dest)
    return spark.table(name)


@query
def loaded_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month load and the lookback load, each told its files by the partitions of a catalog table."""
    name, dest = derived.log_table(spark, sf_dir), scratch(spark, "lake")
    jobs.backfill_month(spark, None, dest, *AUDIT_MONTH, HIVE_LAYOUT, table=name)
    jobs.incremental_lookback(spark, None, dest, AUDIT_AS_OF, 20, HIVE_LAYOUT, table=name)
    return _lake_view(read_lake(spark, dest))


@query
def quarantined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the two days that gave no records, by folder and problem."""
    dest = scratch(spark, "lake")
    jobs.incremental(spark, derived.log_tree(spark, sf_dir), dest, AUDIT_AS_OF, HIVE_LAYOUT)
    files = loads.quarantined_files(spark, dest).select(folder_of("path").alias("location"), "problem")
    found = P.parse_locations(files, HIVE_LAYOUT)
    return found.groupBy("accountid", "region", "year", "month", "day", "problem").agg(F.count("*").alias("files"))


@query
def account_layout_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf folders of a tree in the audit service's own layout, with the values their paths carry."""
    return P.parse_locations(leaf_prefixes(file_manifest(spark, derived.account_tree(spark, sf_dir)))).drop("location")


@query
def account_layout_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load by folder of the days of one month from such a tree."""
    dest = scratch(spark, "lake")
    jobs.backfill_month(spark, derived.account_tree(spark, sf_dir), dest, *AUDIT_MONTH)
    return _lake_view(read_lake(spark, dest))


@query
def matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An availability matrix file, opened into one row for each cell."""
    return unpivot_matrix(read_matrix(spark, derived.matrix_file(spark, sf_dir)).select(*MATRIX_KINDS))


@query
def shown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USE, CREATE, a multi-row INSERT and SHOW TABLES, of names and numbers of the regions."""
    place = scratch(spark, "shown")
    name = place.rsplit("/", 1)[1].replace("-", "_")
    catalog.create_database(spark, name, place)
    at_end(spark, lambda: spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE"))
    before = spark.catalog.currentDatabase()
    regions = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    try:
        spark.sql(f"USE {name}")
        spark.sql("CREATE TABLE regions (id INT, name STRING) USING parquet")
        values = ", ".join(f"({r['r_regionkey']}, {catalog.quoted(r['r_name'])})" for r in regions)
        spark.sql(f"INSERT INTO regions VALUES {values}")
        shown = spark.sql("SHOW TABLES").where("NOT isTemporary").select(F.col("tableName").alias("table_name"))
        rows = spark.table(f"{name}.regions")
    finally:
        spark.sql(f"USE {before}")
    return rows.join(shown, F.col("table_name") == "regions")


@query
def register_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reconcile report of registering everything found."""
    name = derived.log_table(spark, sf_dir, registered=False)
    return jobs.register_partitions(spark, derived.log_tree(spark, sf_dir), name, HIVE_LAYOUT)


@query
def register_two_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions in a new table after registering today and yesterday."""
    root = derived.log_tree(spark, sf_dir)
    name = f"{derived.database(spark, sf_dir)}.recent_{scratch(spark, 'x')[-8:]}"
    catalog.create_partitioned_log_table(spark, name, root)
    jobs.register_recent(spark, root, name, AUDIT_AS_OF, HIVE_LAYOUT)
    return catalog.registered_partitions(spark, name, HIVE_LAYOUT)


@query
def inserted_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A managed table that got the same rows by mistake a second time."""
    name = f"{derived.database(spark, sf_dir)}.people_{scratch(spark, 'x')[-8:]}"
    spark.sql(f"CREATE TABLE {name} (id BIGINT, first_name STRING, last_name STRING) USING parquet")
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer_rows")
    for _ in range(2):
        spark.sql(f"INSERT INTO {name} SELECT c_custkey, c_mktsegment, c_name FROM customer_rows")
    return spark.sql(f"SELECT * FROM {name}")
