"""Inputs in the shapes the jobs read, derived by Spark from the star-schema tables.

Written trees and tables are made once per session and input folder, below the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.functions.paths import DIGEST_FOLDER, HIVE_LAYOUT, LOG_FOLDER
from logsluice.functions.timeparts import local_parts
from logsluice.operators.partitions import parse_locations, well_formed
from logsluice.plans import catalog
from logsluice.schemas import (
    DELIMITED_PRICES,
    DELIVERED_KEYS,
    MATRIX_KINDS,
    PRICE_LIST_COLUMNS,
    PRICE_LIST_PREAMBLE_LINES,
)
from logsluice.session import at_end, many_writers, scratch
from logsluice.sources.manifest import file_manifest, leaf_prefixes

# Records in a derived log file of a folder that has more, about; a folder that has fewer gets one file.
RECORDS_PER_FILE = 5000

_made: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    """The path (or name) made by ``make`` the first time it is asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        path = scratch(spark, name)
        make(path)
        _made[key] = path
    return _made[key]


def audit_records(events: DataFrame) -> DataFrame:
    """``events`` as audit records: delivery keys, and the record as JSON text.

    Delivery is six hours after the event, so evening events sit in the next day's folder. By ``k``: 0
    has an unreadable time; of 10, those ending in 3 name another account than their folder, in 4 another region, and in 7 a time
    without a zone; of 3, the first has a shared id in one spelling, the second in the other.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    # Four hours of the day, since a lake has a folder for each.
    happened = F.expr("ts + interval 16 days - make_interval(0, 0, 0, 0, hour(ts) % 6)")
    delivered = happened + F.expr("interval 6 hours")
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    account = F.lpad((F.col("user_id") % 2 + 1).cast("string"), 12, "0")
    region = F.concat(F.lit("region-"), F.floor(k / 50).cast("string"))
    user = F.col("user_id").cast("string")
    own_account = F.when(k % 10 == 3, F.lit("999999999999")).otherwise(account)
    own_region = F.when(k % 10 == 4, F.lit("elsewhere")).otherwise(region)
    time = F.when(k == 0, F.lit("unknown")).when(k % 10 == 7, F.date_format(happened, iso[:-3])).otherwise(F.date_format(happened, iso))

    def object_of(**fields) -> Column:
        return F.struct(*[v.alias(n) for n, v in fields.items()])

    identity = object_of(
        type=F.lit("User"),
        principalId=F.concat(F.lit("P"), user),
        arn=F.concat(F.lit("arn:user/"), user),
        accountId=own_account,
        userName=F.concat(F.lit("user"), user),
        sessionContext=object_of(
            attributes=object_of(
                mfaAuthenticated=(k >= 50).cast("string"),
                creationDate=F.date_format(F.date_trunc("day", happened), iso),
            ),
            sessionIssuer=object_of(
                type=F.lit("Role"), webIdFederationData=F.from_json("props", "k INT")
            ),
        ),
    )
    endpoint = F.when(F.col("event_type") == "click", F.concat(F.lit("vpce-"), k)).when(
        F.col("event_type") == "signup", F.lit(" \t\r\n ")
    )
    record = object_of(
        eventVersion=F.lit("1.08"),
        userIdentity=identity,
        eventTime=time,
        eventSource=F.concat("event_type", F.lit(".example.com")),
        eventName=F.initcap("event_type"),
        awsRegion=own_region,
        sourceIPAddress=F.concat(F.lit("10.0.0."), k),
        errorCode=F.when(F.col("event_type") == "error", F.lit("Failed")),
        requestParameters=F.from_json("props", "k INT"),
        requestID=F.concat(F.lit("r"), F.col("event_id").cast("string")),
        eventID=F.col("event_id").cast("string"),
        readOnly=F.col("event_type") == "view",
        managementEvent=F.when(k < 10, F.lit("maybe")).otherwise((k < 30).cast("string")),
        resources=F.array(object_of(accountId=own_account, type=F.col("event_type"))),
        recipientAccountId=own_account,
        sharedEventID=F.when(k % 3 < 2, F.concat(F.lit("s"), F.col("event_id").cast("string"))),
        vpcEndpointId=endpoint,
    )
    return events.select(
        "event_id",
        account.alias("accountid"),
        F.lit(LOG_FOLDER).alias("type"),
        region.alias("region"),
        F.date_format(delivered, "yyyy").alias("year"),
        F.date_format(delivered, "MM").alias("month"),
        F.date_format(delivered, "dd").alias("day"),
        k.alias("k"),
        F.when(k % 3 == 1, F.replace(F.to_json(record), F.lit('"sharedEventID"'), F.lit('"sharedEventId"')))
        .otherwise(F.to_json(record)).alias("record"),
    )


#: Files that hold no records, one of a kind in each folder with an event of that ``k``; the second and third are set aside.
BY_KEY = {60: '{"Records":[]}', 61: '{"Entries":[{"eventID":"x"}]}', 62: '{"Records":[{"eventID":'}


def log_tree(spark: SparkSession, sf_dir: str) -> str:
    """Gzip envelope files in delivery folders, one JSON object per file, and some files that are none.

    A digest file lies in a folder beside that of each file of records.
    """

    def make(path: str) -> None:
        records = audit_records(table(spark, sf_dir, "events"))
        # Dealt by the hash of the id to as many files as the folder needs: a file costs more than its records. There is a count for each folder.
        folder = F.struct(*DELIVERED_KEYS)
        needed = records.groupBy(folder.alias("folder")).agg(F.ceil(F.count("*") / RECORDS_PER_FILE).alias("files"))
        chunk = F.pmod(F.xxhash64("event_id"), F.col("files"))
        envelopes = (
            records.join(F.broadcast(needed), folder == F.col("folder"))
            .groupBy(*DELIVERED_KEYS, chunk.alias("chunk"))
            .agg(F.array_join(F.collect_list("record"), ",").alias("records"))
            .select(*DELIVERED_KEYS, F.concat(F.lit('{"Records":['), "records", F.lit("]}")).alias("value"))
        )
        digests = envelopes.withColumn("type", F.lit(DIGEST_FOLDER))
        odd = F.create_map(*[F.lit(x) for pair in BY_KEY.items() for x in pair])
        others = records.where(F.col("k").isin(list(BY_KEY))).dropDuplicates([*DELIVERED_KEYS, "k"]).select(*DELIVERED_KEYS, F.element_at(odd, F.col("k")).alias("value"))
        envelopes = envelopes.unionByName(digests).unionByName(others)
        writer = envelopes.write.option("compression", "gzip").option("maxRecordsPerFile", 1)
        with many_writers(spark):
            writer.partitionBy(*DELIVERED_KEYS).text(path)

    return once(spark, sf_dir, "logs", make)


def account_tree(spark: SparkSession, sf_dir: str) -> str:
    """The files of ``log_tree`` in plain folders, as the audit service lays them out, with digests."""

    def copy(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            attempt = TaskContext.get().taskAttemptId()
            store, root = fs.FileSystem.from_uri(path)
            for batch in batches:
                targets = []
                for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    *folders, name = file.split("/")[-7:]
                    folder = "/".join([root, *(part.split("=", 1)[1] for part in folders)])
                    store.create_dir(folder, recursive=True)
                    with store.open_output_stream(f"{folder}/.{name}-{attempt}") as out:
                        out.write(content.as_buffer())
                    store.move(f"{folder}/.{name}-{attempt}", f"{folder}/{name}")
                    targets.append(f"{folder}/{name}")
                yield pa.RecordBatch.from_pydict({"path": targets})

        return work

    def make(path: str) -> None:
        # Spark names folders key=value itself, so tasks write the files, which are small.
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(log_tree(spark, sf_dir))
        rows.select("path", "content").mapInArrow(copy(path), "path string").write.format("noop").mode("overwrite").save()

    return once(spark, sf_dir, "account_logs", make)


def matrix_file(spark: SparkSession, sf_dir: str) -> str:
    """Market segments by nation as an availability matrix: in the first kind if a customer is rich, in the second if one is poor."""

    def make(path: str) -> None:
        customer = table(spark, sf_dir, "customer")
        cells = customer.groupBy("c_mktsegment", "c_nationkey").agg(
            (F.max("c_acctbal") >= 9500).alias("rich"), (F.min("c_acctbal") < 0).alias("poor")
        )
        maps = [
            F.map_from_entries(F.collect_list(F.struct(F.col("c_nationkey").cast("string"), flag))).alias(flag)
            for flag in ("rich", "poor")
        ]
        services = cells.groupBy("c_mktsegment").agg(*maps)
        kinds = [
            F.map_from_entries(F.collect_list(F.struct("c_mktsegment", flag))).alias(kind)
            for flag, kind in zip(("rich", "poor"), MATRIX_KINDS)
        ]
        services.agg(*kinds).coalesce(1).write.json(path)

    return once(spark, sf_dir, "matrix", make)


def database(spark: SparkSession, sf_dir: str) -> str:
    """A database of our own in the session's catalog."""

    def make(path: str) -> None:
        catalog.create_database(spark, _catalog_name(path), path)
        at_end(spark, lambda: spark.sql(f"DROP DATABASE IF EXISTS {_catalog_name(path)} CASCADE"))

    return _catalog_name(once(spark, sf_dir, "db", make))


def _catalog_name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def log_table(spark: SparkSession, sf_dir: str, registered: bool = True) -> str:
    """A partitioned catalog table over ``log_tree``, with or without its partitions."""
    root, owner = log_tree(spark, sf_dir), database(spark, sf_dir)

    def make(path: str) -> None:
        name = f"{owner}.{_catalog_name(path)}"
        catalog.create_partitioned_log_table(spark, name, root)
        if registered:
            found = parse_locations(leaf_prefixes(file_manifest(spark, root)), HIVE_LAYOUT)
            catalog.add_partitions(spark, name, well_formed(found, HIVE_LAYOUT))

    kind = "logs_registered" if registered else "logs_new"
    return f"{owner}.{_catalog_name(once(spark, sf_dir, kind, make))}"


def day_keys(frame: DataFrame, column: str) -> DataFrame:
    """Text year, month and day keys, zero-padded."""
    return frame.withColumns(
        {
            "year": F.date_format(column, "yyyy"),
            "month": F.date_format(column, "MM"),
            "day": F.date_format(column, "dd"),
        }
    )


def with_parts(frame: DataFrame, column: str, *names: str) -> DataFrame:
    parts = local_parts(column)
    return frame.withColumns({n: parts[n] for n in names or parts})


def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` under the columns of the pipe-delimited price table."""
    line = table(spark, sf_dir, "lineitem")
    sources = {
        "sku": F.concat_ws("-", "l_orderkey", "l_linenumber"),
        "offertermcode": F.col("l_returnflag"),
        "platform": F.concat(F.lit('"'), "l_linestatus", F.lit('" box')),
        "tenancy": F.lit("shared"),
        "operation": F.concat(F.lit("op, "), "l_returnflag"),
        "usagetype": F.col("l_linestatus"),
        "region": F.col("l_suppkey").cast("string"),
        "service": F.col("l_partkey").cast("string"),
        "adjustedpriceperunit": F.col("l_discount"),
        "ondemandhourlycost": F.col("l_tax"),
        "upfrontfee": F.col("l_orderkey"),
        "leaseterm": F.col("l_linenumber").cast("bigint"),
        "termtype": F.when(F.col("l_returnflag") == "R", F.lit("Reserved")),
        "key": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "reservedinstancecost": F.col("l_extendedprice"),
        "vcpu": F.col("l_suppkey"),
        "memory": F.col("l_quantity"),
    }
    columns = [
        sources.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in DELIMITED_PRICES.fields
    ]
    return line.select(*columns)


def delimited_files(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        rows = delimited_rows(spark, sf_dir)
        rows.write.options(sep="|", header="true", quote="", emptyValue="").csv(path)

    return once(spark, sf_dir, "delimited", make)


def price_list_files(spark: SparkSession, sf_dir: str) -> str:
    """``part`` as quoted CSV files, plain and gzip, that each start with a preamble."""
    sources = {
        "sku": F.col("p_partkey").cast("string"),
        "ratecode": F.concat_ws(", ", "p_brand", "p_type"),
        "pricedescription": F.col("p_name"),
        "priceperunit": F.col("p_retailprice").cast("string"),
        "startingrange": F.col("p_size").cast("string"),
        "currency": F.lit("USD"),
    }
    cells = [
        F.concat(F.lit('"'), sources.get(name, F.lit("")), F.lit('"')) for name in PRICE_LIST_COLUMNS
    ]
    preamble = "".join(f'"line {n}","of, the preamble"\n' for n in range(PRICE_LIST_PREAMBLE_LINES))
    # A task writes one file, and its first row is the one with no count below the task number.
    first_of_file = F.monotonically_increasing_id() % 2**33 == 0

    def make(path: str) -> None:
        line = F.concat(F.when(first_of_file, F.lit(preamble)).otherwise(""), F.concat_ws(",", *cells))
        part = table(spark, sf_dir, "part")
        for packed, compression in enumerate(("none", "gzip")):
            rows = part.where(F.col("p_partkey") % 2 == packed).select(line.alias("value"))
            rows.write.mode("append").option("compression", compression).text(path)

    return once(spark, sf_dir, "price_list", make)


#: Of each so many events the last of those of the first week is delivered far too late.
LATE_EVERY = 97


def deliveries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """``events`` in three deliveries that overlap in time by some hours, the third with a few that are weeks late."""
    events = table(spark, sf_dir, "events")
    due = F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 6 as int))")
    late = (F.col("event_id") % LATE_EVERY == 5) & (F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    third = F.when(late, 2).when(due < F.lit("2024-01-10").cast("timestamp_ntz"), 0).when(due < F.lit("2024-01-20").cast("timestamp_ntz"), 1).otherwise(2)
    return [events.where(third == n) for n in range(3)]


def delivered(spark: SparkSession, sf_dir: str, take: Callable[[DataFrame], object]) -> None:
    """Put one delivery after the other into a folder, and call ``take`` with the folder as a stream after each."""
    inbox = scratch(spark, "inbox")
    for rows in deliveries(spark, sf_dir):
        rows.write.mode("append").parquet(inbox)
        take(spark.readStream.schema(rows.schema).parquet(inbox))


#: Files of the text log that grows, at least, and bytes of ``documents`` for each in larger tables.
LOG_FILES = 4
LOG_BYTES = 16 << 20


def log_files(spark: SparkSession, sf_dir: str) -> int:
    """How many logs ``documents`` makes: a task writes one, so their number grows with the table."""
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet").select("length")
    return max(LOG_FILES, -(-(sizes.agg(F.sum("length")).first()[0] or 0) // LOG_BYTES))


def grow_log(spark: SparkSession, sf_dir: str, folder: str, half: int) -> None:
    """Write the lines of ``documents`` as text logs: those of even ids (``half`` 0), and then, in the same files, of all."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, own = f"{root}/access-{task.partitionId()}.log", f"{root}/.{task.taskAttemptId()}"
        with store.open_output_stream(own) as out:
            for batch in batches:
                out.write("".join(f"{text}\n" for text in batch.column("text").to_pylist()).encode())
        if half and task.partitionId() == 0:  # this one is rotated, and goes on under its new name
            name, old = f"{name}.1", name
            if store.get_file_info(old).type != fs.FileType.NotFound:
                store.delete_file(old)
        store.move(own, name)
        yield pa.RecordBatch.from_pydict({"name": [name]})

    odd = F.pmod("doc_id", F.lit(2))
    texts = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & (odd <= half)).select(odd.alias("odd"), "doc_id", "text")
    files = texts.repartition(log_files(spark, sf_dir), "doc_id").sortWithinPartitions("odd", "doc_id").mapInArrow(write, "name string")
    files.write.format("noop").mode("overwrite").save()
