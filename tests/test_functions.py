import json
from datetime import date, datetime

from pyspark.sql import functions as F

from logsluice.functions.rules import event_pattern, failure_notice, message
from logsluice.functions.text import is_noise, not_blank, without_prefix, zero_pad
from logsluice.functions.timeparts import partition_date
from logsluice.functions.urls import before_first_dot, url_after, url_host
from logsluice.schemas import STATE_CHANGE


def values(spark, column, *inputs, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, c {kind}")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def test_not_blank(spark):
    inputs = ("x", " x ", "", " ", "\t\r\n ", " \t \n", None, " ")
    assert values(spark, not_blank("c"), *inputs) == [True, True, False, False, False, False, None, True]


def test_not_blank_equals_the_saved_sql(spark):
    sql = F.expr(
        "ltrim(rtrim(replace(replace(replace(c,chr(9),''),chr(10),''),chr(13),''))) <> ''"
    )
    inputs = ("x", "", "\t\r\n ", "a\tb", None, " \n x")
    assert values(spark, not_blank("c"), *inputs) == values(spark, sql, *inputs)


def test_noise(spark):
    inputs = ("GET error:invalid-request -", "error:transaction-end-before-headers", "GET /", "errorXinvalid-request")
    assert values(spark, is_noise("c"), *inputs) == [True, True, False, False]
    assert values(spark, is_noise("c", ("a.b|",)), "a.b|", "axb|", "a.b") == [True, False, False]


def test_padding_and_prefix(spark):
    assert values(spark, zero_pad("c"), "1", "12", "123", None) == ["01", "12", "123", None]
    assert values(spark, without_prefix("c", "s3://b/"), "s3://b/x/y", "x/s3://b/", None) == ["x/y", "x/s3://b/", None]


def test_partition_date(spark):
    frame = spark.createDataFrame(
        [("2024", "02", "29"), ("2023", "02", "29"), ("2024", "2", "9")], "year string, month string, day string"
    )
    assert [r[0] for r in frame.select(partition_date()).collect()] == [date(2024, 2, 29), None, date(2024, 2, 9)]


def test_url_parts(spark):
    url = "https://abc.execute.example.net/prod/health?x=1"
    assert values(spark, url_host("c"), url, "nonsense") == ["abc.execute.example.net", None]
    assert values(spark, url_after("c", "example.net/"), url, "nonsense") == ["/prod/health?x=1", None]
    assert values(spark, before_first_dot("c"), "s3.example.com", "plain", "", None) == ["s3", "plain", "", None]


FAILED = {
    "source": ["jobs"],
    "detail-type": ["Job State Change"],
    "detail": {"jobName": ["load", "register"], "state": ["FAILED"]},
}


def test_event_pattern(spark):
    when = datetime(2024, 1, 1)
    rows = [
        (when, "jobs", "Job State Change", ("load", None, "FAILED")),
        (when, "jobs", "Job State Change", ("register", None, "FAILED")),
        (when, "jobs", "Job State Change", ("other", None, "FAILED")),
        (when, "jobs", "Job State Change", ("load", None, "SUCCEEDED")),
        (when, "jobs", "Something else", ("load", None, "FAILED")),
        (when, None, "Job State Change", ("load", None, "FAILED")),
        (when, "jobs", "Job State Change", None),
    ]
    events = spark.createDataFrame(rows, STATE_CHANGE)
    hits = events.where(event_pattern(FAILED)).select("detail.jobName").collect()
    assert [r[0] for r in hits] == ["load", "register"]
    assert events.where(event_pattern({})).count() == len(rows)


def test_event_pattern_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([], STATE_CHANGE).write.parquet(str(tmp_path / "events"))
    frame = spark.read.parquet(str(tmp_path / "events")).where(event_pattern(FAILED))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,jobs)" in plan or "In(source" in plan


def test_notices(spark):
    event = json.dumps({"detail": {"pipeline": "deploy", "state": "FAILED"}})
    assert values(spark, failure_notice("c"), event, "{}") == [
        "The Pipeline deploy has failed.",
        "The Pipeline  has failed.",
    ]
    two = message("<a>-<b>!", {"a": F.lit(1), "b": F.col("c")})
    assert values(spark, two, "x") == ["1-x!"]
