import gzip
import json

from pyspark.sql import functions as F

from logsluice.operators.availability import lookup, only_available, unpivot_matrix
from logsluice.schemas import DELIMITED_PRICES, PRICE_LIST_COLUMNS
from logsluice.sources.matrix import read_matrix
from logsluice.sources.tables import read_delimited, read_price_list, typed_prices


def test_delimited_prices(spark, tmp_path):
    names = DELIMITED_PRICES.fieldNames()
    row = ["S1", "T", 'plain "quote', "", "RunInstances", "u", "eu", "svc", "m5", "Linux",
           "0.5", "0.75", "12.5", "100", "1", "All", "standard", "Reserved", "k",
           "1", "2", "3", "4", "8", "not a number"]
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("|".join(names) + "\n" + "|".join(row) + "\n")
    frame = read_delimited(spark, str(tmp_path))
    assert frame.schema == DELIMITED_PRICES
    rows = frame.collect()
    assert len(rows) == 2
    assert rows[0]["platform"] == 'plain "quote'
    assert (rows[0]["adjustedpriceperunit"], rows[0]["upfrontfee"], rows[0]["vcpu"]) == (0.5, 100, 8)
    assert rows[0]["memory"] is None


def test_price_list_preamble_over_many_splits(spark, tmp_path):
    def line(i):
        cells = [f"sku{i}", f"o,{i}"] + [f"c{n}" for n in range(2, 24)]
        cells[9] = "1.25" if i % 2 else "n/a"
        return ",".join(f'"{c}"' for c in cells)

    preamble = ['"FormatVersion","v1.0"', '"Disclaimer","x, y"', '"Date","2024"', '"Version","1"',
                '"OfferCode","db"', ",".join(f'"{c}"' for c in PRICE_LIST_COLUMNS)]
    (tmp_path / "big.csv").write_text("\n".join(preamble + [line(i) for i in range(5000)]) + "\n")
    (tmp_path / "small.csv").write_text("\n".join(preamble + [line(i) for i in range(5000, 5003)]))
    (tmp_path / "short.csv").write_text("\n".join(preamble[:3]))
    (tmp_path / "none.csv").write_text("")
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as f:
        f.write("\n".join(preamble + [line(i) for i in range(5003, 25_003)]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        frame = read_price_list(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
        assert frame.columns == list(PRICE_LIST_COLUMNS)
        rows = frame.select("sku", "offertermcode").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {tuple(r) for r in rows} == {(f"sku{i}", f"o,{i}") for i in range(25_003)}
    assert len(rows) == 25_003
    # Lines are read once, and none moves.
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan text") == 1 and not any(x in text for x in ("Exchange", "Join", "Sort", "Window", "Union"))
    prices = typed_prices(frame)
    assert prices.where(F.col("priceperunit") == 1.25).count() == 12_501
    assert prices.where(F.col("priceperunit").isNull()).count() == 12_502


def test_matrix_long_form_and_lookups(spark, tmp_path):
    content = {
        "InterfaceAvailableServicesByRegion": {
            "queue": {"eu-west-1": True, "us-east-1": False},
            "topic": {"eu-west-1": True},
        },
        "GatewayAvailableServicesByRegion": {"store": {"us-east-1": True}},
    }
    path = tmp_path / "matrix.json"
    path.write_text(json.dumps(content, indent=2))
    cells = unpivot_matrix(read_matrix(spark, str(path)))
    assert {tuple(r) for r in cells.collect()} == {
        ("InterfaceAvailableServicesByRegion", "queue", "eu-west-1", True),
        ("InterfaceAvailableServicesByRegion", "queue", "us-east-1", False),
        ("InterfaceAvailableServicesByRegion", "topic", "eu-west-1", True),
        ("GatewayAvailableServicesByRegion", "store", "us-east-1", True),
    }
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()
    wanted = spark.createDataFrame(
        [("queue", "eu-west-1"), ("queue", "us-east-1"), ("mail", "eu-west-1")],
        "service string, region string",
    )
    keys = ["service", "region"]
    found = {(r["service"], r["region"]): r["available"] for r in lookup(wanted, cells, keys).collect()}
    assert found == {
        ("queue", "eu-west-1"): True,
        ("queue", "us-east-1"): False,
        ("mail", "eu-west-1"): None,
    }
    assert [tuple(r) for r in only_available(wanted, cells, keys).collect()] == [("queue", "eu-west-1")]
