"""Explicit schemas. Nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

from logsluice.functions.names import snake_case



def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names.split()]


def _texts(names: str) -> list[T.StructField]:
    return _fields(T.StringType(), names)


def _struct(name: str, *fields: T.StructField) -> T.StructField:
    return T.StructField(name, T.StructType(list(fields)))


# The keys of one audit record as its JSON spells them (the reader matches case).
# Fields that hold free-form JSON are declared text, so the reader keeps them as they are.
RECORD = T.StructType(
    [
        *_texts("eventVersion"),
        _struct(
            "userIdentity",
            *_texts("type principalId arn accountId invokedBy accessKeyId userName"),
            _struct(
                "sessionContext",
                _struct("attributes", *_texts("mfaAuthenticated creationDate")),
                _struct(
                    "sessionIssuer",
                    *_texts("type principalId arn accountId userName webIdFederationData"),
                ),
            ),
        ),
        *_texts(
            """
            eventTime eventSource eventName awsRegion sourceIPAddress userAgent errorCode
            errorMessage requestParameters responseElements additionalEventData requestID eventID
            eventType apiVersion readOnly resources recipientAccountId serviceEventDetails
            sharedEventID vpcEndpointId managementEvent
            """
        ),
    ]
)

# Leaves that leave the load with a type other than text.
TYPED_LEAVES = {
    "userIdentity.sessionContext.attributes.creationDate": "timestamp",
    "eventTime": "timestamp",
    "readOnly": "boolean",
    "managementEvent": "boolean",
}


def record_schema(spelling: dict[str, str] | None = None) -> T.StructType:
    """The record schema, with top-level keys respelled for sources that write them otherwise.

    ``record_schema({"sharedEventID": "sharedEventId"})`` reads the other spelling; the
    flattened name is the same for both.
    """
    spelling = spelling or {}
    return T.StructType(
        [T.StructField(spelling.get(f.name, f.name), f.dataType, f.nullable) for f in RECORD.fields]
    )


def envelope_schema(record: T.StructType = RECORD) -> T.StructType:
    """One log file: an object with a single ``Records`` array."""
    return T.StructType([T.StructField("Records", T.ArrayType(record))])


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all non-struct fields, in schema order."""
    paths = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            paths += leaf_paths(field.dataType, f"{path}.")
        else:
            paths.append(path)
    return paths


# Keys of the source by delivery folder, and keys of the lake, outermost first.
DELIVERED_KEYS = ("accountid", "type", "region", "year", "month", "day")
LAKE_KEYS = ("account_id", "service", "event_name", "region", "year", "month", "day", "hour")


def lake_schema() -> T.StructType:
    """Data columns in record order, then the partition keys.

    ``event_name`` is a key only; text keys stay text so account ids keep their zeros.
    """
    types = {"timestamp": T.TimestampType(), "boolean": T.BooleanType()}
    data = [
        T.StructField(snake_case(path), types.get(TYPED_LEAVES.get(path), T.StringType()))
        for path in leaf_paths(RECORD)
        if snake_case(path) not in LAKE_KEYS
    ]
    keys = [
        T.StructField(key, T.IntegerType() if key in LAKE_KEYS[4:] else T.StringType())
        for key in LAKE_KEYS
    ]
    return T.StructType(data + keys)


# Columns of the pipe-delimited price table.
DELIMITED_PRICES = T.StructType(
    [
        *_texts("sku offertermcode platform tenancy operation usagetype region service"),
        *_texts("instancetype operatingsystem"),
        *_fields(T.DoubleType(), "adjustedpriceperunit ondemandhourlycost breakevenpercentage"),
        *_fields(T.LongType(), "upfrontfee leaseterm"),
        *_texts("purchaseoption offeringclass termtype key"),
        *_fields(T.DoubleType(), "reservedinstancecost ondemandcostforterm"),
        *_fields(T.DoubleType(), "costsavings percentsavings"),
        *_fields(T.LongType(), "vcpu"),
        *_fields(T.DoubleType(), "memory"),
    ]
)

# Columns of the quoted price list, all text, and the lines above its data.
PRICE_LIST_COLUMNS = (
    "sku", "offertermcode", "ratecode", "termtype", "pricedescription", "effectivedate",
    "startingrange", "endingrange", "unit", "priceperunit", "currency", "leasecontractlength",
    "purchaseoption", "offeringclass", "product family", "servicecode", "location",
    "location type", "volume type", "group", "group description", "usagetype", "operation",
    "servicename",
)
PRICE_LIST = T.StructType([T.StructField(name, T.StringType()) for name in PRICE_LIST_COLUMNS])
PRICE_LIST_PREAMBLE_LINES = 6

# Top-level keys of the availability matrix.
MATRIX_KINDS = ("InterfaceAvailableServicesByRegion", "GatewayAvailableServicesByRegion")
MATRIX_CELLS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.BooleanType()))
MATRIX = T.StructType([T.StructField(kind, MATRIX_CELLS) for kind in MATRIX_KINDS])

# Operational feeds.
STATE_CHANGE = T.StructType(
    [
        *_fields(T.TimestampType(), "time"),
        *_texts("source detail_type"),
        _struct("detail", *_texts("jobName pipeline state")),
    ]
)
METRIC_POINT = T.StructType(
    [
        *_fields(T.TimestampType(), "ts"),
        *_texts("metric rule"),
        *_fields(T.DoubleType(), "value"),
    ]
)
PROBE = T.StructType(
    [
        *_fields(T.LongType(), "probe_id"),
        *_fields(T.TimestampType(), "ts"),
        *_texts("endpoint checker_region"),
        *_fields(T.BooleanType(), "healthy"),
    ]
)
