"""The same results as plain SQL over the star-schema tables, for a second engine."""

from __future__ import annotations

from logsluice.plans.queries import AUDIT_AS_OF, AUDIT_MONTH, EVENTS_AS_OF, NOISE
from logsluice.schemas import DELIMITED_PRICES, PRICE_LIST_COLUMNS

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
HAPPENED = "(ts + INTERVAL 16 DAY - to_hours(hour(ts) % 6))"
DELIVERED = f"({HAPPENED} + INTERVAL 6 HOUR)"

AUDIT = f"""
audit AS (
  SELECT *, CASE WHEN k % 10 = 3 THEN '999999999999' ELSE folder_account END AS account,
    CASE WHEN k % 10 = 4 THEN 'elsewhere' ELSE folder_region END AS region,
    CASE WHEN k % 3 < 2 THEN 's' || event_id END AS shared
  FROM (
    SELECT event_id, user_id, event_type, {K} AS k,
      lpad(CAST(user_id % 2 + 1 AS VARCHAR), 12, '0') AS folder_account,
      'region-' || CAST({K} // 50 AS VARCHAR) AS folder_region,
      {HAPPENED} AS happened,
      CASE WHEN {K} <> 0 THEN date_trunc('second', {HAPPENED}) END AS event_time,
      CAST(date_trunc('day', {DELIVERED}) AS DATE) AS delivered,
      CASE event_type WHEN 'click' THEN 'vpce-' || CAST({K} AS VARCHAR)
        WHEN 'signup' THEN ' ' || chr(9) || chr(13) || chr(10) || ' ' END AS vpc_endpoint_id
    FROM events)
)
"""

FOLDERS = f"""
{AUDIT}, folders AS (
  SELECT event_id, k, folder_account AS accountid, 'CloudTrail' AS type, folder_region AS region,
    strftime(delivered, '%Y') AS year, strftime(delivered, '%m') AS month,
    strftime(delivered, '%d') AS day, delivered
  FROM audit
)
"""


def _two_days(column: str = "delivered") -> str:
    return f"{column} BETWEEN DATE '{AUDIT_AS_OF}' - 1 AND DATE '{AUDIT_AS_OF}'"


FLAT_COLUMNS = f"""
  '1.08' AS event_version,
  'User' AS user_identity_type,
  'P' || user_id AS user_identity_principal_id,
  'arn:user/' || user_id AS user_identity_arn,
  account AS user_identity_account_id,
  CAST(NULL AS VARCHAR) AS user_identity_invoked_by,
  CAST(NULL AS VARCHAR) AS user_identity_access_key_id,
  'user' || user_id AS user_identity_user_name,
  CASE WHEN k >= 50 THEN 'true' ELSE 'false' END
    AS user_identity_session_context_attributes_mfa_authenticated,
  CAST(date_trunc('day', happened) AS TIMESTAMP)
    AS user_identity_session_context_attributes_creation_date,
  'Role' AS user_identity_session_context_session_issuer_type,
  CAST(NULL AS VARCHAR) AS user_identity_session_context_session_issuer_principal_id,
  CAST(NULL AS VARCHAR) AS user_identity_session_context_session_issuer_arn,
  CAST(NULL AS VARCHAR) AS user_identity_session_context_session_issuer_account_id,
  CAST(NULL AS VARCHAR) AS user_identity_session_context_session_issuer_user_name,
  '{{"k":' || k || '}}' AS user_identity_session_context_session_issuer_web_id_federation_data,
  event_time AS event_time,
  event_type || '.example.com' AS event_source,
  upper(event_type[1]) || event_type[2:] AS event_name,
  region AS aws_region,
  '10.0.0.' || k AS source_ip_address,
  CAST(NULL AS VARCHAR) AS user_agent,
  CASE WHEN event_type = 'error' THEN 'Failed' END AS error_code,
  CAST(NULL AS VARCHAR) AS error_message,
  '{{"k":' || k || '}}' AS request_parameters,
  CAST(NULL AS VARCHAR) AS response_elements,
  CAST(NULL AS VARCHAR) AS additional_event_data,
  'r' || event_id AS request_id,
  CAST(event_id AS VARCHAR) AS event_id,
  CAST(NULL AS VARCHAR) AS event_type,
  CAST(NULL AS VARCHAR) AS api_version,
  audit.event_type = 'view' AS read_only,
  '[{{"accountId":"' || account || '","type":"' || audit.event_type || '"}}]' AS resources,
  account AS recipient_account_id,
  CAST(NULL AS VARCHAR) AS service_event_details,
  shared AS shared_event_id,
  vpc_endpoint_id,
  CASE WHEN k >= 10 THEN CASE WHEN k < 30 THEN 'true' ELSE 'false' END END AS management_event
"""

AUDIT_FLAT = f"WITH {AUDIT} SELECT {FLAT_COLUMNS} FROM audit"


def _lake(where: str = "TRUE", by_folder: bool = False) -> str:
    """Lake rows, with the account and region of the record or of the folder."""
    account, region = ("folder_account", "folder_region") if by_folder else ("account", "audit.region")
    return f"""
        WITH {AUDIT}
        SELECT {FLAT_COLUMNS},
          {account} AS account_id, event_type AS service, {region} AS region,
          CAST(year(event_time) AS INTEGER) AS year, CAST(month(event_time) AS INTEGER) AS month,
          CAST(day(event_time) AS INTEGER) AS day, CAST(hour(event_time) AS INTEGER) AS hour
        FROM audit WHERE {where}"""


PATH = (
    "concat_ws('/', 's3://logs', lpad(CAST(o_custkey AS VARCHAR), 12, '0'),"
    " CASE WHEN o_orderstatus <> 'P' THEN 'CloudTrail' END, o_orderpriority,"
    " strftime(o_orderdate, '%Y/%m/%d'), '')"
)
HAS_ALL_LEVELS = "CASE WHEN o_orderstatus <> 'P' THEN"

#: Days that are closed once the newest event is there.
CLOSED_DAY = "date_trunc('day', ts) <= (SELECT date_trunc('day', max(ts)) FROM events) - INTERVAL 1 DAY"

LATE = "(event_id % 97 = 5 AND ts < TIMESTAMP '2024-01-08')"


def _runs(where: str = "TRUE") -> str:
    return f"""
WITH numbered AS (
  SELECT event_id, user_id, ts, event_type = 'error' AS failed,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE {where}
), marked AS (
  SELECT *, max(CASE WHEN NOT failed THEN n END)
    OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS last_ok
  FROM numbered
)
SELECT event_id, user_id, ts, failed, n - coalesce(last_ok, 0) AS run,
  n - coalesce(last_ok, 0) >= 2 AS unhealthy
FROM marked
"""


def _alarms(where: str = "TRUE") -> str:
    return f"""
SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start,
  time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
  CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM events WHERE {where} GROUP BY ALL HAVING sum(CAST(value AS DECIMAL(18, 2))) >= 1
"""

WANTED = """
wanted AS (
  SELECT o_orderkey, c_nationkey AS region, c_mktsegment AS service
  FROM orders JOIN customer ON o_custkey = c_custkey
), cells AS (
  SELECT c_nationkey AS region, c_mktsegment AS service, max(c_acctbal) >= 9500 AS available
  FROM customer GROUP BY ALL
)
"""


def _delimited() -> str:
    sources = {
        "sku": "l_orderkey || '-' || l_linenumber",
        "offertermcode": "l_returnflag",
        "platform": "'\"' || l_linestatus || '\" box'",
        "tenancy": "'shared'",
        "operation": "'op, ' || l_returnflag",
        "usagetype": "l_linestatus",
        "region": "CAST(l_suppkey AS VARCHAR)",
        "service": "CAST(l_partkey AS VARCHAR)",
        "adjustedpriceperunit": "l_discount",
        "ondemandhourlycost": "l_tax",
        "upfrontfee": "l_orderkey",
        "leaseterm": "CAST(l_linenumber AS BIGINT)",
        "termtype": "CASE WHEN l_returnflag = 'R' THEN 'Reserved' END",
        "key": "strftime(l_shipdate, '%Y-%m-%d')",
        "reservedinstancecost": "l_extendedprice",
        "vcpu": "l_suppkey",
        "memory": "l_quantity",
    }
    types = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT"}
    columns = [
        f'{sources.get(f.name, f"CAST(NULL AS {types[f.dataType.simpleString()]})")} AS "{f.name}"'
        for f in DELIMITED_PRICES.fields
    ]
    return f"SELECT {', '.join(columns)} FROM lineitem"


def _price_list() -> str:
    sources = {
        "sku": "CAST(p_partkey AS VARCHAR)", "ratecode": "p_brand || ', ' || p_type", "pricedescription": "p_name",
        "priceperunit": "p_retailprice", "startingrange": "CAST(p_size AS VARCHAR)", "currency": "'USD'",
    }
    columns = [f'{sources.get(name, "CAST(NULL AS VARCHAR)")} AS "{name}"' for name in PRICE_LIST_COLUMNS]
    return f"SELECT {', '.join(columns)} FROM part"


NOISE_PATTERN = "|".join(marker.replace(".", "\\.") for marker in NOISE)


def all_oracles() -> dict[str, str]:
    return {
        "date_parts": """
            SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
              CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour
            FROM events""",
        "service_of": """
            SELECT page_id, split_part(url, '/', 3) AS host,
              split_part(split_part(url, '/', 3), '.', 1) AS service
            FROM pages""",
        "url_parts": """
            SELECT page_id, split_part(url, '/', 3) AS host,
              '/' || string_split(url, 'example.')[2] AS path,
              CASE WHEN url LIKE 'https://%' THEN substr(url, 9) ELSE url END AS bare
            FROM pages""",
        "padded_keys": """
            SELECT o_orderkey, strftime(o_orderdate, '%m') AS month,
              '(year == ''' || strftime(o_orderdate, '%Y') || ''' and month == '''
                || strftime(o_orderdate, '%m') || ''')' AS slice,
              string_split(o_orderpriority, '-')[-1] AS priority
            FROM orders""",
        "json_field": f"""
            SELECT event_id, json_extract_string(props, '$.k') AS k_text, {K} AS k FROM events""",
        "flatten_cast": """
            SELECT event_id, user_id AS user_identity_user_name,
              date_trunc('second', ts) AS user_identity_session_context_event_time,
              CAST(NULL AS DOUBLE) AS user_identity_session_context_event_source,
              event_type = 'view' AS read_only, CAST(NULL AS VARCHAR) AS management_event, value
            FROM events""",
        "nested_as_text": """
            SELECT event_id,
              '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS who,
              '[' || event_id || ',' || user_id || ']' AS ids, CAST(user_id AS VARCHAR) AS plain
            FROM events""",
        "alert_text": """
            SELECT event_id, 'The Pipeline ' || user_id || ' has failed.' AS message
            FROM events WHERE event_type = 'error'""",
        # Fixed value: the rule of the saved query, as it is written there.
        "not_blank_fragment": """
            WITH wrapped AS (
              SELECT page_id,
                chr(9) || ' ' || split_part(url, '#', 2) || ' ' || chr(13) || chr(10) AS fragment
              FROM pages)
            SELECT * FROM wrapped
            WHERE ltrim(rtrim(replace(replace(replace(fragment, chr(9), ''), chr(10), ''), chr(13), ''))) <> ''
              AND fragment IS NOT NULL""",
        "event_failed": f"""
            SELECT event_id, event_type AS source, json_extract_string(props, '$.k') AS "jobName"
            FROM events
            WHERE event_type IN ('error', 'click') AND {K} IN (1, 2, 3) AND value > 20""",
        "month_of_orders": """
            SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y') AS year,
              strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day
            FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 5""",
        "lookback_events": f"""
            SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) >= DATE '{EVENTS_AS_OF}' - 7""",
        "excluded_paths": """
            SELECT o_orderkey, 'logs/' || o_custkey || '/CloudTrail/' || o_orderkey AS path
            FROM orders WHERE o_orderstatus <> 'F'""",
        "noise_filter": f"""
            WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
            numbered AS (
              SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM split)
            SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM numbered
            WHERE NOT regexp_matches(line, '{NOISE_PATTERN}')""",
        "candidates": f"""
            SELECT DISTINCT user_id AS account, event_type AS region,
              strftime(unnest([DATE '{EVENTS_AS_OF}', DATE '{EVENTS_AS_OF}' - 1]), '%Y-%m-%d') AS day
            FROM events""",
        "path_parse": f"""
            SELECT o_orderkey, {PATH} AS location,
              {HAS_ALL_LEVELS} lpad(CAST(o_custkey AS VARCHAR), 12, '0') END AS accountid,
              {HAS_ALL_LEVELS} 'CloudTrail' END AS type,
              {HAS_ALL_LEVELS} o_orderpriority END AS region,
              {HAS_ALL_LEVELS} strftime(o_orderdate, '%Y') END AS year,
              {HAS_ALL_LEVELS} strftime(o_orderdate, '%m') END AS month,
              {HAS_ALL_LEVELS} strftime(o_orderdate, '%d') END AS day
            FROM orders""",
        "new_partitions": """
            SELECT doc_id AS location FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "union_locations": """
            SELECT doc_id AS location FROM documents UNION SELECT doc_id FROM labels""",
        "reconcile": """
            WITH sizes AS (
              SELECT (SELECT count(DISTINCT doc_id) FROM labels)
                + (SELECT count(DISTINCT doc_id) FROM documents
                   WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS expected,
                (SELECT count(DISTINCT doc_id) FROM documents) AS actual)
            SELECT expected, actual, expected = actual AS ok FROM sizes""",
        "k_of_n_health": """
            WITH latest AS (
              SELECT user_id, event_type, value >= 20 AS ok FROM events
              QUALIFY row_number() OVER (
                PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
            SELECT user_id, count(*) AS children, count(*) FILTER (ok) AS healthy_children,
              count(*) FILTER (ok) >= 2 AS healthy
            FROM latest GROUP BY user_id""",
        "health_tree": """
            WITH status AS (
              SELECT c_nationkey, max(c_acctbal) >= 9900 AS healthy FROM customer GROUP BY ALL)
            SELECT r_name AS parent, count(*) AS children,
              count(*) FILTER (coalesce(healthy, FALSE)) AS healthy_children, 2 AS threshold,
              count(*) FILTER (coalesce(healthy, FALSE)) >= 2 AS healthy
            FROM region JOIN nation ON n_regionkey = r_regionkey
            LEFT JOIN status ON c_nationkey = n_nationkey GROUP BY ALL""",
        "matrix_long": f"""
            SELECT event_id, 'by_type' AS kind, event_type AS service, 'k' AS region,
              {K} >= 50 AS available FROM events
            UNION ALL
            SELECT event_id, 'by_value', 'value', 'above', value > 20 FROM events""",
        "available": f"""
            WITH {WANTED} SELECT o_orderkey, region, service FROM wanted
            JOIN cells USING (region, service) WHERE available""",
        "availability_lookup": f"""
            WITH {WANTED} SELECT o_orderkey, region, service, available FROM wanted
            LEFT JOIN cells USING (region, service)""",
        "preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
        "alarm_5min": _alarms(),
        "alarm_5min_stream": f"""
            SELECT a.*, s.sink FROM ({_alarms(f'NOT {LATE}')}) a, (VALUES ('mail'), ('queue')) s(sink)
            WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""",
        "corrected_alarms": _alarms(),
        "failure_notices_stream": """
            SELECT event_id, 'The Pipeline ' || event_type || ' has failed.' AS message, s.sink
            FROM events, (VALUES ('mail'), ('queue')) s(sink) WHERE event_type IN ('error', 'purchase')""",
        "late_points": f"SELECT * FROM events WHERE {LATE}",
        "failure_runs_batch": _runs(),
        "failure_runs_stream": f"""
            SELECT * FROM ({_runs(f'NOT {LATE}')}) WHERE {CLOSED_DAY}""",
        "k_of_n_stream": f"""
            WITH closed AS (SELECT * FROM events WHERE NOT {LATE} AND {CLOSED_DAY}),
            latest AS (
              SELECT user_id, event_type, value >= 20 AS ok FROM closed
              QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
            ends AS (SELECT user_id, CAST(max(date_trunc('day', ts)) + INTERVAL 1 DAY AS TIMESTAMP) AS ended FROM closed GROUP BY user_id)
            SELECT user_id, any_value(ended) AS "at", count(*) AS children, count(*) FILTER (ok) AS healthy_children,
              count(*) FILTER (ok) >= 2 AS healthy
            FROM latest JOIN ends USING (user_id) GROUP BY user_id""",
        "delimited_scan": _delimited(),
        "price_list_scan": _price_list(),
        "tail_lines": f"""
            WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
            SELECT value, CAST(length(value) AS INTEGER) AS n_chars FROM lines
            WHERE NOT regexp_matches(value, '{NOISE_PATTERN}')""",
        "audit_flat": AUDIT_FLAT,
        "audit_two_days": _lake(_two_days()),
        "endpoint_access": _lake("event_type = 'click'"),
        "job_backfill": _lake(),
        "job_month": _lake(f"year(delivered) = {AUDIT_MONTH[0]} AND month(delivered) = {AUDIT_MONTH[1]}", True),
        "job_incremental": _lake(_two_days()),
        "empty_load": _lake(_two_days()),
        "job_lookback": _lake(f"delivered BETWEEN DATE '{AUDIT_AS_OF}' - 7 AND DATE '{AUDIT_AS_OF}'", True),
        "loaded_table": _lake(f"delivered BETWEEN DATE '{AUDIT_AS_OF}' - 1 AND DATE '{AUDIT_AS_OF}' + 1"),
        "loaded_from_table": _lake(
            f"delivered >= DATE '{AUDIT_AS_OF}' - 20"
            f" OR year(delivered) = {AUDIT_MONTH[0]} AND month(delivered) = {AUDIT_MONTH[1]}", True),
        "quarantined_files": f"""
            WITH {FOLDERS} SELECT accountid, region, year, month, day,
              CASE k WHEN 61 THEN 'no records' ELSE 'not JSON' END AS problem, count(DISTINCT k) AS files
            FROM folders WHERE k IN (61, 62) AND {_two_days()} GROUP BY ALL""",
        "account_layout_leaves": f"""
            WITH {FOLDERS} SELECT DISTINCT * EXCLUDE (event_id, k, delivered) FROM folders""",
        "account_layout_load": _lake(f"year(delivered) = {AUDIT_MONTH[0]} AND month(delivered) = {AUDIT_MONTH[1]}", True),
        "matrix_file": """
            WITH cells AS (
              SELECT c_mktsegment AS service, CAST(c_nationkey AS VARCHAR) AS region,
                max(c_acctbal) >= 9500 AS rich, min(c_acctbal) < 0 AS poor
              FROM customer GROUP BY ALL)
            SELECT 'InterfaceAvailableServicesByRegion' AS kind, service, region, rich AS available FROM cells
            UNION ALL SELECT 'GatewayAvailableServicesByRegion', service, region, poor FROM cells""",
        "shown_tables": "SELECT r_regionkey AS id, r_name AS name, 'regions' AS table_name FROM region",
        "ingest_once": """
            SELECT *, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
              CAST(day(ts) AS INTEGER) AS day
            FROM events""",
        "partition_roundtrip": """
            SELECT *, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
              CAST(day(ts) AS INTEGER) AS day
            FROM events""",
        "partition_slice": """
            SELECT *, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
              CAST(day(ts) AS INTEGER) AS day
            FROM events WHERE month(ts) = 1 AND day(ts) >= 15""",
        "manifest_leaves": f"""
            WITH {FOLDERS} SELECT DISTINCT * EXCLUDE (event_id, k, delivered) FROM folders""",
        "registered_counts": f"""
            WITH {FOLDERS} SELECT accountid, region, year, month, day, count(*) AS records
            FROM folders GROUP BY ALL""",
        "table_month": "SELECT * EXCLUDE (shared_event_id) FROM ("
        + _lake(f"year(delivered) = {AUDIT_MONTH[0]} AND month(delivered) = {AUDIT_MONTH[1]}") + ")",
        "table_lookback": "SELECT * EXCLUDE (shared_event_id) FROM (" + _lake(f"delivered >= DATE '{AUDIT_AS_OF}' - 7") + ")",
        "lake_table": _lake(),
        "register_all": f"""
            WITH {FOLDERS}, sizes AS (
              SELECT count(DISTINCT (accountid, region, year, month, day)) AS n FROM folders)
            SELECT n AS expected, n AS actual, TRUE AS ok FROM sizes""",
        "register_two_days": f"""
            WITH {FOLDERS}, pairs AS (
              SELECT DISTINCT accountid, type, region FROM folders),
            dated AS (
              SELECT *, unnest([DATE '{AUDIT_AS_OF}', DATE '{AUDIT_AS_OF}' - 1]) AS d FROM pairs)
            SELECT accountid, type, region, strftime(d, '%Y') AS year, strftime(d, '%m') AS month,
              strftime(d, '%d') AS day
            FROM dated""",
        "inserted_twice": """
            WITH people AS (
              SELECT c_custkey AS id, c_mktsegment AS first_name, c_name AS last_name FROM customer)
            SELECT * FROM people UNION ALL SELECT * FROM people""",
    }
