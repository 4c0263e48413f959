"""Capture files made of the orders table: verdict of every file, and the pages of those that are sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import staged
from ..sources import adapters as A
from ..sources import captures as C
from .market import text_of
from .registry import query

c = F.col


def _day(n: int) -> str:
    return f"CAST(CAST(o_orderdate AS DATE) + {n} AS VARCHAR)"


_PAGE = r"""'{"body":"{\"bars\":{},\"next_page_token\":null}","params":{"limit":' || o_custkey || ',"start":"' || start_day || '"},"path":"/v2/stocks/bars","received_at":"'
  || paid_day || CASE WHEN fault = 5 THEN 'T10:09:00Z' ELSE 'T10:02:00Z' END || '","request_id":"' || o_orderpriority || '","schema_version":1}'"""
FILES = f"""orders_at AS (SELECT *, o_orderkey % 11 AS fault, {_day(0)} AS start_day, {_day(40)} AS paid_day,
    CASE WHEN o_orderkey % 11 = 6 THEN {_day(-1)} ELSE {_day(30)} END AS end_day, {_day(5)} AS execution_day FROM orders),
paged AS (SELECT *, {_PAGE} AS page FROM orders_at),
texts AS (SELECT *, '{{"adapter_version":"minutes.v1","captured_at":"' || paid_day || 'T10:05:00Z","origin":"' || CASE WHEN fault = 3 THEN 'prospective' ELSE 'historical' END
    || '","pages":[' || page || CASE WHEN fault = 10 THEN ',' || page ELSE '' END
    || '],"request":{{"adjustment":"raw","aggregation":"regular_session_from_1min","end_session":"' || end_day || '","feed":"' || CASE WHEN fault = 4 THEN 'otc' ELSE 'sip' END
    || '","first_execution_session":"' || execution_day || '","interval":"1d","schema_version":1,"start_session":"' || start_day
    || '","universe":[{{"exchange":"ARCA","listed_on":"1980-01-02","symbol":"' || CASE WHEN fault = 9 THEN 'c' ELSE 'C' END || o_custkey || '"}}],"warmup_sessions":'
    || CASE WHEN fault = 8 THEN '"3"' ELSE '3' END || ',"zero_volume_policy":"reject"}},"requested_at":"' || paid_day || 'T10:00:00Z","schema_version":1}}' AS text FROM paged),
files AS (SELECT *, CASE WHEN fault = 2 THEN ' ' || text WHEN fault = 7 THEN substr(text, 1, 100) ELSE text END AS stored FROM texts)"""


def _judged(spark, sf):
    return staged(C.judged_files(A.capture_contents(spark, sf), "minutes.v1", "1990-01-01"), "capture-files")


@query(f"""WITH {FILES}
SELECT sha256(stored) AS capture_id, CASE WHEN fault = 1 THEN sha256(stored || ' ') ELSE sha256(stored) END AS digest,
  CAST(length(stored) + CASE WHEN fault = 1 THEN 1 ELSE 0 END AS INTEGER) AS bytes,
  CASE fault WHEN 1 THEN 'checksum_mismatch' WHEN 2 THEN 'not_canonical' WHEN 3 THEN 'invalid_value' WHEN 4 THEN 'request_value' WHEN 5 THEN 'page_outside_capture'
    WHEN 6 THEN 'request_dates' WHEN 7 THEN 'invalid_json' WHEN 8 THEN 'request_fields' WHEN 9 THEN 'request_universe' END AS reason
FROM files""")
def capture_file_verdicts(spark, sf):
    return C.judged_files(A.capture_contents(spark, sf), "minutes.v1", "1990-01-01").select("capture_id", "digest", "bytes", "reason")


@query(f"""WITH {FILES}
SELECT DISTINCT sha256(stored) AS capture_id, CAST(n AS BIGINT) AS seq, '/v2/stocks/bars' AS path, start_day || 'T' || o_custkey AS asked,
  {text_of("CAST(paid_day AS TIMESTAMP) + INTERVAL 602 MINUTE")} AS received_at, o_orderpriority AS request_id, '{{"bars":{{}},"next_page_token":null}}' AS body
FROM files, (VALUES (0), (1)) x(n) WHERE fault IN (0, 10) AND n <= fault""")
def capture_file_pages(spark, sf):
    pages = C.accepted_pages(_judged(spark, sf))
    asked = F.concat(c("params")["start"], F.lit("T"), c("params")["limit"])
    return pages.select("capture_id", "seq", "path", asked.alias("asked"), "received_at", "request_id", "body")
