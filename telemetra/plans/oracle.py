"""DuckDB SQL computing each registered query's answer straight from the test tables.

The oracles never parse the payload JSON: they derive the expected points from the table
columns the fixture adapters encode, so a parser or flattening mistake shows up as a
mismatch. Doubles that come out of arithmetic are rounded to 6 places on both sides.
"""

from __future__ import annotations

# Events as fixture A/B/C encode them: epoch seconds, host tag, k from props.
_E = """e AS (
  SELECT event_id, event_id % 10 AS f, epoch_us(ts) // 1000000 AS s, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         'user-' || CAST(user_id AS VARCHAR) AS h,
         CASE user_id % 3 WHEN 0 THEN 'eu' WHEN 1 THEN 'us' ELSE 'ap' END AS r
  FROM events)"""

_TAGS = """'{"host":"' || h || '","region":"' || r || '"}'"""
_EU = """tags_json LIKE '%"region":"eu"%'"""

# Fixture A points: ".value" and ".k" per event.
_POINTS_A = f"""{_E},
pa AS (
  SELECT event_id AS seq, 0 AS pos, s AS ts, event_type || '.value' AS metric_name, value,
         h AS host, {_TAGS} AS tags_json FROM e
  UNION ALL
  SELECT event_id, 0, s, event_type || '.k', CAST(k AS DOUBLE), h, {_TAGS} FROM e)"""

_POINTS_B = f"""{_E},
pb AS (
  SELECT event_id AS seq, 0 AS pos, s AS ts, event_type AS metric_name, value,
         h AS host, {_TAGS} AS tags_json FROM e)"""

# Fixture E (strict): faults 2, 3, 5, 6 change defaults; 8, 9 clean; bare arrays (1) only
# when accepted; 0, 4, 7 give nothing.
def _dirty(kept: str) -> str:
    return f"""{_E},
m AS (
  SELECT event_id AS seq, 0 AS pos,
         CASE WHEN f = 6 THEN 0 ELSE s END AS ts,
         CASE WHEN f = 2 THEN 'unknown' ELSE event_type END AS name,
         CASE WHEN f = 3 THEN 'unknown' ELSE h END AS host,
         CASE WHEN f = 3 THEN '{{}}' ELSE {_TAGS} END AS tags_json,
         value, CASE WHEN f = 5 THEN NULL ELSE k END AS k
  FROM e WHERE f IN ({kept}))
SELECT seq, pos, ts, name || '.value' AS metric_name, value, host, tags_json FROM m
UNION ALL
SELECT seq, pos, ts, name || '.k', CAST(k AS DOUBLE), host, tags_json FROM m WHERE k IS NOT NULL"""


# Fixture C series keys (prefix "metrics", labels host and region sorted).
_C = f"""{_E},
c AS (
  SELECT event_id AS seq, s AS ts, event_type AS metric, value,
         'metrics:' || event_type || ':host=' || h || ':region=' || r AS series_key,
         {_TAGS} AS labels_json
  FROM e)"""


def _dedup(agg: str) -> str:
    return f"""WITH {_C}
SELECT series_key, (ts // 86400) * 86400 AS ts, round({agg}, 6) AS value, count(*) AS duplicates
FROM c GROUP BY series_key, (ts // 86400) * 86400"""


ORACLE: dict[str, str] = {
    "flatten_fields": f"WITH {_POINTS_A} SELECT * FROM pa",
    "flatten_value": f"WITH {_POINTS_B} SELECT * FROM pb",
    "unpivot_wide": """
WITH l AS (
  SELECT l_orderkey * 8 + l_linenumber AS seq, 0 AS pos, epoch_us(l_shipdate) // 1000000 AS ts,
         l_quantity, l_extendedprice, l_discount, l_tax, 'supp-' || CAST(l_suppkey AS VARCHAR) AS host,
         '{"flag":"' || l_returnflag || '","host":"supp-' || CAST(l_suppkey AS VARCHAR) || '"}' AS tags_json
  FROM lineitem)
SELECT seq, pos, ts, 'lineitem.quantity' AS metric_name, l_quantity AS value, host, tags_json FROM l
UNION ALL SELECT seq, pos, ts, 'lineitem.extendedprice', l_extendedprice, host, tags_json FROM l
UNION ALL SELECT seq, pos, ts, 'lineitem.discount', l_discount, host, tags_json FROM l
UNION ALL SELECT seq, pos, ts, 'lineitem.tax', l_tax, host, tags_json FROM l""",
    "envelope_defaults": "WITH " + _dirty("2, 3, 5, 6, 8, 9"),
    "bare_payloads": "WITH " + _dirty("1, 2, 3, 5, 6, 8, 9"),
    "quarantine": f"""WITH {_E}
SELECT event_id AS seq,
       CASE f WHEN 0 THEN 'malformed' WHEN 1 THEN 'no_envelope' ELSE 'bad_type' END AS reason
FROM e WHERE f IN (0, 1, 4, 7)""",
    "quarantine_metric_scope": f"""WITH {_E}
SELECT event_id AS seq, CASE WHEN f IN (4, 7) THEN 1 ELSE -1 END AS pos,
       CASE f WHEN 0 THEN 'malformed' WHEN 1 THEN 'no_envelope' ELSE 'bad_type' END AS reason
FROM e WHERE f IN (0, 1, 4, 7)""",
    "metric_scope_points": f"""WITH {_E},
m AS (
  SELECT event_id AS seq, 0 AS pos,
         CASE WHEN f = 6 THEN 0 ELSE s END AS ts,
         CASE WHEN f = 2 THEN 'unknown' ELSE event_type END AS name,
         CASE WHEN f = 3 THEN 'unknown' ELSE h END AS host,
         CASE WHEN f = 3 THEN '{{}}' ELSE {_TAGS} END AS tags_json,
         value, CASE WHEN f = 5 THEN NULL ELSE k END AS k
  FROM e WHERE f IN (2, 3, 4, 5, 6, 7, 8, 9))
SELECT seq, pos, ts, name || '.value' AS metric_name, value, host, tags_json FROM m
UNION ALL
SELECT seq, pos, ts, name || '.k', CAST(k AS DOUBLE), host, tags_json FROM m WHERE k IS NOT NULL""",
    "tags_json_sorted": f"WITH {_E} SELECT event_id AS seq, 0 AS pos, h AS host, {_TAGS} AS tags_json FROM e",
    "date_partition": f"""WITH {_E}
SELECT event_id AS seq, event_type || '.value' AS metric_name, strftime(make_timestamp(s * 1000000), '%Y/%m/%d') AS date_path FROM e
UNION ALL
SELECT event_id, event_type || '.k', strftime(make_timestamp(s * 1000000), '%Y/%m/%d') FROM e""",
    "filter_metric_time": f"""WITH {_POINTS_A}
SELECT * FROM pa WHERE metric_name = 'click.value'
  AND ts BETWEEN epoch(TIMESTAMP '2024-01-05 00:00:00') AND epoch(TIMESTAMP '2024-01-20 00:00:00')""",
    "filter_tag": f"WITH {_POINTS_A} SELECT * FROM pa WHERE host = 'user-7'",
    "filter_tag_other": f"WITH {_POINTS_A} SELECT * FROM pa WHERE metric_name = 'view.k' AND {_EU}",
    "filter_metric_list": f"WITH {_POINTS_A} SELECT * FROM pa WHERE metric_name IN ('click.value', 'view.k', 'signup.value')",
    "filter_name_wide": f"""WITH {_E}
SELECT event_id AS seq, s AS ts, event_type AS name, h AS host, 2 AS n_fields, value, CAST(k AS DOUBLE) AS k
FROM e WHERE event_type = 'purchase'""",
    "field_stats": f"""WITH {_POINTS_A}
SELECT metric_name, count(value) AS count, min(value) AS min, max(value) AS max,
       round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev
FROM pa GROUP BY metric_name""",
    "field_stats_one": f"""WITH {_POINTS_A}
SELECT metric_name, count(value) AS count, min(value) AS min, max(value) AS max,
       round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev
FROM pa WHERE metric_name = 'error.value' GROUP BY metric_name""",
    "latest_per_series": f"""WITH {_E}
SELECT event_type AS name, {_TAGS} AS tags_json, 'value' AS main_field, round(value, 2) AS value, s AS ts, event_id AS seq
FROM e
QUALIFY row_number() OVER (PARTITION BY event_type, h ORDER BY s DESC, event_id DESC) = 1""",
    "last_50_per_host": f"""WITH {_E}
SELECT h AS host, s AS ts, event_id AS seq, value AS y,
       CAST(row_number() OVER (PARTITION BY h ORDER BY s DESC, event_id DESC) AS INTEGER) AS rank
FROM e
QUALIFY rank <= 50""",
    "recent_n": f"""WITH {_E}
SELECT event_id AS seq, s AS ts, event_type AS metric_name, value FROM e
ORDER BY s DESC, event_id DESC LIMIT 100""",
    "recent_n_metric": f"""WITH {_E}
SELECT event_id AS seq, s AS ts, event_type AS metric_name, value FROM e WHERE event_type = 'purchase'
ORDER BY s DESC, event_id DESC LIMIT 20""",
    "distinct_hosts": f"WITH {_E} SELECT DISTINCT h AS host FROM e",
    "series_keys": f"WITH {_C} SELECT seq, series_key, ts, value FROM c",
    "series_catalog": f"""WITH {_C}
SELECT series_key, arg_min(metric, seq) AS metric, arg_min(labels_json, seq) AS labels_json,
       min(seq) AS first_seq, arg_min(ts, seq) AS first_ts, count(*) AS points,
       CAST(86400 AS BIGINT) AS retention, 'LAST' AS duplicate_policy, true AS compressed
FROM c GROUP BY series_key""",
    "timestamp_batches": f"""WITH {_C}
SELECT (ts // 3600) * 3600 AS ts, seq, series_key,
       series_key || ' ' || CAST((ts // 3600) * 3600 AS VARCHAR) || ' ' || printf('%.6f', value) AS arg
FROM c""",
    "timestamp_batch_sizes": f"WITH {_C} SELECT (ts // 3600) * 3600 AS ts, count(*) AS points FROM c GROUP BY 1",
    "labelled_array": f"WITH {_C} SELECT series_key, ts, value FROM c",
    "series_from_points": f"""WITH {_C}
SELECT series_key, arg_min(metric, seq) AS metric, arg_min(labels_json, seq) AS labels_json,
       min(seq) AS first_seq, arg_min(ts, seq) AS first_ts, count(*) AS points
FROM c GROUP BY series_key""",
    "recent_n_fields": f"""WITH {_E}
SELECT event_id AS seq, s AS ts, event_type AS name, value FROM e WHERE event_type = 'signup'
ORDER BY s DESC, event_id DESC LIMIT 50""",
    "quarantine_times": f"WITH {_E} SELECT event_id AS seq, 'bad_time' AS reason FROM e WHERE event_id % 6 <> 0",
    "dedup_last": _dedup("arg_max(value, seq)"),
    "dedup_first": _dedup("arg_min(value, seq)"),
    "dedup_min": _dedup("min(value)"),
    "dedup_max": _dedup("max(value)"),
    "dedup_sum": _dedup("sum(value)"),
    "series_retention": f"""WITH {_C}
SELECT seq, series_key, ts FROM c
QUALIFY ts >= max(ts) OVER (PARTITION BY series_key) - 604800""",
    "ingest_counters": f"""WITH {_E}
SELECT count(*) AS total_requests,
       CAST(sum(CASE WHEN f IN (0, 1) THEN 0 WHEN f IN (4, 7) THEN 2 ELSE 1 END) AS BIGINT) AS total_metrics
FROM e""",
}

_STORE_A = f"WITH {_POINTS_A} SELECT ts, metric_name, value, host, tags_json FROM pa"

ORACLE.update({
    "parquet_roundtrip": _STORE_A,
    "parquet_partitioned": _STORE_A,
    "csv_roundtrip": f"WITH {_POINTS_A} SELECT ts, metric_name, value, host FROM pa",
    "csv_tags_roundtrip": _STORE_A,
    "jsonl_gz_roundtrip": _STORE_A,
    "fanout_stores": f"""WITH {_POINTS_A}, s(store) AS (VALUES ('parquet'), ('csv_tags'), ('jsonl'))
SELECT s.store, ts, metric_name, value, host, tags_json FROM pa, s""",
    "rows_per_file": f"""WITH {_POINTS_A}
SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS date, count(*) AS rows
FROM pa GROUP BY 1""",
    "list_files_range": f"""WITH {_POINTS_A}
SELECT DISTINCT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS date
FROM pa WHERE make_timestamp(ts * 1000000) >= TIMESTAMP '2024-01-10' AND make_timestamp(ts * 1000000) < TIMESTAMP '2024-01-21'""",
    "stream_ingest": _STORE_A,
    "stream_first_seen": f"""WITH {_C}
SELECT series_key, arg_min(metric, seq) AS metric, arg_min(labels_json, seq) AS labels_json,
       min(seq) AS first_seq, arg_min(ts, seq) AS first_ts
FROM c GROUP BY series_key""",
    "stream_filtered": f"WITH {_POINTS_A} SELECT * FROM pa WHERE metric_name IN ('click.value', 'view.k') AND {_EU}",
    "stream_latest": ORACLE["latest_per_series"],
    "stream_last_50": ORACLE["last_50_per_host"],
    "stream_counters": ORACLE["ingest_counters"],
})

ORACLE.update({
    "payload_files": _STORE_A,
    "labelled_jsonl": f"WITH {_C} SELECT series_key, ts, value FROM c",
    "stream_text_ingest": _STORE_A,
    "query_per_file": f"""WITH {_POINTS_A}
SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS date,
       count(*) FILTER (WHERE metric_name = 'click.value'
                        AND ts BETWEEN epoch(TIMESTAMP '2024-01-05') AND epoch(TIMESTAMP '2024-01-20')) AS rows
FROM pa GROUP BY 1""",
})

ORACLE["filter_metric_list_early"] = ORACLE["filter_metric_list"]

ORACLE["query_points"] = f"""WITH {_POINTS_A}
SELECT ts, metric_name, value, host, tags_json FROM pa
WHERE metric_name = 'view.value' AND {_EU}
  AND ts BETWEEN epoch(TIMESTAMP '2024-01-03 12:00:00') AND epoch(TIMESTAMP '2024-01-09 12:00:00')"""

ORACLE["bulk_ingest"] = """
WITH l AS (
  SELECT epoch_us(l_shipdate) // 1000000 AS ts, l_quantity, l_extendedprice, l_discount, l_tax,
         'supp-' || CAST(l_suppkey AS VARCHAR) AS host,
         '{"flag":"' || l_returnflag || '","host":"supp-' || CAST(l_suppkey AS VARCHAR) || '"}' AS tags_json
  FROM lineitem)
SELECT ts, 'lineitem.quantity' AS metric_name, l_quantity AS value, host, tags_json FROM l
UNION ALL SELECT ts, 'lineitem.extendedprice', l_extendedprice, host, tags_json FROM l
UNION ALL SELECT ts, 'lineitem.discount', l_discount, host, tags_json FROM l
UNION ALL SELECT ts, 'lineitem.tax', l_tax, host, tags_json FROM l"""


def _chart(names: str, field: str) -> str:
    return f"""WITH {_E},
g AS (SELECT *, CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'memory' ELSE 'system' END AS name FROM e)
SELECT h AS host, s AS ts, event_id AS seq, CAST({field} AS DOUBLE) AS y,
       CAST(row_number() OVER (PARTITION BY h ORDER BY s DESC, event_id DESC) AS INTEGER) AS rank
FROM g WHERE name IN ({names}) AND {field} IS NOT NULL
QUALIFY rank <= 50"""


def _bulk(agg: str) -> str:
    return f"""WITH {_E}
SELECT 'metrics:' || event_type || ':region=' || r AS series_key, (s // 86400) * 86400 AS ts,
       round({agg}(value, event_id), 6) AS value, count(*) AS duplicates
FROM e GROUP BY 1, 2"""


ORACLE.update({
    "chart_cpu": _chart("'cpu', 'system'", "value"),
    "chart_memory": _chart("'memory', 'system'", "k"),
    "dedup_last_bulk": _bulk("arg_max"),
    "dedup_first_bulk": _bulk("arg_min"),
    "parquet_by_host": _STORE_A,
    "csv_partitioned": _STORE_A,
    "jsonl_partitioned": _STORE_A,
    "csv_rotation": "SELECT 4 * count(*) AS rows, CAST(0 AS BIGINT) AS over_limit FROM lineitem",
    "query_late_arrivals": f"""{_STORE_A} WHERE metric_name = 'view.value'
  AND ts BETWEEN epoch(TIMESTAMP '2024-01-05 00:00:00') AND epoch(TIMESTAMP '2024-01-06 00:00:00')""",
    "append_after_stream": _STORE_A,
    # the batch that closes: the second, third and fourth of the query
    "stream_flush": f"""WITH {_POINTS_A}
SELECT CASE seq % 4 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS batch, count(*) AS points FROM pa GROUP BY 1""",
    "stream_filtered_wide": f"""WITH {_E}
SELECT event_id AS seq, s AS ts, event_type AS name, h AS host, {_TAGS} AS tags_json, value, CAST(k AS DOUBLE) AS k
FROM e WHERE event_type IN ('purchase', 'view') AND h = 'user-7'""",
    "stream_rejects": f"""WITH {_E}
SELECT CASE WHEN event_id % 6 = 0 THEN 'ok' ELSE 'bad_time' END AS reason, count(*) AS rows FROM e GROUP BY 1""",
    "store_stats": f"""WITH d AS ({ORACLE["envelope_defaults"]}), q AS ({ORACLE["quarantine"]})
SELECT (SELECT count(*) FROM d) AS total_records, (SELECT count(*) FROM q) AS write_errors, true AS has_files, true AS has_rate""",
    "store_report": "SELECT true AS files_agree, true AS bytes_agree, true AS newest_in_range",
    "expired_files": f"""WITH {_POINTS_A}
SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS date, count(*) AS rows, CAST(0 AS BIGINT) AS deleted FROM pa GROUP BY 1""",
})

# Fixture C as lines: numbers as Spark's JSON writer prints them.
ORACLE.update({
    "published_batches": _STORE_A,
    "recent_store": f"""WITH {_POINTS_A}
SELECT ts, metric_name, value, host FROM pa WHERE metric_name = 'purchase.value' ORDER BY ts DESC LIMIT 40""",
    "recent_store_late": f"""WITH {_POINTS_A}
SELECT ts, metric_name, value, host FROM pa ORDER BY ts DESC LIMIT 40""",
    "recent_store_metrics": f"""WITH {_E}
SELECT s AS ts, event_type AS name, h AS host, {_TAGS} AS tags_json, value, CAST(k AS DOUBLE) AS k
FROM e, range(2) WHERE event_type = 'signup' ORDER BY s DESC, event_id DESC LIMIT 60""",
    "stream_line_numbers": f"""WITH {_E}
SELECT event_id % 4 AS file, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS line,
  '{{"timestamp":' || s || ',"metric":"' || event_type || '","value":' || value || ',"labels":{{"host":"' || h || '","region":"' || r || '"}}}}' AS raw
FROM e""",
})


def _rotation(line: str, header: int, limit: int, age: str) -> str:
    """Files per date and window: the bytes of the lines over what a file may hold beside its
    header and the end of a line."""
    return f"""WITH {_POINTS_A},
l AS (SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS date, {age} AS age, strlen({line}) + 1 AS b FROM pa),
g AS (SELECT date, age, sum(b) AS b, CAST(ceil(sum(b) / ({limit} - {header} - (SELECT max(b) FROM l) + 1)) AS BIGINT) AS files FROM l GROUP BY date, age),
n AS (SELECT date, count(*) AS rows FROM l GROUP BY date)
SELECT date, age, files, CAST(b + files * {header} AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS over_limit, rows FROM g JOIN n USING (date)"""


ORACLE.update({
    "rotation_by_size": _rotation("ts || ',' || metric_name || ',' || value || ',' || host", 28, 16_000, "CAST(0 AS BIGINT)"),
    "rotation_by_age": _rotation("""'{"timestamp":' || ts || ',"metric":"' || metric_name || '","value":' || value || ',"host":"' || host || '","tags":' || tags_json || '}'""",
                                 0, 30_000, "ts // 21600"),
})

for _policy in ("last", "first", "min", "max", "sum"):
    ORACLE[f"stored_{_policy}"] = ORACLE[f"dedup_{_policy}"]
ORACLE["stored_retention"] = f"""WITH {_C},
one AS (SELECT series_key, ts, arg_max(value, seq) AS value FROM c GROUP BY series_key, ts)
SELECT series_key, ts, round(value, 6) AS value FROM one
QUALIFY ts >= max(ts) OVER (PARTITION BY series_key) - 604800"""
ORACLE["stream_seen_reset"] = f"""WITH {_C},
f AS (SELECT series_key, any_value(metric) AS metric, any_value(labels_json) AS labels_json, min(seq) AS seq FROM c GROUP BY series_key, seq % 2)
SELECT series_key, any_value(metric) AS metric, any_value(labels_json) AS labels_json, count(*) AS reports, min(seq) AS first_seq, max(seq) AS last_first_seq
FROM f GROUP BY series_key"""

ORACLE["prefix_scope_points"] = f"""WITH {_E}
SELECT event_id AS seq, CAST(i - 1 AS INTEGER) AS pos, s AS ts, 'm' || i AS metric_name, value
FROM e, range(1, 4) t(i) WHERE event_id % 4 = 0 OR i < event_id % 4"""
ORACLE["prefix_scope_rejects"] = f"""WITH {_E}
SELECT 'E' AS fixture, event_id AS seq, CASE WHEN f IN (4, 7) THEN 1 ELSE -1 END AS pos,
       CASE f WHEN 0 THEN 'malformed' WHEN 1 THEN 'no_envelope' ELSE 'bad_type' END AS reason
FROM e WHERE f IN (0, 1, 4, 7)
UNION ALL SELECT 'H', event_id, CAST(i - 1 AS INTEGER), CASE WHEN i = event_id % 4 THEN 'bad_type' ELSE 'after_bad' END
FROM e, range(1, 4) t(i) WHERE event_id % 4 > 0 AND i >= event_id % 4"""
ORACLE["tags_number_text"] = f"""WITH {_E},
d AS (SELECT event_id, k, k + 1 AS v, rtrim(CAST(k + 1 AS VARCHAR), '0') AS g, length(CAST(k + 1 AS VARCHAR)) - 1 AS p FROM e),
t AS (SELECT *, CASE WHEN length(g) > 1 THEN left(g, 1) || '.' || substr(g, 2) ELSE g END AS m FROM d)
SELECT event_id AS seq, '{{"int":"' || k || '","large":"' || m || 'e+' || (20 + p) || '","nested":"{{\\"a\\":true,\\"b\\":[' || k || ',\\"x\\"]}}","none":"null","part":"'
  || CAST(CAST('0.' || k || '0' AS DOUBLE) AS VARCHAR) || '","small":"' || CASE WHEN p > 2 THEN '0.000' || g ELSE m || 'e-0' || (7 - p) END
  || '","text":"1.0","whole":"' || k || '.0","wide":"'
  || CASE WHEN v < 10 OR v < 19 THEN v || '000000000000000000' ELSE m || 'e+' || (18 + p) END || '"}}' AS tags_json
FROM t"""
