"""The stand-in views again, as DuckDB SQL for the oracle side."""

VIEWS = {
    "ev": """SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t_us FROM events""",
    "packets": """SELECT user_id % 10 AS file_id, (user_id // 10) % 3 AS stream_index, event_id,
  CASE WHEN event_id % 11 <> 0 THEN t_us END AS pts_us,
  CASE WHEN event_id % 13 <> 0 THEN t_us - 40000 END AS dts_us,
  CASE WHEN event_id % 17 <> 0 THEN 1000000 * (1 + event_id % 3) END AS duration_us,
  CAST(round(value * 100) AS BIGINT) AS size, event_type = 'signup' AS is_key,
  CASE WHEN event_type = 'signup' THEN 'K__' ELSE '___' END AS flags,
  sha256(event_type || '|' || props) AS hash,
  row_number() OVER (PARTITION BY user_id % 10, (user_id // 10) % 3 ORDER BY event_id) - 1 AS ordinal
FROM ev""",
    "frames": """SELECT o_custkey % 20 AS file_id, CAST(0 AS BIGINT) AS stream_index, ordinal, o_orderkey,
  ordinal * 41708 + CASE WHEN o_orderkey % 101 = 0 THEN 900 ELSE 0 END AS t_us, CAST(41708 AS BIGINT) AS duration_us,
  sha256(o_orderstatus) AS hash, CAST(round(o_totalprice * 100) AS BIGINT) % 10000 AS score_centi
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS ordinal FROM orders)""",
    "rung_samples": """SELECT l_suppkey AS file_id, CAST(18 + 4 * l_linenumber AS BIGINT) AS crf,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes, CAST(l_quantity AS BIGINT) AS seconds,
  CAST(l_quantity AS BIGINT) * 24 AS frames,
  CASE WHEN l_tax < 0.075 THEN CAST(9900 - 100 * l_linenumber - round(l_discount * 100) AS BIGINT) END AS score_centi
FROM lineitem""",
}
