"""Portfolio tables derived from the given tables. One text serves Spark and any other SQL engine; {names} are
tables or other views, {e1}..{e4} the first elements of a vector."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SYMBOL = "CASE event_id % 5 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' WHEN 3 THEN 'AVAX' ELSE 'BUIDL' END"
VIEWS = {
    "ledger": f"""SELECT user_id % 20 AS portfolio_id, event_id, ts, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id END AS sequence,
        CASE event_type WHEN 'view' THEN 'MARKET_TICK' WHEN 'click' THEN 'DERIVATIVES_METRICS' WHEN 'signup' THEN 'YIELD_ACCRUED' ELSE 'ORDER_EXECUTED' END AS event_type,
        {SYMBOL} AS symbol, 100 + value AS price, CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' END AS side,
        CAST(CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 END AS DOUBLE) AS units, CAST(0.001 AS DOUBLE) * value AS fee, value / 100 AS amount,
        value - 50 AS spot_cvd, CAST(5 * (event_id % 21) - 50 AS DOUBLE) AS perp_cvd, 10 * value AS crypto_margined_oi,
        CAST(CASE WHEN event_id % 50 = 0 THEN 0 ELSE 500 END AS DOUBLE) AS cash_margined_oi, (value - 50) / 100000 AS funding_rate FROM {{events}}""",
    "openings": """SELECT c_custkey % 20 AS portfolio_id, CASE c_nationkey % 5 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' WHEN 3 THEN 'AVAX' ELSE 'BUIDL' END AS symbol,
        CAST(count(*) AS DOUBLE) AS units, CAST(90 + floor(avg(c_custkey % 40)) AS DOUBLE) AS price FROM {customer} GROUP BY 1, 2""",
    "starts": "SELECT c_custkey % 20 AS portfolio_id, 500000 + CAST(count(*) AS DOUBLE) AS cash FROM {customer} GROUP BY 1",
    "prices_daily": """SELECT 'A' || CAST(l_suppkey % 12 AS VARCHAR(9)) AS symbol, CAST(l_shipdate AS DATE) AS day, 100 * (1 + avg(l_discount)) AS close
        FROM {lineitem} GROUP BY 1, 2""",
    "strategy_returns": """SELECT strategy_id, strategy_id % 4 AS family_id, CAST(row_number() OVER (PARTITION BY strategy_id ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS idx,
        (o_totalprice / 250000 - CAST(0.98 AS DOUBLE)) / 50 AS ret FROM (SELECT o_custkey % 40 AS strategy_id, o_orderdate, o_orderkey, o_totalprice FROM {orders}) o""",
    "book_levels": """SELECT l_orderkey AS book_id, CASE WHEN l_returnflag = 'A' THEN 'BID' ELSE 'ASK' END AS side,
        CASE WHEN l_returnflag = 'A' THEN 100 - CAST(0.1 AS DOUBLE) * l_quantity ELSE 100 + CAST(0.1 AS DOUBLE) * l_quantity END AS price, CAST(sum(l_linenumber) AS DOUBLE) AS size
        FROM {lineitem} GROUP BY 1, 2, 3""",
    "current_weights": """SELECT portfolio_id, symbol, v / sum(v) OVER (PARTITION BY portfolio_id) AS weight FROM (
        SELECT l_orderkey % 200 AS portfolio_id, 'A' || CAST(l_suppkey % 12 AS VARCHAR(9)) AS symbol, sum(l_extendedprice) AS v FROM {lineitem} WHERE l_linestatus = 'O' AND l_partkey % 3 = 0 GROUP BY 1, 2) x""",
    "target_weights": """SELECT portfolio_id, symbol, v / sum(v) OVER (PARTITION BY portfolio_id) AS weight FROM (
        SELECT l_orderkey % 200 AS portfolio_id, 'A' || CAST(l_suppkey % 12 AS VARCHAR(9)) AS symbol, sum(l_quantity) AS v FROM {lineitem} WHERE l_linestatus = 'F' AND l_partkey % 3 = 1 GROUP BY 1, 2) x""",
    "equities": "SELECT o_orderkey % 200 AS portfolio_id, sum(o_totalprice) AS equity FROM {orders} GROUP BY 1",
    "assets": """SELECT 'A' || CAST(s_suppkey % 12 AS VARCHAR(9)) AS symbol,
        CASE min(s_nationkey) % 4 WHEN 0 THEN 'CORE' WHEN 1 THEN 'SATELLITE' WHEN 2 THEN 'RWA_YIELD' ELSE 'CASH' END AS category,
        20000 + 100 * max(abs(s_acctbal)) AS depth_2pct, avg(s_acctbal) / 5000 AS beta, CASE WHEN min(s_suppkey) % 3 = 0 THEN max(s_acctbal) / 1000000 END AS funding,
        CASE WHEN min(s_nationkey) % 4 = 2 THEN CAST(0.045 AS DOUBLE) END AS apy FROM {supplier} WHERE s_suppkey % 12 <> 11 GROUP BY 1""",
    "onchain_daily": """SELECT o_custkey % 5 AS asset_id, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS market_cap,
        sum(CASE WHEN o_orderstatus = 'F' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END * o_totalprice) AS realized_cap,
        sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END) AS hot_capital FROM {orders} GROUP BY 1, 2""",
    "asset_vectors": """SELECT label AS grp, vec_id AS obs, 0 AS asset, CAST({e1} AS DOUBLE) AS ret FROM {embeddings} UNION ALL SELECT label, vec_id, 1, CAST({e2} AS DOUBLE) FROM {embeddings}
        UNION ALL SELECT label, vec_id, 2, CAST({e3} AS DOUBLE) FROM {embeddings} UNION ALL SELECT label, vec_id, 3, CAST({e4} AS DOUBLE) FROM {embeddings}""",
    "regime_features": """SELECT vec_id AS obs, CAST({e1} AS DOUBLE) AS cvd_delta, CAST({e2} AS DOUBLE) AS depth_ratio, CAST({e3} AS DOUBLE) AS nupl, CAST({e4} AS DOUBLE) AS roc_30d, label % 3 AS label FROM {embeddings}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    for i in range(1, 5):
        text = text.replace(f"{{e{i}}}", f"element_at(embedding, {i})")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """SQL for another engine: the views that the text names, then the text."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    filled = {n: VIEWS[n].format(**{t: t for t in TABLES}, **{f"e{i}": f"embedding[{i}]" for i in range(1, 5)}) for n in names}
    body = sql.strip()
    head = ", ".join(f"{n} AS ({s})" for n, s in filled.items())
    if not head:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head}, {body[len(start) :]}"
    return f"WITH {head} {body}"
