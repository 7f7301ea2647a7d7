"""Views over the shared tables, each one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tradeloom.session import read

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "conversations")

VIEWS = {
    "v_filings": """SELECT l.l_suppkey AS supplier, o.o_custkey % s.n AS counterparty, year(l.l_shipdate) AS year, quarter(l.l_shipdate) AS quarter,
      CASE WHEN l.l_returnflag = 'R' THEN '2' ELSE '1' END AS phase, l.l_extendedprice AS amount, l.l_orderkey AS order_key
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey CROSS JOIN (SELECT count(*) AS n FROM supplier) s""",
    "v_company_edge": """SELECT supplier AS src, counterparty AS dst, year AS trade_year, round(sum(amount), 2) AS sly_amt, count(*) AS n_filings
      FROM v_filings GROUP BY supplier, counterparty, year""",
    "v_pair": "SELECT src, dst, round(sum(sly_amt), 2) AS amount FROM v_company_edge GROUP BY src, dst",
    "v_block_edge": """SELECT src, dst, amount FROM v_pair
      WHERE floor(src / 4) = floor(dst / 4) OR (src < dst AND src % 4 = 3 AND dst - src <= 12)""",
    "v_dag_edge": "SELECT src, dst, amount FROM v_pair WHERE src < dst",
    "v_block_rate": """SELECT src, dst, round(0.8 * amount / sum(amount) OVER (PARTITION BY src), 9) AS rate FROM v_block_edge WHERE src <> dst""",
    "v_pair_rate": "SELECT src, dst, round(0.8 * amount / sum(amount) OVER (PARTITION BY src), 9) AS rate FROM v_pair",
    "v_buy_rate": "SELECT dst AS src, src AS dst, round(0.8 * amount / sum(amount) OVER (PARTITION BY dst), 9) AS rate FROM v_pair",
    "v_order_edge": "SELECT o_orderkey AS src, -1 - o_custkey AS dst FROM orders",
    "v_dag_rate": "SELECT src, dst, round(0.9 * amount / sum(amount) OVER (PARTITION BY src), 9) AS rate FROM v_dag_edge",
    "v_nation_edge": """SELECT s.s_nationkey AS src, c.c_nationkey AS dst, year(l.l_shipdate) AS trade_year, round(sum(l.l_extendedprice), 2) AS amount
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN customer c ON c.c_custkey = o.o_custkey
      GROUP BY s.s_nationkey, c.c_nationkey, year(l.l_shipdate)""",
    "v_company": """SELECT s.s_suppkey AS company, s.s_name AS name, n.n_name AS hq, r.r_name AS sector, s.s_acctbal AS balance
      FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "v_grade": """SELECT s_suppkey AS company, y.year AS grade_year, b.seq AS bat_seq,
      CASE WHEN s_acctbal < 0 THEN 'B-' WHEN s_acctbal < 2000 THEN 'BB+' WHEN s_acctbal < 4000 THEN 'BBB0' WHEN s_acctbal < 6000 THEN 'A+' WHEN s_acctbal < 8000 THEN 'AA' WHEN s_acctbal < 9000 THEN 'AAA' ELSE 'NR' END AS grade
      FROM supplier CROSS JOIN (SELECT 1997 AS year UNION ALL SELECT 1998 UNION ALL SELECT 2010) y CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2) b
      WHERE b.seq = 1 OR s_suppkey % 3 = 0""",
    "v_product_mix": """SELECT company, year, direction, code, round(100 * amount / sum(amount) OVER (PARTITION BY company, year, direction), 6) AS weight,
      CASE WHEN amount < 20000 THEN 1 WHEN amount < 40000 THEN 2 WHEN amount < 60000 THEN 3 WHEN amount < 80000 THEN 4 WHEN amount < 100000 THEN 5 WHEN amount < 120000 THEN 6 ELSE 7 END AS tier
      FROM (SELECT l_suppkey AS company, year(l_shipdate) AS year, CASE WHEN l_linestatus = 'O' THEN 'EXP' ELSE 'IMP' END AS direction,
      concat(lpad(cast(p_partkey % 97 AS string), 2, '0'), lpad(cast(p_partkey % 13 AS string), 2, '0'), lpad(cast(p_partkey AS string), 6, '0')) AS code, round(sum(l_extendedprice), 2) AS amount
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, year(l_shipdate), l_linestatus, p_partkey) x""",
    "v_country_mix": """SELECT company, year, direction, code AS hs, country, round(sum(amount), 2) AS amount FROM
      (SELECT l_suppkey AS company, year(l_shipdate) AS year, CASE WHEN l_linestatus = 'O' THEN 'EXP' ELSE 'IMP' END AS direction, lpad(cast(l_partkey % 97 AS string), 2, '0') AS code, n_name AS country, l_extendedprice AS amount
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) x GROUP BY company, year, direction, code, country""",
    "v_firms": """SELECT c.company, c.name, c.sector, c.hq, CASE WHEN c.company % 3 = 0 THEN NULL ELSE e.sold END AS sales_fin,
      CASE WHEN c.company % 5 = 0 THEN NULL ELSE round(e.sold * 0.9, 2) END AS sales_est, round(e.sold * 0.8, 2) AS sales_ml, b.bought AS purchases
      FROM v_company c LEFT JOIN (SELECT src, round(sum(amount), 2) AS sold FROM v_pair GROUP BY src) e ON e.src = c.company
      LEFT JOIN (SELECT dst, round(sum(amount), 2) AS bought FROM v_pair GROUP BY dst) b ON b.dst = c.company""",
    "v_catalog": """SELECT lpad(cast(p_partkey AS string), 10, '0') AS code, p_name AS name, p_type AS category, p_brand AS heading, concat(p_name, ' ', p_type, ' size ', cast(p_size AS string)) AS detail,
      CASE WHEN p_partkey % 7 = 0 THEN DATE '2019-12-31' ELSE DATE '2999-12-31' END AS valid_to FROM part""",
    "v_query": "SELECT cast(p_partkey AS string) AS query_id, concat(p_name, ' ', p_type) AS query, lpad(cast(p_partkey AS string), 10, '0') AS target, CASE WHEN p_size > 25 THEN 'T1' ELSE 'T2' END AS template FROM part WHERE p_partkey % 50 = 0",
    # the small sums keep amounts off the halves, which the two engines round differently
    "v_impact": """SELECT e.dst AS firm, 'run1' AS run_id, e.trade_year AS scenario_seq, round(sum(e.sly_amt) * 0.01 + 0.00003, 2) AS rev_demand, round(sum(e.sly_amt) * 0.002 + 0.000003, 2) AS rev_supply,
      round(sum(e.sly_amt) * 0.005 + 0.000003, 2) AS cost_total, round(sum(e.sly_amt) * 0.003 + 0.000003, 2) AS cost_direct, CASE WHEN e.dst % 9 = 0 THEN true ELSE false END AS capped
      FROM v_company_edge e GROUP BY e.dst, e.trade_year""",
}


def used(sql: str) -> list[str]:
    """The views that ``sql`` needs, in the order in which they can be defined."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                out.append(name)

    visit(sql)
    return out


def with_views(sql: str) -> str:
    """``sql`` with the views that it needs as common table expressions."""
    needed = used(sql)
    if not needed:
        return sql
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {text[len('WITH RECURSIVE') :]}"
    if text.upper().startswith("WITH"):
        return f"WITH {heads}, {text[4:]}"
    return f"WITH {heads} {text}"


def tables(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            read(spark, sf_dir, name).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    sql = with_views(f"SELECT * FROM {name}")
    tables(spark, sf_dir, sql)
    return spark.sql(sql)
