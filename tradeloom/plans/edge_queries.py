"""Registered queries on edges, shares, seeds and mixes, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.operators import edges as E
from tradeloom.operators import exposure as X
from tradeloom.operators import graph as G
from tradeloom.plans.views import view, with_views
from tradeloom.session import durable

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (view reader) under its name, with SQL over the views."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return put


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


_REPLACE = "SELECT *, max(phase) OVER (PARTITION BY supplier, counterparty, year, quarter) AS last FROM v_filings"


@query(f"SELECT supplier AS src, counterparty AS dst, year AS trade_year, round(sum(amount), 2) AS sly_amt, count(*) AS n_filings FROM ({_REPLACE}) x WHERE phase = last GROUP BY supplier, counterparty, year HAVING sum(amount) > 0")
def a1_edges_replace(v):
    return _rounded(E.yearly_edges(v("v_filings"), "REPLACE"), sly_amt=2)


@query("SELECT supplier AS src, counterparty AS dst, year AS trade_year, round(sum(amount), 2) AS sly_amt, count(*) AS n_filings FROM v_filings GROUP BY supplier, counterparty, year HAVING sum(amount) > 0")
def a1_edges_sum_all(v):
    return _rounded(E.yearly_edges(v("v_filings"), "SUM_ALL"), sly_amt=2)


@query("SELECT supplier AS src, counterparty AS dst, year AS trade_year, round(sum(amount), 2) AS sly_amt, count(*) AS n_filings FROM v_filings WHERE phase = '1' GROUP BY supplier, counterparty, year HAVING sum(amount) > 0")
def a1_edges_first_only(v):
    return _rounded(E.yearly_edges(v("v_filings"), "FIRST_ONLY"), sly_amt=2)


@query(f"SELECT * FROM ({_REPLACE}) x WHERE phase = last")
def w1_last_phase_rows(v):
    f = v("v_filings")
    from pyspark.sql import Window

    return f.withColumn("last", F.max("phase").over(Window.partitionBy("supplier", "counterparty", "year", "quarter"))).where("phase = last")


@query("SELECT *, round(sly_amt / sum(sly_amt) OVER (PARTITION BY src, trade_year), 6) AS rate FROM v_company_edge")
def w2_source_rate(v):
    return _rounded(E.source_rate(v("v_company_edge")), rate=6)


@query("""SELECT *, round(sly_amt / sum(sly_amt) OVER (PARTITION BY src, trade_year), 6) AS trade_rate, round(sly_amt / sum(sly_amt) OVER (PARTITION BY src, trade_year), 6) AS sell_rate,
  round(sly_amt / sum(sly_amt) OVER (PARTITION BY dst, trade_year), 6) AS buy_rate, 'PURCHASE' AS buy_rate_basis FROM v_company_edge""")
def w9_edge_shares(v):
    return _rounded(E.edge_shares(v("v_company_edge")), trade_rate=6, sell_rate=6, buy_rate=6)


@query("""SELECT round(min(t), 6) AS least, round(max(t), 6) AS most, round(avg(t), 6) AS mean, round(max(abs(t - 1)), 6) AS off, cast(sum(n) AS bigint) AS purchase, cast(0 AS bigint) AS none FROM
  (SELECT src, trade_year, sum(r) AS t, count(*) AS n FROM (SELECT src, trade_year, sly_amt / sum(sly_amt) OVER (PARTITION BY src, trade_year) AS r FROM v_company_edge) x GROUP BY src, trade_year) y""")
def a7_share_checks(v):
    return _rounded(E.share_checks(E.edge_shares(v("v_company_edge"))), least=6, most=6, mean=6, off=6)


@query("""SELECT b.company, round(b.bought, 2) AS bought FROM (SELECT dst AS company, sum(amount) AS bought FROM v_dag_edge GROUP BY dst) b
  LEFT JOIN (SELECT src AS company, sum(amount) AS sold FROM v_dag_edge GROUP BY src) s ON s.company = b.company WHERE s.sold IS NULL OR s.sold <= 0""")
def j13_buyers_without_sales(v):
    return _rounded(E.buyers_without_sales(v("v_dag_edge").withColumnRenamed("amount", "sly_amt")), bought=2)


@query("""SELECT src, dst, round(amount / sum(amount) OVER (PARTITION BY src), 6) AS rate, by_year FROM (SELECT src, dst, sum(sly_amt) AS amount, string_agg(concat(cast(trade_year AS string), '=', cast(cast(round(1000 * r) AS bigint) AS string)), ';' ORDER BY trade_year) AS by_year
  FROM (SELECT *, round(sly_amt / sum(sly_amt) OVER (PARTITION BY src, trade_year), 6) AS r FROM v_company_edge) x GROUP BY src, dst) y""")
def a3_rate_maps(v):
    entry = lambda e: F.concat(e.key, F.lit("="), F.round(e.value * 1000).cast("bigint").cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("by_year")), entry), ";")
    return _rounded(E.rate_maps(v("v_company_edge")).withColumn("by_year", text), rate=6)


@query("SELECT src, dst, round(amount / sum(amount) OVER (PARTITION BY dst), 6) AS share FROM v_pair")
def a4_in_shares(v):
    return _rounded(E.in_shares(v("v_company_edge")), share=6)


_PARTNER = """SELECT p.{own} AS company, p.{other} AS partner, round(p.amount, 2) AS amount, round(p.amount / t.total, 6) AS share FROM v_pair p JOIN (SELECT {other}, sum(amount) AS total FROM v_pair GROUP BY {other}) t ON t.{other} = p.{other}"""


@query(_PARTNER.format(own="src", other="dst"))
def a5_customer_shares(v):
    return _rounded(E.partner_shares(v("v_company_edge"), v("v_company"), "customer"), amount=2, share=6)


@query(_PARTNER.format(own="dst", other="src"))
def a5_supplier_shares(v):
    return _rounded(E.partner_shares(v("v_company_edge"), v("v_company"), "supplier"), amount=2, share=6)


@query("""SELECT c.company, round(coalesce(s.a, 0), 2) AS sold, round(coalesce(b.a, 0), 2) AS bought FROM v_company c LEFT JOIN (SELECT src, sum(sly_amt) AS a FROM v_company_edge GROUP BY src) s ON s.src = c.company
  LEFT JOIN (SELECT dst, sum(sly_amt) AS a FROM v_company_edge GROUP BY dst) b ON b.dst = c.company""")
def a6_firm_amounts(v):
    return _rounded(E.firm_amounts(v("v_company_edge"), v("v_company")), sold=2, bought=2)


@query("""SELECT coalesce(o.node, i.node) AS node, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, coalesce(max_out, 0) AS max_out, coalesce(max_in, 0) AS max_in FROM
  (SELECT src AS node, count(DISTINCT dst) AS customers, max(sly_amt) AS max_out FROM v_company_edge GROUP BY src) o FULL JOIN (SELECT dst AS node, count(DISTINCT src) AS suppliers, max(sly_amt) AS max_in FROM v_company_edge GROUP BY dst) i ON o.node = i.node""")
def a8_edge_stats(v):
    return E.edge_stats(v("v_company_edge"))


@query("""SELECT f.company, round(coalesce(f.sales_fin, s.a, 0), 2) AS sales, round(coalesce(f.purchases, b.a, 0), 2) AS purchases FROM v_firms f
  LEFT JOIN (SELECT src, sum(sly_amt) AS a FROM v_company_edge GROUP BY src) s ON s.src = f.company LEFT JOIN (SELECT dst, sum(sly_amt) AS a FROM v_company_edge GROUP BY dst) b ON b.dst = f.company""")
def a9_estimates(v):
    return _rounded(E.estimates(v("v_firms").withColumnRenamed("sales_fin", "sales"), v("v_company_edge")), sales=2, purchases=2)


@query("SELECT round(max(t), 6) AS largest FROM (SELECT src, sum(rate) AS t FROM v_block_rate GROUP BY src) x")
def a27_largest_outflow(v):
    return _rounded(E.largest_outflow(v("v_block_rate")), largest=6)


@query("SELECT DISTINCT trade_year FROM v_company_edge")
def a24_available_years(v):
    return v("v_company_edge").select("trade_year").distinct().orderBy(F.desc("trade_year"))


@query("SELECT src, dst, trade_year, sly_amt AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY trade_year DESC) AS n FROM v_company_edge) x WHERE n = 1")
def g34_latest_edges(v):
    return E.latest_edges(v("v_company_edge"))


_NODES = "SELECT company AS node FROM v_company WHERE sector IN ('ASIA', 'EUROPE')"


def _nodes(v):
    return v("v_company").where("sector IN ('ASIA', 'EUROPE')").select(F.col("company").alias("node"))


@query(f"SELECT * FROM v_company_edge WHERE src IN ({_NODES}) AND dst IN ({_NODES})")
def j2_induced_edges(v):
    return E.induced(v("v_company_edge"), _nodes(v))


@query(f"""SELECT e.src, e.dst, e.amount, round(sum(e.amount) OVER (PARTITION BY e.src), 2) AS sub_total, round(f.t, 2) AS full_total FROM v_pair e JOIN (SELECT src, sum(amount) AS t FROM v_pair GROUP BY src) f ON f.src = e.src
  WHERE e.src IN ({_NODES}) AND e.dst IN ({_NODES}) AND e.amount > 0""")
def w3_induced_shares(v):
    return _rounded(E.induced_shares(v("v_pair"), _nodes(v)), sub_total=2, full_total=2)


@query("SELECT DISTINCT node FROM (SELECT dst AS node FROM v_block_edge WHERE src IN (1, 2, 40) UNION ALL SELECT src FROM v_block_edge WHERE dst IN (1, 2, 40)) x")
def j3_step_both_ways(v):
    return G.step(v("v_block_edge"), v("v_company").where("company IN (1, 2, 40)").select(F.col("company").alias("node")))


@query("SELECT DISTINCT company FROM v_product_mix WHERE code LIKE '07%' AND company IN (SELECT company FROM v_company)")
def j1_seed_companies(v):
    return v("v_company").select("company").join(X.companies_of_codes(v("v_product_mix"), ["07"]), "company", "left_semi").distinct()


@query("SELECT DISTINCT company FROM v_product_mix WHERE substr(code, 1, 2) IN ('01', '02', '96')")
def j5_companies_of_chapters(v):
    return X.companies_of_codes(v("v_product_mix"), X.resolve_industry("food, misc", {"food": ["01", "02"], "misc": ["96"]}))


@query("SELECT c.company, c.name, round(coalesce(m.w, 0), 4) AS weight FROM v_company c LEFT JOIN (SELECT company, sum(weight) AS w FROM v_product_mix WHERE code LIKE '11%' GROUP BY company) m ON m.company = c.company")
def j4_companies_with_code_weight(v):
    m = v("v_product_mix").where(F.col("code").startswith("11")).groupBy("company").agg(F.sum("weight").alias("weight"))
    return _rounded(v("v_company").select("company", "name").join(m, "company", "left").na.fill(0.0, ["weight"]), weight=4)


@query("""SELECT company, round(avg(r), 4) AS avg_ratio, round(max(r), 4) AS max_ratio, max(t) AS tier, count(*) AS n_cells, round(0.7 * avg(r) / 100 + 0.3 * max(t) / 7, 4) AS score FROM
  (SELECT company, year, direction, sum(weight) AS r, max(tier) AS t FROM v_product_mix WHERE code LIKE '05%' AND direction = 'EXP' GROUP BY company, year, direction) x GROUP BY company HAVING avg(r) >= 0.5""")
def a2_exposure_screen(v):
    return _rounded(X.screen(v("v_product_mix"), "05", direction="EXP", min_ratio=0.5), avg_ratio=4, max_ratio=4, score=4)


@query("""SELECT company, code, round(sum(CASE WHEN direction = 'EXP' THEN weight ELSE 0 END), 6) AS export_weight, round(sum(CASE WHEN direction = 'IMP' THEN weight ELSE 0 END), 6) AS import_weight,
  string_agg(concat(cast(year AS string), direction), ',' ORDER BY year, direction) AS years FROM v_product_mix GROUP BY company, code""")
def a10_code_weights(v):
    listed = F.array_join(F.transform("years", lambda y: F.concat(y.year.cast("string"), y.direction)), ",")
    return _rounded(X.code_weights(v("v_product_mix")).withColumn("years", listed), export_weight=6, import_weight=6)


@query("SELECT *, round(100 * amount / nullif(sum(amount) OVER (PARTITION BY company, year, direction, hs), 0), 4) AS ratio FROM v_country_mix")
def w8_country_ratios(v):
    return _rounded(X.country_ratios(v("v_country_mix")), ratio=4)


@query("""SELECT company, direction, hs, string_agg(country, ',' ORDER BY ratio DESC, country) AS countries, count(*) AS n_countries FROM
  (SELECT *, round(100 * amount / nullif(sum(amount) OVER (PARTITION BY company, direction, hs), 0), 4) AS ratio FROM (SELECT company, direction, hs, country, sum(amount) AS amount FROM v_country_mix GROUP BY company, direction, hs, country) x) y GROUP BY company, direction, hs""")
def a11_country_lists(v):
    return X.country_lists(v("v_country_mix"))


@query("SELECT * FROM v_product_mix ORDER BY weight DESC NULLS LAST, company, year, direction, code LIMIT 10")
def t1_top_product_mix(v):
    return X.top_mix(v("v_product_mix"))


@query("SELECT * FROM v_block_edge WHERE src IN (3, 7) OR dst IN (3, 7) ORDER BY amount DESC, src, dst LIMIT 5")
def t2_top_edges_of_frontier(v):
    near = v("v_company").where("company IN (3, 7)").select("company")
    e = v("v_block_edge")
    both = e.join(near.withColumnRenamed("company", "src"), "src", "left_semi").unionByName(e.join(near.withColumnRenamed("company", "dst"), "dst", "left_semi").select(*e.columns)).distinct()
    return both.orderBy(F.desc("amount"), "src", "dst").limit(5)


@query("""SELECT e.src, a.name AS seller, e.dst, b.name AS buyer, e.amount FROM v_block_edge e LEFT JOIN v_company a ON a.company = e.src LEFT JOIN v_company b ON b.company = e.dst""")
def t7_edge_grid(v):
    names = v("v_company").select("company", "name")
    e = v("v_block_edge").join(names.select(F.col("company").alias("src"), F.col("name").alias("seller")), "src", "left").join(names.select(F.col("company").alias("dst"), F.col("name").alias("buyer")), "dst", "left")
    return e.select("src", "seller", "dst", "buyer", "amount")


_SORT_KEYS = ("sales_fin", "sales_est", "sales_ml", "purchases")


@query(" UNION ALL ".join(f"SELECT '{k}' AS sort_key, company, n AS place, total FROM (SELECT *, row_number() OVER (ORDER BY {k} DESC NULLS LAST, company) AS n, count(*) OVER () AS total FROM v_firms) x WHERE n BETWEEN 21 AND 40" for k in _SORT_KEYS))
def t8_firm_page(v):
    firms = durable(v("v_firms").select("company", *_SORT_KEYS))  # four orders of one table
    pages = [E.firm_page(firms, k, 2, 20, "company").withColumn("sort_key", F.lit(k)) for k in _SORT_KEYS]
    return reduce(DataFrame.unionByName, pages).select("sort_key", "company", "place", "total")


@query("SELECT 'lineitem' AS name, count(*) AS n FROM v_filings UNION ALL SELECT 'pairs', count(*) FROM v_pair UNION ALL SELECT 'companies', count(*) FROM v_company")
def u5_table_counts(v):
    of = lambda label, name: v(name).agg(F.count("*").alias("n")).select(F.lit(label).alias("name"), "n")
    return of("lineitem", "v_filings").unionByName(of("pairs", "v_pair")).unionByName(of("companies", "v_company"))


@query("SELECT company FROM v_firms WHERE sales_fin IS NULL UNION SELECT company FROM v_firms WHERE sales_est IS NULL")
def u1_union_of_seeds(v):
    f = v("v_firms")
    return f.where("sales_fin IS NULL").select("company").union(f.where("sales_est IS NULL").select("company")).distinct()


@query("SELECT company FROM v_company WHERE company NOT IN (SELECT dst FROM v_dag_edge)")
def u2_not_visited(v):
    return v("v_company").select("company").join(v("v_dag_edge").select(F.col("dst").alias("company")).distinct(), "company", "left_anti")


@query("SELECT DISTINCT substr(a.code, 1, 4) AS family FROM v_product_mix a WHERE a.company = 1 AND substr(a.code, 1, 4) IN (SELECT substr(code, 1, 4) FROM v_product_mix WHERE company = 2)")
def u3_shared_families(v):
    m = v("v_product_mix").select("company", F.substring("code", 1, 4).alias("family"))
    return m.where("company = 1").select("family").intersect(m.where("company = 2").select("family"))


@query("SELECT src AS node FROM v_block_edge UNION SELECT dst FROM v_block_edge")
def u4_node_set(v):
    return G.nodes_of(v("v_block_edge"))


@query("SELECT company, grade_year, grade FROM (SELECT *, row_number() OVER (PARTITION BY company, grade_year ORDER BY bat_seq DESC) AS n FROM v_grade) x WHERE n = 1")
def j8_latest_grades(v):
    return v("v_grade").groupBy("company", "grade_year").agg(F.max_by("grade", "bat_seq").alias("grade"))


@query("""SELECT y AS trade_year, CASE WHEN g IS NULL THEN 'skipped' ELSE 'used' END AS status FROM (SELECT DISTINCT trade_year AS y FROM v_company_edge) e LEFT JOIN (SELECT DISTINCT grade_year AS g FROM v_grade) x ON x.g = e.y""")
def j7_grade_years(v):
    years = v("v_company_edge").select("trade_year").distinct()
    known = v("v_grade").select(F.col("grade_year").alias("trade_year"), F.lit("used").alias("status")).distinct()
    return years.join(known, "trade_year", "left").na.fill("skipped")


@query("""SELECT c.company, c.hq, m.codes FROM v_company c LEFT JOIN (SELECT company, count(DISTINCT code) AS codes FROM v_product_mix GROUP BY company) m ON m.company = c.company""")
def j14_node_meta(v):
    m = v("v_product_mix").groupBy("company").agg(F.countDistinct("code").alias("codes"))
    return v("v_company").select("company", "hq").join(m, "company", "left")


@query("""SELECT s.company, CASE WHEN n.node IS NULL THEN 'not in graph' ELSE 'kept' END AS status FROM (SELECT company FROM v_company WHERE company % 6 = 0 UNION ALL SELECT -1) s LEFT JOIN (SELECT src AS node FROM v_block_edge UNION SELECT dst FROM v_block_edge) n ON n.node = s.company""")
def j15_seed_membership(v):
    seeds = v("v_company").where("company % 6 = 0").select("company").unionByName(v("v_company").agg(F.lit(-1).cast("bigint").alias("company")))
    nodes = G.nodes_of(v("v_block_edge")).withColumnRenamed("node", "company")
    kept = seeds.join(nodes, "company", "left_semi").withColumn("status", F.lit("kept"))
    return kept.unionByName(seeds.join(nodes, "company", "left_anti").withColumn("status", F.lit("not in graph")))


_TARIFF = """SELECT company, 1000.0 AS amount, 0.1 AS shock_rate, code FROM (SELECT DISTINCT company, code FROM v_product_mix WHERE code LIKE '3%' AND direction = 'EXP') x"""


@query(f"""SELECT s.company, round(s.amount * sum(w.rate) * s.shock_rate, 4) AS value, count(w.rate) AS n_found FROM ({_TARIFF}) s
  JOIN (SELECT company, code, max(weight) / 100 AS rate FROM v_product_mix WHERE direction = 'EXP' GROUP BY company, code) w ON w.company = s.company AND w.code = s.code GROUP BY s.company, s.amount, s.shock_rate""")
def j16_tariff_seeds(v):
    mix = v("v_product_mix").where("direction = 'EXP'")
    seeds = mix.where(F.col("code").startswith("3")).groupBy("company").agg(F.collect_list("code").alias("codes")).withColumns({"amount": F.lit(1000.0), "shock_rate": F.lit(0.1)})
    weights = mix.groupBy("company", "code").agg((F.max("weight") / 100).alias("rate"))
    return _rounded(X.tariff_seeds(seeds, weights)[0], value=4)


@query("SELECT h.hq, c.company FROM (SELECT DISTINCT hq FROM v_company UNION ALL SELECT 'NOWHERE') h LEFT JOIN v_company c ON c.hq = h.hq")
def j17_code_to_companies(v):
    keys = v("v_company").select("hq").distinct().unionByName(v("v_company").agg(F.lit("NOWHERE").alias("hq")))
    return keys.join(v("v_company").select("hq", "company"), "hq", "left")


@query("SELECT hq, count(DISTINCT company) AS companies FROM v_company GROUP BY hq HAVING count(DISTINCT company) > 1")
def j18_collisions(v):
    return v("v_company").groupBy("hq").agg(F.countDistinct("company").alias("companies")).where("companies > 1")


@query("SELECT company, code, max(weight) / 100 AS rate FROM v_product_mix WHERE direction = 'EXP' AND year = 1998 AND weight BETWEEN 0 AND 100 GROUP BY company, code")
def src9_trade_weights(v):
    items = v("v_product_mix").where("year = 1998").groupBy("company").agg(F.collect_list(F.struct("code", "direction", (F.col("weight") / 100).cast("string").alias("rate"))).alias("items"))
    return X.trade_weights(items, "EXP")


@query("""SELECT company, sales FROM (SELECT f.company, coalesce(u.sales, f.sales_ml) AS sales FROM v_firms f LEFT JOIN (SELECT company, 2 * sales_ml AS sales FROM v_firms WHERE company % 4 = 0) u ON u.company = f.company) x
  UNION ALL SELECT -5, 1.0""")
def snk1_upsert(v):
    f = v("v_firms").select("company", F.col("sales_ml").alias("sales"))
    new = f.where("company % 4 = 0").withColumn("sales", F.col("sales") * 2)
    return E.upsert(f, new.unionByName(f.agg(F.lit(-5).cast("bigint").alias("company"), F.lit(1.0).alias("sales"))), ["company"])


@query("SELECT f.company, f.name, coalesce(u.s, f.sales_ml) AS sales_ml FROM v_firms f LEFT JOIN (SELECT company, 3 * sales_ml AS s FROM v_firms WHERE company % 7 = 0) u ON u.company = f.company")
def snk2_update_by_join(v):
    f = v("v_firms").select("company", "name", "sales_ml")
    return E.update_columns(f, f.where("company % 7 = 0").select("company", (F.col("sales_ml") * 3).alias("sales_ml")), ["company"], ["sales_ml"])


_NATIONS = range(25)  # the columns of the matrix are the nations' keys


@query(f"SELECT src, {', '.join(f'round(sum(CASE WHEN dst = {i} THEN amount END), 2) AS d{i}' for i in _NATIONS)} FROM v_nation_edge GROUP BY src")
def a31_edge_matrix(v):
    return _rounded(E.matrix(v("v_nation_edge").select("src", "dst", F.col("amount").alias("rate")), list(_NATIONS)), **{f"d{i}": 2 for i in _NATIONS})
