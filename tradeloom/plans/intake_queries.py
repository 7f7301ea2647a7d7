"""Registered queries on what enters a run, on labels and texts, top lists and autocomplete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions import labels as L
from tradeloom.operators import edges as E
from tradeloom.operators import impacts as I
from tradeloom.operators import intake as N
from tradeloom.operators import search as S
from tradeloom.plans import graph_queries
from tradeloom.plans.search_queries import _GRAMS, _cut
from tradeloom.plans.views import view, with_views
from tradeloom.session import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name) if name.startswith("v_") else read(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return put


def _nodes(v) -> DataFrame:
    return v("v_company").select(F.col("company").alias("node"), "name", "sector")


@query("""SELECT n.node, c.name, c.sector FROM (SELECT company AS node FROM v_company UNION SELECT src FROM v_company_edge WHERE trade_year = 1997
  UNION SELECT dst FROM v_company_edge WHERE trade_year = 1997) n LEFT JOIN v_company c ON c.company = n.node""")
def src7_graph_nodes(v):
    return N.graph_of_year(_nodes(v), v("v_company_edge"), 1997)[0]


@query("SELECT src, dst, trade_year, coalesce(sly_amt, 1.0) AS weight FROM v_company_edge WHERE trade_year = 1997")
def src7_graph_edges(v):
    return N.graph_of_year(_nodes(v), v("v_company_edge"), 1997, "sly_amt")[1].select("src", "dst", "trade_year", "weight")


@query("SELECT src, dst, trade_year, coalesce(CASE WHEN n_filings > 1 THEN cast(n_filings AS double) END, cast(1 AS double)) AS weight FROM v_company_edge")
def p28_edge_weights(v):
    counts = v("v_company_edge").withColumn("trade_cnt", F.when(F.col("n_filings") > 1, F.col("n_filings")))
    return N.weighted_edges(counts, "trade_cnt").select("src", "dst", "trade_year", "weight")


@query("""SELECT c.company AS firm, coalesce(CASE WHEN c.company % 3 = 0 THEN c.sector END, CASE WHEN c.company % 7 <> 0 THEN c.hq END) AS sector, coalesce(e.n, 0) AS n_supplies
  FROM v_company c LEFT JOIN (SELECT src, count(*) AS n FROM v_company_edge WHERE trade_year = 1997 GROUP BY src) e ON e.src = c.company""")
def src8_firms_of_graph(v):
    c = v("v_company").withColumnRenamed("company", "firm")
    own = c.select("firm", F.when(F.col("firm") % 3 == 0, F.col("sector")).alias("sector"))
    linked = c.where("firm % 7 <> 0").select("firm", F.col("hq").alias("sector"))
    got = N.firm_tables(own, linked, {"supplies": v("v_company_edge").withColumnRenamed("trade_year", "year")}, 1997)
    n = got["supplies"].groupBy(F.col("src").alias("firm")).agg(F.count("*").alias("n"))
    return got["firms"].join(n, "firm", "left").select("firm", "sector", F.coalesce("n", F.lit(0)).alias("n_supplies"))


@query("""SELECT src, dst, rate, CASE WHEN src IS NULL THEN 'no src' WHEN dst IS NULL THEN 'no dst' WHEN rate IS NULL THEN 'no rate' ELSE '' END AS reason FROM
  (SELECT cast(CASE WHEN src % 77 = 0 THEN NULL ELSE src END AS string) AS src, cast(dst AS string) AS dst, CASE WHEN dst % 5 <> 0 THEN amount END AS rate FROM v_pair) x""")
def p26_rate_triples(v):
    t = v("v_pair").select(F.when(F.col("src") % 7 != 0, F.col("src")).alias("from_"), F.when(F.col("src") % 11 != 0, F.col("src")).alias("p1"), F.col("dst").alias("to"), F.when(F.col("dst") % 5 != 0, F.col("amount")).alias("w"))
    good, bad = N.norm_triples(t)
    return good.withColumn("reason", F.lit("")).unionByName(bad)


@query("""SELECT company AS node, year, CASE WHEN balance < 0 THEN 'amount below 0' WHEN company % 13 = 0 THEN 'rate not finite' WHEN company % 17 = 0 THEN 'no company'
  WHEN short THEN 'code not of 10 digits' ELSE '' END AS reason, n_codes FROM (SELECT m.company, m.year, c.balance, count(DISTINCT m.code) AS n_codes, max(CASE WHEN m.tier = 7 THEN 1 ELSE 0 END) = 1 AS short
  FROM v_product_mix m JOIN v_company c ON c.company = m.company GROUP BY m.company, m.year, c.balance) x""")
def p29_tariff_seeds(v):
    codes = v("v_product_mix").groupBy("company", "year").agg(F.countDistinct("code").alias("n_codes"), F.collect_set(F.when(F.col("tier") == 7, F.substring("code", 1, 6)).otherwise(F.col("code"))).alias("codes"))
    seeds = codes.join(v("v_company").select("company", F.col("balance").alias("amount")), "company").select(
        F.col("company").alias("node"), F.when(F.col("company") % 17 != 0, F.col("company")).alias("company"), "amount", "codes", "n_codes", "year", F.when(F.col("company") % 13 == 0, F.lit(float("nan"))).otherwise(0.1).alias("rate")
    )
    good, bad = N.checked_seeds(seeds)
    return good.withColumn("reason", F.lit("")).unionByName(bad).select("node", "year", "reason", "n_codes")


@query("""SELECT concat('run', cast(i.scenario_seq AS string)) AS run_id, i.firm, i.rev_demand, i.capped, CASE WHEN i.scenario_seq > 1995 THEN concat('s', cast(i.scenario_seq AS string)) END AS scenario_id
  FROM v_impact i WHERE i.firm IN (SELECT company FROM v_company) AND i.scenario_seq <> 1993""")
def snk9_impact_links(v):
    i = v("v_impact").withColumn("run_id", F.concat(F.lit("run"), F.col("scenario_seq").cast("string")))
    runs = i.where("scenario_seq <> 1993").select("run_id", F.when(F.col("scenario_seq") != 1994, F.concat(F.lit("s"), F.col("scenario_seq").cast("string"))).alias("scenario_id")).distinct()
    got = N.impact_links(i.select("run_id", "firm", "rev_demand", "capped"), v("v_company").select(F.col("company").alias("firm")), runs, runs.where("scenario_id > 's1995'"))
    return got["impacts"].join(got["executed_as"], "run_id", "left").select("run_id", "firm", "rev_demand", "capped", "scenario_id")


@query("""SELECT company, CASE company % 6 WHEN 0 THEN '미대상' WHEN 1 THEN '대기업' WHEN 2 THEN '중소기업' WHEN 3 THEN '중견기업' ELSE cast(company % 6 AS string) END AS size,
  CASE company % 4 WHEN 0 THEN '-' WHEN 1 THEN '코스피' WHEN 2 THEN '코스닥' ELSE '기타' END AS market, hq FROM v_company""")
def p19_code_labels(v):
    c = v("v_company")
    return c.select("company", L.label("scaledivcd", F.col("company") % 6).alias("size"), L.label("ltgmktdivcd", F.when(F.col("company") % 4 != 0, F.col("company") % 4)).alias("market"), L.label("hq", F.col("hq")).alias("hq"))


@query("""SELECT c.company, concat_ws(chr(10), concat('company: ', cast(c.company AS string)), concat('name: ', c.name), concat('sector: ', CASE WHEN c.company % 4 = 0 THEN '-' ELSE c.sector END), CASE WHEN c.company % 3 <> 0 THEN concat('nation: ', c.hq) END) AS profile,
  format('customers: {}, suppliers: {}, most sold: {:,}, most bought: {:,}', coalesce(o.n, 0), coalesce(i.n, 0), cast(trunc(coalesce(o.m, 0)) AS bigint), cast(trunc(coalesce(i.m, 0)) AS bigint)) AS stats
  FROM v_company c LEFT JOIN (SELECT src, count(DISTINCT dst) AS n, max(sly_amt) AS m FROM v_company_edge GROUP BY src) o ON o.src = c.company
  LEFT JOIN (SELECT dst, count(DISTINCT src) AS n, max(sly_amt) AS m FROM v_company_edge GROUP BY dst) i ON i.dst = c.company""")
def p20_profile_texts(v):
    c = v("v_company").withColumns({"sector": F.when(F.col("company") % 4 == 0, " ").otherwise(F.col("sector")), "hq": F.when(F.col("company") % 3 != 0, F.col("hq"))})
    text = L.profile_text("company", {"name": "name", "sector": "sector"}, {"hq": "nation"}).alias("profile")
    stats = E.edge_stats(v("v_company_edge")).withColumnRenamed("node", "company")
    return c.join(stats, "company", "left").select("company", text, L.stats_text(F.col("customers"), F.col("suppliers"), F.col("max_out"), F.col("max_in")).alias("stats"))


@query("""SELECT company, year, string_agg(concat(cast(tier AS string), '=', code, ' (wgt=', cast(cast(weight AS decimal(12, 6)) AS string), ', dir=', direction, ')'), ' | ' ORDER BY weight DESC, code, direction) AS mix
  FROM (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY weight DESC, code, direction) AS rk FROM v_product_mix) x WHERE rk <= 10 GROUP BY company, year""")
def p20_mix_lines(v):
    m = v("v_product_mix").withColumn("rk", F.expr("row_number() OVER (PARTITION BY company, year ORDER BY weight DESC, code, direction)")).where("rk <= 10")
    rows = m.groupBy("company", "year").agg(F.array_sort(F.collect_list(F.struct("rk", "tier", "code", F.col("weight").cast("decimal(12,6)").alias("weight"), "direction"))).alias("rows"))
    return rows.select("company", "year", L.mix_text(F.col("rows")).alias("mix"))


@query("""SELECT code AS full_code, rpad(substr(code, 1, cast(4 + length(name) % 7 AS int)), 10, '0') AS padded, length(name) % 7 < 6 AS changed FROM v_catalog""")
def p33_padded_codes(v):
    short = v("v_catalog").select(F.col("code").alias("full_code"), F.expr("substr(code, 1, 4 + length(name) % 7)").alias("short"))
    padded, changed = L.padded_code(F.col("short"))
    return short.select("full_code", padded.alias("padded"), changed.alias("changed"))


@query("""SELECT p_partkey, refused, CASE WHEN unrelated THEN CASE WHEN hits = 0 AND refused THEN '거부(정상)' WHEN hits = 0 OR refused THEN '부분거부' ELSE '오추천' END
  ELSE CASE WHEN refused THEN '거부' WHEN hits = 0 THEN '후보없음' ELSE '유효 추천' END END AS verdict FROM (SELECT p_partkey, p_partkey % 5 = 0 AS refused, p_size > 40 AS unrelated, p_size % 3 AS hits FROM part) x""")
def a22_refusal_verdicts(v):
    p = v("part")
    answer = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_name"), F.lit("은 무관합니다"))).otherwise(F.col("p_name"))
    refused, verdict = L.refusal_verdict(F.col("p_size") > 40, F.col("p_size") % 3, answer)
    return p.select("p_partkey", refused.alias("refused"), verdict.alias("verdict"))


@query(f"SELECT firm, round(revenue_sum, 2) AS revenue_sum FROM ({graph_queries._TABLE}) x WHERE scenario_seq = 1998 ORDER BY abs(revenue_sum) DESC, firm LIMIT 30")
def t4_top_impacts(v):
    return I.top_impacts(graph_queries._impact(v).where("scenario_seq = 1998")).select("firm", F.round("revenue_sum", 2).alias("revenue_sum"))


QUERIES["t4_top_scores"] = lambda spark, sf_dir: I.top_scores(graph_queries.QUERIES["g24_tis"](spark, sf_dir))
SQL["t4_top_scores"] = f"SELECT firm, tis FROM ({graph_queries.SQL['g24_tis']}) t ORDER BY tis DESC, firm LIMIT 20"

_TYPED = "SELECT company AS query_id, substr(name, 10) AS query FROM v_company WHERE company % 50 = 0"


@query("SELECT query_id, code AS firm, score, rk FROM (" + _cut(
    f"""SELECT query_id, code, round(n / (nq + nc - n), 6) AS score FROM (SELECT query_id, code, nq, nc, count(*) AS n FROM (SELECT query_id, len(g) AS nq, unnest(g) AS gram FROM (SELECT query_id, {_GRAMS.format('query')} AS g FROM ({_TYPED}) t) a) q
  JOIN (SELECT code, len(g) AS nc, unnest(g) AS gram FROM (SELECT company AS code, {_GRAMS.format('name')} AS g FROM v_company) b) c ON c.gram = q.gram GROUP BY query_id, code, nq, nc) x""", 10) + ") z")
def r14_autocomplete(v):
    firms = v("v_company").select(F.col("company").alias("firm"), "name")
    typed = firms.where("firm % 50 = 0").select(F.col("firm").alias("query_id"), F.expr("substr(name, 10)").alias("query"))
    return S.autocomplete(typed, firms)
