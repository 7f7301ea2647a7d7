"""Registered queries on catalog search, evaluation, text expressions, loaders and the two append flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions import text as T
from tradeloom.operators import learning, vectors
from tradeloom.operators import search as S
from tradeloom.plans.edge_queries import _rounded
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


_TOK = "list_distinct(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> ''))"
_INDEX = "SELECT code, token, max(w) AS weight FROM (" + " UNION ALL ".join(f"SELECT code, unnest({_TOK.format(c)}) AS token, {w} AS w FROM v_catalog" for c, w in (("name", 1.0), ("category", 0.4), ("heading", 0.2), ("detail", 0.1))) + ") x GROUP BY code, token"
_Q = f"SELECT query_id, unnest({_TOK.format('query')}) AS token FROM v_query"
_TOKSIG = f"SELECT query_id, code, round(sum(weight), 6) AS score FROM ({_Q}) q JOIN ({_INDEX}) i ON i.token = q.token GROUP BY query_id, code"
_GRAMS = "list_distinct([substr('  ' || lower(coalesce({0}, '')) || ' ', i, 3) for i in range(1, length(lower(coalesce({0}, ''))) + 2)])"
_TRGSIG = f"""SELECT query_id, code, round(n / (nq + nc - n), 6) AS score FROM (SELECT query_id, code, nq, nc, count(*) AS n FROM (SELECT query_id, len(g) AS nq, unnest(g) AS gram FROM (SELECT query_id, {_GRAMS.format('query')} AS g FROM v_query) a) q
  JOIN (SELECT code, len(g) AS nc, unnest(g) AS gram FROM (SELECT code, {_GRAMS.format('name')} AS g FROM v_catalog) b) c ON c.gram = q.gram GROUP BY query_id, code, nq, nc) x"""


def _cut(sql: str, pool: int) -> str:
    return f"SELECT * FROM (SELECT query_id, code, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS rk FROM ({sql}) s) y WHERE rk <= {pool}"


_FUSED = _cut(f"SELECT query_id, code, round(sum(1.0::DOUBLE / (60 + rk)), 8) AS score FROM (SELECT * FROM ({_cut(_TRGSIG, 50)}) a UNION ALL SELECT * FROM ({_cut(_TOKSIG, 50)}) b) u GROUP BY query_id, code", 10)


def _index(v) -> DataFrame:
    return S.weighted_tokens(v("v_catalog"), {"name": "A", "category": "B", "heading": "C", "detail": "D"})


def _hits(v) -> DataFrame:
    return S.search(v("v_query"), v("v_catalog"), _index(v))


@query(_INDEX)
def r6_weighted_tokens(v):
    return _index(v)


@query(_cut(_TOKSIG, 50))
def r3_token_signal(v):
    return S.token_signal(v("v_query"), _index(v))


@query(_cut(_TRGSIG, 20))
def r2_trigram_signal(v):
    return S.trigram_signal(v("v_query"), v("v_catalog"), 20)


@query(_cut(f"SELECT q.query_id, c.code, coalesce(t.score, 0) AS score FROM v_query q CROSS JOIN v_catalog c LEFT JOIN ({_TRGSIG}) t ON t.query_id = q.query_id AND t.code = c.code", 800))
def r2_filled_pool(v):
    """Pools larger than what shares a trigram: the rest of each is filled."""
    return S.trigram_signal(v("v_query"), v("v_catalog"), 800, fill=True)


_DOT = "list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


@query(_cut(f"SELECT q.vec_id AS query_id, c.vec_id AS code, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) AS score FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 50 = 0", 10))
def r1_vector_signal(v):
    e = v("embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return S.vector_signal(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "code"), 10)


@query("SELECT count(*) AS queries, true AS good FROM embeddings WHERE vec_id % 50 = 0")
def r1_index_recall(v):
    """The index of lists against the exact neighbours, over the whole table: recall is 0.9 at least."""
    e = v("embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q, c = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "code")
    share = vectors.recall(S.vector_signal(q, c, 10, lists=16), S.vector_signal(q, c, 10))
    return q.agg(F.count("*").alias("queries")).join(share, F.lit(True)).select("queries", (F.col("recall") >= 0.9).alias("good"))


@query(_FUSED)
def r4_fused_search(v):
    return _hits(v)


@query(_cut(f"SELECT query_id, code, round(sum(1.0::DOUBLE / (60 + rk)), 8) AS score FROM (SELECT * FROM ({_cut(_TRGSIG.replace('FROM v_catalog', chr(70) + 'ROM v_catalog WHERE valid_to >= DATE ' + chr(39) + '2024-01-01' + chr(39) + ' AND starts_with(code, ' + chr(39) + '00000' + chr(39) + ')'), 50)}) a UNION ALL SELECT * FROM ({_cut(_TOKSIG.replace('FROM v_catalog', 'FROM v_catalog WHERE valid_to >= DATE ' + chr(39) + '2024-01-01' + chr(39) + ' AND starts_with(code, ' + chr(39) + '00000' + chr(39) + ')'), 50)}) b) u GROUP BY query_id, code", 5))
def r5_filtered_catalog_search(v):
    return S.search(v("v_query"), v("v_catalog"), _index(v), 5, as_of="2024-01-01", prefix="00000")


@query("SELECT * FROM v_catalog WHERE valid_to >= DATE '2024-01-01'")
def p4_active_codes(v):
    return v("v_catalog").where(F.col("valid_to") >= F.lit("2024-01-01").cast("date"))


@query("SELECT code, substr(code, 1, 2) AS hs2, substr(code, 1, 4) AS hs4, substr(code, 1, 6) AS hs6 FROM v_catalog")
def p5_prefix_columns(v):
    return v("v_catalog").select("code", *T.prefixes(F.col("code")))


_RANKS = f"SELECT q.query_id, q.template, min(CASE WHEN h.code = q.target THEN rk END) AS exact, min(CASE WHEN substr(h.code, 1, 6) = substr(q.target, 1, 6) THEN rk END) AS family FROM v_query q LEFT JOIN ({_FUSED}) h ON h.query_id = q.query_id GROUP BY q.query_id, q.template"


@query(f"SELECT query_id, exact, family FROM ({_RANKS}) x")
def w7_rank_of_target(v):
    return S.ranks(v("v_query"), _hits(v))


_METRICS = "count(*) AS n, round(avg(CASE WHEN family IS NULL THEN 0 ELSE 1 END), 6) AS found, round(avg(CASE WHEN family <= 1 THEN 1 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN family <= 5 THEN 1 ELSE 0 END), 6) AS hit5, round(avg(CASE WHEN family <= 10 THEN 1 ELSE 0 END), 6) AS hit10, round(avg(coalesce(1.0::DOUBLE / family, 0)), 6) AS mrr"


@query(f"SELECT {_METRICS} FROM ({_RANKS}) x")
def a19_retrieval_metrics(v):
    return _rounded(S.retrieval_metrics(S.ranks(v("v_query"), _hits(v)), "family"), found=6, hit1=6, hit5=6, hit10=6, mrr=6)


@query(f"SELECT template, {_METRICS} FROM ({_RANKS}) x GROUP BY template")
def r13_metrics_by_template(v):
    r = S.ranks(v("v_query"), _hits(v)).join(v("v_query").select("query_id", "template"), "query_id")
    return _rounded(S.retrieval_metrics(r, "family", "template"), found=6, hit1=6, hit5=6, hit10=6, mrr=6)


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) x WHERE k = least(floor(0.95 * n), n - 1)")
def a19_latency_p95(v):
    return S.nearest_rank(v("events"), "value", 0.95, "event_type")


@query(f"SELECT query_id, code, score, rk FROM (SELECT h.*, q.template, max(h.score) OVER (PARTITION BY h.query_id) AS best FROM ({_FUSED}) h JOIN v_query q ON q.query_id = h.query_id) x WHERE template = 'T2' OR best >= 0.033")
def r10_search_flow(v):
    """The flow without synonyms; queries of one template that find little are judged unrelated."""
    catalog, index = v("v_catalog"), _index(v)
    verdicts = v("v_query").where("template = 'T1'").select("query_id", F.lit("unrelated").alias("verdict"), F.lit(None).cast("string").alias("keywords"))
    none = v("v_catalog").limit(0).select(F.col("name").alias("alias"), F.col("name").alias("official"))
    return learning.search_flow(v("v_query").select("query_id", "query"), lambda q, n: S.search(q, catalog, index, n), none, verdicts, 10, 0.033)[0]


@query(f"SELECT query_id, string_agg(concat(cast(rk AS string), '. ', h.code, ' ', c.name), chr(10) ORDER BY rk) AS context FROM ({_FUSED}) h JOIN v_catalog c ON c.code = h.code GROUP BY query_id")
def r11_context_text(v):
    return S.context_text(_hits(v), v("v_catalog"))


@query(_cut(f"SELECT query_id, code, max(score) AS score FROM (SELECT * FROM ({_cut(_TRGSIG, 10)}) a UNION ALL SELECT * FROM ({_cut(_TOKSIG, 10)}) b) x GROUP BY query_id, code", 8))
def r9_merged_hits(v):
    return S.merge_hits(S.trigram_signal(v("v_query"), v("v_catalog"), 10), S.token_signal(v("v_query"), _index(v), 10), 8)


@query(f"SELECT q.query_id, q.query, coalesce(h.s, 0) AS top_score, h.c AS top_codes, coalesce(h.s, 0) < 0.033 AS low_confidence FROM v_query q LEFT JOIN (SELECT query_id, max(score) AS s, string_agg(code, ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS c FROM ({_FUSED}) f GROUP BY query_id) h ON h.query_id = q.query_id")
def snk12_search_log(v):
    return S.log_rows(_hits(v), v("v_query"), 0.033).withColumn("top_codes", F.array_join("top_codes", ","))


@query("SELECT company AS query_id, name AS query, company AS target FROM v_company WHERE length(trim(name)) >= 2 AND name IN (SELECT name FROM v_company GROUP BY name HAVING count(DISTINCT company) = 1)")
def a23_evaluation_set(v):
    return S.evaluation_set(v("v_company").select(F.col("company").alias("code"), "name"))


@query("SELECT round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std, round(min(m), 4) AS least, round(max(m), 4) AS most, round(max(m) - min(m), 4) AS spread, round((avg(m) - 10) / stddev_pop(m), 3) AS delta_sigma, CASE WHEN abs((avg(m) - 10) / stddev_pop(m)) <= 2 THEN 'noise' ELSE 'changed' END AS verdict FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) x")
def a20_stability(v):
    runs = v("events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return _rounded(S.stability(runs, "m", 10.0), mean=4, std=4, least=4, most=4, spread=4, delta_sigma=3)


@query("SELECT p_partkey AS answer_id, cast(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS cited, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS grounded, round(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END / CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END, 4) AS faithfulness FROM part")
def a21_grounding(v):
    code = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    other = F.lpad((F.col("p_partkey") + 1000000).cast("string"), 10, "0")
    text = F.concat(F.lit("see "), code, F.when(F.expr("p_partkey % 3 = 0"), F.concat(F.lit(" and "), other)).otherwise(F.lit(".")))
    a = v("part").select(F.col("p_partkey").alias("answer_id"), text.alias("text"), F.array(F.when(F.expr("p_partkey % 2 = 0"), code).otherwise(F.lit("none"))).alias("sources"))
    return _rounded(S.grounding(a), faithfulness=4)


_PRE = "SELECT substr(code, 1, 8) AS prefix, min(category) AS name FROM v_catalog GROUP BY substr(code, 1, 8) UNION ALL SELECT substr(code, 1, 6), 'F' || substr(code, 5, 2) FROM v_catalog GROUP BY substr(code, 1, 6), substr(code, 5, 2) UNION ALL SELECT substr(code, 1, 7), 'F' || substr(code, 5, 2) FROM v_catalog GROUP BY substr(code, 1, 7), substr(code, 5, 2)"


@query(f"""SELECT c.code, concat(a.name, ' > ', b.name) AS chain FROM v_catalog c JOIN ({_PRE}) a ON a.prefix = substr(c.code, 1, 6) JOIN ({_PRE}) b ON b.prefix = substr(c.code, 1, 8)""")
def r7_ancestor_chains(v):
    c = v("v_catalog")
    part = lambda n, name: c.groupBy(F.substring("code", 1, n).alias("prefix")).agg(name.alias("name"))
    family = F.min(F.concat(F.lit("F"), F.substring("code", 5, 2)))
    heads = part(8, F.min("category")).unionByName(part(6, family)).unionByName(part(7, family))
    return S.chains(c, heads, [6, 7, 8])


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN rpad(CASE WHEN length(cast(p_partkey AS string)) % 2 = 1 THEN '0' || cast(p_partkey AS string) ELSE cast(p_partkey AS string) END, 10, '0') ELSE rpad(cast(p_partkey AS string), 10, '0') END AS code FROM part")
def p1_product_codes(v):
    return v("part").select("p_partkey", T.product_code(F.col("p_partkey").cast("string"), F.expr("p_size % 2 = 1")).alias("code"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(ts AS DATE) END AS day, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def p2_parsed_fields(v):
    day = F.when(F.expr("event_id % 3 = 0"), "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    number = F.when(F.expr("event_id % 5 = 0"), " nan ").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return v("events").select("event_id", T.to_date(day).alias("day"), T.to_number(number).alias("value"))


@query("SELECT CASE WHEN p_size < 5 THEN 'size' WHEN p_retailprice < 920 THEN 'price' ELSE 'ok' END AS reason, count(*) AS n FROM part GROUP BY 1")
def a26_load_report(v):
    good, bad = T.split_valid(v("part"), {"size": F.col("p_size") >= 5, "price": F.col("p_retailprice") >= 920})
    return bad.groupBy("reason").agg(F.count("*").alias("n")).unionByName(good.agg(F.count("*").alias("n")).select(F.lit("ok").alias("reason"), "n"))


@query("SELECT company, grade, CASE regexp_replace(grade, '[^A-Za-z]', '', 'g') WHEN 'AAA' THEN 1 WHEN 'AA' THEN 2 WHEN 'A' THEN 3 WHEN 'BBB' THEN 4 WHEN 'BB' THEN 5 WHEN 'B' THEN 6 END AS score FROM v_grade")
def p7_grade_scores(v):
    from tradeloom.operators.risk import grade_to_score

    return v("v_grade").select("company", "grade", grade_to_score(F.col("grade")).alias("score"))


@query("SELECT company, CASE WHEN s < 1.5 THEN 'AAA' WHEN s < 2.5 THEN 'AA' WHEN s < 3.5 THEN 'A' WHEN s < 4.5 THEN 'BBB' WHEN s < 5.5 THEN 'BB' WHEN s < 6.5 THEN 'B' WHEN s < 7.5 THEN 'CCC' WHEN s < 8.5 THEN 'CC' WHEN s < 9.5 THEN 'C' ELSE 'D' END AS grade FROM (SELECT company, 1 + abs(balance) / 1000 AS s FROM v_company) x")
def p8_score_grades(v):
    from tradeloom.operators.risk import score_to_grade

    return v("v_company").select("company", score_to_grade(1 + F.abs("balance") / 1000).alias("grade"))


@query("SELECT concat(cast(company AS string), '|', hq) AS node_id, cast(company AS string) AS bizno, hq AS code FROM v_company")
def p9_node_ids(v):
    x = v("v_company").select(T.node_id(F.col("company"), F.col("hq")).alias("node_id"))
    a, b = T.parse_node_id(F.col("node_id"))
    return x.select("node_id", a.alias("bizno"), b.alias("code"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[,;/|·ㆍ()\\[\\]{}]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents")
def p10_normalised_text(v):
    return v("documents").select("doc_id", T.normalise_query(F.col("text")).alias("clean"))


@query("SELECT code, concat(name, ' | ', category, CASE WHEN heading LIKE '%1' THEN '' ELSE ' | ' || heading END) AS text FROM v_catalog")
def p13_search_text(v):
    h = F.when(F.col("heading").endswith("1"), " ").otherwise(F.col("heading"))
    return v("v_catalog").select("code", T.search_text(F.col("name"), F.col("category"), h).alias("text"))


@query("SELECT conv_id, turn, contains(text, '?') OR len(string_split_regex(trim(text), '\\s+')) >= 6 OR (len(string_split_regex(trim(text), '\\s+')) >= 3 AND (contains(text, 'the') OR contains(text, 'der'))) AS sentence FROM conversations")
def p14_sentence_gate(v):
    return v("conversations").select("conv_id", "turn", T.looks_like_sentence(F.col("text"), ["the", "der"]).alias("sentence"))


_ALIASES = "SELECT DISTINCT p_name AS alias, 'x' || substr(p_type, 1, 2) AS official FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT substr(p_type, 1, 2)) = 1) UNION ALL SELECT DISTINCT p_type, 'y' || substr(p_type, 1, 2) FROM part"


@query(f"""SELECT q.query_id, string_agg(w, ' ' ORDER BY p) AS expanded FROM (SELECT query_id, w, min(p) AS p FROM (SELECT query_id, unnest(string_split(full_text, ' ')) AS w, generate_subscripts(string_split(full_text, ' '), 1) AS p FROM
  (SELECT q.query_id, q.query || coalesce(' ' || string_agg(a.official, ' ' ORDER BY a.alias, a.official), '') AS full_text FROM v_query q LEFT JOIN ({_ALIASES}) a ON contains(q.query, a.alias) AND NOT contains(q.query, a.official) GROUP BY q.query_id, q.query) x) y WHERE w <> '' GROUP BY query_id, w) q GROUP BY q.query_id""")
def p17_query_expansion(v):
    part = v("part").select("p_name", "p_type", F.substring("p_type", 1, 2).alias("kind"))
    names = part.groupBy("p_name").agg(F.countDistinct("kind").alias("n"), F.min("kind").alias("kind")).where("n = 1").select(F.col("p_name").alias("alias"), F.concat(F.lit("x"), "kind").alias("official"))
    return T.expand_queries(v("v_query"), names.unionByName(part.select(F.col("p_type").alias("alias"), F.concat(F.lit("y"), "kind").alias("official")).distinct()))


@query("SELECT conv_id, turn, trim(text) AS answer FROM conversations")
def p21_stripped_responses(v):
    wrapped = F.concat(F.lit("<think>why\nnot</think> "), F.trim("text"))
    return v("conversations").select("conv_id", "turn", T.strip_reasoning(wrapped).alias("answer"))


@query("SELECT event_type, CASE WHEN upper(event_type) IN ('CLICK', 'ERROR') THEN upper(event_type) ELSE 'FIT' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2")
def p22_valid_verdicts(v):
    return v("events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", T.valid_choice(F.col("event_type"), ["CLICK", "ERROR"], "FIT").alias("verdict"), "n")


@query("SELECT vec_id, round(v[1], 5) AS first, round(v[16], 5) AS last, round(list_sum(v), 4) AS total, round(sqrt(list_dot_product(v, v)), 4) AS length FROM (SELECT vec_id, [x / sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])) for x in embedding[1:16]::DOUBLE[]] AS v FROM embeddings) y")
def p25_unit_vectors(v):
    u = v("embeddings").select("vec_id", T.unit_vector(F.col("embedding"), 16).alias("u"))
    return u.select("vec_id", F.round(F.get("u", 0), 5).alias("first"), F.round(F.get("u", 15), 5).alias("last"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("length"))


@query("SELECT event_id, last_value(CASE WHEN event_id % 7 = 0 THEN event_type END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events")
def w6_forward_fill_of_a_sheet(v):
    e = v("events").select("event_id", F.when(F.expr("event_id % 7 = 0"), F.col("event_type")).alias("section"))
    return T.forward_fill(e, ["section"], "event_id")


@query("SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events) x WHERE k = least(floor(0.95 * n), n - 1)")
def a19_latency_p95_overall(v):
    return S.nearest_rank(v("events"), "value", 0.95)


@query("SELECT event_id, last_value(CASE WHEN event_id % 7 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events")
def w6_forward_fill(v):
    e = v("events").select("event_id", "user_id", F.when(F.expr("event_id % 7 = 0"), F.col("event_type")).alias("section"))
    return T.forward_fill(e, ["section"], "event_id", "user_id").select("event_id", "section")


@query("SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n = 1")
def w5_latest_row_per_key(v):
    return v("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l")).select("user_id", "l.event_type", "l.ts")


@query("SELECT code, length(code) AS level FROM (SELECT DISTINCT substr(code, 1, 2 * i) AS code FROM v_catalog CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS i) s) x WHERE regexp_matches(code, '^[0-9]{2,10}$')")
def src6_heading_levels(v):
    x = v("v_catalog").select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.substring("code", F.lit(1), 2 * i))).alias("code")).distinct()
    return x.where(F.col("code").rlike("^[0-9]{2,10}$")).select("code", F.length("code").cast("bigint").alias("level"))


@query("SELECT category, count(*) AS n, CASE WHEN count(*) = e.n THEN 'same' ELSE 'differs' END AS status FROM v_catalog c CROSS JOIN (SELECT count(*) / 6 AS n FROM v_catalog) e GROUP BY category, e.n")
def a16_level_counts(v):
    c = v("v_catalog")
    return c.groupBy("category").agg(F.count("*").alias("n")).join(c.agg((F.count("*") / 6).alias("e")), F.lit(True)).select("category", "n", F.when(F.col("n") == F.col("e"), "same").otherwise("differs").alias("status"))


@query("SELECT count(*) AS n, count(CASE WHEN regexp_matches(name, 'ring') THEN 1 END) AS rings, count(CASE WHEN heading IS NULL THEN 1 END) AS bare FROM v_catalog")
def a15_catalog_checks(v):
    return v("v_catalog").agg(F.count("*").alias("n"), F.count_if(F.col("name").rlike("ring")).alias("rings"), F.count_if(F.col("heading").isNull()).alias("bare"))


@query("SELECT count(*) AS n, count(p) AS covered FROM (SELECT DISTINCT substr(code, 1, 4) AS q FROM v_product_mix) a LEFT JOIN (SELECT DISTINCT substr(code, 1, 4) AS p FROM v_product_mix WHERE direction = 'EXP') b ON b.p = a.q")
def j12_prefix_coverage(v):
    m = v("v_product_mix")
    have = m.where("direction = 'EXP'").select(F.substring("code", 1, 4).alias("q"), F.lit(1).alias("p")).distinct()
    return m.select(F.substring("code", 1, 4).alias("q")).distinct().join(have, "q", "left").agg(F.count("*").alias("n"), F.count("p").alias("covered"))




@query("SELECT domain, query_id, code, rk FROM (SELECT 'product' AS domain, * FROM (" + _cut(_TRGSIG, 5) + ") a UNION ALL SELECT 'token' AS domain, * FROM (" + _cut(_TOKSIG, 5) + ") b) x")
def j19_unified_domains(v):
    a = S.trigram_signal(v("v_query"), v("v_catalog"), 5).withColumn("domain", F.lit("product"))
    b = S.token_signal(v("v_query"), _index(v), 5).withColumn("domain", F.lit("token"))
    return a.unionByName(b).select("domain", "query_id", "code", "rk")


@query("SELECT event_type AS query, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value < 3) x WHERE n = 1")
def st1_low_confidence_queue(v):
    """The stream's batch step applied to the whole log: latest low-confidence row of each query."""
    from tradeloom.streaming.flows import latest_low_confidence

    return latest_low_confidence(v("events").select(F.col("event_type").alias("query"), "ts", "event_id", F.col("value").alias("top_score")), 3.0)


