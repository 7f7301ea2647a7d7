"""Expressions on codes, names, queries and free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tradeloom.operators.matching import contained
from tradeloom.operators.ordered import carried_forward


def blank_to_null(c: Column) -> Column:
    """Trimmed text; empty text and the word nan are null."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def to_date(c: Column) -> Column:
    """The date in the first ten characters, null if there is none."""
    return F.try_to_timestamp(F.substring(blank_to_null(c), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def to_number(c: Column) -> Column:
    return blank_to_null(c).try_cast("double")


def product_code(c: Column, numeric: Column) -> Column:
    """Ten digits: text is padded on the right; a number of odd length first gets a leading zero. Else null."""
    t = F.trim(c)
    t = F.when(numeric & (F.length(t) % 2 == 1), F.concat(F.lit("0"), t)).otherwise(t)
    return F.when(t.rlike("^[0-9]{1,10}$"), F.rpad(t, 10, "0"))


def prefixes(code: Column) -> list[Column]:
    return [F.substring(code, 1, n).alias(f"hs{n}") for n in (2, 4, 6)]


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def node_id(bizno: Column, company_code: Column) -> Column:
    return F.concat_ws("|", F.coalesce(bizno.cast("string"), F.lit("")), F.coalesce(company_code.cast("string"), F.lit("")))


def parse_node_id(c: Column) -> tuple[Column, Column]:
    parts = F.split(c, "\\|", 2)
    return F.nullif(F.get(parts, 0), F.lit("")), F.nullif(F.get(parts, 1), F.lit(""))


def nfkc(c: Column) -> Column:
    """Compatibility normal form, which Spark has no function for."""

    @F.pandas_udf("string")
    def form(texts):
        import unicodedata

        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return form(c)


def normalise_query(c: Column, unicode_form: bool = True) -> Column:
    """Normal form, separators as spaces, runs of spaces as one, trimmed."""
    t = nfkc(c) if unicode_form else c
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[,;/|·ㆍ()\\[\\]{}]", " "), "\\s+", " "))


_CLAUSE = "\\[[^\\]]*(?:except|limited)[^\\]]*\\]|\\([^)]*(?:except|limited)[^)]*\\)"


def strip_clauses(c: Column) -> Column:
    """Without bracketed clauses that except or limit."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, _CLAUSE, " "), "\\s+", " "))


def extract_clauses(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(f"({_CLAUSE})"), 1), " ")


def search_text(*slots: Column) -> Column:
    """The filled slots joined by a bar."""
    return F.concat_ws(" | ", *[blank_to_null(s) for s in slots])


def looks_like_sentence(c: Column, noise: list[str]) -> Column:
    """A question mark, six tokens, or three tokens and a noise word."""
    n = F.size(F.split(F.trim(c), "\\s+"))
    noisy = F.lit(False)
    for w in noise:
        noisy = noisy | F.contains(c, F.lit(w))
    return F.contains(c, F.lit("?")) | (n >= 6) | ((n >= 3) & noisy)


def keep_items(items: Column, query: Column, least: int = 2, most: int = 3) -> Column:
    """Items that occur in the query, spaces aside, in order and once; each is normalised before its length counts."""
    flat = F.replace(query, F.lit(" "), F.lit(""))
    clean = F.transform(items, lambda x: normalise_query(x, unicode_form=False))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: (F.length(x) >= least) & F.contains(flat, F.replace(x, F.lit(" "), F.lit(""))))), 1, most)


def merge_synonyms(builtin: DataFrame, learned: DataFrame) -> DataFrame:
    """``(alias, official)``: enabled learned pairs override built-in ones."""
    new = learned.where("enabled").groupBy("alias").agg(F.max("official").alias("new"))
    return builtin.join(new, "alias", "full").select("alias", F.coalesce("new", "official").alias("official"))


def expand_queries(queries: DataFrame, synonyms: DataFrame, match: str = "query") -> DataFrame:
    """``(query_id, expanded)``: official terms whose alias occurs in the query, if not there already, in order of alias; tokens once.

    ``match`` names the column that aliases are sought in, if another. Aliases are found by their rarest characters (:func:`matching.contained`), so dictionaries of any size will do.
    """
    found = contained(queries.select(F.col("query_id").alias("id"), F.col(match).alias("text")), synonyms.select(F.col("alias").alias("term")))
    x = queries.join(found.select(F.col("id").alias("query_id"), F.col("term").alias("alias")).join(synonyms, "alias"), "query_id", "left")
    x = x.withColumn("pair", F.when(F.col("alias").isNotNull() & ~F.contains("query", "official"), F.struct("alias", "official")))
    terms = F.transform(F.array_sort(F.collect_list("pair")), lambda s: s.official)
    listed = x.groupBy("query_id", "query").agg(terms.alias("terms"))
    every = F.flatten(F.array(F.split("query", " "), F.flatten(F.transform("terms", lambda t: F.split(t, " ")))))
    return listed.select("query_id", F.array_join(F.array_distinct(F.array_remove(every, "")), " ").alias("expanded"))


def strip_reasoning(c: Column) -> Column:
    """Without a leading reasoning block."""
    return F.trim(F.regexp_replace(c, "(?s)<think>.*?</think>", ""))


def outer_json(c: Column, schema: str) -> Column:
    """The outermost braces, parsed; null if they hold no such object."""
    return F.from_json(F.nullif(F.regexp_extract(strip_reasoning(c), "(?s)(\\{.*\\})", 1), F.lit("")), schema)


def valid_choice(c: Column, choices: list[str], default: str) -> Column:
    up = F.upper(F.trim(c))
    return F.when(up.isin(*choices), up).otherwise(F.lit(default))


def section_name(c: Column) -> tuple[Column, Column]:
    """Name and range of a section such as ``Name (01~03)``."""
    span = F.regexp_extract(c, "\\(([0-9]+ *~ *[0-9]+)\\)", 1)
    return F.trim(F.regexp_replace(c, "\\([0-9]+ *~ *[0-9]+\\)", "")), F.nullif(span, F.lit(""))


def unit_vector(v: Column, dim: int) -> Column:
    """The first ``dim`` values at length 1; a zero vector stays."""
    cut = F.transform(F.slice(v, 1, dim), lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(cut, lambda x: F.when(n > 0, x / n).otherwise(x))


def category_order(c: Column) -> Column:
    """Place of HIGH, MEDIUM, LOW, NONE and anything else."""
    return F.when(c == "HIGH", 0).when(c == "MEDIUM", 1).when(c == "LOW", 2).when(c == "NONE", 3).otherwise(4)


def forward_fill(df: DataFrame, columns: list[str], order: str, *keys: str) -> DataFrame:
    """The last value above that isn't null, in order of a row number; keys bound a sheet.

    Without keys the table is filled by range partitions, each handing its last values on.
    """
    if not keys:
        return carried_forward(df, columns, order)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """An error for missing columns before any job runs."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every rule, and the others with the first rule that they break."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")
