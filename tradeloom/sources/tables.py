"""Loaders of files and writers of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions.text import blank_to_null, forward_fill, product_code, require, section_name, split_valid, to_date, to_number
from tradeloom.operators.edges import upsert
from tradeloom.sources import versions


def read_csv(spark: SparkSession, path: str, numbers: list[str] = (), rename: dict[str, str] | None = None, required: list[str] = (), delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Every column as text, blanks null, ``numbers`` parsed (bad ones null), columns renamed; missing required columns are an error."""
    raw = spark.read.options(header=True, sep=delimiter, encoding=encoding, nullValue="").csv(path)
    df = require(raw.withColumnsRenamed(rename or {}), list(required))
    df = df.withColumns({c: (to_number(F.col(c)) if c in numbers else blank_to_null(F.col(c))) for c in df.columns})
    return df.select(*required, *[c for c in df.columns if c not in required]) if required else df


def with_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One column for each name, from the first filled of its header aliases; a name without any alias present is an error."""
    chosen = {}
    for name, options in aliases.items():
        present = [o for o in options if o in df.columns]
        if not present:
            raise ValueError(f"no column for {name}: {options}")
        chosen[name] = F.coalesce(*[F.col(o) for o in present]).alias(name)
    return df.select(*chosen.values())


def risk_pair(companies: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checked ``companies(id, grade, sales)`` and ``edges(source, target, share)``: no empty input, repeated company or unknown end."""
    if companies.isEmpty() or edges.isEmpty():
        raise ValueError("empty input")
    if twice := companies.groupBy("id").count().where("count > 1").select("id").limit(3).collect():
        raise ValueError(f"repeated companies: {[r.id for r in twice]}")
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    if unknown := ends.join(companies, "id", "left_anti").limit(3).collect():
        raise ValueError(f"unknown companies: {[r.id for r in unknown]}")
    return companies, edges


def product_codes(raw: DataFrame, headers: dict[str, str], as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed rows of a product-code export (columns ``code, name, valid_from, valid_to`` among ``headers``), and rejects with a reason."""
    df = raw.withColumnsRenamed(headers)
    numeric = F.col("code").rlike("^[0-9]+$") & F.coalesce(F.col("is_number").cast("boolean"), F.lit(False)) if "is_number" in df.columns else F.lit(False)
    typed = df.withColumns({"code": product_code(F.col("code"), numeric), "name": blank_to_null(F.col("name")), "valid_from": to_date(F.col("valid_from")), "valid_to": to_date(F.col("valid_to"))})
    good, bad = split_valid(typed, {"code": F.col("code").isNotNull(), "valid_from": F.col("valid_from").isNotNull(), "valid_to": F.col("valid_to").isNotNull()})
    return (good if as_of is None else good.where(F.col("valid_to") >= F.lit(as_of).cast("date"))), bad


def industry_levels(wide: DataFrame) -> DataFrame:
    """``(level, code, name, span, children)`` of sections and divisions from a wide sheet ``(row_no, c1, n1, .. c5, n5)``.

    Upper cells are filled downwards. A section's children are division and
    group names, a division's the names of all lower levels, in sheet order
    and once. A division before any section is an error.
    """
    pairs = [c for k in (1, 2) for c in (f"c{k}", f"n{k}")]
    full = forward_fill(wide, pairs, "row_no")
    full = full.withColumn("c1", F.when(F.col("c2").isNotNull() & F.col("c1").isNull(), F.raise_error(F.lit("a division stands before any section")).cast("string")).otherwise(F.col("c1")))

    def level(n: int, below: list[int]) -> DataFrame:
        names = F.array(*[F.struct("row_no", F.lit(k).alias("k"), F.col(f"n{k}").alias("v")) for k in below])
        x = full.where(F.col(f"c{n}").isNotNull()).groupBy(F.col(f"c{n}").alias("code")).agg(F.min_by(f"n{n}", "row_no").alias("raw"), F.flatten(F.collect_list(names)).alias("all"))
        kids = F.array_distinct(F.filter(F.transform(F.array_sort("all"), lambda s: s["v"]), lambda v: v.isNotNull()))
        name, span = section_name(F.col("raw"))
        return x.select(F.lit(n).alias("level"), "code", name.alias("name"), span.alias("span"), F.array_join(kids, " ").alias("children"))

    return level(1, [2, 3]).unionByName(level(2, [3, 4, 5]))


def graph_tables(firms: DataFrame) -> dict[str, DataFrame]:
    """Relationship tables of firms ``(firm, sector, year, hq, country)``; rows with a null end are left out, each pair once."""
    ends = {"in_sector": "sector", "observed_in": "year", "belongs_to": "hq", "located_in": "country"}
    return {name: firms.where(F.col(c).isNotNull()).select("firm", c).dropDuplicates() for name, c in ends.items() if c in firms.columns}


def supplies(edges: DataFrame, firms: DataFrame) -> DataFrame:
    """Supply edges whose ends are both known, one for each (src, dst, year): the greatest amount."""
    keys = firms.select("firm").distinct()
    kept = edges.join(keys.withColumnRenamed("firm", "src"), "src", "left_semi").join(keys.withColumnRenamed("firm", "dst"), "dst", "left_semi")
    return kept.groupBy("src", "dst", "year").agg(F.max("amount").alias("amount"))


def trade_tables(trade: DataFrame) -> dict[str, DataFrame]:
    """Exports, imports and product trade of ``(firm, direction, country, hs, year, amount)``, each with its own key."""
    sums = lambda df, *k: df.groupBy(*k).agg(F.sum("amount").alias("amount"))
    return {
        "exports_to": sums(trade.where("direction = 'EXP'"), "firm", "country", "year"),
        "imports_from": sums(trade.where("direction = 'IMP'"), "firm", "country", "year"),
        "trades_product": sums(trade, "firm", "hs", "direction", "year"),
    }


def upsert_table(updates: DataFrame, path: str, keys: list[str]) -> None:
    """Upsert into a plain Parquet table by key; for large tables see :func:`versions.upsert_versioned`, which rewrites touched buckets only."""
    spark = updates.sparkSession
    old = spark.read.parquet(path) if versions.recover(spark, path) else updates.limit(0)
    versions.replace(upsert(old, updates, keys), path)


def load_masters(masters: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Upsert sectors, product codes and countries, each by its key; returns the rows read of each."""
    keys = {"sectors": "code", "hs_codes": "code", "countries": "iso_alpha2"}
    unknown = [n for n in masters if n not in keys]
    if unknown:
        raise ValueError(f"unknown masters: {unknown}")
    for name, df in masters.items():
        upsert_table(require(df, [keys[name]]), f"{folder}/{name}", [keys[name]])
    return {name: df.count() for name, df in masters.items()}


def truncate(spark: SparkSession, path: str) -> int:
    """Empty a table; returns the number of rows it had."""
    df = spark.read.parquet(path)
    n = df.count()
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
    return n


def write_result_csv(df: DataFrame, path: str, scores: list[str]) -> None:
    """CSV with scores to four decimals, null as empty."""
    df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))) for c in scores}).write.mode("overwrite").options(header=True, nullValue="").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
