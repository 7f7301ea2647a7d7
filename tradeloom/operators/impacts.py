"""Input-output impacts: shock rates, first-round changes, coefficient table, split, cap, impact table and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.propagate import row_normalise, solve, spectral_radius
from tradeloom.session import durable

DEMAND = ("TARIFF", "GDP", "B2C_REVENUE", "GOV_REVENUE")
SUPPLY = ("IMPORT_PRICE", "IMPORT_SHUTDOWN", "DOMESTIC_SHUTDOWN", "DOMESTIC_PRICE")
_C = F.col


def _kind(*names: str) -> Column:
    return _C("input_type").isin(*names)


def shock_rates(shocks: DataFrame) -> DataFrame:
    """``shocks`` with ``revenue_rate`` and ``cost_rate``, both scaled by months over 12; an unknown kind is an error.

    Columns read: input_type, duration_month, before_tariff, after_tariff,
    price_elasticity, pass_through, income_elasticity, gdp_growth_rate,
    revenue_value, price_m_change_rate, price_m_elasticity, import_change,
    substitute_elasticity, price_domestic_value.
    """
    price_step = (1 + _C("before_tariff")) / (1 + _C("after_tariff")) - 1
    year = _C("duration_month") / 12
    wrong = F.raise_error(F.concat(F.lit("unknown input_type: "), F.coalesce("input_type", F.lit("null"))))
    revenue = (
        F.when(_kind("TARIFF"), _C("pass_through") * price_step * (_C("price_elasticity") + 1))
        .when(_kind("GDP"), _C("income_elasticity") * _C("gdp_growth_rate"))
        .when(_kind("B2C_REVENUE", "GOV_REVENUE"), _C("revenue_value"))
        .when(_kind("IMPORT_PRICE"), _C("pass_through") * _C("price_m_change_rate"))
        .when(_kind("IMPORT_SHUTDOWN", "DOMESTIC_SHUTDOWN"), (_C("substitute_elasticity") - 1) * _C("import_change"))
        .when(_kind("DOMESTIC_PRICE"), _C("pass_through") * _C("price_domestic_value"))
        .otherwise(wrong.cast("double"))
    )
    cost = (
        F.when(_kind("IMPORT_PRICE"), _C("price_m_change_rate") * (1 + F.coalesce("price_m_elasticity", F.lit(0.0))))
        .when(_kind("IMPORT_SHUTDOWN", "DOMESTIC_SHUTDOWN"), -_C("import_change"))
        .when(_kind("DOMESTIC_PRICE"), _C("price_domestic_value"))
        .otherwise(F.lit(0.0))
    )
    return shocks.withColumn("revenue_rate", revenue * year).withColumn("cost_rate", cost * year)


def sales_base(firms: DataFrame, columns: list[str]) -> DataFrame:
    """``(firm, base)``: the first of ``columns`` with any value, its nulls as 0; 0 if none has one."""
    present = firms.agg(*[F.count(c).alias(c) for c in columns]).first()
    for c in columns:
        if present[c]:
            return firms.select("firm", F.coalesce(_C(c).cast("double"), F.lit(0.0)).alias("base"))
    return firms.select("firm", F.lit(0.0).alias("base"))


#: Shocks that a join may broadcast.
MOST_SHOCKS = 10_000


def exports_hit(shocks: DataFrame, exports: DataFrame) -> DataFrame:
    """``(shock_id, firm, exported)``: exports ``(firm, hs6, nation, amount)`` that a shock's ``target_codes`` and ``target_nations`` name.

    Null codes, and null or no nations, mean all. Targets are exploded, so each
    kind of shock meets the exports by an equi-join of its own; a shock on all
    takes the firms' totals.
    """
    named = shocks.select("shock_id", _C("target_codes").alias("codes"), F.when(F.size("target_nations") > 0, _C("target_nations")).alias("nations"))
    by_code, by_nation = _C("codes").isNotNull(), _C("nations").isNotNull()
    one = lambda df, c, name: df.withColumn(name, F.explode(F.array_distinct(c))).drop(c)
    both = one(one(named.where(by_code & by_nation), "codes", "hs6"), "nations", "nation")
    code, nation = one(named.where(by_code & ~by_nation).drop("nations"), "codes", "hs6"), one(named.where(~by_code & by_nation).drop("codes"), "nations", "nation")
    met = [exports.join(t, keys).select("shock_id", "firm", "amount") for t, keys in ((both, ["hs6", "nation"]), (code, "hs6"), (nation, "nation"))]
    return met[0].unionByName(met[1]).unionByName(met[2]).groupBy("shock_id", "firm").agg(F.sum("amount").alias("exported"))


def first_round(shocks: DataFrame, firms: DataFrame, exports: DataFrame, sales_columns: list[str]) -> DataFrame:
    """``(shock_id, firm, delta_revenue, delta_cost)`` for every shock and firm.

    Tariffs and growth act on the exports that :func:`exports_hit` names, the
    others on sales; supply kinds cost the firm's purchases. Firms and exports
    are read several times, so both are made once.
    """
    firms, exports = durable(firms.select("firm", "purchases", *sales_columns)), durable(exports.select("firm", "hs6", "nation", "amount"))
    rated = durable(shock_rates(shocks).select("shock_id", "input_type", "revenue_rate", "cost_rate", "target_codes", "target_nations"))
    base = sales_base(firms, sales_columns).join(firms.select("firm", F.coalesce("purchases", F.lit(0.0)).alias("bought")), "firm")
    base = base.join(exports.groupBy("firm").agg(F.sum("amount").alias("all_exports")), "firm", "left")
    small = rated.count() <= MOST_SHOCKS
    pairs = base.join(F.broadcast(rated) if small else rated, F.lit(True))  # a row for each firm and shock, as the result has
    trade = _kind("TARIFF", "GDP")
    both = pairs.join(exports_hit(rated.where(trade), exports), ["shock_id", "firm"], "left")
    on_all = _C("target_codes").isNull() & (F.coalesce(F.size("target_nations"), F.lit(0)) <= 0)
    exported = F.coalesce(F.when(on_all, _C("all_exports")).otherwise(_C("exported")), F.lit(0.0))
    revenue = F.when(trade, exported).otherwise(_C("base"))
    cost = F.when(_kind(*SUPPLY), _C("bought")).otherwise(0.0)
    return both.select("shock_id", "firm", (revenue * _C("revenue_rate")).alias("delta_revenue"), (cost * _C("cost_rate")).alias("delta_cost"))


def coefficients(edges: DataFrame, firms: DataFrame, year: int, denominators: list[str], capital_codes: list[str] = ()) -> DataFrame:
    """``(i, j, w)``: seller i's part of buyer j's base; columns over 1 are scaled to 1.

    ``edges(src, dst, year, amount, target_cate, capital_code)``; households,
    government and capital goods are left out. A buyer's base is its first
    positive denominator; buyers without one have no column.
    """
    kept = edges.where(_C("year") == year).where(~F.coalesce(_C("target_cate").isin("B2C", "GOV"), F.lit(False)))
    if capital_codes:
        kept = kept.where(~F.coalesce(_C("capital_code").isin(*capital_codes), F.lit(False)))
    base = F.coalesce(*[F.when(_C(c) > 0, _C(c).cast("double")) for c in denominators])
    z = kept.groupBy(_C("src").alias("i"), _C("dst").alias("j")).agg(F.sum("amount").alias("amount"))
    z = z.join(firms.select(_C("firm").alias("i")), "i", "left_semi").join(firms.select(_C("firm").alias("j"), base.alias("base")).where("base > 0"), "j")
    h = z.select("i", "j", (_C("amount") / _C("base")).alias("w"))
    total = F.sum("w").over(Window.partitionBy("j"))
    return h.withColumn("total", total).select("i", "j", F.when(_C("total") > 1, _C("w") / _C("total")).otherwise(_C("w")).alias("w"))


def check_and_normalise(matrix: DataFrame, limit: float = 0.95, rounds: int = 30) -> tuple[DataFrame, float]:
    """The matrix, its rows normalised if its spectral radius estimate reaches ``limit``; and that estimate."""
    edges = matrix.select(_C("i").alias("src"), _C("j").alias("dst"), _C("w").alias("rate"))
    radius = spectral_radius(edges, rounds)
    if radius < limit:
        return matrix, radius
    return row_normalise(edges).select(_C("src").alias("i"), _C("dst").alias("j"), _C("rate").alias("w")), radius


def demand_split(matrix: DataFrame, change: DataFrame) -> DataFrame:
    """``(firm, initial, propagation, total)`` of ``change(firm, value)``."""
    total = solve(matrix, change.select(_C("firm").alias("i"), _C("value").alias("b")))
    joined = total.select(_C("i").alias("firm"), _C("x").alias("total")).join(change.select("firm", _C("value").alias("initial")), "firm", "left").na.fill(0.0)
    return joined.select("firm", "initial", (_C("total") - _C("initial")).alias("propagation"), "total")


def supply_split(matrix: DataFrame, cost: DataFrame, revenue: DataFrame, forward: DataFrame | None = None) -> DataFrame:
    """Cost by the matrix, revenue by the transpose of ``forward`` or of the matrix."""
    turned = (matrix if forward is None else forward).select(_C("j").alias("i"), _C("i").alias("j"), "w")
    c, r = demand_split(matrix, cost), demand_split(turned, revenue)
    name = lambda df, p: df.select("firm", *[_C(x).alias(f"{p}_{x}") for x in ("initial", "propagation", "total")])
    return name(c, "cost").join(name(r, "revenue"), "firm", "full").na.fill(0.0)


def cap(values: DataFrame, base: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``values(firm, value)`` cut to ``threshold`` times ``base(firm, base)``, sign kept, with a flag; firms without a base stay."""
    x = values.join(base.select("firm", "base"), "firm", "left")
    limit = threshold * F.abs("base")
    over = F.coalesce(F.abs("value") > limit, F.lit(False))
    return x.select("firm", F.when(over, F.signum("value") * limit).otherwise(_C("value")).alias("value"), over.alias("capped"))


def capped_ratio(flags: DataFrame) -> DataFrame:
    return flags.agg(F.coalesce(F.avg(_C("capped").cast("int")), F.lit(0.0)).alias("capped_ratio"))


def tis(change: DataFrame, sales: DataFrame, scores: DataFrame) -> DataFrame:
    """``(firm, tis)``: size of the change over sales, times the score over 10; 0 where sales are missing or 0."""
    x = change.join(sales, "firm", "left").join(scores, "firm", "left")
    return x.select("firm", F.coalesce(F.abs("value") / F.nullif(_C("sales"), F.lit(0.0)) * F.coalesce("score", F.lit(0.0)) / 10, F.lit(0.0)).alias("tis"))


def impact_table(firms: DataFrame, demand: DataFrame | None = None, supply: DataFrame | None = None) -> DataFrame:
    """The nine impact columns of each firm; revenue of supply adds to that of demand, profit is revenue less cost."""
    out = firms.select("firm")
    parts = ("initial", "propagation", "total")
    if demand is not None:
        out = out.join(demand.select("firm", *[_C(p).alias(f"d_{p}") for p in parts]), "firm", "left")
    if supply is not None:
        out = out.join(supply.select("firm", *[_C(f"{s}_{p}").alias(f"{s[0]}_{p}") for s in ("cost", "revenue") for p in parts]), "firm", "left")
    have = set(out.columns)
    value = lambda *names: sum((F.coalesce(n, F.lit(0.0)) for n in names if n in have), F.lit(0.0))
    label = {"initial": "initial", "propagation": "propagation", "total": "sum"}
    columns = [value(f"d_{p}", f"r_{p}").alias(f"revenue_{label[p]}") for p in parts] + [value(f"c_{p}").alias(f"cost_{label[p]}") for p in parts]
    columns += [(value(f"d_{p}", f"r_{p}") - value(f"c_{p}")).alias(f"profit_{label[p]}") for p in parts]
    return out.select("firm", *columns)


MEASURES = [f"{m}_{p}" for m in ("revenue", "cost", "profit") for p in ("initial", "propagation", "sum")]


def summary_card(impact: DataFrame, *keys: str) -> DataFrame:
    """Sums of the nine measures, the number and the ordered list of firms whose revenue changed."""
    hit = F.when(_C("revenue_sum") != 0, _C("firm"))
    return impact.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in MEASURES], F.count(hit).alias("n_affected"), F.array_join(F.array_sort(F.collect_list(hit)).cast("array<string>"), ",").alias("affected"))


def by_group(impact: DataFrame, firms: DataFrame, group: str) -> DataFrame:
    """``(run_id, group, revenue_total, cost_total, profit_total, firm_count)``."""
    x = impact.join(firms.select("firm", group), "firm")
    return x.groupBy("run_id", group).agg(F.sum("revenue_sum").alias("revenue_total"), F.sum("cost_sum").alias("cost_total"), F.sum("profit_sum").alias("profit_total"), F.count_if(_C("revenue_sum") != 0).alias("firm_count"))


def top_scores(scores: DataFrame, top_n: int = 20) -> DataFrame:
    """The ``top_n`` firms by ``tis``, greatest first, ties by firm."""
    return scores.orderBy(F.desc("tis"), "firm").limit(top_n)


def top_impacts(impact: DataFrame, top_n: int = 30) -> DataFrame:
    """The ``top_n`` rows of an impact table by size of revenue, ties by firm."""
    return impact.orderBy(F.desc(F.abs("revenue_sum")), "firm").limit(top_n)


def affected_firms(impact: DataFrame, firms: DataFrame, top_n: int, sort_by: str = "revenue_sum") -> DataFrame:
    """The ``top_n`` firms by size of ``sort_by``, with the metadata columns that ``firms`` has."""
    top = impact.orderBy(F.desc(F.abs(sort_by)), "firm").limit(top_n)
    return top.join(firms, "firm", "left").orderBy(F.desc(F.abs(sort_by)), "firm")


def severity(value: Column, most: Column, seed: Column) -> Column:
    """'seed', or 'high' from half of the maximum on, 'mid' from 0.15 on, else 'low'."""
    share = F.abs(value) / F.nullif(most, F.lit(0.0))
    return F.when(seed, "seed").when(share >= 0.5, "high").when(share >= 0.15, "mid").otherwise("low")


def run_chain(shock_id: int, shocks: DataFrame, firms: DataFrame, exports: DataFrame, edges: DataFrame, year: int, sales_columns: list[str], threshold: float = 1.0) -> DataFrame:
    """First round, coefficients, radius check, split, cap and impact table of one shock, with TIS."""
    firms = durable(firms)
    change = durable(first_round(shocks.where(_C("shock_id") == shock_id), firms, exports, sales_columns))
    matrix = durable(check_and_normalise(durable(coefficients(edges, firms, year, sales_columns)))[0])
    split = durable(demand_split(matrix, change.select("firm", _C("delta_revenue").alias("value"))))
    base = sales_base(firms, sales_columns)
    capped = cap(split.select("firm", _C("total").alias("value")), base, threshold)
    demand = split.select("firm", "initial").join(capped, "firm").select("firm", "initial", (_C("value") - _C("initial")).alias("propagation"), _C("value").alias("total"), "capped")
    table = impact_table(firms, demand)
    scores = firms.select("firm", "score")
    index = tis(table.select("firm", _C("revenue_sum").alias("value")), base.withColumnRenamed("base", "sales"), scores)
    return table.join(index, "firm").join(demand.select("firm", "capped"), "firm", "left")
