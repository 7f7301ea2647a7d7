"""Labels and texts made of codes, profiles and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of code columns, and the label of codes a column does not list.
LABELS = {
    "scaledivcd": {"0": "미대상", "1": "대기업", "2": "중소기업", "3": "중견기업"},
    "ltgmktdivcd": {"1": "코스피", "2": "코스닥"},
    "frgivs_crp_yn": {"Y": "예", "N": "아니오"},
    "vtr_epr_yn": {"Y": "예", "N": "아니오"},
    "fundco_yn": {"Y": "예", "N": "아니오"},
}
OTHERWISE = {"ltgmktdivcd": "기타"}

#: Phrases of a refusal, and the verdicts.
REFUSAL = "확실하지 않|무관"
VERDICT = {"right": "거부(정상)", "partly": "부분거부", "wrong": "오추천", "valid": "유효 추천", "refused": "거부", "none": "후보없음"}


def label(column: str, c: Column) -> Column:
    """The label of a code, '-' for blanks, the code itself where its column has neither a label nor another default."""
    code = F.trim(c.cast("string"))
    known = [F.when(code == k, F.lit(v)) for k, v in LABELS.get(column, {}).items()]
    blank = code.isNull() | code.isin("", "None")
    return F.when(blank, "-").otherwise(F.coalesce(*known, F.lit(OTHERWISE[column]) if column in OTHERWISE else code))


def profile_text(key: str, head: dict[str, str], fields: dict[str, str]) -> Column:
    """Lines 'title: value': ``key``, each of ``head`` ('-' if empty), and the filled ones of ``fields`` with code labels."""
    text = lambda n: F.trim(F.col(n).cast("string"))
    lines = [F.concat(F.lit(f"{key}: "), F.col(key).cast("string"))]
    lines += [F.concat(F.lit(f"{title}: "), F.coalesce(F.nullif(text(n), F.lit("")), F.lit("-"))) for n, title in head.items()]
    lines += [F.when(text(n).isNotNull() & ~text(n).isin("", "None"), F.concat(F.lit(f"{title}: "), label(n, F.col(n)))) for n, title in fields.items()]
    return F.concat_ws("\n", *lines)


def mix_text(rows: Column) -> Column:
    """One line on an array of ``(tier, code, weight, direction)`` rows, in their order; '' for none."""
    return F.array_join(F.transform(rows, lambda m: F.concat(m["tier"].cast("string"), F.lit("="), m["code"], F.lit(" (wgt="), m["weight"].cast("string"), F.lit(", dir="), m["direction"], F.lit(")"))), " | ")


def stats_text(customers: Column, suppliers: Column, most_out: Column, most_in: Column) -> Column:
    """One line on a firm's edges, missing counts and amounts 0."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return F.format_string("customers: %d, suppliers: %d, most sold: %,d, most bought: %,d", n(customers), n(suppliers), n(most_out), n(most_in))


def padded_code(c: Column, width: int = 10) -> tuple[Column, Column]:
    """The code with zeros to its right up to ``width`` (longer ones stay, null is empty), and whether that changed it."""
    code = F.coalesce(c, F.lit(""))
    out = F.when(F.length(code) < width, F.rpad(code, width, "0")).otherwise(code)
    return out, ~out.eqNullSafe(c)


def refusal_verdict(unrelated: Column, n_hits: Column, answer: Column) -> tuple[Column, Column]:
    """Whether an answer refuses, and the verdict on it by kind of question and hits."""
    refused, empty = F.coalesce(answer.rlike(REFUSAL), F.lit(False)), F.coalesce(n_hits, F.lit(0)) == 0
    off = F.when(empty & refused, VERDICT["right"]).when(empty | refused, VERDICT["partly"]).otherwise(VERDICT["wrong"])
    on = F.when(refused, VERDICT["refused"]).when(empty, VERDICT["none"]).otherwise(VERDICT["valid"])
    return refused, F.when(unrelated, off).otherwise(on)
