"""Temporal list join: every capture of a page is judged by the list entries in force when it was fetched.

A list is a log of dated entries: a pattern (a host or a parent domain) is
added to or removed from a list at a date. Entries become validity intervals,
from an ``add`` to the pattern's next entry. A capture looks up its host and
the host's parent domains. The most specific pattern in force decides; between
lists, ``allow`` wins over ``block`` on the same pattern.

The as-of join is an equi-join on pattern and month, with the interval test on
top, so a host with a third of all captures is spread over months and can be
split further by adaptive execution; no window over captures is needed. An
interval has a row for each month in which captures exist.

Only DataFrame functions are used. A capture without a host, or with null time,
is judged ``none``. Captures that repeat id, URL and time count once. Entries
with null fields are ignored; of several entries of one pattern, list and date
the last in the order add, remove holds. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.session import read

_HOST = "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port, leading www. and final dot; null if there is none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), _HOST, 1), "^www\\.|\\.$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, list, valid_from, valid_to)`` of ``entries(pattern, list, action, effective_on)``; an open end is null."""
    known = entries.dropna(subset=["pattern", "list", "action", "effective_on"])
    last = known.groupBy("pattern", "list", "effective_on").agg(F.max("action").alias("action"))  # remove sorts after add
    after = Window.partitionBy("pattern", "list").orderBy("effective_on")
    dated = last.withColumn("valid_to", F.lead("effective_on").over(after))
    return dated.where("action = 'add'").select("pattern", "list", F.col("effective_on").alias("valid_from"), "valid_to")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``(capture_id, url, host, fetched_on, verdict, pattern, listed_since)`` of ``captures(capture_id, url, fetched_on)``."""
    rows = captures.select("capture_id", "url", "fetched_on").withColumn("host", host_of("url")).withColumn("month", _month(F.col("fetched_on")))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keyed = rows.withColumn("pattern", F.explode_outer(F.when(F.col("host").isNotNull(), suffixes)))
    span = captures.agg(F.min("fetched_on").alias("low"), F.max("fetched_on").alias("high"))
    # one row of bounds; intervals are cut to the months that have captures
    valid = intervals(entries).join(F.broadcast(span), F.lit(True))
    begin, end = F.greatest("valid_from", "low"), F.least(F.coalesce(F.date_sub("valid_to", 1), "high"), F.col("high"))
    valid = valid.where(begin <= end).withColumn("month", F.explode(F.sequence(_month(begin), _month(end)))).select("pattern", "list", "valid_from", "valid_to", "month")
    in_force = (F.col("k.pattern") == F.col("v.pattern")) & (F.col("k.month") == F.col("v.month")) & (F.col("v.valid_from") <= F.col("k.fetched_on")) & (F.col("v.valid_to").isNull() | (F.col("k.fetched_on") < F.col("v.valid_to")))
    joined = keyed.alias("k").join(valid.alias("v"), in_force, "left")
    rank = F.when(F.col("v.pattern").isNotNull(), F.struct(F.length("v.pattern").alias("size"), F.when(F.col("v.list") == "allow", 1).otherwise(0).alias("allow"), F.col("v.pattern").alias("pattern"), F.col("v.list").alias("list"), F.col("v.valid_from").alias("since")))
    best = joined.groupBy("capture_id", "url", "host", "fetched_on").agg(F.max(rank).alias("b"))
    return best.select("capture_id", "url", "host", "fetched_on", F.coalesce("b.list", F.lit("none")).alias("verdict"), F.col("b.pattern").alias("pattern"), F.col("b.since").alias("listed_since"))


#: The first day of the captures that the query derives.
_DAY0 = "2023-01-01"


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of the page table, whose fetch days follow from the page number."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit(_DAY0).cast("date"), (F.col("page_id") * 7919 % 730).cast("int")).alias("fetched_on"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts and domains that occur: each third is added, some are removed and added again."""
    hosts = pages.select(host_of("url").alias("pattern")).where("pattern is not null").distinct()
    domains = hosts.select(F.regexp_extract("pattern", "([^.]+\\.[^.]+\\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''")
    listed = hosts.unionByName(domains).distinct().withColumn("h", F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 7), 16, 10).cast("long"))
    listed = listed.where("h % 3 = 0").withColumn("list", F.when(F.expr("h % 4 = 0"), "allow").otherwise("block"))
    day = lambda n: F.date_add(F.lit(_DAY0).cast("date"), F.expr(n).cast("int"))
    log = F.array(
        F.struct(F.lit("add").alias("action"), day("h % 400").alias("effective_on")),
        F.when(F.expr("h % 2 = 0"), F.struct(F.lit("remove").alias("action"), day("h % 400 + 30 + h % 97").alias("effective_on"))),
        F.when(F.expr("h % 5 = 0"), F.struct(F.lit("add").alias("action"), day("h % 400 + 150 + h % 89").alias("effective_on"))),
    )
    return listed.select("pattern", "list", F.explode(log).alias("e")).where("e is not null").select("pattern", "list", "e.action", "e.effective_on")


def op6_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict on its fetch day."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(captures_of(pages), entries_of(pages)).withColumnRenamed("capture_id", "page_id")


SQL = f"""
WITH p AS (
  SELECT DISTINCT page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '^www\\.|\\.$', '', 'g'), '') AS host,
         DATE '{_DAY0}' + CAST(page_id * 7919 % 730 AS INTEGER) AS fetched_on
  FROM pages
),
names AS (SELECT host AS pattern FROM p WHERE host IS NOT NULL UNION SELECT regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) FROM p WHERE host IS NOT NULL),
listed AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS h FROM names WHERE pattern <> ''),
entries AS (
  SELECT pattern, CASE WHEN h % 4 = 0 THEN 'allow' ELSE 'block' END AS list, action, DATE '{_DAY0}' + CAST(day AS INTEGER) AS day
  FROM (
    SELECT pattern, h, 'add' AS action, h % 400 AS day FROM listed WHERE h % 3 = 0
    UNION ALL SELECT pattern, h, 'remove', h % 400 + 30 + h % 97 FROM listed WHERE h % 3 = 0 AND h % 2 = 0
    UNION ALL SELECT pattern, h, 'add', h % 400 + 150 + h % 89 FROM listed WHERE h % 3 = 0 AND h % 5 = 0
  )
),
dated AS (SELECT pattern, list, day, max(action) AS action FROM entries GROUP BY pattern, list, day),
valid AS (SELECT *, lead(day) OVER (PARTITION BY pattern, list ORDER BY day) AS till FROM dated),
hit AS (
  SELECT p.page_id, p.url, v.pattern, v.list, v.day,
         row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(v.pattern) DESC, (v.list = 'allow') DESC, v.pattern DESC, v.day DESC) AS n
  FROM p JOIN valid v ON v.action = 'add' AND (p.host = v.pattern OR ends_with(p.host, '.' || v.pattern)) AND v.day <= p.fetched_on AND (v.till IS NULL OR p.fetched_on < v.till)
)
SELECT p.page_id, p.url, p.host, p.fetched_on, coalesce(h.list, 'none') AS verdict, h.pattern, h.day AS listed_since
FROM p LEFT JOIN hit h ON h.page_id = p.page_id AND h.url = p.url AND h.n = 1
"""
