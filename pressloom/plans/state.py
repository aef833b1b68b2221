"""Keyed state and queues, in their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.plans.oracle import NOW
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles
from pressloom.plans.scans import ago, timed
from pressloom.sources.tables import table
from pressloom.streaming import journal as J

Q, SQL, query = registry()

_KINDS = "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'short' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'rejected' ELSE 'non_event' END"


def tries(spark: SparkSession, d: str) -> DataFrame:
    """Tries of urls: one for each event, keyed by user."""
    return table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("n"), F.expr(_KINDS).alias("verdict"))


@query(f"""WITH t AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS url, event_id AS n, {_KINDS} AS verdict FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n) AS r FROM t),
stop AS (SELECT url, coalesce(min(r) FILTER (WHERE verdict IN ('accepted', 'rejected', 'non_event') OR (verdict = 'short' AND r >= 2)), max(r)) AS r FROM k GROUP BY url)
SELECT k.url, k.verdict, CAST(k.r AS INT) AS attempts, (k.verdict IN ('accepted', 'rejected', 'non_event') OR (k.verdict = 'short' AND k.r >= 2)) AS final FROM k JOIN stop ON stop.url = k.url AND stop.r = k.r""")
def w05_url_state(spark: SparkSession, d: str) -> DataFrame:
    return J.batch_journal(tries(spark, d))


@query("SELECT dump_ts AS tick, row_number() OVER (ORDER BY dump_ts) AS n FROM (SELECT DISTINCT dump_ts FROM gkg) ORDER BY dump_ts LIMIT 24")
def w03_backlog(spark: SparkSession, d: str) -> DataFrame:
    """The oldest 24 ticks, numbered."""
    from pyspark.sql import Window

    first = table(spark, d, "gkg", "dump_ts").distinct().orderBy("dump_ts").limit(24)
    return first.select(F.col("dump_ts").alias("tick"), F.row_number().over(Window.orderBy("dump_ts")).alias("n"))


@query("SELECT url, min(gkg_id) AS gkg_id FROM gkg WHERE url IS NOT NULL GROUP BY url")
def w04_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg", "url", "gkg_id").where("url is not null").groupBy("url").agg(F.min("gkg_id").alias("gkg_id"))


@query("SELECT url, attempts FROM seen_urls WHERE verdict = 'short' AND attempts + 1 >= 2 ORDER BY attempts DESC, url LIMIT 25")
def w06_retry_ladder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seen_urls").where("verdict = 'short' and attempts + 1 >= 2").orderBy(F.desc("attempts"), "url").limit(25).select("url", "attempts")


@query("SELECT url, attempts, first_seen FROM seen_urls WHERE verdict = 'pending'")
def w07_pending(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seen_urls").where("verdict = 'pending'").orderBy("attempts", "first_seen", "url").select("url", "attempts", "first_seen")


@query(f"""SELECT count(*) FILTER (WHERE fetched_at > {NOW} - INTERVAL 24 HOUR) AS feed, count(*) FILTER (WHERE fetched_at > {NOW} - INTERVAL 192 HOUR) AS reuse,
  count(*) FILTER (WHERE fetched_at > {NOW} - INTERVAL 336 HOUR) AS archive, count(*) FILTER (WHERE fetched_at > {NOW} - INTERVAL 360 HOUR) AS kept FROM articles""")
def w08_windows(spark: SparkSession, d: str) -> DataFrame:
    inside = lambda h: F.count_if(F.col("fetched_at") > ago(h))
    return timed(spark, d).agg(inside(24).alias("feed"), inside(192).alias("reuse"), inside(336).alias("archive"), inside(360).alias("kept"))


@query("""SELECT article_id, CASE WHEN n IS NULL THEN translated_by WHEN n + 1 >= 3 THEN 'unsupported:no-en' ELSE 'wait:en:' || CAST(n + 1 AS VARCHAR) END AS next FROM (
  SELECT article_id, translated_by, try_cast(nullif(regexp_extract(coalesce(translated_by, ''), '^wait:en:([0-9]+)$', 1), '') AS INT) AS n FROM (SELECT article_id, coalesce(translated_by, 'wait:en:' || CAST(article_id % 4 AS VARCHAR)) AS translated_by FROM articles))""")
def w09_bounded_wait(spark: SparkSession, d: str) -> DataFrame:
    by = F.coalesce("translated_by", F.concat(F.lit("wait:en:"), (F.col("article_id") % 4).cast("string")))
    n = F.regexp_extract(by, r"^wait:en:([0-9]+)$", 1).try_cast("int")
    nxt = F.when(n.isNull(), by).when(n + 1 >= 3, "unsupported:no-en").otherwise(F.concat(F.lit("wait:en:"), (n + 1).cast("string")))
    return articles(spark, d, "article_id", "translated_by").select("article_id", nxt.alias("next"))


@query("SELECT dump_ts AS tick, stream, count(*) AS n FROM gkg GROUP BY 1, 2")
def w01_tick_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg").groupBy(F.col("dump_ts").alias("tick"), "stream").agg(F.count(F.lit(1)).alias("n"))
