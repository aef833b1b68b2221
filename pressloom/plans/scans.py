"""Scans, work queues and batch writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.operators import journal as J
from pressloom.plans.oracle import NOW, outlet
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles, now
from pressloom.sources.tables import table

Q, SQL, query = registry()


def timed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """articles with fetched_at as an instant and the latest fetch time beside it."""
    a = articles(spark, d, *dict.fromkeys(("article_id", "fetched_at", *columns))).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return a.crossJoin(now(a))


def ago(hours: int) -> object:
    return F.col("now") - F.expr(f"interval {hours} hours")


@query(f"SELECT article_id, country FROM articles WHERE importance > 5 AND fetched_at >= {NOW} - INTERVAL 336 HOUR")
def s06_window(spark: SparkSession, d: str) -> DataFrame:
    return timed(spark, d, "country", "importance").where((F.col("importance") > 5) & (F.col("fetched_at") >= ago(336))).select("article_id", "country")


@query("""SELECT article_id, CASE WHEN starts_with(lower(language), 'ru') THEN text ELSE text_ru END AS doc_text, CASE WHEN starts_with(lower(language), 'ru') THEN title ELSE title_ru END AS doc_title
FROM articles WHERE coalesce(text_ru, '') <> '' OR starts_with(lower(language), 'ru')""")
def s07_archive_docs(spark: SparkSession, d: str) -> DataFrame:
    own = F.lower("language").startswith("ru")
    a = articles(spark, d, "article_id", "language", "title", "text", "title_ru", "text_ru").where((F.coalesce("text_ru", F.lit("")) != "") | own)
    return a.select("article_id", F.when(own, F.col("text")).otherwise(F.col("text_ru")).alias("doc_text"), F.when(own, F.col("title")).otherwise(F.col("title_ru")).alias("doc_title"))


@query("SELECT country, article_id, row_number() OVER (PARTITION BY country ORDER BY fetched_at DESC NULLS LAST, article_id) AS place FROM articles WHERE importance IS NULL")
def s08_unjudged(spark: SparkSession, d: str) -> DataFrame:
    """The unjudged articles of each country, the newest first; places are ranks within day and country, shifted by the days' totals."""
    a = articles(spark, d, "country", "article_id", "importance", "fetched_at").where("importance is null").withColumn("day", F.to_date("fetched_at"))
    per = a.groupBy("country", "day").agg(F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy("country").orderBy(F.desc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("country").alias("c"), F.col("day").alias("t"), F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    r = F.row_number().over(Window.partitionBy("country", "day").orderBy(F.desc("fetched_at"), "article_id"))
    return a.withColumn("r", r).join(per, F.col("country").eqNullSafe(F.col("c")) & F.col("day").eqNullSafe(F.col("t"))).select("country", "article_id", (F.col("before") + F.col("r")).alias("place"))


@query("""WITH q AS (SELECT article_id, fetched_at FROM articles WHERE importance > 5 AND embedding_body IS NULL AND text IS NOT NULL)
SELECT article_id, greatest(0, (SELECT count(*) FROM q) - 4000) AS remaining FROM (SELECT article_id FROM q ORDER BY fetched_at DESC, article_id LIMIT 4000)""")
def s09_body_queue(spark: SparkSession, d: str) -> DataFrame:
    """The bodies to embed next, and how many wait beyond them."""
    a = articles(spark, d, "article_id", "fetched_at", "importance", "embedding_body", "text").where("importance > 5 and embedding_body is null and text is not null")
    left = F.broadcast(a.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - 4000).alias("remaining")))
    return a.orderBy(F.desc("fetched_at"), "article_id").limit(4000).select("article_id").crossJoin(left)


_QUOTA = 150


@query(f"""WITH fresh AS (SELECT article_id FROM articles WHERE importance > 5 AND fetched_at >= {NOW} - INTERVAL 336 HOUR AND (title IS NOT NULL OR text IS NOT NULL) AND (translated_by IS NULL OR starts_with(translated_by, 'wait:') OR starts_with(translated_by, 'unsupported:')) AND title_ru IS NULL ORDER BY importance DESC, fetched_at DESC, article_id LIMIT {_QUOTA}),
redo AS (SELECT article_id FROM articles WHERE fetched_at >= {NOW} - INTERVAL 168 HOUR AND translated_by IS NOT NULL AND NOT contains(translated_by, 'tcbig') AND translated_by <> 'error' AND NOT starts_with(translated_by, 'skip:') AND NOT starts_with(translated_by, 'unsupported:') AND NOT starts_with(translated_by, 'wait:') ORDER BY importance DESC NULLS LAST, article_id LIMIT {_QUOTA // 4})
SELECT article_id, 'fresh' AS kind FROM fresh UNION ALL SELECT article_id, 'redo' FROM redo""")
def s10_translation_queue(spark: SparkSession, d: str) -> DataFrame:
    """Untranslated articles of the archive by importance, and a quarter of their quota for translations by engines no longer trusted."""
    a = timed(spark, d, "importance", "title", "text", "title_ru", "translated_by")
    by = F.col("translated_by")
    fresh = a.where("importance > 5 and title_ru is null and (title is not null or text is not null)").where((F.col("fetched_at") >= ago(336)) & (by.isNull() | by.startswith("wait:") | by.startswith("unsupported:")))
    redo = a.where((F.col("fetched_at") >= ago(168)) & by.isNotNull() & ~by.contains("tcbig") & (by != "error") & ~by.rlike("^(skip|unsupported|wait):"))
    fresh = fresh.orderBy(F.desc("importance"), F.desc("fetched_at"), "article_id").limit(_QUOTA)
    redo = redo.orderBy(F.desc_nulls_last("importance"), "article_id").limit(_QUOTA // 4)
    return fresh.select("article_id", F.lit("fresh").alias("kind")).unionByName(redo.select("article_id", F.lit("redo").alias("kind")))


@query("SELECT s.url, s.verdict, s.attempts FROM seen_urls s WHERE s.url IN (SELECT url FROM articles)")
def s11_multi_get(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seen_urls", "url", "verdict", "attempts").join(articles(spark, d, "url"), "url", "left_semi")


@query("SELECT url, min(article_id) AS article_id FROM articles GROUP BY url")
def k01_insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """The first writer of each url stays: the later half of the articles is anti-joined against the earlier one."""
    a = articles(spark, d, "url", "article_id")
    halves = a.crossJoin(F.broadcast(a.agg(F.avg("article_id").alias("middle")))).withColumn("later", F.col("article_id") > F.col("middle"))
    stored = J.insert_or_ignore(a.where("false"), halves.where("not later").select("url", "article_id"), "url", "article_id")
    return J.insert_or_ignore(stored, halves.where("later").select("url", "article_id"), "url", "article_id")


@query("""WITH n AS (SELECT url, max(CAST(dump_ts AS DATE)) AS day, count(*) AS n, arg_max(stream, gkg_id) AS stream FROM gkg GROUP BY url)
SELECT coalesce(s.url, n.url) AS url, coalesce(s.first_seen, CAST(n.day AS VARCHAR)) AS first_seen, CASE WHEN n.url IS NULL THEN s.last_seen ELSE CAST(n.day AS VARCHAR) END AS last_seen,
  CASE WHEN n.url IS NULL THEN s.verdict ELSE CASE WHEN n.stream = 'en' THEN 'accepted' ELSE 'short' END END AS verdict, coalesce(s.attempts, 0) + coalesce(n.n, 0) AS attempts FROM seen_urls s FULL JOIN n ON n.url = s.url""")
def k02_verdict_upsert(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gkg", "url", "dump_ts", "stream", "gkg_id")
    new = g.groupBy("url").agg(F.max(F.to_date("dump_ts")).cast("string").alias("day"), F.count(F.lit(1)).alias("n"), F.max_by("stream", "gkg_id").alias("stream"))
    new = new.select("url", "day", "n", F.when(F.col("stream") == "en", "accepted").otherwise("short").alias("verdict"), F.lit(None).cast("array<float>").alias("embedding"))
    return J.upsert(table(spark, d, "seen_urls"), new).select("url", "first_seen", "last_seen", "verdict", "attempts")


@query("SELECT 'gkg_cursor' AS key, strftime(max(dump_ts), '%Y%m%d%H%M%S') AS value FROM gkg")
def k03_cursor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg").agg(F.date_format(F.max("dump_ts"), "yyyyMMddHHmmss").alias("value")).select(F.lit("gkg_cursor").alias("key"), "value")


@query("""WITH s AS (SELECT title_hash, max(importance) AS score FROM articles WHERE importance IS NOT NULL AND title_hash IS NOT NULL GROUP BY title_hash)
SELECT a.article_id, coalesce(a.importance, s.score) AS importance, CASE WHEN a.importance IS NULL AND s.score IS NOT NULL THEN 'dup' ELSE a.scored_by END AS scored_by FROM articles a LEFT JOIN s ON s.title_hash = a.title_hash""")
def k04_propagate(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "title_hash", "importance", "scored_by")
    s = a.where("importance is not null and title_hash is not null").groupBy("title_hash").agg(F.max("importance").alias("score"))
    return a.join(s, "title_hash", "left").select("article_id", F.coalesce("importance", "score").alias("importance"), F.when(F.col("importance").isNull() & F.col("score").isNotNull(), "dup").otherwise(F.col("scored_by")).alias("scored_by"))


@query(f"SELECT article_id FROM articles WHERE fetched_at >= {NOW} - INTERVAL 360 HOUR")
def k05_retention(spark: SparkSession, d: str) -> DataFrame:
    return timed(spark, d).where(F.col("fetched_at") >= ago(360)).select("article_id")


@query(f"SELECT url FROM seen_urls WHERE embedding IS NOT NULL OR CAST(last_seen AS DATE) >= CAST({NOW} AS DATE) - 30")
def k06_journal_retention(spark: SparkSession, d: str) -> DataFrame:
    n = now(articles(spark, d, "fetched_at"))
    return table(spark, d, "seen_urls").crossJoin(n).where(F.col("embedding").isNotNull() | (F.to_date("last_seen") >= F.date_sub(F.to_date("now"), 30))).select("url")


_MAP = f"um AS (SELECT url, substr(sha1(coalesce(first_seen, '')), 1, 12) AS key FROM seen_urls), live AS (SELECT url FROM articles WHERE fetched_at >= {NOW} - INTERVAL 360 HOUR)"


@query(f"WITH {_MAP} SELECT 'url' AS kind, url AS gone FROM um WHERE url NOT IN (SELECT url FROM live) UNION ALL SELECT DISTINCT 'key', key FROM um WHERE key NOT IN (SELECT key FROM um WHERE url IN (SELECT url FROM live))")
def k07_orphans(spark: SparkSession, d: str) -> DataFrame:
    """What a sweep removes: mapped urls whose article is gone, then overviews without any mapped url left. Journal days stand in for overviews."""
    live = timed(spark, d, "url").where(F.col("fetched_at") >= ago(360)).select("url")
    mapped = table(spark, d, "seen_urls", "url", "first_seen").select("url", F.substring(F.sha1(F.coalesce("first_seen", F.lit(""))), 1, 12).alias("key"))
    urls, keys = J.orphans(mapped, mapped.select("key").distinct(), live)
    return urls.select(F.lit("url").alias("kind"), F.col("url").alias("gone")).unionByName(keys.select(F.lit("key").alias("kind"), F.col("key").alias("gone")))


@query("SELECT url, arg_max(article_id, CAST(batch_no AS BIGINT) * 1000000000 + article_id) AS article_id FROM articles GROUP BY url")
def k11_last_writer(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "url", "article_id", "batch_no").groupBy("url").agg(F.max_by("article_id", F.struct("batch_no", "article_id")).alias("article_id"))


@query("SELECT name, ru, src FROM entity_ru WHERE src IS NOT NULL AND coalesce(ru, '') <> ''")
def k12_name_cache(spark: SparkSession, d: str) -> DataFrame:
    """Failed lookups are not kept."""
    return table(spark, d, "entity_ru").where("src is not null and coalesce(ru, '') <> ''").select("name", "ru", "src")


@query("SELECT url, CAST(NULL AS VARCHAR) AS added, verdict FROM seen_urls")
def k13_migrate(spark: SparkSession, d: str) -> DataFrame:
    return J.migrated(table(spark, d, "seen_urls", "url", "verdict"), {"added": "string"}).select("url", "added", "verdict")


@query(f"SELECT {outlet('url')} AS outlet, count(*) AS articles, count(DISTINCT country) AS countries FROM articles GROUP BY 1")
def s00_outlets(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "url", "country").groupBy(T.outlet(F.col("url")).alias("outlet")).agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("country").alias("countries"))
