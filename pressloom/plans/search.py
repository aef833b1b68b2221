"""The interactive layer: filters, pages, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.plans.oracle import NAMES, outlet
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles
from pressloom.sources.tables import table

Q, SQL, query = registry()

_HAY = f"lower(concat_ws(' ', coalesce(title, ''), coalesce(country, ''), {outlet('url')}, coalesce(entities, '')))"


def haystack(a: DataFrame) -> DataFrame:
    parts = (F.coalesce("title", F.lit("")), F.coalesce("country", F.lit("")), T.outlet(F.col("url")), F.coalesce("entities", F.lit("")))
    return a.withColumn("hay", F.lower(F.concat_ws(" ", *parts)))


@query(f"SELECT article_id FROM articles WHERE contains({_HAY}, 'university')")
def q01_text(spark: SparkSession, d: str) -> DataFrame:
    return haystack(articles(spark, d, "article_id", "title", "country", "url", "entities")).where(F.col("hay").contains("university")).select("article_id")


@query(f"""WITH f AS (SELECT article_id, fetched_at FROM articles WHERE language = 'en' AND CAST(fetched_at AS DATE) >= DATE '2024-01-10' AND contains({_HAY}, 'agency'))
SELECT article_id, (SELECT count(*) FROM f) AS total FROM (SELECT article_id FROM f ORDER BY fetched_at DESC, article_id LIMIT 60)""")
def q02_filters(spark: SparkSession, d: str) -> DataFrame:
    f = haystack(articles(spark, d, "article_id", "title", "country", "url", "entities", "language", "fetched_at")).where("language = 'en' and to_date(fetched_at) >= date'2024-01-10'").where(F.col("hay").contains("agency"))
    total = F.broadcast(f.agg(F.count(F.lit(1)).alias("total")))
    return f.orderBy(F.desc("fetched_at"), "article_id").limit(60).select("article_id").crossJoin(total)


@query("SELECT a.article_id FROM articles a JOIN countries c ON c.country = a.country WHERE c.region_name = 'old_basin'")
def q03_scope(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "countries").where("region_name = 'old_basin'").select("country")
    return articles(spark, d, "article_id", "country").join(F.broadcast(region), "country", "left_semi").select("article_id")


@query("""WITH b AS (SELECT slug, CAST(row_number() OVER (ORDER BY slug) - 1 AS INT) AS i FROM subjects),
m AS (SELECT article_id, CAST(bit_or(1 << i) AS INT) AS mask FROM (SELECT DISTINCT article_id, slug FROM subject_labels) l JOIN b USING (slug) GROUP BY article_id)
SELECT article_id FROM m WHERE (mask & 5) <> 0""")
def q04_topic_mask(spark: SparkSession, d: str) -> DataFrame:
    from pressloom.plans.counts import a10_topic_mask

    return a10_topic_mask(spark, d).where(F.col("mask").bitwiseAND(5) != 0).select("article_id")


@query("SELECT article_id FROM articles WHERE CAST(fetched_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def q05_days(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "fetched_at").where("to_date(fetched_at) between date'2024-01-05' and date'2024-01-09'").select("article_id")


@query("""WITH r AS (SELECT country, article_id, row_number() OVER (PARTITION BY country ORDER BY fetched_at DESC, article_id) AS n, count(*) OVER (PARTITION BY country) AS total FROM articles WHERE country IS NOT NULL)
SELECT country, article_id, n, total FROM r WHERE n BETWEEN 21 AND 40""")
def q06_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 20 in each country. Counts are joined, so the ranking keeps its early cut."""
    a = articles(spark, d, "country", "article_id", "fetched_at").where("country is not null")
    total = F.broadcast(a.groupBy("country").agg(F.count(F.lit(1)).alias("total")))
    w = Window.partitionBy("country").orderBy(F.desc("fetched_at"), "article_id")
    return a.withColumn("n", F.row_number().over(w)).where("n <= 40").where("n >= 21").join(total, "country").select("country", "article_id", "n", "total")


@query("SELECT DISTINCT g.url FROM gkg g WHERE g.url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.url = g.url)")
def q07_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg", "url").where("url is not null").distinct().join(articles(spark, d, "url"), "url", "left_anti")


@query(f"WITH {NAMES}, c AS (SELECT name, count(*) AS n FROM names GROUP BY name) SELECT name, n FROM c WHERE contains(name, 'inst') AND name <> 'inst' ORDER BY n DESC, name LIMIT 8")
def q09_suggest(spark: SparkSession, d: str) -> DataFrame:
    from pressloom.plans.counts import names

    c = names(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return c.where(F.col("name").contains("inst") & (F.col("name") != "inst")).orderBy(F.desc("n"), "name").limit(8)


@query("""SELECT region, country, n, CAST(top >= 30 AS INT) + CAST(top >= 50 AS INT) + CAST(top >= 70 AS INT) + CAST(top >= 85 AS INT) AS tier FROM (
  SELECT c.region_name AS region, a.country, count(*) AS n, max(a.importance) AS top FROM articles a JOIN countries c ON c.country = a.country WHERE a.importance > 5 GROUP BY 1, 2)""")
def q12_atlas(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "country", "importance").where("importance > 5").join(F.broadcast(table(spark, d, "countries", "country", "region_name")), "country")
    return a.groupBy(F.col("region_name").alias("region"), "country").agg(F.count(F.lit(1)).alias("n"), F.max("importance").alias("top")).select("region", "country", "n", T.tier(F.col("top")).alias("tier"))
