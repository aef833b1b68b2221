"""Picks, batches, feeds and page forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import pages as H
from pressloom.operators import select as O
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles

Q, SQL, query = registry()


@query("""WITH RECURSIVE a AS (SELECT country, article_id AS id, CAST(importance AS DOUBLE) AS imp, CAST(embedding AS DOUBLE[]) AS v FROM articles WHERE country IS NOT NULL AND importance > 5 AND embedding IS NOT NULL),
m AS (SELECT *, CASE WHEN max(imp) OVER p - min(imp) OVER p > 1e-9 THEN (imp - min(imp) OVER p) / (max(imp) OVER p - min(imp) OVER p) ELSE 0.5 END AS rel FROM a WINDOW p AS (PARTITION BY country)),
pool AS MATERIALIZED (SELECT country, list({'id': id, 'v': v, 'rel': rel} ORDER BY id) AS rows FROM m GROUP BY country),
step AS (SELECT country, -1 AS k, CAST(NULL AS BIGINT) AS id, CAST([] AS DOUBLE[][]) AS picked, CAST([] AS BIGINT[]) AS gone FROM pool UNION ALL
  SELECT country, k + 1, best.id, list_append(picked, best.v), list_append(gone, best.id) FROM (
    SELECT s.country, s.k, s.picked, s.gone, list_reduce(list_filter(p.rows, lambda r: NOT list_contains(s.gone, r.id)), lambda x, y: CASE WHEN
      round(0.7 * y.rel - 0.3 * greatest(0.0, coalesce(list_max(list_transform(s.picked, lambda q: list_dot_product(q, y.v) / nullif(sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(y.v, y.v)), 0))), 0.0)), 9) >
      round(0.7 * x.rel - 0.3 * greatest(0.0, coalesce(list_max(list_transform(s.picked, lambda q: list_dot_product(q, x.v) / nullif(sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(x.v, x.v)), 0))), 0.0)), 9) THEN y ELSE x END) AS best
    FROM step s JOIN pool p USING (country) WHERE s.k < 4 AND len(s.gone) < len(p.rows)))
SELECT country, k, id FROM step WHERE k >= 0""")
def c08_varied(spark: SparkSession, d: str) -> DataFrame:
    """Five varied articles of each country."""
    a = articles(spark, d, "country", "article_id", "importance", "embedding").where("country is not null and importance > 5 and embedding is not null")
    return O.varied(a.select("country", F.col("article_id").alias("id"), F.col("importance").cast("double").alias("importance"), F.col("embedding").alias("vector")), "country")


@query("SELECT article_id, CAST(ceil(n / 20.0) AS BIGINT) AS batch, CAST((n - 1) % 20 + 1 AS INT) AS place FROM (SELECT article_id, row_number() OVER (ORDER BY fetched_at, article_id) AS n FROM articles WHERE importance IS NULL AND fetched_at IS NOT NULL)")
def x04_judge_batches(spark: SparkSession, d: str) -> DataFrame:
    """Unjudged articles of all countries in batches of twenty."""
    return O.numbered_batches(articles(spark, d, "article_id", "fetched_at", "importance").where("importance is null and fetched_at is not null"), "fetched_at", "article_id").select("article_id", "batch", "place")


@query("""WITH RECURSIVE t AS (SELECT article_id, replace(coalesce(text, ''), chr(10), ' ') AS t FROM articles),
p AS MATERIALIZED (SELECT article_id, t, list_transform(string_split(t, ''), lambda c: CASE WHEN regexp_matches(c, '[A-Za-z0-9_.~/-]') THEN 1 ELSE 3 * strlen(c) END) AS size FROM t),
f AS (SELECT article_id, t, list_reduce(list_transform(size, lambda x: [CAST(x AS BIGINT)]), lambda acc, x, i: CASE WHEN acc[1] + x[1] > 1500 AND acc[1] > 0 THEN list_append(list_concat([x[1]], acc[2:]), CAST(i AS BIGINT)) ELSE list_concat([acc[1] + x[1]], acc[2:]) END, [CAST(0 AS BIGINT)])[2:] AS cuts FROM p WHERE len(t) > 0),
g AS (SELECT article_id, t, list_concat([1], cuts) AS a, list_append(cuts, CAST(length(t) + 1 AS BIGINT)) AS b FROM f)
SELECT article_id, CAST(k AS INT) AS k, substr(t, s, e - s) AS chunk FROM (SELECT article_id, t, unnest(a) AS s, unnest(b) AS e, unnest(range(0, len(a))) AS k FROM g) UNION ALL SELECT article_id, 0, '' FROM t WHERE t = ''""")
def t21_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each text for a translator that takes 1500 quoted bytes, cut by character."""
    return articles(spark, d, "article_id", "text").select("article_id", F.posexplode(H.quoted_chunks(F.col("text"))).alias("k", "chunk"))
