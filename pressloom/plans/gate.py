"""The relevance gate's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.operators import gate as G
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles

Q, SQL, query = registry()
_SET = "importance IS NOT NULL AND embedding IS NOT NULL AND (scored_by IS NULL OR scored_by = 'llm')"
_TEXT = "coalesce(title, '') || ' ' || chr(10) || ' ' || substr(coalesce(text, ''), 1, 3000)"


def judged(spark: SparkSession, d: str, chars: int | None = None) -> DataFrame:
    return G.training_set(articles(spark, d), chars)


@query(f"SELECT article_id, CAST(importance > 5 AS INT) AS y, {_TEXT} AS text FROM articles WHERE {_SET}")
def m01_training_set(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d, 3000).select("article_id", "y", "text")


@query(f"SELECT count(*) AS n, least(sum(y), count(*) - sum(y)) AS minority, (count(*) < 3000 OR least(sum(y), count(*) - sum(y)) < 500) AS refused FROM (SELECT CAST(importance > 5 AS INT) AS y FROM articles WHERE {_SET})")
def m02_enough(spark: SparkSession, d: str) -> DataFrame:
    least = F.least(F.sum("y"), F.count(F.lit(1)) - F.sum("y"))
    return judged(spark, d).agg(F.count(F.lit(1)).alias("n"), least.alias("minority")).withColumn("refused", (F.col("n") < 3000) | (F.col("minority") < 500))


@query()
def m03_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of the text and vector classifiers, over whole texts."""
    return G.probabilities(judged(spark, d)).select("article_id", "y", F.round("p_vec", 6).alias("p_vec"), F.round("p_txt", 6).alias("p_txt"))


@query(f"SELECT article_id, y, ntile(5) OVER (PARTITION BY y ORDER BY fetched_at, article_id) AS fold FROM (SELECT *, CAST(importance > 5 AS INT) AS y FROM articles WHERE {_SET})")
def m04_folds(spark: SparkSession, d: str) -> DataFrame:
    return G.folds(judged(spark, d)).select("article_id", "y", "fold")


def probe(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in scores with a fixed formula, so that thresholds have exact SQL."""
    length = F.length(F.coalesce("text", F.lit("")))
    a = articles(spark, d, "article_id", "importance", "text").where("importance is not null")
    return a.select("article_id", (F.col("importance") > 5).cast("int").alias("y"), ((length % 101) / 101.0 + F.col("importance") / 200.0).alias("p_vec"), ((length % 37) / 37.0 + F.col("importance") / 300.0).alias("p_txt"))


_PROBE = """probe AS (SELECT article_id, CAST(importance > 5 AS INT) AS y, (length(coalesce(text, '')) % 101) / 101.0 + importance / 200.0 AS p_vec, (length(coalesce(text, '')) % 37) / 37.0 + importance / 300.0 AS p_txt FROM articles WHERE importance IS NOT NULL),
z AS (SELECT article_id, y, p_vec, p_txt, (p_vec - avg(p_vec) OVER ()) / stddev_pop(p_vec) OVER () + (p_txt - avg(p_txt) OVER ()) / stddev_pop(p_txt) OVER () AS z FROM probe),
s AS (SELECT article_id, y, round(CAST(z AS DOUBLE), 8) AS z FROM z)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return G.combined(probe(spark, d)).withColumn("z", F.round("z", 8))


@query(f"WITH {_PROBE} SELECT article_id, round(z, 5) AS z FROM s")
def m05_combined(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("article_id", F.round("z", 5).alias("z"))


_BOUNDS = f"""{_PROBE}, lo AS (SELECT quantile_cont(z, 0.05) AS lo FROM s WHERE y = 1), per AS (SELECT z AS v, sum(y) AS p, count(*) AS n FROM s GROUP BY z),
run AS (SELECT v, sum(p) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS pr FROM per WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)),
hi AS (SELECT min(v) FILTER (WHERE pr >= 0.90) AS hi, max(v) AS top FROM run),
b AS (SELECT lo, CASE WHEN hi IS NULL OR hi <= lo THEN top + 1 ELSE hi END AS hi FROM lo, hi)"""


@query(f"WITH {_BOUNDS} SELECT round(lo, 5) AS lo, round(hi, 5) AS hi FROM b")
def a14_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return G.thresholds(scored(spark, d)).select(F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"))


@query(f"WITH {_BOUNDS} SELECT article_id, CASE WHEN z < lo THEN 'drop' WHEN z > hi THEN 'keep' ELSE 'ask' END AS verdict FROM s, b")
def m06_verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return G.verdicts(s, G.thresholds(s)).select("article_id", "verdict")


@query(f"WITH {_BOUNDS} SELECT round(avg(CASE WHEN y = 1 THEN CAST(z >= lo AS INT) END), 6) AS recall, round(avg(CASE WHEN y = 0 THEN CAST(z < lo AS INT) END), 6) AS dropped, round(avg(CAST(z >= lo AND z <= hi AS INT)), 6) AS asked FROM s, b")
def a15_shares(spark: SparkSession, d: str) -> DataFrame:
    """Recall, share of negatives dropped (the guard of m07) and share left to the judge."""
    s = scored(spark, d)
    v = G.verdicts(s, G.thresholds(s))
    share = lambda y, kind: F.round(F.avg(F.when(F.col("y") == y, kind.cast("int"))), 6)
    drop = F.col("verdict") == "drop"
    return v.agg(share(1, ~drop).alias("recall"), share(0, drop).alias("dropped"), F.round(F.avg((F.col("verdict") == "ask").cast("int")), 6).alias("asked"))


@query(f"WITH {_PROBE}, r AS (SELECT y, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def a16_auc(spark: SparkSession, d: str) -> DataFrame:
    return G.auc(scored(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(f"WITH {_BOUNDS} SELECT round(avg(CASE WHEN y = 0 THEN CAST(z < lo AS INT) END), 6) AS dropped, coalesce(avg(CASE WHEN y = 0 THEN CAST(z < lo AS INT) END) >= 0.30, FALSE) AS saved FROM s, b")
def m07_saved(spark: SparkSession, d: str) -> DataFrame:
    """A gate is only kept if it drops enough of the negatives."""
    return G.saved(a15_shares(spark, d)).select("dropped", "saved")


@query("SELECT article_id, 'ask' AS verdict FROM articles WHERE importance IS NOT NULL")
def m07_gate_off(spark: SparkSession, d: str) -> DataFrame:
    """Without a kept gate everything is asked."""
    return G.gated(scored(spark, d), None).select("article_id", "verdict")
