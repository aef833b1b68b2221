"""Topic tagging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.operators import topics as P
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles
from pressloom.sources.tables import table

Q, SQL, query = registry()

_LISTS = " UNION ALL ".join(f"SELECT {i} AS ord, '{s}' AS slug, '({w})' AS rx" for i, (s, w) in enumerate(P.BUCKETS.items()))
_SCAN = f"""b AS ({_LISTS}), m AS (SELECT article_id, slug, ord, list_distinct(regexp_extract_all(lower(coalesce(title, '')), rx)) AS h, list_distinct(regexp_extract_all(lower(substr(coalesce(text, ''), 1, 700)), rx)) AS t FROM articles, b),
scan AS (SELECT article_id, slug, ord, len(h) AS head, len(list_filter(t, lambda x: NOT list_contains(h, x))) AS deep FROM m),
hit AS (SELECT *, (head > 0 OR deep >= 2) AS strict FROM scan WHERE head + deep > 0)"""


def scanned(spark: SparkSession, d: str) -> DataFrame:
    return P.scan(articles(spark, d, "article_id", "title", "text"))


@query(f"WITH {_SCAN} SELECT article_id, slug, head, deep, strict FROM hit")
def tp01_scan(spark: SparkSession, d: str) -> DataFrame:
    return scanned(spark, d).select("article_id", "slug", "head", "deep", "strict")


@query(f"WITH {_SCAN} SELECT article_id, string_agg(slug, ',' ORDER BY head = 0, -(head + deep), ord) AS topics FROM hit WHERE strict GROUP BY article_id")
def tp02_strict_order(spark: SparkSession, d: str) -> DataFrame:
    return P.of(articles(spark, d, "article_id"), scanned(spark, d).where("strict")).where("topics[0] <> 'other'").select("article_id", F.array_join("topics", ",").alias("topics"))


@query(f"""WITH {_SCAN}, s AS (SELECT article_id, string_agg(slug, ',' ORDER BY head = 0, -(head + deep), ord) AS t FROM hit WHERE strict GROUP BY article_id),
w AS (SELECT article_id, arg_min(slug, (100 - deep) * 100 + ord) AS t FROM hit WHERE NOT strict GROUP BY article_id)
SELECT a.article_id, coalesce(s.t, w.t, 'other') AS topics FROM articles a LEFT JOIN s USING (article_id) LEFT JOIN w USING (article_id)""")
def tp03_topics(spark: SparkSession, d: str) -> DataFrame:
    return P.of(articles(spark, d, "article_id"), scanned(spark, d)).select("article_id", F.array_join("topics", ",").alias("topics"))


def classes(spark: SparkSession, d: str) -> DataFrame:
    """The classifier learns from the strict finds of the word lists and answers for every article with a vector."""
    rows = articles(spark, d, "article_id", "embedding_body").where("embedding_body is not null").select("article_id", F.transform("embedding_body", lambda x: x.cast("double")).alias("vector"))
    labelled = scanned(spark, d).where("strict").select("article_id", "slug").join(rows, "article_id")
    return P.classified(labelled, rows, list(P.BUCKETS))


@query()
def tp05_classified(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).select("article_id", "slug", F.round("p", 5).alias("p"))


@query()
def tp04_refined(spark: SparkSession, d: str) -> DataFrame:
    """Strict topics, else the classifier's by probability, else `other`."""
    strict = scanned(spark, d).where("strict").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct((F.col("head") == 0).alias("a"), (-(F.col("head") + F.col("deep"))).alias("b"), "ord", "slug"))).alias("s"))
    model = classes(spark, d).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "slug"))).alias("m"))
    j = articles(spark, d, "article_id").join(strict, "article_id", "left").join(model, "article_id", "left")
    slugs = lambda c: F.array_join(F.transform(c, lambda x: x["slug"]), ",")
    return j.select("article_id", F.coalesce(slugs(F.col("s")), slugs(F.col("m")), F.lit("other")).alias("topics"))


@query(f"WITH {_SCAN}, r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY ord) AS r FROM hit WHERE strict) SELECT article_id, string_agg(slug, ',' ORDER BY ord) AS shown FROM r WHERE r <= 3 GROUP BY article_id")
def tp06_card_labels(spark: SparkSession, d: str) -> DataFrame:
    """At most three strict topics in list order; the remainder is hidden."""
    got = scanned(spark, d).where("strict").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("ord", "slug"))).alias("s"))
    return got.select("article_id", F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x["slug"]), ",").alias("shown"))
