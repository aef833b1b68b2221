"""Stories: similarity, clustering, ranking, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.functions import time as D
from pressloom.functions import vector as V
from pressloom.operators import rank as R
from pressloom.operators import similarity as S
from pressloom.operators.cluster import leaders
from pressloom.plans.counts import frequencies, names
from pressloom.plans import story_sql as Y
from pressloom.plans.oracle import NOW, outlet
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles
from pressloom.plans.scans import ago, timed
from pressloom.settings import DEFAULT, RESTRICTED
from pressloom.storage import cut

Q, SQL, query = registry()


@query("SELECT article_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM articles WHERE embedding IS NOT NULL AND len(embedding) > 0")
def c01_norm(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "embedding").where("embedding is not null and size(embedding) > 0")
    return a.select("article_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("""SELECT article_id, round(list_dot_product(embedding, embedding_body) / nullif(sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(embedding_body, embedding_body)), 0), 4) AS cos
FROM (SELECT article_id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(embedding_body AS DOUBLE[]) AS embedding_body FROM articles WHERE embedding IS NOT NULL AND embedding_body IS NOT NULL)""")
def c02_cosine(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "embedding", "embedding_body").where("embedding is not null and embedding_body is not null")
    return a.select("article_id", F.round(V.cosine(F.col("embedding"), F.col("embedding_body")), 4).alias("cos"))


def newest(a: DataFrame) -> DataFrame:
    return a.withColumn("age_us", -F.unix_micros("fetched_at"))


def title_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = newest(timed(spark, d, "country", "embedding"))
    return leaders(rows, "country", ["age_us"], "embedding", S.fitted(rows, DEFAULT.same_title))


@query(Y.leaders("TRUE", "embedding", 0.95) + " SELECT article_id, leader FROM grouped")
def c04_title_groups(spark: SparkSession, d: str) -> DataFrame:
    return title_groups(spark, d)


def window(spark: SparkSession, d: str, *columns: str, hours: int = 336) -> DataFrame:
    return timed(spark, d, "importance", "country", *columns).where((F.col("importance") > DEFAULT.accepted_above) & (F.col("fetched_at") >= ago(hours)))


def body_groups(spark: SparkSession, d: str, hours: int = 336) -> DataFrame:
    rows = newest(window(spark, d, "embedding_body", hours=hours))
    return leaders(rows, "country", ["age_us"], "embedding_body", S.fitted(rows, DEFAULT.same_body, "embedding_body"))


@query(Y.bodies() + " SELECT article_id, leader FROM grouped")
def c05_stories(spark: SparkSession, d: str) -> DataFrame:
    return body_groups(spark, d)


_REUSE = Y.leaders("importance IS NULL", "embedding", 0.95) + """,
u AS (SELECT article_id, country, fetched_at, importance, scored_by, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM articles WHERE embedding IS NOT NULL) WHERE len(v) > 0 AND list_dot_product(v, v) > 0),
p AS (SELECT n.article_id, o.article_id AS old, o.importance, list_dot_product(n.u, o.u) AS cos FROM u n JOIN u o ON o.country = n.country AND n.article_id <> o.article_id
  WHERE n.article_id IN (SELECT leader FROM grouped) AND o.importance IS NOT NULL AND (o.scored_by IS NULL OR o.scored_by = 'llm') AND o.fetched_at <= n.fetched_at AND o.fetched_at >= n.fetched_at - INTERVAL 192 HOUR AND list_dot_product(n.u, o.u) >= 0.95 - 1e-7),
reuse AS (SELECT article_id AS leader, importance FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(cos, 5) DESC, old) AS r FROM p) WHERE r = 1)"""


def reused(spark: SparkSession, d: str) -> DataFrame:
    """article_id, leader, importance: the unjudged articles in groups of one title vector, with the verdict of the group's nearest judged article.

    The newest article stands for its group; a judged one counts if it is of the same country and at most eight days older. Country and
    day range are part of the join: pairs are only built inside a country.
    """
    a = timed(spark, d, "country", "importance", "scored_by", "embedding")
    s = S.fitted(a, DEFAULT.same_title)
    new = newest(a.where("importance is null"))
    groups = cut(leaders(new, "country", ["age_us"], "embedding", s))
    asked = a.join(groups.select(F.col("leader").alias("article_id")).distinct(), "article_id", "left_semi")
    old = a.where("importance is not null and (scored_by is null or scored_by = 'llm')")
    side = lambda x: S.vectors(x, s).withColumnRenamed("id", "rep")
    facts = lambda x: x.where("country is not null").select(F.col("article_id").alias("rep"), "country", "fetched_at", "importance")
    n, o = side(asked), side(old)
    met = S.probe(S.segment_index(n, s).join(facts(asked), "rep"), S.segment_index(o, s).join(facts(old), "rep"), s, groups=("country",))
    near = S.cosine_at_least(met, n, o, s)
    near = near.join(facts(asked).select(F.col("rep").alias("a"), F.col("fetched_at").alias("ta")), "a").join(facts(old).select(F.col("rep").alias("b"), F.col("fetched_at").alias("tb"), F.col("importance").alias("verdict")), "b")
    near = near.where((F.col("tb") <= F.col("ta")) & (F.col("tb") >= F.col("ta") - F.expr(f"interval {DEFAULT.reuse_hours} hours")))
    best = near.groupBy(F.col("a").alias("leader")).agg(F.max_by("verdict", F.struct(F.round("cos", 5), -F.col("b"))).alias("importance"))
    return groups.join(best, "leader", "left").select("article_id", "leader", "importance")


@query(_REUSE + " SELECT g.article_id, r.importance, 'dup' AS scored_by FROM grouped g JOIN reuse r USING (leader)")
def c06_verdict_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts copied to every article of a group."""
    return reused(spark, d).where("importance is not null").select("article_id", "importance", F.lit("dup").alias("scored_by"))


@query("""WITH u AS (SELECT article_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT article_id, CAST(embedding AS DOUBLE[]) AS v FROM articles WHERE embedding IS NOT NULL) WHERE len(v) > 0 AND list_dot_product(v, v) > 0),
p AS (SELECT a.article_id AS q, b.article_id AS other, round(list_dot_product(a.u, b.u), 4) AS cos FROM u a JOIN u b ON a.article_id <> b.article_id WHERE a.article_id % 50 = 0 AND list_dot_product(a.u, b.u) >= 0.90 - 1e-7)
SELECT q, other, cos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cos DESC, other) AS r FROM p) WHERE r <= 4""")
def c07_similar(spark: SparkSession, d: str) -> DataFrame:
    """Up to four similar articles of each query row (ids divisible by 50) among all rows."""
    a = articles(spark, d, "article_id", "embedding")
    s = S.fitted(a, DEFAULT.similar)
    rows = S.vectors(a, s).withColumnRenamed("id", "rep")
    asked = rows.where("rep % 50 = 0")
    near = S.cosine_at_least(S.probe(S.segment_index(asked, s), S.segment_index(rows, s), s), asked, rows, s)
    w = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    top = near.withColumn("cos", F.round("cos", 4)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= DEFAULT.similar_most)
    return top.select(F.col("a").alias("q"), F.col("b").alias("other"), "cos")


_BLEND = """b AS (SELECT article_id, list_transform(m, lambda x: x / nullif(sqrt(list_dot_product(m, m)), 0)) AS u FROM (SELECT article_id, CASE WHEN e IS NULL THEN f WHEN f IS NULL THEN e ELSE list_transform(list_zip(e, f), lambda z: (z[1] + z[2]) / 2) END AS m
FROM (SELECT article_id, CAST(embedding AS DOUBLE[]) AS e, CAST(embedding_body AS DOUBLE[]) AS f FROM articles) WHERE e IS NOT NULL OR f IS NOT NULL))"""


def blend(title: Column, body: Column) -> Column:
    """Mean of the vectors that are there, of unit length; null without a length."""
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    both = F.zip_with(title, body, lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    m = F.when(title.isNull(), wide(body)).when(body.isNull(), wide(title)).otherwise(both)
    return F.when(V.norm(m) > 0, F.transform(m, lambda x: x / V.norm(m)))


@query(f"WITH {_BLEND} SELECT article_id, round(u[1], 5) AS first, round(u[64], 5) AS last, round(list_sum(u), 4) AS total, round(sqrt(list_dot_product(u, u)), 4) AS norm FROM b WHERE u[1] IS NOT NULL")
def c09_blend(spark: SparkSession, d: str) -> DataFrame:
    """Title and body vector in one, checked by its ends, sum and length."""
    a = articles(spark, d, "article_id", "embedding", "embedding_body").select("article_id", blend(F.col("embedding"), F.col("embedding_body")).alias("u")).where("u is not null")
    u = F.col("u")
    return a.select("article_id", F.round(u[0], 5).alias("first"), F.round(F.get(u, F.lit(63)), 5).alias("last"), F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(V.norm(u), 4).alias("norm"))


@query("SELECT article_id, embedding_body IS NULL AS fallback, round(list_sum(CAST(coalesce(embedding_body, embedding) AS DOUBLE[])), 4) AS total FROM articles WHERE embedding_body IS NOT NULL OR embedding IS NOT NULL")
def c10_body_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The body vector, else the title's."""
    v = F.coalesce("embedding_body", "embedding")
    a = articles(spark, d, "article_id", "embedding", "embedding_body").where(v.isNotNull())
    return a.select("article_id", F.col("embedding_body").isNull().alias("fallback"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query(Y.bodies() + " SELECT g.leader, sha1(string_agg(DISTINCT a.url, chr(10) ORDER BY a.url) || chr(10)) AS key FROM grouped g JOIN articles a USING (article_id) GROUP BY g.leader")
def c11_story_key(spark: SparkSession, d: str) -> DataFrame:
    """sha1 over the story's sorted distinct urls. A story's urls are the key's own input."""
    joined = body_groups(spark, d).join(articles(spark, d, "article_id", "url"), "article_id")
    return joined.groupBy("leader").agg(F.sha1(F.concat(F.array_join(F.array_sort(F.collect_set("url")), "\n"), F.lit("\n"))).alias("key"))


@query("SELECT DISTINCT url FROM articles WHERE CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 10000 < 500")
def c14_control_stream(spark: SparkSession, d: str) -> DataFrame:
    """Five in a hundred urls, chosen by hash, go past the gate."""
    drawn = F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long")
    return articles(spark, d, "url").where(drawn % 10000 < 500).select("url").distinct()


def ranked(spark: SparkSession, d: str, hours: int = 336, groups: DataFrame | None = None) -> DataFrame:
    """country, leader, members, outlets, lex, cov, ent, weight, age, value, rank of each story of the window.

    A story is as old as its newest article by publication time; `value` is the weight damped by age. `groups`: its clusters, where the caller has them.
    """
    a = window(spark, d, "article_id", "url", "embedding_body", "embedding", "entities", "publish_date", hours=hours).withColumn("domain", T.outlet(F.col("url")))
    a = a.withColumn("pub", D.published(F.col("publish_date"), F.col("fetched_at"), F.col("now")))
    grouped = (groups or body_groups(spark, d, hours)).join(a, "article_id")
    n = names(spark, d).join(a.select("article_id"), "article_id", "left_semi")
    f = frequencies(n).select(F.col("country").alias("c"), F.col("name").alias("m"), "df")
    ent = n.join(f, F.col("country").eqNullSafe(F.col("c")) & (F.col("name") == F.col("m"))).groupBy("article_id").agg(F.least(F.lit(1.0), F.count_if(F.col("df") >= DEFAULT.prominent_at) / 4.0).alias("w"))
    rows = grouped.join(ent, "article_id", "left")
    story = rows.groupBy(F.coalesce("country", F.lit("")).alias("country"), "leader").agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct(F.when(F.col("domain") != "", F.col("domain"))).alias("outlets"),
        F.coalesce(F.max("w"), F.lit(0.0)).alias("ent"), F.min(D.age_days(F.col("pub"), F.col("now"))).alias("age"),
    )
    vector = F.coalesce("embedding_body", "embedding")
    nodes = a.join(story.select(F.col("leader").alias("article_id"), F.col("country").alias("g")), "article_id").where(vector.isNotNull()).select(F.col("g").alias("country"), F.col("article_id").alias("id"), vector.alias("vector"), "domain")
    lex = R.lexrank(nodes, "country")
    joined = story.join(lex.select("country", F.col("id").alias("leader"), "lex"), ["country", "leader"], "left")
    joined = joined.withColumn("lex", R.minmax(F.coalesce("lex", F.lit(0.0)), "country")).withColumn("cov", R.coverage(F.col("outlets")))
    weighted = joined.withColumn("weight", R.blended(F.col("lex"), F.col("cov"), F.col("ent")))
    weighted = weighted.withColumn("value", F.round(F.col("weight") * D.freshness(F.col("age")), 9))
    return weighted.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("value"), "leader")))


@query(Y.bodies() + f""" SELECT g.leader, count(*) AS members, count(DISTINCT nullif({outlet('url')}, '')) AS outlets,
  round(CASE WHEN count(DISTINCT nullif({outlet('url')}, '')) <= 1 THEN 0 ELSE least(1.0, ln(count(DISTINCT nullif({outlet('url')}, ''))) / ln(12)) END, 6) AS cov FROM grouped g JOIN articles a USING (article_id) GROUP BY g.leader""")
def r01_coverage(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "url").withColumn("domain", T.outlet(F.col("url")))
    g = body_groups(spark, d).join(a, "article_id").groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.count_distinct(F.when(F.col("domain") != "", F.col("domain"))).alias("outlets"))
    return g.select("leader", "members", "outlets", F.round(R.coverage(F.col("outlets")), 6).alias("cov"))


@query(Y.ranked() + " SELECT country, leader, round(x, 6) AS lex FROM raw WHERE x > 0")
def r02_lexrank(spark: SparkSession, d: str) -> DataFrame:
    """Stationary weight of each story in the similarity graph of its country, before scaling."""
    a = window(spark, d, "article_id", "url", "embedding_body", "embedding").withColumn("domain", T.outlet(F.col("url")))
    led = body_groups(spark, d).select(F.col("leader").alias("article_id")).distinct()
    vector = F.coalesce("embedding_body", "embedding")
    nodes = a.join(led, "article_id").where(vector.isNotNull()).select(F.coalesce("country", F.lit("")).alias("country"), F.col("article_id").alias("id"), vector.alias("vector"), "domain")
    return R.lexrank(nodes, "country").select("country", F.col("id").alias("leader"), F.round("lex", 6).alias("lex"))


_STARS = "WITH s AS (SELECT article_id, country, importance * 1.0 AS x, length(coalesce(text, '')) * 1.0 AS y FROM articles WHERE importance IS NOT NULL), m AS (SELECT *, max(x) OVER p AS hi, min(x) OVER p AS lo FROM s WINDOW p AS (PARTITION BY country))"


@query(_STARS + " SELECT article_id, round(CASE WHEN hi - lo <= 1e-12 THEN 0.5 ELSE (x - lo) / (hi - lo) END, 6) AS scaled FROM m")
def r03_minmax(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "country", "importance").where("importance is not null")
    return a.select("article_id", F.round(R.minmax(F.col("importance").cast("double"), "country"), 6).alias("scaled"))


@query(_STARS + " SELECT article_id, round((0.5 * x / 100 + 0.35 * least(1.0, y / 6000) + 0.15 * (article_id % 5) / 4.0) / 1.0, 6) AS blended FROM s")
def r04_blend(spark: SparkSession, d: str) -> DataFrame:
    """Three factors by their weights."""
    a = articles(spark, d, "article_id", "importance", "text").where("importance is not null")
    size = F.least(F.lit(1.0), F.length(F.coalesce("text", F.lit(""))) / 6000.0)
    return a.select("article_id", F.round(R.blended(F.col("importance") / 100.0, size, F.col("article_id") % 5 / 4.0), 6).alias("blended"))


@query(Y.ranked() + " SELECT country, leader, round(lex, 5) AS lex, round(cov, 6) AS cov, round(ent, 6) AS ent, round(weight, 5) AS weight FROM ranked")
def r07_structural(spark: SparkSession, d: str) -> DataFrame:
    """Centrality (r02, scaled by r03), coverage (r01) and names (a03) blended (r04) for each story."""
    return ranked(spark, d).select("country", "leader", F.round("lex", 5).alias("lex"), F.round("cov", 6).alias("cov"), F.round("ent", 6).alias("ent"), F.round("weight", 5).alias("weight"))


@query(Y.ranked() + " SELECT country, leader, members, outlets, round(weight, 5) AS weight, round(age, 6) AS age, rank FROM ranked")
def r08_ranked_stories(spark: SparkSession, d: str) -> DataFrame:
    """Stories by weight times freshness; the age is that of the newest article."""
    return ranked(spark, d).select("country", "leader", "members", "outlets", F.round("weight", 5).alias("weight"), F.round("age", 6).alias("age"), "rank")


_REP = Y.is_open("url")


@query(Y.bodies() + f""" SELECT leader, article_id FROM (SELECT g.leader, a.article_id, {_REP} AS open, row_number() OVER (PARTITION BY g.leader ORDER BY {_REP} DESC, a.fetched_at DESC, a.article_id) AS r
FROM grouped g JOIN articles a USING (article_id)) WHERE r = 1 AND open""")
def r09_representative(spark: SparkSession, d: str) -> DataFrame:
    """The newest article that readers may open; a story without one is left out."""
    a = articles(spark, d, "article_id", "url", "fetched_at")
    open_ = ~T.in_domains(T.outlet(F.col("url")), RESTRICTED)
    j = body_groups(spark, d).join(a, "article_id").withColumn("open", open_)
    return j.groupBy("leader").agg(F.max_by(F.struct("article_id", "open"), F.struct("open", "fetched_at", -F.col("article_id"))).alias("w")).where("w.open").select("leader", "w.article_id")


@query(Y.bodies() + f""", reach AS (SELECT {outlet('url')} AS domain, count(*) AS n FROM articles GROUP BY 1),
one AS (SELECT g.leader, {outlet('a.url')} AS domain, a.article_id, length(coalesce(a.text, '')) AS n, row_number() OVER (PARTITION BY g.leader, {outlet('a.url')} ORDER BY a.fetched_at DESC, a.article_id) AS r FROM grouped g JOIN articles a USING (article_id))
SELECT o.leader, o.domain, o.article_id, round(0.62 * least(1.0, ln(1 + o.n) / ln(6001)) + 0.38 * least(1.0, ln(1 + reach.n) / ln(301)), 6) AS place FROM one o JOIN reach USING (domain) WHERE r = 1 AND domain <> ''""")
def r11_sources(spark: SparkSession, d: str) -> DataFrame:
    """One source of a story for each outlet, with its place by detail and reach."""
    a = articles(spark, d, "article_id", "url", "fetched_at", "text").withColumn("domain", T.outlet(F.col("url")))
    reach = a.groupBy("domain").agg(F.count(F.lit(1)).alias("reach"))
    j = body_groups(spark, d).join(a, "article_id").where("domain <> ''")
    one = j.groupBy("leader", "domain").agg(F.max_by(F.struct("article_id", F.length(F.coalesce("text", F.lit(""))).alias("n")), F.struct("fetched_at", -F.col("article_id"))).alias("w"))
    place = 0.62 * F.least(F.lit(1.0), F.log1p("w.n") / F.log1p(F.lit(6000.0))) + 0.38 * F.least(F.lit(1.0), F.log1p("reach") / F.log1p(F.lit(300.0)))
    return one.join(reach, "domain").select("leader", "domain", "w.article_id", F.round(place, 6).alias("place"))


@query(Y.ranked() + " SELECT country, leader, outlets, round(value, 5) AS score FROM ranked ORDER BY value DESC, outlets DESC, leader LIMIT 100")
def r15_top_stories(spark: SparkSession, d: str) -> DataFrame:
    """The hundred stories of highest rank over all countries."""
    return ranked(spark, d).orderBy(F.desc("value"), F.desc("outlets"), "leader").limit(DEFAULT.top).select("country", "leader", "outlets", F.round("value", 5).alias("score"))
