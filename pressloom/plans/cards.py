"""Stories as readers see them: heads, titles, cards, feeds, roll-ups and the search index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions import pages as H
from pressloom.functions import text as T
from pressloom.functions import time as D
from pressloom.operators import select as O
from pressloom.plans import story_sql as Y
from pressloom.plans.counts import names
from pressloom.plans.oracle import NOW, outlet
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles
from pressloom.plans.scans import ago, timed
from pressloom.plans.stories import body_groups, ranked, window
from pressloom.settings import DEFAULT, RESTRICTED
from pressloom.sources.tables import table
from pressloom.storage import cut

Q, SQL, query = registry()


def readable() -> F.Column:
    """Is there a translation, or a language that needs none."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return some("title_ru") | some("title_en") | F.coalesce("language", F.lit("")).isin("ru", "en")


def members(spark: SparkSession, d: str, groups: DataFrame, *columns: str, hours: int = 336) -> DataFrame:
    """leader, domain, pub, open, readable beside the window's articles."""
    need = ("url", "title", "title_ru", "title_en", "language", "publish_date", *columns)
    a = window(spark, d, *dict.fromkeys(need), hours=hours).withColumn("domain", T.outlet(F.col("url")))
    a = a.withColumn("pub", D.published(F.col("publish_date"), F.col("fetched_at"), F.col("now"))).withColumn("open", ~T.in_domains(F.col("domain"), RESTRICTED))
    return groups.join(a.withColumn("readable", readable()), "article_id")


def newest_first() -> F.Column:
    """Members in the order of the site: readable ones, then the newest."""
    return F.struct("readable", "fetched_at", -F.col("article_id"))


@query(Y.members() + f""" SELECT leader, article_id AS head FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY open DESC, readable DESC, fetched_at DESC, article_id) AS r FROM mem) WHERE r = 1 AND open""")
def r10_site_head(spark: SparkSession, d: str) -> DataFrame:
    """The first article by (readable, fetched_at) that readers may open; a story without one is left out."""
    m = members(spark, d, body_groups(spark, d)).where("open")
    return m.groupBy("leader").agg(F.max_by("article_id", newest_first()).alias("head"))


@query(Y.members() + " SELECT leader, epoch_us(min(pub)) AS first_us, epoch_us(max(pub)) AS last_us, CAST(CAST(min(pub) AS DATE) AS VARCHAR) AS day, epoch_us(max(pub)) - epoch_us(min(pub)) >= 86400000000 AS updated FROM mem GROUP BY leader")
def d05_story_dates(spark: SparkSession, d: str) -> DataFrame:
    """A story is dated by its first article; it is marked as updated when the last one is a whole day later."""
    span = members(spark, d, body_groups(spark, d)).groupBy("leader").agg(F.min("pub").alias("first"), F.max("pub").alias("last"))
    us = lambda c: F.unix_micros(c)
    return span.select("leader", us("first").alias("first_us"), us("last").alias("last_us"), F.to_date("first").cast("string").alias("day"), (us("last") - us("first") >= 86_400_000_000).alias("updated"))


def titles(m: DataFrame) -> DataFrame:
    """leader, id, title: the best title of each story among those that can be shown."""
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    own = F.when(F.coalesce("language", F.lit("")).isin("ru", "en"), F.col("title"))
    shown = F.when(F.col("open"), F.coalesce(some("title_ru"), some("title_en"), own, F.lit(""))).otherwise("")
    vector = F.when(F.size("embedding") > 0, F.col("embedding"))
    rows = m.select("leader", F.col("article_id").alias("id"), T.clean_title(shown, F.col("domain")).alias("title"), vector.alias("vector"), F.struct("readable", "fetched_at").alias("order"))
    return O.best_title(cut(rows), "leader", "order")


@query(Y.members() + ", " + Y.titles() + " SELECT leader, id, t AS title FROM title")
def r12_story_title(spark: SparkSession, d: str) -> DataFrame:
    return titles(members(spark, d, body_groups(spark, d), "embedding"))


def cards(spark: SparkSession, d: str, hours: int = 336) -> DataFrame:
    """One row for each story that readers may see: its place, head, sources, title, dates and names."""
    groups = cut(body_groups(spark, d, hours))
    m = cut(members(spark, d, groups, "embedding", "text", "entities", hours=hours))
    story = ranked(spark, d, hours, groups)
    reach = timed(spark, d, "url").where(F.col("fetched_at") > ago(336)).groupBy(T.outlet(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("reach"))
    head = m.where("open").groupBy("leader").agg(F.max_by(F.struct("article_id", "url", T.entities(F.col("entities")).alias("names")), newest_first()).alias("h"))
    one = m.where("open and domain <> ''").groupBy("leader", "domain").agg(F.max_by(F.struct("url", F.length(F.coalesce("text", F.lit(""))).alias("n")), newest_first()).alias("w"))
    place = 0.62 * F.least(F.lit(1.0), F.log1p("w.n") / F.log1p(F.lit(6000.0))) + 0.38 * F.least(F.lit(1.0), F.log1p(F.coalesce("reach", F.lit(1))) / F.log1p(F.lit(300.0)))
    by_place = F.array_sort(F.collect_list(F.struct((-F.round(place, 6)).alias("p"), "domain", "w.url")))  # one row an outlet
    sources = one.join(reach, "domain", "left").groupBy("leader").agg(by_place.alias("s"))
    span = m.groupBy("leader").agg(F.min("pub").alias("first"), F.max("pub").alias("last"))
    j = story.join(head, "leader").join(sources, "leader").join(span, "leader").join(titles(m).select("leader", F.col("title").alias("t")), "leader", "left")
    us = lambda c: F.unix_micros(c)
    return j.select(
        "country", "leader", "value", "weight", "age", F.bround(F.col("weight") * 100, 0).cast("int").alias("score"), F.col("h.article_id").alias("head"),
        F.array_join(F.transform("s", lambda x: x["domain"]), ";").alias("sources"), F.size("s").alias("outlets"), F.col("s")[0]["domain"].alias("domain"), T.safe_url(F.col("s")[0]["url"]).alias("url"),
        F.coalesce(F.when(F.col("t") != "", F.col("t")), F.col("h.url")).alias("title"), F.to_date("first").cast("string").alias("day"), "first", "last", (us("last") - us("first") >= 86_400_000_000).alias("updated"),
        F.array_join(F.slice("h.names", 1, 4), ";").alias("entities"), F.round(D.live(F.col("age")), 3).alias("live"),
    )


@query(Y.cards() + """ SELECT country, leader, head, score, CAST(score >= 30 AS INT) + CAST(score >= 50 AS INT) + CAST(score >= 70 AS INT) + CAST(score >= 85 AS INT) AS tier, round(value, 5) AS rank, live, outlets, domain, url, sources, title, day, updated, entities FROM card""")
def r13_story_cards(spark: SparkSession, d: str) -> DataFrame:
    """The published card: score 0..100 rounded half to even, and its tier."""
    c = cards(spark, d)
    return c.select("country", "leader", "head", "score", T.tier(F.col("score")).alias("tier"), F.round("value", 5).alias("rank"), "live", "outlets", "domain", "url", "sources", "title", "day", "updated", "entities")


_REP = "feed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY open DESC, fetched_at DESC, article_id) AS rr FROM mem) WHERE rr = 1 AND open)"
_ESC = "regexp_replace(replace(replace(replace(coalesce({}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
_SHOWN = "substr(coalesce(nullif(title_ru, ''), nullif(title_en, ''), nullif(title, ''), url), 1, 300)"
_BODY = "coalesce(nullif(text_ru, ''), nullif(text_en, ''), text, '')"


@query(Y.ranked(24) + f""", {_REP}
SELECT f.cc AS country, row_number() OVER (PARTITION BY f.cc ORDER BY r.rank) AS r, '<item><guid>' || {_ESC.format('url')} || '</guid><link>' || {_ESC.format('url')} || '</link><title>' || {_ESC.format(_SHOWN)} || '</title><content><![CDATA[' || replace({_BODY}, ']]>', ']]]]><![CDATA[>') || ']]></content><pubDate>'
  || strftime(pub, '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate></item>' AS item FROM feed f JOIN ranked r ON r.leader = f.leader AND r.country = f.cc""")
def k08_feeds(spark: SparkSession, d: str) -> DataFrame:
    """country, r, item: each country's feed, every story of the last day by its rank, an item a row.

    The representative is the newest article that readers may open; a story without one is left out. A writer sorts by r within a country, so no feed
    is collected into one row.
    """
    hours = DEFAULT.window_hours
    groups = cut(body_groups(spark, d, hours))
    m = members(spark, d, groups, "text", "text_ru", "text_en", hours=hours).where("open")
    rep = m.groupBy("leader").agg(F.max_by(F.struct("url", "title", "title_ru", "title_en", "text", "text_ru", "text_en", "pub"), F.struct("fetched_at", -F.col("article_id"))).alias("w")).select("leader", "w.*")
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    title = F.substring(F.coalesce(full("title_ru"), full("title_en"), full("title"), F.col("url")), 1, 300)
    body = F.replace(F.coalesce(full("text_ru"), full("text_en"), F.col("text"), F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    stamp = F.concat(F.date_format("pub", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    url = H.escaped(F.col("url"))
    item = F.concat(F.lit("<item><guid>"), url, F.lit("</guid><link>"), url, F.lit("</link><title>"), H.escaped(title), F.lit("</title><content><![CDATA["), body, F.lit("]]></content><pubDate>"), stamp, F.lit("</pubDate></item>"))
    j = ranked(spark, d, hours, groups).join(rep, "leader")
    return j.select("country", F.row_number().over(Window.partitionBy("country").orderBy("rank")).alias("r"), item.alias("item"))


_REGION = "JOIN countries g ON g.country = card.country"
_BEST = "value DESC, outlets DESC, leader"


@query(Y.cards() + f""", scoped AS (SELECT 'home' AS scope, '' AS key, leader, row_number() OVER (ORDER BY {_BEST}) AS r FROM card
  UNION ALL SELECT 'region', g.region_name, leader, row_number() OVER (PARTITION BY g.region_name ORDER BY {_BEST}) FROM card {_REGION}
  UNION ALL SELECT 'country', card.country, leader, row_number() OVER (PARTITION BY card.country ORDER BY value DESC, leader) FROM card)
SELECT scope, key, r, leader FROM scoped WHERE r <= 100""")
def k10_top_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred stories of the home page, of each region and of each country."""
    c = cut(cards(spark, d).select("country", "leader", "value", "outlets"))
    region = c.join(F.broadcast(table(spark, d, "countries", "country", "region_name")), "country")
    best = (F.desc("value"), F.desc("outlets"), "leader")
    top = lambda x, key, order: x.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= DEFAULT.top)
    home = c.orderBy(*best).limit(DEFAULT.top).withColumn("one", F.lit(""))  # a page of a hundred
    parts = [top(home, "one", best).select(F.lit("home").alias("scope"), F.col("one").alias("key"), "r", "leader")]
    parts.append(top(region, "region_name", best).select(F.lit("region").alias("scope"), F.col("region_name").alias("key"), "r", "leader"))
    parts.append(top(c, "country", (F.desc("value"), "leader")).select(F.lit("country").alias("scope"), F.col("country").alias("key"), "r", "leader"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_NAMED = "en AS (SELECT country, leader, value, outlets, unnest(string_split(entities, ';')) AS name, unnest(range(len(string_split(entities, ';')))) AS pos FROM card WHERE entities <> '')"
_SEEN = "row_number() OVER (ORDER BY value DESC, outlets DESC, leader, pos)"


@query(Y.cards() + f""", {_NAMED} SELECT country, name, n, r FROM (SELECT country, name, n, row_number() OVER (PARTITION BY country ORDER BY n DESC, seen) AS r FROM (SELECT country, name, count(*) AS n, min(seen) AS seen FROM (SELECT *, row_number() OVER (ORDER BY value DESC, leader, pos) AS seen FROM en) GROUP BY country, name)) WHERE r <= 14 AND n > 1""")
def a06_top_entities(spark: SparkSession, d: str) -> DataFrame:
    """The names that stand in most stories of a country: four of each story's head, more than one story, fourteen at most; ties go to the name seen first."""
    n = named(cards(spark, d)).groupBy("country", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("value")).alias("v"), "leader", "pos")).alias("seen"))
    r = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "seen"))
    return n.withColumn("r", r).where("r <= 14 and n > 1").select("country", "name", "n", "r")


def named(c: DataFrame) -> DataFrame:
    return c.where("entities <> ''").select("country", "leader", "value", "outlets", F.posexplode(F.split("entities", ";")).alias("pos", "name"))


_GLOSS = "gl AS (SELECT array_to_string(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'), ' ') AS k, min(ru) AS ru FROM entity_ru WHERE name IS NOT NULL AND ru IS NOT NULL GROUP BY 1)"
_KEY = "array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ')"


def glossary(spark: SparkSession, d: str) -> DataFrame:
    """k, ru: the known forms of names by their words."""
    g = table(spark, d, "entity_ru").where("name is not null and ru is not null").select(T.phrase_key(F.col("name")).alias("k"), "ru")
    return g.groupBy("k").agg(F.min("ru").alias("ru"))


@query(Y.cards() + f""", {_NAMED}, {_GLOSS} SELECT gl.ru, name, n FROM (SELECT name, count(*) AS n, min(seen) AS seen FROM (SELECT *, {_SEEN} AS seen FROM en) GROUP BY name HAVING count(*) >= 3) JOIN gl ON gl.k = {_KEY.format('name')} ORDER BY n DESC, seen LIMIT 12""")
def a07_popular_names(spark: SparkSession, d: str) -> DataFrame:
    """The dozen most frequent names of the archive that have a known form and stand in three stories or more."""
    seen = F.min(F.struct((-F.col("value")).alias("v"), (-F.col("outlets")).alias("o"), "leader", "pos"))
    n = named(cards(spark, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), seen.alias("seen")).where("n >= 3")
    return n.withColumn("k", T.phrase_key(F.col("name"))).join(glossary(spark, d), "k").orderBy(F.desc("n"), "seen").limit(12).select("ru", "name", "n")


@query(Y.cards() + """, per AS (SELECT g.region_name AS region, card.country, count(*) AS n, first(score ORDER BY value DESC, leader) AS top FROM card JOIN countries g ON g.country = card.country GROUP BY 1, 2)
SELECT region, sum(n)::BIGINT AS n, string_agg(country || ':' || n || ':' || top, ';' ORDER BY country) AS countries FROM per GROUP BY region""")
def a09_region_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Stories of each region, with its countries' numbers and the score of their first story."""
    c = cards(spark, d).join(F.broadcast(table(spark, d, "countries", "country", "region_name")), "country")
    per = c.groupBy(F.col("region_name").alias("region"), "country").agg(F.count(F.lit(1)).alias("n"), F.max_by("score", F.struct("value", -F.col("leader"))).alias("top"))
    text = F.concat_ws(":", "country", F.col("n").cast("string"), F.col("top").cast("string"))
    # the countries of a region are a fixed dimension
    return per.groupBy("region").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("country", text.alias("t")))), lambda x: x["t"]), ";").alias("countries"))


_INDEX = """, ordered AS (SELECT *, row_number() OVER (ORDER BY value DESC, outlets DESC, leader) - 1 AS i FROM card),
ck AS (SELECT country, row_number() OVER (ORDER BY country) - 1 AS k FROM (SELECT DISTINCT country FROM card)), dk AS (SELECT day, row_number() OVER (ORDER BY day DESC) - 1 AS k FROM (SELECT DISTINCT day FROM card))"""


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """The cards with `i`, their place in the whole corpus from 0."""
    return O.places(cut(cards(spark, d)), "value", F.desc("outlets"), "leader").withColumn("i", F.col("place") - 1)


@query(Y.cards() + _INDEX + """ SELECT i, to_json([to_json(title), to_json(CAST(ck.k AS INT)), to_json(CAST(dk.k AS INT)), to_json(score), to_json(url), to_json(domain), to_json(entities), to_json(outlets)])::VARCHAR AS line, live FROM ordered JOIN ck USING (country) JOIN dk USING (day)""")
def k09_search_index(spark: SparkSession, d: str) -> DataFrame:
    """i, line, live: the corpus of the search as JSON rows, countries and days as numbers of their dictionaries."""
    from pressloom.operators.journal import dictionary

    o = indexed(spark, d)
    ck, dk = dictionary(o, "country"), dictionary(o, "day", descending=True)
    j = o.join(F.broadcast(ck), "country").join(F.broadcast(dk), "day")
    cell = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    cells = [cell(F.col(c)) for c in ("title", "country_k", "day_k", "score", "url", "domain", "entities", "outlets")]
    return j.select("i", F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("line"), "live")


@query(Y.cards() + f""", {_NAMED}, {_GLOSS} SELECT 'c' AS part, country AS key, CAST(row_number() OVER (ORDER BY country) - 1 AS VARCHAR) AS value FROM (SELECT DISTINCT country FROM card)
UNION ALL SELECT 'd', day, CAST(row_number() OVER (ORDER BY day DESC) - 1 AS VARCHAR) FROM (SELECT DISTINCT day FROM card)
UNION ALL SELECT 'g', region_name, string_agg(country, ',' ORDER BY country) FROM countries WHERE country IN (SELECT country FROM card) GROUP BY region_name
UNION ALL SELECT DISTINCT 'n', name, gl.ru FROM en JOIN gl ON gl.k = {_KEY.format('name')}""")
def k09_dictionaries(spark: SparkSession, d: str) -> DataFrame:
    """The dictionaries of the search index: countries, days, regions with their countries, and names with a known form."""
    from pressloom.operators.journal import dictionary

    c = cut(cards(spark, d).select("country", "day", "leader", "entities", "value", "outlets"))
    part = lambda df, p, key, value: df.select(F.lit(p).alias("part"), F.col(key).alias("key"), F.col(value).cast("string").alias("value"))
    regions = table(spark, d, "countries", "country", "region_name").join(c, "country", "left_semi").groupBy("region_name").agg(F.array_join(F.array_sort(F.collect_list("country")), ",").alias("cs"))
    known = named(c).select("name").distinct().withColumn("k", T.phrase_key(F.col("name"))).join(glossary(spark, d), "k")
    return part(dictionary(c, "country"), "c", "country", "country_k").unionByName(part(dictionary(c, "day", descending=True), "d", "day", "day_k")).unionByName(part(regions, "g", "region_name", "cs")).unionByName(part(known, "n", "name", "ru"))


@query(Y.cards() + _INDEX + """, hv AS (SELECT o.i, o.url, CAST(coalesce(a.embedding_body, a.embedding) AS DOUBLE[]) AS v FROM ordered o JOIN articles a ON a.article_id = o.head),
hu AS (SELECT i, url, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM hv WHERE v IS NOT NULL AND len(v) > 0 AND list_dot_product(v, v) > 0),
near AS (SELECT a.i, a.url, b.i AS j, b.url AS other, row_number() OVER (PARTITION BY a.i ORDER BY round(list_dot_product(a.u, b.u), 4) DESC, b.i) AS k FROM hu a JOIN hu b ON a.i <> b.i AND list_dot_product(a.u, b.u) >= 0.90 - 1e-7)
SELECT url, CAST(k AS INT) AS k, other FROM near WHERE k <= 4""")
def q10_similar_by_url(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours that the index holds for a story's url: up to four similar stories of any country."""
    from pressloom.operators import similarity as S

    o = cut(indexed(spark, d).select("i", "url", "head"))
    v = o.join(articles(spark, d, "article_id", F.coalesce("embedding_body", "embedding").alias("v")), F.col("head") == F.col("article_id")).select("i", "v")
    s = S.fitted(v, DEFAULT.similar, "v")
    rows = cut(S.vectors(v, s, "v", "i").withColumnRenamed("id", "rep"))
    index = S.segment_index(rows, s)
    near = S.cosine_at_least(S.probe(index, index, s), rows, rows, s).withColumn("cos", F.round("cos", 4))
    top = near.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))).where("k <= 4")
    url = o.select("i", "url")
    return top.join(url.withColumnRenamed("i", "a"), "a").join(url.select(F.col("i").alias("b"), F.col("url").alias("other")), "b").select("url", "k", "other")
