"""Digest, dictionary and translation queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import russian as L
from pressloom.functions import text as T
from pressloom.operators import digest as O
from pressloom.plans.oracle import outlet
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles
from pressloom.sources.tables import table
from pressloom.storage import cut

Q, SQL, query = registry()

_SENTS = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?…])\\s+|\\n+', '\\1\x01', 'g'), '\x01'), lambda x: trim(x, ' ')), lambda x: x <> '')"
_WORDS = "regexp_extract_all(lower(replace(coalesce({}, ''), 'İ', 'i')), '[\\p{{L}}\\p{{N}}]+')"
_SH = "list_distinct(list_transform(generate_series(1, len({0}) - 3), lambda i: array_to_string({0}[i:i + 3], ' ')))"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """story, url, text: articles grouped by their title hash."""
    return articles(spark, d, "article_id", "title_hash", "text").where("title_hash is not null and text is not null").select(F.col("title_hash").alias("story"), F.col("article_id").alias("url"), "text")


_CAND = f"""doc AS (SELECT title_hash AS story, article_id AS url, {_SENTS}[1:20] AS ss FROM articles WHERE title_hash IS NOT NULL AND text IS NOT NULL),
cand AS (SELECT story, url, pos, s FROM (SELECT story, url, unnest(ss) AS s, unnest(range(0, len(ss))) AS pos FROM doc)),
ww AS (SELECT story, url, pos, list_distinct({_WORDS.format('s')}) AS w FROM cand),
ex AS (SELECT story, url, pos, len(w) AS k, unnest(w) AS word FROM ww),
wt AS (SELECT c.story, word, c / CAST(n AS DOUBLE) * (1 - c / CAST(n + 1 AS DOUBLE)) AS weight FROM (SELECT story, word, count(*) AS c FROM ex GROUP BY story, word) c JOIN (SELECT story, count(*) AS n FROM cand GROUP BY story) USING (story))"""


def russian(spark: SparkSession, d: str) -> DataFrame:
    """story, url, domain, text, title: what can be read in Russian, own or translated."""
    a = articles(spark, d, "article_id", "url", "language", "title", "text", "title_ru", "text_ru", "title_hash")
    own = F.coalesce(F.lower("language").startswith("ru"), F.lit(False))
    text, title = F.when(own, F.col("text")).otherwise(F.col("text_ru")), F.when(own, F.col("title")).otherwise(F.col("title_ru"))
    return a.select(F.coalesce("title_hash", F.col("article_id").cast("string")).alias("story"), F.col("article_id").alias("url"), T.outlet(F.col("url")).alias("domain"), text.alias("text"), title.alias("title")).where("text is not null")


def by_text(rows: DataFrame, schema: str, each: Callable[[dict], list[tuple]]) -> DataFrame:
    """`each` over the rows of Arrow batches."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            yield pd.DataFrame([x for r in p.to_dict("records") for x in each(r)], columns=names)

    return rows.mapInPandas(run, schema)


@query()
def o01_without_title(spark: SparkSession, d: str) -> DataFrame:
    """Russian texts that begin with their title, less the title; each text is given its own title in front."""
    docs = russian(spark, d).withColumn("text", F.concat_ws(" ", "title", "text"))
    return by_text(docs, "article_id long, cut int", lambda r: [(r["url"], len(t := " ".join(r["text"].split())) - len(L.without_title(t, r["title"] or "")))])


@query()
def o02_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Russian texts cut into sentences: decimals, shortened words and initials do not end one."""
    return by_text(russian(spark, d), "article_id long, k int, s string", lambda r: [(r["url"], k, s) for k, s in enumerate(L.pieces(r["text"], r["title"] or ""))])


@query()
def o03_usable(spark: SparkSession, d: str) -> DataFrame:
    """The sentences that can stand alone in a digest."""
    return O.russian_sentences(russian(spark, d)).select(F.col("url").alias("article_id"), "pos", "s")


@query("SELECT article_id, substr(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', '', 'g'), 1, 120) AS fp FROM articles")
def o04_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "title").select("article_id", T.fingerprint(F.col("title")).alias("fp"))


@query(f"SELECT article_id, CASE WHEN len(w) < 4 THEN 0 ELSE len({_SH.format('w')}) END AS n FROM (SELECT article_id, {_WORDS.format('text')} AS w FROM articles)")
def o05_shingles(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "text").select("article_id", F.size(O.shingles(O.words(F.col("text")))).alias("n"))


@query(f"""WITH w AS (SELECT article_id, title_hash, {_WORDS.format('text')} AS w FROM articles WHERE title_hash IS NOT NULL), s AS (SELECT article_id, title_hash, CASE WHEN len(w) < 4 THEN [] ELSE {_SH.format('w')} END AS sh FROM w),
f AS (SELECT title_hash, min(article_id) AS first FROM s GROUP BY title_hash)
SELECT s.article_id, round(CASE WHEN len(s.sh) = 0 THEN 0 ELSE len(list_filter(s.sh, lambda x: NOT list_contains(k.sh, x))) / CAST(len(s.sh) AS DOUBLE) END, 6) AS novelty FROM s JOIN f USING (title_hash) JOIN s k ON k.article_id = f.first WHERE s.article_id <> f.first""")
def o06_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Share of an article's shingles that the first article with its title lacks."""
    s = articles(spark, d, "article_id", "title_hash", "text").where("title_hash is not null").select("article_id", "title_hash", O.shingles(O.words(F.col("text"))).alias("sh"))
    first = s.groupBy("title_hash").agg(F.min_by("sh", "article_id").alias("known"), F.min("article_id").alias("first"))
    return s.join(first, "title_hash").where("article_id <> first").select("article_id", F.round(O.novelty(F.col("sh"), F.col("known")), 6).alias("novelty"))


@query(f"WITH {_CAND} SELECT story, word, round(weight, 6) AS weight FROM wt")
def o07_word_weights(spark: SparkSession, d: str) -> DataFrame:
    return O.word_weights(O.candidates(docs(spark, d))).select("story", "word", F.round("weight", 6).alias("weight"))


@query(f"WITH {_CAND} SELECT story, url, pos, round(sum(weight) / sqrt(any_value(k)) * CASE pos WHEN 0 THEN 1.3 WHEN 1 THEN 1.1 ELSE 1 END + 1e-9, 5) AS score FROM ex JOIN wt USING (story, word) GROUP BY story, url, pos")
def o08_sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    return O.scored(O.candidates(docs(spark, d))).select("story", "url", "pos", F.round(F.col("score") + 1e-9, 5).alias("score"))


@query()
def o09_digest(spark: SparkSession, d: str) -> DataFrame:
    """Three sentences of each story out of its Russian texts, without what their sites repeat."""
    return O.digest(O.own_sentences(cut(O.russian_sentences(russian(spark, d)))))


_GUARD_WORDS = "regexp_extract_all(lower({}), '[а-яёa-z0-9]+')"
_R12 = "list_transform(generate_series(1, len({0}) - 11), lambda i: array_to_string({0}[i:i + 11], ' '))"
_UNIT = "list_distinct(list_transform(regexp_extract_all(' ' || replace(lower({}), ' ', '  ') || ' ', '[^а-яё](руб|рупи|крор|лакх|крон|доллар|евро|фунт|юан|иен)[а-яё]{{0,3}}[^а-яё]'), lambda x: regexp_extract(x, '(руб|рупи|крор|лакх|крон|доллар|евро|фунт|юан|иен)', 1)))"


@query(f"""WITH r AS (SELECT article_id, array_to_string(list_filter(regexp_split_to_array(title || ' ' || CASE article_id % 5 WHEN 0 THEN '77 рублей' WHEN 1 THEN 'полovina' WHEN 2 THEN 'новое <think> слово' WHEN 3 THEN array_to_string(list_transform(range(30), lambda i: 'раз'), ' ') ELSE substr(text, 1, 100) END, '\\s+'), lambda x: x <> ''), ' ') AS t, text FROM articles
  WHERE title IS NOT NULL AND text IS NOT NULL AND NOT regexp_matches(title || text, '[‑\\x1c-\\x1f\\x85\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]|\\d\\s*л\\.')),
q AS (SELECT *, {_GUARD_WORDS.format('t')} AS w, {_GUARD_WORDS.format('text')} AS sw FROM r)
SELECT article_id, concat_ws(',', CASE WHEN t = '' OR regexp_full_match(lower(t), '[«"'']?нет[.!»"'']*') THEN 'refusal' END, CASE WHEN contains(lower(t), '<think') THEN 'thoughts' END, CASE WHEN length(t) NOT BETWEEN 80 AND 600 THEN 'length' END,
  CASE WHEN regexp_matches(lower(t), '[а-яё][a-z]|[a-z][а-яё]') THEN 'mixed' END, CASE WHEN len(w) > 25 AND len(list_distinct(w)) / CAST(len(w) AS DOUBLE) < 0.62 THEN 'repeating' END,
  CASE WHEN len(list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(text, '[0-9]+'), x))) > 0 THEN 'number' END, CASE WHEN len(list_filter({_UNIT.format('t')}, lambda x: NOT list_contains({_UNIT.format('text')}, x))) > 0 THEN 'unit' END,
  CASE WHEN (t <> '' AND contains(text, t)) OR (len(w) >= 12 AND len(sw) >= 12 AND list_has_any({_R12.format('w')}, {_R12.format('sw')})) THEN 'copy' END) AS faults FROM q""")
def o10_guards(spark: SparkSession, d: str) -> DataFrame:
    """What speaks against a rewrite: titles with various additions stand in for rewrites of their texts.

    Texts with spaces or digits that the two regular expression dialects read apart are left out on both sides.
    """
    odd = "[‑\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|\\d\\s*л\\."
    k = F.col("article_id") % 5
    more = F.when(k == 0, "77 рублей").when(k == 1, "полovina").when(k == 2, "новое <think> слово").when(k == 3, " ".join(["раз"] * 30)).otherwise(F.substring("text", 1, 100))
    a = articles(spark, d, "article_id", "title", "text").where("title is not null and text is not null").where(~F.concat("title", "text").rlike(odd))
    rows = a.select("article_id", F.concat("title", F.lit(" "), more).alias("t"), "text")
    return by_text(rows, "article_id long, faults string", lambda r: [(r["article_id"], ",".join(L.faults(" ".join(r["t"].split()), r["text"], 80, 600)))])


@query()
def o14_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """A headline and a retelling of each story by a stand-in writer, from twelve sentences of 1700 characters, kept where the guards allow it."""
    return rewritten(O.digest(O.own_sentences(cut(O.russian_sentences(russian(spark, d)))), want=12, most=1700))


def rewritten(picked: DataFrame) -> DataFrame:
    """story, headline, body: null where nothing passes. A story's sentences are bounded by the digest."""
    source = picked.groupBy("story").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), " ").alias("source"))

    def write(r: dict) -> list[tuple]:
        # the stand-in writer turns the order of every other three words about, and so copies no long run
        w = r["source"].split()
        body = " ".join(x for k in range(0, len(w), 3) for x in (reversed(w[k : k + 3]) if k % 2 else w[k : k + 3]))[:400]
        head, text = L.guarded_headline(" ".join(w[3:12]), r["source"])[0], L.guarded(body, r["source"])[0]
        return [(r["story"], head if text else None, text)]

    return by_text(source, "story string, headline string, body string", write)


_STORY = """dc AS (SELECT title_hash AS story, article_id AS url, text FROM articles WHERE title_hash IS NOT NULL AND text IS NOT NULL), half AS (SELECT avg(url) AS m FROM dc),
nk AS (SELECT story, sha1(string_agg(DISTINCT CAST(url AS VARCHAR), chr(10) ORDER BY CAST(url AS VARCHAR)) || chr(10)) AS key FROM dc GROUP BY story),
od AS (SELECT dc.* FROM dc, half WHERE url <= m), ok AS (SELECT story, sha1(string_agg(DISTINCT CAST(url AS VARCHAR), chr(10) ORDER BY CAST(url AS VARCHAR)) || chr(10)) AS key FROM od GROUP BY story),
um AS (SELECT od.url, ok.key FROM od JOIN ok USING (story)),
pr AS (SELECT key, old_key, shared FROM (SELECT key, old_key, shared, row_number() OVER (PARTITION BY key ORDER BY shared DESC, old_key) AS r FROM (SELECT nk.key, um.key AS old_key, count(*) AS shared FROM dc JOIN nk USING (story) JOIN um USING (url) GROUP BY nk.key, um.key)) WHERE r = 1)"""


def stored_overviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their story's key now, the url map and the keys as they were when half of the articles had come."""
    a = docs(spark, d)
    docs_now = a.join(O.story_keys(a), "story")
    earlier = a.crossJoin(F.broadcast(a.agg(F.avg("url").alias("m")))).where("url <= m").drop("m")
    was = earlier.join(O.story_keys(earlier), "story")
    return docs_now, was.select("url", "key"), was.select("key").distinct()


@query(f"WITH {_STORY} SELECT key, old_key, shared FROM pr")
def c12_prior_overview(spark: SparkSession, d: str) -> DataFrame:
    """The stored overview that covers most of a story's urls, though its own key has changed."""
    now_, url_map, _ = stored_overviews(spark, d)
    return O.prior(now_.select("key", "url"), url_map)


@query(f"""WITH {_STORY}, w AS (SELECT nk.key, pr.old_key, dc.url, {_WORDS.format('dc.text')} AS w FROM dc JOIN nk USING (story) JOIN pr ON pr.key = nk.key WHERE nk.key NOT IN (SELECT key FROM ok)),
sh AS (SELECT DISTINCT key, url, EXISTS (SELECT 1 FROM um WHERE um.url = w.url AND um.key = w.old_key) AS known, unnest(CASE WHEN len(w) < 4 THEN [] ELSE {_SH.format('w')} END) AS sh FROM w),
base AS (SELECT DISTINCT key, sh FROM sh WHERE known), fr AS (SELECT s.key, s.url, 1 - count(b.sh) / CAST(count(*) AS DOUBLE) AS nov FROM sh s LEFT JOIN base b ON b.key = s.key AND b.sh = s.sh WHERE NOT s.known GROUP BY s.key, s.url),
nv AS (SELECT key, max(nov) >= 0.55 AS new FROM fr WHERE key IN (SELECT key FROM base) GROUP BY key)
SELECT nk.key, CASE WHEN nk.key IN (SELECT key FROM ok) THEN 'stored ' || nk.key WHEN pr.old_key IS NULL OR coalesce(nv.new, FALSE) THEN 'made ' || nk.key ELSE 'stored ' || pr.old_key END AS lines, nk.key NOT IN (SELECT key FROM ok) AND coalesce(nv.new, FALSE) AS added
FROM nk LEFT JOIN pr ON pr.key = nk.key LEFT JOIN nv ON nv.key = nk.key""")
def o12_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Which overview each story shows when half of the articles were known before: the stored one, the earlier one or a new one."""
    now_, url_map, keys = stored_overviews(spark, d)
    stored = keys.select("key", F.concat(F.lit("stored "), "key").alias("lines"), F.lit(False).alias("added"))
    made = now_.select("key").distinct().withColumn("lines", F.concat(F.lit("made "), "key"))
    return O.resolved(now_, made, stored, url_map)


@query(f"""WITH l AS (SELECT article_id AS story, {outlet('url')} AS domains, {_SENTS}[1:3] AS ss FROM articles), x AS (SELECT story, domains, unnest(ss) AS s, unnest(range(0, len(ss))) AS k FROM l)
SELECT story, CAST(k AS INT) AS k, s, domains FROM (SELECT *, sum(length(s)) OVER (PARTITION BY story ORDER BY k) AS run FROM x WHERE k < 2) WHERE k = 0 OR run <= 300""")
def o13_tail_overview(spark: SparkSession, d: str) -> DataFrame:
    """The short form of an overview: two lines of 300 characters at most, the first whatever its length."""
    a = articles(spark, d, "article_id", "url", "text").select(F.col("article_id").alias("story"), T.outlet(F.col("url")).alias("domains"), F.posexplode(F.slice(O.sentences(F.col("text")), 1, 3)).alias("k", "s"))
    return O.tail(a).select("story", "k", "s", "domains")


_LINE_END = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'"
_STRIPPED = "regexp_replace(regexp_replace({}, '^[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ''), '[\\s\\x0b\\x{{85}}\\p{{Z}}]+$', '')"


@query(f"""SELECT article_id, {_STRIPPED.format(f"regexp_replace(regexp_split_to_array(coalesce(title, ''), {_LINE_END})[1], '^[*\\s\\x{{85}}\\p{{Z}}]*', '')")} AS headline, {_STRIPPED.format(f"regexp_replace(regexp_replace(coalesce(text, ''), {_LINE_END}, chr(10), 'g'), '^[* \\t\\x{{85}}\\p{{Z}}]*([^\\n]*?)[ \\t\\x{{85}}\\p{{Z}}]*\\n', '\\1' || chr(10))")} AS body FROM articles""")
def o11_whole_reply(spark: SparkSession, d: str) -> DataFrame:
    """Headline and body read back out of a reply of several lines that holds the whole title and text."""
    a = articles(spark, d, "article_id", "title", "text")
    reply = F.concat(F.lit("Вот ответ.\n**Заголовок:** "), F.coalesce("title", F.lit("")), F.lit("\nПересказ: "), F.coalesce("text", F.lit("")))
    return a.select("article_id", T.reply_parts(reply).alias("p")).select("article_id", "p.headline", "p.body")


def glossary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_ru").where("name is not null and ru is not null").select(F.array_join(O.words(F.col("name")), " ").alias("name"), "ru")


_KEY = "array_to_string(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'), ' ')"


@query(f"SELECT e.entity_id, g.ru FROM entity_ru e JOIN (SELECT {_KEY} AS k, min(ru) AS ru FROM entity_ru WHERE name IS NOT NULL AND ru IS NOT NULL GROUP BY 1) g ON g.k = array_to_string(regexp_extract_all(lower(e.name), '[\\p{{L}}\\p{{N}}]+'), ' ')")
def l02_lookup(spark: SparkSession, d: str) -> DataFrame:
    g = glossary(spark, d).groupBy("name").agg(F.min("ru").alias("ru")).withColumnRenamed("name", "k")
    return table(spark, d, "entity_ru").select("entity_id", F.array_join(O.words(F.col("name")), " ").alias("k")).join(g, "k").select("entity_id", "ru")


@query("SELECT article_id, CASE WHEN language IS NULL OR trim(language) = '' THEN 'defer' WHEN starts_with(lower(language), 'ru') THEN 'skip' WHEN starts_with(lower(language), 'en') THEN 'en' ELSE 'pivot' END AS work FROM articles")
def l11_work(spark: SparkSession, d: str) -> DataFrame:
    g = F.lower("language")
    work = F.when(F.col("language").isNull() | (F.trim("language") == ""), "defer").when(g.startswith("ru"), "skip").when(g.startswith("en"), "en").otherwise("pivot")
    return articles(spark, d, "article_id", "language").select("article_id", work.alias("work"))


@query("SELECT article_id, 'https://web.archive.org/web/' || strftime(fetched_at, '%Y%m%d%H%M%S') || 'id_/' || url AS raw FROM articles")
def x02_archive_url(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "url", "fetched_at").select("article_id", F.concat(F.lit("https://web.archive.org/web/"), F.date_format("fetched_at", "yyyyMMddHHmmss"), F.lit("id_/"), F.col("url")).alias("raw"))


