"""The scoring and translation chains with stand-ins for outside services, and the streaming state."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import pages as H
from pressloom.functions import russian as L
from pressloom.functions import text as T
from pressloom.operators import dictionary as W
from pressloom.operators import ticks as K
from pressloom.operators.ring import Ring
from pressloom.operators.select import numbered_batches
from pressloom.plans.oracle import NOW
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles
from pressloom.plans.stories import _REUSE, reused
from pressloom.plans.texts import by_text
from pressloom.sources.tables import table
from pressloom.storage import cut, shared_folder
from pressloom.streaming import ticks as S

Q, SQL, query = registry()


# --- judging


def stub_judge(prompts: pd.Series) -> pd.Series:
    """A stand-in for the judge: it answers by the hash of each title and leaves some out."""
    out = []
    for p in prompts:
        verdicts = {}
        for m in re.finditer(r"^\[id=(\d+)\] \([^\n]*?\) ([^\n]*)$", p or "", re.M):
            h = hashlib.md5(m.group(2).encode(), usedforsecurity=False).hexdigest()[0]
            if h != "f":
                verdicts[m.group(1)] = h < "8"
        out.append("```json\n" + json.dumps(verdicts) + "\n```")
    return pd.Series(out)


@query(_REUSE + """, rep AS (SELECT a.article_id AS leader, trim(replace(coalesce(a.title, ''), chr(10), ' ')) AS title, a.fetched_at FROM articles a WHERE a.article_id IN (SELECT leader FROM grouped) AND a.article_id NOT IN (SELECT leader FROM reuse) AND a.fetched_at IS NOT NULL),
judged AS (SELECT leader, CASE WHEN substr(md5(title), 1, 1) < '8' THEN 100 ELSE 0 END AS importance FROM rep WHERE substr(md5(title), 1, 1) <> 'f')
SELECT g.article_id, coalesce(r.importance, j.importance) AS importance, CASE WHEN r.importance IS NOT NULL THEN 'dup' ELSE 'llm' END AS scored_by FROM grouped g LEFT JOIN reuse r USING (leader) LEFT JOIN judged j USING (leader) WHERE coalesce(r.importance, j.importance) IS NOT NULL""")
def x04_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scoring run: groups of one title, verdicts reused, the rest judged in batches of twenty across countries, verdicts given to whole groups.

    An id that the judge leaves out stays without a verdict for the next run.
    """
    groups = cut(reused(spark, d))
    todo = groups.where("importance is null").select(F.col("leader").alias("article_id")).distinct()
    a = articles(spark, d, "article_id", "country", "title", "text", "fetched_at").where("fetched_at is not null").join(todo, "article_id")
    n = cut(numbered_batches(a, "fetched_at", "article_id").select("article_id", "batch", "place", "country", "title", "text"))
    item = F.concat(F.lit("[id="), F.col("place").cast("string"), F.lit("] ("), T.title_case(F.coalesce("country", F.lit(""))), F.lit(") "), F.trim(F.replace(F.coalesce("title", F.lit("")), F.lit("\n"), F.lit(" "))), F.lit("\n"), F.substring(T.squeezed(F.coalesce("text", F.lit(""))), 1, 800))
    prompts = n.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("x")))), lambda y: y["x"]), "\n").alias("prompt"))  # twenty items
    replies = prompts.select("batch", F.pandas_udf(stub_judge, "string")("prompt").alias("reply"))
    verdicts = replies.select("batch", F.explode(T.judged_ids(F.col("reply"), F.lit(20))).alias("x")).select("batch", F.col("x.id").alias("place"), F.col("x.v").alias("judged"))
    judged = n.join(verdicts, ["batch", "place"]).select(F.col("article_id").alias("leader"), "judged")
    out = groups.join(judged, "leader", "left").withColumn("score", F.coalesce("importance", "judged")).where("score is not null")
    return out.select("article_id", F.col("score").alias("importance"), F.when(F.col("importance").isNotNull(), "dup").otherwise("llm").alias("scored_by"))


@query()
def x05_ring(spark: SparkSession, d: str) -> DataFrame:
    """Whom nine calls of a small ring reach: a model that fails moves to the end of its pool, one that answers to the front."""
    ring = Ring({"a": ["a1", "a2"], "b": ["b1"], "c": ["c1", "c2"]})
    down = {"a1", "b1"}
    got = [ring.ask(lambda p, m: None if m in down else f"{p}:{m}") for _ in range(9)]
    return spark.createDataFrame([(k, *g[:2]) for k, g in enumerate(got) if g], "call int, provider string, model string")


@query("SELECT gkg_id, regexp_replace(url, '([?&](utm_[a-z]+|fbclid|gclid|ref|key|token)=)[^&#]*', '\\1***', 'g') AS url FROM gkg WHERE url IS NOT NULL")
def x07_redact(spark: SparkSession, d: str) -> DataFrame:
    """Values that identify a reader or a caller taken out of the urls that a log shows."""
    return table(spark, d, "gkg", "gkg_id", "url").where("url is not null").select("gkg_id", F.regexp_replace("url", "([?&](utm_[a-z]+|fbclid|gclid|ref|key|token)=)[^&#]*", "$1***").alias("url"))


# --- dictionary and translation


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The stored names as a dictionary: kept ones, and those with a Russian form."""
    return table(spark, d, "entity_ru").select("name", "ru", F.when(F.col("src") == "keep", "keep").otherwise("ru").alias("mode"), F.lit("").alias("gloss"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "text").where("text is not null").select(F.col("article_id").alias("id"), "text")


_DICT = "dict AS (SELECT array_to_string(regexp_extract_all(lower(replace(name, 'İ', 'i')), '[\\p{L}\\p{N}]+'), ' ') AS name, min(ru) AS ru FROM entity_ru WHERE name IS NOT NULL AND ru <> '' GROUP BY 1 HAVING name <> '')"
_FOUND = f"""{_DICT}, tk AS (SELECT article_id AS id, regexp_extract_all(lower(replace(text, 'İ', 'i')), '[\\p{{L}}\\p{{N}}]+') AS w FROM articles WHERE text IS NOT NULL),
lens AS (SELECT max(len(string_split(name, ' '))) AS most FROM dict), fw AS (SELECT DISTINCT string_split(name, ' ')[1] AS head FROM dict),
pos AS (SELECT id, w, start FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS start FROM tk) WHERE w[start] IN (SELECT head FROM fw)),
hits AS (SELECT p.id, p.start, n.size, d.name, d.ru FROM (SELECT unnest(range(1, (SELECT most FROM lens) + 1)) AS size) n, pos p JOIN dict d ON d.name = array_to_string(p.w[p.start:p.start + n.size - 1], ' ') WHERE p.start + n.size - 1 <= len(p.w)),
keep AS (SELECT id, unnest(list_reduce(list_concat([[CAST(0 AS BIGINT)]], list([CAST(start AS BIGINT), CAST(size AS BIGINT)] ORDER BY start, size DESC)), lambda s, x: CASE WHEN x[1] > s[1] THEN list_append(list_concat([x[1] + x[2] - 1], s[2:]), x[1]) ELSE s END)[2:]) AS start FROM hits GROUP BY id),
found AS (SELECT h.id, h.start, h.size, h.name, h.ru FROM keep k JOIN (SELECT *, row_number() OVER (PARTITION BY id, start ORDER BY size DESC) AS r FROM hits) h ON h.id = k.id AND h.start = k.start AND h.r = 1)"""


def found(spark: SparkSession, d: str) -> DataFrame:
    return W.matches(texts(spark, d), entries(spark, d))


@query(f"WITH {_FOUND} SELECT id, CAST(start AS INT) AS start, CAST(size AS INT) AS size, name, ru FROM found")
def l01_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary phrases in every text, the longest at each place, none overlapping."""
    return found(spark, d)


@query(f"WITH {_FOUND}, first AS (SELECT id, name, min(start) AS start FROM found GROUP BY id, name) SELECT id, string_agg(name, ';' ORDER BY start) AS names FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start) AS r FROM first) WHERE r <= 40 GROUP BY id")
def l03_names(spark: SparkSession, d: str) -> DataFrame:
    """The first forty distinct names of each text."""
    first = found(spark, d).groupBy("id", "name").agg(F.min("start").alias("start"))
    return first.groupBy("id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("start", "name"))), 1, 40), lambda x: x["name"]), ";").alias("names"))


_CASES = ("gent", "datv", "accs", "ablt", "loct")
_NOUN = {"gent": "а", "datv": "у", "accs": "а", "ablt": "ым", "loct": "е"}
_ADJ = {"gent": "ого", "datv": "ому", "accs": "ого", "ablt": "им", "loct": "ом"}
_BY_CASE = " UNION ALL ".join(
    f"SELECT entity_id, '{c}' AS grammatical_case, CASE WHEN regexp_matches(w, '(швили|дзе|ури|оглу|огл|заде|уа|иа|ава)$') THEN w WHEN regexp_matches(w, '(ский|цкий|ской|цкой)$') THEN substr(w, 1, length(w) - 2) || '{_ADJ[c]}' WHEN regexp_matches(w, '(ов|ев|ёв|ин|ын|ян)$') THEN w || '{_NOUN[c]}' ELSE w END AS form FROM s" for c in _CASES
)


@query(f"WITH s AS (SELECT entity_id, lower(string_split(ru, ' ')[-1]) AS w FROM entity_ru WHERE regexp_full_match(lower(string_split(ru, ' ')[-1]), '[а-яё-]+')) {_BY_CASE}")
def l07_surnames(spark: SparkSession, d: str) -> DataFrame:
    """The last word of each name in five cases, where it declines like a surname."""
    w = F.lower(F.element_at(F.split("ru", " "), -1))
    rows = table(spark, d, "entity_ru").where("ru is not null").select("entity_id", w.alias("w")).where(F.col("w").rlike("^[а-яё-]+$"))
    return by_text(rows, "entity_id long, grammatical_case string, form string", lambda r: [(r["entity_id"], c, L.inflected(r["w"], c)) for c in _CASES])


@query()
def l05_inflected(spark: SparkSession, d: str) -> DataFrame:
    """Titles in which a Latin name was left over, mended by its Russian form in the case that the words before call for."""
    e = table(spark, d, "entity_ru").where("ru is not null and name is not null").select("entity_id", "name")
    lead = F.element_at(F.array(*map(F.lit, ("президент ", "встреча с ", "прибыл в ", "сказал о ", "данные по ", "говорят ", "по Москве и "))), (F.col("entity_id") % 7 + 1).cast("int"))
    rows = e.select("entity_id", F.concat(lead, F.col("name")).alias("t"))
    return W.over_texts(rows, entries(spark, d), "entity_id long, mended string", lambda f, r: [(r["entity_id"], f.mended(r["t"]))])


_LEADS = ("президент ", "встреча с ", "прибыл в ", "сказал о ", "данные по ", "говорят ", "по Москве и ", "в городе ")
_WANT = ("gent", "ablt", "accs", "loct", "datv", "", "datv", "")


@query(f"SELECT entity_id, {list(_WANT)}[entity_id % 8 + 1] AS wanted FROM entity_ru WHERE name IS NOT NULL".replace('"', "'"))
def l06_case_before(spark: SparkSession, d: str) -> DataFrame:
    """The case called for by prepositions, nouns, verbs of motion and conjunctions; '' for the nominative."""
    e = table(spark, d, "entity_ru").where("name is not null").select("entity_id", "name")
    return by_text(e, "entity_id long, wanted string", lambda r: [(r["entity_id"], L.case_before((lead := _LEADS[r["entity_id"] % 8]) + r["name"], len(lead)) or "")])


@query(f"""WITH {_FOUND}, modes AS (SELECT array_to_string(regexp_extract_all(lower(replace(name, 'İ', 'i')), '[\\p{{L}}\\p{{N}}]+'), ' ') AS name, min({{'ru': ru, 'mode': CASE WHEN src = 'keep' THEN 'keep' ELSE 'ru' END}}) AS w FROM entity_ru WHERE name IS NOT NULL AND ru <> '' GROUP BY 1),
first AS (SELECT f.id, f.name, m.w.ru AS ru, m.w.mode AS mode, min(f.start) AS start FROM found f JOIN modes m USING (name) GROUP BY ALL)
SELECT id, string_agg('  "' || name || '" -> ' || ru || CASE mode WHEN 'keep' THEN ' (keep Latin script)' ELSE '' END, chr(10) ORDER BY start) AS block FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start) AS r FROM first) WHERE r <= 60 GROUP BY id""")
def l08_prompt_block(spark: SparkSession, d: str) -> DataFrame:
    """The lines that tell a writer the renderings of a text's names."""
    return W.over_texts(texts(spark, d), entries(spark, d), "id long, block string", lambda f, r: [(r["id"], b)] if (b := f.prompt(r["text"])) else [])


def stub_translated(c: F.Column) -> F.Column:
    """A stand-in translator: each chunk of a text marked as English."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.array_join(F.transform(H.quoted_chunks(c), lambda x: F.concat(F.lit("en:"), x)), " "))


@query("""WITH a AS (SELECT article_id, coalesce(title_en, '') <> '' OR coalesce(text_en, '') <> '' AS cached, coalesce(language, '') NOT IN ('', 'ru', 'en') AS asked, title, title_en, length(text) AS n FROM articles)
SELECT article_id, cached, CASE WHEN cached THEN title_en WHEN asked AND title <> '' THEN 'en:' || replace(title, chr(10), ' ') END AS title_en FROM a WHERE (cached OR asked) AND length(coalesce(title, '')) < 160""")
def l09_translate_missing(spark: SparkSession, d: str) -> DataFrame:
    """Stored translations are kept; titles and texts of other languages are translated in chunks and written back."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    a = articles(spark, d, "article_id", "title", "text", "title_en", "text_en", "language")
    a = a.withColumn("cached", some("title_en") | some("text_en")).withColumn("asked", ~F.coalesce("language", F.lit("")).isin("", "ru", "en"))
    out = a.where("cached or asked").select("article_id", "cached", "title", F.when(F.col("cached"), F.col("title_en")).otherwise(stub_translated(F.col("title"))).alias("title_en"), F.when(F.col("cached"), F.col("text_en")).otherwise(stub_translated(F.col("text"))).alias("text_en"))
    return out.where(F.length(F.coalesce("title", F.lit(""))) < 160).select("article_id", "cached", "title_en")


def common_letters(c: str) -> bool:
    """A stand-in for the letters of a translator's vocabulary: Cyrillic and typographic signs, no Latin letter with a mark."""
    return "Ѐ" <= c <= "ӿ" or c in "–—…№€“”‘’"


@query()
def l10_translated(spark: SparkSession, d: str) -> DataFrame:
    """English titles and texts through protection, a stand-in model that shouts, restoring and mending."""
    a = articles(spark, d, "article_id", "title", "text", "language").where(F.lower("language").startswith("en")).select("article_id", "title", "text")
    shout = lambda ss: [s.upper() for s in ss]
    return W.over_texts(a, entries(spark, d), "article_id long, title string, text string, route string", lambda f, r: [(r["article_id"], *W.translated(r["title"], r["text"], f, shout, common_letters))])


_CHUNK = "[^\\s.,;:!?()\\[\\]«»\"]+"


@query(f"""SELECT article_id, len(list_filter(regexp_extract_all(title, '{_CHUNK}'), lambda c: regexp_matches(c, '[^\\x00-\\x7FЀ-ӿ–—…№€“”‘’]'))) AS hidden, title AS back FROM articles WHERE title IS NOT NULL AND NOT regexp_matches(title, '[''’]s|[\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')""")
def l12_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of titles with letters beyond the translator's vocabulary behind markers, and back; titles with possessives, which are cut, and odd spaces are left out on both sides."""
    a = articles(spark, d, "article_id", "title").where("title is not null").where(~F.col("title").rlike("['’]s|[\u0085   -     　]"))

    def each(r: dict) -> list[tuple]:
        subs: dict[str, str] = {}
        t = W.hide_unknown(r["title"], subs, common_letters)
        return [(r["article_id"], len(subs), W.put_back(t, subs)[0])]

    return by_text(a, "article_id long, hidden long, back string", each)


# --- cascade of names


_KEYED = "array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ')"


@query(f"""WITH g AS (SELECT {_KEYED.format('name')} AS k, min(ru) AS ru FROM entity_ru WHERE src = 'keep' AND ru <> '' AND name IS NOT NULL GROUP BY 1), c AS (SELECT lower(trim(name)) AS k, min(ru) AS ru FROM entity_ru WHERE src = 'google' AND ru <> '' GROUP BY 1),
n AS (SELECT DISTINCT trim(unnest(string_split(coalesce(entities, ''), ';'))) AS name FROM articles), w AS (SELECT name, {_KEYED.format('name')} AS k, string_split({_KEYED.format('name')}, ' ') AS ws FROM n WHERE name <> ''),
h AS (SELECT w.name, arg_max(g.ru, s.n) AS brand, max(s.n) AS size FROM w, (SELECT unnest(range(1, 9)) AS n) s JOIN g ON g.k = array_to_string(w.ws[1:s.n], ' ') WHERE s.n < len(w.ws) GROUP BY w.name),
r AS (SELECT w.name, g.ru AS whole, h.brand, h.size, w.ws, c.ru AS cached FROM w LEFT JOIN g ON g.k = w.k LEFT JOIN h ON h.name = w.name LEFT JOIN c ON c.k = lower(w.name)),
t AS (SELECT *, row_number() OVER (ORDER BY name) AS place FROM r WHERE whole IS NULL AND brand IS NULL AND cached IS NULL)
SELECT r.name, CASE WHEN r.whole IS NOT NULL THEN 'glossary' WHEN r.brand IS NOT NULL THEN 'brand' WHEN r.cached IS NOT NULL THEN 'cache' WHEN t.place <= 40 THEN 'translator' ELSE 'title' END AS step, CASE WHEN r.brand IS NOT NULL AND r.whole IS NULL THEN r.brand ELSE coalesce(r.whole, r.cached, CASE WHEN t.place <= 40 THEN 'ru:' || r.name ELSE NULL END) END AS shown
FROM r LEFT JOIN t ON t.name = r.name""")
def c13_name_cascade(spark: SparkSession, d: str) -> DataFrame:
    """How each name is shown: the glossary's form of the whole, a kept brand at its head, the cache, a translator for forty names a run, else title case (null here)."""
    e = table(spark, d, "entity_ru").where("ru <> '' and name is not null")
    g = e.where("src = 'keep'").groupBy(T.phrase_key(F.col("name")).alias("k")).agg(F.min("ru").alias("whole"))
    c = e.where("src = 'google'").groupBy(F.lower(F.trim("name")).alias("ck")).agg(F.min("ru").alias("cached"))
    n = articles(spark, d, "entities").select(F.explode(F.split(F.coalesce("entities", F.lit("")), ";")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''").distinct()
    n = n.withColumn("k", T.phrase_key(F.col("name"))).withColumn("ck", F.lower("name"))
    w = F.split("k", " ")
    heads = n.select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when(i < F.size(w), F.array_join(F.slice(w, 1, i), " ")))).alias("size", "h")).where("h is not null")
    brand = heads.join(g.select(F.col("k").alias("h"), F.col("whole").alias("b")), "h").groupBy("name").agg(F.max_by("b", "size").alias("brand"))
    r = cut(n.join(g, "k", "left").join(brand, "name", "left").join(c, "ck", "left").select("name", "whole", "brand", "cached"))
    asked = r.where("whole is null and brand is null and cached is null").select("name").orderBy("name").limit(40).withColumn("asked", F.lit(True))
    j = r.join(F.broadcast(asked), "name", "left")
    step = F.when(F.col("whole").isNotNull(), "glossary").when(F.col("brand").isNotNull(), "brand").when(F.col("cached").isNotNull(), "cache").when(F.col("asked"), "translator").otherwise("title")
    return j.select("name", step.alias("step"), F.coalesce("whole", "brand", "cached", F.when(F.col("asked"), F.concat(F.lit("ru:"), "name"))).alias("shown"))


# --- streams and budgets


@query(f"""WITH seen AS (SELECT DISTINCT dump_ts FROM gkg), lim AS (SELECT min(dump_ts) AS a, max(dump_ts) AS b FROM gkg), t AS (SELECT unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS tick FROM lim),
gone AS (SELECT tick FROM t WHERE tick NOT IN (SELECT dump_ts FROM seen)), stop AS (SELECT coalesce(min(tick), TIMESTAMP '9999-01-01') AS s FROM gone WHERE tick > (SELECT b FROM lim) + INTERVAL 15 MINUTE - INTERVAL 90 MINUTE)
SELECT strftime(tick, '%Y%m%d%H%M%S') AS tick FROM t, stop WHERE tick < s AND tick IN (SELECT dump_ts FROM seen)""")
def w01_tick_source(spark: SparkSession, d: str) -> DataFrame:
    """The ticks that a stream of the dump takes from its cursor on, each once, over several batches, seen a quarter of an hour after the last one.

    Old ticks without a dump are passed over as holes; a young one ends the run.
    """
    g = table(spark, d, "gkg", "dump_ts").distinct()
    have = sorted(r.t for r in g.select(F.date_format("dump_ts", S.FORM.replace("%Y", "yyyy").replace("%m", "MM").replace("%d", "dd").replace("%H", "HH").replace("%M", "mm").replace("%S", "ss")).alias("t")).collect())  # one row a tick of the archive's days
    out = f"{shared_folder(spark)}/ticks-{uuid.uuid4().hex}"
    if not have:
        return spark.createDataFrame([], "tick string")
    first, last = (S.datetime.strptime(x, S.FORM) for x in (have[0], have[-1]))
    known = set(have)
    missing = [t for k in range((last - first) // S.STEP + 1) if (t := (first + k * S.STEP).strftime(S.FORM)) not in known]
    spark.dataSource.register(S.TickSource)
    options = {"cursor": (first - S.STEP).strftime(S.FORM), "latest": have[-1], "now": (last + S.STEP).strftime(S.FORM), "missing": ",".join(missing), "most": "960"}
    stream = spark.readStream.format("dump_ticks").options(**options).load()
    run = stream.writeStream.foreachBatch(S.once_per_batch(out)).option("checkpointLocation", f"{out}-offsets").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.schema("tick string").parquet(f"{out}/batch=*")


@query("SELECT batch_no, count(*) AS n FROM articles GROUP BY batch_no")
def w11_repeated_runs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each collection run after its batch reached the sink twice, the first time cut short."""
    a = articles(spark, d, "article_id", "batch_no")
    out = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    sink = S.once_per_batch(out)
    halves = [a.where("batch_no % 2 = 0"), a.where("batch_no % 2 <> 0 or batch_no is null")]
    sink(halves[0].where("article_id % 3 = 0"), 0)  # died half way
    for k, h in [*enumerate(halves), *enumerate(halves)]:
        sink(h, k)
    return spark.read.parquet(out).groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY importance DESC, article_id) AS r FROM (SELECT country, article_id, importance, length(coalesce(text, '')) AS n FROM articles WHERE importance > 5)),
t AS (SELECT * FROM r WHERE r <= 12 ORDER BY importance DESC, article_id LIMIT 100) SELECT country, article_id FROM (SELECT *, sum(n) OVER (ORDER BY importance DESC, article_id) AS run FROM t) WHERE run <= 120000""")
def w10_budget(spark: SparkSession, d: str) -> DataFrame:
    """What a run of limited means takes on: twelve articles a country, a hundred in all, 120 000 characters."""
    a = articles(spark, d, "country", "article_id", "importance", "text").where("importance > 5").select("country", "article_id", "importance", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return K.within_budget(a, "country", [F.desc("importance"), F.col("article_id")], 12, 100, "n", 120_000).select("country", "article_id")


@query("""SELECT p.page, string_agg(CASE WHEN gap THEN '…' || mid ELSE CAST(n + 1 AS VARCHAR) END, ' ' ORDER BY n, gap DESC) AS shown FROM (
  SELECT page, n, FALSE AS gap, 0 AS mid FROM w UNION ALL SELECT page, n, TRUE, before + ((n - before) >> 1) + 1 FROM (SELECT page, n, lag(n) OVER (PARTITION BY page ORDER BY n) AS before FROM w) WHERE n - before > 1) p GROUP BY p.page""".replace("FROM w", "FROM (SELECT DISTINCT page, n FROM (SELECT unnest(range(0, 40)) AS page), (SELECT unnest(range(0, 40)) AS n) WHERE n IN (0, 39, 25) OR abs(n - page) <= 1) w"))
def q08_pager(spark: SparkSession, d: str) -> DataFrame:
    """The numbers that a pager of forty pages shows on each page, one of them opened before, with the middle page behind every gap."""
    page, pages, opened = F.col("page"), 40, (25,)
    want = F.array_sort(F.array_distinct(F.filter(F.array(F.lit(0), F.lit(pages - 1), page - 1, page, page + 1, *map(F.lit, opened)), lambda n: (n >= 0) & (n < pages))))
    text = lambda n, k: F.concat(F.when((k > 0) & (n - F.get("w", k - 1) > 1), F.concat(F.lit("…"), (F.get("w", k - 1) + F.floor((n - F.get("w", k - 1)) / 2) + 1).cast("string"), F.lit(" "))).otherwise(""), (n + 1).cast("string"))
    rows = spark.range(pages).select(F.col("id").cast("int").alias("page")).withColumn("w", want)
    return rows.select(F.col("page").cast("long").alias("page"), F.array_join(F.transform("w", text), " ").alias("shown"))
