"""Scalars over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.functions import time as D
from pressloom.plans.oracle import NOW, entity_clean, host, outlet, squeezed, title_key
from pressloom.plans.registry import registry
from pressloom.plans.story_sql import clean_titles
from pressloom.settings import RESTRICTED
from pressloom.sources.tables import table

Q, SQL, query = registry()

#: Words of pages that report no event, in four languages.
NON_EVENT_WORDS = ["interview", "opinion", "editorial", "column", "analysis", "commentary", "explainer", "podcast", "интервью", "мнение", "колонка", "مقابلة", "رأي", "tribune", "éditorial"]
#: Marks of pages that keep robots out.
ANTI_BOT_MARKS = [
    "security service to protect", "verifies you are not a bot", "performing security verification", "triggered the security solution", "you have been blocked", "just a moment",
    "attention required", "checking your browser", "enable javascript and cookies", "cloudflare ray id", "are you a robot", "проверка безопасности",
]
_EDGE = "[^\\p{L}\\p{N}_]"
NON_EVENT = f"(^|{_EDGE})({'|'.join(NON_EVENT_WORDS)})($|{_EDGE})"
ANTI_BOT = "|".join(ANTI_BOT_MARKS)


def articles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "articles", *columns)


def now(df: DataFrame) -> DataFrame:
    """The one-row latest fetch time."""
    return F.broadcast(df.agg(F.max("fetched_at").alias("now")))


@query(f"SELECT article_id, sha1({title_key('title')}) AS hash FROM articles")
def t01_title_hash(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "title").select("article_id", T.title_hash(F.col("title")).alias("hash"))


@query("""SELECT article_id FROM (SELECT article_id, row_number() OVER (PARTITION BY title_hash ORDER BY batch_no, article_id) AS r FROM articles WHERE title_hash IS NOT NULL) WHERE r > 1""")
def t02_later_titles(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "batch_no", "title_hash").where("title_hash is not null")
    first = a.groupBy("title_hash").agg(F.min(F.struct("batch_no", "article_id")).alias("f")).select("title_hash", F.col("f.article_id").alias("first"))
    return a.join(first, "title_hash").where("article_id <> first").select("article_id")


@query("SELECT article_id, length(coalesce(text, '')) AS n, length(coalesce(text, '')) < 300 AS short FROM articles")
def t03_short(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    return articles(spark, d, "article_id", "text").select("article_id", n.alias("n"), (n < 300).alias("short"))


def _seen(sql: bool, n: int) -> object:
    if sql:
        return f"lower(coalesce(title, '')) || ' ' || lower(substr(coalesce(text, ''), 1, {n}))"
    return F.concat_ws(" ", F.lower(F.coalesce("title", F.lit(""))), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, n)))


@query(f"SELECT article_id FROM articles WHERE regexp_matches({_seen(True, 2000)}, '{NON_EVENT}')")
def t04_non_event(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "title", "text").where(_seen(False, 2000).rlike(NON_EVENT)).select("article_id")


@query(f"SELECT article_id FROM articles WHERE regexp_matches({_seen(True, 1500)}, '{ANTI_BOT}')")
def t05_anti_bot(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "title", "text").where(_seen(False, 1500).rlike(ANTI_BOT)).select("article_id")


@query("""SELECT name, ru, CASE WHEN regexp_matches(x, '[가-힯]') THEN 'ko' WHEN regexp_matches(x, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(x, '[一-鿿]') THEN 'zh-cn' END AS lang
FROM (SELECT *, coalesce(name, '') || CASE entity_id % 4 WHEN 1 THEN '서울' WHEN 2 THEN 'です' WHEN 3 THEN '北京' ELSE '' END AS x FROM entity_ru)""")
def t06_script_language(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("entity_id") % 4 == 1, "서울").when(F.col("entity_id") % 4 == 2, "です").when(F.col("entity_id") % 4 == 3, "北京").otherwise("")
    return table(spark, d, "entity_ru").select("name", "ru", T.script_language(F.concat(F.coalesce("name", F.lit("")), tail)).alias("lang"))


_COUNTS = ", ".join(f"{{'n': len(list_filter(w, lambda x: x IN ({', '.join(map(repr, v))}))), 'k': '{k}'}}" for k, v in sorted(T.COMMON.items()))


@query(f"""WITH t AS (SELECT article_id, substr({squeezed("coalesce(text, '')")}, 1, 2000) AS t FROM articles), w AS (SELECT *, regexp_extract_all(lower(t), '[\\p{{L}}]+') AS w FROM t),
c AS (SELECT article_id, t, list_reduce([{_COUNTS}], lambda a, b: CASE WHEN b.n > a.n THEN b ELSE a END) AS b FROM w)
SELECT article_id, CASE WHEN length(t) >= 80 THEN CASE WHEN regexp_matches(t, '[가-힯]') THEN 'ko' WHEN regexp_matches(t, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(t, '[一-鿿]') THEN 'zh-cn' WHEN b.n > 0 THEN b.k END END AS lang FROM c""")
def t07_detected_language(spark: SparkSession, d: str) -> DataFrame:
    """Language of every text: script first, then profiles of common words; none for short texts."""
    return articles(spark, d, "article_id", "text").select("article_id", T.detected_language(F.col("text")).alias("lang"))


@query("""SELECT article_id, coalesce(
  CASE WHEN length(regexp_replace(coalesce(text, ''), '[^А-Яа-яЁё]', '', 'g')) / CAST(greatest(length(coalesce(text, '')), 1) AS DOUBLE) > 0.3 THEN 'ru' END,
  CASE lower(split_part(trim(language), '-', 1)) WHEN '' THEN NULL WHEN 'he' THEN 'iw' ELSE lower(split_part(trim(language), '-', 1)) END, 'auto') AS code FROM articles""")
def t09_source_code(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "text", "language").select("article_id", T.source_code(F.col("text"), F.col("language")).alias("code"))


@query(f"SELECT url, {host('url')} AS host, {outlet('url')} AS outlet FROM gkg")
def t10_outlet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg", "url").select("url", T.host(F.col("url")).alias("host"), T.outlet(F.col("url")).alias("outlet"))


@query(f"SELECT article_id FROM articles WHERE {' OR '.join(f"{outlet('url')} = '{r}' OR ends_with({outlet('url')}, '.{r}')" for r in RESTRICTED)}")
def t11_restricted(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "url").where(T.in_domains(T.outlet(F.col("url")), RESTRICTED)).select("article_id")


@query("SELECT url, CASE WHEN regexp_matches(lower(trim(url)), '^https?://') THEN trim(url) ELSE '#' END AS safe FROM gkg")
def t12_safe_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg", "url").select("url", T.safe_url(F.col("url")).alias("safe"))


@query(f"WITH src AS (SELECT article_id AS id, title, {outlet('url')} AS domain FROM articles), {clean_titles('src')} SELECT id AS article_id, t AS title FROM clean")
def t13_clean_title(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "title", "url").select("article_id", T.clean_title(F.col("title"), T.outlet(F.col("url"))).alias("title"))


@query("""SELECT article_id, round(
  CASE WHEN l > 0 AND u / CAST(l AS DOUBLE) > 0.55 THEN 0.30 ELSE 0 END + CASE WHEN regexp_matches(rtrim(title), '(\\.\\.\\.|…)$') THEN 0.22 ELSE 0 END
  + CASE WHEN contains(title, '|') OR (length(title) - length(replace(title, ' - ', ''))) / 3 > 1 THEN 0.12 ELSE 0 END
  + CASE WHEN regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}_])(видео|фото|подкаст|галерея|онлайн|прямая трансляция)($|[^\\p{L}\\p{N}_])') THEN 0.15 ELSE 0 END
  + CASE WHEN ends_with(title, '?') THEN 0.08 ELSE 0 END + CASE WHEN NOT regexp_matches(lower(title), '[а-яёa-z]') THEN 0.5 ELSE 0 END, 6) AS flaws
FROM (SELECT *, length(regexp_replace(title, '[^\\p{L}]', '', 'g')) AS l, length(regexp_replace(title, '[^\\p{Lu}]', '', 'g')) AS u FROM articles WHERE title IS NOT NULL)""")
def t14_title_flaws(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "title").where("title is not null").select("article_id", F.round(T.title_flaws(F.col("title")), 6).alias("flaws"))


@query(f"SELECT entity_id, {entity_clean('name')} AS name FROM entity_ru")
def t15_entity_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_ru").select("entity_id", T.entity_clean(F.col("name")).alias("name"))


@query(f"""WITH n AS (SELECT gkg_id, min(pos) AS pos, name FROM (
  SELECT gkg_id, pos, {entity_clean('raw')} AS name FROM (
    SELECT gkg_id, unnest(string_split(concat_ws(';', v1p, v1o), ';')) AS raw, unnest(range(1, len(string_split(concat_ws(';', v1p, v1o), ';')) + 1)) AS pos FROM gkg)) WHERE name <> '' GROUP BY gkg_id, name)
SELECT g.gkg_id, coalesce(string_agg(n.name, ';' ORDER BY n.pos), '') AS cell FROM gkg g LEFT JOIN n USING (gkg_id) GROUP BY g.gkg_id""")
def t16_entity_cell(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg", "gkg_id", "v1p", "v1o").select("gkg_id", T.entity_cell(F.col("v1p"), F.col("v1o")).alias("cell"))


@query("""SELECT article_id, token, CASE WHEN t IN ('true', 'yes', 'y', 'да') THEN 100 WHEN t IN ('false', 'no', 'n', 'нет') THEN 0 WHEN try_cast(t AS DOUBLE) > 5 THEN 100 WHEN try_cast(t AS DOUBLE) <= 5 THEN 0 END AS v
FROM (SELECT *, lower(trim(token)) AS t FROM (SELECT article_id, CASE article_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'нет' WHEN 2 THEN CAST(importance AS VARCHAR) WHEN 3 THEN 'true ' WHEN 4 THEN 'maybe' ELSE '4.5' END AS token FROM articles))""")
def t17_verdict_token(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("article_id") % 6
    token = F.when(m == 0, " Yes").when(m == 1, "нет").when(m == 2, F.col("importance").cast("string")).when(m == 3, "true ").when(m == 4, "maybe").otherwise("4.5")
    return articles(spark, d, "article_id", "importance").select("article_id", token.alias("token")).withColumn("v", T.verdict(F.col("token")))


@query("""WITH b AS (SELECT article_id, CAST(ceil(n / 20.0) AS BIGINT) AS batch, CAST((n - 1) % 20 + 1 AS INT) AS place FROM (SELECT article_id, row_number() OVER (ORDER BY fetched_at, article_id) AS n FROM articles WHERE fetched_at IS NOT NULL))
SELECT batch, place, CASE WHEN article_id % 3 = 0 THEN 100 ELSE 0 END AS v FROM b WHERE article_id % 7 <> 0""")
def t18_judge_reply(spark: SparkSession, d: str) -> DataFrame:
    """A fenced reply for each batch of twenty is built and read back: the first JSON object alone, ids that were asked, known tokens."""
    from pressloom.operators.select import numbered_batches

    a = numbered_batches(articles(spark, d, "article_id", "fetched_at").where("fetched_at is not null"), "fetched_at", "article_id")
    token = F.when(F.col("article_id") % 7 == 0, "unsure").when(F.col("article_id") % 3 == 0, "yes").otherwise("no")
    pairs = F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("place").cast("string"), F.lit('": "'), token, F.lit('"'))), ", ")
    replies = a.groupBy("batch").agg(F.concat(F.lit("<think>so {}</think>```json\n{"), pairs, F.lit(', "99": "yes", "x": "no"}\n``` {"1": "unsure"}')).alias("reply"))
    read = replies.select("batch", F.explode(T.judged_ids(F.col("reply"), F.lit(20))).alias("x"))
    return read.select("batch", F.col("x.id").alias("place"), F.col("x.v").alias("v"))


@query("""SELECT article_id, trim(CASE WHEN contains(r, '</think>') THEN string_split(r, '</think>')[-1] WHEN contains(r, '<think>') THEN string_split(r, '<think>')[1] ELSE r END) AS reply
FROM (SELECT article_id, CASE article_id % 4 WHEN 0 THEN '<think>a</think>' WHEN 1 THEN '<think>a</think><think>b </think> ' WHEN 2 THEN 'kept <think>' ELSE '' END || coalesce(title, '') AS r FROM articles)""")
def t19_without_thoughts(spark: SparkSession, d: str) -> DataFrame:
    """Titles after closed, repeated and unclosed thoughts, and bare; what follows an unclosed one is no answer."""
    k = F.col("article_id") % 4
    lead = F.when(k == 0, "<think>a</think>").when(k == 1, "<think>a</think><think>b </think> ").when(k == 2, "kept <think>").otherwise("")
    return articles(spark, d, "article_id", "title").select("article_id", T.without_thoughts(F.concat(lead, F.coalesce("title", F.lit("")))).alias("reply"))


_MODELS = """(SELECT p_partkey % 3 AS provider, lower(replace(p_name, ' ', '-')) || CASE p_partkey % 5 WHEN 0 THEN '-mini' WHEN 1 THEN '-8b' ELSE '' END AS model, p_size * 1000 AS context FROM part)"""


@query(f"""SELECT provider, model, r FROM (SELECT provider, model, row_number() OVER (PARTITION BY provider ORDER BY context DESC, model DESC) AS r FROM (SELECT DISTINCT * FROM {_MODELS})
WHERE NOT regexp_matches(lower(model), 'lite|-8b|8b-|-4b|-3b|-1b|-mini|-small|nano')) WHERE r <= 5""")
def t20_model_pool(spark: SparkSession, d: str) -> DataFrame:
    """The five models of the longest context of each provider, weak ones left out; part names stand in for a provider's listing."""
    from pressloom.operators.ring import pool

    p = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    tail = F.when(F.col("p_partkey") % 5 == 0, "-mini").when(F.col("p_partkey") % 5 == 1, "-8b").otherwise("")
    return pool(p.select((F.col("p_partkey") % 3).alias("provider"), F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), tail).alias("model"), (F.col("p_size") * 1000).alias("context")).distinct())


@query("""SELECT days, CASE WHEN days % 7 = 0 AND days // 7 BETWEEN 1 AND 4 THEN ['неделю', 'две недели', 'три недели', 'четыре недели'][days // 7] ELSE days || ' ' || w END AS span, CASE WHEN days % 7 = 0 AND days // 7 BETWEEN 1 AND 4 THEN ['недели', 'двух недель', 'трёх недель', 'четырёх недель'][days // 7] ELSE days || ' ' || w END AS of_span
FROM (SELECT days, CASE WHEN days % 10 = 1 AND days % 100 <> 11 THEN 'день' WHEN days % 10 BETWEEN 2 AND 4 AND NOT days % 100 BETWEEN 12 AND 14 THEN 'дня' ELSE 'дней' END AS w FROM (SELECT unnest(range(1, 61)) AS days))""")
def t25_period_words(spark: SparkSession, d: str) -> DataFrame:
    days = spark.range(1, 61).select(F.col("id").alias("days"))
    return days.select("days", T.period_words(F.col("days"), 0).alias("span"), T.period_words(F.col("days"), 1).alias("of_span"))


@query("""SELECT article_id, CAST(k AS INT) AS k, s FROM (SELECT article_id, unnest(ss) AS s, unnest(range(0, len(ss))) AS k FROM (SELECT article_id, list_filter(list_transform(string_split(regexp_replace(substr(trim(regexp_replace(coalesce(text, ''), '[\\p{Z}\\s]+', ' ', 'g')), 1, 6000), '([.!?。！？；;])\\s*', '\\1\x01', 'g'), '\x01'), lambda x: trim(x)), lambda x: length(x) > 1)[1:60] AS ss FROM articles))""")
def t22_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences that a translator is given: of 6000 characters, sixty at most."""
    return articles(spark, d, "article_id", "text").select("article_id", F.posexplode(T.translation_sentences(F.col("text"))).alias("k", "s"))


@query("""SELECT article_id, CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 'статья' WHEN n % 10 BETWEEN 2 AND 4 AND NOT n % 100 BETWEEN 12 AND 14 THEN 'статьи' ELSE 'статей' END AS form
FROM (SELECT article_id, article_id AS n FROM articles)""")
def t23_plural(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id").select("article_id", T.plural_ru(F.col("article_id"), "статья", "статьи", "статей").alias("form"))


@query(f"""SELECT article_id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN CAST(m AS VARCHAR) || ' min' WHEN m < 1440 THEN CAST(m // 60 AS VARCHAR) || ' h' WHEN m < 10080 THEN CAST(m // 1440 AS VARCHAR) || ' d' ELSE strftime(fetched_at, '%d.%m') END AS age
FROM (SELECT article_id, fetched_at, greatest(0, CAST(floor((epoch_us({NOW}) - epoch_us(fetched_at)) / 60000000.0) AS BIGINT)) AS m FROM articles)""")
def t24_age_label(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "fetched_at")
    m = F.greatest(F.lit(0), F.floor((F.unix_micros("now") - F.unix_micros("fetched_at")) / 60_000_000))
    unit = lambda n, u: F.concat(n.cast("string"), F.lit(u))
    label = F.when(m < 1, "now").when(m < 60, unit(m, " min")).when(m < 1440, unit(F.floor(m / 60), " h")).when(m < 10080, unit(F.floor(m / 1440), " d")).otherwise(F.date_format("fetched_at", "dd.MM"))
    return a.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).crossJoin(now(a.select(F.col("fetched_at").cast("timestamp").alias("fetched_at")))).select("article_id", label.alias("age"))


@query("""SELECT country, array_to_string(list_transform(string_split(replace(country, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS shown FROM countries""")
def t26_country_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "countries").select("country", T.title_case(F.col("country")).alias("shown"))


@query("SELECT article_id, substr(coalesce(CASE WHEN trim(title_ru) <> '' THEN title_ru END, CASE WHEN trim(title_en) <> '' THEN title_en END, CASE WHEN trim(title) <> '' THEN title END, ''), 1, 300) AS shown FROM articles")
def t27_display(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "title", "title_en", "title_ru").select("article_id", T.display(F.col("title_ru"), F.col("title_en"), F.col("title")).alias("shown"))


@query("""SELECT article_id, lower(substr(coalesce(nullif(trim(language), ''), 'und'), 1, 2)) AS lang_code, coalesce(trim(title_ru) <> '', FALSE) AS translated, CASE WHEN coalesce(trim(title_ru) <> '', FALSE) THEN title END AS orig_title FROM articles""")
def t28_language_columns(spark: SparkSession, d: str) -> DataFrame:
    translated = F.coalesce(F.trim("title_ru") != "", F.lit(False))
    code = F.lower(F.substring(F.coalesce(F.when(F.trim("language") != "", F.trim("language")), F.lit("und")), 1, 2))
    return articles(spark, d, "article_id", "title", "language", "title_ru").select("article_id", code.alias("lang_code"), translated.alias("translated"), F.when(translated, F.col("title")).alias("orig_title"))


@query("""SELECT entity_id, CASE WHEN regexp_matches(name, '[А-Яа-яЁё]') THEN name ELSE array_to_string(list_transform(string_split(name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END AS shown
FROM (SELECT entity_id, ru AS name FROM entity_ru)""")
def t29_title_casing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_ru").select("entity_id", F.when(F.col("ru").rlike("[А-Яа-яЁё]"), F.col("ru")).otherwise(F.initcap("ru")).alias("shown"))


@query("SELECT entity_id, trim(regexp_replace(regexp_replace(name, '[\u200b\u200c\u200d\u2060\ufeff]', '', 'g'), '[\u00a0\u202f]', ' ', 'g')) AS name FROM entity_ru")
def t30_invisible(spark: SparkSession, d: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.regexp_replace("name", "[\u200b\u200c\u200d\u2060\ufeff]", ""), "[\u00a0\u202f]", " "))
    return table(spark, d, "entity_ru").select("entity_id", plain.alias("name"))


@query("SELECT article_id, epoch_us(coalesce(try_cast(t AS TIMESTAMP), try_strptime(regexp_extract(t, '^(\\d{4}-\\d{1,2}-\\d{1,2})', 1), '%Y-%m-%d'))) AS us FROM (SELECT article_id, replace(regexp_replace(trim(publish_date), '/', '-', 'g'), 'T', ' ') AS t FROM articles)")
def d01_stamp(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "publish_date").select("article_id", F.unix_micros(D.stamp(F.col("publish_date"))).alias("us"))


@query(f"""SELECT article_id, epoch_us(CASE WHEN length(trim(publish_date)) <= 10 AND CAST(t AS DATE) = CAST(fetched_at AS DATE) THEN fetched_at ELSE coalesce(t, fetched_at, {NOW}) END) AS us FROM (
  SELECT article_id, publish_date, fetched_at, coalesce(try_cast(t AS TIMESTAMP), try_strptime(regexp_extract(t, '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})', 1), '%Y-%m-%d')) AS t FROM (SELECT *, replace(regexp_replace(trim(publish_date), '/', '-', 'g'), 'T', ' ') AS t FROM articles))""")
def d03_published(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "publish_date", "fetched_at").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return a.crossJoin(now(a)).select("article_id", F.unix_micros(D.published(F.col("publish_date"), F.col("fetched_at"), F.col("now"))).alias("us"))


@query(f"""WITH t AS (SELECT unnest(generate_series(0, 13)) AS k), n AS (SELECT CAST(max(fetched_at) AS DATE) AS today FROM articles),
s AS (SELECT today - CAST(k AS INT) AS day, k FROM t, n), c AS (SELECT CAST(fetched_at AS DATE) AS day, count(*) AS n FROM articles GROUP BY 1)
SELECT CAST(s.day AS VARCHAR) AS day, coalesce(c.n, 0) AS n FROM s LEFT JOIN c ON c.day = s.day WHERE k <= greatest(coalesce((SELECT max(k) FROM s JOIN c ON c.day = s.day), 0), 0)""")
def d06_day_strip(spark: SparkSession, d: str) -> DataFrame:
    """Last 14 days, newest first, empty days at the old end cut, one day at least."""
    a = articles(spark, d, "fetched_at").select(F.to_date("fetched_at").alias("day"))
    counts = a.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    days = a.agg(F.max("day").alias("today")).select(F.posexplode(F.expr("transform(sequence(0, 13), k -> date_sub(today, k))")).alias("k", "day"))
    strip = days.join(counts, "day", "left")
    last = F.broadcast(strip.agg(F.coalesce(F.max(F.when(F.col("n").isNotNull(), F.col("k"))), F.lit(0)).alias("last")))
    return strip.crossJoin(last).where("k <= last").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""SELECT epoch_us(max(fetched_at)) AS last_us, count(*) FILTER (WHERE fetched_at > {NOW} - INTERVAL 24 HOUR) AS day_articles,
  count(DISTINCT country) FILTER (WHERE fetched_at > {NOW} - INTERVAL 24 HOUR) AS day_countries, max(fetched_at) > {NOW} + INTERVAL 2 HOUR - INTERVAL 3 HOUR AS live FROM articles""")
def d07_status(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline's state, seen two hours after the latest fetch; live while that is less than three hours ago."""
    a = articles(spark, d, "country", "fetched_at").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    fresh = F.col("fetched_at") > F.col("now") - F.expr("interval 24 hours")
    return a.crossJoin(now(a)).agg(F.unix_micros(F.max("fetched_at")).alias("last_us"), F.count_if(fresh).alias("day_articles"), F.count_distinct(F.when(fresh, F.col("country"))).alias("day_countries"), (F.max("fetched_at") > F.max("now") + F.expr("interval 2 hours") - F.expr("interval 3 hours")).alias("live"))


@query(f"SELECT article_id, round(0.35 + 0.65 * pow(0.5, greatest(a, 0) / 4.0), 6) AS fresh, round(1 - (0.35 + 0.65 * pow(0.5, greatest(a, 0) / 4.0)), 6) AS fade, round(greatest(0, least(1, 1 - log2(1 + greatest(a, 0) * 24 / 6.0) / log2(1 + 336 / 6.0))), 3) AS live FROM (SELECT article_id, (epoch_us({NOW}) - epoch_us(fetched_at)) / 86400000000.0 AS a FROM articles)")
def r05_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Freshness with its inverse (r06) and the log-hours bar (r14)."""
    a = articles(spark, d, "article_id", "fetched_at").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    aged = a.crossJoin(now(a)).withColumn("a", D.age_days(F.col("fetched_at"), F.col("now")))
    fresh = D.freshness(F.col("a"))
    return aged.select("article_id", F.round(fresh, 6).alias("fresh"), F.round(1 - fresh, 6).alias("fade"), F.round(D.live(F.col("a")), 3).alias("live"))


@query(f"SELECT DISTINCT key FROM (SELECT {squeezed('title')} AS key FROM articles WHERE title IS NOT NULL)")
def t00_squeezed(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "title").where("title is not null").select(T.squeezed(F.col("title")).alias("key")).distinct()
