"""Extractive digests: sentences, shingles, word weights and a greedy choice in distributed rounds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import russian as L
from pressloom.functions import text as T
from pressloom.storage import cut

WORDS = r"[\p{L}\p{N}]+"


def sentences(text: Column) -> Column:
    """Sentences of a text in order, blank ones left out."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?…])\s+|\n+", "$1\x01"), "\x01")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def words(c: Column) -> Column:
    # a dotted capital would leave a lone mark behind
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(c, F.lit("")), "İ", "i")), F.lit(f"({WORDS})"), F.lit(1))


def shingles(w: Column, n: int = 4) -> Column:
    """Distinct runs of `n` words, joined by a space.

    Shifted copies are zipped, so that `w` is evaluated once for each shift and not for each run.
    """
    last = F.size(w) - n + 1
    shift = lambda k: F.slice(w, k, F.greatest(last, F.lit(0)))
    runs = shift(1)
    for k in range(2, n + 1):
        runs = F.zip_with(runs, shift(k), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def novelty(new: Column, known: Column) -> Column:
    """Share of new shingles that are not known; 0 where there are none."""
    return F.when(F.size(new) > 0, F.size(F.array_except(new, known)) / F.size(new)).otherwise(0.0)


def candidates(docs: DataFrame, head: int = 20) -> DataFrame:
    """story, url, pos, s: the first `head` sentences of each document, by sentence ends alone."""
    return docs.select("story", "url", F.posexplode(F.slice(sentences(F.col("text")), 1, head)).alias("pos", "s"))


def russian_sentences(docs: DataFrame) -> DataFrame:
    """story, url, domain, pos, s: the usable sentences of Russian texts (story, url, domain, text, title), each text parsed once."""
    schema = pa.schema([("story", pa.string()), ("url", pa.int64()), ("domain", pa.string()), ("pos", pa.int32()), ("s", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for story, url, domain, text, title in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text and re.search("[а-яё]", text, re.I):
                    rows += [(story, url, domain, k, s) for k, s in enumerate(L.sentences(text, title or ""))]
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema=schema)

    return docs.select(F.col("story").cast("string"), F.col("url").cast("long"), "domain", "text", "title").mapInArrow(parse, "story string, url long, domain string, pos int, s string")


def usual(parsed: DataFrame, stories: int = 4) -> DataFrame:
    """domain, fp: sentences that a site repeats in `stories` stories or more. Distinct first, so that counting is pre-aggregated."""
    each = parsed.select("domain", "story", T.fingerprint(F.col("s")).alias("fp")).distinct()
    return each.groupBy("domain", "fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= stories).select("domain", "fp")


def own_sentences(parsed: DataFrame, head: int = 20) -> DataFrame:
    """The first `head` sentences of each text less its site's usual ones; places are counted before those go."""
    named = parsed.where(F.col("pos") < head).withColumn("fp", T.fingerprint(F.col("s")))
    return named.join(usual(parsed), ["domain", "fp"], "left_anti").select("story", "url", "pos", "s")


def word_weights(cand: DataFrame) -> DataFrame:
    """story, word, weight: (c/n)(1 - c/(n+1)) of a word in c of the story's n sentences."""
    n = cand.groupBy("story").agg(F.count(F.lit(1)).alias("n"))
    c = cand.select("story", F.explode(F.array_distinct(words(F.col("s")))).alias("word")).groupBy("story", "word").agg(F.count(F.lit(1)).alias("c"))
    return c.join(n, "story").select("story", "word", (F.col("c") / F.col("n") * (1 - F.col("c") / (F.col("n") + 1))).alias("weight"))


def scored(cand: DataFrame) -> DataFrame:
    """The candidates with `score`: weight of their words over the root of their number, more for the first two sentences."""
    exploded = cand.select("story", "url", "pos", F.size(F.array_distinct(words(F.col("s")))).alias("k"), F.explode(F.array_distinct(words(F.col("s")))).alias("word"))
    total = exploded.join(word_weights(cand), ["story", "word"]).groupBy("story", "url", "pos").agg((F.sum("weight") / F.sqrt(F.first("k"))).alias("base"))
    lead = F.when(F.col("pos") == 0, 1.3).when(F.col("pos") == 1, 1.1).otherwise(1.0)
    return cand.join(total, ["story", "url", "pos"]).withColumn("score", F.col("base") * lead).drop("base")


def digest(cand: DataFrame, want: int = 3, most: int = 560, overlap: float = 0.28) -> DataFrame:
    """story, k, url, s: up to `want` of the candidate sentences of each story, in reading order.

    The best of the first two sentences of any text leads, else the best of all. Then the best sentence of an unused source follows, and
    where there is none of any source, if it fits into `most` characters and shares at most `overlap` of its shingles with those
    chosen. Each choice is one aggregation over all stories; what is kept between choices is bounded by `want`.
    """
    c = cut(scored(cand).withColumn("sh", shingles(words(F.col("s")))).where(F.size("sh") > 0))
    key = F.struct(F.round("score", 9), F.col("url"), -F.col("pos"))
    pick = F.struct("url", "pos", "s", "sh")
    state = c.groupBy("story").agg(F.max_by(pick, F.struct(F.col("pos") <= 1, key)).alias("w")).select("story", F.array(F.struct("w.url", "w.pos", "w.s")).alias("out"), F.col("w.sh").alias("seen"), F.length("w.s").alias("total"))
    for _ in range(want - 1):
        state = cut(state)
        fits = (F.col("total") + F.length("s") <= most) & (F.size(F.array_intersect("sh", "seen")) <= F.size("sh") * overlap)
        fresh = ~F.array_contains(F.transform("out", lambda x: x["url"]), F.col("url"))
        step = c.join(state, "story").where(fits).groupBy("story").agg(F.max_by(pick, F.struct(fresh, key)).alias("w"))
        grown = state.join(step, "story", "left")
        state = grown.select("story", F.when(F.col("w").isNull(), F.col("out")).otherwise(F.concat("out", F.array(F.struct("w.url", "w.pos", "w.s")))).alias("out"), F.when(F.col("w").isNull(), F.col("seen")).otherwise(F.array_union("seen", F.col("w.sh"))).alias("seen"), (F.col("total") + F.coalesce(F.length("w.s"), F.lit(0))).alias("total"))
    rest = F.transform(F.array_sort(F.transform(F.slice("out", 2, want), lambda x, i: F.struct((x["pos"] != 0).alias("a"), x["pos"].alias("b"), i.alias("k"), x.alias("x")))), lambda y: y["x"])
    return state.select("story", F.posexplode(F.concat(F.slice("out", 1, 1), rest)).alias("k", "x")).select("story", "k", "x.url", "x.s")


def longest_matches(rows: DataFrame, glossary: DataFrame, most_words: int | None = None) -> DataFrame:
    """id, start, size, name, ru: non-overlapping glossary phrases of `text`, the longest first at each word.

    `glossary`: name (lower case, words by one space), ru. Runs of words are joined with the glossary, so it may
    be of any size; what overlaps is settled within one text. Runs are as long as the glossary's longest phrase (`most_words` where it is known).
    """
    if most_words is None:
        most_words = glossary.agg(F.max(F.size(F.split("name", " "))).alias("n")).first().n or 1
    w = rows.select("id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(i.alias("start"), n.alias("size"), F.when(i + n - 1 <= F.size("w"), F.array_join(F.slice("w", i, n), " ")).alias("name")))))
    met = w.select("id", F.explode(runs).alias("r")).select("id", "r.*").where("name is not null").join(glossary.select("name", "ru").groupBy("name").agg(F.min("ru").alias("ru")), "name")
    order = F.array_sort(F.collect_list(F.struct("start", (-F.col("size")).alias("less"), "name", "ru")))
    start = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<start:int,less:int,name:string,ru:string>>)").alias("kept"))
    kept = F.aggregate(order, start, lambda s, x: F.when(x["start"] > s["end"], F.struct((x["start"] - x["less"] - 1).alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s))
    return met.groupBy("id").agg(kept.alias("k")).select("id", F.explode("k.kept").alias("m")).select("id", F.col("m.start").alias("start"), (-F.col("m.less")).alias("size"), "m.name", "m.ru")



def tail(lines: DataFrame, most_lines: int = 2, most: int = 300) -> DataFrame:
    """story, k, s, domains: the first lines of each overview (story, k, s, domains) that fit; the first always does."""
    first = lines.where(F.col("k") < most_lines)
    run = F.sum(F.length("s")).over(Window.partitionBy("story").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("run", run).where((F.col("k") == 0) | (F.col("run") <= most)).drop("run")


def story_keys(docs: DataFrame) -> DataFrame:
    """story, key: sha1 over the story's distinct urls in order."""
    return docs.groupBy("story").agg(F.sha1(F.concat(F.array_join(F.array_sort(F.collect_set(F.col("url").cast("string"))), "\n"), F.lit("\n"))).alias("key"))


def prior(stories: DataFrame, url_map: DataFrame) -> DataFrame:
    """key, old_key, shared: of the stored overviews the one that covers most urls of a story (key, url); ties go to the smaller key."""
    c = stories.join(url_map.select("url", F.col("key").alias("old_key")), "url").groupBy("key", "old_key").agg(F.count(F.lit(1)).alias("shared"))
    return c.groupBy("key").agg(F.min(F.struct((-F.col("shared")).alias("less"), "old_key")).alias("w")).select("key", "w.old_key", (-F.col("w.less")).alias("shared"))


def resolved(docs: DataFrame, made: DataFrame, stored: DataFrame, url_map: DataFrame, least: float = 0.55) -> DataFrame:
    """key, lines, added: the overview that each story shows.

    `docs`: key, url, text; `made`: key, lines (null where nothing was made); `stored`: key, lines, added. A stored overview of the same key
    is shown as it is. Else what was made is shown, unless an earlier overview covers some of the urls and no new text has `least` new shingles
    against the known ones: then the earlier lines stay. Shingles are compared by joins, so no story is collected.
    """
    hit = made.select("key").join(stored, "key")
    todo = made.where("lines is not null").join(stored.select("key"), "key", "left_anti")
    old = prior(docs.select("key", "url"), url_map).join(stored.select(F.col("key").alias("old_key"), F.col("lines").alias("old_lines"), F.col("added").alias("old_added")), "old_key")
    todo = todo.join(old, "key", "left")
    known = url_map.select("url", F.col("key").alias("old_key"), F.lit(True).alias("known"))
    sh = docs.join(todo.where("old_key is not null").select("key", "old_key"), "key").join(known, ["old_key", "url"], "left").select("key", "url", F.coalesce("known", F.lit(False)).alias("known"), F.explode(shingles(words(F.col("text")))).alias("sh"))
    sh = cut(sh)
    base = sh.where("known").select("key", "sh").distinct()
    fresh = sh.where("not known").join(base.withColumn("old", F.lit(1)), ["key", "sh"], "left").groupBy("key", "url").agg((1 - F.count("old") / F.count(F.lit(1))).alias("novelty"))
    novel = fresh.groupBy("key").agg(F.max("novelty").alias("novelty")).join(base.select("key").distinct(), "key", "left_semi")
    j = todo.join(novel, "key", "left").withColumn("new", F.coalesce(F.col("novelty") >= least, F.lit(False)))
    out = j.select("key", F.when(F.col("old_key").isNull() | F.col("new"), F.col("lines")).otherwise(F.col("old_lines")).alias("lines"), (F.col("new") | F.coalesce("old_added", F.lit(False))).alias("added"))
    return out.unionByName(hit.select("key", "lines", "added"))
