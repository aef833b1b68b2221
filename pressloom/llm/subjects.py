"""Problem 2: subject areas of each article.

Curated terms are matched by a multi-pattern automaton in every whole paragraph of an article's
own text. A term weighs by its rarity over all articles, relative to the other terms
of its language, so that languages with few rows are not favoured. A paragraph is on
the subject whose terms weigh most, if they outweigh the next subject's by `margin`; its
score is that weight over the root of its number of sentences. An article's score for a subject is that of its best
paragraph on it, to which half the weight of the title's terms is added: a title supports a subject but makes none.
Every subject of at least `least` is assigned.

`margin` and `least` are fitted to hand labels: the pair of a small grid with the best F1 on at most `labels` labelled
articles, chosen by the hash of their id; one that is not better than the default by `gain` does not replace it, as a few labels are wrong.

Edge cases: null and empty texts, and articles with residue, get no row; headlines, menus and
teasers are no paragraphs; ties between two subjects in a paragraph decide for neither;
repeated rows give one row for each subject; an empty table gives no row; without labels the defaults hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm import residue
from pressloom.llm.furniture import SENTENCE_END, is_prose

TERMS = Path(__file__).with_name("subject_terms.txt")


@dataclass(frozen=True)
class Settings:
    """margin: by how much the first subject of a paragraph must outweigh the second; least: least
    score of an article's subject; margins, leasts: what fitting tries; labels: labelled articles it reads; gain: in F1, to leave the default."""

    margin: float = 1.5
    least: float = 0.25
    margins: tuple[float, ...] = (1.1, 1.2, 1.5, 2.0)
    leasts: tuple[float, ...] = (0.15, 0.25, 0.4, 0.6, 0.8)
    labels: int = 2_000
    gain: float = 0.005


def read_terms(path: Path | str = TERMS) -> dict[str, tuple[str, str]]:
    """term -> (subject, language)."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if line and not line.startswith("#"):
            subject, language, terms = line.split("\t")
            out.update((t, (subject, language)) for t in terms.split("|"))
    return out


def automaton(terms: dict[str, tuple[str, str]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def mentions(low: str, finder: ahocorasick.Automaton) -> Iterator[tuple[int, str]]:
    """Place and term of each match that begins and ends with a word; longest first, none overlapping."""
    for end, t in finder.iter_long(low):
        start = end + 1 - len(t)
        if not low[start - 1 : start].isalnum() and not low[end + 1 : end + 2].isalnum():
            yield start, t


def lowered(text: str) -> str:
    return text.lower().replace("i̇", "i").replace("'", "’")


def term_weights(articles: DataFrame, terms: dict[str, tuple[str, str]]) -> dict[str, float]:
    """Weight by rarity over all articles, 1 on average in its language; one row a term reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, seen = automaton(terms), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen[""] += 1
                if t:
                    seen.update({x for _, x in mentions(lowered(t), finder)})
        yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))

    rows = articles.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r.term: r.n for r in rows}
    n = df.pop("", 0)
    # smoothed, so that a handful of articles tells little about rarity
    raw = {t: math.log(1.0 + (n + 100.0) / (df.get(t, 0) + 10.0)) for t in terms}
    total: Counter[str] = Counter()
    number: Counter[str] = Counter()
    for t, (_, language) in terms.items():
        if df.get(t):
            total[language] += raw[t]
            number[language] += 1
    return {t: raw[t] * number[g] / total[g] if df.get(t) and total[g] > 0 else 1.0 for t, (_, g) in terms.items()}


Paragraph = tuple[int, Counter]


def weighed(passage: str, finder: ahocorasick.Automaton, terms: dict[str, tuple[str, str]], weight: dict[str, float]) -> Counter[str]:
    """Weight of each subject's terms in a passage."""
    own: Counter[str] = Counter()
    for _, t in mentions(lowered(passage), finder):
        own[terms[t][0]] += weight[t]
    return own


def paragraphs(text: str, finder: ahocorasick.Automaton, terms: dict[str, tuple[str, str]], weight: dict[str, float]) -> list[Paragraph]:
    """Sentences and weights of each whole paragraph with a term."""
    out = []
    for line in re.split(r"\n+", text):
        if is_prose(line) and (own := weighed(line, finder, terms, weight)):
            out.append((len(SENTENCE_END.findall(line)), own))
    return out


def scores(found: list[Paragraph], title: Counter[str], margin: float) -> dict[str, float]:
    """Score of each subject that some whole paragraph is on."""
    out: dict[str, float] = {}
    for sentences, own in found:
        (first, top), *rest = own.most_common(2)
        if not rest or top >= margin * rest[0][1]:
            out[first] = max(out.get(first, 0.0), top / math.sqrt(max(2, sentences)))
    return {s: x + title.get(s, 0.0) / 2 for s, x in out.items()}


def fitted(articles: DataFrame, labels: DataFrame | None, finder: ahocorasick.Automaton, terms: dict[str, tuple[str, str]], weight: dict[str, float], index: residue.Index, settings: Settings) -> Settings:
    """The settings with the thresholds that agree best with the labels."""
    if labels is None:
        return settings
    own = labels.where(F.col("slug").isNotNull()).groupBy(F.col("article_id").cast("long").alias("id")).agg(F.collect_set("slug").alias("slugs"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(settings.labels)
    rows = articles.select(F.col("article_id").cast("long").alias("id"), "title", "text").where(F.col("text").isNotNull()).join(F.broadcast(own), "id").collect()  # `labels` at most
    known = []
    for r in rows:
        if not index.residue(r.title, r.text):
            known.append((set(r.slugs), paragraphs(r.text, finder, terms, weight), weighed(r.title or "", finder, terms, weight)))

    def agreement(margin: float, least: float) -> float:
        both = ours = theirs = 0
        for slugs, found, title in known:
            got = {s for s, x in scores(found, title, margin).items() if x >= least}
            both, ours, theirs = both + len(got & slugs), ours + len(got), theirs + len(slugs)
        return 2 * both / (ours + theirs) if ours + theirs else 0.0

    base = agreement(settings.margin, settings.least)
    best, margin, least = max((agreement(m, x), m, x) for m in settings.margins for x in settings.leasts)
    return replace(settings, margin=margin, least=least) if best > base + settings.gain else settings


def assign(articles: DataFrame, labels: DataFrame | None = None, terms_path: Path | str = TERMS, settings: Settings = Settings(), p1: residue.Settings = residue.Settings()) -> DataFrame:
    """article_id, slug, score: the subjects of each article without residue."""
    terms = read_terms(terms_path)
    weight = term_weights(articles, terms)
    index = residue.index_of(articles, p1)
    settings = fitted(articles, labels, automaton(terms), terms, weight, index, settings)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton(terms)
        schema = pa.schema([("article_id", pa.int64()), ("slug", pa.string()), ("score", pa.float64())])
        for b in batches:
            rows = []
            for i, title, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if text and not index.residue(title, text):
                    found = scores(paragraphs(text, finder, terms, weight), weighed(title or "", finder, terms, weight), settings.margin)
                    rows += [(i, s, x) for s, x in sorted(found.items()) if x >= settings.least]
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema=schema)

    rows = articles.select(F.col("article_id").cast("long"), "title", "text")
    return rows.mapInArrow(search, "article_id long, slug string, score double").groupBy("article_id", "slug").agg(F.max("score").alias("score"))


def mix(assigned: DataFrame, subjects: DataFrame) -> DataFrame:
    """slug, title, articles, share: how the corpus is made up by subject."""
    counts = assigned.groupBy("slug").agg(F.count_distinct("article_id").alias("articles"))
    total = assigned.agg(F.count_distinct("article_id").alias("n"))
    out = subjects.select("slug", "title").join(counts, "slug", "left").crossJoin(F.broadcast(total))
    return out.select("slug", "title", F.coalesce("articles", F.lit(0)).alias("articles"), F.round(F.coalesce("articles", F.lit(0)) / F.greatest("n", F.lit(1)), 6).alias("share"))
