"""Problem 7: missing or wrong language labels.

Cross-parsing entropy. For each language a suffix automaton of labelled text is built. A paragraph
is parsed against it into the longest pieces that the labelled text contains, from left to right; the
language whose text needs the fewest pieces, normalised by the logarithm of the automaton's text,
wins. Confidence is the margin to the next language.

The labelled text is a sample of at most `rows` articles for each language label, those with the
smallest hash of their id, cut to `characters` for each language. Labels may be wrong, so
each half of the sample is judged with the other half's automata and pieces that another
language explains better are left out.

Tasks parse many paragraphs at a time: the automata are dense tables, and one numpy step moves
all paragraphs and all languages on by one character.

Edge cases: null and empty texts and articles with residue get no row; lines that are no whole paragraph (menus,
headlines) are not judged; if an article has no whole paragraph its longest line that is not
of the page around decides; repeated rows give one row; an empty table gives no row; ties go to the language
first in the alphabet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm import residue
from pressloom.llm.blocks import parts
from pressloom.llm.furniture import LIST_ITEM, is_furniture, is_prose

LANGUAGES = ("de", "en", "es", "fr", "ru", "tr")
#: Three-letter codes and names of the languages.
CODES = {"deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "rus": "ru", "tur": "tr",
         "german": "de", "english": "en", "spanish": "es", "french": "fr", "russian": "ru", "turkish": "tr"}
NOT_LETTER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """rows: labelled articles of each language in the sample; characters: length of each
    language's text; block, cells: paragraphs, and their characters filled up to the longest, parsed at a time."""

    rows: int = 150
    characters: int = 14_000
    block: int = 1024
    cells: int = 2_000_000


def normal_code(label: Column) -> Column:
    """Two-letter language of a label; null for a blank one or `und`."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)", 1)
    return F.when(first.isin("", "und"), None).otherwise(F.coalesce(*(F.when(first == k, v) for k, v in CODES.items()), first))


def letters(text: str) -> str:
    """Lower case, one space for everything that is no letter."""
    return " " + NOT_LETTER.sub(" ", text.lower().replace("i̇", "i")).strip() + " "


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of each state; state 0 is the start."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in text:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return step


class Parser:
    """Suffix automata of all languages as one dense table."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.samples = samples
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"samples": self.samples, "table": None}

    def ready(self) -> None:
        if self.table is not None:
            return
        signs = sorted(set("".join(self.samples.values())))
        self.code = {c: k + 1 for k, c in enumerate(signs)}
        width, tables, self.start = len(signs) + 1, [], []
        at = 0
        for g in LANGUAGES:
            step = suffix_automaton(self.samples.get(g, ""))
            t = np.full((len(step), width), -1, dtype=np.int32)
            for s, nxt in enumerate(step):
                for c, q in nxt.items():
                    t[s, self.code[c]] = q + at
            tables.append(t)
            self.start.append(at)
            at += len(step)
        self.width, self.table = width, np.concatenate(tables).ravel()
        self.scale = np.array([1.0 / np.log2(len(self.samples.get(g, "")) + 2.0) for g in LANGUAGES])
        self.trans = {ord(c): k for c, k in self.code.items()}

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        return self.lookup[np.minimum(points, len(self.lookup) - 1)]

    @property
    def lookup(self) -> np.ndarray:
        if not hasattr(self, "_lookup"):
            self._lookup = np.zeros(0x3000, dtype=np.int32)
            for c, k in self.trans.items():
                if c < len(self._lookup):
                    self._lookup[c] = k
        return self._lookup

    def pieces(self, texts: list[str]) -> np.ndarray:
        """Normalised pieces a character of each text (rows) in each language (columns)."""
        self.ready()
        coded = [self.codes(letters(t)) for t in texts]
        order = sorted(range(len(coded)), key=lambda k: -len(coded[k]))
        size = np.array([len(coded[k]) for k in order])
        out = np.zeros((len(texts), len(LANGUAGES)))
        if not len(texts):
            return out
        grid = np.zeros((len(order), size[0]), dtype=np.int32)
        for r, k in enumerate(order):
            grid[r, : len(coded[k])] = coded[k]
        grid = np.ascontiguousarray(grid.T)
        roots = np.array(self.start, dtype=np.int32)
        state = np.tile(roots, (len(order), 1))
        count = np.ones((len(order), len(LANGUAGES)), dtype=np.int32)
        # the texts are sorted by length, so those still going are the first ones
        going = np.searchsorted(-size, -np.arange(size[0]), side="left")
        first = self.table.reshape(-1, self.width)[roots]
        for j in range(size[0]):
            n = going[j]
            c = grid[j, :n]
            new = self.table.take(state[:n] * self.width + c[:, None])
            lost = new < 0
            count[:n] += lost
            again = first[:, c].T
            state[:n] = np.where(lost, np.where(again < 0, roots, again), new)
        out[order] = count * np.ones_like(out) / (size[:, None] * self.scale)
        return out


def judged(rates: np.ndarray) -> list[tuple[str, float]]:
    """Language and confidence of each row of rates."""
    out = []
    for r in rates:
        order = np.argsort(r, kind="stable")
        out.append((LANGUAGES[order[0]], float(1 - r[order[0]] / r[order[1]]) if r[order[1]] > 0 else 0.0))
    return out


def labelled_sample(articles: DataFrame, settings: Settings = Settings()) -> dict[str, str]:
    """Cleaned labelled text of each language: a bounded sample, chosen by hash."""
    rows = articles.where("text is not null").select(normal_code(F.col("language")).alias("lang"), F.xxhash64("article_id").alias("h"), "text").where(F.col("lang").isin(*LANGUAGES))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return {g: "" for g in LANGUAGES}

    def some(g: str) -> DataFrame:
        # rows far above the sample's expected hash stay in their tasks
        share = min(1.0, 2.0 * settings.rows / counts[g] + 20 / counts[g])
        return rows.where((F.col("lang") == g) & (F.col("h") <= F.lit(min(2**63 - 1, int((2 * share - 1) * 2**63))))).orderBy("h").limit(settings.rows)

    union = reduce(DataFrame.unionByName, map(some, sorted(counts)))
    found = union.collect()
    pieces: dict[str, list[str]] = {g: [] for g in LANGUAGES}
    for r in found:
        pieces[r.lang] += [p for p in r.text.split("\n") if is_prose(p)]
    return purified(pieces, settings)


def purified(pieces: dict[str, list[str]], settings: Settings) -> dict[str, str]:
    """Joins the pieces of each language that the other half of the sample gives the same language."""
    halves = [{g: p[k::2] for g, p in pieces.items()} for k in (0, 1)]
    kept: dict[str, list[str]] = {g: [] for g in pieces}
    for k in (0, 1):
        other = Parser({g: "".join(map(letters, p))[: settings.characters // 2] for g, p in halves[1 - k].items()})
        for g, p in halves[k].items():
            if p:
                kept[g] += [x for x, (lang, _) in zip(p, judged(other.pieces(p)), strict=True) if lang == g]
    return {g: "".join(map(letters, p))[: settings.characters] for g, p in kept.items()}


def paragraphs(text: str) -> list[tuple[int, str]]:
    """Number and text of the whole paragraphs; of the longest own line where there is none."""
    lines = list(enumerate(text.split("\n"), 1))
    own = [(n, x) for n, x in lines if is_prose(x)]
    if not own:
        rest = [(n, x) for n, x in lines if len(x.strip()) >= 40 and not is_furniture(x) and not LIST_ITEM.match(x)]
        own = [max(rest, key=lambda y: len(y[1]))] if rest else []
    return own


def segments(articles: DataFrame, settings: Settings = Settings(), p1: residue.Settings = residue.Settings()) -> DataFrame:
    """article_id, line_no, characters, lang, confidence of each whole paragraph of articles without residue."""
    index, parser = residue.index_of(articles, p1), Parser(labelled_sample(articles, settings))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["article_id", "line_no", "characters", "lang", "confidence"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        held: list[tuple[int, int, str]] = []

        def out(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
            found = judged(parser.pieces([r[2] for r in rows]))
            cols = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [f[0] for f in found], [f[1] for f in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda r: len(r[2]))
            for a, b in parts([len(r[2]) for r in held], settings.block, settings.cells):
                yield out(held[a:b])

        waiting = 0
        for b in batches:
            for i, title, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if text and not index.residue(title, text):
                    held += [(i, n, x) for n, x in paragraphs(text)]
                    waiting += len(text)
                if len(held) >= 8 * settings.block or waiting > 8 * settings.cells:
                    yield from flush()
                    held, waiting = [], 0
        yield from flush()

    rows = articles.select(F.col("article_id").cast("long"), "title", "text")
    return rows.mapInArrow(judge, "article_id long, line_no int, characters int, lang string, confidence double")


def labels(articles: DataFrame, found: DataFrame) -> DataFrame:
    """article_id, label, main, langs, confidence, wrong: the main language by characters beside the stored label."""
    each = found.groupBy("article_id", "lang").agg(F.sum("characters").alias("n"), F.sum(F.col("confidence") * F.col("characters")).alias("c"))
    best = F.max(F.struct("n", "lang", "c"))
    main = each.groupBy("article_id").agg(best.alias("w"), F.sort_array(F.collect_set("lang")).alias("langs"), F.sum("n").alias("all"))
    # the share of the characters in the main language, each weighed by how sure its paragraph is
    main = main.select("article_id", F.col("w.lang").alias("main"), "langs", (F.col("w.c") / F.col("all")).alias("confidence"))
    stored = articles.select(F.col("article_id").cast("long").alias("article_id"), normal_code(F.col("language")).alias("label"))
    out = stored.distinct().join(main, "article_id")
    return out.select("article_id", "label", "main", "langs", "confidence", (F.col("label").isNull() | (F.col("label") != F.col("main"))).alias("wrong"))


def to_correct(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """article_id, lang: the languages of articles whose label is missing or wrong or that hold several."""
    judged_ = labels(articles, segments(articles, settings))
    return judged_.where(F.col("wrong") | (F.size("langs") > 1)).select("article_id", F.explode("langs").alias("lang")).distinct()
