"""Problem 1: template residue, filler and error pages.

Labelled exemplars are kept in an inverted index (rare term -> exemplars). A passage
window (a line, a sentence, a part of the title) that holds a term of an exemplar's prefix of rare
terms is compared with it by TF-IDF containment both ways: the share of the
exemplar's weight found in the window and the share of the window's weight that the
exemplar explains; a reworded window is compared with all exemplars of a kind together. Term weights come from document frequencies counted over all rows.

An unfilled hole is a window of its own whose one term is its shape, looked up in the same index; the words
around a hole are compared with exemplars labelled as mere mentions.

Edge cases: a null title or text counts as empty; an article with neither is no case;
duplicate rows give one row for each `article_id`; an empty table gives no row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm import exemplars

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?…])[”»\"]?\s+|\n+")
#: Parts of a title; the name of the page in its url may stand at the end.
TITLE_PART = re.compile(r"\s+[|–—-]\s+|:\s+|\s+·\s+|\s*[()]\s*|\s+(?=[a-z0-9]+(?:-[a-z0-9]+)+$)")
#: Paths, codes and names of pages in urls, which differ from page to page.
CODE = re.compile(r"/[\w./-]+|\b\w+(?:-\w+){3,}|\b(?=\w*\d)(?=\w*[a-z])[a-z0-9]{5,}\b")
DIGITS = re.compile(r"\d+")
#: A character or word without which no hole is there.
HOLE_HINT = re.compile(r"[{\[<#@_%]|&lt;|undefined|TKTK")
HOLE = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^\n]{0,80}?%\}|\$\{[^{}\n]{0,60}\}|\{\$?[\w.]{0,60}\}|%%\w{1,60}%%|\[\[[^\[\]\n]{1,80}\]\]"
    r"|<%[^\n]{1,80}?%>|<<[^<>\n]{1,60}>>?|#[A-Z][A-Z0-9_]{2,60}#|@@\w{1,60}@@|__[A-Z][A-Z0-9_]{2,60}?__|%\(\w{1,60}\)[sdf]"
    r"|\[(?:INSERT|ADD|YOUR)\b[^\]\n]{0,80}\]|\[(?:(?:FIRST|LAST|FULL|USER) ?NAME|NAME|TITLE|HEADLINE|AUTHOR|CITY|COMPANY|DATE|TEXT|LINK|URL)\]|(?:<|&lt;)INSERT\b[^<>&\n]{0,60}(?:>|&gt;)|\[object \w+\]|\bundefined\b|\bTK(?:TK)+\b"
)
INNER = re.compile(r"[\w.%=$ ]+")


@dataclass(frozen=True)
class Settings:
    """contained: least share of the exemplar's weight in the window; covered: least share of
    the window's weight explained; mention: share of a mention's weight around a hole from
    which the hole is only talked about; around: words on each side of a hole; together: share of the window's weight that
    all exemplars of one kind must explain where no single one does, with `rare` of their rarer terms (half the greatest weight)."""

    contained: float = 0.6
    covered: float = 0.7
    mention: float = 0.5
    around: int = 9
    together: float = 0.66
    rare: int = 3


def shape(hole: str) -> str:
    """A hole without the name inside: `{{author}}` and `{{ lead }}` have one shape."""
    return hole if hole[0].isalpha() else INNER.sub("·", hole.replace("INSERT", "!").lower())


def terms(passage: str) -> list[str]:
    """Words in lower case, digits read as one digit, holes as their shape; paths and codes left out."""
    passage = CODE.sub(" ", passage)
    if HOLE_HINT.search(passage):
        out, at = [], 0
        for m in HOLE.finditer(passage):
            out += [DIGITS.sub("0", w) for w in WORD.findall(passage[at : m.start()].lower())] + [shape(m.group())]
            at = m.end()
        return out + [DIGITS.sub("0", w) for w in WORD.findall(passage[at:].lower())]
    return [DIGITS.sub("0", w) for w in WORD.findall(passage.lower())]


def passages_of(exemplar: str) -> list[str]:
    return [p for p in SENTENCE.split(exemplar) if p]


def vocabulary() -> frozenset[str]:
    """Every term of an exemplar; bounded by the exemplar lists."""
    lists = (exemplars.SCRIPTS, exemplars.ERRORS, exemplars.FILLER, exemplars.MENTIONS)
    return frozenset(t for e in lists for x in e for t in terms(x))


def document_frequencies(articles: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and rows holding each exemplar term, over the whole table.

    Each task counts before the shuffle; at most one row a term reaches the driver.
    """
    known = vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen[""] += 1
                if text:
                    seen.update(known.intersection(WORD.findall(text.lower())))
        yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))

    rows = articles.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r.term: r.n for r in rows}
    return counts.pop("", 0), counts


class Index:
    """Exemplars by their rare terms, with the weights of all terms."""

    def __init__(self, n: int, df: dict[str, int], settings: Settings = Settings()) -> None:
        self.settings, self.unknown, self.rows = settings, math.log(n + 2.0), n
        self.weight = {t: math.log((n + 2.0) / (df.get(t, 0) + 1.0)) for t in vocabulary()}
        self.exemplars: list[tuple[frozenset[str], float, bool]] = []
        self.postings: dict[str, list[int]] = {}
        self.kinds: list[frozenset[str]] = []
        for kind in (exemplars.SCRIPTS, exemplars.ERRORS, exemplars.FILLER):
            self.kinds.append(frozenset(t for text in kind if len(text) < 300 for t in terms(text)))
            for text in kind:
                # the words of one long filler text may come in any order and number
                loose = kind is exemplars.FILLER and len(text) > 300
                for part in [text] if loose else {text, *passages_of(text)}:
                    own = frozenset(terms(part))
                    self.exemplars.append((own, sum(map(self.w, own)), loose))
                    for t in [t for t in own if len(t) > 4] if loose else self.prefix(own):
                        self.postings.setdefault(t, []).append(len(self.exemplars) - 1)
        # a hole is a window of its own, of one term: its shape
        for h in exemplars.HOLES:
            own = frozenset([shape(h)])
            self.exemplars.append((own, sum(map(self.w, own)), False))
            self.postings.setdefault(shape(h), []).append(len(self.exemplars) - 1)
        self.mentions = [(own, sum(map(self.w, own))) for own in (frozenset(terms(m)) for m in exemplars.MENTIONS)]
        self.terms = frozenset(t for t in self.postings if t.isalpha())
        self._finder = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_finder": None}

    @property
    def finder(self) -> ahocorasick.Automaton:
        """Finds the posting terms in a text; built once in each process."""
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for t in self.terms:
                self._finder.add_word(t, len(t))
            self._finder.make_automaton()
        return self._finder

    def prefix(self, own: frozenset[str]) -> list[str]:
        """The heaviest terms, such that what is left falls short of `contained`: no window that reaches it lacks them all.

        Digits and holes stand in a text otherwise than as their term, so they are no postings.
        """
        out, total = [], sum(map(self.w, own))
        left = total
        for t in sorted((t for t in own if t.isalpha()), key=lambda t: (-self.w(t), t)):
            if left < self.settings.contained * total - 1e-9:
                break
            out.append(t)
            left -= self.w(t)
        return out

    def w(self, t: str) -> float:
        return self.weight.get(t, self.unknown)

    def covered(self, passage: str) -> bool:
        """Is the window explained by one exemplar?"""
        own = set(terms(passage))
        found = {e for t in own if t in self.postings for e in self.postings[t]}
        if not found:
            return False
        mass = sum(map(self.w, own))
        for e in found:
            which, total, loose = self.exemplars[e]
            both = sum(map(self.w, own & which))
            if both >= self.settings.covered * mass and (len(own & which) >= 4 if loose else both >= self.settings.contained * total):
                return True
        # reworded residue: no exemplar alone, but those of its kind together
        for kind in self.kinds:
            both = own & kind
            if sum(map(self.w, both)) >= self.settings.together * mass and sum(t.isalpha() and self.w(t) >= self.unknown / 2 for t in both) >= self.settings.rare:
                return True
        return False

    def open_hole(self, text: str) -> bool:
        """Is there a hole, outside sentences that only talk about one?"""
        if not HOLE_HINT.search(text):
            return False
        for m in HOLE.finditer(text):
            s = shape(m.group())
            if not self.covered(m.group()):
                continue
            n = self.settings.around
            near = {*WORD.findall(text[max(0, m.start() - 200) : m.start()].lower())[-n:], s, *WORD.findall(text[m.end() : m.end() + 200].lower())[:n]}
            if not any(s in own and sum(map(self.w, own & near)) >= self.settings.mention * total for own, total in self.mentions):
                return True
        return False

    def residue(self, title: str | None, text: str | None) -> bool:
        """Does the title or text hold residue?"""
        title, text = title or "", text or ""
        if self.open_hole(title) or self.open_hole(text):
            return True
        if title and self.terms.intersection(terms(title)) and any(map(self.covered, (title, *TITLE_PART.split(title)))):
            return True
        if not text:
            return False
        low = text.lower()
        last = -1
        for end, size in self.finder.iter(low):
            # only the line around a posting is looked at, and each line once
            start = end + 1 - size
            if start < last or low[start - 1 : start].isalnum() or low[end + 1 : end + 2].isalnum():
                continue
            a, b = low.rfind("\n", 0, start) + 1, low.find("\n", end)
            last = b if b >= 0 else len(low)
            line = low[a:last]
            parts = [p for p in SENTENCE.split(line) if p]
            if self.covered(line) or len(parts) > 1 and any(map(self.covered, parts)):
                return True
        return False


def index_of(articles: DataFrame, settings: Settings = Settings()) -> Index:
    """The exemplar index weighted by the table's own document frequencies."""
    return Index(*document_frequencies(articles), settings)


def find_residue(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """article_id of each article with residue; one row for each id."""
    index = index_of(articles, settings)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, titles, texts = (b.column(k).to_pylist() for k in range(3))
            found = [i for i, title, text in zip(ids, titles, texts, strict=True) if index.residue(title, text)]
            yield pa.RecordBatch.from_pydict({"article_id": found}, schema=pa.schema([("article_id", pa.int64())]))

    rows = articles.select(F.col("article_id").cast("long"), "title", "text")
    return rows.mapInArrow(search, "article_id long").distinct()


def without_residue(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The articles that can be kept."""
    return articles.join(find_residue(articles, settings), "article_id", "left_anti")
