"""A dictionary of phrases over texts: longest matches, markers, renderings in case, prompt lines and whole translations.

The dictionary is counted before it is sent to the tasks, as an automaton's table; beyond `most` phrases its words' first keys are
joined by shuffle instead, with runs as long as its longest phrase.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import russian as L
from pressloom.functions.text import phrase_key
from pressloom.operators.digest import longest_matches

TOKEN = re.compile(r"[^\W_]+")
MARK = re.compile(r"XX(\d+)XX")
#: key -> (rendering, mode, gloss)
Phrases = dict[str, tuple[str, str, str]]


def phrases(entries: DataFrame) -> DataFrame:
    """name, ru, mode, gloss: one entry a key, the smallest rendering of several."""
    e = entries.select(phrase_key(F.col("name")).alias("name"), "ru", "mode", F.coalesce("gloss", F.lit("")).alias("gloss")).where("name <> '' and ru <> ''")
    return e.groupBy("name").agg(F.min(F.struct("ru", "mode", "gloss")).alias("w")).select("name", "w.*")


class Finder:
    """Longest non-overlapping phrases of a text."""

    def __init__(self, known: Phrases) -> None:
        self.known = known
        self.longest = max((k.count(" ") + 1 for k in known), default=0)
        # the sizes that occur behind a first word: most words begin no phrase
        self.sizes: dict[str, list[int]] = {}
        for k in known:
            w = k.split(" ")
            self.sizes.setdefault(w[0], []).append(len(w))
        self.sizes = {k: sorted(set(v), reverse=True) for k, v in self.sizes.items()}

    def find(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(start, end, number of the first word, words, key) in order."""
        tokens = [(m.start(), m.end(), m.group().lower().replace("i̇", "i")) for m in TOKEN.finditer(text or "")]
        out, k = [], 0
        while k < len(tokens):
            for n in self.sizes.get(tokens[k][2], ()):
                key = " ".join(t[2] for t in tokens[k : k + n])
                if k + n <= len(tokens) and key in self.known:
                    out.append((tokens[k][0], tokens[k + n - 1][1], k + 1, n, key))
                    k += n
                    break
            else:
                k += 1
        return out

    def protect(self, text: str, subs: dict[str, str]) -> str:
        """Phrases to keep behind markers, which `subs` collects."""
        out, at = [], 0
        for a, b, _, _, key in self.find(text):
            ru, mode, _ = self.known[key]
            if mode == "keep":
                mark = f"XX{len(subs) + 1}XX"
                subs[mark] = ru
                out += [text[at:a], mark]
                at = b
        return "".join([*out, text[at:]])

    def mended(self, text: str) -> str:
        """Phrases that a translation left in their own letters, by their rendering in the case that is called for."""
        for a, b, _, _, key in reversed(self.find(text)):
            ru, mode, _ = self.known[key]
            if mode == "ru":
                text = text[:a] + L.inflected(ru, L.case_before(text, a)) + text[b:]
        return text

    def prompt(self, text: str, most: int = 60) -> str:
        """A line for each phrase of the text, in order, each once."""
        lines = []
        for key in dict.fromkeys(x[4] for x in self.find(text)):
            ru, mode, gloss = self.known[key]
            lines.append(f'  "{key}" -> {ru if mode == "ru" else ru + " (keep Latin script)"}' + (f" — {gloss}" if gloss else ""))
        return "\n".join(lines[:most])


def hide_unknown(text: str, subs: dict[str, str], known: Callable[[str], bool]) -> str:
    """Chunks with a letter that the translator's vocabulary lacks behind markers, counted on from `subs`; an English possessive is cut off."""

    def mark(m: re.Match) -> str:
        if all(c.isascii() or known(c) for c in m.group()):
            return m.group()
        name = f"XX{len(subs) + 1}XX"
        subs[name] = re.sub(r"['’]s$", "", m.group())
        return name

    return re.sub(r"[^\s.,;:!?()\[\]«»\"]+", mark, text)


def put_back(text: str, subs: dict[str, str], bearable: float = 0.34) -> tuple[str, bool]:
    """The text with its markers' names, and whether the share of lost ones is bearable and none is left over."""
    if not subs:
        return text, True
    found = set(MARK.findall(text))
    ok = len(subs) - len(found) <= bearable * len(subs) and len(found) <= len(subs)
    # the longest markers first, so XX1XX never cuts XX11XX
    for mark in sorted(subs, key=len, reverse=True):
        text = text.replace(mark, subs[mark])
    left = MARK.search(text)
    return MARK.sub("", text), ok and not left


def translated(title: str, text: str, finder: Finder, model: Callable[[list[str]], list[str]], known: Callable[[str], bool]) -> tuple[str, str, str]:
    """Title and text by a sentence model, with protected names; without protection where too many markers were lost."""

    def run(protect: bool) -> tuple[list[str], bool]:
        parts, subs = [], []
        for t in (title, text):
            own: dict[str, str] = {}
            t = t or ""
            parts.append(sentences(hide_unknown(finder.protect(t, own), own, known) if protect else t))
            subs.append(own)
        out = model(parts[0] + parts[1])
        back = [put_back(" ".join(out[: len(parts[0])]), subs[0]), put_back(" ".join(out[len(parts[0]) :]), subs[1])]
        return [b[0] for b in back], all(b[1] for b in back)

    shown, ok = run(True)
    if not ok:
        shown, _ = run(False)
    return finder.mended(shown[0]), finder.mended(shown[1]), "model" if ok else "model/unprotected"


def sentences(text: str, characters: int = 6000, most: int = 60) -> list[str]:
    t = " ".join(text.split())[:characters]
    return [s.strip() for s in re.split(r"(?<=[.!?。！？；;])\s*", t) if len(s.strip()) > 1][:most] or ([t] if t else [])


def over_texts(rows: DataFrame, entries: DataFrame, schema: str, each: Callable[[Finder, dict], Iterator[tuple] | list[tuple]], most: int = 500_000) -> DataFrame:
    """`each` applied to every row with the finder of all entries. Refused where the dictionary is too large to be sent."""
    found = phrases(entries).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a dictionary of more than {most} phrases; use longest_matches, which joins them")
    known = rows.sparkSession.sparkContext.broadcast({r.name: (r.ru, r["mode"], r.gloss) for r in found})
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(known.value)
        for p in frames:
            yield pd.DataFrame([x for r in p.to_dict("records") for x in each(finder, r)], columns=names)

    return rows.mapInPandas(run, schema)


def matches(rows: DataFrame, entries: DataFrame, most: int = 500_000) -> DataFrame:
    """id, start, size, name, ru of the phrases in (id, text): by a finder in each task, or by a join where the dictionary is larger than `most`."""
    if phrases(entries).limit(most + 1).count() > most:
        return longest_matches(rows, phrases(entries))

    def each(finder: Finder, r: dict) -> list[tuple]:
        return [(r["id"], k, n, key, finder.known[key][0]) for _, _, k, n, key in finder.find(r["text"])]

    return over_texts(rows, entries, "id long, start int, size int, name string, ru string", each, most)
