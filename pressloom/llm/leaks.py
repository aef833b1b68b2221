"""Problem 9: passages of evaluation items inside documents.

Size-partitioned MinHash containment search. A passage of `words` consecutive words is a set of
`words - shingle + 1` word shingles. Items are partitioned by size, class k holding those of 2**k to
2**(k + 1) passages' worth of shingles; in a class the share of an item that a document must contain, one passage
over the item, is known within a factor of two, and each class has a sketch table of its own: the MinHash of every window of
one passage of its items. A document is sketched the same way, by the minima of its windows (a seventh of its
shingles), so query and window sets are of equal size: a window that holds the passage has the same shingles, hence the
same minimum, and no containing document is lost. Every meeting of sketches is verified by exact
containment: the shingles of item and document around the common one must agree in a run of a whole passage.

The sketch tables travel with the tasks while they hold `most` passages at most, counted first;
beyond it they are joined by shuffle, each sketch with the shingles around it, and verified alike.

Edge cases: null and empty texts, items of fewer than `words` words and documents of fewer
match nothing; repeated passages and repeated items count once for each item_id; repeated
rows give one row; an empty table on either side gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """words: least run of item words that counts; shingle: words in a shingle; most: passages of all items
    up to which their sketches travel with the tasks (some 16 bytes each)."""

    words: int = 17
    shingle: int = 5
    most: int = 1_000_000

    @property
    def width(self) -> int:
        """Shingles of a passage."""
        return self.words - self.shingle + 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words, remembered by each task."""

    def __init__(self, most: int = 2_000_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def hashes(self, text: str) -> np.ndarray:
        import xxhash

        known = self.known
        # a dotted capital would fall apart into two words
        words = WORD.findall(text.lower().replace("i̇", "i"))
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.array([known[w] for w in words], dtype=np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of `k` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = mixed(h * MIX + words[j : j + n] + np.uint64(j + 1))
    return h


def minima(shingle: np.ndarray, width: int) -> np.ndarray:
    """MinHash of each window of `width` shingles."""
    if len(shingle) < width:
        return np.zeros(0, dtype=np.uint64)
    # the minimum over a window by doubling: a few passes whatever the width
    m, size = shingle, 1
    while size * 2 <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[: len(shingle) - width + 1], m[width - size :][: len(shingle) - width + 1])


def sketch(s: np.ndarray, width: int) -> np.ndarray:
    """Places of the shingles that are the minimum of some window of `width`."""
    least = np.unique(minima(s, width))
    return np.flatnonzero(np.isin(s, least)) if len(least) else np.zeros(0, dtype=np.int64)


def size_class(shingle_count: np.ndarray | int, width: int) -> np.ndarray:
    """0 for items of one to two passages of shingles, 1 for two to four, and so on."""
    return np.log2(np.maximum(shingle_count, width) / width).astype(np.int64)


def around(s: np.ndarray, at: np.ndarray, width: int, blank: int) -> np.ndarray:
    """The shingles up to one passage to both sides of each place; `blank` beyond the ends."""
    padded = np.concatenate([np.full(width - 1, blank, dtype=np.uint64), s, np.full(width - 1, blank, dtype=np.uint64)])
    return padded[at[:, None] + np.arange(2 * width - 1)]


def whole(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Do the shingles of each row agree in a run of `width` through the middle."""
    same = a == b
    left = np.cumprod(same[:, width - 1 :: -1], axis=1).sum(axis=1)
    right = np.cumprod(same[:, width - 1 :], axis=1).sum(axis=1)
    return left + right - 1 >= width


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(rows: DataFrame, key: str, blank: int, settings: Settings) -> DataFrame:
    """key, size, least, near: the sketch of each text with the shingles around."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, schema = Words(), pa.schema([(key, pa.int64()), ("size", pa.int32()), ("least", pa.int64()), ("near", pa.binary())])
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with np.errstate(over="ignore"):
                    s = shingles(words.hashes(text or ""), settings.shingle)
                at = sketch(s, settings.width)
                if len(at):
                    k = np.full(len(at), int(size_class(len(s), settings.width)), dtype=np.int32)
                    near = [x.tobytes() for x in around(s, at, settings.width, blank)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, dtype=np.int64)), pa.array(k), pa.array(_signed(s[at])), pa.array(near, pa.binary())], schema=schema)

    return rows.select(F.col(key).cast("long"), "text").mapInArrow(build, f"{key} long, size int, least long, near binary")


def leaks(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id: each document with a run of at least `words` words of an item; each once."""
    asked = sketches(items, "item_id", 1, settings).distinct()
    rows = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    if asked.count() > settings.most:
        return _leaks_by_shuffle(rows, asked, settings)
    known = asked.collect()  # counted above
    width = settings.width
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for k in sorted({r["size"] for r in known}):
        own = sorted((r for r in known if r["size"] == k), key=lambda r: r.least)
        near = np.frombuffer(b"".join(r.near for r in own), dtype=np.uint64).reshape(len(own), 2 * width - 1)
        classes[k] = np.array([r.least for r in own], dtype=np.int64).view(np.uint64), np.array([r.item_id for r in own], dtype=np.int64), near
    # unsigned order, as the documents' minima have it
    classes = {k: tuple(x[np.argsort(v[0], kind="stable")] for x in v) for k, v in classes.items()}
    del known

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            out: set[tuple[int, int]] = set()
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with np.errstate(over="ignore"):
                    s = shingles(words.hashes(text), settings.shingle)
                mins = np.unique(minima(s, width))
                if not len(mins):
                    continue
                for least, owner, near in classes.values():
                    lo, hi = np.searchsorted(least, mins, "left"), np.searchsorted(least, mins, "right")
                    for m in np.flatnonzero(hi > lo):
                        at = np.flatnonzero(s == mins[m])
                        mine = around(s, at, width, 0)
                        for q in range(lo[m], hi[m]):
                            if (i, int(owner[q])) not in out and whole(mine, near[q][None, :], width).any():
                                out.add((i, int(owner[q])))
            pairs = sorted(out)
            yield pa.RecordBatch.from_pydict({"doc_id": [p[0] for p in pairs], "item_id": [p[1] for p in pairs]}, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())]))

    return rows.mapInArrow(search, "doc_id long, item_id long").distinct()


def _leaks_by_shuffle(rows: DataFrame, asked: DataFrame, settings: Settings) -> DataFrame:
    """The same where the sketches are too many to travel."""
    width = settings.width
    mine = sketches(rows, "doc_id", 0, settings).select("doc_id", "least", F.col("near").alias("mine"))
    met = mine.join(asked.select("item_id", "least", "near"), "least").select("doc_id", "item_id", "mine", "near")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint64).reshape(b.num_rows, 2 * width - 1) for k in (2, 3))
            yield b.select(["doc_id", "item_id"]).filter(pa.array(whole(a, c, width)))

    return met.mapInArrow(verify, "doc_id long, item_id long").distinct()
