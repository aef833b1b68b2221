"""Logistic regression over term counts and vectors, every fold fitted in the same passes over the rows."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.storage import cut

WORD = re.compile(r"\w{2,}")
HELD = 400_000  # terms that a task counts before it hands them on
BLOCK = 1000  # rows
TASKS = 32  # of a pass at most: each sends its gradients to the driver


def terms(text: str) -> list[str]:
    """1- and 2-grams of words of two letters or more, with repetitions."""
    w = WORD.findall(text.lower())
    return w + list(map(" ".join, zip(w, w[1:])))


def frequencies(rows: DataFrame, k: int) -> DataFrame:
    """term, `1` to `k`: how many rows of each fold hold the term."""
    schema = pa.schema([("term", pa.string()), ("fold", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter[str]] = {i: Counter() for i in range(1, k + 1)}

        def full() -> Iterator[pa.RecordBatch]:
            for i, c in held.items():
                yield pa.RecordBatch.from_pydict({"term": list(c), "fold": [i] * len(c), "n": list(c.values())}, schema=schema)
                c.clear()

        for b in batches:
            for fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[fold].update(set(terms(text)))
                if sum(map(len, held.values())) > HELD:
                    yield from full()
        yield from full()

    each = [F.sum(F.when(F.col("fold") == i, F.col("n")).otherwise(0)).alias(str(i)) for i in range(1, k + 1)]
    return rows.select("fold", "text").mapInArrow(count, "term string, fold int, n long").groupBy("term").agg(*each)


@dataclass(frozen=True)
class Vocabulary:
    """Terms of any fold; of each fold which of them are its own, and what they weigh."""

    terms: list[str]
    own: list[np.ndarray]
    idf: list[np.ndarray]


def vocabulary(df: DataFrame, sizes: list[int], features: int, least: int) -> Vocabulary:
    """A fold's terms are the `features` that most of its training rows hold, of those that at least `least` do; `sizes`: rows of each fold."""
    k = len(sizes)

    def top(i: int) -> DataFrame:
        own = sum((F.col(str(j)) for j in range(1, k + 1) if j != i), F.lit(0))
        return df.select("term", F.lit(i).alias("fold"), own.alias("df")).where(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(features)

    found = reduce(DataFrame.unionAll, map(top, range(1, k + 1))).toArrow()  # a bounded dimension
    words = found.column("term").combine_chunks().dictionary_encode()
    fold, at, n = found.column("fold").to_numpy(), words.indices.to_numpy(), found.column("df").to_numpy()
    own, idf = [], []
    for i in range(1, k + 1):
        order = np.argsort(at[fold == i])
        own.append(at[fold == i][order].astype(np.int64))
        idf.append(np.log((1 + sum(sizes) - sizes[i - 1]) / (1 + n[fold == i][order])) + 1)
    return Vocabulary(words.dictionary.to_pylist(), own, idf)


@dataclass
class Block:
    """Rows of a fold as arrays. `t`, 1 + ln tf of the terms `at`, row by row as many as `counts`; `norms`: a row's length by fold, 1 if it has no term."""

    y: np.ndarray
    fold: int
    counts: np.ndarray
    at: np.ndarray
    t: np.ndarray
    norms: np.ndarray
    vectors: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum of `x`, which has a value for every term, by row."""
        out, some = np.zeros(len(self.y)), self.counts > 0
        if len(x):
            out[some] = np.add.reduceat(x, (np.cumsum(self.counts) - self.counts)[some])
        return out


def squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0: in as few bytes as hold the largest, bytes of equal weight together, compressed."""
    x = x.astype(np.min_scalar_type(x.max(initial=0)))
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T if len(x) else x), codec="zstd", asbytes=True) + bytes([x.itemsize])


def spread(b: pa.Buffer, n: int) -> np.ndarray:
    """The `n` numbers that `squeezed` made `b` of."""
    wide = b[b.size - 1]
    planes = np.frombuffer(pa.decompress(b.slice(0, b.size - 1), n * wide, codec="zstd"), np.uint8).reshape(wide, n)
    out = planes[0].astype(np.int64)
    for i in range(1, wide):
        if planes[i].any():
            out |= planes[i].astype(np.int64) << 8 * i
    return out


def blocks(rows: DataFrame, known: Vocabulary, k: int) -> DataFrame:
    """The rows of a fold by `BLOCK` at most, as arrays in binary columns."""
    key = rows.schema["article_id"].dataType.simpleString()
    model = rows.sparkSession.sparkContext.broadcast(known)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.value
        size, number = len(v.terms), {t: i for i, t in enumerate(v.terms)}
        weights = np.zeros((k, size))
        for i in range(k):
            weights[i, v.own[i]] = v.idf[i]
        for whole in batches:
            folds = whole.column(2).to_numpy()
            for i in np.unique(folds):
                own = whole.filter(pa.array(folds == i))
                for start in range(0, own.num_rows, BLOCK):
                    yield packed(own.slice(start, BLOCK), int(i), number, weights)

    def packed(b: pa.RecordBatch, fold: int, number: dict[str, int], weights: np.ndarray) -> pa.RecordBatch:
        size, texts = max(len(number), 1), b.column(3).to_pylist()
        found = [[i for t in terms(x) if (i := number.get(t)) is not None] for x in texts]
        row = np.repeat(np.arange(len(texts)), list(map(len, found)))
        cell, tf = np.unique(row * size + np.fromiter((i for x in found for i in x), np.int64, len(row)), return_counts=True)
        row, at = np.divmod(cell, size)
        t = 1 + np.log(tf)
        norms = np.stack([np.sqrt(np.bincount(row, (t * np.take(w, at)) ** 2, len(texts))) for w in weights])
        norms[norms == 0] = 1
        arrays = {"y": np.asarray(b.column(1), np.int8), "counts": np.bincount(row, minlength=len(texts)).astype(np.int32), "norms": norms, "vectors": np.array(b.column(4).to_pylist(), np.float64)}
        whole = {c: x.tobytes() for c, x in arrays.items()} | {"cells": squeezed(np.diff(cell, prepend=0)), "tf": squeezed(tf)}
        return pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], pa.list_(b.schema.field(0).type)), pa.array([fold], pa.int32()), *(pa.array([x], pa.binary()) for x in whole.values())], ["ids", "fold", *whole])

    schema = f"ids array<{key}>, fold int, y binary, counts binary, norms binary, vectors binary, cells binary, tf binary"
    whole = cut(rows.select("article_id", "y", "fold", "text", "vector").mapInArrow(pack, schema))
    return whole.coalesce(min(TASKS, max(1, rows.sparkSession.sparkContext.defaultParallelism)))


def read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Scalar, Block]]:
    """The blocks and their rows' ids; `size`: terms of the vocabulary."""
    for b in batches:
        for i in range(b.num_rows):
            x = {c: np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in dict(y=np.int8, counts=np.int32, norms=np.float64, vectors=np.float64).items()}
            n, cells = len(x["y"]), int(x["counts"].sum())
            gaps, tf = (spread(b.column(c)[i].as_buffer(), cells) for c in ("cells", "tf"))
            at = np.cumsum(gaps, out=gaps) - np.repeat(np.arange(n) * max(size, 1), x["counts"])
            t = np.take(1 + np.log(np.maximum(np.arange(tf.max(initial=0) + 1), 1)), tf)
            yield b.column("ids")[i], Block(x["y"], b.column("fold")[i].as_py(), x["counts"], at, t, x["norms"].reshape(-1, n), x["vectors"].reshape(n, -1))


@dataclass(frozen=True)
class Problem:
    """A classifier of a fold; its weights end with the intercept."""

    words: bool
    fold: int

    def wide(self, v: Vocabulary, w: np.ndarray) -> np.ndarray:
        """The weights over all terms, times what the terms weigh."""
        if not self.words:
            return w
        out = np.zeros(len(v.terms) + 1)
        out[v.own[self.fold - 1]], out[-1] = w[:-1] * v.idf[self.fold - 1], w[-1]
        return out

    def margins(self, b: Block, w: np.ndarray) -> np.ndarray:
        """`w`: as `wide` gives them."""
        return (b.sums(np.take(w, b.at) * b.t) / b.norms[self.fold - 1] if self.words else b.vectors @ w[:-1]) + w[-1]

    def slope(self, b: Block, r: np.ndarray, total: np.ndarray) -> None:
        """Adds the gradient's share of the block over all terms (unweighed) or vector elements, and over the intercept."""
        total[:-1] += np.bincount(b.at, np.repeat(r / b.norms[self.fold - 1], b.counts) * b.t, len(total) - 1) if self.words else r @ b.vectors
        total[-1] += r.sum()

    def own(self, v: Vocabulary, g: np.ndarray) -> np.ndarray:
        return np.append(g[:-1][v.own[self.fold - 1]] * v.idf[self.fold - 1], g[-1]) if self.words else g


def descent(scale: np.ndarray, tolerance: float, rounds: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS with a weak Wolfe search: yields points, is sent the value and gradient of each, returns the minimum.

    It steps in units of `scale`; `tolerance` holds for every element of the gradient itself.
    """
    x = np.zeros(len(scale))
    f, g = yield x
    g = g * scale
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=10)
    for _ in range(rounds):
        if np.abs(g / scale).max() <= tolerance:
            break
        d, shares = -g, []
        for s, u, su in reversed(past):
            shares.append((s @ d) / su)
            d = d - shares[-1] * u
        if past:
            d = d * (past[-1][2] / (past[-1][1] @ past[-1][1]))
        for (s, u, su), a in zip(past, reversed(shares), strict=True):
            d = d + (a - (u @ d) / su) * s
        down = g @ d
        step, low, high = 1.0 if past else 1 / np.linalg.norm(g), 0.0, np.inf
        for _ in range(40):
            at, slope = yield (x + step * d) * scale
            slope = slope * scale
            if at > f + 1e-4 * step * down + 1e-14 * abs(f):
                high = step
            elif slope @ d < 0.9 * down:
                low = step
            else:
                break
            step = 2 * low if high == np.inf else (low + high) / 2
        else:
            break  # as near as numbers tell
        s, u = step * d, slope - g
        x, f, g = x + s, at, slope
        if s @ u > 0:
            past.append((s.astype(np.float32), u.astype(np.float32), s @ u))  # only the direction comes from these
    return x * scale


def fitted(packed: DataFrame, known: Vocabulary, classes: dict[tuple[int, int], int], k: int, length: int, tolerance: float, rounds: int) -> dict[Problem, np.ndarray]:
    """The weights of both classifiers of every fold, trained on the other folds' rows.

    Both classes weigh the same; an L2 penalty of 1 against the sum over rows. `classes`: rows by (fold, y).
    """
    context = packed.sparkSession.sparkContext
    model = context.broadcast(known)
    count = {(i, y): sum(n for (fold, z), n in classes.items() if fold != i and z == y) for i in range(1, k + 1) for y in (0, 1)}
    rows = {i: count[i, 0] + count[i, 1] for i in range(1, k + 1)}
    share = {(i, y): rows[i] / (2 * max(n, 1)) for (i, y), n in count.items()}
    problems = [Problem(words, i) for i in range(1, k + 1) for words in (True, False)]
    # the intercept is in every row and has no penalty: it is that much steeper than the rest
    scale = {p: np.append(np.ones(len(known.own[p.fold - 1]) if p.words else length), 2 / rows[p.fold] ** 0.5) for p in problems}
    runs = {p: descent(scale[p], tolerance, rounds) for p in problems}
    asked, done = {p: next(run) for p, run in runs.items()}, {}
    while asked:
        sent, order = context.broadcast(asked), list(asked)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, loss, some = model.value, dict.fromkeys(order, 0.0), False  # noqa: B023
            weights = {p: p.wide(v, w) for p, w in sent.value.items()}  # noqa: B023
            total = {p: np.zeros(len(w)) for p, w in weights.items()}
            for _, b in read(batches, len(v.terms)):
                some = True
                for p, w in weights.items():
                    if p.fold != b.fold:
                        each, m = np.where(b.y == 1, share[p.fold, 1], share[p.fold, 0]), p.margins(b, w)
                        loss[p] += each @ (np.logaddexp(0, m) - b.y * m)
                        p.slope(b, each * (0.5 * (1 + np.tanh(m / 2)) - b.y), total[p])
            if some:
                yield pa.RecordBatch.from_pydict({"of": range(len(order)), "loss": [loss[p] for p in order], "x": [p.own(v, total[p]).astype(np.float32).tobytes() for p in order]}, schema=pa.schema([("of", pa.int32()), ("loss", pa.float64()), ("x", pa.binary())]))  # noqa: B023

        got = packed.mapInArrow(add, "of int, loss double, x binary").toArrow()  # a row for each task and classifier, `features` numbers at most
        sent.destroy()
        of, following = got["of"].to_numpy(), {}
        for j, p in enumerate(order):
            mine = np.flatnonzero(of == j).tolist()
            f, g = sum(got["loss"][i].as_py() for i in mine), np.zeros(len(asked[p]))
            for i in mine:
                g += np.frombuffer(got["x"][i].as_buffer(), np.float32)
            if not np.isfinite(f):
                raise ValueError("a vector holds something that is no number")
            w, n = np.append(asked[p][:-1], 0.0), rows[p.fold]
            try:
                following[p] = runs[p].send(((f + w @ w / 2) / n, (g + w) / n))
            except StopIteration as end:
                done[p] = end.value
        asked, got = following, None
    return done


def held_out(packed: DataFrame, known: Vocabulary, weights: dict[Problem, np.ndarray]) -> DataFrame:
    """article_id, y, p_vec, p_txt: what the classifiers of a row's fold, which did not see it, say."""
    model = packed.sparkSession.sparkContext.broadcast((known, weights))
    key = packed.schema["ids"].dataType.elementType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, found = model.value
        weights = {p: p.wide(v, w) for p, w in found.items()}
        for ids, b in read(batches, len(v.terms)):
            vec, txt = (0.5 * (1 + np.tanh(p.margins(b, weights[p]) / 2)) for p in (Problem(False, b.fold), Problem(True, b.fold)))
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(b.y.astype(np.int32)), pa.array(vec), pa.array(txt)], ["article_id", "y", "p_vec", "p_txt"])

    return packed.mapInArrow(apply, f"article_id {key}, y int, p_vec double, p_txt double")
