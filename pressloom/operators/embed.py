"""Vectors of texts by a pluggable encoder, loaded once in each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: hidden states [text, token, dim] and mask [text, token] of a batch of texts
Forward = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens of the mask, at unit length."""
    m = mask[:, :, None].astype(np.float64)
    v = (hidden * m).sum(axis=1) / np.clip(m.sum(axis=1), 1e-9, None)
    return (v / np.clip(np.linalg.norm(v, axis=1, keepdims=True), 1e-12, None)).astype(np.float32)


def encode(texts: list[str], forward: Forward, dims: int, batch: int = 16, long: int = 1_000, long_batch: int = 4) -> np.ndarray:
    """One row a text. Batches with a long text are run in smaller ones; of a batch that fails each text is tried alone, and becomes a zero vector."""
    out = np.zeros((len(texts), dims), dtype=np.float32)
    for k in range(0, len(texts), batch):
        part = texts[k : k + batch]
        size = long_batch if max(map(len, part)) > long else batch
        for j in range(0, len(part), size):
            some = part[j : j + size]
            try:
                out[k + j : k + j + len(some)] = pooled(*forward(some))
            except Exception:  # noqa: BLE001 -- any failure of the model
                for i, t in enumerate(some):
                    try:
                        out[k + j + i] = pooled(*forward([t]))[0]
                    except Exception:  # noqa: BLE001, S110
                        pass
    return out


def embedded(rows: DataFrame, key: str, text: str, load: Callable[[], Forward], dims: int, prefix: str = "passage: ") -> DataFrame:
    """key, vector of each row with a text; `load` makes the encoder in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward = load()
        for b in batches:
            v = encode([prefix + t for t in b.column(1).to_pylist()], forward, dims)
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=["key", "vector"])

    return rows.where(F.col(text).isNotNull()).select(F.col(key).cast("long"), text).mapInArrow(run, "key long, vector array<float>").withColumnRenamed("key", key)


def word_shapes() -> Forward:
    """A stand-in encoder without a model: a token is a word, its states are its length and 1."""

    def forward(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [t.split(" ") for t in texts]
        longest = max(map(len, words))
        hidden, mask = np.zeros((len(texts), longest, 2)), np.zeros((len(texts), longest))
        for i, w in enumerate(words):
            hidden[i, : len(w)] = [(len(x), 1.0) for x in w]
            mask[i, : len(w)] = 1
        return hidden, mask

    return forward
