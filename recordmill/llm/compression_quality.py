"""Quality scores from compressed sizes under dictionaries of good and bad text (operator 2).

Two zstandard dictionaries are built from labelled texts. A text that is like good text compresses better with the
good dictionary: ``(bytes with bad - bytes with good) / bytes`` is the normalised difference. A
logistic curve over it, the share of bytes the good dictionary leaves, the difference over the larger size, and their squares,
fitted on labelled texts that built no dictionary, turns it into a probability.
"""

from __future__ import annotations

import functools
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import materialize, maybe_in

#: Bounds of what is learnt from: labelled rows of a class for each of the two purposes, and their bytes; rows are taken
#: in the order of a hash of their id, those that would exceed the bytes are passed over. Everything else covers all rows.
SAMPLE_ROWS = 2000
#: Ids taken beyond that, for rows that have no text.
SPARE_ROWS = 1000
SAMPLE_BYTES = 12_000_000
PIECE = 8192
LEVEL = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray


@functools.lru_cache(maxsize=2)
def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in (good, bad):
        held = zstandard.ZstdCompressionDict(raw)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_dict_id=False))
    return out


def features(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """Normalised size difference, share left by the good dictionary, and difference over the larger size, of each text."""
    by_good, by_bad = _compressors(good, bad)
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8")
        g, b = len(by_good.compress(raw)), len(by_bad.compress(raw))
        n = len(raw) + 32
        out[i] = (b - g) / n, g / n, (b - g) / max(b, g)
    return out


def predict(model: QualityModel, texts: list[str | None]) -> np.ndarray:
    x = _expand((features(texts, model.good, model.bad) - model.centre) / model.scale)
    return 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))


def _expand(x: np.ndarray) -> np.ndarray:
    """Intercept, the measures and their squares."""
    return np.column_stack([np.ones(len(x)), x, x**2])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def build_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of too few texts to train on, their plain bytes."""
    pieces = [raw[i : i + PIECE] for raw in (t.encode("utf-8") for t in texts) for i in range(0, len(raw), PIECE)]
    try:
        return zstandard.train_dictionary(112_640, pieces, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-112_640:] or b" "


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from labelled rows whose crc32(id as text) mod 3 is not 1: 0 builds dictionaries, 2 calibrates.

    Rows without text, id or label are not learnt from; of repeated labels of an id the largest counts, rows that repeat an id are all
    learnt from. With one class or none the score is the
    share of good labels, or one half.
    """
    part = F.crc32(F.col(id_col).cast("string")) % 3
    known = labels.where(F.col(label_col).isin(0, 1) & (part != 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = materialize(known.select("id", "y", (F.crc32(F.col("id").cast("string")) % 3).alias("part"), F.xxhash64("id").alias("order")), "known")
    groups = [(y, k) for y in (0, 1) for k in (0, 2)]
    # ids are chosen from the labels alone, some to spare for rows without text; one scan fetches their texts
    chosen = [known.where((F.col("y") == y) & (F.col("part") == k)).orderBy("order", "id").limit(SAMPLE_ROWS + SPARE_ROWS) for y, k in groups]
    chosen = materialize(functools.reduce(DataFrame.unionByName, chosen), "chosen")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = rows.where(maybe_in("id", chosen.select("id"))).join(chosen, "id")
    rows = materialize(rows.select("y", "part", "order", "text"), "sample")
    sample: dict[tuple[int, int], list[str]] = {}
    for y, k in groups:
        top = rows.where((F.col("y") == y) & (F.col("part") == k)).select("order", "text").orderBy("order", "text").limit(SAMPLE_ROWS)
        held, size = [], 0
        for r in top.toLocalIterator():
            n = len(r["text"].encode("utf-8"))
            if size + n <= SAMPLE_BYTES:
                held.append(r["text"])
                size += n
        sample[y, k] = held
    good, bad = build_dictionary(sample[1, 0]), build_dictionary(sample[0, 0])
    texts = sample[0, 2] + sample[1, 2]
    y = np.array([0.0] * len(sample[0, 2]) + [1.0] * len(sample[1, 2]))
    x = features(texts, good, bad) if texts else np.zeros((0, 3))
    centre = x.mean(axis=0) if len(x) else np.zeros(3)
    scale = x.std(axis=0) if len(x) else np.ones(3)
    scale[scale == 0] = 1.0
    if 0 < y.sum() < len(y):
        weights = fit_logistic(_expand((x - centre) / scale), y)
    else:
        share = y.mean() if len(y) else 0.5
        weights = np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), *[0.0] * 6])
    return QualityModel(good, bad, weights, centre, scale)


def score(model: QualityModel, docs: DataFrame, text_col: str = "text") -> Column:
    """Column of scores from 0 to 1; null and empty texts get the score of an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(_loaded(shared.value), texts.tolist()))

    return run(F.col(text_col))


@functools.lru_cache(maxsize=2)
def _loaded(raw: bytes) -> QualityModel:
    return pickle.loads(raw)


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that no model learns from; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1

