"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A
text is cut into pieces, every piece is compressed with both, and the difference
of the summed sizes over the text's length becomes a probability by a logistic
curve that is fitted on labelled texts which neither dictionary has seen.

The labelled sample is bounded: ``per_class`` rows of each label, taken in the
order of a hash of the id; this bounds what reaches the driver. Scoring is a
narrow map over every whole text.

A short text says little, so its difference is drawn to that of the average
good text, as if ``PRIOR_BYTES`` more bytes of it were there.

Defined cases: a null or empty text has the difference of the average good text; a null id counts as the text ``''`` for the held-out rule;
repeated labels count once (the smaller quality if they disagree); repeated rows
are scored one by one; with a class missing, every score is the share of good
labels (0.5 with none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.textkit import slices, texts

PER_CLASS = 1500
PIECE = 1024
DICT_BYTES = 64 << 10
LEVEL = 3
PRIOR_BYTES = 96
THRESHOLD = 0.7


def held_out(doc_id: Column, modulus: int = 4, rest: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    prior: float = 0.0

    def score(self, x: float) -> float:
        z = max(-40.0, min(40.0, self.slope * x + self.intercept))
        return 1.0 / (1.0 + math.exp(-z))


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=_with_level(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def _with_level(dictionary: bytes):
    import zstandard

    out = zstandard.ZstdCompressionDict(dictionary)
    out.precompute_compress(level=LEVEL)
    return out


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; raw content where there is too little to train on."""
    import zstandard

    pieces = [p for s in samples for p in _pieces(s)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICT_BYTES:] or b"\n" * 8


def difference(text: bytes, good, bad, prior: float) -> float:
    """(size with the bad dictionary - size with the good one) / length, with
    ``PRIOR_BYTES`` bytes of difference ``prior`` added to the text."""
    saved = sum(len(bad.compress(p)) - len(good.compress(p)) for p in _pieces(text))
    return (saved + prior * PRIOR_BYTES) / (len(text) + PRIOR_BYTES)


def fit(rows: list[tuple[bytes, int]], share: float | None = None) -> Model:
    """``rows``: texts with label 1 (good) or 0, in a fixed order. Every third
    row of a class calibrates, the others build the dictionaries. ``share``: how
    many of all labels are good; by default the share in ``rows``."""
    by = {q: [t for t, label in rows if label == q] for q in (0, 1)}
    if share is None:
        share = len(by[1]) / len(rows) if rows else 0.5
    if not by[0] or not by[1]:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"\n" * 8, b"\n" * 8, 0.0, math.log(share / (1 - share)))
    build = {q: [t for k, t in enumerate(ts) if k % 3 or len(ts) < 3] for q, ts in by.items()}
    keep = {q: [t for k, t in enumerate(ts) if k % 3 == 0] for q, ts in by.items()}
    good, bad = _dictionary(build[1]), _dictionary(build[0])
    g, b = _compressor(good), _compressor(bad)
    long_good = [t for t in keep[1] if len(t) >= PIECE] or keep[1]
    prior = float(np.mean([difference(t, g, b, 0.0) for t in long_good]))
    x = np.array([difference(t, g, b, prior) for q in (0, 1) for t in keep[q]])
    y = np.array([q for q in (0, 1) for _ in keep[q]], float)
    return Model(good, bad, *_logistic(x, y, share), prior)


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Newton's method with a small ridge; the classes weigh as among all labels."""
    weight = np.where(y == 1, share / max(1.0, y.sum()), (1 - share) / max(1.0, (1 - y).sum())) * len(y)
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        grad = design.T @ (weight * (p - y)) + np.array([0.1, 0.0]) * theta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([0.1, 1e-6])
        step = np.linalg.solve(hess, grad)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``2 * per_class`` labelled texts outside the held-out part.
    The ids are chosen from the narrow label table, so texts move only for them."""
    known = (
        labels.select(labels["doc_id"].alias("id"), labels["quality"].cast("int").alias("q"))
        .where(F.col("id").isNotNull() & F.col("q").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id").agg(F.min("q").alias("q"))
    )
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("good")).first()
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.where("q = 0").orderBy(*order).limit(per_class).unionAll(known.where("q = 1").orderBy(*order).limit(per_class))
    got = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = got.groupBy("id", "q").agg(F.min("text").alias("text")).collect()  # 2 * per_class rows at most
    rows.sort(key=lambda r: (r["id"]))
    share = counts["good"] / counts["n"] if counts["n"] else 0.5
    return fit([((r["text"] or "").encode(), r["q"]) for r in rows], share)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the raw difference of every row."""
    kept = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    scored = with_scores(kept, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference")


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``difference`` and ``score``."""
    names = docs.columns
    where = names.index("text")
    fields = [*docs.schema.fields]
    schema = docs.schema.__class__(fields).add("difference", "double").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = _compressor(model.good), _compressor(model.bad)
        for batch in slices(batches):
            x = [difference(t, good, bad, model.prior) for t in texts(batch.column(where))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.float64()), pa.array([model.score(v) for v in x], pa.float64())], names=[*names, "difference", "score"])

    return docs.mapInArrow(score, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    return score_documents(docs, train(docs, labels, per_class))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns.

    ``difference`` and ``score`` are computed beside the columns of ``docs``
    under names of their own, so clashing columns survive.
    """
    model = train(docs, labels, per_class)
    names = docs.columns
    inner = docs.toDF(*(("text" if n == "text" else f"c{k}") for k, n in enumerate(names)))
    good = with_scores(inner, model).where(F.col("score") >= THRESHOLD)
    return good.select(*(F.col("text" if n == "text" else f"c{k}").alias(n) for k, n in enumerate(names)))
