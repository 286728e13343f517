"""Quality by compression: which of two zstandard dictionaries, good or bad, packs a text better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from loam.llm.langid import held_out
from loam.session import discard, small_batches, written

#: Bytes that are compressed at once.
PIECE = 512


@dataclass(frozen=True)
class Model:
    """The two dictionaries and the line that turns the size difference into a log-odds."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    level: int

    def scorer(self):
        if not self.good or not self.bad:
            return lambda text: _sigmoid(self.intercept)
        difference = _difference(self.good, self.bad, self.level)
        return lambda text: _sigmoid(self.intercept + self.slope * difference(text))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def _difference(good: bytes, bad: bytes, level: int):
    """text -> how many bytes more the bad dictionary needs than the good one, for each byte of the text.

    A text is compressed in pieces of PIECE bytes, so that the dictionaries and not what went before
    decide, whatever its length.
    """
    sizes = []
    for raw in (good, bad):
        own = zstandard.ZstdCompressionDict(raw)
        own.precompute_compress(level=level)
        sizes.append(zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_dict_id=False))

    def difference(text: str | None) -> float:
        data = memoryview((text or "").encode("utf-8", "surrogatepass"))
        total = 0
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            by_good, by_bad = (len(c.compress(piece)) for c in sizes)
            total += by_bad - by_good
        return total / max(1, len(data))

    return difference


def _spread(data: bytes, most: int) -> bytes:
    """The text, or pieces of it at even distances where it is longer than ``most``."""
    if len(data) <= most:
        return data
    pieces, taken = -(-len(data) // PIECE), max(1, most // PIECE)
    return b"".join(data[i * pieces // taken * PIECE :][:PIECE] for i in range(taken))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; the texts themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of a weighted logistic regression with a little ridge, by Newton's method."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (w * (p - y)) + 1e-3 * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = 3000,
    sample_bytes: int = 16_384,
    dictionary_bytes: int = 112_640,
    level: int = 3,
) -> Model:
    """A model from labels outside fold 0 of 5.

    Of each label about ``per_label`` rows are taken, by a hash of the id: this sample alone meets
    the texts, as a join side of bounded size. Two thirds of it build the dictionaries; the
    driver gets ``sample_bytes`` of each text at most, in pieces from all over it. The other third is
    scored whole, by tasks, and fits the calibration, weighted back to the shares that the labels
    have among all learnable rows. Null labels teach nothing; with one label only, every score is
    that label's smoothed share.
    """
    known = labels.where(~held_out(id_col, 5, 0) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(counts) < 2:
        return Model(b"", b"", 0.0, prior, level)
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20) < rates[F.col("label")])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    deal = F.xxhash64("id", F.lit(1))
    found = written(texts.join(F.broadcast(sample), "id").select("label", "text", deal.alias("deal")), "sample")

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cut = [_spread(t.as_py().encode("utf-8", "surrogatepass"), sample_bytes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary()), batch.column(2)], ["label", "data", "deal"])

    build = found.where(F.pmod("deal", F.lit(3)) > 0).mapInArrow(pieces, "label int, data binary, deal long").toArrow()
    build = build.sort_by([("deal", "ascending"), ("label", "ascending")])
    rows = list(zip(build["label"].to_pylist(), build["data"].to_pylist()))
    good, bad = ([t for y, t in rows if y == k and t] for k in (1, 0))
    if not good or not bad:
        return Model(b"", b"", 0.0, prior, level)
    model = Model(_dictionary(good, dictionary_bytes), _dictionary(bad, dictionary_bytes), 0.0, prior, level)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def differences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        difference = _difference(own.good, own.bad, own.level)
        for batch in it:
            found = pa.array([difference(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["label", "x"])

    fit = found.where(F.pmod("deal", F.lit(3)) == 0).mapInArrow(differences, "label int, x double").toArrow()
    fit = fit.sort_by([("x", "ascending"), ("label", "ascending")])
    discard(found)
    x, y = fit["x"].to_numpy(), fit["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return Model(b"", b"", 0.0, prior, level)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    slope, intercept = _logistic(x, y, weight)
    return Model(model.good, model.bad, slope, intercept, level)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options
) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row.

    ``score`` is the calibrated probability of label 1, from the whole text alone: the difference
    of its compressed sizes under the two dictionaries, over its length. ``predicted`` is 1 from
    ``threshold`` on. A null text is an empty one, and empty texts have the score of no difference.
    Long texts are compressed whole, in pieces. Rows that repeat an id are scored each; ids that
    ``labels`` repeats teach each of their labels. Null ids are in the fold of an empty text. An empty
    table of documents gives an empty result, and one of labels the score 0.5; columns other than those
    named are ignored in both.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, **options))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in it:
            scores = pa.array([score(text.as_py()) for text in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, "id long, score double").select(
        F.col("id").alias(id_col),
        held_out("id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
