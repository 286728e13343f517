"""Language identification: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loam.session import small_batches

UNDETERMINED = "und"
#: Characters whose n-grams are counted at once.
_CHUNK = 1 << 18
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Whether each code point of Unicode is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def characters(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points in lower case, with every run of other characters than letters as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    other = ~letters[codes]
    codes = np.where(other, np.uint32(_SPACE), codes)
    return codes[~(other & np.r_[False, other[:-1]])] if len(codes) else codes


def ngram_counts(codes: np.ndarray, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """How often each of 2**bits hash slots is hit by the n-grams of the given orders."""
    counts = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    for at in range(0, len(codes), _CHUNK):
        for n in orders:
            part = codes[at : at + _CHUNK + n - 1]
            starts = min(_CHUNK, len(part) - n + 1)
            if starts <= 0:
                continue
            mixed = np.full(starts, n, np.uint32)
            for i in range(n):
                mixed = (mixed ^ part[i : i + starts]) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
            counts += np.bincount((mixed * np.uint32(0x85EBCA6B)) >> shift, minlength=1 << bits)
    return counts


@dataclass(frozen=True)
class Model:
    """Weights over hash slots (the last row is the bias), inverse document frequencies and temperature."""

    labels: tuple[str, ...]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float
    bits: int
    orders: tuple[int, ...]

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = np.flatnonzero(counts)
        return slots, _unit((1 + np.log(counts[slots])) * self.idf[slots])

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        codes = characters(text or "", letters)
        if not self.labels or not len(codes) or (codes == _SPACE).all():
            return UNDETERMINED, 0.0
        slots, x = self.vector(ngram_counts(codes, self.bits, self.orders))
        p = _softmax((x @ self.weights[slots] + self.weights[-1]) / self.temperature)
        return self.labels[int(p.argmax())], float(min(1.0, p.max()))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], slots: int, labels: int, alpha: float, beta: float, l1: float, l2: float, epochs: int
) -> np.ndarray:
    """Follow the regularised leader, per coordinate, with elastic-net penalties; most weights stay zero."""
    z, n = np.zeros((slots + 1, labels)), np.zeros((slots + 1, labels))
    rng = np.random.default_rng(0)

    def current(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        shrunk = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, shrunk)

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, label = rows[r]
            at, x = np.r_[at, slots], np.r_[x, 1.0]
            w = current(at)
            error = _softmax(x @ w)
            error[label] -= 1
            gradient = x[:, None] * error
            squared = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(squared) - np.sqrt(n[at])) / alpha * w
            n[at] = squared
    return current(np.arange(slots + 1))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes held-back labels likeliest."""
    if not len(labels):
        return 1.0
    tried = np.geomspace(0.05, 20, 121)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)).mean() for t in tried]
    return float(tried[int(np.argmin(losses))])


def train(
    rows: DataFrame,
    per_label: int = 1500,
    bits: int = 15,
    orders: tuple[int, ...] = (1, 2, 3),
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-3,
    epochs: int = 4,
) -> Model:
    """A model from (id, text, label).

    Document frequencies count every labelled row with letters, by executor and then by slot, so
    the driver gets 2**bits numbers at most. The regression is fitted on a sample: about
    ``per_label`` rows of each label, chosen by a hash of the id, a fifth of which is held back
    for the temperature. Rows with a null text or label teach nothing; without any row the
    model answers ``und``.
    """
    small_batches(rows.sparkSession)
    labelled = rows.where(F.col("text").isNotNull() & F.col("label").isNotNull())
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = tuple(sorted(counts))
    empty = np.zeros(1 << bits)
    if not labels:
        return Model((), np.zeros((1, 0)), empty, 1.0, bits, orders)

    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, df, total = _letters(), np.zeros(1 << bits, np.int64), 0
        for batch in it:
            for text in batch.column(0):
                codes = characters(text.as_py(), letters)
                df += ngram_counts(codes, bits, orders) > 0
                total += 1
        slots = np.r_[np.flatnonzero(df), -1]
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.r_[df[slots[:-1]], total])], ["slot", "n"])

    found = labelled.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df, total = empty.copy(), 0
    for r in found:
        if r["slot"] < 0:
            total = r["n"]
        else:
            df[r["slot"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1

    rates = F.create_map(*[F.lit(x) for label in labels for x in (label, min(1.0, per_label / counts[label]))])
    dealt = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in it:
            out = []
            for text in batch.column(0):
                seen = ngram_counts(characters(text.as_py(), letters), bits, orders)
                slots = np.flatnonzero(seen)
                out.append((slots.astype(np.int32), seen[slots].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    batch.column(2),
                    pa.array([s for s, _ in out], pa.list_(pa.int32())),
                    pa.array([c for _, c in out], pa.list_(pa.int32())),
                ],
                ["label", "deal", "slots", "counts"],
            )

    sample = (
        labelled.where(dealt < rates[F.col("label")])
        .select("text", "label", F.xxhash64("id", F.lit(1)).alias("deal"))
        .mapInArrow(vectors, "label string, deal long, slots array<int>, counts array<int>")
        .toArrow()
        .sort_by([("deal", "ascending"), ("label", "ascending")])
    )
    at = {label: i for i, label in enumerate(labels)}
    made = []
    for i in range(sample.num_rows):
        slots = sample["slots"][i].values.to_numpy(zero_copy_only=False)
        if len(slots):
            tf = 1 + np.log(sample["counts"][i].values.to_numpy(zero_copy_only=False))
            made.append((slots, _unit(tf * idf[slots]), at[sample["label"][i].as_py()]))
    del sample
    pa.default_memory_pool().release_unused()
    back, fitted = made[::5], [r for i, r in enumerate(made) if i % 5]
    weights = _ftrl(fitted or made, 1 << bits, len(labels), alpha, beta, l1, l2, epochs)
    logits = np.array([x @ weights[slots] + weights[-1] for slots, x, _ in back]).reshape(-1, len(labels))
    temperature = _temperature(logits, np.array([y for *_, y in back], np.int64))
    return Model(labels, weights.astype(np.float32), idf, temperature, bits, orders)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row; see :func:`identify` for the cases."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, own = _letters(), shared.value
        for batch in it:
            found = [own.predict(text.as_py(), letters) for text in batch.column(1)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id as text falls in ``fold``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **options) -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every row.

    The model learns from rows outside fold 2 of 4 and sees a text only. ``score`` is the calibrated
    probability of the predicted label. A text that is null or has no letter is ``und`` with score
    0, as is every text when nothing is labelled. Whole texts are read, in pieces if long. Rows
    that repeat an id are predicted each, and labels that fit equally well go to the first in order.
    An empty table gives an empty result, and columns other than the three named are ignored.
    """
    out = held_out(id_col, 4, 2)
    learn = docs.where(~out).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    model = train(learn, **options)
    return predict(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", min_score: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rows whose language can't be told: ``und``, or a score near chance.

    Near chance is a score under 1.2 by the number of labels, and under ``min_score`` in any case: with
    many labels a clean text may have a low score. Where nothing is labelled every row is ``und``.

    Texts pass through the prediction beside their rows, so nothing is joined or shuffled; columns
    and their names are those of ``docs``.

    Null and empty texts, and those without a letter, are ``und`` and go. Very long texts are read whole. Of labels that
    fit equally well the first counts. Rows that repeat an id or a text are judged each, and stay or go
    alike where their texts are the same. An empty table stays empty.
    """
    learn = docs.where(~held_out(id_col, 4, 2)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")
    )
    model = train(learn, **options)
    shared, least = docs.sparkSession.sparkContext.broadcast(model), min(min_score, 1.2 / max(1, len(model.labels)))
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, own = _letters(), shared.value
        for batch in it:
            found = [own.predict(text.as_py(), letters) for text in batch.column(at)]
            yield batch.filter(pa.array([label != UNDETERMINED and score >= least for label, score in found], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
