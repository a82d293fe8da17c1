"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed as toxic; everything else that may be learned from is unlabelled. A
linear model over hashed words and word beginnings is trained with the non-negative risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

where R_p(+), R_p(-) are the mean losses of the positives as positive and as negative and R_u(-) that of
the unlabelled as negative: what the positives hidden among the unlabelled add to R_u(-) is taken away
again, and the rest can't become negative by overfitting. The prior is the share of toxic documents among
the labelled ones. Training uses at most ``MAX_POSITIVE`` + ``MAX_UNLABELLED`` documents, those with the
smallest hashes of their ids; scoring covers the whole of every text.

A document's value is the sum over its distinct features. The threshold is calibrated on a part of the
positives and unlabelled that the weights were not fitted to, and the score is a logistic function of the
distance from it.

Defined cases: null and empty texts have no features and get the score of an empty text; without any
positive document every score is 0; ids that repeat in ``labels`` count as toxic if one row says so;
labels of unknown documents are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.text import held_out
from emberline.llm.wordhash import Powers, Words, bounded
from emberline.sources.scratch import stage

FOLDS = 5
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
BITS = 32
MAX_FEATURES = 4096
CERTAIN = 5.0  # standard deviations by which a feature must exceed its count by chance
STEPS = 400

#: Letters of any script; digits and marks end a word.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
BEGINNINGS = (4, 5, 6)


def features(texts: list[str | None], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the distinct hashed features: words and their first 4, 5 and 6 bytes."""
    words = Words(texts, LETTERS, powers)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    lengths = words.ends - words.starts
    parts, owners = [words.hashes], [owner]
    for n in BEGINNINGS:
        long = lengths > n
        parts.append(words.hash_of(words.starts[long], words.starts[long] + n) + np.uint64(n))
        owners.append(owner[long])
    slot = np.concatenate(parts) >> np.uint64(64 - BITS)
    pairs = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(BITS)) | slot)
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    slots: np.ndarray  # sorted feature numbers
    weights: np.ndarray
    threshold: float
    scale: float

    def values(self, n: int, owner: np.ndarray, slot: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(n)
        at = np.searchsorted(self.slots, slot)
        at[at == len(self.slots)] = 0
        known = self.slots[at] == slot
        return np.bincount(owner[known], weights=self.weights[at[known]], minlength=n)

    def scores(self, n: int, owner: np.ndarray, slot: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(n)
        return 1.0 / (1.0 + np.exp(-np.clip((self.values(n, owner, slot) - self.threshold) * self.scale, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, bool]], prior: float) -> Model:
    """Train on (distinct features, confirmed toxic) per document; every fourth one calibrates."""
    fitted = [r for i, r in enumerate(rows) if i % 4 != 3]
    calibrating = [r for i, r in enumerate(rows) if i % 4 == 3]
    toxic = np.array([r[1] for r in fitted], bool)
    none = Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 1.0)
    if not toxic.any() or toxic.all():
        return none
    owner = np.repeat(np.arange(len(fitted), dtype=np.int32), [len(r[0]) for r in fitted])
    distinct, slot = np.unique(np.concatenate([r[0] for r in fitted]), return_inverse=True)
    in_p = np.bincount(slot[toxic[owner]], minlength=len(distinct))
    in_u = np.bincount(slot[~toxic[owner]], minlength=len(distinct))
    n_p, n_u = toxic.sum(), (~toxic).sum()
    # The most telling features: log odds against the unlabelled rid of their hidden positives.
    share_p, share_u = in_p / n_p, in_u / n_u
    rest = np.maximum(share_u - prior * share_p, 0) / (1 - prior)
    gain = share_p * np.log((share_p + 1e-6) / (rest + 0.3 / n_u))
    expected = n_p * np.maximum(rest, 1 / n_u)
    gain[(in_p < 3) | (in_p - expected < CERTAIN * np.sqrt(expected + 0.5))] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[: min(MAX_FEATURES, int((gain > 0).sum()))])
    if not len(chosen):
        return none
    slots = distinct[chosen].astype(np.int64)
    at = np.minimum(np.searchsorted(chosen, slot), len(chosen) - 1)
    known = chosen[at] == slot
    owner, column = owner[known], at[known]
    weights, bias = np.zeros(len(slots)), 0.0
    first, second, moments = np.zeros(len(slots) + 1), np.zeros(len(slots) + 1), (0.9, 0.999)
    for step in range(1, STEPS + 1):
        value = np.bincount(owner, weights=weights[column], minlength=len(fitted)) + bias
        as_toxic = _sigmoid(value)  # slope of the loss as negative; minus (1 - this) as positive
        loss_negative = np.logaddexp(0, value)
        inside = loss_negative[~toxic].mean() - prior * loss_negative[toxic].mean()
        slope = np.zeros(len(fitted))
        if inside >= 0:
            slope[toxic] = -prior * (1 - as_toxic[toxic]) / n_p - prior * as_toxic[toxic] / n_p
            slope[~toxic] = as_toxic[~toxic] / n_u
        else:  # only undo the overfitting
            slope[toxic] = prior * as_toxic[toxic] / n_p
            slope[~toxic] = -as_toxic[~toxic] / n_u
        grad = np.append(np.bincount(column, weights=slope[owner], minlength=len(slots)) + 1e-5 * weights, slope.sum())
        first = moments[0] * first + (1 - moments[0]) * grad
        second = moments[1] * second + (1 - moments[1]) * grad * grad
        move = 0.05 * (first / (1 - moments[0] ** step)) / (np.sqrt(second / (1 - moments[1] ** step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    model = Model(slots, weights, -bias, 1.0)
    model.threshold = _threshold(model, calibrating, prior)
    return model


def _threshold(model: Model, rows: list[tuple[np.ndarray, bool]], prior: float) -> float:
    """The cut with the best estimated F-score: precision is read off the unlabelled by the prior."""
    toxic = np.array([r[1] for r in rows], bool)
    if not toxic.any() or toxic.all():
        return model.threshold
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    slot = np.concatenate([r[0] for r in rows])
    value = model.values(len(rows), owner, slot)
    levels = np.unique(value)
    cuts = (levels[1:] + levels[:-1]) / 2
    if not len(cuts):
        return model.threshold
    found = 1 - np.searchsorted(np.sort(value[toxic]), cuts) / toxic.sum()
    flagged = 1 - np.searchsorted(np.sort(value[~toxic]), cuts) / (~toxic).sum()
    hit = prior * found
    quality = 2 * hit / (np.maximum(flagged * (1 - prior), 0) + hit + prior)
    # Among nearly equal cuts, the one in the widest gap: most room on both sides.
    room = np.where(quality >= quality.max() - 1e-3, np.diff(levels), -1)
    return float(cuts[int(np.argmax(room))])


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Model:
    """Fit on documents outside the held-out fold; labels of the fold are dropped before anything is read."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("_id"), folds))
    known = stage(known.groupBy("_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not counts.toxic:
        return fit([], 0.5)
    prior = min(max(counts.toxic / counts.n, 1e-3), 0.9)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
    marked = ids.distinct().join(known.filter("toxic = 1").select("_id", "toxic"), F.col("doc_id") == F.col("_id"), "left")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = [
        marked.filter(test).select("doc_id", F.col("toxic").isNotNull().alias("confirmed")).orderBy(*order).limit(most)
        for test, most in ((F.col("toxic").isNotNull(), MAX_POSITIVE), (F.col("toxic").isNull(), MAX_UNLABELLED))
    ]
    sample = stage(chosen[0].unionByName(chosen[1]), "toxic-sample").withColumnRenamed("doc_id", "_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in bounded(batch):
                owner, slot = features(part.column("text").to_pylist(), powers)
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                found = [slot[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("confirmed"), pa.array(found, pa.binary())], ["doc_id", "confirmed", "slots"]
                )

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = texts.select("doc_id", "confirmed", "text").mapInArrow(extract, "doc_id bigint, confirmed boolean, slots binary")
    once = rows.groupBy("doc_id").agg(F.first("confirmed").alias("confirmed"), F.max("slots").alias("slots"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])), key=lambda r: r[0])
        model = fit([(np.frombuffer(slots, "<u4"), confirmed) for _, confirmed, slots in held], prior)
        row = {"slots": model.slots.astype("<i8").tobytes(), "weights": model.weights.astype("<f8").tobytes(), "threshold": model.threshold}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("slots", pa.binary()), ("weights", pa.binary()), ("threshold", pa.float64())]))

    # The bounded sample meets in one task; only the model, at most MAX_FEATURES numbers, comes to the driver.
    row = once.coalesce(1).mapInArrow(learn, "slots binary, weights binary, threshold double").first()
    if row is None:
        return fit([], prior)
    return Model(np.frombuffer(row.slots, "<i8"), np.frombuffer(row.weights, "<f8"), row.threshold, 1.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns with text) with ``score``; only the text is looked at."""
    from pyspark.sql import types as T

    plain = docs.drop("score")
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in bounded(batch):
                value = model.scores(part.num_rows, *features(part.column("text").to_pylist(), powers))
                names = [*part.schema.names, "score"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], names)

    return plain.mapInArrow(run, schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The documents whose score is below ``most``, with all their columns."""
    clash = [c for c in docs.columns if c == "score"]
    if clash:
        docs = docs.withColumnRenamed("score", "_score")
    kept = score(docs, train(docs, labels)).filter(F.col("score") < most).drop("score")
    return kept.withColumnRenamed("_score", "score") if clash else kept
