"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words and the beginnings of its longer words (which inflected insults share), hashed into
2**BITS buckets; a bucket counts once. score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>): the pairs give a
weight to two terms that mean more together than apart, which additive weights miss.

The model is fitted on at most SAMPLE labelled rows, those with the least hash of their id, taken from the training
folds alone (crc32 of the id as text, modulo 3, is not 1). Equal texts count once in it, and so does an id: with its first
text. A bucket gets a weight and factors if its chi square in the sample is LEAST_CHI2 or more and LEAST_DOCS documents have
it, counted by Spark; there are no more than 2**BITS. The fit is a few seconds of numpy on the driver, over a few integers a
document. Every document is then scored whole, where it lies.

Edge cases: a null or empty text has no terms and gets the base rate's score. A doc_id with several labels counts as
toxic if any is. Without labels the score is 0.5 for all; with one class only, the smoothed base rate. A null id is in
the training fold and has no label. Repeated rows get the same score. Other columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored, texts

BITS = 20
STEMS = (4, 5, 6)
SAMPLE = 20_000
LEAST_DOCS = 4
LEAST_CHI2 = 10.0
RANK = 6
EPOCHS = 30
LEAST_STEPS = 1_500
BATCH = 128
RATE = 0.02
DECAY = 3e-3
THRESHOLD = 0.7
#: Words whose buckets a task keeps, and the longest of them, so that its memory is bounded.
KNOWN, LONGEST = 150_000, 40

_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


class Terms(dict):
    """word -> its buckets; forgotten when there are KNOWN words."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        terms = [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]
        found = tuple(xxhash.xxh32_intdigest(t.encode()) >> (32 - BITS) for t in terms)
        if len(word) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = found
        return found


def buckets(text: str, terms: Terms) -> set[int]:
    found: set[int] = set()
    for word in set(_word(text.lower())):
        found.update(terms[word])
    return found


class FactorizationMachine:
    def __init__(self, bias: float, chosen: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors
        self.place = {int(b): i for i, b in enumerate(chosen)}

    def score(self, found: set[int]) -> float:
        rows = [self.place[b] for b in found if b in self.place]
        z = self.bias
        if rows:
            v = self.factors[rows]
            s = v.sum(axis=0)
            z += float(self.weights[rows].sum() + 0.5 * (s @ s - (v * v).sum()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors, by Adam on the logistic loss. rows: the terms of each document, 0 to n_terms - 1."""
    random = np.random.default_rng(seed)
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = np.array([np.log(rate / (1 - rate))])
    params = [bias, np.zeros(n_terms), random.normal(0, 0.01, (n_terms, RANK))]
    if not len(labels) or labels.min() == labels.max():
        return float(bias[0]), params[1], params[2] * 0
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sizes = np.array([len(r) for r in rows])
    flat, begins = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(rows)) if len(rows) > BATCH else LEAST_STEPS)
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            n = sizes[own]
            terms = np.concatenate([flat[begins[i] : begins[i + 1]] for i in own])
            doc = np.repeat(np.arange(len(own)), n)
            v = params[2][terms]
            sums = np.zeros((len(own), RANK))
            np.add.at(sums, doc, v)
            z = params[0][0] + np.bincount(doc, params[1][terms], len(own)) + 0.5 * ((sums * sums).sum(1) - np.bincount(doc, (v * v).sum(1), len(own)))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            grads = [np.array([error.sum()]), np.bincount(terms, error[doc], n_terms), np.zeros((n_terms, RANK))]
            np.add.at(grads[2], terms, error[doc][:, None] * (sums[doc] - v))
            step += 1
            for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g + (DECAY / len(own)) * p * (k > 0)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p -= RATE * 0.04 ** (epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def _count_terms(batches):
    """(bucket, n, toxic) over the task's rows."""
    terms, n, toxic = Terms(), np.zeros(1 << BITS, dtype=np.int32), np.zeros(1 << BITS, dtype=np.int32)
    for batch in batches:
        for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            found = np.fromiter(buckets(text, terms), dtype=np.int64)
            n[found] += 1
            toxic[found] += label
    del terms
    give_back()
    seen = np.flatnonzero(n)
    for at in range(0, len(seen), 50_000):
        part = seen[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part].astype(np.int64)), pa.array(toxic[part].astype(np.int64))], ["bucket", "n", "toxic"])


def _keep_terms(place: dict[int, int]):
    def run(batches):
        terms = Terms()
        for batch in batches:
            rows = [sorted(place[b] for b in buckets(t, terms) if b in place) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["label", "terms"])

    return run


def fold(id_col: str = "doc_id") -> F.Column:
    """Remainder that deals rows to folds; 1 is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample: int = SAMPLE) -> FactorizationMachine:
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 1))
    labels = labels.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    picked = labels.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), F.col("__key") == F.col("__id"))
    rows = rows.groupBy("__id").agg(F.min("text").alias("text"), F.max("__label").alias("label"))  # at most `sample` rows, as an id counts once
    once = stored(rows.groupBy("text").agg(F.max("label").alias("label")), "labelled")
    n, toxic = once.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = once.mapInArrow(_count_terms, "bucket int, n long, toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    expected = F.col("n") * F.lit(toxic / max(n, 1))
    chi2 = (F.col("t") - expected) ** 2 / (expected * F.lit(1 - toxic / max(n, 1)) * (1 - F.col("n") / F.lit(n + 1)))
    top = counts.where(F.col("n") >= LEAST_DOCS).select("bucket", chi2.alias("chi2")) if 0 < toxic < n else counts.select("bucket", F.lit(0.0).alias("chi2"))
    chosen = np.array([r[0] for r in top.where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "bucket").collect()], dtype=np.int64)
    fitted = once.mapInArrow(_keep_terms({int(b): i for i, b in enumerate(chosen)}), "label int, terms array<int>").collect()
    fitted.sort(key=lambda r: (r[0], r[1]))  # as the tasks' order varies
    bias, weights, factors = fit([np.array(r[1], dtype=np.int64) for r in fitted], np.array([r[0] for r in fitted], dtype=float), len(chosen))
    return FactorizationMachine(bias, chosen, weights, factors)


def score(docs: DataFrame, model: FactorizationMachine, id_col="doc_id", text_col="text") -> DataFrame:
    """id_col, held_out, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of RANK + 1 numbers at most

    def run(batches):
        terms = Terms()
        for batch in batches:
            scores = [shared.value.score(buckets(t, terms)) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], [id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, (fold(id_col) == 1).alias("held_out"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: FactorizationMachine, text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with all their columns, less the documents scored at threshold or above."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        terms = Terms()
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(buckets(t, terms)) < threshold for t in texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
