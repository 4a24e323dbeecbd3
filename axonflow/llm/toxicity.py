"""Toxicity by non-negative positive-unlabelled learning (operator 9).

Positives are confirmed toxic rows, everything else is unlabelled text. A linear classifier over hashed words and word
beginnings is trained with numpy on the driver, from a bounded sample: at most ``MAX_POSITIVE`` positives and
``MAX_UNLABELLED`` unlabelled rows, those with the smallest hash of doc_id. The risk is
``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])``; where the second part of a mini-batch is negative the
step goes the other way, which keeps a flexible model from fitting the positives away. Features that positives do not
have clearly more often than the whole sample are left out. The intercept is moved to where
models that have not seen the rows have the best F-measure. Every row is then scored in its whole text by the broadcast
weights, of which there are no more than the bounded sample has features.

Defined cases: null and empty texts have no features and get the score of the intercept alone; repeated rows are scored
one by one; without a positive example every score is 0; if every label is positive, the prior is short of 1 by half a label; an
empty table gives an empty result; a row with a null doc_id
is scored, and is neither sampled nor held out; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import materialize, slices, table
from axonflow.llm.shingles import CHUNK_BYTES, U, _BYTES, _powers, mix

MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
#: Bytes of a word's beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_keys(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashed features of every word of the texts, group by group: text in its group, 64-bit feature, texts in it."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        data = (text or "").encode().lower()
        if group and held + len(data) > CHUNK_BYTES:
            yield _keys(group)
            group, held = [], 0
        group.append(data)
        held += len(data) + 1
    if group:
        yield _keys(group)


def _keys(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    raw = np.frombuffer(b" ".join(group) + b" ", np.uint8)
    inside = _WORD[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, length = edge[::2], edge[1::2] - edge[::2]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), len(group)
    starts = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(starts, length)
    values = _BYTES[raw[inside]] * _powers(int(length.max()))[at]
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in group]), first, side="right")
    keys, owners = [mix(np.add.reduceat(values, starts) ^ U(99))], [owner]
    for k in BEGINNINGS:
        long = length > k
        keys.append(mix(np.add.reduceat(np.where(at < k, values, U(0)), starts)[long] ^ U(k)))
        owners.append(owner[long])
    return np.concatenate(owners), np.concatenate(keys).view(np.int64), len(group)


def known(texts: list[str | None], vocabulary: np.ndarray | None) -> list[np.ndarray]:
    """For each text its distinct features: their places in the sorted ``vocabulary``, or without one themselves."""
    out: list[np.ndarray] = []
    for owner, key, n in word_keys(texts):
        if vocabulary is not None:
            at = np.searchsorted(vocabulary, key)
            at[at == len(vocabulary)] = 0
            hit = vocabulary[at] == key if len(vocabulary) else np.zeros(len(key), bool)
            owner, key = owner[hit], at[hit]
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
        owner, key = owner[new], key[new]
        out += np.split(key, np.searchsorted(owner, np.arange(1, n)))
    return out


@dataclass(frozen=True)
class Model:
    """``vocabulary``: sorted hashes of the features in use, with their ``weights``."""

    vocabulary: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows = known(texts, self.vocabulary)
        return _sigmoid(_margin(self.weights, self.intercept, *_flat(rows)))


def _sigmoid(x):
    return np.where(np.isneginf(x), 0.0, 1 / (1 + np.exp(-np.clip(x, -60, 60))))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Features one after another, the row of each, and the number of rows."""
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes), len(rows)


def _margin(weights, intercept, flat, row, n):
    return np.bincount(row, weights[flat], n) + intercept


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int, epochs: int = 40, rate: float = 0.05, decay: float = 3e-5, batches: int = 6, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept over features 0..size-1: non-negative PU risk with logistic loss, minimised by Adam."""
    rng = np.random.default_rng(seed)
    w, m, v, t = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), 0
    w[-1] = np.log(prior / (1 - prior))
    batches = max(1, min(batches, len(positive) // 8))
    total, mean = epochs * batches, np.zeros(size + 1)
    for _ in range(epochs):
        p_parts = np.array_split(rng.permutation(len(positive)), batches)
        u_parts = np.array_split(rng.permutation(len(unlabelled)), batches)
        for p, u in zip(p_parts, u_parts, strict=True):
            if not len(p) or not len(u):
                continue
            xp, xu = _flat([positive[i] for i in p]), _flat([unlabelled[i] for i in u])
            gp, gu = _margin(w[:-1], w[-1], *xp), _margin(w[:-1], w[-1], *xu)
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            # slopes: l(g) falls by sigmoid(-g), l(-g) rises by sigmoid(g)
            up, uu = prior * _sigmoid(gp) / len(p), _sigmoid(gu) / len(u)
            if negative >= 0:
                cp, cu = -prior * _sigmoid(-gp) / len(p) - up, uu
            else:
                cp, cu = up, -uu
            g = decay * w
            g[-1] = cp.sum() + cu.sum()
            for (flat, row, _n), c in ((xp, cp), (xu, cu)):
                g[:-1] += np.bincount(flat, c[row], size)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (1 - t / (total + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            if 2 * t > total:  # steps that go the other way leave noise in the last weights
                mean += (w - mean) / (t - total // 2)
    w = mean if t else w
    return w[:-1], float(w[-1])


#: A feature is used if at least so many positives have it, and so many standard deviations more than expected.
LEAST_POSITIVE, LEAST_Z = 5, 4.0
#: Weight of recall beside precision where the cut is set; folds of the models that have not seen what they are cut by; and
#: the precision under which no cut is taken, so that never more fine rows than toxic ones are rejected for the sake of recall.
BETA, FOLDS, LEAST_PRECISION = 2.0, 3, 0.5


def cut(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int, beta: float = BETA, folds: int = FOLDS) -> float:
    """The margin with the best F-measure, estimated from models of the other folds without any negative label.

    Recall is the share of positives above a margin, precision ``prior * recall`` over the share of unlabelled rows above it.
    The class estimator ranks well but its zero lies where the loss puts it, which with few positives is too high. Where no
    margin sets the positives apart, the zero stays.
    """
    if len(positive) < 2 * folds or len(unlabelled) < 2 * folds:
        return 0.0
    margins: tuple[list, list] = ([], [])
    for k in range(folds):
        weights, intercept = train(*([x for i, x in enumerate(rows) if i % folds != k] for rows in (positive, unlabelled)), prior, size)
        for found, rows in zip(margins, (positive, unlabelled), strict=True):
            found.append(_margin(weights, intercept, *_flat(rows[k::folds])))
    p, u = (np.sort(np.concatenate(m)) for m in margins)
    recall = 1 - np.searchsorted(p, p) / len(p)
    share = 1 - np.searchsorted(u, p) / len(u)
    precision = np.minimum(1, prior * recall / np.maximum(share, 1e-9))
    measure = np.where(precision >= LEAST_PRECISION, (1 + beta**2) * precision * recall / (beta**2 * precision + recall), 0.0)
    return float(p[np.argmax(measure)]) if measure.any() else 0.0


def held_out() -> F.Column:
    """Every fifth row by the CRC-32 of its id's decimal digits; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = known(batch.column("text").to_pylist(), None)
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(rows, pa.list_(pa.int64()))], names=["positive", "features"])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); held-out rows take no part, with label or text."""
    marked = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = materialize(marked, "toxic-labels")
    prior, order = marked.agg(F.avg("toxic")).first()[0], F.xxhash64("doc_id", F.lit(5))
    if not prior:
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    confirmed = marked.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(max_positive)
    others = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order, "doc_id").limit(max_unlabelled)
    # both samples are bounded by their limits, so they may be broadcast
    ids = confirmed.select("doc_id", F.lit(True).alias("positive")).union(others.select("doc_id", F.lit(False)))
    texts = docs.select("doc_id", "text").join(F.broadcast(materialize(ids, "toxic-sample")), "doc_id").select("text", "positive")
    # copies count once
    sample = texts.groupBy("positive", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text")).select("text", "positive")
    sample = materialize(sample.mapInArrow(_explained, "positive boolean, features array<long>"), "toxic-features")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    counts = sample.select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("positive").alias("p"), F.count(F.lit(1)).alias("n"))
    expected = F.col("n") * n_p / max(n_p + n_u, 1)
    z = (F.col("p") - expected) / F.sqrt(expected)
    best = counts.where(F.col("p") >= LEAST_POSITIVE).select("f", z.alias("z")).where(F.col("z") >= LEAST_Z)  # of the bounded sample
    vocabulary = np.sort(np.array([r["f"] for r in best.collect()], np.int64))
    sent = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.flatnonzero(np.isin(sent.value, np.array(f, np.int64))) for f in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(rows, pa.list_(pa.int32()))], names=["positive", "places"])

    found = {True: [], False: []}
    for r in sample.mapInArrow(places, "positive boolean, places array<int>").collect():
        found[r["positive"]].append(np.array(r["places"], np.int64))
    for kind in found:  # the rows come in any order
        found[kind].sort(key=lambda x: (len(x), x.tolist()))
    # never all or none, however the labels are
    known_labels = marked.count()
    prior = min(max(float(prior), 0.5 / known_labels), 1 - 0.5 / known_labels)
    weights, intercept = train(found[True], found[False], prior, len(vocabulary))
    return Model(vocabulary, weights, intercept - cut(found[True], found[False], prior, len(vocabulary)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` (0 to 1) to doc_id and text of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = sent.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = sent.value.scores(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op9_toxicity": op9_toxicity}
