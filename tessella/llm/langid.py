"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from .common import id_type, lean, ship, stash
from .textkit import slices

BUCKETS = 1 << 13
_STEP = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_buckets(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For orders 1 to 3 the bucket of the n-gram at each place of all lower-cased texts, then where each text begins
    and ends. Runs of anything but letters count as one blank."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    plain = pc.replace_substring_regex(lowered, r"[^\p{L}]+", " ")
    points = np.frombuffer("".join([f" {x} " for x in plain.to_pylist()]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(pc.utf8_length(plain).to_numpy(zero_copy_only=False) + 2)
    out = []
    for order in (1, 2, 3):
        n = len(points) - order + 1
        if n <= 0:
            out.append(np.zeros(0, np.int32))
            continue
        h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for j in range(order):
            h = (h ^ points[j : j + n]) * _STEP[j]
            h ^= h >> np.uint32(15)
        out.append((h & np.uint32(BUCKETS - 1)).astype(np.int32))
    return out, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)


def term_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the buckets it has and how often."""
    orders, begin, end = ngram_buckets(texts)
    for a, b in zip(begin, end, strict=True):
        n = np.zeros(BUCKETS, np.int64)
        for order, codes in enumerate(orders):
            if b - a > order:
                n += np.bincount(codes[a : b - order], minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield at, n[at]


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of unit length: (1 + log n) * idf."""
    w = (1 + np.log(n)) * idf[at]
    return w / max(1e-12, float(np.sqrt((w * w).sum())))


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets by labels, mostly zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return tfidf(at, n, self.idf) @ self.weights[at] + self.bias

    def probabilities(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = self.logits(at, n) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


class ProximalLeader:
    """Follow the regularised leader, per coordinate, with elastic-net penalties l1 and l2."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        score = x @ w
        p = np.exp(score - score.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        top = z.max(1, keepdims=True)
        return float((np.log(np.exp(z - top).sum(1)) + top[:, 0] - z[np.arange(len(z)), labels]).mean())

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(
    docs: DataFrame,
    may_learn: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 6000,
    least: int = 20,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 1.0,
) -> LanguageModel:
    """Learns from the rows where may_learn holds and the label is not null.

    Document frequencies cover all such rows. The regression learns from the sample different texts of least hash of text
    and label, copies counting once, and least of each label, or all it has; a fifth of them, chosen by that hash, only set the temperature. Labels are ordered by name. Without
    a row to learn from the model has no labels.
    """
    ship(docs.sparkSession)
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for a, b in slices(batch.column(0)):
                for at, _ in term_counts(batch.column(0).slice(a, b - a)):
                    total[at] += 1
                    seen += 1
        total[BUCKETS] = seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(lean(frequencies), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in found:
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    if not df[BUCKETS]:
        return LanguageModel([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))

    order = F.xxhash64("text", "label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                at, n = zip(*term_counts(part.column(2)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())), pa.array([x.astype(np.int32) for x in n], pa.list_(pa.int32()))], names=["label", "place", "at", "n"])

    drawn = rows.select("label", order.alias("place"), "text")
    different = stash(drawn.select("label", "place").distinct(), "places", narrow=True)
    last = different.orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    # Tasks send least rows a label at most to this window: a limit on row_number is applied before the shuffle.
    first = different.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("place"))).where(F.col("r") <= least)
    cuts = first.groupBy(F.col("label").alias("_label")).agg(F.greatest(F.max("place"), F.lit(last)).alias("_last"))
    drawn = drawn.join(F.broadcast(cuts), (F.col("label") == F.col("_label")) & (F.col("place") <= F.col("_last"))).select("label", "place", "text")
    drawn = drawn.mapInArrow(lean(features), "label string, place bigint, at array<int>, n array<int>").dropDuplicates(["place"]).toArrow()
    labels = sorted(set(drawn.column("label").to_pylist()))
    if not labels:
        return LanguageModel([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))
    y = np.array([labels.index(x) for x in drawn.column("label").to_pylist()])
    place = drawn.column("place").to_numpy()
    at = [np.array(x, np.int64) for x in drawn.column("at").to_pylist()]
    x = [tfidf(a, np.array(n), idf) for a, n in zip(at, drawn.column("n").to_pylist(), strict=True)]
    order_of = np.lexsort((y, place))
    held = place % 5 == 0
    held &= np.isin(y, y[~held])  # a label that only has held rows learns from them
    leader = ProximalLeader(BUCKETS + 1, len(labels), alpha, beta, l1, l2)
    learn = [i for i in order_of if not held[i]] or list(order_of)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(learn):
            leader.learn(np.append(at[i], BUCKETS), np.append(x[i], 1.0), int(y[i]))
    w = leader.weights()
    model = LanguageModel(labels, idf, w[:BUCKETS], w[BUCKETS])
    check = [i for i in order_of if held[i]]
    if check and len(labels) > 1:
        model.temperature = fit_temperature(np.array([x[i] @ model.weights[at[i]] + model.bias for i in check]), y[check])
    return model


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", unknown: str = "und") -> DataFrame:
    """(id_col, lang_pred, score) from each whole text alone; the model goes to the workers with the task, its size set
    by BUCKETS and the number of labels."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.idf.astype(np.float64), model.weights, model.bias, model.temperature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*sent.value)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
                lang, score = [], []
                for ok, (at, n) in zip(letters, term_counts(texts), strict=True):
                    p = m.probabilities(at, n) if ok and m.labels else None
                    lang.append(unknown if p is None else m.labels[int(p.argmax())])
                    score.append(0.0 if p is None else float(p.max()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang), pa.array(score)], names=["id", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), f"id {id_type(docs, id_col)}, lang_pred string, score double").withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % folds


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_fold: int = 2, **options) -> DataFrame:
    """Learns on the rows outside the held-out fold and predicts the language of every whole text.

    Returns (id_col, held_out boolean, lang_pred string, score double), a row for each row of docs. Null texts and texts
    without a letter: und, score 0.0; with nothing to learn from, all are. Rows with a null label are predicted but not
    learnt from; a null id is in no fold, held_out false, and not learnt from. Ties go to the label first by name.
    Repeated rows count each time; other columns are ignored; empty input gives no rows.
    """
    held = F.coalesce(fold(id_col) == held_fold, F.lit(False))
    with Scratch(docs.sparkSession):
        model = fit(docs, F.col(id_col).isNotNull() & ~held, text_col, lang_col, **options)
    # Folds are a function of the id: no join is needed to bring them back.
    return predict(docs, model, id_col, text_col).select(id_col, held.alias("held_out"), "lang_pred", "score")
