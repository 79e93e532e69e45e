"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, id_type, lean, ship, stash, text_field, trim, whole_row, with_carried
from .textkit import SPACE, flat, slices, span_hashes, word_spans

TEXT_BUCKETS, META_BUCKETS = 1 << 12, 1 << 9
#: Classes of bytes whose shares are features of the text view: capitals, lower case, digits, blanks, stops, shouts, symbols,
#: first bytes of others. No byte is of two classes.
_SHAPES = (
    np.array([65 <= b <= 90 for b in range(256)]),
    np.array([97 <= b <= 122 for b in range(256)]),
    np.array([48 <= b <= 57 for b in range(256)]),
    SPACE,
    np.array([chr(b) in ".,;:" for b in range(256)]),
    np.array([chr(b) in "!?" for b in range(256)]),
    np.array([chr(b) in "#*$%&|<>=_~^@+\\/{}[]" for b in range(256)]),
    np.array([b >= 0xC2 for b in range(256)]),
)
_SHAPE_OF = sum(((i + 1) * mask for i, mask in enumerate(_SHAPES)), np.zeros(256, int)).astype(np.uint8)
TEXT_DENSE = len(_SHAPES) + 4
META_DENSE = 4


def text_view(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Dense features of each whole text, shares and logarithms, and the buckets of its different words."""
    buf, off = flat(texts)
    n, size = len(off) - 1, np.diff(off)
    shapes = np.bincount(np.repeat(np.arange(0, 16 * n, 16, dtype=np.int32), size) + _SHAPE_OF[buf], minlength=16 * n).reshape(n, 16)
    columns = list((shapes[:, 1 : len(_SHAPES) + 1] / np.maximum(size, 1)[:, None]).T)
    starts, ends, first = word_spans(buf, off)
    h = span_hashes(buf, starts, ends)
    words = np.diff(first)
    letters = np.concatenate([[0], np.cumsum(ends - starts)])
    columns.append((letters[first[1:]] - letters[first[:-1]]) / np.maximum(words, 1) / 10)
    # A text's number over 40 bits of each word: one sort finds the different words of all texts.
    of = np.repeat(np.arange(n, dtype=np.uint64), words)
    own = np.sort(of << np.uint64(40) | h >> np.uint64(24))
    own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
    columns.append(np.bincount((own >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(words, 1))
    bits = np.uint64(TEXT_BUCKETS.bit_length() - 1)
    at = np.sort((own >> np.uint64(40)) << bits | (own >> np.uint64(16)) & np.uint64(TEXT_BUCKETS - 1))
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    buckets = np.split((at & np.uint64(TEXT_BUCKETS - 1)).astype(np.int32), np.searchsorted(at >> bits, np.arange(1, n, dtype=np.uint64))) if n else []
    lines = [(t or "").split("\n") for t in texts.to_pylist()]
    columns.append(np.array([len(set(x)) / len(x) for x in lines]))
    columns.append(np.log1p(words) / 10)
    return np.stack(columns, 1), buckets


def meta_view(lang: list, source: list, n_chars: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Dense features and buckets of a page's metadata: language, source and recorded length, each null or not."""
    size = np.array([0 if c is None else max(0, c) for c in n_chars], float)
    dense = np.stack([np.log1p(size) / 10, np.array([c is None for c in n_chars], float), np.array([x is None for x in lang], float), np.array([x is None for x in source], float)], 1)
    buckets = []
    for a, b, c in zip(lang, source, size.tolist(), strict=True):
        names = {f"lang={a}", f"source={b}", f"size={int(np.log2(c + 1))}", f"lang={a}&size={int(np.log2(c + 1))}"}
        buckets.append(np.unique(np.array([zlib.crc32(x.encode()) % META_BUCKETS for x in names], np.int32)))
    return dense, buckets


@dataclass
class View:
    """A logistic regression on dense features and buckets, and a straight line that calibrates its score."""

    dense: np.ndarray
    sparse: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, dense: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
        out = ((dense - self.centre) / self.scale * self.dense).sum(1) + self.bias
        return out + np.array([self.sparse[b].sum() / np.sqrt(max(1, len(b))) for b in buckets])

    def logit(self, dense: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
        return self.raw(dense, buckets) * self.slope + self.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_view(dense: np.ndarray, buckets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, n_buckets: int, steps: int = 200, l2: float = 1e-3) -> View:
    """Weighted logistic regression by adaptive gradient steps from zero; the same rows give the same model."""
    centre, scale = dense.mean(0), dense.std(0) + 1e-3
    x = (dense - centre) / scale
    rows = np.repeat(np.arange(len(y)), [len(b) for b in buckets])
    at = np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
    value = np.repeat([1 / np.sqrt(max(1, len(b))) for b in buckets], [len(b) for b in buckets])
    w, v, bias = np.zeros(dense.shape[1]), np.zeros(n_buckets), 0.0
    gw, gv, gb = np.full_like(w, 1e-8), np.full_like(v, 1e-8), 1e-8
    weight = weight / weight.sum()
    for _ in range(steps):
        z = x @ w + bias + np.bincount(rows, weights=v[at] * value, minlength=len(y))
        error = (_sigmoid(z) - y) * weight
        dw, dv, db = x.T @ error + l2 * w, np.bincount(at, weights=error[rows] * value, minlength=n_buckets) + l2 * v, error.sum()
        gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
        w, v, bias = w - 0.3 * dw / np.sqrt(gw), v - 0.3 * dv / np.sqrt(gv), bias - 0.3 * db / np.sqrt(gb)
    return View(w, v, float(bias), centre, scale)


#: Held-out rows of each class that a calibration needs, and the least rise of log-odds over one deviation of a score.
LEAST_HELD, LEAST_RISE = 5, 0.05


def calibrate(view: View, raw: np.ndarray, y: np.ndarray) -> None:
    """Sets slope and shift to the logistic regression of y on the raw score, targets drawn in a little from 0 and 1.

    Newton steps are halved until the loss falls, so that separable rows end at a finite line too. With few rows of a class
    the raw score is kept and only shifted by the log-odds of the labels. The slope is positive whatever the rows say: a
    score that does not rise with quality is flattened, its order is kept.
    """
    good, bad = float(y.sum()), float(len(y) - y.sum())
    prior = float(np.log((good + 1) / (bad + 1)))
    centre, spread = float(raw.mean()), float(raw.std())
    if min(good, bad) < LEAST_HELD or spread < 1e-9:
        view.slope, view.shift = 1.0, prior
        return
    x = (raw - centre) / spread
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(line: np.ndarray) -> float:
        z = line[0] * x + line[1]
        return float((np.logaddexp(0, z) - target * z).sum())

    line = np.array([0.0, prior])
    best = loss(line)
    for _ in range(100):
        p = _sigmoid(line[0] * x + line[1])
        g, s = p - target, p * (1 - p)
        gradient = np.array([(g * x).sum(), g.sum()])
        step = np.linalg.solve(np.array([[(s * x * x).sum() + 1e-6, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]]), gradient)
        scale = 1.0
        while scale > 1e-8 and loss(line - scale * step) > best - 1e-4 * scale * float(gradient @ step):
            scale /= 2
        line = line - scale * step
        now = loss(line)
        if scale <= 1e-8 or best - now < 1e-10 * (1 + abs(best)):
            break
        best = now
    rise, shift = (float(line[0]), float(line[1])) if line[0] >= LEAST_RISE else (LEAST_RISE, prior)
    view.slope, view.shift = rise / spread, shift - rise * centre / spread


@dataclass
class CoTrained:
    text: View
    meta: View
    prior: float  # log-odds of the labels

    def score(self, text: tuple, meta: tuple) -> np.ndarray:
        """The probability of good quality: both views' log-odds, the prior counted once."""
        return _sigmoid(self.text.logit(*text) + self.meta.logit(*meta) - self.prior)


def _balance(y: np.ndarray) -> np.ndarray:
    return np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))


@dataclass
class Rows:
    """Both views of some rows, with a label of each row for each view: 0, 1, or -1 for none."""

    text: tuple[np.ndarray, list]
    meta: tuple[np.ndarray, list]
    for_text: np.ndarray
    for_meta: np.ndarray

    def part(self, name: str, at: np.ndarray) -> tuple[np.ndarray, list]:
        dense, buckets = getattr(self, name)
        return dense[at], [buckets[i] for i in at.tolist()]

    def joined(self, more: "Rows") -> "Rows":
        return Rows(
            *((np.concatenate([a[0], b[0]]), a[1] + b[1]) for a, b in ((self.text, more.text), (self.meta, more.meta))),
            np.concatenate([self.for_text, more.for_text]),
            np.concatenate([self.for_meta, more.for_meta]),
        )


def fit_pair(rows: Rows, n_labelled: int) -> CoTrained | None:
    """Both views from rows, the first n_labelled with labels, the others with pseudo-labels that weigh half.

    A third of the labelled rows only calibrate. None if a class is missing among the labels.
    """
    known = np.arange(n_labelled)
    label = rows.for_text[:n_labelled]
    if len(np.unique(label)) < 2:
        return None
    held, learn = known[known % 3 == 2], known[known % 3 != 2]
    if len(np.unique(label[learn])) < 2 or len(np.unique(label[held])) < 2:
        held = learn = known
    views = {}
    for name, n_buckets in (("text", TEXT_BUCKETS), ("meta", META_BUCKETS)):
        given = getattr(rows, f"for_{name}")
        extra = n_labelled + np.flatnonzero(given[n_labelled:] >= 0)
        at = np.concatenate([learn, extra])
        y = given[at].astype(float)
        weight = _balance(y) * np.where(at < n_labelled, 1.0, 0.5)
        views[name] = fit_view(*rows.part(name, at), y, weight, n_buckets)
        calibrate(views[name], views[name].raw(*rows.part(name, held)), label[held].astype(float))
    base = float(np.clip(label[held].mean(), 0.01, 0.99))
    return CoTrained(views["text"], views["meta"], float(np.log(base / (1 - base))))


def _views(batch: pa.RecordBatch, texts: pa.Array) -> tuple[tuple, tuple]:
    lang, source, size = (batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
    return text_view(texts), meta_view(lang, source, size)


def _picked(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, size_col: str, carry: bool = False, text: bool = True) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        *([F.col(text_col).cast("string").alias("text")] if text else []),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.col(size_col).cast("bigint").alias("n_chars"),
        *([whole_row(docs).alias("carried")] if carry else []),
    )


#: Width of the classes of log-odds by which the most confident rows are found.
STEP = 0.05
#: Bytes of text that are worked on at a time: some fifty times as many are in use meanwhile.
SLICE = 1 << 18


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    size_col: str = "n_chars",
    label_col: str = "quality",
    sample: int = 4000,
    rounds: int = 3,
    per_round: int = 200,
    confidence: float = 0.95,
    threshold: float = 0.5,
    carry: bool = False,
) -> DataFrame:
    """Scores every document with two co-trained views: its text, and its metadata (language, source, length).

    The views learn from at most sample labelled rows, an even draw by the hash of the id. In each round both views score
    all rows without a label; of each view, the per_round most confident different texts (a share for each class as among
    the labels, confidence at least) become pseudo-labels for the other view. Every row is scored on its whole text at the
    end. Returns (id_col, text_score, meta_score, score double, kept boolean), a row for each row of docs: calibrated
    probabilities of good quality, and score >= threshold.

    Labels other than 0 and 1 and null labels count as none; of several labels of an id the least counts, and of several
    rows of a labelled id the text of least hash. Rows with a null id are scored but not learnt from. Null texts are empty,
    null metadata is a value of its own; texts of any length are read whole, a slice of them at a time. Equally confident
    texts are ordered by their hash. Without labels of both classes all scores are null and all rows kept. Repeated rows
    give repeated results; other columns are ignored; empty input gives no rows. With carry there is one more column,
    carried, a struct of the whole row: a filter needs no join to come back to its rows.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = id_type(docs, id_col)
    picked = _picked(docs, id_col, text_col, lang_col, source_col, size_col)
    hashed = picked.where(F.col("id").isNotNull()).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.min(label_col).cast("int").alias("label"))

    def features(wanted: DataFrame, on: list[str]) -> pa.Table:
        """Both views of the rows that wanted names, a few thousand at most; one row for each id, in an even order."""

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column("text"), SLICE):
                    part = batch.slice(a, b - a)
                    (td, tb), (md, mb) = _views(part, part.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("id", "h", "for_text", "for_meta")), pa.array(list(td), pa.list_(pa.float64())), pa.array(tb, pa.list_(pa.int32())), pa.array(list(md), pa.list_(pa.float64())), pa.array(mb, pa.list_(pa.int32()))],
                        names=["id", "h", "for_text", "for_meta", "td", "tb", "md", "mb"],
                    )

        drawn = hashed.join(F.broadcast(wanted.withColumnsRenamed({c: f"_{c}" for c in on})), [hashed[c] == F.col(f"_{c}") for c in on]).drop(*(f"_{c}" for c in on))
        rows = drawn.mapInArrow(lean(extract), f"id {kind}, h bigint, for_text int, for_meta int, td array<double>, tb array<int>, md array<double>, mb array<int>")
        least = rows.groupBy("id").agg(F.min(F.struct("h", "for_text", "for_meta", "td", "tb", "md", "mb")).alias("r"))
        return least.select("id", "r.*").orderBy(F.xxhash64("id"), "id").toArrow()

    def as_rows(found: pa.Table) -> Rows:
        def view(dense: str, sparse: str, width: int) -> tuple[np.ndarray, list]:
            lists = found[sparse].combine_chunks()
            cuts = lists.offsets.to_numpy()
            buckets = np.split(lists.values.to_numpy()[cuts[0] : cuts[-1]], (cuts - cuts[0])[1:-1]) if len(lists) else []
            return found[dense].combine_chunks().flatten().to_numpy().reshape(-1, width), buckets

        return Rows(view("td", "tb", TEXT_DENSE), view("md", "mb", META_DENSE), found["for_text"].to_numpy(), found["for_meta"].to_numpy())

    matched = stash(known.join(hashed.select(F.col("id").alias("lid")).distinct(), "lid", "left_semi"), "labels", narrow=True)
    share = (1.25 * sample + 64) / max(1, matched.count())
    drawn = matched if share >= 1 else matched.where(F.xxhash64("lid") < int((2 * share - 1) * 2**63))  # so that one task sorts what sample bounds
    chosen = drawn.orderBy(F.xxhash64("lid"), "lid").limit(sample).select(F.col("lid").alias("id"), F.col("label").alias("for_text"), F.col("label").alias("for_meta"))
    rows = as_rows(features(chosen, ["id"]))
    n_labelled = len(rows.for_text)
    model = fit_pair(rows, n_labelled) if n_labelled else None
    limit = float(np.log(confidence / (1 - confidence)))
    share_good = float(rows.for_text[:n_labelled].mean()) if n_labelled else 0.0
    used: dict[str, set[int]] = {"text": set(), "meta": set()}
    for _ in range(rounds if model else 0):
        found = _most_confident(hashed, known, model, used, kind, limit, {1: max(1, round(per_round * share_good)), 0: max(1, round(per_round * (1 - share_good)))})
        if not found:
            break
        for name in used:
            used[name].update(h for (_, h), given in found.items() if name in given)
        wanted = spark.createDataFrame([(i, h, given.get("text", -1), given.get("meta", -1)) for (i, h), given in found.items()], f"id {kind}, h bigint, for_text int, for_meta int")
        rows = rows.joined(as_rows(features(wanted, ["id", "h"])))
        model = fit_pair(rows, n_labelled)
    drop_stash(matched)
    del rows
    trim()
    sent = spark.sparkContext.broadcast(model)
    at = text_field(docs, text_col) if carry else None  # a row that is carried has its text with it, so that it is not sent twice

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column("text") if at is None else batch.column("carried").field(at)
            for a, b in slices(texts, SLICE):
                part = batch.slice(a, b - a)
                if m is None:
                    found = [pa.nulls(b - a, pa.float64())] * 3
                    kept = pa.array([True] * (b - a))
                else:
                    text, meta = _views(part, texts.slice(a, b - a))
                    found = [pa.array(x) for x in (_sigmoid(m.text.logit(*text)), _sigmoid(m.meta.logit(*meta)), m.score(text, meta))]
                    kept = pc.greater_equal(found[2], threshold)
                yield pa.RecordBatch.from_arrays([part.column("id"), *found, kept, *([part.column("carried")] if carry else [])], names=["id", "text_score", "meta_score", "score", "kept", *(["carried"] if carry else [])])

    rows_in = _picked(docs, id_col, text_col, lang_col, source_col, size_col, carry, text=at is None)
    return rows_in.mapInArrow(lean(score), with_carried(f"id {kind}, text_score double, meta_score double, score double, kept boolean", docs if carry else None)).withColumnRenamed("id", id_col)


def _most_confident(hashed: DataFrame, known: DataFrame, model: CoTrained, used: dict[str, set[int]], kind: str, limit: float, most: dict[int, int]) -> dict[tuple, dict[str, int]]:
    """For each view and class the different texts without a label that the other view is surest of, most[class] at most:
    {(id, hash of the text): {view to teach: class}}. Rows are scored where they lie; only sure ones are moved, equal
    texts are merged, and a histogram of the log-odds tells which are worth ordering."""
    sent = hashed.sparkSession.sparkContext.broadcast((model, {k: np.array(sorted(v), np.int64) for k, v in used.items()}))

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, done = sent.value
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                part = batch.slice(a, b - a)
                text, meta = _views(part, part.column("text"))
                h = part.column("h").to_numpy()
                for teach, z in (("meta", m.text.logit(*text)), ("text", m.meta.logit(*meta))):
                    at = np.flatnonzero((np.abs(z) >= limit) & ~np.isin(h, done[teach]))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), pa.array(h[at]), pa.array([teach] * len(at), pa.string()), pa.array(z[at])], names=["id", "h", "teach", "z"])

    rows = hashed.mapInArrow(lean(sure), f"id {kind}, h bigint, teach string, z double")
    rows = rows.join(known, rows["id"] == known["lid"], "left_anti")
    merged = rows.groupBy("teach", "h").agg(F.min(F.struct("id", "z")).alias("r"))
    merged = stash(merged.select("teach", "h", "r.id", (F.col("r.z") > 0).cast("int").alias("y"), F.abs("r.z").alias("z")).withColumn("bin", F.floor(F.least("z", F.lit(30.0)) / STEP)), "sure", narrow=True)
    counts: dict[tuple[str, int], list] = {}
    for r in merged.groupBy("teach", "y", "bin").agg(F.count(F.lit(1)).alias("n")).collect():  # a few hundred classes
        counts.setdefault((r["teach"], r["y"]), []).append((r["bin"], r["n"]))
    best: DataFrame | None = None
    for (teach, y), bins in sorted(counts.items()):
        total, low = 0, 0
        for low, n in sorted(bins, reverse=True):
            total += n
            if total >= most[y]:
                break
        mine = merged.where((F.col("teach") == teach) & (F.col("y") == y) & (F.col("bin") >= low)).orderBy(F.desc("z"), F.xxhash64("h"), "h").limit(most[y])
        best = mine if best is None else best.unionByName(mine)
    out: dict[tuple, dict[str, int]] = {}
    for r in best.collect() if best is not None else []:  # most rows of each kind
        out.setdefault((r["id"], r["h"]), {})[r["teach"]] = r["y"]
    drop_stash(merged)
    return out
