"""MinHash near-duplicates by an inverted join over signature coordinates."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .common import drop_stash, id_type, join_counted, lean, ship, stash
from .components import connected_components
from .textkit import LOWER, flat, mix64, slices, span_hashes, word_spans

_rng = np.random.default_rng(0x51C4)
_STEPS = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORDS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of width words, A-Z lower-cased; with fewer words the
    whole sequence is one shingle; without words the set is empty."""
    buf, off = flat(texts)
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, off)
    h = span_hashes(buf, starts, ends)
    n = np.diff(first)
    if len(h) >= width:
        rolled = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            rolled += h[j : len(h) - width + 1 + j] * _STEPS[j]
        rolled = mix64(rolled)
    out = []
    for at, m in zip(first[:-1], n, strict=True):
        if m >= width:
            out.append(np.unique(rolled[at : at + m - width + 1]))
        elif m:
            out.append(mix64(np.array([(h[at : at + m] * _STEPS[:m]).sum(dtype=np.uint64) + np.uint64(m)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _signer(width: int, k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a), width)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                signed = np.zeros((len(full), k), np.int32)
                if len(full):
                    flat_sets = np.concatenate([sets[i] for i in full])
                    begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for j in range(k):
                        least = np.minimum.reduceat(flat_sets * _COORDS[j], begins)
                        signed[:, j] = (least & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                counts = np.zeros(len(sets) + 1, np.int32)
                counts[1:][full] = k
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(signed.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary()), lists],
                    names=["id", "n", "digest", "sig"],
                )

    return sign


def _matcher(width: int, percent: int):
    """Keeps the pairs of texts whose full shingle sets have 100 * intersection >= percent * union."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(key: bytes, text: pa.Scalar) -> np.ndarray:
            found = recent.pop(key, None)
            if found is None:
                found = shingle_sets(pa.array([text.as_py()], pa.string()), width)[0]
            recent[key] = found
            if len(recent) > 32:
                recent.popitem(last=False)
            return found

        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i, (u, v) in enumerate(zip(us, vs, strict=True)):
                x, y = of(u, batch.column(2)[i]), of(v, batch.column(3)[i])
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))], names=["u", "v"])

    return match


def _long_signer(width: int, wide: int):
    """Of rows (digest, text), those whose text has that digest, with wide signature coordinates of a byte each."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column(1), width)
                keep = [i for i, (s, d) in enumerate(zip(sets, part.column(0).to_pylist(), strict=True)) if digest_of(s) == d]
                if not keep:
                    continue
                signed = np.zeros((len(keep), wide), np.uint8)
                flat_sets = np.concatenate([sets[i] for i in keep])
                begins = np.concatenate([[0], np.cumsum([len(sets[i]) for i in keep])[:-1]]).astype(np.int64)
                for j in range(wide):
                    signed[:, j] = (np.minimum.reduceat(flat_sets * _COORDS[j], begins) & np.uint64(0xFF)).astype(np.uint8)
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in signed], pa.binary())], names=["digest", "text", "wide"])

    return sign


def _merger(wide: int, least_wide: int):
    """Of rows sorted by (key, i, j), a posting list's blocks i and j: the pairs of members that have different labels
    and least_wide equal coordinates, from the first of the lists in which they meet only; a row for each member."""

    def pairs(t: pa.Table) -> pa.RecordBatch | None:
        key, i, j = (t.column(c)[0].as_py() for c in ("key", "i", "j"))
        label, block = t.column("label").to_numpy(), t.column("block").to_numpy()
        sig = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint8).reshape(len(t), wide)
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return None
        us, vs = [], []
        for at in range(0, len(left), 32):
            rows = left[at : at + 32]
            same = (sig[rows][:, None, :] == sig[right][None, :, :]).sum(2, dtype=np.int32) >= least_wide
            same &= label[rows][:, None] != label[right][None, :]
            if i == j:
                same &= rows[:, None] < right[None, :]
            x, y = np.nonzero(same)
            us.append(rows[x])
            vs.append(right[y])
        u, v = np.concatenate(us), np.concatenate(vs)
        if not len(u):
            return None
        lists = t.column("keys").to_pylist()
        most = max(map(len, lists))
        table = np.array([x + [-1 - n] * (most - len(x)) for n, x in enumerate(lists)], np.int64)
        first = np.zeros(len(u), bool)
        for at in range(0, len(u), 4096):
            a, b = table[u[at : at + 4096]], table[v[at : at + 4096]]
            first[at : at + 4096] = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int64).max).min(1) == key
        names = t.column("digest").to_pylist()
        met: dict[int, list[bytes]] = {}
        for x, y in zip(u[first].tolist(), v[first].tolist(), strict=True):
            met.setdefault(x, []).append(names[y])
            met.setdefault(y, [])
        if not met:
            return None
        n = len(met)
        return pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array([names[x] for x in met], pa.binary()), pa.array(list(met.values()), pa.list_(pa.binary()))], names=["key", "i", "j", "digest", "partners"])

    return _by_block(pairs)


def _by_block(work: Callable[[pa.Table], pa.RecordBatch | None]):
    """Applies work to each block pair of rows sorted by (key, i, j); holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            k, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            begin = 0
            for end in (np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist():
                if (out := work(t.slice(begin, end - begin))) is not None:
                    yield out
                begin = end
            held = t.slice(begin)
        if held is not None and (out := work(held)) is not None:
            yield out

    return run


def _confirmer(width: int, percent: int):
    """Of members (key, i, j, digest, partners, text) of block pairs: the partners that are similar on full sets."""

    def confirm(t: pa.Table) -> pa.RecordBatch | None:
        names = t.column("digest").to_pylist()
        sets = shingle_sets(t.column("text").combine_chunks(), width)
        every, dense = np.unique(np.concatenate(sets), return_inverse=True)
        parts = np.split(dense, np.cumsum([len(s) for s in sets])[:-1])
        place = {d: n for n, d in enumerate(names)}
        flag = np.zeros(len(every), np.int32)
        us, vs = [], []
        for n, partners in enumerate(t.column("partners").to_pylist()):
            others = [place[p] for p in partners]
            if not others:
                continue
            flag[parts[n]] = 1
            sizes = np.array([len(parts[o]) for o in others])
            shared = np.add.reduceat(flag[np.concatenate([parts[o] for o in others])], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            flag[parts[n]] = 0
            for o in np.flatnonzero(100 * shared >= percent * (sizes + len(parts[n]) - shared)).tolist():
                us.append(min(names[n], partners[o]))
                vs.append(max(names[n], partners[o]))
        return pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"]) if us else None

    return _by_block(confirm)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, k: int = 32, min_matches: int = 11, wide: int = 256, least_wide: int = 150, block: int = 1024) -> DataFrame:
    """Components of the graph that links documents whose sets of word shingles have a Jaccard similarity of percent.

    1. Equal sets are one class from the start, by digest, so that exact copies, however many, are one node.
    2. Each class has a signature of k MinHash coordinates. A posting list is all classes under one (coordinate, value)
       pair. Two classes with min_matches equal coordinates must meet among the k - min_matches + 1 rarest pairs of
       each (prefix rule), so only those that others share as well are posted: pairs that only one class has need no
       list, and passages that many documents have do not make long ones unless they make up most of a document.
    3. Merging skips what cannot add a link: first each list is linked to its least member; then lists that still hold
       several components are compared, block against block, on signatures of wide coordinates of a byte each: pairs of
       members from different components that reach the match threshold least_wide come out, each from the first list
       only in which it meets. Nothing else of a list is ever emitted.
       A row holds a member and its partners in the block, so that no table has a row for each pair, and a text goes
       once to each block where it has a partner.
    4. The pairs are confirmed on the full sets of both whole texts.

    A pair at the least similarity has 24 of 32 equal coordinates on average, and fewer than 11 with a chance of 3e-7;
    of 256 bytes it has 192 equal on average, and fewer than 150 with a chance of 2e-9. No other link is lost.

    Returns (id_col, n_shingles long, component_id, kept boolean), a row for each row of docs. component_id is the
    least id that can be reached; kept is whether that is the document's own. Texts without a word or null: n_shingles
    0, linked with nothing. A null id is never the least; a component of null ids only has component_id null and is
    kept. Repeated rows give repeated results. Other columns are ignored. Empty input gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    with Scratch(spark) as scratch:
        return scratch.keep(stash(_near_duplicates(docs, id_col, text_col, width, percent, k, min_matches, wide, least_wide, block), "components", narrow=True))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, k: int, min_matches: int, wide: int, least_wide: int, block: int) -> DataFrame:
    """The steps of near_duplicates; its result reads tables that they write."""
    kind = id_type(docs, id_col)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stash(picked.mapInArrow(lean(_signer(width, k)), f"id {kind}, n bigint, digest binary, sig array<int>"), "signed")
    classes = stash(signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("rows")), "classes")

    coords = classes.select("digest", F.posexplode("sig").alias("j", "value")).select("digest", (F.shiftleft(F.col("j").cast("long"), 32) + F.col("value").cast("long") + F.lit(2**31)).alias("key"))
    shared = coords.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    prefix = k - min_matches + 1
    common = coords.join(shared, "key").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))  # k entries at most
    postings = stash(
        common.where(F.size("keys") >= min_matches).select("digest", F.explode(F.expr(f"transform(slice(keys, 1, {prefix - k} + size(keys)), x -> x.key)")).alias("key")),
        "postings",
        narrow=True,
    )
    lists = postings.groupBy("key").agg(F.min("digest").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head")
    met = stash(postings.join(lists, "key").where("digest <> head").select(F.col("head").alias("u"), F.col("digest").alias("v")).distinct(), "met", narrow=True)

    sigs = classes.select("digest", "sig")

    def collide(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sigs.select(F.col("digest").alias("u"), F.col("sig").alias("su")), "u")
            .join(sigs.select(F.col("digest").alias("v"), F.col("sig").alias("sv")), "v")
            .where(F.expr(f"aggregate(zip_with(su, sv, (x, y) -> int(x = y)), 0, (n, x) -> n + x) >= {min_matches}"))
            .select("u", "v")
        )

    posted = postings.join(lists.select("key"), "key", "left_semi").groupBy("digest").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # k entries at most
    posted = stash(posted, "posted", narrow=True)
    wanted = classes.join(posted, "digest", "left_semi").select("digest", F.col("least").alias("id"))
    texts = stash(
        picked.join(wanted, picked["id"].eqNullSafe(wanted["id"])).select("digest", "text").mapInArrow(lean(_long_signer(width, wide)), "digest binary, text string, wide binary").dropDuplicates(["digest"]),
        "texts",
    )

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("digest").alias("v"), F.col("text").alias("tv")), "v").join(texts.select(F.col("digest").alias("u"), F.col("text").alias("tu")), "u")
        return both.select("u", "v", "tu", "tv").mapInArrow(lean(_matcher(width, percent)), "u binary, v binary")

    first = stash(confirm(collide(met)), "links1")
    labels = connected_components(first)

    labelled = stash(
        posted.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("digest", F.xxhash64(F.coalesce("label", "digest")).alias("label"), F.explode("keys").alias("key")),
        "labelled",
        narrow=True,
    )
    mixed = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z").select("key", F.expr(f"cast(ceil(n / {block}) as int)").alias("blocks"))
    dealt = (
        labelled.join(mixed, "key")
        .withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
        .join(posted, "digest")
        .join(texts.select("digest", "wide"), "digest")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "label", "block", "keys", "wide")
    )
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    cross = stash(dealt.mapInArrow(lean(_merger(wide, least_wide)), "key bigint, i int, j int, digest binary, partners array<binary>"), "cross")
    members = cross.join(texts.select("digest", "text"), "digest").select("key", "i", "j", "digest", "partners", "text")
    second = stash(members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(_confirmer(width, percent)), "u binary, v binary").distinct(), "links2", narrow=True)
    for done in (labelled, texts, met, postings, posted, cross):  # they are many: before the next tables are written
        drop_stash(done)
    final = connected_components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(second))
    named = classes.select("digest", "least", "rows").join(final.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    of_class = stash(named.join(least, "label").select("digest", "component", "rows"), "classes", narrow=True)
    found = join_counted(signed.select("id", "n", "digest"), of_class, "digest", "rows").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )
    return found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
