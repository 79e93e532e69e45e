"""Packing of token pieces into sequences by linear grouping, few-size configurations and best fit.

Everything that the driver holds is a histogram over lengths or free places, which the sequence length bounds; pieces
themselves are numbered and placed by distributed joins-free lookups in those plans.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import vocabulary
from ..runtime import Scratch
from .common import id_type, lean, ship, stash
from .textkit import flat, slices, span_hashes, word_spans

#: A vocabulary of the kind whose ids are those of its words: white space is dropped, nothing is merged across
#: it, letters are lower-cased, and a stop is not merged with what is before it.
WORDS_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

def _encode_chunks(tokenizer, chunks: list[str], together: int = 256) -> list[tuple[str, bytes]]:
    """Each chunk with its ids. Chunks go to the library by the hundred, with a mark between them that is a token of
    its own; chunks that hold the mark go alone."""
    mark = "\x01"
    ids = tokenizer.encode(mark, add_special_tokens=False).ids
    alone = chunks if len(ids) != 1 else [c for c in chunks if mark in c]
    out = [(c, array("I", e.ids).tobytes()) for c, e in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True)]
    if len(ids) == 1:
        rest = [c for c in chunks if mark not in c]
        groups = [rest[at : at + together] for at in range(0, len(rest), together)]
        for at in range(0, len(groups), 100):
            some = groups[at : at + 100]
            for group, e in zip(some, tokenizer.encode_batch_fast([f" {mark} ".join(g) for g in some], add_special_tokens=False), strict=True):
                found = np.array(e.ids, "<u4")
                cuts = (4 * np.flatnonzero(found == ids[0])).tolist()
                raw = found.tobytes()
                out.extend(zip(group, [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)], strict=True)], strict=True))
    return out


def reads_words(path: str) -> bool:
    """Whether the ids of a text are those of its words by the vocabulary at path: see WORDS_NORMALIZER."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    known = spec.get("normalizer") == WORDS_NORMALIZER and split.get("pattern") == {"Regex": WORDS_PATTERN} and split.get("behavior") == "Removed"
    known = known and [r.get("type") for r in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and spec.get("post_processor") is None
    return known and not any(any(c.isspace() or c.isalnum() and t["content"].isalnum() for c in t["content"]) for t in spec["added_tokens"])


class WordIds:
    """The ids of words by the tokenizers library, kept in arrays sorted by the words' 64-bit hashes.

    A vocabulary that reads words (see reads_words) drops white space and never merges across it, so that the ids of a text
    are those of its words. Nor does it merge letters or digits with stops behind them, and it lower-cases: a plain ASCII
    word is asked for in lower case and without its stops. With other vocabularies whole texts go to the library. At most
    about max_kept words are kept; beyond that all are forgotten.
    """

    def __init__(self, path: str, max_kept: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word, self.max_kept = Tokenizer.from_file(path), reads_words(path), max_kept
        self.parts: dict[str, bytes] = {"": b""}
        self._forget()

    def _forget(self) -> None:
        self.key, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _ask(self, words: list[str]) -> list[bytes]:
        if len(self.parts) > self.max_kept // 12:
            self.parts = {"": b""}
        cut: list[tuple[str, str]] = []
        for w in words:
            low = w.lower() if w.isascii() else ""
            word = low.rstrip(".,")
            cut.append((word, low[len(word) :]) if word.isalnum() else (w, ""))
        new = {p for pair in cut for p in pair if p not in self.parts}
        self.parts.update(_encode_chunks(self.tokenizer, list(new)))
        found = [self.parts[a] + self.parts[b] for a, b in cut]
        for p in new:
            if len(p) > 256:
                self.parts.pop(p, None)
        return found

    def _learn(self, key: np.ndarray, words: list[str]) -> None:
        ids = self._ask(words)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        begin = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        self.key, self.begin, self.size = (np.concatenate(x) for x in ((self.key, key), (self.begin, begin), (self.size, size)))
        order = np.argsort(self.key)
        self.key, self.begin, self.size = self.key[order], self.begin[order], self.size[order]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        buf, off = flat(texts)
        starts, ends, first = word_spans(buf, off)
        wanted, at, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.key) + len(wanted) > self.max_kept:
            self._forget()
        place = np.searchsorted(self.key, wanted)
        lost = np.ones(len(wanted), bool)
        inside = place < len(self.key)
        lost[inside] = self.key[place[inside]] != wanted[inside]
        new = np.flatnonzero(lost)
        if len(new):
            raw = buf.tobytes()
            self._learn(wanted[new], [raw[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            place = np.searchsorted(self.key, wanted)
        size = self.size[place][which]
        behind = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.begin[place][which] - behind[:-1], size) + np.arange(behind[-1])]
        edge = behind[first]
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


_words: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One for each vocabulary and worker process."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and end_id, cut into pieces of size ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer if os.sep in tokenizer else vocabulary(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        words = encoder(path)
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 22):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, found in enumerate(words.encode(batch.column(1).slice(a, b - a))):
                    ids = found.astype("<u4", copy=False).tobytes() + end
                    for p, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        rows.append(a + i)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), f"id {id_type(docs, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint")


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Ways to fill sequences with items of few sizes, each with how often it is used; together they hold all items.

    Column generation on the covering program: a basis of as many configurations as sizes, prices from it, and an
    unbounded knapsack over the capacity that finds the best new configuration; then whole parts of the solution, and
    best fit decreasing for the rest. counts are bounded only by the data; the work depends on sizes alone.
    """
    m = len(sizes)
    if not m:
        return []
    demand = np.array(counts, float)
    basis = np.zeros((m, m))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    used = demand / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(m))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i in np.argsort(sizes):
            s, p = sizes[i], price[i]
            if p <= 1e-12:
                continue
            for lo in range(s, capacity + 1, s):  # each block of s places depends on the block before
                hi = min(lo + s, capacity + 1)
                gain = best[lo - s : hi - s] + p
                better = gain > best[lo:hi] + 1e-12
                best[lo:hi][better] = gain[better]
                last[lo:hi][better] = i
        if best[capacity] <= 1 + 1e-9:
            break
        column, left = np.zeros(m), capacity
        while left > 0 and last[left] >= 0:
            column[last[left]] += 1
            left -= sizes[last[left]]
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        step = max(0.0, ratio[out])
        used = used - step * change
        used[out] = step
        basis[:, out] = column
    rest, plan = list(counts), []
    for j in np.argsort(-used):
        config = [int(round(x)) for x in basis[:, j]]
        times = int(used[j] + 1e-6)
        times = min([times, *(rest[i] // c for i, c in enumerate(config) if c)])
        if times > 0:
            plan.append((config, times))
            rest = [r - c * times for r, c in zip(rest, config, strict=True)]
    order = sorted(range(m), key=lambda i: -sizes[i])
    while any(rest):
        config, left = [0] * m, capacity
        for i in order:
            c = min(rest[i], left // sizes[i])
            config[i], left = c, left - c * sizes[i]
        times = min(rest[i] // c for i, c in enumerate(config) if c)
        plan.append((config, times))
        rest = [r - c * times for r, c in zip(rest, config, strict=True)]
    return plan


class Places:
    """A plan for one kind of item: for ranks from begin to end, which sequences take them and at which place.

    Within a run, times items of the same sequence follow each other: item r goes to sequence base + (r - begin) // per
    and is its (r - begin) % per + slot'th item.
    """

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.filled: dict[int, int] = {}

    def add(self, kind: int, items: int, base: int, per: int, slot: int) -> None:
        begin = self.filled.get(kind, 0)
        self.runs.setdefault(kind, []).append((begin, base, per, slot))
        self.filled[kind] = begin + items

    def arrays(self) -> dict[int, np.ndarray]:
        return {k: np.array(v, np.int64) for k, v in self.runs.items()}


def plan_large(hist: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple[int, int, int]], Places, int]:
    """Linear grouping of the lengths in hist: (lengths by descending order with the rank where each begins), places by
    group, and the number of sequences."""
    lengths = sorted(hist, reverse=True)
    total = sum(hist.values())
    begins, rank = [], 0
    for x in lengths:
        begins.append((x, rank, hist[x]))
        rank += hist[x]
    if not total:
        return [], Places(), 0
    share = -(-total // groups)
    sizes, counts = [], []
    tops = [b for _, b, _ in begins]
    for g in range(0, total, share):
        sizes.append(lengths[bisect.bisect_right(tops, g) - 1])  # the largest of the group: all are rounded up to it
        counts.append(min(share, total - g))
    merged: dict[int, int] = {}
    for s, c in zip(sizes, counts, strict=True):
        merged[s] = merged.get(s, 0) + c
    names = sorted(merged, reverse=True)
    places, n = Places(), 0
    for config, times in configurations(names, [merged[s] for s in names], capacity):
        slot = 0
        for kind, c in enumerate(config):
            if c:
                places.add(kind, c * times, n, c, slot)
                slot += c
        n += times
    edges, at = [], 0
    for kind, s in enumerate(names):
        edges.append((at, kind, merged[s]))
        at += merged[s]
    return [(x, b, c) for x, b, c in begins], _by_rank(places, edges), n


def _by_rank(places: Places, edges: list[tuple[int, int, int]]) -> Places:
    """The same places under one kind, 0, with ranks over all groups from the longest item on."""
    out = Places()
    for begin, kind, count in edges:
        for start, base, per, slot in places.runs.get(kind, []):
            out.runs.setdefault(0, []).append((begin + start, base, per, slot))
        out.filled[0] = begin + count
    return out


def plan_small(free: dict[int, int], hist: dict[int, int], capacity: int, n_bins: int) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Best fit of small items, longest first, into classes of sequences that have equal free room.

    free: room -> number of sequences. Sequences of one room are numbered; a class is a range of such numbers with the
    room it has by now. Gives for each length its runs (begin, origin, first, per, taken): item r of the length goes to
    sequence number first + (r - begin) // per of those that had room origin at the start (origin -1: new sequences),
    behind what that sequence has had put in, taken, and (r - begin) % per items of the same run.
    """
    classes: dict[int, list[tuple[int, int, int, int]]] = {}  # room -> (origin, first, count, taken)
    for room, count in sorted(free.items()):
        if room > 0 and count:
            classes[room] = [(room, 0, count, 0)]
    rooms = sorted(classes)
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    opened = 0

    def put(room: int, x: tuple[int, int, int, int]) -> None:
        if room <= 0:
            return
        if room not in classes:
            bisect.insort(rooms, room)
            classes[room] = []
        classes[room].append(x)

    for length in sorted(hist, reverse=True):
        left, begin, out = hist[length], 0, []
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                bins = -(-left // per)
                put(capacity, (-1, opened, bins, 0))
                opened += bins
                continue
            room = rooms[at]
            origin, first, count, taken = classes[room].pop()
            if not classes[room]:
                del classes[room]
                rooms.pop(at)
            per = min(room // length, left)
            full = min(count, left // per)
            out.append((begin, origin, first, per, taken))
            put(room - per * length, (origin, first, full, taken + per * length))
            if full < count:
                put(room, (origin, first + full, count - full, taken))
            begin += full * per
            left -= full * per
        runs[length] = out
    return runs, opened


def _ranked(df: DataFrame, by: list[str], order: list[str], salt: list[str], rows: int, name: str, block: int = 20_000) -> DataFrame:
    """Numbers the rows from 0 within each value of by, without ever bringing one value's rows into one task.

    Rows are dealt into about rows / block buckets by a hash of salt; they are numbered within (by, bucket), and the
    counts of the buckets before, a table of values times buckets, are added.
    """
    buckets = max(1, -(-rows // block))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*salt), F.lit(buckets)).cast("int"))
    tally = dealt.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = tally.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).drop("_n")
    local = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)).cast("long") - 1)
    return local.join(before, [*by, "_b"]).withColumn(name, F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")


def _locate(runs: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of each rank, and the rank within the run."""
    at = np.searchsorted(runs[:, 0], ranks, "right") - 1
    return at, ranks - runs[at, 0]


def best_fit_packing(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    size: int = 4096,
    groups: int = 48,
    small_share: int = 8,
) -> DataFrame:
    """Packs all documents into few sequences of at most size tokens.

    A document is its ids by the tokenizer and end_id; only longer ones than size are cut, into pieces of size (the
    last may be shorter). Pieces above size / small_share are large: sorted by length they are dealt into groups of
    equal cardinality and rounded up to the longest of the group; configurations of these few sizes are optimised;
    actual pieces take the places by their rank. What room they leave is then filled, best fit, longest first, with
    the small pieces; new sequences are opened only when no room is large enough.

    Returns (id_col, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long), a row for each
    piece; sequences are gapless from offset 0. Null and empty texts are one piece of end_id alone; very long ones are as
    many pieces as they need. Pieces of one length are numbered in buckets of equal shares, whatever their ids are (null,
    or one for many rows), and in a bucket by (id, piece). Repeated rows are pieces of their own. Empty input gives no
    rows; other columns are ignored. The driver holds one count for each length and each free room, at most 2 * size numbers, and the plan.
    """
    spark = docs.sparkSession
    ship(spark)
    with Scratch(spark) as scratch:
        return scratch.keep(stash(_packed(docs, id_col, text_col, tokenizer, end_id, size, groups, small_share), "packed"))


def _packed(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, size: int, groups: int, small_share: int) -> DataFrame:
    """The steps of best_fit_packing; its result reads tables that they write."""
    pieces = stash(token_pieces(docs, id_col, text_col, tokenizer, end_id, size).withColumn("at", F.monotonically_increasing_id()), "pieces")
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = size // small_share
    rows = sum(hist.values())
    ranked = stash(_ranked(pieces, ["length"], ["id", "piece", "ids_crc32"], ["at"], rows, "rank").drop("at"), "ranked")

    begins, places, n_bins = plan_large({x: c for x, c in hist.items() if x > limit}, size, groups)
    first_rank = np.zeros(size + 1, np.int64)
    for x, b, _ in begins:
        first_rank[x] = b
    runs = np.array(sorted(places.runs.get(0, [])), np.int64).reshape(-1, 4)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at, r = _locate(runs, batch.column(batch.schema.get_field_index("rank")).to_numpy() + first_rank[length])
            per = runs[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs[at, 1] + r // per), pa.array(runs[at, 3] + r % per)], names=[*batch.schema.names, "bin", "slot"])

    fields = f"id {id_type(docs, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint"
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    large = ranked.where(F.col("length") > limit).select(*columns, "rank").mapInArrow(lean(seat), f"{fields}, rank bigint, bin bigint, slot bigint")
    # A sequence holds fewer than small_share large pieces, so that its window is small.
    over = Window.partitionBy("bin").orderBy("slot")
    large = stash(large.withColumn("offset", F.sum("length").over(over) - F.col("length")).withColumn("room", size - F.sum("length").over(Window.partitionBy("bin"))), "large")

    bins = large.where("slot = 0").select("bin", "room")
    free = {r["room"]: r["n"] for r in bins.groupBy("room").agg(F.count(F.lit(1)).alias("n")).collect()}
    fill, opened = plan_small(free, {x: c for x, c in hist.items() if x <= limit}, size, n_bins)
    tables = {x: np.array(v, np.int64).reshape(-1, 5) for x, v in fill.items()}

    def pour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            origin, number, behind = (np.zeros(len(rank), np.int64) for _ in range(3))
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                t = tables[int(x)]
                at, r = _locate(t, rank[mine])
                origin[mine], number[mine] = t[at, 1], t[at, 2] + r // t[at, 3]
                behind[mine] = t[at, 4] + r % t[at, 3] * x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(origin), pa.array(number), pa.array(behind)], names=[*batch.schema.names, "room", "number", "behind"])

    small = ranked.where(F.col("length") <= limit).select(*columns, "rank").mapInArrow(lean(pour), f"{fields}, rank bigint, room bigint, number bigint, behind bigint")
    numbered = _ranked(bins.where("room > 0"), ["room"], ["bin"], ["bin"], max(1, sum(free.values())), "number")
    hosted = small.where("room >= 0").join(numbered, ["room", "number"]).select(*columns, F.col("bin").alias("sequence_id"), (F.lit(size) - F.col("room") + F.col("behind")).alias("offset"))
    alone = small.where("room < 0").select(*columns, (F.lit(n_bins) + F.col("number")).alias("sequence_id"), F.col("behind").alias("offset"))
    whole = large.select(*columns, F.col("bin").alias("sequence_id"), "offset").unionByName(hosted).unionByName(alone)
    return whole.select(F.col("id").alias(id_col), *columns[1:], F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
