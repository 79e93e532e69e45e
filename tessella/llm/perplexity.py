"""Quality rules: base counts, and perplexity bands of a modified Kneser-Ney n-gram model counted by Spark.

The model is one of characters, all of them, of order 5, for each language. It is counted, smoothed and stored by Spark and
grows with the corpus. Its entries are sorted hash arrays in slices; the most frequent ones, a bounded number, go to every
task, and what a text has beyond them is looked up slice by slice.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .common import id_type, lean, ship, stash, trim, whole_row, with_carried
from .textkit import flat, mix64, slices, span_hashes, word_spans

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
ORDER = 5
#: Stands before the first character of a text; no character is folded to it.
PAD = 0
#: Log-probabilities are whole numbers of this part of a nat, so that their sums do not depend on an order.
UNIT = 1 << 20
#: Resolution of the distributions that bands come from, in nats a character.
STEP = 0.001

_rng = np.random.default_rng(0x4E47)
_STEPS = _rng.integers(0, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_fold: tuple[np.ndarray, np.ndarray] | None = None


def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """What each code point of the basic plane is folded to, and whether it is a capital: lower case, digits 0, blanks and
    controls a blank, line ends a line feed. Others stand for themselves."""
    global _fold
    if _fold is None:
        import unicodedata

        table, upper = np.arange(0x10000, dtype=np.uint32), np.zeros(0x10000, bool)
        for c in range(0x10000):
            ch = chr(c)
            kind, low = unicodedata.category(ch), ch.lower()
            if kind == "Nd":
                table[c] = ord("0")
            elif kind[0] in "ZC" and kind not in ("Co", "Cn", "Cs"):
                table[c] = ord(" ")
            elif len(low) == 1 and low != ch:
                table[c], upper[c] = ord(low), True
        table[[10, 13]] = 10
        _fold = table, upper
    return _fold


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded characters of all texts, each behind ORDER - 1 pads, and len + 1 offsets. A capital behind a capital is
    not folded, so that shouting is not lower-case prose."""
    front = chr(PAD) * (ORDER - 1)
    points = np.frombuffer("".join([front + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum([len(t) + ORDER - 1 for t in texts])]).astype(np.int64)
    table, upper = _fold_table()
    low = np.minimum(points, 0xFFFF)
    plane = points < 0x10000
    capital = plane & upper[low]
    again = capital.copy()
    again[1:] &= capital[:-1]
    again[:1] = False
    found = np.where(plane & ~again, table[low], points)
    for back in range(ORDER - 1):
        found[ends[:-1] + back] = PAD
    return found, ends


@dataclass
class Runs:
    """How often each text has each n-gram: runs of (gram, text, n), sorted by gram and text; and the characters of the
    different grams."""

    chars: np.ndarray
    gram: np.ndarray
    text: np.ndarray
    n: np.ndarray


def gram_runs(texts: list[str]) -> Runs:
    """The n-grams that end at each character of each text. Where they and the text's number fit into 64 bits, with the
    characters numbered as they occur, one sort does; else a hash of the gram is sorted."""
    points, ends = spelled(texts)
    if not len(points):
        return Runs(np.zeros((0, ORDER), np.uint32), *(np.zeros(0, np.int64) for _ in range(3)))
    n_places = len(points) - ORDER + 1
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(ends))[ORDER - 1 :]
    real = np.ones(len(points), bool)
    for back in range(ORDER - 1):
        real[ends[:-1] + back] = False
    real = real[ORDER - 1 :]
    present = np.flatnonzero(np.bincount(points))
    bits, text_bits = max(1, (len(present) - 1).bit_length()), max(1, (len(texts) - 1).bit_length())
    if ORDER * bits + text_bits <= 64:
        number = np.zeros(int(present[-1]) + 1, np.uint64)
        number[present] = np.arange(len(present))
        local = number[points]
        code = local[:n_places].copy()
        for j in range(1, ORDER):
            code <<= np.uint64(bits)
            code |= local[j : j + n_places]
        code <<= np.uint64(text_bits)
        code |= text
        code = np.sort(code[real])
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        n, code = np.diff(np.append(begin, len(code))), code[begin]
        text, code = (code & np.uint64((1 << text_bits) - 1)).astype(np.int64), code >> np.uint64(text_bits)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else begin
        digits = [(code[first] >> np.uint64(bits * (ORDER - 1 - j))) & np.uint64((1 << bits) - 1) for j in range(ORDER)]
        chars = present[np.stack(digits, 1).astype(np.int64)].astype(np.uint32)
    else:
        code = np.zeros(n_places, np.uint64)
        for j in range(ORDER):
            code += points[j : j + n_places].astype(np.uint64) * _STEPS[j]
        at = np.flatnonzero(real)
        at = at[np.argsort(mix64(code[at]), kind="stable")]
        code, text = mix64(code[at]), text[at].astype(np.int64)
        change = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
        begin = np.flatnonzero(change | np.concatenate([[True], text[1:] != text[:-1]])) if len(code) else np.zeros(0, np.int64)
        n, at, code, text = np.diff(np.append(begin, len(code))), at[begin], code[begin], text[begin]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else begin
        chars = points[at[first][:, None] + np.arange(ORDER)]
    gram = np.zeros(len(n), np.int64)
    gram[first[1:]] = 1
    return Runs(chars, np.cumsum(gram), text, n)


def keys_of(chars: np.ndarray, lang: str) -> np.ndarray:
    """64-bit hashes of n-grams of a language."""
    seed = int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    code = np.full(len(chars), seed, np.uint64)
    for j in range(ORDER):
        code += chars[:, j].astype(np.uint64) * _STEPS[j]
    return mix64(code).view(np.int64)


def _as_strings(chars: np.ndarray) -> list[str]:
    return np.ascontiguousarray(chars, "<u4").view(f"<U{ORDER}").ravel().tolist()


class _Tally:
    """Counts of n-grams of one language, with the least and the greatest of the marks of the texts that have them."""

    def __init__(self) -> None:
        self.chars = np.zeros((0, ORDER), np.uint32)
        self.key, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.low, self.high = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, runs: Runs, marks: np.ndarray, lang: str) -> None:
        if not len(runs.n):
            return
        begin = np.flatnonzero(np.concatenate([[True], runs.gram[1:] != runs.gram[:-1]]))
        mark = marks[runs.text]
        new = (keys_of(runs.chars, lang), np.add.reduceat(runs.n, begin), np.minimum.reduceat(mark, begin), np.maximum.reduceat(mark, begin))
        key, n, low, high = (np.concatenate([a, b]) for a, b in zip((self.key, self.n, self.low, self.high), new, strict=True))
        chars = np.concatenate([self.chars, runs.chars])
        order = np.argsort(key)
        begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        self.key, self.chars = key[order][begin], chars[order[begin]]
        self.n, self.low, self.high = np.add.reduceat(n[order], begin), np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; null is empty."""
    buf, off = flat(texts)
    starts, ends, first = word_spans(buf, off)
    n = len(off) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[off[1:]] - sums[off[:-1]]

    within = np.zeros(len(buf) + 1, np.int8)
    within[starts] += 1
    within[ends] -= 1
    in_word = np.cumsum(within[:-1], dtype=np.int8).astype(bool)
    symbols = np.zeros(256, bool)
    symbols[[ord(c) for c in SYMBOLS]] = True
    h = span_hashes(buf, starts, ends)
    windows = mix64(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xD6E8FEB86659FD93)) if len(h) > 2 else h[:0]
    repeat = np.zeros(n, np.int64)
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b - a < 4:
            continue
        own = windows[a : b - 2]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if not same.any():
            continue
        again = np.zeros(len(own), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = np.zeros(b - a, bool)
        for j in range(3):
            hit[j : len(own) + j] |= again
        repeat[d] = hit.sum()
    dup = np.zeros(n, np.int64)
    for d, t in enumerate(texts.to_pylist()):
        if not t or "\n" not in t:
            continue
        seen: set[str] = set()
        for line in t.split("\n"):
            if line in seen:
                dup[d] += 1
            elif line.strip(" \t\n\r\x0b\x0c"):
                seen.add(line)
    return {"n_words": np.diff(first), "word_chars": total(in_word & ((buf & 0xC0) != 0x80)), "n_symbols": total(symbols[buf]), "n_dup_lines": dup, "n_repeat_words": repeat}


#: The counts of the base rules, in the order of the result.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def language_key(lang: Column) -> Column:
    """A language's name as a key: null is a language of its own."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def _by_language(batch: pa.RecordBatch, column: str) -> Iterator[tuple[str, np.ndarray]]:
    names = batch.column(column).to_pylist()
    number = {x: i for i, x in enumerate(dict.fromkeys(names))}
    of = np.array([number[x] for x in names], np.int64)
    for x, i in number.items():
        yield x, np.flatnonzero(of == i)


def count_grams(rows: DataFrame, most: int = 1 << 19) -> DataFrame:
    """(lang, gram, n long, shared boolean) of rows (text, lang): n-grams of ORDER characters, how often they end at a
    character of the rows, and whether two different texts have them. Tasks merge what they count, up to most entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Tally] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, t in held.items():
                for a in range(0, len(t.n), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t.n[part]), pa.string()), pa.array(_as_strings(t.chars[part]), pa.string()), pa.array(t.n[part]), pa.array(t.low[part]), pa.array(t.high[part])], names=["lang", "gram", "n", "low", "high"])
            held.clear()

        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 21):
                part = batch.slice(a, b - a)
                for lang, at in _by_language(part, "lang"):
                    texts = pc.fill_null(part.column("text").take(pa.array(at)), "").to_pylist()
                    marks = np.array([zlib.crc32(t.encode()) for t in texts], np.uint32).view(np.int32)
                    held.setdefault(lang, _Tally()).add(gram_runs(texts), marks, lang)
                if sum(len(t.n) for t in held.values()) > most:
                    yield from sent()
        yield from sent()

    found = rows.select("text", "lang").mapInArrow(lean(count), "lang string, gram string, n bigint, low int, high int")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3, kinds): what modified Kneser-Ney takes from counts of 1, 2 and more, from how many n-grams of the
    language have counts 1 to 4; and the number of different n-grams."""
    of = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), *(F.count_if(F.col("n") == c).cast("double").alias(f"n{c}") for c in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    some = (F.col("n1") > 0) & (F.col("n2") > 0)
    raw = (1 - 2 * y * F.col("n2") / F.col("n1"), 2 - 3 * y * F.col("n3") / F.col("n2"), F.when(F.col("n3") > 0, 3 - 4 * y * F.col("n4") / F.col("n3")).otherwise(1.5))
    return of.select("lang", "kinds", *(F.when(some, F.least(F.greatest(d, F.lit(0.1)), F.lit(c - 0.05))).otherwise(0.5).alias(f"d{c}") for c, d in zip((1, 2, 3), raw, strict=True)))


def _shared() -> Column:
    return F.col("low") != F.col("high")


def kneser_ney(top: DataFrame) -> DataFrame:
    """(lang, gram, n, p, value): the interpolated probability of each n-gram's last character behind the others, and
    the logarithm that a text is charged for it.

    top: counts of the highest order. Lower orders count the different characters in front. An n-gram that no two
    different texts have counts as unseen where a text is judged, as it would otherwise be likely by its own counts: its
    value is the weight of what is shorter, and the shorter one's value.
    """
    few = top.select("lang").distinct().limit(100_001).count() <= 100_000

    def of_language(table: DataFrame) -> DataFrame:
        """A table of one row a language, sent to all tasks if its size is known to be small: a language may be hot."""
        return F.broadcast(table) if few else table

    levels = {ORDER: top}
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[order + 1].groupBy("lang", F.substring("gram", 2, order).alias("gram"))
        levels[order] = stash(shorter.agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "counts", narrow=True)
    below = None
    for order in range(1, ORDER + 1):
        counts = levels[order].join(of_language(_discounts(levels[order])), "lang")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        counts = counts.withColumns({"cut": cut, "front": F.substring("gram", 1, order - 1)})
        contexts = counts.groupBy("lang", "front").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"), (F.min("low") != F.max("high")).alias("known"))
        here = counts.join(contexts, ["lang", "front"])
        weight = F.col("freed") / F.col("total")
        if below is None:
            shorter_p = 1.0 / (F.col("kinds") + 1)
            shorter_value = F.log(shorter_p)
        else:
            here = here.withColumn("rear", F.substring("gram", 2, order - 1)).join(below.select("lang", F.col("gram").alias("rear"), F.col("p").alias("rear_p"), F.col("value").alias("rear_value")), ["lang", "rear"])
            shorter_p, shorter_value = F.col("rear_p"), F.col("rear_value")
        p = (F.col("n") - F.col("cut")) / F.col("total") + weight * shorter_p
        here = here.withColumn("p", p)
        value = F.when(_shared(), F.log("p")).otherwise(F.when(F.col("known"), F.log(weight)).otherwise(0.0) + shorter_value)
        below = here.select("lang", "gram", "n", "p", value.alias("value"))
        if order < ORDER:  # so that plans stay small
            below = stash(below, "model", narrow=True)
    return below


def _bin(n: Column) -> Column:
    """Classes of counts, eight to a doubling."""
    return F.floor(F.log2(n.cast("double")) * 8).cast("int")


def slice_bits(entries: int, per_slice: int = 1 << 14) -> int:
    """How many of a key's first bits name its slice."""
    return max(1, (max(1, entries) // per_slice).bit_length())


def store_model(model: DataFrame, bits: int) -> DataFrame:
    """(slice, entries): the model as sorted hash arrays, entries an array of (key, value, n) in ascending order of the key,
    a slice a range of keys, so that slices are equal shares whatever the n-grams are."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, at in _by_language(batch, "lang"):
                part = batch.take(pa.array(at))
                chars = np.frombuffer("".join(part.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(chars, lang)), part.column("value"), part.column("n")], names=["key", "value", "n"])

    rows = model.select("lang", "gram", F.round(F.col("value") * UNIT).cast("int").alias("value"), "n").mapInArrow(lean(hashed), "key bigint, value int, n bigint")
    return rows.groupBy(F.shiftright("key", 64 - bits).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("key", "value", "n"))).alias("entries"))


def _failed(base: dict[str, np.ndarray], min_words: int, max_repeat_percent: int) -> np.ndarray:
    return (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_percent * base["n_words"])


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    low_spread: float = 9.0,
    high_spread: float = 20.0,
    min_spread: float = 0.025,
    everywhere: int = 1 << 21,
    carry: bool = False,
) -> DataFrame:
    """Base rules, then perplexity bands by language.

    The model has every character n-gram of order 5 of each value of lang_col, over all rows, base-failed ones too. It is
    counted, smoothed and stored as tables (see kneser_ney and store_model) and grows with the corpus. Its everywhere most
    frequent entries at most go to every task, as sorted arrays; n-grams of a text that are not among them are sent to the
    slice that has them, and their sums come back. The result does not depend on everywhere.

    A language's band lies around the median of the mean log-probability a character of its different texts that pass the
    base rules, from an exact histogram of STEP; its unit is the median absolute deviation, min_spread nats at least.
    deviation is how far a text lies above its own language's median, in units: above low_spread, perplexity is below the
    lower bound (repetitive, formulaic), below -high_spread it is above the upper one. n-grams that no other text has are
    charged as unseen ones, copies of a text being one text, so that noise is not likely by its own counts.

    Returns (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed, kept boolean,
    perplexity, deviation double), a row for each row of docs. Null and empty texts have no words, fail the base rules and
    have null perplexity and deviation; so has a language no text of which passes the base rules a null deviation. A null
    language is a language. Texts of any length are counted whole; a slice of texts has 2 MB at most, or one text. Repeated rows
    count each time and give repeated results; other columns are ignored; empty input gives no rows. Bounds are inclusive.
    """
    spark = docs.sparkSession
    ship(spark)
    with Scratch(spark) as scratch:
        picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), language_key(F.col(lang_col).cast("string")).alias("lang"), *([whole_row(docs).alias("carried")] if carry else []))
        top = stash(count_grams(picked), "grams")
        classes = sorted(((r["c"], r["k"]) for r in top.groupBy(_bin(F.col("n")).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # a few hundred classes at most
        least, held = 0, 0
        for c, k in classes:
            if held + k > everywhere:
                least = c + 1
                break
            held += k
        bits = slice_bits(sum(k for _, k in classes))
        stored = stash(store_model(kneser_ney(top), bits), "model")
        entry = stored.select("slice", F.explode("entries").alias("e")).select("slice", "e.*")
        head = entry.where(_bin(F.col("n")) >= least).select("key", "value").toArrow()  # everywhere rows at most
        order = np.argsort(head["key"].to_numpy())
        sent = spark.sparkContext.broadcast((head["key"].to_numpy()[order], head["value"].to_numpy()[order]))
        del head, order
        trim()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, values = sent.value
            for batch in batches:
                for a, b in slices(batch.column("text"), 1 << 20):
                    part = batch.slice(a, b - a)
                    texts = part.column("text")
                    base = base_counts(texts)
                    plain = pc.fill_null(texts, "").to_pylist()
                    total, missing = np.zeros(b - a, np.int64), [(np.zeros(0, np.int64),) * 3]
                    for lang, at in _by_language(part, "lang"):
                        runs = gram_runs([plain[i] for i in at.tolist()])
                        if not len(runs.n):
                            continue
                        wanted = keys_of(runs.chars, lang)
                        by_key = np.argsort(wanted)
                        place = np.empty(len(wanted), np.int64)
                        place[by_key] = np.searchsorted(keys, wanted[by_key])
                        place = np.minimum(place, max(0, len(keys) - 1))
                        hit = keys[place] == wanted if len(keys) else np.zeros(len(wanted), bool)
                        value = np.where(hit, values[place], 0).astype(np.int64) if len(keys) else np.zeros(len(wanted), np.int64)
                        total[at] = np.rint(np.bincount(runs.text, value[runs.gram] * runs.n.astype(np.float64), len(at))).astype(np.int64)
                        lost = np.flatnonzero(~hit[runs.gram])
                        if len(lost):
                            missing.append((at[runs.text[lost]], wanted[runs.gram[lost]], runs.n[lost]))
                    of, key, n = (np.concatenate(x) for x in zip(*missing, strict=True))
                    by_text = np.argsort(of, kind="stable")
                    begins = pa.array(np.searchsorted(of[by_text], np.arange(b - a + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id"),
                            *(pa.array(base[c]) for c in BASE),
                            pa.array(_failed(base, min_words, max_repeat_percent)),
                            part.column("lang"),
                            pa.array([len(t) for t in plain], pa.int64()),
                            pa.array([zlib.crc32(t.encode()) for t in plain], pa.int64()),
                            pa.array(total),
                            pa.ListArray.from_arrays(begins, pa.array(key[by_text])),
                            pa.ListArray.from_arrays(begins, pa.array(n[by_text].astype(np.int64))),
                            *part.columns[3:],
                        ],
                        names=["id", *BASE, "base_failed", "lang", "chars", "mark", "total", "keys", "times", *part.schema.names[3:]],
                    )

        fields = ", ".join(f"{c} bigint" for c in BASE)
        scored = picked.mapInArrow(lean(score), with_carried(f"id {id_type(docs, id_col)}, {fields}, base_failed boolean, lang string, chars bigint, mark bigint, total bigint, keys array<bigint>, times array<bigint>", docs if carry else None))
        if least > 0:  # entries that were not sent: their slices are asked
            scored = stash(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
            asked = scored.where(F.size("keys") > 0).select("uid", F.explode(F.arrays_zip("keys", "times")).alias("a")).select("uid", "a.keys", "a.times")
            more = _looked_up(asked, stored, least, bits).groupBy("uid").agg(F.sum("value").alias("more"))
            scored = scored.drop("keys", "times").join(more, "uid", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0))).drop("uid", "more")
        else:
            scored = scored.drop("keys", "times")
        scored = scratch.keep(stash(scored.withColumn("mean", F.when(F.col("chars") > 0, F.col("total") / F.lit(float(UNIT)) / F.col("chars"))), "scored"))
        sent.unpersist()
    bins = scored.where("not base_failed and mean is not null").groupBy("lang", "mark", "chars").agg(F.min(F.floor(F.col("mean") / STEP)).alias("bin")).groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    middles = bins.groupBy("lang").agg(((F.percentile("bin", F.lit(0.5), F.col("n")) + 0.5) * STEP).alias("middle"))
    away = bins.join(middles, "lang").withColumn("away", F.abs((F.col("bin") + 0.5) * STEP - F.col("middle")))
    bands = away.groupBy("lang", "middle").agg(F.greatest(F.percentile("away", F.lit(0.5), F.col("n")), F.lit(min_spread)).alias("spread"))
    judged = scored.join(F.broadcast(bands) if bands.limit(100_001).count() <= 100_000 else bands, "lang", "left").withColumn("deviation", (F.col("mean") - F.col("middle")) / F.col("spread"))
    return judged.select(
        F.col("id").alias(id_col),
        *BASE,
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("deviation").between(-high_spread, low_spread), F.lit(False))).alias("kept"),
        F.exp(-F.col("mean")).alias("perplexity"),
        "deviation",
        *(["carried"] if carry else []),
    )


def _looked_up(asked: DataFrame, stored: DataFrame, least: int, bits: int) -> DataFrame:
    """(uid, value): for rows (uid, keys, times) times the value of the key, from the slice that has it. Slices are small,
    and so is what is asked of one: only entries below the class least are."""

    def find(texts: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(model):
            return pd.DataFrame({"uid": texts.uid[:0], "value": texts.times[:0]})
        keys, values = np.asarray(model["keys"].iloc[0]), np.asarray(model["found"].iloc[0])
        at = np.searchsorted(keys, texts["keys"].to_numpy())
        return pd.DataFrame({"uid": texts.uid, "value": values[at].astype(np.int64) * texts.times})

    rare = F.filter("entries", lambda e: _bin(e["n"]) < least)
    part = stored.select("slice", F.transform(rare, lambda e: e["key"]).alias("keys"), F.transform(rare, lambda e: e["value"]).alias("found"))
    asked = asked.withColumn("slice", F.shiftright("keys", 64 - bits))
    return asked.groupBy("slice").cogroup(part.groupBy("slice")).applyInPandas(find, "uid bigint, value bigint")
