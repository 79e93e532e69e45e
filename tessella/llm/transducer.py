"""Token counts from a tokenizer compiled to deterministic transducers.

Two machines read a text. The splitter reads character classes and marks where pre-tokens begin. The merger reads bytes; its
transitions carry the number of tokens that a byte adds to (or takes from) what has been emitted, and it starts anew at
each pre-token. For both, the text is cut into chunks of equal length, each chunk becomes a map from the state before it to
the state behind it, and a parallel prefix scan composes the maps, so that all chunks are read at once whatever came before.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet, vocabulary
from .common import id_type, lean, ship
from .textkit import slices

# Classes of symbols. QUOTE and the letters of contractions are told apart from other marks and letters.
LETTER, NUMBER, BLANK, SPACE, MARK, QUOTE, L_ONE, L_RV, L_L, L_E, END = range(11)
LETTERS = (LETTER, L_ONE, L_RV, L_L, L_E)
#: What may follow an apostrophe as one pre-token; of the vocabulary's published pattern.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

# States of the splitter: FRESH nothing open; in a run of letters, numbers, marks; W1 one white character, WB one blank,
# W2/W2B several, by their last; QUOTED an apostrophe that began a pre-token; Q_RV, Q_L a letter behind it.
FRESH, IN_L, IN_N, IN_M, W1, WB, W2, W2B, QUOTED, Q_RV, Q_L = range(11)
STATES, CLASSES = 11, 11
#: Output bits: a pre-token begins at this character; one begins at the character before.
HERE, BEFORE = 1, 2


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """The tables next[state, class] and output[state, class].

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?others+| white+ not before a non-white| white+.
    """
    nxt, out = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)

    def opening(c: int) -> int:
        """The state behind a first character."""
        if c in LETTERS:
            return IN_L
        return {NUMBER: IN_N, MARK: IN_M, QUOTE: QUOTED, BLANK: WB, SPACE: W1, END: FRESH}[c]

    run = {IN_L: LETTERS, IN_N: (NUMBER,), IN_M: (MARK, QUOTE)}
    for c in range(CLASSES):
        for s in range(STATES):
            emit, to = HERE, opening(c)
            if s in run and c in run[s]:
                emit, to = 0, s
            elif s == QUOTED:
                if c in (MARK, QUOTE):
                    emit, to = 0, IN_M
                elif c == L_ONE:
                    emit, to = 0, FRESH
                elif c in (L_RV, L_L):
                    emit, to = 0, Q_RV if c == L_RV else Q_L
            elif s in (Q_RV, Q_L):
                if (s, c) in ((Q_RV, L_E), (Q_L, L_L)):
                    emit, to = 0, FRESH
                elif c in LETTERS:  # no contraction: the letter before began a pre-token
                    emit, to = BEFORE, IN_L
                else:
                    emit = BEFORE | HERE
            elif s in (W1, WB, W2, W2B):
                if c in (BLANK, SPACE):
                    emit, to = 0, W2B if c == BLANK else W2
                elif c == END:
                    emit, to = HERE, FRESH
                else:
                    cut = BEFORE if s in (W2, W2B) else 0
                    if s in (WB, W2B):  # the blank goes with what follows; a blank before an apostrophe opens marks
                        emit, to = cut, IN_M if c == QUOTE else opening(c)
                    else:
                        emit = cut | HERE
            nxt[s, c], out[s, c] = to, emit
    return nxt, out


def split_chunks(classes: np.ndarray, length: int = 256) -> np.ndarray:
    """The splitter's output bits for a whole stream that begins in FRESH.

    All chunks run from all states together until their maps have become constant; the prefix scan then gives each
    chunk its first state, in as many steps as the logarithm of the number of chunks.
    """
    nxt, out = _splitter
    n = len(classes)
    lanes = max(1, -(-n // length))
    padded = np.full(lanes * length, END, np.uint8)
    padded[:n] = classes
    cut = np.ascontiguousarray(padded.reshape(lanes, length).T)
    flat_next = nxt.ravel()
    at = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    known = np.zeros(lanes, np.uint8)
    open_ = np.arange(lanes)  # chunks whose end still depends on their first state
    final = np.empty((STATES, lanes), np.uint8)
    for j in range(length):
        at = flat_next[at.astype(np.int16) * CLASSES + cut[j, open_]]
        if j % 8 == 7 or j == length - 1:
            same = (at == at[:1]).all(0)
            if same.any() and j < length - 1:
                known = at[0, same]
                done = open_[same]
                for i in range(j + 1, length):  # one state is enough from here on
                    known = flat_next[known.astype(np.int16) * CLASSES + cut[i, done]]
                final[:, done] = known
                open_, at = open_[~same], at[:, ~same]
                if not len(open_):
                    break
    if len(open_):
        final[:, open_] = at
    step = 1  # inclusive scan: final[:, i] becomes the map of chunks 0 to i
    while step < lanes:
        later = np.take_along_axis(final[:, step:], final[:, :-step].astype(np.intp), axis=0)
        final = np.concatenate([final[:, :step], later], axis=1)
        step *= 2
    state = np.concatenate([[FRESH], final[FRESH, :-1]]).astype(np.uint8)
    bits = np.empty((length, lanes), np.uint8)
    flat_out = out.ravel()
    for j in range(length):
        where = state.astype(np.int16) * CLASSES + cut[j]
        bits[j] = flat_out[where]
        state = flat_next[where]
    return np.ascontiguousarray(bits.T).ravel()[:n]


_splitter = compile_splitter()


class Merger:
    """The merges of a byte-level vocabulary as a deterministic transducer that is compiled as texts ask for it.

    Of a pre-token's encoding, every prefix is the encoding of a prefix, and two tokens may stand side by side if
    merging their bytes gives just these two. So the last token behind each byte is the one whose bytes end there and
    that may follow the last token where it begins. A state is all that later bytes can depend on: for each place
    where an unfinished vocabulary entry may have begun, the entry so far, the last token before it and how many fewer
    tokens there were. A transition carries the change in the number of tokens. States are numbered as they are met;
    beyond max_states all are forgotten and compiled anew, with the same results.
    """

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int], max_states: int = 120_000):
        self.ranks, self.max_states = ranks, max_states
        self.children: list[dict[int, int]] = [{}]
        self.entry: list[bytes | None] = [None]
        for token in vocab:
            node = 0
            for b in token:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.entry.append(None)
                node = self.children[node][b]
            self.entry[node] = token
        self.whole: dict[bytes, bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self._forget()

    def _merge(self, raw: bytes) -> list[bytes]:
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, last: bytes | None, token: bytes) -> bool:
        if token not in self.whole:
            self.whole[token] = self._merge(token) == [token]  # else it is never the result of merges
        if last is None or not self.whole[token]:
            return self.whole[token]
        found = self.pairs.get((last, token))
        if found is None:
            found = self.pairs[last, token] = self._merge(last + token) == [last, token]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
        return found

    def _forget(self) -> None:
        # A state: (node, last token before, tokens then minus tokens now) for each open place, the earliest first.
        self.states: list[tuple] = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        room = self.max_states * 4 // 3
        self.next = np.zeros((room, 256), np.int32)  # the state plus one; 0: not compiled
        self.delta = np.zeros((room, 256), np.int8)

    def _compile(self, state: int, byte: int) -> None:
        best: tuple[bytes, int] | None = None
        grown = []
        for node, last, behind in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.entry[child]
            if best is None and token is not None and self._follows(last, token):
                best = token, behind + 1
            if self.children[child]:
                grown.append((child, last, behind))
        assert best is not None, "every byte is an entry"
        token, change = best
        after = (*((node, last, behind - change) for node, last, behind in grown), (0, token, 0))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
            if number >= len(self.next):
                self.next = np.concatenate([self.next, np.zeros_like(self.next)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
        self.next[state, byte] = number + 1
        self.delta[state, byte] = change

    def _run(self, data: np.ndarray, fresh: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """The state behind each lane of size bytes from at on, entered in state; all lanes take a step at a time. The
        machine starts anew where fresh says; changes are written to out."""
        order = np.argsort(-size, kind="stable")
        at, size, now_in = at[order], size[order], state[order].astype(np.int32)
        step, alive = 0, len(at)
        while alive:
            if size[alive - 1] <= step:
                alive = int(np.searchsorted(-size, -step, "left"))
                continue
            place = at[:alive] + step
            byte = data[place]
            now = np.where(fresh[place], 0, now_in[:alive])
            to = self.next[now, byte]
            missing = np.flatnonzero(to == 0)
            if len(missing):
                for key in np.unique(now[missing].astype(np.int64) << 8 | byte[missing]).tolist():
                    self._compile(key >> 8, key & 255)
                to = self.next[now, byte]
            if out is not None:
                out[place] = self.delta[now, byte]
            now_in[:alive] = to - 1
            step += 1
        found = np.empty(len(at), np.int32)
        found[order] = now_in
        return found

    def count(self, data: np.ndarray, begins: np.ndarray, chunk: int = 512, warm: int = 48) -> np.ndarray:
        """For each byte of data the change in the number of tokens; the machine starts anew at begins, the first of which
        is 0.

        The stream is cut into chunks of equal length. A chunk in which a pre-token begins is a constant map: the state
        behind it does not depend on the state before it. One that lies within a pre-token is a map from states to
        states, made for the states that can come in: that behind the warm bytes before it, and whatever comes out of the
        chunk before, until no new state comes out of any. A prefix scan composes the maps, so that every chunk knows the
        state before it, and what was left open is read, all chunks at a time.
        """
        n = len(data)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        if len(self.states) > self.max_states:
            self._forget()
        fresh = np.zeros(n, bool)
        fresh[begins[begins < n]] = True
        start = np.arange(0, n, chunk)
        end = np.minimum(start + chunk, n)
        lanes = len(start)
        found = np.searchsorted(begins, start)
        first = np.append(begins, n)[found]
        inner = first >= end
        first = np.minimum(first, end)
        behind = self._run(data, fresh, first, end - first, np.zeros(lanes, np.int32), out)
        entry = np.zeros(lanes, np.int32)
        entry[1:] = behind[:-1]
        if inner.any():
            entry = self._compose(data, fresh, start, end, inner, behind, warm)
        return self._heads(data, fresh, start, first, entry, out)

    def _heads(self, data: np.ndarray, fresh: np.ndarray, start: np.ndarray, first: np.ndarray, entry: np.ndarray, out: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(first > start)
        self._run(data, fresh, start[some], (first - start)[some], entry[some], out)
        return out

    def _compose(self, data: np.ndarray, fresh: np.ndarray, start: np.ndarray, end: np.ndarray, inner: np.ndarray, behind: np.ndarray, warm: int) -> np.ndarray:
        """The state before each chunk, where some chunks are maps: see count."""
        lanes = np.flatnonzero(inner)
        before = np.maximum(0, start[lanes] - warm)
        guess = self._run(data, fresh, before, start[lanes] - before, np.zeros(len(lanes), np.int32))
        known = ~inner[lanes - 1]  # the first chunk is never one: a pre-token begins at 0
        guess[known] = behind[lanes[known] - 1]
        maps: dict[int, dict[int, int]] = {i: {} for i in lanes.tolist()}
        new = list(zip(lanes.tolist(), guess.tolist(), strict=True))
        while new:
            at = np.array([i for i, _ in new])
            came = self._run(data, fresh, start[at], (end - start)[at], np.array([s for _, s in new], np.int32)).tolist()
            more = set()
            for (i, s), t in zip(new, came, strict=True):
                maps[i][s] = t
                if i + 1 in maps and t not in maps[i + 1]:
                    more.add((i + 1, t))
            new = sorted(more)
        # The scan: table[k, j] is the place, among the states of the next chunk, of what state k of chunk j becomes.
        states = [list(maps[i]) if i in maps else [int(behind[i])] for i in range(len(start))]
        most = max(map(len, states))
        table = np.zeros((most, len(start)), np.int32)
        for i, m in maps.items():
            if i + 1 in maps:
                following = {s: k for k, s in enumerate(states[i + 1])}
                table[: len(m), i] = [following[t] for t in m.values()]
        for i in (lanes[known] - 1).tolist():  # constant maps
            table[:, i] = states[i + 1].index(int(behind[i]))
        step = 1
        while step < len(start):
            later = np.take_along_axis(table[:, step:], table[:, :-step].astype(np.intp), axis=0)
            table = np.concatenate([table[:, :step], later], axis=1)
            step *= 2
        entry = np.zeros(len(start), np.int32)
        for i in range(1, len(start)):
            entry[i] = states[i][table[0, i - 1]] if inner[i] else (maps[i - 1][states[i - 1][table[0, i - 2]]] if inner[i - 1] else behind[i - 1])
        return entry


class TokenCounter:
    """Counts tokens as the library does, from its vocabulary file alone."""

    def __init__(self, path: str, kinds: np.ndarray | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}

        def raw(piece: str) -> bytes:
            return bytes(back[c] for c in piece)

        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special, key=len, reverse=True)
        vocab = {raw(p): i for p, i in spec["model"]["vocab"].items() if p not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merger = Merger(vocab, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)})
        self.kinds = self.classes(path) if kinds is None else kinds

    @staticmethod
    def classes(path: str) -> np.ndarray:
        """The class of every code point, as the library's own splitter shows it: between an a and a 1, a letter stays
        with the one and a number with the other, white space sticks to nothing, a mark keeps the mark before it."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        kinds = np.full(0x110000, MARK, np.uint8)
        # Planes 4 to 13 hold no characters, 15 and 16 private ones: all marks.
        points = [c for c in (*range(0x40000), *range(0xE0000, 0xE1000)) if not 0xD800 <= c <= 0xDFFF]
        for at in range(0, len(points), 1 << 16):
            some = points[at : at + (1 << 16)]
            for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", MARK)):
                text = "".join(f"{probe}{chr(c)}\n" for c in some)
                cuts = {begin for _, (begin, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
                where = np.arange(len(some)) * 3 + 1
                joined = np.array([w not in cuts for w in where.tolist()])
                if probe == "!":
                    for c, j in zip(some, joined.tolist(), strict=True):
                        if not j and kinds[c] == MARK:
                            kinds[c] = SPACE
                else:
                    kinds[np.array(some)[joined]] = kind
        kinds[ord(" ")] = BLANK
        kinds[ord("'")] = QUOTE
        kinds[[ord(c) for c in ONE_LETTER]] = L_ONE
        kinds[[ord("r"), ord("v")]] = L_RV
        kinds[ord("l")] = L_L
        kinds[ord("e")] = L_E
        return kinds

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text; null is empty."""
        extra = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            parts = [text or ""]
            for s in self.special:
                if text and s in text:
                    parts = [p for x in parts for p in x.split(s)]
            extra[i] = len(parts) - 1
            pieces.extend(parts)
            owner.extend([i] * len(parts))
        stream = "\n".join(pieces)  # what stands between pieces is made an END below
        points = np.frombuffer((stream + "\n").encode("utf-32-le"), np.uint32)
        size = np.array([len(p) + 1 for p in pieces], np.int64)
        ends = np.cumsum(size) - 1
        classes = self.kinds[points]
        classes[ends] = END
        bits = split_chunks(classes)
        begin = (bits & HERE).astype(bool)
        begin[:-1] |= (bits[1:] & BEFORE).astype(bool)
        begin[np.concatenate([[0], ends[:-1] + 1])] = True
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.cumsum(width) - width
        data = np.frombuffer((stream + "\n").encode("utf-8"), np.uint8)
        begin[ends] = True  # a byte between pieces is a pre-token of its own, one token, taken off again
        deltas = self.merger.count(data, place[begin])
        sums = np.concatenate([[0], np.cumsum(deltas, dtype=np.int64)])
        first = place[np.concatenate([[0], ends[:-1] + 1])]
        found = sums[place[ends]] - sums[first]
        return extra + np.bincount(owner, weights=found, minlength=len(texts)).astype(np.int64)


_counters: dict[str, TokenCounter] = {}
_kinds: dict[str, np.ndarray] = {}


def counter(path: str, kinds: np.ndarray | None = None) -> TokenCounter:
    """One counter for each vocabulary and worker process: tables are compiled once and grow with the texts met."""
    if path not in _counters:
        _counters[path] = TokenCounter(path, kinds)
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Counts the tokens of each whole text as the tokenizers library would, special strings as special tokens.

    tokenizer is a vocabulary's name, or a path that holds a slash. Returns (id_col, n_bytes, n_tokens long, over_limit
    boolean: n_tokens > limit), a row for each row of docs. Null and empty texts have 0 bytes and tokens. Repeated rows
    give repeated results; other columns are ignored. One task holds one batch of whole texts; nothing is shuffled.
    """
    ship(docs.sparkSession)
    if tokenizer not in _kinds:
        _kinds[tokenizer] = TokenCounter.classes(tokenizer if os.sep in tokenizer else vocabulary(tokenizer))
    kinds = docs.sparkSession.sparkContext.broadcast(_kinds[tokenizer])  # a byte for each code point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer if os.sep in tokenizer else vocabulary(tokenizer), kinds.value)
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 21):
                texts = batch.column(1).slice(a, b - a)
                n = count.count_batch(texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), f"id {id_type(docs, id_col)}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
