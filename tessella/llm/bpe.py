"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, lean, ship
from .textkit import slices

#: Bytes that stand for themselves in the printable alphabet of byte-level vocabularies.
PRINTABLE_RANGES = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
#: Field numbers and enumeration values of the sentencepiece model format.
MODEL_PIECES, MODEL_TRAINER, MODEL_NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TYPE_NORMAL, TYPE_UNKNOWN = 1, 2
TRAINER_MODEL_TYPE, MODEL_TYPE_BPE = 3, 2
TRAINER_VOCAB_SIZE, TRAINER_UNK, TRAINER_BOS, TRAINER_EOS, TRAINER_PAD = 4, 40, 41, 42, 43
NORMALIZER_NAME, NORMALIZER_DUMMY_PREFIX, NORMALIZER_EXTRA_SPACES, NORMALIZER_ESCAPE = 1, 3, 4, 5


def byte_alphabet() -> list[str]:
    """For each byte its printable character: itself, or the next free one from U+0100."""
    plain = {b for lo, hi in PRINTABLE_RANGES for b in range(lo, hi + 1)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The bytes of a sentencepiece BPE model: piece 0 is the unknown piece, then the vocabulary by rank, each piece in
    the printable alphabet and scored by its negative rank; the normaliser changes nothing."""
    alphabet = byte_alphabet()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(MODEL_PIECES, _block(PIECE_TEXT, text.encode()) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score) + _number(PIECE_TYPE, kind))

    out = [piece("<unk>", 0.0, TYPE_UNKNOWN)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(piece("".join(alphabet[b] for b in token), -float(rank), TYPE_NORMAL))
    trainer = _number(TRAINER_MODEL_TYPE, MODEL_TYPE_BPE) + _number(TRAINER_VOCAB_SIZE, len(ranks) + 1) + _number(TRAINER_UNK, 0)
    trainer += b"".join(_number(field, -1) for field in (TRAINER_BOS, TRAINER_EOS, TRAINER_PAD))
    normalizer = _block(NORMALIZER_NAME, b"identity") + _number(NORMALIZER_DUMMY_PREFIX, 0) + _number(NORMALIZER_EXTRA_SPACES, 0) + _number(NORMALIZER_ESCAPE, 0)
    return b"".join(out) + _block(MODEL_TRAINER, trainer) + _block(MODEL_NORMALIZER, normalizer)


class ByteBPE:
    """Encodes texts as ranks of a byte-level vocabulary and decodes them.

    A text is cut into pre-tokens by the pattern; each is mapped to the printable alphabet and merged by sentencepiece.
    A pre-token that is a vocabulary entry is that entry. Many pre-tokens are merged in one call, with a character
    between them that no piece holds. Results of short pre-tokens are kept, up to max_kept of them.
    """

    #: Outside the alphabet: comes back as the unknown piece and never takes part in a merge.
    BREAK = "\u0000"

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_kept: int = 400_000):
        import regex
        import sentencepiece

        self.ranks, self.max_kept = ranks, max_kept
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of_piece = np.array([-1, *(r for _, r in by_rank)], np.int64)
        self.alphabet = {b: ord(c) for b, c in enumerate(byte_alphabet())}
        self.token = {r: t for t, r in by_rank}
        self.kept: dict[str, bytes] = {}

    def _merge(self, parts: list[str]) -> list[bytes]:
        """The ids, as little-endian 32-bit integers, of each pre-token."""
        out: list[bytes | None] = []
        ask: list[str] = []
        for p in parts:
            raw = p.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is not None:
                out.append(struct.pack("<I", rank))
            else:
                out.append(None)
                ask.append(raw.decode("latin-1").translate(self.alphabet))
        if ask:
            ids = self.rank_of_piece[np.array(self.model.encode(self.BREAK.join(ask)), np.int64)]
            cuts = np.flatnonzero(ids < 0)
            packed = ids.astype("<u4").tobytes()
            begins, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            if len(begins) != len(ask):
                raise RuntimeError("the model split or joined pre-tokens")
            merged = iter([packed[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)])
            out = [next(merged) if x is None else x for x in out]
        return out  # type: ignore[return-value]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        cut = [self.find(t) if t else [] for t in texts]
        kept = self.kept
        new = list({p for parts in cut for p in parts if p not in kept})
        own: dict[str, bytes] = {}
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            own.update(zip(some, self._merge(some), strict=True))
        get = kept.get
        out = [b"".join([get(p) or own[p] for p in parts]) for parts in cut]
        if len(kept) + len(own) > self.max_kept:
            kept.clear()
        kept.update((p, ids) for p, ids in own.items() if len(p) <= 64)
        return out

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for each vocabulary and worker process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _coders[path, pattern]


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine; looked up where it is read, as workers may have it elsewhere."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """Encodes each whole text and decodes the ids again.

    ranks is a vocabulary's name, or a path that holds a slash. Returns (id_col, n_tokens long, ids binary: little-endian
    unsigned 32-bit integers, decoded binary), a row for each row of docs. Null and empty texts have no ids. Ties among
    merges go to the leftmost pair. Repeated rows give repeated results; other columns are ignored. One task holds one
    batch of whole texts; nothing is shuffled.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe = coder(ranks if os.sep in ranks else vocabulary(ranks), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids = bpe.encode_batch(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                    names=["id", "n_tokens", "ids", "decoded"],
                )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), f"id {id_type(docs, id_col)}, n_tokens bigint, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """SHA-256 of the ids and of the decoded bytes, as lower-case hex."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def expected_digest(text: str | None, ids: list[int]) -> tuple[int, str, str]:
    """The same columns from a text and its ids, for tests."""
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
