"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised from a rank file.

Every byte is written as one character (U+0100 + byte), so a vocabulary entry becomes a sentencepiece piece; its score is
minus its rank, so that sentencepiece merges in rank order; normalisation is the identity, without prefix space or white
space rules. Texts are first cut by the tokenizer's pattern; each match is encoded by itself, and one that is itself a
vocabulary entry is that entry. Nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFT = 0x100
GAP = "\u0e3f"
CACHE_ENTRIES = 200_000
_to_chars = {b: SHIFT + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 of the bytes, then the rank, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: bytes as length-delimited, floats as 32 bits, ints as varints (two's complement)."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value % (1 << 64))


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece follows the last rank.

    Ranks have to be 0, 1, ..., n - 1, without gaps.
    """
    entries = sorted(ranks, key=ranks.__getitem__)
    if [ranks[e] for e in entries] != list(range(len(entries))):
        raise ValueError("ranks have gaps or repeat")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, e.decode("latin-1").translate(_to_chars).encode()) + _field(2, -float(r)) + _field(3, normal) for r, e in enumerate(entries)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(40, len(entries)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one model; keeps a bounded cache of pre-tokens, each with its ids as packed bytes, which are
    small and nothing for the garbage collector to look through."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor()
        self.pieces.LoadFromSerializedProto(model)
        self.find = regex.compile(pattern).findall
        n = self.pieces.get_piece_size() - 1
        self.unknown = n
        self.decimal = [str(i) for i in range(n)]
        self.bytes = [self.pieces.id_to_piece(i).encode("utf-16-be")[1::2] for i in range(n)]
        self.whole = {b: i for i, b in enumerate(self.bytes)}
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> array:
        parts = self.find(text)
        known = self.cache
        if new := [p for p in set(parts) if p not in known]:
            if len(known) + len(new) > CACHE_ENTRIES:
                known.clear()
                new = list(set(parts))
            self.learn(new)
        return array("i", b"".join(map(known.__getitem__, parts)))

    def learn(self, parts: list[str], most: int = 20_000) -> None:
        """Encode pre-tokens into the cache. Many go in one call, apart by a character that is in no piece: nothing can
        merge across it, and it comes back as the unknown id."""
        known, unknown = self.cache, self.unknown
        some: list[str] = []
        size = 0

        def flush() -> None:
            found = self.pieces.encode("".join(p.encode().decode("latin-1").translate(_to_chars) + GAP for p in some), num_threads=1)
            at = 0
            for p in some:
                end = found.index(unknown, at)
                known[p] = array("i", found[at:end]).tobytes()
                at = end + 1

        for p in parts:
            one = self.whole.get(p.encode())
            if one is not None:
                known[p] = array("i", (one,)).tobytes()
                continue
            some.append(p)
            size += len(p)
            if size >= most:
                flush()
                some, size = [], 0
        if some:
            flush()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _model(docs: DataFrame, vocabulary: str | None, pattern: str | None):
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    # Broadcast: the vocabulary's own size, about 1 MB, whatever the corpus.
    return docs.sparkSession.sparkContext.broadcast(serialize_model(read_ranks(vocabulary))), pattern


def _rows(batches: Iterator[pa.RecordBatch], make, schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            out = [(k, *make(v)) for k, v in zip(part.column(0).to_pylist(), (x.as_py() for x in part.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids array<int>): token ids of each whole text, special tokens not recognised; null and empty texts have none.

    One row for each row of `docs`, repeated rows and null ids included; other columns are ignored.
    """
    shared, pattern = _model(docs, vocabulary, pattern)
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        c = Codec(shared.value, pattern)  # a tenth of a second; it goes with the task, so that the worker is free for others
        return _rows(batches, lambda t: (c.encode(t or ""),), schema)

    return _pairs(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, decoded binary): the bytes behind each list of ids; null and empty lists give no bytes, an unknown id fails."""
    shared, pattern = _model(encoded, vocabulary, pattern)
    schema = pa.schema([("id", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        c = Codec(shared.value, pattern)
        return _rows(batches, lambda t: (c.decode(t or []),), schema)

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) after encoding each whole text and decoding the ids, in one pass.

    Digests are lowercase hex: of the decimal ids joined by one space, and of the decoded bytes. Rows as for
    `encode_documents`: an empty table gives none, and texts of any length are encoded whole, pre-token by pre-token, in
    memory that grows with the one text.
    """
    shared, pattern = _model(docs, vocabulary, pattern)
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c = Codec(shared.value, pattern)

        def digest(text):
            ids = c.encode(text or "")
            line = " ".join(map(c.decimal.__getitem__, ids)).encode()
            return len(ids), hashlib.sha256(line).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

        return _rows(batches, digest, schema)

    out = _pairs(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
