"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

No tokenizer is trained. Each byte stands for one character (U+0100 + byte), each vocabulary
entry becomes a piece of such characters with the score -rank, and normalisation is the identity,
so that sentencepiece's merges (best score first, then leftmost) are the merges of the ranks.
Texts are cut into pre-tokens by the vocabulary's pattern, each is encoded on its own, and ids
are decoded by mapping their pieces back to bytes.

Odd input: null or empty text: no ids, empty bytes. Repeated rows and null ids: each row has its
own result. Very long texts are cut between pre-tokens while they are encoded, so memory holds
one window and the result. Empty table: empty result. Other columns are kept as they are.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_FIRST = 0x100
#: The public pattern of these vocabularies (a fixed value): a space belongs to what follows it.
SPACE_JOINS_NEXT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are cut into pre-tokens at once.
WINDOW = 1 << 20
#: Pre-tokens whose ids a task remembers before it starts afresh.
REMEMBERED = 300_000
#: Bytes of ids or decoded bytes in an Arrow batch that goes back to Spark.
BATCH_BYTES = 8 << 20


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token, rank) in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file))
    if [rank for rank, _ in rows] != list(range(len(rows))):
        raise ValueError(f"{path}: ranks are not consecutive")
    return [token for _, token in rows]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _as_chars(token: bytes) -> str:
    return "".join(chr(_FIRST + b) for b in token)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; one more id stands for unknown."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, _as_chars(t).encode()) + _field(2, float(-rank)) + _field(3, normal)) for rank, t in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class _Irregular(Exception):
    """A chunk next to a space that belongs to a longer run of white space."""


class _Tokens(dict):
    """Ids of pre-tokens, as little-endian unsigned 32-bit integers."""

    def __init__(self, processor) -> None:
        self.encode = processor.encode
        self.chars = {b: _FIRST + b for b in range(256)}

    def __missing__(self, token: str) -> bytes:
        ids = self.encode(token.encode().decode("latin-1").translate(self.chars), out_type=int)
        found = np.array(ids, "<u4").tobytes()
        if len(token) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = found
        return found


class _Chunks(dict):
    """Ids of a space and the chunk up to the next space.

    If neither end of the chunk is white space, the chunk's pre-tokens don't depend on what
    stands around it: the space joins its first one, and no run of white space leaves it.
    """

    def __init__(self, split, tokens: _Tokens) -> None:
        self.split, self.tokens = split, tokens

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Irregular
        found = b"".join(map(self.tokens.__getitem__, self.split(" " + chunk)))
        if len(chunk) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found


class Codec:
    """Encodes and decodes one text at a time, by a serialised model."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.tokens = _Tokens(self.processor)
        self.chunks = _Chunks(self.split, self.tokens) if pattern == SPACE_JOINS_NEXT else None
        n = self.processor.get_piece_size() - 1
        back = {_FIRST + b: b for b in range(256)}
        self.pieces = [self.processor.id_to_piece(i).translate(back).encode("latin-1") for i in range(n)]

    def _windows(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of the text, window by window. The last three of a window may change with what follows."""
        at, width = 0, WINDOW
        while at < len(text):
            found = self.split(text, at, at + width)
            if at + width < len(text):
                if len(found) <= 3:
                    width *= 2
                    continue
                del found[-3:]
            yield found
            at += sum(map(len, found)) if at + width < len(text) else len(text)
            width = WINDOW

    def _by_chunks(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            raise _Irregular
        return b"".join(map(self.tokens.__getitem__, self.split(first))) + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if self.chunks is not None and len(text) <= WINDOW:
            try:
                return self._by_chunks(text)
            except _Irregular:
                pass
        return b"".join([b"".join(map(self.tokens.__getitem__, part)) for part in self._windows(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _mapped(df: DataFrame, column: str, to: str, make) -> DataFrame:
    """``df`` with the binary column ``to`` (replaced, if there already), made by ``make()(value)`` from ``column``; nulls give empty bytes."""
    kept = [f for f in df.schema.fields if f.name != to]

    def run(batches):
        one = make()
        for batch in batches:
            source, made, size, start = batch.column(batch.schema.get_field_index(column)), [], 0, 0
            for i, value in enumerate(source):
                value = value.as_py()
                made.append(one(value) if value is not None else b"")
                size += len(made[-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    old = [part.column(batch.schema.get_field_index(f.name)) for f in kept]
                    yield pa.RecordBatch.from_arrays([*old, pa.array(made, pa.binary())], [*[f.name for f in kept], to])
                    made, size, start = [], 0, i + 1

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(to, T.BinaryType())]))


class ByteBpe:
    """Encoding and decoding of DataFrame columns by the ranks in ``path``.

    The model is broadcast: its size is that of the vocabulary file (about 1 MB) and doesn't
    depend on the data.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        self._model = spark.sparkContext.broadcast(sentencepiece_model(read_ranks(path)))
        self._pattern = pattern

    def encode(self, df: DataFrame, column: str = "text", to: str = "ids") -> DataFrame:
        """Adds the ids of ``column`` as little-endian unsigned 32-bit integers in one binary value."""
        model, pattern = self._model, self._pattern
        return _mapped(df, column, to, lambda: Codec(model.value, pattern).encode)

    def decode(self, df: DataFrame, column: str = "ids", to: str = "decoded") -> DataFrame:
        """Adds the bytes that the ids of ``column`` stand for."""
        model, pattern = self._model, self._pattern
        return _mapped(df, column, to, lambda: Codec(model.value, pattern).decode)
