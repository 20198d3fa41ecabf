"""SentencePiece encoding that keeps the source bytes of every piece, and decoding.

A text is normalised here: at each place the longest key of the model's compiled character
map is replaced, and every normalised byte keeps the source byte it came from. The library
then segments the normalised text with the same model, its own normaliser turned off, and
the piece lengths project each piece back to the source.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table

MODEL = "piece_bpe_32k.model"
#: Fixed values of the public model format: field numbers and piece types.
PIECE_FIELD, TRAINER_FIELD, NORMALIZER_FIELD = 1, 2, 3
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6
SPACE = "▁".encode()
_TOGETHER = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at:at + size]
            at += size


class CharacterMap:
    """Compiled map of the model: a double-array trie, then the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that starts at `at`."""
        units = self.units
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        found = None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        first, length = found
        return self.texts[first:self.texts.index(b"\0", first)], length


class Normalizer:
    """The model's normalisation, with the source byte of every normalised byte."""

    def __init__(self, spec: bytes, symbols: list[bytes] = (), suffix: bool = False):
        flags = {3: 1, 4: 1, 5: 1} | dict(_fields(spec))
        blob = flags.get(2, b"")
        self.map = CharacterMap(blob) if blob else None
        self.dummy, self.squeeze, self.escape = bool(flags[3]), bool(flags[4]), bool(flags[5])
        self.suffix = suffix
        self.symbols = sorted(symbols, key=len, reverse=True)

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self.symbols:
            if data.startswith(symbol, at):
                return symbol, len(symbol)
        found = self.map.longest(data, at) if self.map else None
        if found:
            return found
        size = 1 if data[at] < 0xC0 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return data[at:at + size], size

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source offsets of its bytes and of its end."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, dtype=np.int64)
        if not (self.map or self.symbols or self.squeeze or self.suffix) and self.escape:
            return self._spaces_only(text, data)
        at = 0
        while self.squeeze and at < len(data):
            what, size = self._prefix(data, at)
            if what != b" ":
                break
            at += size
        if at == len(data):
            return "", np.full(1, at, dtype=np.int64)
        space = SPACE if self.escape else b" "
        out, source = bytearray(), []

        def add(part: bytes) -> None:
            out.extend(part)
            source.extend([at] * len(part))

        if self.dummy and not self.suffix:
            add(space)
        after_space = self.squeeze
        while at < len(data):
            what, size = self._prefix(data, at)
            if after_space:
                what = what.lstrip(b" ")
            if what:
                add(what.replace(b" ", space))
                after_space = what.endswith(b" ")
            at += size
            after_space = after_space and self.squeeze
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space):]
                at = source[len(out)]
                del source[len(out):]
        if self.dummy and self.suffix:
            add(space)
        return out.decode(), np.array([*source, at], dtype=np.int64)

    def _spaces_only(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """Without a map only spaces change: the same in whole-array steps."""
        lengths = np.ones(len(data) + 1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)
        lengths[:-1][raw == 32] = len(SPACE)
        # every byte of a character comes from the character's first byte
        source = np.arange(len(data) + 1)
        later = (raw & 0xC0) == 0x80
        source[:-1][later] = 0
        np.maximum.accumulate(source, out=source)
        source = np.repeat(source, lengths)
        out = text.replace(" ", "▁")
        if self.dummy:
            return "▁" + out, np.concatenate([np.zeros(len(SPACE), dtype=np.int64), source])
        return out, source


class Encoder:
    """Ids and source spans of texts for one model file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        pieces, spec, suffix = [], b"", False
        for number, value in _fields(model):
            if number == PIECE_FIELD:
                pieces.append({3: 1} | dict(_fields(value)))
            elif number == NORMALIZER_FIELD:
                spec += value
            elif number == TRAINER_FIELD:
                suffix = bool(dict(_fields(value)).get(24, 0))
        self.normalize = Normalizer(spec, [p[1] for p in pieces if p[3] == USER_DEFINED], suffix)
        self.lengths = np.array([0 if p[3] == CONTROL else 1 if p[3] == BYTE else len(p[1]) for p in pieces])
        self.unknown = next((i for i, p in enumerate(pieces) if p[3] == UNKNOWN), -1)
        # a later message of the same field is merged over the earlier one: no map, all flags off
        off = bytes([0x12, 0, 0x18, 0, 0x20, 0, 0x28, 0])
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.segments = sentencepiece.SentencePieceProcessor(
            model_proto=model + bytes([NORMALIZER_FIELD << 3 | 2, len(off)]) + off
        )

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids with begin and end, and the first and end source byte of each."""
        normal = [self.normalize(t) for t in texts]
        found = self.segments.encode([n for n, _ in normal], add_bos=True, add_eos=True, num_threads=1)
        for (text, source), ids in zip(normal, found):
            ids = np.array(ids, dtype=np.int64)
            lengths = self.lengths[ids]
            if (ids == self.unknown).any():
                pieces = self.segments.encode(text, out_type=str)
                lengths[1:-1] = [len(p.encode()) if i == self.unknown else n
                                 for p, i, n in zip(pieces, ids[1:-1], lengths[1:-1])]
            ends = np.cumsum(lengths)
            if ends[-1] != len(source) - 1:
                raise ValueError("the pieces do not cover the normalised text")
            yield ids, source[ends - lengths], source[ends]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


ENCODED = pa.struct([("ids", pa.binary()), ("begins", pa.binary()), ("ends", pa.binary()), ("covered", pa.int64())])


def packed(values: np.ndarray) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return values.astype("<u4").tobytes()


def _encoding(path: str, spans: bool, text: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their pieces, a few at a time: pieces take several times a text's memory."""
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                some = batch.slice(at, _TOGETHER)
                rows = [
                    (packed(ids), packed(begins) if spans else None, packed(ends) if spans else None,
                     int((ends - begins).sum()))
                    for ids, begins, ends in own.encode([t or "" for t in some.column(text).to_pylist()])
                ]
                pieces = pa.StructArray.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows), ENCODED)], fields=list(ENCODED)
                )
                yield some.append_column("pieces", pieces)

    return encode


def decoding(path: str):
    """UDF: the library's text of packed ids."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        library = encoder(path).library
        return pa.array([
            library.decode(np.frombuffer(i.as_py(), dtype="<u4").tolist()) if i.is_valid else None for i in ids
        ], type=pa.string())

    return decode


def encode_texts(docs: DataFrame, path: str, spans: bool = True) -> DataFrame:
    """Add struct column `pieces`, `pieces_` if there is one of this name; rows stay where they are.

    It holds packed ids, packed begins and ends of their source bytes, and the number of bytes
    covered. Null is an empty text: begin and end ids only. With spans=False the spans are
    worked out and checked, but not carried along. Texts of any length are encoded whole.
    """
    kind = T.StructType([
        T.StructField("ids", T.BinaryType()), T.StructField("begins", T.BinaryType()),
        T.StructField("ends", T.BinaryType()), T.StructField("covered", T.LongType()),
    ])
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names of any form, dots included
    fields = T.StructType([*numbered.schema.fields, T.StructField("pieces", kind)])
    found = numbered.mapInArrow(_encoding(path, spans, docs.columns.index("text")), fields)
    return found.toDF(*docs.columns, free_name("pieces", docs.columns))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document. Null or empty text: two ids, decoded empty."""
    import public_tokenizers

    path = public_tokenizers.path(MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode_texts(docs, path, spans=False).select(
        "doc_id", F.col("pieces.ids").alias("ids"), F.col("pieces.covered").alias("n_covered_bytes")
    )
    return ids.withColumn("decoded", decoding(path)(F.col("ids"))).select(
        "doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "n_covered_bytes",
    )
