"""Substring dedup: windows of words that also start in an earlier document are cut out.

A window's anchor is the least hash of its eight-word parts. Neighbouring windows mostly share
it, and equal windows have equal anchors, so a window is in no more documents than its anchor.
First pass: every partition counts its anchors in a count-min sketch (each once per
document), the sketches are added up block by block. A sketch never counts too little, so a
window whose anchor it has seen once is unique. Second pass: only windows with an anchor
counted twice or more are grouped, exactly, by their own 128-bit hash. Those of a hot anchor
are dealt to salted groups; what is least in its salt is settled by a small aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import KEY, by_key, checked_broadcast, keyed, table, written

WORDS = 13
#: Words of the parts whose least is the anchor: windows of 13 have six of them.
PART = 8
#: The sketch has 2 rows of 2**bits cells: about one for every 4 bytes of text (a sixth of an
#: anchor each), within these bounds. The upper one bounds what is broadcast (a bit a cell, 64 MB)
#: and filters well up to some 5 GB; beyond it more and more unique windows reach the exact
#: pass, where they cost time, and the result stays the same. `bits` can be raised where workers have the memory.
LEAST_BITS, MOST_BITS = 20, 28
#: Cells of a block, and anchors a task gathers before it passes its counts on.
BLOCK_BITS, GATHER = 20, 1 << 20
#: Windows passed on together.
OUT = 1 << 18
#: Anchors in more documents than this, or a 1/400,000 of the bytes, are hot: there are at
#: most 200,000 such cells a row, whatever the size of the corpus.
HOT, HOT_SHARE = 1000, 400_000
#: Groups that a hot window is dealt to; as many rows of it wait to be settled.
SALTS = 64
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Hashes(dict):
    """128-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_128_digest(word)
        return value


def word_hashes(parts: list[bytes], hashes: _Hashes) -> np.ndarray:
    return np.frombuffer(b"".join([hashes[p] for p in parts]), dtype="<u8").reshape(-1, 2)


def window_hashes(parts: list[bytes], hashes: _Hashes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of consecutive words."""
    both = word_hashes(parts, hashes)
    n = len(parts) - words + 1
    out = []
    for side, factor in enumerate(_FACTORS):
        column = np.ascontiguousarray(both[:, side])
        value = column[:n].copy()
        for k in range(1, words):
            value *= factor
            value += column[k:k + n]
        value ^= value >> np.uint64(29)
        out.append(value * np.uint64(0xBF58476D1CE4E5B9))
    return out[0], out[1]


def anchors(parts: list[bytes], hashes: _Hashes, words: int = WORDS) -> np.ndarray:
    """The anchor of every window of consecutive words."""
    n = len(parts) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    own = min(PART, words)
    count, column = len(parts) - own + 1, np.ascontiguousarray(word_hashes(parts, hashes)[:, 0])
    value = column[:count].copy()
    for k in range(1, own):
        value *= _FACTORS[1]
        value += column[k:k + count]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0x94D049BB133111EB)
    value ^= value >> np.uint64(29)
    least = value[:n].copy()
    for k in range(1, words - own + 1):
        np.minimum(least, value[k:k + n], out=least)
    return least


def _sides(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of an anchor in both rows. A least hash has small numbers, so it is mixed again."""
    shift = np.uint64(64 - bits)
    return tuple(((anchor * factor) >> shift).astype(np.int64) for factor in _FACTORS)


def _sketcher(bits: int, words: int) -> Callable:
    """Counts of cells per task, as sorted cells and counts of each block."""
    schema = pa.schema([("side", pa.int32()), ("block", pa.int64()), ("cells", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack = _Hashes(), zstandard.ZstdCompressor(level=1)
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for side in (0, 1):
                cells, counts = np.unique(np.concatenate([g[side] for g in gathered]), return_counts=True)
                blocks = cells >> BLOCK_BITS
                starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
                rows = []
                for a, b in zip(starts, [*starts[1:], len(cells)]):
                    gaps = np.diff(cells[a:b] & ((1 << BLOCK_BITS) - 1), prepend=0).astype("<u4")
                    planes = gaps.view(np.uint8).reshape(-1, 4).T.tobytes()
                    data = planes + counts[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                    rows.append(pack.compress(data))
                for at in range(0, len(rows), 256):
                    some = slice(at, at + 256)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([side] * len(rows[some]), pa.int32()),
                        pa.array(blocks[starts[some]], pa.int64()), pa.array(rows[some], pa.binary()),
                    ], schema=schema)

        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                if text is None:
                    continue
                own = np.unique(anchors(text.encode().split(), hashes, words))
                if len(own):
                    gathered.append(_sides(own, bits))
                    size += len(own)
                if size >= GATHER:
                    yield from flush()
                    gathered, size = [], 0
        if size:
            yield from flush()

    return sketch


def _merger(hot: int) -> Callable:
    """Add up the counts of each block: a bit for cells counted twice, a list of the hot ones."""
    schema = pa.schema([("side", pa.int32()), ("block", pa.int64()), ("twice", pa.binary()), ("hot", pa.binary())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, open_block, counts = zstandard.ZstdDecompressor(), None, None

        def close() -> pa.RecordBatch:
            twice = np.packbits(counts >= 2, bitorder="little").tobytes()
            heavy = np.flatnonzero(counts >= hot).astype("<u4").tobytes()
            return pa.RecordBatch.from_arrays([
                pa.array([open_block[0]], pa.int32()), pa.array([open_block[1]], pa.int64()),
                pa.array([twice], pa.binary()), pa.array([heavy], pa.binary()),
            ], schema=schema)

        for batch in batches:
            sides, blocks = batch.column("side").to_pylist(), batch.column("block").to_pylist()
            for side, block, data in zip(sides, blocks, batch.column("cells")):
                if (side, block) != open_block:
                    if open_block is not None:
                        yield close()
                    open_block, counts = (side, block), np.zeros(1 << BLOCK_BITS, dtype=np.int64)
                planes = np.frombuffer(unpack.decompress(data.as_py()), dtype=np.uint8).reshape(8, -1)
                gaps = np.ascontiguousarray(planes[:4].T).view("<u4").ravel()
                counts[np.cumsum(gaps, dtype=np.int64)] += np.ascontiguousarray(planes[4:].T).view("<u4").ravel()
        if open_block is not None:
            yield close()

    return merge


class Sketch:
    """Which cells were counted twice or more, and which are hot. Its size is bounded by `bits`."""

    def __init__(self, bits: int, rows: list):
        self.bits = bits
        self.twice = [np.zeros(1 << (bits - 3), dtype=np.uint8) for _ in range(2)]
        hot: list[list] = [[], []]
        wide = 1 << (BLOCK_BITS - 3)
        for side, block, twice, heavy in rows:
            self.twice[side][block * wide:(block + 1) * wide] = np.frombuffer(twice, np.uint8)
            hot[side].append(np.frombuffer(heavy, "<u4").astype(np.int64) + (block << BLOCK_BITS))
        self.hot = [np.sort(np.concatenate(h)) if h else np.zeros(0, np.int64) for h in hot]

    def repeated(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of windows that may be in two documents, and which of them may be in very many."""
        if not len(anchor):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        found, heavy = np.ones(len(starts), bool), np.ones(len(starts), bool)
        for side, cells in enumerate(_sides(anchor[starts], self.bits)):
            found &= (self.twice[side][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
            hot = self.hot[side]
            at = np.minimum(np.searchsorted(hot, cells), len(hot) - 1)
            heavy &= hot[at] == cells if len(hot) else False
        sizes = np.diff(np.append(starts, len(anchor)))
        at = np.flatnonzero(np.repeat(found, sizes))
        return at, np.repeat(heavy, sizes)[at]


def sketch_windows(docs: DataFrame, words: int = WORDS, bits: int | None = None) -> Sketch:
    """The merged sketch of the anchors of all windows. Only blocks of bits reach the driver, at most 64 MB."""
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = bits or min(MOST_BITS, max(LEAST_BITS, (size // 4).bit_length()))
    counted = docs.select("text").mapInArrow(_sketcher(bits, words), "side int, block bigint, cells binary")
    merged = counted.repartition("side", "block").sortWithinPartitions("side", "block").mapInArrow(
        _merger(max(HOT, size // HOT_SHARE)), "side int, block bigint, twice binary, hot binary"
    )
    return Sketch(bits, merged.collect())


READ = pa.schema([
    ("first", pa.int64()), ("second", pa.int64()), ("k_id", pa.int64()), ("k_text", pa.int64()), ("place", pa.int32()),
    ("hot", pa.bool_()),
])
_READ = "first bigint, second bigint, k_id bigint, k_text bigint, place int, hot boolean"


def _reader(sketch, words: int) -> Callable:
    """Windows that may be repeated; the second hash of a hot one is that of its salt."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = _Hashes(), sketch.value
        out: list[list[np.ndarray]] = [[] for _ in READ]
        size = 0

        def gathered() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c), type=f.type) for c, f in zip(out, READ)], schema=READ)

        for batch in batches:
            for k_id, k_text, text in zip(*(batch.column(c) for c in ("k_id", "k_text", "text"))):
                text = text.as_py()
                if text is None:
                    continue
                parts, k_id, k_text = text.encode().split(), k_id.as_py(), k_text.as_py()
                at, heavy = known.repeated(anchors(parts, hashes, words))
                if not len(at):
                    continue
                first, second = (h[at].view(np.int64) for h in window_hashes(parts, hashes, words))
                second[heavy] = k_text % SALTS
                row = (first, second, np.full(len(at), k_id), np.full(len(at), k_text), at.astype(np.int32), heavy)
                for column, values in zip(out, row):
                    column.append(values)
                size += len(at)
                if size >= OUT:
                    yield gathered()
                    out, size = [[] for _ in READ], 0
        if size:
            yield gathered()

    return read


def _spans(words: int):
    @F.arrow_udf("binary")
    def spans(places: pa.Array) -> pa.Array:
        """Merged (start, end) word ranges of window positions, as packed 32-bit integers."""
        out = []
        for positions in places:
            at = np.sort(positions.values.to_numpy())
            breaks = np.flatnonzero(np.diff(at) > words) + 1
            starts, ends = at[np.concatenate([[0], breaks])], at[np.concatenate([breaks - 1, [len(at) - 1]])] + words
            out.append(np.stack([starts, ends], axis=1).astype("<u4").tobytes())
        return pa.array(out, pa.binary())

    return spans


def repeated_spans(docs: DataFrame, words: int = WORDS, bits: int | None = None) -> DataFrame:
    """Written table (k_id, k_text, spans): word ranges of each document that earlier ones have too.

    The texts are read twice, whatever the size. A hot window would gather in one task, so its
    rows are dealt by the text's hash; the least of each salt waits for the least of all.
    Repeated rows send the same places, which are merged before they are shuffled.
    """
    rows = keyed(docs)
    sketch = docs.sparkSession.sparkContext.broadcast(sketch_windows(docs, words, bits))
    group = Window.partitionBy("first", "second", "hot")
    ranked = rows.mapInArrow(_reader(sketch, words), _READ).withColumn("least", F.min("k_id").over(group))
    later = F.col("k_id") > F.col("least")
    per_text = written(ranked.where(later | F.col("hot")).groupBy(*KEY).agg(
        F.collect_set(F.when(later, F.col("place"))).alias("places"),
        F.collect_set(F.when(~later, F.struct("first", "place"))).alias("waiting"),
    ), "places")
    waiting = written(per_text.where(F.size("waiting") > 0).select(*KEY, F.explode("waiting").alias("w")).select(
        *KEY, "w.first", "w.place"), "waiting")
    firsts = waiting.groupBy("first").agg(F.min("k_id").alias("least"))
    settled = waiting.join(checked_broadcast(written(firsts, "firsts")), "first").where("k_id > least").groupBy(*KEY).agg(
        F.collect_set("place").alias("more"))
    none = F.array().cast("array<int>")
    places = F.concat("places", F.coalesce("more", none))
    found = per_text.join(settled, KEY, "left").select(*KEY, places.alias("places")).where(F.size("places") > 0)
    return written(found.select(*KEY, _spans(words)(F.col("places")).alias("spans")), "spans")


def cut_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The words left, joined by one space, when the spans are cut out."""
    total, removed, kept = [], [], []
    for text, span in zip(texts, spans):
        parts = (text.as_py() or "").encode().split()
        total.append(len(parts))
        if span.is_valid:
            ranges = np.frombuffer(span.as_py(), "<u4").reshape(-1, 2).tolist()
            left, at = [], 0
            for start, end in ranges:
                left += parts[at:start]
                at = end
            parts = left + parts[at:]
        removed.append(total[-1] - len(parts))
        kept.append(b" ".join(parts).decode())
    return pa.StructArray.from_arrays(
        [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
        names=["n_words", "n_removed", "kept"],
    )


def drop_repeated(docs: DataFrame, words: int = WORDS, bits: int | None = None) -> DataFrame:
    """(row, cut): a struct of each document's own columns and one of (n_words, n_removed, kept)."""
    cut = F.arrow_udf(cut_spans, "struct<n_words: bigint, n_removed: bigint, kept: string>")
    found = by_key(docs, repeated_spans(docs, words, bits), "left", wide="spans")
    return found.select("row", cut(F.col("row.text"), F.col("found.spans")).alias("cut"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document.

    Null and empty texts have no words. A null doc_id comes before all others; rows with one
    doc_id never take words from each other. Repeated rows are cut alike. Very long texts are
    read whole, one at a time. Other columns are never read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated(docs).select(
        "row.doc_id", F.col("cut.n_words").alias("n_words"), F.col("cut.n_removed").alias("n_removed"),
        F.sha2(F.col("cut.kept").cast("binary"), 256).alias("kept_sha256"),
    )
