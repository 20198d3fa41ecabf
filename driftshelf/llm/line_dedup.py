"""Line dedup by an edit-distance join: segments, length-aware substrings, banded verification.

Of two lines at edit distance `edits` or less, one of the shorter's edits + 1 segments stands
unchanged in the longer, shifted by a little. Each line leaves its own segments and the
substrings at which segments of lines up to `edits` shorter could stand, as hashes with
length and segment number. Lines that meet in a hash are compared. Linked lines form
classes; the first line of a class, by document and place, stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, KEY, by_key, checked_broadcast, keyed, table, written
from .components import components

EDITS = 2
#: Lines with fewer characters are repeated if they are equal: two edits change too much of them.
LEAST_CHARS = 32
#: A hash with more lines than this is dealt to parts, and every two parts are compared apart.
TOGETHER = 64


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 nearly equal segments; the last ones are the longer ones."""
    short, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        size = short + (i > edits - longer)
        out.append((at, size))
        at += size
    return out


def probes(line: str, edits: int = EDITS) -> Iterator[tuple[int, bool]]:
    """(hash, is own segment) of the substrings of a line that can match a segment.

    With i errors at most before segment i and edits - i after it, only these starts count.
    """
    n = len(line)
    for less in range(min(edits, n) + 1):
        length = n - less
        for i, (start, size) in enumerate(segments(length, edits)):
            rest = edits - i
            first = max(0, start - i, start + less - rest)
            last = min(n - size, start + i, start + less + rest)
            for at in range(first, last + 1):
                value = xxhash.xxh64_intdigest(line[at:at + size].encode(), length * (edits + 1) + i)
                yield value - ((value >> 63) << 64), not less and at == start


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most `edits`, by bit vectors of a band of diagonals.

    Bit r of a vector in column j stands for row j - edits + r. The vectors move down a row
    with each column, and the distance is summed along the diagonal that ends in the corner.
    """
    if len(a) < len(b):
        a, b = b, a
    ahead = len(a) - len(b)
    if ahead > edits:
        return False
    start = 0
    for x, y in zip(a, b):
        if x != y:
            break
        start += 1
    end = 0
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if not b:
        return True
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << (2 * edits + 1)) - 1
    up, down = full & ~((1 << edits) - 1), 0
    corner, distance = 1 << (ahead + edits), ahead
    for j, c in enumerate(b):
        match = places.get(c, 0)
        match = (match >> (j - edits) if j >= edits else match << (edits - j)) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        if not same & corner:
            distance += 1
            if distance > edits:
                return False
        right_up = (down | ~(same | up)) & full
        right_down = same & up
        up = (right_down | ~((same >> 1) | right_up)) & full
        down = (same >> 1) & right_up
    return True


def _short_id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _lines(text: str | None, least: int) -> Iterator[str]:
    return (line for line in (text or "").split("\n") if len(line) >= least)


def _signing(edits: int, least: int) -> Callable:
    """(hash, line, own) rows of every line, a line once per batch; line is 64 bits of its MD5."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            rows: list[tuple[int, int, bool]] = []
            for text in batch.column("text"):
                for line in _lines(text.as_py(), least):
                    name = _short_id(hashlib.md5(line.encode()).digest())
                    if name not in seen:
                        seen.add(name)
                        rows += [(h, name, own) for h, own in probes(line, edits)]
                if len(rows) > 100_000:
                    yield _signed(rows)
                    rows = []
            if rows:
                yield _signed(rows)

    return sign


def _signed(rows: list) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.bool_())], names=["hash", "line", "own"]
    )


def _meeting(together: int) -> Callable:
    """Batches sorted by (hash, line): pairs of lines that meet, or the members of a large group."""
    names = ["a", "b", "crowd"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        crowd = None  # the hash whose members are passed on as they come

        def pairs(lines: np.ndarray, own: np.ndarray, rows: list) -> None:
            mine: dict[int, bool] = {}
            for line, flag in zip(lines.tolist(), own.tolist()):
                mine[line] = mine.get(line, False) or flag
            members = list(mine.items())
            for i, (x, p) in enumerate(members):
                for y, q in members[i + 1:]:
                    if p or q:
                        rows.append((min(x, y), max(x, y), None))

        def settle(hashes: np.ndarray, lines: np.ndarray, own: np.ndarray) -> list[tuple]:
            rows: list[tuple] = []
            edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]))
            several = np.flatnonzero(np.diff(edges) > 1)
            for g in several.tolist():
                first, last = edges[g], edges[g + 1]
                if lines[first] == lines[last - 1] or not own[first:last].any():
                    continue
                some = lines[first:last]
                if len(some) > together and len(np.unique(some)) > together:
                    rows += [(x, None, int(hashes[first])) for x in np.unique(some).tolist()]
                else:
                    pairs(some, own[first:last], rows)
            return rows

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column("hash").to_numpy(), batch.column("line").to_numpy(),
                   batch.column("own").to_numpy(zero_copy_only=False)]
            if crowd is not None:
                more = int(np.searchsorted(new[0], crowd, side="right"))
                if more:
                    yield out([(x, None, crowd) for x in np.unique(new[1][:more]).tolist()])
                if more == batch.num_rows:
                    continue
                crowd, new = None, [c[more:] for c in new]
            kept = [np.concatenate(x) for x in zip(kept, new)]
            last = int(np.searchsorted(kept[0], kept[0][-1], side="left"))
            rows = settle(*(c[:last] for c in kept))
            kept = [c[last:] for c in kept]
            members = np.unique(kept[1])
            if len(members) > together:  # own segment or not: comparing a pair more does no harm
                crowd = int(kept[0][0])
                rows += [(x, None, crowd) for x in members.tolist()]
                kept = [c[:0] for c in kept]
            elif len(kept[0]) > 4 * together:  # the same few lines again and again
                _, index = np.unique(np.stack([kept[1], kept[2]]), axis=1, return_index=True)
                kept = [c[np.sort(index)] for c in kept]
            if rows:
                yield out(rows)
        if rows := settle(*kept):
            yield out(rows)

    return meet


def _fetching(wanted, least: int) -> Callable:
    """(line, id, text) of the lines in the broadcast sorted array, or of all lines without one."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        for batch in batches:
            names, digests, texts = [], [], []
            for text in batch.column("text"):
                for line in _lines(text.as_py(), least):
                    digests.append(hashlib.md5(line.encode()).digest())
                    texts.append(line)
            names = np.array([_short_id(d) for d in digests], dtype=np.int64)
            if known is None:
                chosen = range(len(names))
            else:
                at = np.minimum(np.searchsorted(known, names), max(0, len(known) - 1))
                chosen = np.flatnonzero(known[at] == names) if len(known) else []
            first = {digests[i]: i for i in chosen}
            if first:
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[i] for i in first.values()], pa.int64()), pa.array(list(first), pa.binary()),
                    pa.array([texts[i] for i in first.values()], pa.string()),
                ], names=["line", "id", "text"])

    return fetch


def _close(edits: int) -> Callable:
    def close(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([within(a, b, edits) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.bool_())

    return F.arrow_udf(close, "boolean")


def _crowd_links(edits: int) -> Callable:
    """Batches sorted by (crowd, part): links that join what close pairs within a group join."""

    def spanning(group: list[tuple[bytes, str]]) -> list[tuple[bytes, bytes]]:
        links = []
        while group:
            root, group = group[0], group[1:]
            front = [root[1]]
            while front and group:
                text, rest = front.pop(), []
                for item in group:
                    if within(text, item[1], edits):
                        links.append((root[0], item[0]))
                        front.append(item[1])
                    else:
                        rest.append(item)
                group = rest
        return links

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if links := spanning(group):
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            for crowd, part, name, text in zip(*(batch.column(c).to_pylist() for c in ("crowd", "part", "id", "text"))):
                if (crowd, part) != key:
                    yield from out()
                    key, group = (crowd, part), []
                group.append((name, text))
        yield from out()

    return link


def line_links(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, together: int = TOGETHER) -> DataFrame:
    """Links (a, b) between the MD5s of different lines whose components are those of all close lines."""
    texts_only = docs.select("text")
    signed = texts_only.mapInArrow(_signing(edits, least), "hash bigint, line bigint, own boolean")
    met = written(
        signed.repartition("hash").sortWithinPartitions("hash", "line", F.desc("own"))
        .mapInArrow(_meeting(together), "a bigint, b bigint, crowd bigint"), "met",
    )
    pairs = written(met.where("crowd IS NULL").select("a", "b").distinct(), "pairs")
    crowds = written(met.where("crowd IS NOT NULL").select("crowd", F.col("a").alias("line")).distinct(), "crowds")
    names = written(
        pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(crowds.select("line")).distinct(), "names"
    )
    if names.count() * 8 <= BROADCAST_BYTES:
        found = np.sort(names.toPandas()["line"].to_numpy(np.int64))
        fetched = texts_only.mapInArrow(
            _fetching(docs.sparkSession.sparkContext.broadcast(found), least), "line bigint, id binary, text string"
        )
    else:
        fetched = texts_only.mapInArrow(_fetching(None, least), "line bigint, id binary, text string").join(
            names, "line", "left_semi"
        )
    texts = written(fetched.groupBy("id", "line").agg(F.first("text").alias("text")), "texts")

    def named(side: str) -> DataFrame:
        return texts.select(F.col("line").alias(side), F.col("id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"))

    close = pairs.join(named("a"), "a").join(named("b"), "b").where(
        _close(edits)(F.col("a_text"), F.col("b_text"))
    ).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    parts = F.ceil(F.col("n") / together).cast("int")
    own = F.pmod(F.xxhash64("line", F.lit(7)), parts).cast("int")
    meetings = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda other: (F.greatest(own, other) * parts + F.least(own, other)).cast("long"),
    )
    crowded = (
        crowds.join(crowds.groupBy("crowd").agg(F.count("*").alias("n")), "crowd")
        .select("crowd", "line", F.explode(meetings).alias("part"))
        .join(texts, "line")
        .repartition("crowd", "part").sortWithinPartitions("crowd", "part")
        .mapInArrow(_crowd_links(edits), "a binary, b binary")
    )
    return close.union(crowded)


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """Written table (k_id, k_text, lines): numbers of the lines to drop, comma-joined, per document.

    Lines of fewer than `least` characters are in no link, so their class is the lines equal to
    them. Lines without characters are no text and stay.
    """
    roots = components(line_links(docs, edits, least))
    places = keyed(docs).select("k_id", "k_text", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    places = written(
        places.where(F.length("line") > 0).select("k_id", "k_text", "place", F.unhex(F.md5("line")).alias("id")),
        "places",
    )
    spot = F.struct("k_id", "k_text", "place")
    firsts = places.groupBy("id").agg(F.min(spot).alias("first"), F.count("*").alias("n"))
    classed = written(
        firsts.join(roots, firsts["id"] == roots["node"], "left")
        .select("id", "first", "n", F.coalesce("root", "id").alias("class")), "classed",
    )
    heads = classed.groupBy("class").agg(
        F.min("first").alias("head"), F.sum("n").alias("n_lines")
    ).where("n_lines > 1")
    repeated = written(classed.join(heads, "class").select("id", "head"), "repeated")
    later = places.join(checked_broadcast(repeated), "id").where(spot != F.col("head"))
    return written(
        later.groupBy(*KEY).agg(
            F.array_join(F.array_sort(F.collect_set("place")), ",").alias("lines")
        ), "later",
    )


def _dropping(texts: pa.Array, numbers: pa.Array) -> pa.Array:
    """The text without the lines numbered, and how many lines it had and has lost."""
    kept, total, lost = [], [], []
    for text, drop in zip(texts, numbers):
        text, drop = text.as_py(), drop.as_py()
        lines = text.split("\n") if text is not None else []
        total.append(len(lines))
        gone = set(map(int, drop.split(","))) if drop else set()
        lost.append(len(gone))
        kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if text is not None else None)
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())],
        names=["kept", "n_lines", "n_removed"],
    )


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """(row, dedup): a struct of each document's own columns and one of (kept, n_lines, n_removed)."""
    drop = F.arrow_udf(_dropping, "struct<kept: string, n_lines: bigint, n_removed: bigint>")
    found = by_key(docs, repeated_lines(docs, edits, least), "left", wide="lines")
    return found.select("row", drop(F.col("row.text"), F.col("found.lines")).alias("dedup"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of every document.

    A null text has no lines, an empty one has one. Short lines go if they are equal to an earlier one. A null
    doc_id comes first; equal rows are the same document and keep the same lines.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "row.doc_id", F.col("dedup.n_lines").alias("n_lines"), F.col("dedup.n_removed").alias("n_removed"),
        F.sha2(F.coalesce("dedup.kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
