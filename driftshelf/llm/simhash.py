"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming distance, components.

Two fingerprints at `distance` or less differ in at most `distance` of the `blocks` blocks
they are cut into, so they agree in some choice of blocks - distance of them. Fingerprints
are grouped by each such choice and compared inside the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, by_key, table, written
from .components import components

WORDS, SEED, DISTANCE, BLOCKS = 3, 42, 3, 6
#: Fingerprints compared in one go. Larger groups are cut into parts, and every pair of parts is compared.
TOGETHER = 2048


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    """A hash of each run of `words` words, repeats included; of all words if they are fewer."""
    joined = b" ".join(parts)
    hashed = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hashed(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist())
    return np.fromiter((hashed(joined[s:e], SEED) for s, e in pairs), dtype=np.uint64,
                       count=len(parts) - words + 1)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint, as a signed integer; 0 if there are no words.

    Bytes' own split and lower know ASCII white space and letters only, as is wanted.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    hashes = shingle_hashes(parts, words)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: str = "text") -> Column:
    """The fingerprint of a text column."""
    return F.arrow_udf(_fingerprints, "bigint")(F.col(text))


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], type=pa.int64())


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """A signed mask for each choice of blocks that a close pair may agree in."""
    if not 0 <= distance < blocks <= 64:
        raise ValueError("there must be more blocks than differing bits")
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(group: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that join what close pairs within `group` join: at most one for each member."""
    rest = group.view(np.uint64)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = [seed]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                front.extend(found)
                root = int(seed.astype(np.int64))
                yield from ((root, int(f)) for f in found.view(np.int64))


def _linker(distance: int) -> Callable:
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by group; a group may run over several batches."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        open_group, members = None, []

        def close() -> list[tuple[int, int]]:
            return list(spanning_links(np.concatenate(members), distance)) if members else []

        def batch(links: list) -> pa.RecordBatch:
            a, b = zip(*links)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for rows in batches:
            if not rows.num_rows:
                continue
            keys = np.stack([rows.column(c).to_numpy() for c in ("mask", "block", "part")])
            prints = rows.column("fingerprint").to_numpy()
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
            links = []
            for first, last in zip(edges, edges[1:]):
                group = tuple(keys[:, first])
                if group != open_group:
                    links += close()
                    open_group, members = group, []
                members.append(prints[first:last])
            if links:
                yield batch(links)
        if links := close():
            yield batch(links)

    return link


def close_links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS,
                together: int = TOGETHER) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all close pairs.

    No pair of a group is written out that isn't needed to connect it: a group of n gives at
    most n - 1 links. A group above `together` is dealt to parts by hash, and every two parts
    meet in a task of their own, so none holds more than about twice `together`.
    """
    masks = block_masks(distance, blocks)
    keys = prints.select(
        "fingerprint",
        F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks))).alias("mask", "block"),
    )
    shared = keys.groupBy("mask", "block").count().where("count > 1")
    parts = F.ceil(F.col("count") / together).cast("int")
    own = F.pmod(F.xxhash64("fingerprint", F.lit(7)), parts).cast("int")
    meetings = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda other: (F.greatest(own, other) * parts + F.least(own, other)).cast("long"),
    )
    dealt = (
        keys.join(shared, ["mask", "block"])
        .select("mask", "block", "fingerprint", F.explode(meetings).alias("part"))
        .repartition("mask", "block", "part")
        .sortWithinPartitions("mask", "block", "part", "fingerprint")
    )
    return dealt.mapInArrow(_linker(distance), "a bigint, b bigint")


def classes(prints: DataFrame) -> DataFrame:
    """Written table (fingerprint, root, component_id) of a written table (doc_id, fingerprint).

    component_id is the smallest doc_id reachable over close fingerprints. Null ids are never
    the smallest; a component of null ids only has a null component_id.
    """
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(close_links(distinct.select("fingerprint")))
    rooted = written(
        distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
            "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
        ), "roots",
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return written(rooted.join(smallest, "root").select("fingerprint", "root", "component_id"), "classes")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    return docs.withColumn("fingerprint", fingerprints())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated
    rows keep a row each.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = written(with_fingerprint(docs).drop("text"), "prints")
    return prints.join(classes(prints).drop("root"), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one document of each component of close fingerprints: the one with the smallest doc_id.

    Null, empty and blank texts are copies of each other. Ties (one id on several rows of a
    component) go to the smallest hash of the text, and of equal rows one stays; a null doc_id
    comes last. All columns are kept, whatever their names. The kept row is picked by an
    aggregate over narrow rows; only the kept keys are joined with the texts.
    """
    prints = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k_text"), fingerprints().alias("fingerprint"),
    ), "prints")
    counted = prints.groupBy("doc_id", "k_text", "fingerprint").agg(F.count("*").alias("n"))
    best = counted.join(classes(prints), "fingerprint").groupBy("root").agg(F.min_by(
        F.struct("doc_id", "k_text", "n"), F.struct(F.col("doc_id").isNull(), "doc_id", "k_text")
    ).alias("kept"))
    kept = written(best.select(
        F.coalesce("kept.doc_id", F.lit(NO_ID)).alias("k_id"), "kept.k_text", "kept.n"
    ), "kept")
    found = by_key(docs, kept, "inner")
    once = found.where("found.n = 1").select("row")
    if not kept.where("n > 1").isEmpty():
        once = once.union(found.where("found.n > 1").dropDuplicates(["found"]).select("row"))
    return once.select("row.*")
