"""MinHash near-duplicates with tensored banding.

Two small collections of TABLES partial keys are computed for each set of shingles, each
partial key from WIDTH minima. The key of table (i, j) is the pair of the i-th partial key of
one and the j-th of the other: TABLES * TABLES tables of 2 * WIDTH minima out of 2 * TABLES *
WIDTH minima, about the square root of what independent tables would take. A pair of sets
shares a table if it shares a partial key of either collection, so at similarity J it is
missed with probability 1 - (1 - (1 - J^WIDTH)^TABLES)^2: 1.5 in 10,000 at 0.85, 5 in a
million at 0.9. What shares a table and agrees in enough of the minima is a candidate;
links are confirmed on the whole sets.

Nowhere are all pairs of a group written: candidates and links join what belongs together, at
most about one a member, so that their components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, by_key, checked_broadcast, table, written
from .components import components
from .simhash import shingle_hashes

WORDS, PERCENT = 5, 85
#: Minima of a partial key, and partial keys of each of the two collections.
WIDTH, TABLES = 3, 10
MINIMA = 2 * TABLES * WIDTH
#: Two bits of each minimum go along with a key. Sets of similarity 0.85 agree in 53 of 60 pairs of
#: bits, give or take 2.5; below this many a pair is no candidate (unrelated sets: 15).
AGREE = 41
#: Rows of a key compared in one go. A key of more is dealt to parts that are joined by one link each.
TOGETHER = 8192
#: Bytes of sets compared in one go; larger groups are first compared with one of their sets.
SET_BYTES = 8 << 20
#: Sets compared in one go, whatever their size.
SET_ROWS = 512
#: Shingles whose minima are taken in one go.
STEP = 4096
_PLACES = np.arange(MINIMA, dtype="<u8")
_FACTORS = np.array([xxhash.xxh64_intdigest(p.tobytes(), 1) | 1 for p in _PLACES], dtype=np.uint64)[:, None]
_MASKS = np.array([xxhash.xxh64_intdigest(p.tobytes(), 2) for p in _PLACES], dtype=np.uint64)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EVEN = np.uint64(0x5555555555555555)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the different shingles; the whole sequence is one if the words are fewer."""
    parts = (text or "").encode().lower().split()
    return np.unique(shingle_hashes(parts, WORDS)) if parts else np.zeros(0, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of the shingles in each of MINIMA orders."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), STEP):
        mixed = (shingles[None, at:at + STEP] ^ _MASKS) * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def partial_keys(least: np.ndarray) -> np.ndarray:
    """Of rows of minima, the partial keys of both collections, one after the other."""
    parts = least.reshape(-1, 2 * TABLES, WIDTH)
    key = parts[..., 0]
    for k in range(1, WIDTH):
        key = ((key ^ (key >> np.uint64(29))) * _MIX) ^ parts[..., k]
    return key * _MIX


def agreement_bits(least: np.ndarray) -> np.ndarray:
    """Of rows of minima, two bits of each, in two numbers."""
    two = ((least * _MIX) >> np.uint64(62)).reshape(-1, 2, MINIMA // 2)
    return (two << (2 * np.arange(MINIMA // 2, dtype=np.uint64))).sum(axis=-1, dtype=np.uint64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many minima rows of two numbers seem to agree."""
    apart = a ^ b
    return MINIMA - np.bitwise_count((apart | (apart >> np.uint64(1))) & _EVEN).sum(axis=-1, dtype=np.int64)


SKETCH = "struct<n: bigint, sid: binary, lefts: array<bigint>, rights: array<bigint>, bits: array<bigint>>"


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _sketches(texts: pa.Array) -> pa.Array:
    sizes, names, least = [], [], np.zeros((len(texts), MINIMA), dtype=np.uint64)
    for i, text in enumerate(texts):
        own = shingle_set(text.as_py())
        sizes.append(len(own))
        names.append(xxhash.xxh3_128_digest(own.tobytes()))
        if len(own):
            least[i] = minima(own)
    keys = partial_keys(least)
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), _lists(keys[:, :TABLES]), _lists(keys[:, TABLES:]),
         _lists(agreement_bits(least))],
        names=["n", "sid", "lefts", "rights", "bits"])


def _shingle_sets(texts: pa.Array) -> pa.Array:
    return pa.array([shingle_set(t.as_py()).tobytes() for t in texts], type=pa.binary())


def spanning(near: Callable[[int, np.ndarray], np.ndarray], count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(member, members near it that hang on it): each of `count` members hangs on one at most."""
    rest = np.arange(count)
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            own = front.pop()
            found = near(own, rest)
            if found.any():
                front.extend(rest[found].tolist())
                yield own, rest[found]
                rest = rest[~found]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by key and part, cut where a group ends, and where each group starts and ends."""
    held = None
    for rows in batches:
        if not rows.num_rows:
            continue
        rows = pa.Table.from_batches([rows])
        held = pa.concat_tables([held, rows]) if held is not None else rows
        keys = np.stack([held["key"].to_numpy(), held["part"].to_numpy()])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        if len(edges) > 1:
            yield held.slice(0, edges[-1]), edges
            held = held.slice(edges[-1])
    if held is not None:
        yield held, [0, held.num_rows]


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "crowd"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links within the groups; of each part of a crowded key all members, and the least one by itself."""
    for rows, edges in whole_groups(batches):
        ids, key, crowd = rows["id"].to_numpy(), rows["key"].to_numpy(), rows["crowd"].to_numpy()
        bits = np.stack([rows["b0"].to_numpy(), rows["b1"].to_numpy()], axis=1).view(np.uint64)
        sizes, starts = np.diff(edges), np.array(edges[:-1])
        group = np.repeat(np.arange(len(sizes)), sizes)
        few = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= 4) & ~crowd)
        for step in range(1, 4):
            a, b = few[:-step], few[step:]
            close = (group[a] == group[b]) & (agreeing(bits[a], bits[b]) >= AGREE)
            if close.any():
                yield _links(ids[a[close]], ids[b[close]])
        for g in np.flatnonzero((sizes > 4) & ~crowd[starts]).tolist():
            first, last = edges[g], edges[g + 1]
            own = bits[first:last]
            for i, found in spanning(lambda i, rest: agreeing(own[rest], own[i]) >= AGREE, last - first):
                yield _links(np.full(len(found), ids[first + i]), ids[first + found])
        for g in np.flatnonzero(crowd[starts]).tolist():
            first, last = edges[g], edges[g + 1]
            yield _links(np.full(last - first - 1, ids[first]), ids[first + 1:last])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[first:first + 1]), pa.nulls(1, pa.int64()), pa.array(key[first:first + 1])], names=["a", "b", "crowd"])


def _table_keys(lefts: Column, place: Column | None = None) -> Column:
    """Pairs of these partial keys, the first standing at `place`, with all of the other collection."""
    return F.flatten(F.transform(lefts, lambda g, i: F.transform(
        "rights", lambda h, j: F.xxhash64(g, h, (i if place is None else place) * TABLES + j))))


def crowded_keys(sets: DataFrame, together: int) -> DataFrame:
    """Written table (key, count) of the keys with more than `together` sets.

    Such a key has a partial key with as many, so partial keys are counted first, a tenth of the rows.
    """
    partial = sets.select("rights", F.posexplode("lefts").alias("i", "g"))
    often = written(partial.groupBy("i", "g").count().where(F.col("count") > together).select("i", "g"), "often")
    found = partial.join(checked_broadcast(often), ["i", "g"]).select(
        F.explode(_table_keys(F.array("g"), F.col("i"))).alias("key"))
    return written(found.groupBy("key").count().where(F.col("count") > together), "crowded")


def candidate_links(sets: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Links (a, b) between ids of `sets` (id, lefts, rights, bits) that join what shares a table and seems alike.

    A key with more than `together` sets is dealt to parts; the sets of a part, and the least
    of the parts, are joined whether they seem alike or not, so that nothing is lost and
    the rows grow with the number of sets only.
    """
    keyed = sets.select("id", F.col("bits")[0].alias("b0"), F.col("bits")[1].alias("b1"),
                        F.explode(_table_keys(F.col("lefts"))).alias("key"))
    parts = F.ceil(F.coalesce("count", F.lit(1)) / together).cast("int")
    dealt = keyed.join(checked_broadcast(crowded_keys(sets, together)), "key", "left").select(
        "key", F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("long").alias("part"), "id", "b0", "b1",
        F.col("count").isNotNull().alias("crowd"))
    met = written(dealt.repartition("key", "part").sortWithinPartitions("key", "part", "id")
                  .mapInArrow(_candidates, "a bigint, b bigint, crowd bigint"), "met")
    heads = met.where("crowd IS NOT NULL").select("crowd", F.col("a").alias("b"))
    least = heads.groupBy("crowd").agg(F.min("b").alias("a"))
    return met.where("crowd IS NULL").select("a", "b").union(heads.join(least, "crowd").select("a", "b"))


def shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of its shingles each of the others, none of them empty, has in common with `own`."""
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
    starts = np.cumsum([0, *(len(x) for x in others[:-1])])
    return np.add.reduceat((own[at] == joined).astype(np.int64), starts)


def alike(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the others are linked with `own`."""
    sizes = np.array([len(x) for x in others], dtype=np.int64)
    found = 100 * np.minimum(sizes, len(own)) >= PERCENT * np.maximum(sizes, len(own))
    at = np.flatnonzero(found)
    if len(at):
        both = shared(own, [others[i] for i in at.tolist()])
        found[at] = 100 * both >= PERCENT * (len(own) + sizes[at] - both)
    return found


def _set(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=np.uint64)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the groups, on the whole sets."""
    for rows, edges in whole_groups(batches):
        names, sets = rows["sid"].to_pylist(), [_set(x) for x in rows["shingles"].to_pylist()]
        for first, last in zip(edges, edges[1:]):
            own = sets[first:last]
            for i, found in spanning(lambda i, rest: alike(own[i], [own[j] for j in rest.tolist()]), last - first):
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[first + i]] * len(found), pa.binary()),
                    pa.array([names[first + j] for j in found.tolist()], pa.binary()),
                ], names=["a", "b"])


def _with_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which members are linked with the centre, the first row of each part."""
    group, centre = None, None
    for rows in batches:
        out = []
        for key, part, place, sid, value in zip(*(rows[c].to_pylist() for c in ("key", "part", "place", "sid", "shingles"))):
            if place == 0:
                group, centre = (key, part), (sid, _set(value))
            elif group == (key, part):
                out.append((key, centre[0], sid, bool(alike(centre[1], [_set(value)])[0])))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.bool_()))],
                names=["key", "a", "b", "linked"])


def _with_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the members (place 1) with those no centre is linked with (place 0), held part by part."""
    group, names, sets, top = None, [], [], []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for rows in batches:
        out = []
        for key, part, place, sid, value in zip(*(rows[c].to_pylist() for c in ("key", "part", "place", "sid", "shingles"))):
            if (key, part) != group:
                group, names, sets, top = (key, part), [], [], []
            if place == 0:
                names.append(sid)
                sets.append(_set(value))
                top.append(len(top))
            elif sets:
                known: set[int] = set()
                for i in np.flatnonzero(alike(_set(value), sets)).tolist():
                    if (r := root(i)) not in known:  # one link for each part of the group it joins
                        known.add(r)
                        out.append((names[i], sid))
                for r in known:
                    top[r] = min(known)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])


def confirmed_links(sets: DataFrame, together: int = SET_BYTES, most: int = SET_ROWS) -> DataFrame:
    """Links (a, b) between sids of a written table (key, sid, shingles), `key` naming the candidate group.

    A group of more than `together` bytes or `most` sets is first compared with its least set, which is copied
    once for each part of the group. Only what that one isn't linked with is then compared
    with the whole group, part against part; if all are copies of one text, nothing is left.
    """
    size = F.greatest(F.sum(F.octet_length("shingles")) / together, F.count("*") / most)
    large = written(sets.groupBy("key").agg(F.ceil(size).alias("parts"), F.min("sid").alias("centre")).where("parts > 1"), "large")
    marked = sets.join(checked_broadcast(large), "key", "left")
    within = (
        marked.where("parts IS NULL").select("key", F.lit(0).cast("long").alias("part"), "sid", "shingles")
        .repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_confirmed, "a binary, b binary")
    )
    if large.isEmpty():
        return within
    grouped = written(marked.where("parts IS NOT NULL"), "grouped")
    part = F.pmod(F.xxhash64("sid", F.lit(7)), "parts")

    def met(rows: DataFrame, function: Callable, kind: str) -> DataFrame:
        return rows.repartition("key", "part").sortWithinPartitions("key", "part", "place", "sid").mapInArrow(function, kind)

    columns = ["key", "part", "place", "sid", "shingles"]
    centres = grouped.where("sid = centre").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    star = written(met(
        centres.withColumn("place", F.lit(0)).select(*columns).union(
            grouped.where("sid <> centre").withColumn("part", part).withColumn("place", F.lit(1)).select(*columns)),
        _with_centre, "key bigint, a binary, b binary, linked boolean"), "star")
    links = within.union(star.where("linked").select("a", "b"))
    apart = written(star.where("NOT linked").select("key", F.col("b").alias("sid")), "apart")
    if apart.isEmpty():
        return links
    left = written(grouped.join(apart, ["key", "sid"], "left_semi"), "left")
    held = left.groupBy("key").agg(F.ceil(size).alias("blocks"))
    block = F.pmod(F.xxhash64("sid", F.lit(11)), "blocks")
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    ones = left.join(held, "key").withColumn("part", F.explode(F.transform(every, lambda p: block * F.col("parts") + p)))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    others = grouped.join(held, "key").withColumn("part", F.explode(F.transform(blocks, lambda b: b * F.col("parts") + part)))
    rest = met(ones.withColumn("place", F.lit(0)).select(*columns).union(others.withColumn("place", F.lit(1)).select(*columns)),
               _with_others, "a binary, b binary")
    return links.union(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, sid, component_id) of every row; equal sets share a sid.

    component_id is the smallest doc_id reachable over links, itself included. Null ids are
    never the smallest; a component of null ids only has a null component_id.
    """
    sketch = F.arrow_udf(_sketches, SKETCH)(F.col("text"))
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k_text"), sketch.alias("s"),
    ).select("doc_id", "k_text", "s.*"), "sketches")
    at = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("k_id"), "k_text")
    sets = written(rows.where("n > 0").groupBy("sid").agg(
        F.min("doc_id").alias("first_id"), F.min(at).alias("at"),
        *(F.first(c).alias(c) for c in ("lefts", "rights", "bits")),
    ).withColumn("id", F.xxhash64("sid")), "sets")
    groups = components(candidate_links(sets))
    members = written(sets.join(groups, sets["id"] == groups["node"]).select("at.*", "sid", F.col("root").alias("key")), "members")
    whole = by_key(docs.select("doc_id", "text"), members, "inner").dropDuplicates(["found"])
    compared = written(whole.select(
        "found.key", "found.sid", F.arrow_udf(_shingle_sets, "binary")(F.col("row.text")).alias("shingles")), "compared")
    roots = components(confirmed_links(compared))
    linked = written(roots.join(sets, roots["node"] == sets["sid"]).select("sid", "root", "first_id"), "linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    single = sets.join(linked, "sid", "left_anti").select("sid", F.col("first_id").alias("component_id"))
    classes = written(linked.join(least, "root").select("sid", "component_id").union(single), "classes")
    found = rows.select("doc_id", "n", "sid").join(classes, "sid", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "sid",
                        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of texts alike in 85 % of their five-word shingles.

    Null, empty and blank texts have no shingles, are linked with nothing and kept. Repeated
    rows and equal texts are linked; rows that share a doc_id get equal verdicts if their
    components do. A null doc_id is kept only where no row with an id is in its component.
    Very long texts are cut into shingles whole, one at a time. Other columns are never read.
    """
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Compares all pairs of different sets that share a shingle: for small tables.
SQL = f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
flat AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM words),
shingles AS (SELECT DISTINCT r, s FROM (
    SELECT r, {" || ' ' || ".join(["x", *(f"lead(x, {k}) OVER o" for k in range(1, WORDS))])} AS s
    FROM flat WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE s IS NOT NULL
  UNION ALL SELECT r, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND {WORDS - 1}),
sets AS (SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM shingles GROUP BY r),
kinds AS (SELECT k, any_value(n) AS n, min(doc_id) AS first_id, min(r) AS r FROM sets JOIN words USING (r) GROUP BY k),
inside AS (SELECT k, n, s FROM kinds JOIN shingles USING (r)),
pairs AS (SELECT a.k AS a, b.k AS b FROM inside a JOIN inside b ON a.s = b.s AND a.k <> b.k
  GROUP BY a.k, b.k HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT k, first_id AS id FROM kinds UNION SELECT p.b, r.id FROM reach r JOIN pairs p ON p.a = r.k),
classes AS (SELECT k, min(id) AS id FROM reach GROUP BY k)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE id END AS kept
FROM words LEFT JOIN sets USING (r) LEFT JOIN classes USING (k)
"""
