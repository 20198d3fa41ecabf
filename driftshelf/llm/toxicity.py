"""Toxicity by two Kneser-Ney models of word pairs, one of toxic and one of ordinary texts.

A word's probability after the word before it comes from the texts of the class that hold the
pair. Each count is discounted by one; what that frees goes to the pair's probability in both
classes together, and from there to the number of different words it follows in either. So a
pair that was seen once says no more than its first word does, and one that a class repeats
says much, however ordinary its two words are.

A word alone is judged by its continuation count in each class (the number of different words
it follows), discounted in favour of its stem (its first letters) in the class and of what
both classes share. So a rare word says what its stem says.

A text is compared by length-normalised log-likelihood ratios: of its pairs, of its words, of
its best pair, best word and best passage of three. Labels are used of rows outside the
held-out fold only, and never to score.

Pairs travel in packed rows (each word once, then the words before it) to the part of their word,
where they are summed up and counted; of pairs that say no more than their first word only the counts are
written. Labels travel to the texts, not texts to the labels.

The ratios are a written table. It is broadcast, in slices if it has many rows; a task works out
what some texts look up and takes one slice after the other into memory. Beyond `BROADCAST_ROWS`
the texts are looked at in blocks, each block's distinct words and pairs are joined with the table, and block
and ratios meet again. All ways give the same scores, and nothing is left out of the table for its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, by_key, checked_broadcast, keyed, new_folder, table, written

FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
STEM, PASSAGE, THRESHOLD = 5, 3, 0.3
#: Taken off continuation counts of words and stems, and off counts of pairs.
DISCOUNT, PAIR_DISCOUNT = 2, 1
#: A pair whose ratio differs less from that of its first word (as a logarithm) has the first word's.
LEAST_GAIN = 1.5
#: Rows of the calibration fold that the weights of the score are fitted on; all others are counted.
CALIBRATION_ROWS = 20_000
#: Rows of ratios that are broadcast at most (12 bytes each on a worker's disk), and about those
#: of a slice, of which a worker has one in memory.
BROADCAST_ROWS, SLICE_ROWS = 1 << 26, 1 << 21
#: Times GATHER that a task looks up at once where there are as many slices, or more.
SWEEP = 4
#: Labels that are broadcast packed at most (9 bytes each in a worker).
LABEL_ROWS = 1 << 22
#: Parts that words are dealt to at least; as many as shuffle partitions if those are more.
PARTS = 256
#: Texts of a block, as a power of two, where the ratios are joined.
BLOCK_BITS = 9
#: Pairs or words that a task holds at once.
GATHER = 300_000
FEATURES = ["word", "passage", "words", "pair", "pairs", "length"]
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEM, _WORD_KIND, _BEFORE, _PAIR = range(4)
_PACKED = "part int, words array<bigint>, sizes array<int>, befores array<int>, n0 array<int>, n1 array<int>"
_MERGED = "kind int, before int, word bigint, " + ", ".join(f"x{i} bigint" for i in range(5))


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_key(word: str) -> int:
    """32 bits for the stem above 32 bits for the word, as a signed integer."""
    stem, whole = xxhash.xxh32_intdigest(word[:STEM]), xxhash.xxh32_intdigest(word, 1)
    return ((stem << 32) | whole) - ((stem >> 31) << 64)


class _Keys(dict):
    """Key of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > GATHER:
            self.clear()
        key = self[word] = word_key(word)
        return key

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _before(keys: np.ndarray) -> np.ndarray:
    """32 bits of the word before each; 0 before the first."""
    return np.concatenate([np.zeros(min(1, len(keys)), np.int32), keys[:-1].astype(np.int32)])


def _pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (before.astype(np.int64).view(np.uint64) * _MIX ^ word.view(np.uint64)).view(np.int64)


def _distinct(before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each stands there."""
    _, first, n = np.unique(_pair_key(before, word), return_index=True, return_counts=True)
    return before[first], word[first], n


def _summed(before: np.ndarray, word: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same columns with each pair once, in order of words."""
    _, first, back = np.unique(_pair_key(before, word), return_index=True, return_inverse=True)
    n0, n1 = (np.bincount(back, n, len(first)).astype(np.int64) for n in (n0, n1))
    order = np.lexsort((before[first], word[first]))
    return before[first][order], word[first][order], n0[order], n1[order]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _pairs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """How many texts of each class hold each pair, summed up over some texts: a row for each part of
    words, with its words, how many pairs each ends, and of those the words before and the numbers."""
    known = _Keys()

    def packed(gathered: list) -> Iterator[pa.RecordBatch]:
        if gathered:
            before, word, toxic = (np.concatenate(c) for c in zip(*gathered))
            before, word, n0, n1 = _summed(before, word, toxic == 0, toxic == 1)
            part = (word & 0xFFFFFFFF) % parts
            order = np.argsort(part, kind="stable")
            before, word, n0, n1, part = (c[order] for c in (before, word, n0, n1, part))
            runs, rows = _starts(word), _starts(part)
            first = np.searchsorted(runs, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[rows], pa.int32()), _lists(word[runs], first, pa.int64()),
                 _lists(np.diff(np.append(runs, len(word))), first, pa.int32()),
                 *(_lists(c, rows, pa.int32()) for c in (before, n0, n1))],
                names=["part", "words", "sizes", "befores", "n0", "n1"],
            )

    gathered, size = [], 0
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic")):
            keys = known.of(text.as_py())
            if len(keys):
                b, w, _ = _distinct(_before(keys), keys)
                gathered.append((b, w, np.full(len(b), toxic.as_py(), np.int8)))
                size += len(b)
            if size > 2 * GATHER:
                yield from packed(gathered)
                gathered, size = [], 0
    yield from packed(gathered)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows in order of parts, summed up. By kind: (_WORD_KIND) each word, the different words
    before it in ordinary texts, in toxic ones, in any; (_BEFORE) of words before: texts of each class with its
    pairs here, different pairs of each class, of any; (_PAIR) each pair beyond the discount, texts
    of each class with it, and the different words before its word."""
    held = []  # words before, of several parts

    def rows(kind: int, before: np.ndarray, word: np.ndarray, *numbers: np.ndarray) -> pa.RecordBatch:
        n = len(before)
        numbers = [*numbers, *[np.zeros(n, np.int64)] * (5 - len(numbers))]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(before, pa.int32()), pa.array(word, pa.int64()),
             *(pa.array(x, pa.int64()) for x in numbers)],
            names=["kind", "before", "word", *(f"x{i}" for i in range(5))],
        )

    def ended(some: list) -> Iterator[pa.RecordBatch]:
        if some:
            before, word, n0, n1 = _summed(*(np.concatenate(c) for c in zip(*some)))
            runs = _starts(word)
            kinds = [np.add.reduceat(x, runs, dtype=np.int64) for x in (n0 > 0, n1 > 0, np.ones(len(word), int))]
            yield rows(_WORD_KIND, np.zeros(len(runs), np.int32), word[runs], *kinds)
            any_of = np.repeat(kinds[2], kinds[2])
            often = np.maximum(n0, n1) > PAIR_DISCOUNT
            yield rows(_PAIR, before[often], word[often], n0[often], n1[often], any_of[often])
            held.append(by_before([(before, n0, n1, n0 > 0, n1 > 0, np.ones(len(before), int))]))
            if sum(len(c[0]) for c in held) > 4 * GATHER:
                held[:] = [by_before(held)]
            if len(held[0][0]) > 2 * GATHER:
                yield of_held()

    def by_before(some: list) -> list[np.ndarray]:
        before, *numbers = (np.concatenate(c) for c in zip(*some))
        order = np.argsort(before, kind="stable")
        runs = _starts(before[order])
        return [before[order][runs], *(np.add.reduceat(x[order], runs, dtype=np.int64) for x in numbers)]

    def of_held() -> pa.RecordBatch:
        before, *sums = by_before(held)
        held.clear()
        return rows(_BEFORE, before, np.zeros(len(before), np.int64), *sums)

    some, size, limit, now = [], 0, 4 * GATHER, None
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = _starts(parts)
        for i, end in zip(cuts, [*cuts[1:], len(parts)]):
            if parts[i] != now:
                yield from ended(some)
                some, size, limit, now = [], 0, 4 * GATHER, parts[i]
            words, sizes, befores, n0, n1 = (
                batch.column(c).slice(i, end - i).flatten().to_numpy()
                for c in ("words", "sizes", "befores", "n0", "n1"))
            some.append((befores, np.repeat(words, sizes), n0, n1))
            size += len(befores)
            if size > limit:
                some = [_summed(*(np.concatenate(c) for c in zip(*some)))]
                size = len(some[0][0])
                limit = max(limit, 2 * size)
    yield from ended(some)
    if held:
        yield of_held()


class _Slice:
    """Ratios of stems, words, words before and pairs, as sorted arrays."""

    def __init__(self, entries: pa.Table):
        kind, a, b, ratio = (entries.column(c).to_numpy() for c in ("kind", "a", "b", "ratio"))
        self.sorted = []
        for k in (_STEM, _WORD_KIND, _BEFORE, _PAIR):
            mine = kind == k
            keys = _pair_key(a[mine].astype(np.int32), b[mine]) if k == _PAIR else a[mine]
            order = np.argsort(keys)
            self.sorted.append((keys[order], ratio[mine][order].astype(np.float32)))

    def put(self, kind: int, wanted: np.ndarray, to: np.ndarray) -> np.ndarray:
        """`to`, with the ratios of those of `wanted` that are here."""
        keys, values = self.sorted[kind]
        if not len(keys):
            return to
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at].astype(float), to)


def _not_kept(shared: Broadcast) -> _Slice:
    """A broadcast slice, read anew, where `value` would stay in the worker."""
    path = getattr(shared, "_path", None)
    return shared.load_from_path(path) if path else shared.value


class _Ratios:
    """Log-likelihood ratios of words and pairs, from slices that are looked at one after the other."""

    def __init__(self, slices: list, unknown: float):
        self.slices, self.unknown = slices, unknown

    def _each(self) -> Iterator[_Slice]:
        for s in self.slices:
            yield s if isinstance(s, _Slice) else s.value if len(self.slices) == 1 else _not_kept(s)

    def of(self, keys: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, and of each word after the one before it."""
        kinds, kind_back = np.unique(keys, return_inverse=True)
        stems, stem_back = np.unique(kinds >> 32, return_inverse=True)
        befores, before_back = np.unique(before, return_inverse=True)
        pairs, first, pair_back = np.unique(_pair_key(before, keys), return_index=True, return_inverse=True)
        wanted = [(_STEM, stems, stems), (_WORD_KIND, kinds, kinds), (_BEFORE, befores.astype(np.int64), befores),
                  (_PAIR, pairs, before[first] ^ keys[first])]
        n = len(self.slices)
        own = [slice(None)] * 4
        found = [np.full(len(w[1]), np.nan) for w in wanted]
        for i, one in enumerate(self._each()):
            if n > 1:
                own = [np.flatnonzero(low & (n - 1) == i) for _, _, low in wanted]
            for (kind, sought, _), mine, to in zip(wanted, own, found):
                to[mine] = one.put(kind, sought[mine], to[mine])
        stem, word, follow, pair = found
        stem = np.where(np.isnan(stem), self.unknown, stem)[stem_back]
        words = np.where(np.isnan(word), stem, word)[kind_back]
        follow = np.where(np.isnan(follow), 0.0, follow)[before_back]
        pair = pair[pair_back]
        return words, np.where(np.isnan(pair), follow, pair)

    def features(self, texts: list[np.ndarray]) -> list[tuple]:
        """FEATURES of texts given as keys; those of a text without words are 0."""
        if not any(map(len, texts)):
            return [(0.0,) * len(FEATURES)] * len(texts)
        words, pairs = self.of(np.concatenate(texts), np.concatenate([_before(t) for t in texts]))
        rows, at = [], 0
        for n in map(len, texts):
            w, p, at = words[at:at + n], pairs[at:at + n], at + n
            if not n:
                rows.append((0.0,) * len(FEATURES))
                continue
            size = min(PASSAGE, n)
            sums = np.concatenate([[0.0], np.cumsum(w)])
            best = (sums[size:] - sums[:-size]).max() / size
            rows.append((w.max(), best, w.mean(), p.max(), p.mean(), np.log(n)))
        return rows

    def tables(self, batches: Iterator[pa.Array]) -> Iterator[list[tuple]]:
        """Features of the texts of all batches, some at a time."""
        some, size, known, limit = [], 0, _Keys(), GATHER * min(SWEEP, len(self.slices))
        for texts in batches:
            for text in texts:
                some.append(known.of(text.as_py()))
                size += len(some[-1])
                if size > limit:
                    yield self.features(some)
                    some, size = [], 0
        yield self.features(some)


@dataclass
class Model:
    """``entries``: written (kind, a, b, ratio); ``unknown``: ratio of a word of no known stem."""

    entries: DataFrame
    rows: int
    unknown: float
    weights: list[float] = field(default_factory=list)
    slices: list[Broadcast] = field(default_factory=list)

    def shared(self) -> list[Broadcast]:
        """The entries, broadcast once; one slice is collected at a time."""
        if not self.slices:
            spark, n = self.entries.sparkSession, 1
            while n * SLICE_ROWS < self.rows:
                n *= 2
            one = self.entries
            if n > 1:
                path = new_folder(spark, "slices")
                low = F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(n - 1).cast("long")).cast("int")
                one.withColumn("slice", low).write.partitionBy("slice").parquet(path)
                one = spark.read.schema("kind int, a bigint, b bigint, ratio double, slice int").parquet(path)
            for i in range(n):
                part = one.where(F.col("slice") == i).drop("slice") if n > 1 else one
                self.slices.append(spark.sparkContext.broadcast(_Slice(part.toArrow())))
        return self.slices

    def probability(self, f: str) -> Column:
        """The score for a struct of features; 0 without weights."""
        if not self.weights:
            return F.lit(0.0)
        total = F.lit(self.weights[0])
        for name, weight in zip(FEATURES, self.weights[1:]):
            total = total + F.col(f"{f}.{name}") * weight
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def fit_weights(features: np.ndarray, toxic: np.ndarray, rounds: int = 40, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method on standardised features."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.concatenate([np.ones((len(features), 1)), (features - mean) / spread], axis=1)
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(weights))
        weights += np.linalg.solve(curve, x.T @ (toxic - p) - penalty * weights)
    slopes = weights[1:] / spread
    return np.concatenate([[weights[0] - (slopes * mean).sum()], slopes])


def _struct(rows: list[tuple]) -> pa.StructArray:
    columns = zip(*rows) if rows else [[]] * len(FEATURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names=FEATURES)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block looks up, distinct within a batch."""
    known = _Keys()
    for batch in batches:
        blocks, texts = batch.column("block").to_numpy(), batch.column("text")
        for block in np.unique(blocks):
            keys = [known.of(texts[int(i)].as_py()) for i in np.flatnonzero(blocks == block)]
            before, word = np.concatenate([_before(k) for k in keys]), np.concatenate(keys)
            some = np.unique(word)
            b, w, _ = _distinct(before, word)
            lists = [(_STEM, np.unique(some >> 32), None), (_WORD_KIND, some, None),
                     (_BEFORE, np.unique(before).astype(np.int64), None), (_PAIR, b.astype(np.int64), w)]
            for kind, first, second in lists:
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.full(n, kind, np.int32)), pa.array(first),
                     pa.array(np.zeros(n, np.int64) if second is None else second)],
                    names=["block", "kind", "a", "b"],
                )


def featured(docs: DataFrame, model: Model) -> DataFrame:
    """(row, found): each row of `docs` as a struct, and FEATURES of its text as another."""
    unknown = model.unknown
    kind = "struct<" + ", ".join(f"{name}: double" for name in FEATURES) + ">"
    if model.rows <= BROADCAST_ROWS:
        shared = model.shared()

        @F.arrow_udf(kind)
        def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from map(_struct, _Ratios(shared, unknown).tables(batches))

        return docs.select(F.struct("*").alias("row"), features(F.col("text")).alias("found"))

    placed = written(keyed(docs).select(
        *KEY, "text", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")
    ), "placed")
    wanted = placed.select("block", "text").mapInArrow(_wanted, "block bigint, kind int, a bigint, b bigint")
    ratios = wanted.distinct().join(model.entries, ["kind", "a", "b"])

    def scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        rows = _Ratios([_Slice(found)], unknown).tables([texts.column("text").combine_chunks()])
        columns = _struct([row for some in rows for row in some]).flatten()
        return pa.table([texts.column(c) for c in KEY] + columns, names=KEY + FEATURES)

    fields = ", ".join(f"{name} double" for name in FEATURES)
    found = placed.groupBy("block").cogroup(ratios.groupBy("block")).applyInArrow(
        scored, f"k_id bigint, k_text bigint, {fields}"
    )
    joined = by_key(docs, written(found.dropDuplicates(KEY), "features"), "left")
    return joined.select("row", F.struct(*(F.col(f"found.{name}") for name in FEATURES)).alias("found"))


def _usable(labels: DataFrame) -> DataFrame:
    """Written (doc_id, toxic, counted) of labels outside the held-out fold."""
    own = written(
        labels.select("doc_id", "toxic", fold_of(F.col("doc_id")).alias("fold"))
        .where(f"toxic IN (0, 1) AND fold <> {HELD_OUT}")
        .groupBy("doc_id", "fold").agg(F.max("toxic").cast("int").alias("toxic")), "labels",
    )
    order = F.xxhash64("doc_id")
    last = own.where(F.col("fold") == CALIBRATION).select(order.alias("o")).orderBy("o").limit(
        CALIBRATION_ROWS).agg(F.max("o")).first()[0]
    counted = (F.col("fold") != CALIBRATION) | (order > (-(2**63) if last is None else last))
    return own.select("doc_id", "toxic", counted.alias("counted"))


def _with_texts(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, counted) of the documents with such labels.

    Labels too many to be joined as a broadcast table are broadcast packed, so that no text is moved for
    them; beyond `LABEL_ROWS`, or where ids are no whole numbers, Spark joins them.
    """
    rows, small = docs.select("doc_id", "text"), checked_broadcast(own)
    whole = {d.schema["doc_id"].dataType.typeName() for d in (docs, own)} <= {"long", "integer", "short", "byte"}
    if small is not own or not whole or own.count() > LABEL_ROWS:
        return rows.join(small, "doc_id")
    code = F.col("toxic").cast("byte") + 2 * F.col("counted").cast("byte")
    found = own.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("id"), code.cast("byte").alias("code")).toArrow()
    ids, codes = found["id"].to_numpy(), found["code"].to_numpy()
    order = np.argsort(ids)
    shared = docs.sparkSession.sparkContext.broadcast((ids[order], codes[order]))

    @F.arrow_udf("tinyint")
    def label(wanted: pa.Array) -> pa.Array:
        ids, codes = shared.value
        sought = wanted.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids, sought), len(ids) - 1)
        return pa.array(codes[at], pa.int8(), mask=(ids[at] != sought) | wanted.is_null().to_numpy(zero_copy_only=False))

    known = rows.withColumn("label", label(F.col("doc_id").cast("long"))).where("label IS NOT NULL")
    return known.select(
        "doc_id", "text", (F.col("label") % 2).cast("int").alias("toxic"), (F.col("label") >= 2).alias("counted"))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, counted) of labelled rows outside the held-out fold.

    Not counted are the rows kept for the weights: those of the calibration fold whose ids have
    the least hashes. Labels that contradict each other count as toxic; null labels and null ids
    are left out.
    """
    return _with_texts(docs, _usable(labels))


def _counts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written. Pairs beyond the discount: (before, word, n0, n1, any), texts of each class with the pair and the
    different words before its word. By word the number of different words before it: in ordinary texts, in
    toxic ones, in any. By word before: texts of each class with its pairs, and different pairs of each, of any."""
    parts = max(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = rows.select("text", "toxic").mapInArrow(lambda batches: _pairs(batches, parts), _PACKED)
    found = written(packed.repartition("part").sortWithinPartitions("part").mapInArrow(_merged, _MERGED), "pairs")

    def of(kind: int, *columns: str) -> DataFrame:
        return found.where(F.col("kind") == kind).select(*(F.expr(c) for c in columns))

    befores = of(_BEFORE, "before", "x0", "x1", "x2", "x3", "x4").groupBy("before").agg(*(
        F.sum(f"x{i}").alias(name) for i, name in enumerate(["all0", "all1", "kinds0", "kinds1", "kinds"])))
    return (of(_PAIR, "before", "word", "x0 AS n0", "x1 AS n1", "x2 AS any"),
            written(of(_WORD_KIND, "word", "x0 AS ordinary", "x1 AS toxic", "x2 AS any"), "counts"),
            written(befores, "befores"))


def _pair_entries(often: DataFrame, counts: DataFrame, befores: DataFrame) -> list[DataFrame]:
    """Entries of words before (what unseen or rare pairs after them say) and of repeated pairs."""
    n_pairs = counts.agg(F.coalesce(F.sum("any"), F.lit(0))).first()[0]

    def freed(c: int) -> Column:
        return F.when(F.col(f"all{c}") > 0, PAIR_DISCOUNT * F.col(f"kinds{c}") / F.col(f"all{c}")).otherwise(1.0)

    def over(count: Column, total: Column) -> Column:
        return F.when(total > 0, F.greatest(count - PAIR_DISCOUNT, F.lit(0)) / total).otherwise(0.0)

    all_texts = F.col("all0") + F.col("all1")
    both = (over(F.col("n0") + F.col("n1"), all_texts)
            + PAIR_DISCOUNT * F.col("kinds") / all_texts * (F.col("any") / n_pairs))

    def share(c: int) -> Column:
        return over(F.col(f"n{c}"), F.col(f"all{c}")) + freed(c) * both

    # A pair no class has more often than the discount has just the ratio of its first word.
    known = often.join(checked_broadcast(befores), "before")
    first, own = F.log(freed(1)) - F.log(freed(0)), F.log(share(1)) - F.log(share(0))
    return [
        befores.where(F.greatest("all0", "all1") > 1).select(
            F.lit(_BEFORE).alias("kind"), F.col("before").cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
            first.alias("ratio")),
        known.where(F.abs(own - first) >= LEAST_GAIN).select(
            F.lit(_PAIR).alias("kind"), F.col("before").cast("long").alias("a"), F.col("word").alias("b"),
            own.alias("ratio")),
    ]


def _word_entries(counts: DataFrame) -> tuple[list[DataFrame], float] | None:
    """Entries of stems and words, and the ratio of an unknown stem; None without both classes."""
    stems = written(counts.groupBy(F.shiftright("word", 32).alias("stem")).agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.count("*").alias("kinds")
    ), "stems")

    def totals(df: DataFrame) -> list:
        return list(df.select(
            F.coalesce(F.sum("ordinary"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0)),
            F.count_if(F.col("ordinary") > 0), F.count_if(F.col("toxic") > 0), F.count("*"),
        ).first())

    all0, all1, words0, words1, _ = totals(counts)
    _, _, stems0, stems1, n_stems = totals(stems)
    if not all0 or not all1:
        return None

    def stem_share(name: str, total: int, kinds: int) -> Column:
        shared = (F.col("s_ordinary") + F.col("s_toxic") + 0.5) / (all0 + all1 + 0.5 * (n_stems + 1))
        return (F.greatest(F.col(f"s_{name}") - DISCOUNT, F.lit(0)) + DISCOUNT * kinds * shared) / total

    def word_share(name: str, total: int, kinds: int, n_stem: int) -> Column:
        both = F.col("s_ordinary") + F.col("s_toxic")
        shared = (F.col("ordinary") + F.col("toxic") + 0.5) / (both + 0.5 * (F.col("kinds") + 1))
        return (F.greatest(F.col(name) - DISCOUNT, F.lit(0))
                + DISCOUNT * kinds * stem_share(name, total, n_stem) * shared) / total

    backoff = float(np.log(words1 / all1) - np.log(words0 / all0))
    named = stems.select(
        "stem", "kinds", F.col("ordinary").alias("s_ordinary"), F.col("toxic").alias("s_toxic")
    )
    stem_ratio = F.log(stem_share("toxic", all1, stems1)) - F.log(stem_share("ordinary", all0, stems0)) + backoff
    word_ratio = (F.log(word_share("toxic", all1, words1, stems1))
                  - F.log(word_share("ordinary", all0, words0, stems0)))
    none = F.lit(0).cast("long").alias("b")
    known_stems = named.where(F.greatest("s_ordinary", "s_toxic") > DISCOUNT).select(
        F.lit(_STEM).alias("kind"), F.col("stem").alias("a"), none, stem_ratio.alias("ratio"))
    known_words = counts.where(F.greatest("ordinary", "toxic") > DISCOUNT).join(
        named, F.shiftright("word", 32) == F.col("stem")
    ).select(F.lit(_WORD_KIND).alias("kind"), F.col("word").alias("a"), none, word_ratio.alias("ratio"))
    return [known_stems, known_words], backoff + float(np.log(stems1 / all1) - np.log(stems0 / all0))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Count over all labelled rows but those kept for the weights, then fit the weights on those.

    Without rows of both classes in both, every score is 0. A null or empty text counts nothing;
    repeated rows count each; a text of any length is one text.
    """
    own = _usable(labels)
    often, counts, befores = _counts(_with_texts(docs, own.where("counted")))
    words = _word_entries(counts)
    if words is None:
        empty = docs.sparkSession.createDataFrame([], "kind int, a bigint, b bigint, ratio double")
        return Model(empty, 0, 0.0)
    parts, unknown = words
    entries = written(reduce(DataFrame.unionByName, parts + _pair_entries(often, counts, befores)), "ratios")
    model = Model(entries, entries.count(), unknown)
    sample = featured(_with_texts(docs, own.where("NOT counted")), model).select(
        "row.toxic", "found.*", F.xxhash64("row.doc_id").alias("o1"), F.xxhash64("row.text").alias("o2")
    ).orderBy("o1", "o2").limit(CALIBRATION_ROWS).toArrow()
    toxic = sample["toxic"].to_numpy().astype(float)
    if len(toxic) and 0 < toxic.sum() < len(toxic):
        values = np.stack([sample[name].to_numpy() for name in FEATURES], axis=1)
        model.weights = fit_weights(values, toxic).tolist()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): each row of `docs` as a struct, whatever its columns, and its score, 0 to 1."""
    return featured(docs, model).select("row", model.probability("found").alias("score"))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Add a column with the score, replacing one of this name."""
    return scored(docs, model).select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns if c != name), F.col("score").alias(name)
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below the threshold; all columns are kept, whatever their names.

    A null or empty text is kept unless texts without words are mostly labelled toxic; repeated
    rows go or stay together; an empty table stays empty; without usable labels all stay.
    """
    return scored(docs, train(docs, labels)).where(F.col("score") < threshold).select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score.

    Null and empty texts have ratios of 0 and get the score that gives. A null doc_id is not
    held out and never labelled. Repeated rows get equal scores, and very long texts are scored
    whole. Columns beside doc_id and text are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
