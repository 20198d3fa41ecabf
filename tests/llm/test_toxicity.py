"""The word-pair models beside a plain version, and what only pairs of words tell."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from driftshelf.llm import toxicity

WORDS = [f"{a}{b}" for a in ("stone", "river", "cloud", "ember", "field") for b in range(12)]


def plain_counts(rows):
    """Texts of each class with each pair."""
    pairs = (Counter(), Counter())
    for text, toxic in rows:
        words = toxicity.words_of(text)
        pairs[toxic].update(set(zip([None] + words[:-1], words)))
    return pairs


def plain_pair_ratio(pairs):
    """Pair -> logarithm of P(word | before, toxic) / P(word | before, ordinary), by the definition."""
    total, kinds = [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for (before, _), n in pairs[c].items():
            total[c][before] += n
            kinds[c][before] += 1
    either = set(pairs[0]) | set(pairs[1])
    follows, after = Counter(w for _, w in either), Counter(b for b, _ in either)

    def ratio(pair):
        before, word = pair
        n = total[0][before] + total[1][before]
        if not n:
            return 0.0
        both = max(pairs[0][pair] + pairs[1][pair] - 1, 0) / n + after[before] / n * follows[word] / len(either)
        shares = []
        for c in (0, 1):
            if total[c][before]:
                own = max(pairs[c][pair] - 1, 0) / total[c][before]
                shares.append(own + kinds[c][before] / total[c][before] * both)
            else:
                shares.append(both)
        if not both:  # an unseen word: what the two have in common cancels out
            shares = [kinds[c][before] / total[c][before] if total[c][before] else 1.0 for c in (0, 1)]
        return math.log(shares[1] / shares[0])

    return ratio


def plain_word_ratio(pairs):
    """Word -> ratio of its discounted continuation counts, smoothed by its stem's and those of both classes."""
    d, stem_of = toxicity.DISCOUNT, lambda w: w[:toxicity.STEM]
    words = [Counter(w for _, w in pairs[c]) for c in (0, 1)]
    stems = [Counter(), Counter()]
    for c in (0, 1):
        for w, n in words[c].items():
            stems[c][stem_of(w)] += n
    members = defaultdict(set)
    for w in set(words[0]) | set(words[1]):
        members[stem_of(w)].add(w)
    total = [sum(words[c].values()) for c in (0, 1)]

    def stem_share(c, s):
        shared = (stems[0][s] + stems[1][s] + 0.5) / (sum(total) + 0.5 * (len(members) + 1))
        return (max(stems[c][s] - d, 0) + d * len(stems[c]) * shared) / total[c]

    def word_share(c, w):
        s = stem_of(w)
        shared = (words[0][w] + words[1][w] + 0.5) / (stems[0][s] + stems[1][s] + 0.5 * (len(members[s]) + 1))
        return (max(words[c][w] - d, 0) + d * len(words[c]) * stem_share(c, s) * shared) / total[c]

    def ratio(w):
        return math.log(word_share(1, w) / word_share(0, w))

    return ratio


def plain_features(text, word_ratio, pair_ratio):
    words = toxicity.words_of(text)
    if not words:
        return (0.0,) * 6
    w = [word_ratio(x) for x in words]
    p = [pair_ratio(x) for x in zip([None] + words[:-1], words)]
    size = min(toxicity.PASSAGE, len(w))
    best = max(sum(w[i:i + size]) / size for i in range(len(w) - size + 1))
    return max(w), best, sum(w) / len(w), max(p), sum(p) / len(p), math.log(len(w))


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(3)
    rows = []
    for i in range(160):
        words = [r.choice(WORDS) for _ in range(r.randint(1, 30))]
        if i % 3 == 0:
            words += ["ember1", "cloud2"] + ["vile"] * (i % 2)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "?!"), (203, " ".join(WORDS * 50)), (None, "ember1 cloud2"),
             (5, "another text of id five"), (5, "another text of id five"), (204, "unheard stonework ember1 unheard")]
    docs = spark.createDataFrame([(*row, "s", "r", "f", 7) for row in rows],
                                 "doc_id bigint, text string, score string, row string, found string, block int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(160)] + [(None, 1), (3, None)],
                                   "doc_id bigint, toxic int")
    return rows, docs, labels


def found(docs, model):
    return sorted(
        (tuple(map(repr, r["row"][:2])), tuple(r["found"])) for r in toxicity.featured(docs, model).collect()
    )


def test_features_equal_a_plain_version_broadcast_or_joined(spark, small, monkeypatch):
    rows, docs, labels = small
    monkeypatch.setattr(toxicity, "LEAST_GAIN", 0.0)
    model = toxicity.train(docs, labels)
    toxic = {i: int(i % 3 == 0) for i in range(160)}
    counted = [(t, toxic[i]) for i, t in rows if i in toxic and zlib.crc32(str(i).encode()) % 4 in (0, 1)]
    pairs = plain_counts(counted)
    known = {w for c in (0, 1) for _, w in pairs[c]}
    assert not {"stonework", "unheard"} & known
    stems = {w[:5] for w in known}
    word_ratio, pair_ratio = plain_word_ratio(pairs), plain_pair_ratio(pairs)
    direct = found(docs, model)
    texts = [(tuple(map(repr, row)), row[1]) for row in rows if row[0] != 204]
    want = sorted((key, plain_features(text, word_ratio, pair_ratio)) for key, text in texts)
    kept = [d for d in direct if d[0][0] != "204"]
    assert [d[0] for d in kept] == [w[0] for w in want]
    seen = {w for w in known if max(sum(x == w for _, x in pairs[c]) for c in (0, 1)) > toxicity.DISCOUNT}
    for (key, got), (_, plain) in zip(kept, want):
        words = set(toxicity.words_of(eval(key[1])))
        at = range(6) if words <= seen else (3, 4, 5)  # rarer words say what their stem says
        assert all(abs(got[i] - plain[i]) < 1e-4 for i in at), key
    assert sum(set(toxicity.words_of(t)) <= seen for _, t in rows) > 100
    assert "stone" in stems
    monkeypatch.setattr(toxicity, "LEAST_GAIN", 1.5)
    fewer = toxicity.train(docs, labels).entries.where("kind = 3")
    everything = model.entries.where("kind = 3")
    assert 0 < fewer.count() < everything.count() and not fewer.exceptAll(everything).count()

    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(toxicity, "BLOCK_BITS", 3)
    assert found(docs, model) == direct
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    again = {repr(r["doc_id"]): r["score"] for r in toxicity.score(docs, model, "s").collect()}
    monkeypatch.undo()
    assert again == {repr(r["doc_id"]): r["score"] for r in toxicity.score(docs, model, "s").collect()}


def test_no_usable_labels_leave_all_documents(spark, small):
    _, docs, labels = small
    assert toxicity.drop_toxic(docs, labels.where("toxic = 0")).count() == docs.count()
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_two_ordinary_words_side_by_side(spark):
    """Toxic texts hold two words side by side that ordinary ones hold apart: no word tells them apart."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["kettle", "red"]
    rows = []
    for i in range(4000):
        words, toxic, at = [r.choice(vocabulary[:300]) for _ in range(60)], int(r.random() < 0.2), r.randrange(50)
        words[at:at + 3] = ["kettle", "red", words[at]] if toxic else ["kettle", words[at], "red"]
        rows.append((i, " ".join(words), toxic))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    scores = {x["doc_id"]: x["score"] for x in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [(scores[i] >= toxicity.THRESHOLD, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(s and t for s, t in held) >= 0.95 * sum(t for _, t in held)
    assert sum(s and not t for s, t in held) <= 0.02 * sum(not t for _, t in held)


def test_all_rows_but_those_of_the_weights_are_counted(spark, small, monkeypatch):
    _, docs, labels = small
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 10)
    counts = {r["counted"]: r["n"] for r in toxicity._labelled(docs.where("doc_id <> 5"), labels).groupBy(
        "counted").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n").collect()}
    outside = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(160) if i != 5)
    assert counts[False] in (9, 10) and counts[True] == outside - counts[False]


def test_slices_of_ratios_give_the_same_features(spark, small, monkeypatch):
    _, docs, labels = small
    monkeypatch.setattr(toxicity, "LEAST_GAIN", 0.0)
    model = toxicity.train(docs, labels)
    whole = found(docs, model)
    assert len(model.slices) == 1
    monkeypatch.setattr(toxicity, "SLICE_ROWS", 40)
    sliced = toxicity.Model(model.entries, model.rows, model.unknown, model.weights)
    assert found(docs, sliced) == whole
    assert len(sliced.slices) >= 4 and all(len(s.value.sorted[3][0]) < model.rows / 2 for s in sliced.slices)


def test_texts_stay_where_they_are_with_many_labels(spark, small, monkeypatch):
    _, docs, labels = small

    def rows():
        return sorted(map(repr, toxicity._labelled(docs, labels).collect()))

    want = rows()
    assert want
    monkeypatch.setattr(toxicity, "checked_broadcast", lambda table, wide=None: table)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in toxicity._labelled(docs, labels)._jdf.queryExecution().executedPlan().toString()
        assert rows() == want
        monkeypatch.setattr(toxicity, "LABEL_ROWS", 3)
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("gather", [40, 300_000])
def test_packed_pairs_are_few_rows_and_add_up(monkeypatch, gather):
    monkeypatch.setattr(toxicity, "GATHER", gather)
    r = random.Random(5)
    rows = [(" ".join(r.choices(WORDS[:20], k=r.randint(0, 30))), i % 2) for i in range(80)] + [("", 1), (None, 0)]
    batches = [
        toxicity.pa.RecordBatch.from_arrays([toxicity.pa.array(c) for c in zip(*rows[i:i + 20])], names=["text", "toxic"])
        for i in range(0, len(rows), 20)
    ]
    packed = [row for b in toxicity._pairs(iter(batches), 4) for row in b.to_pylist()]
    want = plain_counts(rows)
    if gather > 40:
        assert len(packed) == 4 and sum(len(p["words"]) for p in packed) == 20
    packed.sort(key=lambda p: p["part"])
    schema = next(iter(toxicity._pairs(iter(batches), 4))).schema
    merged = [row for b in toxicity._merged(
        toxicity.pa.RecordBatch.from_pylist(packed[i:i + 3], schema) for i in range(0, len(packed), 3)
    ) for row in b.to_pylist()]
    words = {w: toxicity.word_key(w) for w in WORDS}
    before = {None: 0} | {w: int(toxicity.np.array(k).astype(toxicity.np.int32)) for w, k in words.items()}
    either = set(want[0]) | set(want[1])
    any_of = Counter(w for _, w in either)
    got = {(m["before"], m["word"]): (m["x0"], m["x1"], m["x2"]) for m in merged if m["kind"] == toxicity._PAIR}
    assert got == {(before[b], words[w]): (want[0][b, w], want[1][b, w], any_of[w])
                   for b, w in either if max(want[0][b, w], want[1][b, w]) > 1}
    got = {m["word"]: (m["x0"], m["x1"], m["x2"]) for m in merged if m["kind"] == toxicity._WORD_KIND}
    assert got == {words[w]: (sum(x == w for _, x in want[0]), sum(x == w for _, x in want[1]), n)
                   for w, n in any_of.items()}
    sums = defaultdict(lambda: [0] * 5)
    for m in merged:
        if m["kind"] == toxicity._BEFORE:
            sums[m["before"]] = [x + m[f"x{i}"] for i, x in enumerate(sums[m["before"]])]
    assert dict(sums) == {before[b]: [
        *(sum(n for (x, _), n in want[c].items() if x == b) for c in (0, 1)),
        *(sum(x == b for x, _ in want[c]) for c in (0, 1)), sum(x == b for x, _ in either),
    ] for b in {b for b, _ in either}}
