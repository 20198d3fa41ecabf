"""MinHash near-duplicates beside all pairs."""

import random

import numpy as np
import pytest

from driftshelf.llm import common, components, minhash, queries

COLUMNS = "doc_id bigint, text string, sid string, key string, n string, row string, found string"


def words(seed, n):
    r = random.Random(seed)
    return [f"wört{r.randrange(5000)}" for _ in range(n)]


def corpus():
    """Chains of near copies, exact copies, short, empty, null and long texts, repeated rows and ids."""
    r = random.Random(11)
    texts = [None, None, "", " \n\t", "one two", "ONE  two", "one two three", "a b c d e", "A b c d e f", "a b c d e f g"]
    for i in range(25):
        base = words(i, r.choice((6, 12, 40, 150, 150, 400)))
        texts += [" ".join(base)] * 2
        for _ in range(6):
            base = list(base)
            for _ in range(r.choice((1, 1, 2, 6))):
                base[r.randrange(len(base))] = f"new{r.randrange(10**9)}"
            texts.append(" ".join(base))
    texts += [" ".join(words(900, 8000)), " ".join(words(900, 8000) + ["end"])]
    ids = list(range(10, 10 + len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + rows[20:24] + [(None, rows[30][1]), (None, "nobody else has this text at all"), (-3, rows[40][1]), (rows[50][0], rows[60][1])]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)


def roots_of(count, links):
    top = list(range(count))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in links:
        top[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(count)]


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    roots = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if linked(sets[i], sets[j])])
    out = []
    for (doc, _), own, root in zip(rows, sets, roots):
        ids = [d for (d, _), s, r in zip(rows, sets, roots) if r == root and d is not None]
        least = (min(ids) if ids else None) if own else doc
        out.append((doc, len(own), least, doc == least))
    return sorted(map(repr, out))


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, "s", "k", "n", "r", "f") for x in ROWS], COLUMNS)


def test_components_equal_all_pairs(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = minhash.op13_minhash(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(ROWS)


def test_sql_equals_all_pairs(spark, docs, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(repr, con.execute(queries.SQL["op13_minhash"]).fetchall())) == plain(ROWS)


def test_an_empty_table_gives_no_rows(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert minhash.op13_minhash(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("together", [3, 8192])
def test_crowded_keys_lose_no_candidate(spark, together):
    """With 3 sets a part, all keys of near copies are crowded."""
    base = words(1, 200)
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1:]]) for i in range(40)] + [" ".join(words(i, 200)) for i in range(50, 60)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        minhash.F.arrow_udf(minhash._sketches, minhash.SKETCH)(minhash.F.col("text")).alias("s")).select("s.*")
    sets = common.written(rows.withColumn("id", minhash.F.xxhash64("sid")), "sets")
    found = components.components(minhash.candidate_links(sets, together)).groupBy("root").count().collect()
    assert [r["count"] for r in found] == [40]
    crowded = minhash.crowded_keys(sets, together).count()
    assert crowded == 0 if together > 50 else crowded > 20


@pytest.mark.parametrize("together", [2000, minhash.SET_BYTES])
def test_large_groups_are_confirmed_in_linear_rows(spark, together):
    """One candidate group of two chains and near copies: links join what all pairs join, and are few."""
    base, chain = words(1, 100), words(2, 100)
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1:]]) for i in range(40)]
    for i in range(30):
        chain = [*chain[1:], f"y{i}"] if i % 2 else [*chain, f"y{i}"]
        texts.append(" ".join(chain))
    texts += [" ".join(words(i, 60)) for i in range(20, 25)]
    sids = [i.to_bytes(4, "big") for i in range(len(texts))]
    rows = [(7, bytearray(s), bytearray(minhash.shingle_set(t).tobytes())) for s, t in zip(sids, texts)]
    table = common.written(spark.createDataFrame(rows, "key bigint, sid binary, shingles binary"), "compared")
    links = [tuple(int.from_bytes(x, "big") for x in r) for r in minhash.confirmed_links(table, together).collect()]
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if linked(sets[i], sets[j])]
    assert all(linked(sets[i], sets[j]) for i, j in links)
    assert roots_of(len(texts), links) == roots_of(len(texts), pairs)
    assert len(links) < len(texts) * (1 if together > 2000 else 12)


def test_pairs_at_the_limit_share_a_table(spark):
    """Of isolated pairs of similarity 0.85 to 0.86, all but a few in 10,000 are candidates."""
    r, missed, seen = random.Random(3), 0, 0
    for i in range(400):
        a = np.unique(np.array([r.getrandbits(64) for _ in range(200)], dtype=np.uint64))
        b = np.concatenate([a[15:], np.array([r.getrandbits(64) for _ in range(15)], dtype=np.uint64)])
        assert 0.85 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.87
        least = np.stack([minhash.minima(a), minhash.minima(np.unique(b))])
        keys, bits = minhash.partial_keys(least), minhash.agreement_bits(least)
        same = keys[0] == keys[1]
        found = same[:minhash.TABLES].any() and same[minhash.TABLES:].any()
        missed += not (found and minhash.agreeing(bits[:1], bits[1:])[0] >= minhash.AGREE)
        seen += int(np.sum(least[0] == least[1]))
    assert missed <= 1 and abs(seen / 400 / minhash.MINIMA - 0.86) < 0.02
