"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from driftshelf.llm import (
    common, components, decontaminate, line_dedup, pieces, quality, queries, sharding, simhash, substring,
    token_counts, toxicity, warc,
)

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, shard string, n_words string, quality string, pieces string, score string"
WORDS = [f"wörd{i}" if i % 7 == 0 else f"word{i}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = "\n".join(prose(100 + i, 40) for i in range(120))
BENCH = [(1, prose(1, 30)), (2, "Short item, three"), (3, None), (4, "--"), (None, prose(2, 12)), (5, prose(1, 30))]
TEXTS = [
    (1, prose(10, 60)), (2, prose(10, 60)), (2, prose(10, 60)), (3, prose(10, 59) + " changed"), (4, None), (5, ""),
    (6, " \n\t "), (None, prose(11, 50)), (None, None), (7, LONG), (8, prose(12, 20) + " " + BENCH[0][1] + " end"),
    (9, "so a SHORT item three follows"), (10, "a line of the text that comes again and again\n" * 3),
    (11, "a line of the text that comes again and agaim\nother"), (12, "idiot " + prose(13, 30)), (12, "other text"),
    (13, "<|endoftext|> and more"), (-5, prose(14, 13)), (14, "x" * 40), (15, "x" * 41),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "w", "q", "p", "c") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 3 > 0), int(i == 12)) for i in range(1, 14)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(3, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (None, None, None), (9, "a b", ""),
             (8, "u", ""), (7, "u", "z" * 300_000)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


CORPUS = sorted(set(queries.QUERIES) - {"op11_prefix_trie", "op12_turn_repair", "op13_minhash"})


@pytest.mark.parametrize("name", CORPUS)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(CORPUS) - {"op2_warc"}))
def test_every_row_has_a_result(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", sorted(set(queries.SQL) & set(CORPUS)))
def test_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        rows = f"SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')"
        if name != "op1_sharding" and table == "documents":  # SQL there tells rows apart by id
            rows += " WHERE doc_id NOT IN (2, 12) AND doc_id IS NOT NULL"
        if table == "benchmark":
            rows += " WHERE item_id IS NOT NULL"
        if table == "pages":
            rows += " WHERE page_id <> 1"
        con.execute(f"CREATE VIEW {table} AS {rows}")
    theirs = con.execute(queries.SQL[name]).fetchall()
    names = [d[0] for d in con.description]
    ours = queries.QUERIES[name](spark, folder)
    if name == "op10_decontamination":
        ours = ours.where("doc_id NOT IN (2, 12) AND doc_id IS NOT NULL")
        # the item without an id is found in the document without one only
    if name == "op2_warc":
        ours = ours.where("page_id <> 1 AND page_id NOT IN (3)")
        theirs = [r for r in theirs if r[0] is not None and r[0] != 3]
    assert sorted(map(repr, (tuple(r) for r in ours.select(names).collect()))) == sorted(map(repr, theirs))


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    keys = [0, 1, -1, 2**62, -(2**63), 12345678901234567, *random.Random(1).sample(range(10**12), 200)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 24, 1000):
        got = {r[0]: r[1] for r in df.select("k", sharding.jump_shard(df["k"], n, first_rounds=5)).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_slots_have_no_gaps_and_growth_moves_into_the_new_shard(spark, folder):
    rows = sharding.op1_sharding(spark, folder).collect()
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)


def test_archive_round_trip_and_lookup(spark, folder, tmp_path):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, frame=50, bundle=2000)
    rows = {r["page_id"]: r for r in warc.read_records(spark, path).collect()}
    assert rows[3]["record_type"] == "revisit" and rows[3]["refers_to"] == 1 and rows[3]["payload_bytes"] == 9
    assert rows[1]["payload"].decode() == "<p>é</p>" and rows[7]["payload_bytes"] == 300_000
    assert rows[9]["refers_to"] == 8 and rows[None]["refers_to"] == 8 and rows[8]["record_type"] == "response"
    assert warc.read_records(spark, path).count() == pages.count()
    found = warc.read_records(spark, path, spark.createDataFrame([(7,), (1,)], "page_id bigint")).collect()
    assert sorted(r["page_id"] for r in found) == [1, 1, 7]
    broken = bytearray(next(iter(warc.bundles(spark, path).collect()))["content"])
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        warc.SeekableReader(bytes(broken))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normaliser_equals_the_library(rule):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(pieces._fields(library.serialized_model_proto()))[pieces.NORMALIZER_FIELD]
    own = pieces.Normalizer(spec)
    for text in ("", " ", "ﬁne  ①② x", "Ａｂｃ　ｶﾞ", "  Ünï ", "a\tb\nc", "é ½", prose(3, 40)):
        normal, source = own(text)
        assert normal == library.normalize(text), text
        assert len(source) == len(normal.encode()) + 1 and (np.diff(source) >= 0).all()


def test_pieces_equal_the_library(spark, folder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(pieces.MODEL))
    want = []
    for i, t in TEXTS:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(sp.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    got = [tuple(r) for r in pieces.op3_sentencepiece(spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_spans_are_the_library_s(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(pieces.MODEL))
    text = "Über 漢字 and  two 😀 spaces"
    proto = sp.encode(text, return_type="proto")
    (ids, begins, ends), = pieces.encoder(P.path(pieces.MODEL)).encode([text])
    assert [p.begin for p in proto.pieces] == begins[1:-1].tolist()
    assert [p.end for p in proto.pieces] == ends[1:-1].tolist()


def test_quality_counts_equal_a_plain_version(spark, folder):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.op4_quality_rules(spark, folder).collect()}
    for i, t in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
        covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        row = got[(i, len(words))]
        assert (row["word_chars"], row["n_dup_lines"], row["n_repeat_words"]) == (
            sum(map(len, words)), len(lines) - len(set(lines)), len(covered))
        assert row["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (row["base_failed"] and row["kept"])


def test_viterbi_finds_the_best_of_all_labellings():
    from itertools import product

    r = np.random.default_rng(0)
    for _ in range(50):
        field = quality.Field(r.normal(size=3), r.normal(size=(2, 2)))
        lines = [[int(f) for f in np.flatnonzero(r.random(3) < 0.5)] for _ in range(6)]

        def value(labels):
            return sum(sum(field.weights[f] for f in x) for x, y in zip(lines, labels) if y) + sum(
                field.step[a][b] for a, b in zip(labels, labels[1:]))

        best = max(product((0, 1), repeat=6), key=value)
        assert abs(value(field.viterbi(lines)) - value(best)) < 1e-9
    assert quality.Field(np.zeros(3), np.zeros((2, 2))).viterbi([]) == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, text, n):
    text = list(text)
    for _ in range(n):
        at = r.randrange(len(text) + 1)
        kind = r.randrange(3)
        if kind == 0:
            text.insert(at, r.choice("abc"))
        elif text:
            at = min(at, len(text) - 1)
            text[at:at + 1] = [] if kind == 1 else [r.choice("abc")]
    return "".join(text)


def test_close_lines_meet_and_are_verified():
    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randrange(12)))
        b = changed(r, a, r.randrange(4))
        for edits in (0, 1, 2, 3):
            close = distance(a, b) <= edits
            assert line_dedup.within(a, b, edits) == close
            if close and a != b and min(len(a), len(b)) > edits:
                x, y = (set(line_dedup.probes(t, edits)) for t in (a, b))
                assert {h for h, own in x if own} & {h for h, _ in y} or {h for h, _ in x} & {h for h, own in y if own}


@pytest.mark.parametrize("together", [2, 64])
def test_line_classes_equal_all_pairs(spark, together):
    r = random.Random(9)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(40)) for _ in range(30)]
    lines += [changed(r, x, r.randrange(1, 4)) for x in lines] + [f"{'same start of a line, number':40}{i:02d}" for i in range(40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string")
    links = line_dedup.line_links(df, together=together)
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    parent = {x: x for x in lines}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(lines):
        for y in lines[:i]:
            if distance(x, y) <= 2:
                parent[top(x)] = top(y)
    digest = {x: hashlib.md5(x.encode()).digest() for x in lines}
    for x in lines:
        for y in lines:
            same = roots.get(digest[x], digest[x]) == roots.get(digest[y], digest[y])
            assert same == (top(x) == top(y))


def test_first_line_of_a_class_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"]: r["dedup"] for r in line_dedup.drop_repeated_lines(docs).select("row.doc_id", "dedup").where("doc_id IN (4, 10, 11)").collect()}
    assert kept[10]["kept"] == "a line of the text that comes again and again\n" and kept[10]["n_removed"] == 2
    assert kept[11]["kept"] == "other" and kept[4]["kept"] is None


def test_equal_short_lines_go_and_close_ones_stay(spark):
    shorts = ["Read more", "x", "y" * 31]
    texts = ["\n".join([f"own line {i}", *shorts, "", f"Read mor{i % 10}"]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["dedup"] for r in line_dedup.drop_repeated_lines(df).select("row.doc_id", "dedup").collect()}
    assert got[0]["kept"] == texts[0] and got[0]["n_removed"] == 0
    for i in range(1, 40):
        assert got[i]["kept"].split("\n") == [f"own line {i}", ""] + ([f"Read mor{i}"] if i < 10 else [])


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_components_equal_all_pairs(spark, folder):
    rows = simhash.op6_simhash(spark, folder).collect()
    prints = {plain_fingerprint(t) for _, t in TEXTS}
    assert {int(r["fingerprint"], 16) for r in rows} == prints
    for r in rows:
        group, more = {int(r["fingerprint"], 16)}, True
        while more:
            found = {p for p in prints if any((p ^ g).bit_count() <= 3 for g in group)}
            more, group = found != group, found
        ids = [i for i, t in TEXTS if i is not None and plain_fingerprint(t) in group]
        assert r["component_id"] == (min(ids) if ids else None)


@pytest.mark.parametrize("together", [4, 2048])
def test_crowded_blocks_lose_no_link(spark, together):
    r = random.Random(3)
    base = r.getrandbits(63)
    prints = list({base ^ sum(1 << b for b in r.sample(range(63), r.randrange(5))) for _ in range(120)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    roots = {x["node"]: x["root"] for x in components.components(simhash.close_links(df, together=together)).collect()}
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                parent[top(p)] = top(q)
    assert len({roots.get(p, p) for p in prints}) == len({top(p) for p in prints})


def test_one_document_of_each_group_stays(spark, docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = common.written(docs.select("doc_id", simhash.fingerprints().alias("fingerprint")), "prints")
    assert kept.count() == simhash.classes(prints).select("root").distinct().count()
    assert {r["doc_id"] for r in kept.where("doc_id < 8").collect()} == {-5, 1, 3, 4, 7}  # 3 differs from 1 in more than 3 bits


@pytest.mark.parametrize("hot, bits", [(2, 20), (1000, 28), (2, 6)])
def test_cut_words_equal_a_plain_version(spark, folder, monkeypatch, hot, bits):
    """With rare and hot windows, and with a sketch so small that nearly all windows pass it."""
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "LEAST_BITS", bits)
    monkeypatch.setattr(substring, "MOST_BITS", bits)
    monkeypatch.setattr(substring, "BLOCK_BITS", min(20, bits))
    first = {}
    rank = lambda i: common.NO_ID if i is None else i
    for i, t in sorted(TEXTS, key=lambda x: rank(x[0])):
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), rank(i))
    want = []
    for i, t in TEXTS:
        w = (t or "").encode().split()
        gone = {k + d for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < rank(i) for d in range(13)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    got = [tuple(r) for r in substring.op7_substring_dedup(spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_toxic_words_are_learnt_and_found_in_held_out_rows(spark, tmp_path):
    rows = [(i, prose(i, 40) + (" vile nasty" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scored[i] >= 0.3) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert 0 <= scored[1000] == scored[1001] < 0.3
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    flipped = labels.withColumn("toxic", labels["toxic"] + (toxicity.fold_of(labels["doc_id"]) == 2).cast("int") * 5)
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, flipped)).collect()}
    assert all(abs(again[i] - scored[i]) < 1e-9 for i in scored)


def test_spliced_counts_equal_whole_ones():
    tok = token_counts.tokenizer(P.path(token_counts.TOKENIZER))

    def offsets(part):
        return tok.encode(part, add_special_tokens=False).offsets

    r = random.Random(2)
    texts = [t for _, t in TEXTS if t] + ["".join(r.choice(" \n\tab1.é漢😀'\x1c\u00a0-_,<|") for _ in range(500)) for _ in range(20)]
    for text in [*texts, "x" * 300, " " * 300, "don't <|endoftext|> " * 30]:
        want = len(tok.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((20, 3), (64, 16), (1000, 10)):
            assert token_counts.spliced_count(offsets, text, chunk, overlap) == want


@pytest.mark.parametrize("text", [
    "\n".join(f"line{i}" for i in range(40_000)), "key=value&x=1," * 20_000, "x" * 200_000, "漢字かな" * 40_000,
])
def test_long_texts_without_spaces_are_encoded_a_few_times_at_most(text):
    tok, seen = token_counts.tokenizer(P.path(token_counts.TOKENIZER)), []

    def offsets(part):
        seen.append(len(part))
        return tok.encode(part, add_special_tokens=False).offsets

    want = len(tok.encode(text, add_special_tokens=False).ids)
    assert token_counts.spliced_count(offsets, text, 1 << 13) == want
    assert sum(seen) <= 8 * len(text)
    if text[0] in "lk":
        assert sum(seen) <= 1.5 * len(text)


def test_counts_use_splicing_for_long_texts(spark, docs):
    path = P.path(token_counts.TOKENIZER)
    whole = [r[:] for r in token_counts.count_tokens(docs, path).select("doc_id", "n_tokens").collect()]
    parts = [r[:] for r in token_counts.count_tokens(docs, path, chunk=50, overlap=8).select("doc_id", "n_tokens").collect()]
    assert whole == parts


CLASHING = ["row", "found", "row_id", "row_text", "k_id", "k_text", "dedup", "score", "features", "__score", "__lines", "__n",
            "lines", "kept", "n", "fingerprint", "root", "hits", "pieces", "ids", "Pieces 2", "a.b"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_of_any_name(spark, docs, folder, name, stage):
    """All columns come through as they were, whatever a stage calls its own."""
    own = docs.select("doc_id", "text", *(common.F.concat(common.F.lit(f"{c}: "), "shard").alias(c) for c in CLASHING))
    out = stage(spark, own, folder)
    assert out.columns[:len(own.columns)] == own.columns
    assert len(out.columns) == len(own.columns) + (name == "encoding")
    rows = out.collect()
    assert rows and all(r[i + 2] == f"{c}: s" for r in rows for i, c in enumerate(CLASHING))


def test_pipeline_on_odd_rows_and_on_nothing(spark, folder, empty):
    out = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert 1 in ids and not ids & {2, 8, 9} and out.columns[:2] == ["doc_id", "text"]
    assert corpus_pipeline.run(spark, empty).count() == 0
