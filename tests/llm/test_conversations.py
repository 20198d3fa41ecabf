"""Prefix trie and structure repair beside plain versions, on odd and random conversations."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from driftshelf.llm import prefix_trie, queries, turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, block string, digest string, gone string"
ODD = [
    (0, 0, "system", "Be brief."), (0, 1, "user", "Hi?"), (0, 2, "assistant", "Hello."), (0, 3, "user", "And"),
    (0, 4, "assistant", "So."), (0, 5, "user", "x"), (1, 0, "user", "Hi?"), (1, 1, "assistant", None), (2, 0, None, "t."),
    (2, None, "user", "null turn first."), (3, 0, "assistant", " \t\n"), (4, 0, "user", "é" * 5000 + "."),
    (5, 7, "user", ""), (5, 9, "", "no role."), (6, 0, "user", "same"), (6, 0, "user", "same"), (6, 0, "user", "other"),
    (None, 0, "user", "lost."), (None, None, None, None), (-7, 0, "user", "Hi?"), (-107, 0, "user", "Hi?"), (-100, 1, "system", "neg."),
    (200, 0, "user", "Hi?"), (201, 0, "Assistant", "no. end\n"), (202, 3, "assistant", "a."), (202, 1, "user", "u!"),
]


def many():
    """Long and short conversations, with many that share an opening, a third of them equal."""
    r = random.Random(9)
    rows = []
    for conv in range(300, 420):
        n = 0 if conv % 50 == 1 else r.choice((1, 2, 3, 5, 9, 40))
        for turn in range(n):
            same = conv % 3 == 0
            text = "one text." if same else r.choice(("Yes.", "No!", "", "cut", "Why?", f"{conv} {turn}."))
            rows.append((conv, turn + (turn > 4), r.choice(("user", "assistant", "system", "user")) if not same
                         else ("user", "assistant")[turn % 2], text))
    return rows


ROWS = ODD + many()


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*x, "p", "b", "d", "g") for x in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, conversations, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    conversations.write.parquet(f"{path}/conversations.parquet")
    return path


def rank(turn):
    return (turn is not None, turn or 0)


def plain_trie(rows):
    def key(role, text):
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()

    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((rank(turn), key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(family, [])[:h] + ts[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for node, inside in members.items():
        below = [v for v in members if v[:len(node)] == node]
        children = [v for v in below if len(v) == len(node) + 1]
        leaves = [v for v in below if not any(w != v and w[:len(v)] == v for w in below)]
        ends = sorted(c for c in inside if len(paths[c]) == len(node))
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children), len(leaves),
            sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(repr, out))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("most", [0, 200, prefix_trie.BLOCK_BYTES])
def test_trie_equals_a_plain_one(spark, conversations, most, monkeypatch):
    """Whatever the blocks: with `most` 0 each path is a block of its own."""
    monkeypatch.setattr(prefix_trie, "IDS_BYTES", 5 if most == 0 else 1 << 14)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(most > 0).lower())
    turns = prefix_trie.rebuilt(prefix_trie.conversation_turns(conversations))
    got = prefix_trie.prefix_trie(turns, most).select(COLUMNS).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(repr(tuple(r)) for r in got) == plain_trie(ROWS)


def test_range_minima_and_both_ends():
    r = np.random.default_rng(1)
    for size in (1, 2, 7, 64, 100):
        values = r.integers(0, 5, size)
        minima = prefix_trie.RangeMinimum(values)
        first, last = np.array(list(itertools.combinations_with_replacement(range(size), 2))).T
        assert (minima(first, last) == [values[a:b + 1].min() for a, b in zip(first, last)]).all()
        start, least = np.arange(size), r.integers(0, 6, size)
        for i, right, left in zip(start, minima.right(start, least), minima.left(start, least)):
            assert all(values[i + 1:right + 1] >= least[i]) and (right == size - 1 or values[right + 1] < least[i])
            assert all(values[left + 1:i + 1] >= least[i]) and (left == 0 or values[left] < least[i])


def test_a_trie_of_no_turns_is_a_root(spark):
    """The only conversation loses its turns: its opening is that of an absent one."""
    conv = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 3)
    df = spark.createDataFrame([(conv, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    row, = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.conversation_turns(df))).select(COLUMNS).collect()
    assert tuple(row) == (conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())


def full_chart(cells):
    """CYK over all spans and all splits."""
    chart = {(i, i + 1): c for i, c in enumerate(cells)}
    for size in range(2, len(cells) + 1):
        for i in range(len(cells) - size + 1):
            chart[i, i + size] = turn_repair.least(
                x for k in range(i + 1, i + size)
                for x in turn_repair.combined(chart[i, k], chart[k, i + size]).items())
    whole = chart[0, len(cells)]
    return min(whole[0, q] for q in turn_repair.FINAL if (0, q) in whole)


def tried(rows):
    """The best of all edits, tried one by one."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            places = [[role] if e == "K" else ["u", "a"] if e == "R" else [] for e, (role, _, _) in zip(edits, rows)]
            if any(bad and e != "D" or e == "K" and not role for e, (role, bad, _) in zip(edits, rows)):
                continue
            cost = sum({"K": 0, "R": 2, "D": 3}[e] + (t and e != "D") for e, (_, _, t) in zip(edits, rows)) + 2 * sum(gaps)
            audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""]))
            if best is not None and (cost, audit) >= best:
                continue
            slots = []
            for g, p in itertools.zip_longest(gaps, places, fillvalue=[]):
                slots += [["u", "a"]] * g + ([p] if p else [])
            if any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*slots)):
                best = (cost, audit)
    return best


def test_cells_equal_the_full_chart_and_all_edits():
    r = random.Random(4)
    for n in [*([1, 2, 3] * 12), 7, 12, 20]:
        rows = [(r.choice(("s", "u", "a", "u", "a", "x", "")), r.random() < 0.2, r.random() < 0.3) for _ in range(n)]
        cells = [turn_repair.row_cell(*x) for x in rows]
        spans = turn_repair.Spans()
        for cell in cells:
            spans.add(cell)
        assert spans.best() == full_chart(cells)
        if n <= 3:
            assert spans.best() == tried(rows)


def plain_repair(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = convs.setdefault(conv, [])
        if damage == 0:
            continue
        role = "user" if damage == 4 else role
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        own += [(turn, role, text)] * (2 if damage == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (rank(x[0]), x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        seen, faults = set(), []
        for _, role, text in own:
            inside = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not inside else "duplicate" if (role, text) in seen
                          else "truncated" if inside[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = 0, ""
        if own:
            cells = [turn_repair.row_cell(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(own, faults)]
            cost, audit = full_chart(cells)
        rows_left, lines = iter(own), []
        for edit in audit:
            _, role, text = next(rows_left) if edit != "I" else (None, None, "")
            if edit != "D":
                lines.append((role if edit == "K" else None, text))
        start = 1 if lines and (lines[0][0] or "").startswith("s") else 0
        done = "\n".join(f"{r if r is not None else ('user', 'assistant')[(i - start) % 2]}:{t}" for i, (r, t) in enumerate(lines))
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            cost, audit, hashlib.sha256(done.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_repair_equals_a_plain_one(spark, folder):
    got = sorted(repr(tuple(r)) for r in turn_repair.op12_turn_repair(spark, folder).collect())
    assert got == plain_repair(ROWS)


def test_repeated_rows_and_a_long_conversation(spark):
    rows = [(1, i % 700, ("user", "assistant", "user")[i % 3], f"t{i % 900}.") for i in range(3000)]
    df = spark.createDataFrame([(*x, False) for x in rows], "conv_id bigint, turn bigint, role string, text string, gone boolean")
    row, = turn_repair.repair_conversations(df).collect()
    assert row["duplicate"] == 3000 - len({(r, t) for _, _, r, t in rows})
    assert row["audit"].replace("I", "").count("D") >= row["duplicate"] and len(row["audit"].replace("I", "")) == 3000


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_turn_repair"])
def test_equals_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    theirs = con.execute(queries.SQL[name])
    names = [d[0] for d in theirs.description]
    ours = queries.QUERIES[name](spark, folder).select(names).collect()
    assert sorted(repr(tuple(r)) for r in ours) == sorted(map(repr, theirs.fetchall()))


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_turn_repair"])
def test_empty_tables_give_no_rows(spark, folder, name, tmp_path):
    spark.read.parquet(f"{folder}/conversations.parquet").limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
