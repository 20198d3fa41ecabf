"""Conversation structure repair: weighted CYK over spans of turns.

What a repaired conversation may look like, `(s?(ua)+)?` over the initials of its roles, has
four states: nothing yet, after s, after u, after a. The repair grammar in Chomsky normal form
has a nonterminal for each pair of them, "these rows lead from p to q": a pair derives a row by
one edit, or two pairs that meet in a state, one after the other. A cell holds, for each
nonterminal, the least (cost, audit) over its span; cells of single rows are closed under
insertions on both sides. Spans are combined bottom-up by length.

Any split of a span derives the same edits, as the nonterminals say where each half begins and
ends; so one split a span is enough, and spans of 1, 2, 4, ... rows suffice: time and memory
grow with the length of a conversation, not with its third power. The least audit of a whole
is made of least audits: equally cheap edits of the same rows differ at some letter, none is
the start of another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CRC_SQL, crc_sql, table

#: Steps of the grammar by role initial, its start and its final states.
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
START, FINAL, STATES = 0, (0, 3), 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: ASCII white space, and what ends a whole turn.
BLANKS, ENDINGS = " \t\n\v\f\r", ".!?"
DAMAGES = 20

#: Least (cost, audit) of each pair of states that a span can lead from and to.
Cell = dict[tuple[int, int], tuple[int, str]]


def least(options: Iterable[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    cell: Cell = {}
    for pair, found in options:
        if pair not in cell or found < cell[pair]:
            cell[pair] = found
    return cell


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side: all binary rules."""
    return least(((p, q), (a + c, b + d)) for (p, r), (a, b) in left.items()
                 for (s, q), (c, d) in right.items() if r == s)


def _closure() -> Cell:
    """What insertions alone lead to."""
    cell = {(p, p): (0, "") for p in range(STATES)}
    single = least([*cell.items(), *((step, (INSERT, "I")) for role in "ua" for step in STEPS[role])])
    while (wider := combined(cell, single)) != cell:
        cell = wider
    return cell


INSERTED = _closure()


@lru_cache(maxsize=64)
def row_cell(initial: str, unwanted: bool, truncated: bool) -> Cell:
    """The cell of a row, closed under insertions. A row without a role has no initial to keep."""
    options = [((p, p), (DELETE, "D")) for p in range(STATES)]
    if not unwanted:
        more = TRUNCATED if truncated else 0
        options += [(step, (KEEP + more, "K")) for step in STEPS.get(initial, ())]
        options += [(step, (REROLE + more, "R")) for role in "ua" for step in STEPS[role]]
    return combined(combined(INSERTED, least(options)), INSERTED)


class Spans:
    """Cells of spans of 1, 2, 4, ... rows; equal neighbours are combined as they arise."""

    def __init__(self) -> None:
        self.cells: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        rows = 1
        while self.cells and self.cells[-1][0] == rows:
            cell, rows = combined(self.cells.pop()[1], cell), 2 * rows
        self.cells.append((rows, cell))

    def best(self) -> tuple[int, str]:
        """The cheapest edits of all rows, the ASCII-least ones among them; none if there is no row."""
        if not self.cells:
            return 0, ""
        whole = self.cells[-1][1]
        for _, cell in reversed(self.cells[:-1]):
            whole = combined(cell, whole)
        return min(whole[START, q] for q in FINAL if (START, q) in whole)


class Repair:
    """Applies an audit to rows as they come and hashes the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.lines, self.begin = audit, 0, 0, 0
        self.sha = hashlib.sha256()

    def _line(self, role: str | None, text: str, initial: str = "") -> None:
        if self.lines == 0 and initial == "s":
            self.begin = 1  # users stand at odd places after it
        role = role if role is not None else ("user", "assistant")[(self.lines - self.begin) % 2]
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def _insertions(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._line(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insertions()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            self._line(role if edit == "K" else None, text, role[:1] if edit == "K" else "")

    def digest(self) -> str:
        self._insertions()
        return self.sha.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): every row after its damage; dropped rows stay, marked as gone."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    damage = F.crc32(name.cast("binary")) % DAMAGES
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(damage == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(damage == 1, F.lit("")).when(damage == 2, F.translate(text, ENDINGS, "")).otherwise(text).alias("text"),
        (damage == 0).alias("gone"),
        F.explode(F.when(damage == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def ordered_rows(rows: DataFrame) -> DataFrame:
    """With `digest`, a hash of role and text that orders rows of one turn number and role."""
    return rows.withColumn("digest", F.md5(F.concat(
        F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


ORDER = ["turn", "role", "digest"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
VERDICT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])
REPAIRED = VERDICT.append(pa.field("repaired_sha256", pa.string()))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults and cheapest edits of conversations whose rows come in order, without their texts."""
    own, state = None, None

    def close() -> dict:
        turns = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
        cost, audit = state["spans"].best()
        return {"conv_id": own[0], "gaps": turns, **{c: state[c] for c in COUNTS[1:5]}, "cost": cost, "audit": audit}

    for rows in batches:
        out = []
        columns = (rows[c].to_pylist() for c in ("conv_id", "turn", "initial", "gone", "blank", "repeat", "truncated"))
        for conv, turn, initial, gone, blank, repeat, truncated in zip(*columns):
            if own != (conv,):
                if own:
                    out.append(close())
                own = (conv,)
                state = {"spans": Spans(), "turns": 0, "low": None, "high": None, "last": None} | dict.fromkeys(COUNTS, 0)
            if gone:
                continue
            if turn is not None and turn != state["high"]:
                state["turns"] += 1
                state["low"], state["high"] = turn if state["low"] is None else state["low"], turn
            fault = "blank" if blank else "duplicate" if repeat else "truncated" if truncated else None
            if fault:
                state[fault] += 1
            if state["last"] is not None and state["last"] + initial not in LEGAL:
                state["illegal"] += 1
            state["last"] = initial
            state["spans"].add(row_cell(initial, blank or repeat, truncated))
        if out:
            yield _batch(out, VERDICT)
    if own:
        yield _batch([close()], VERDICT)


def verdicts(rows: DataFrame) -> DataFrame:
    """One row of counts, cost and audit for each conversation of `ordered_rows`.

    Only initials and flags reach the parser. Equal rows are numbered by (conversation, hash),
    so a long conversation is spread there; its edits are then found in one streaming pass.
    """
    trimmed = F.expr(r"rtrim(' \t\n\u000B\f\r', text)")
    earlier = Window.partitionBy("conv_id", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())
    narrow = rows.select(
        "conv_id", "turn", "role", "digest", "gone", F.substring("role", 1, 1).alias("initial"),
        (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(*ENDINGS)).alias("truncated"),
    ).withColumn("repeat", F.row_number().over(earlier) > 1)
    return (
        narrow.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "repeat")
        .select("conv_id", "turn", "initial", "gone", "blank", "repeat", "truncated")
        .mapInArrow(_parse, _ddl(VERDICT))
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's verdict, followed by its rows in order: a text is held for one row only."""
    verdict, repair = None, None

    def close() -> dict:
        return verdict | {"repaired_sha256": repair.digest()}

    for rows in batches:
        out = []
        names = rows.schema.names
        for values in zip(*(rows[c].to_pylist() for c in names)):
            row = dict(zip(names, values))
            if row["place"] == 0:
                if verdict:
                    out.append(close())
                verdict, repair = {f.name: row[f.name] for f in VERDICT}, Repair(row["audit"])
            else:
                repair.row(row["role"], row["text"])
        if out:
            yield _batch(out, REPAIRED)
    if verdict:
        yield _batch([close()], REPAIRED)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and hash of the repaired form of each conversation of (conv_id, turn, role, text, gone).

    The hash is of one text, so the lines of one conversation pass one task, one after the other.
    """
    rows = ordered_rows(rows)
    found = verdicts(rows).withColumn("place", F.lit(0))
    texts = rows.where("NOT gone").select("conv_id", *ORDER, "text", F.lit(1).alias("place"))
    return (
        found.unionByName(texts, allowMissingColumns=True)
        .repartition("conv_id").sortWithinPartitions("conv_id", "place", *ORDER)
        .mapInArrow(_apply, _ddl(REPAIRED))
    )


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults, cheapest repair and repaired form, after the contract's damage.

    Null role or text is one space; null turns come first and count in no gap; rows without a
    conv_id are a conversation of their own, with a null id. Rows of one turn number are
    ordered by role and a hash of role and text, so copies stand together. A row with an empty
    role can't be kept, as it has no initial. Repeated rows are duplicates. Long texts are held
    one at a time. An empty table gives no rows. Other columns are never read.
    """
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def _more(value: str, cost: str, letters: str) -> str:
    return f"(lpad((({value})[1:9]::INT + {cost})::VARCHAR, 9, '0') || ({value})[10:] || '{letters}')"


_BEFORE_U = "least(s0, s1, s3)"
#: Walks the rows of each conversation in order, with the least (cost, audit) of each state as one text.
SQL = rf"""
WITH RECURSIVE {CRC_SQL},
named AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS g, conv_id::BIGINT AS conv_id, turn::BIGINT AS turn,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
harmed AS (SELECT named.*, ({crc_sql('name')} % {DAMAGES})::INT AS damage FROM named, lookup),
damaged AS (
  SELECT g, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy
  FROM harmed WHERE damage <> 0),
hashed AS (SELECT *, row_number() OVER () AS r, md5(length(role) || ':' || role || text) AS k, role[1:1] AS initial,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS unended FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, k, r) AS i,
    row_number() OVER (PARTITION BY g, k ORDER BY turn NULLS FIRST, r) > 1 AS repeated FROM hashed),
faults AS (SELECT *, NOT blank AND NOT repeated AS ok, unended::INT AS t,
    lag(initial) OVER (PARTITION BY g ORDER BY i) || initial NOT IN {LEGAL} AS illegal FROM numbered),
counted AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
    sum((NOT blank AND repeated)::INT) AS duplicate, sum((ok AND unended)::INT) AS truncated,
    sum(coalesce(illegal, false)::INT) AS illegal, max(i) AS n FROM faults GROUP BY g),
walk AS (
  SELECT DISTINCT g, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, '000000002I' AS s2, '000000004II' AS s3 FROM named
  UNION ALL
  SELECT g, i, n0, n1, least(n2, {_more('least(n0, n1, n3)', '2', 'I')}),
    least(n3, {_more('n2', '2', 'I')}, {_more('least(n0, n1)', '4', 'II')})
  FROM (SELECT f.g, f.i, {_more('s0', '3', 'D')} AS n0,
      least({_more('s1', '3', 'D')}, CASE WHEN ok AND initial = 's' THEN {_more('s0', 't', 'K')} END) AS n1,
      least({_more('s2', '3', 'D')}, CASE WHEN ok AND initial = 'u' THEN {_more(_BEFORE_U, 't', 'K')} END,
        CASE WHEN ok THEN {_more(_BEFORE_U, '(2 + t)', 'R')} END) AS n2,
      least({_more('s3', '3', 'D')}, CASE WHEN ok AND initial = 'a' THEN {_more('s2', 't', 'K')} END,
        CASE WHEN ok THEN {_more('s2', '(2 + t)', 'R')} END) AS n3
    FROM walk w JOIN faults f ON f.g = w.g AND f.i = w.i + 1)),
found AS (SELECT w.g, CASE WHEN w.i = 0 THEN '000000000' ELSE least(s0, s3) END AS best
  FROM walk w LEFT JOIN counted c ON c.g = w.g WHERE w.i = coalesce(c.n, 0)),
letters AS (SELECT g, p, best[9 + p:9 + p] AS letter FROM found, LATERAL (SELECT unnest(range(1, length(best) - 8)) AS p)),
placed AS (SELECT *, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w - 1 AS o
  FROM letters WINDOW w AS (PARTITION BY g ORDER BY p)),
joined AS (SELECT p.g, p.p, p.o, p.letter, f.role, f.text, f.initial FROM placed p
  LEFT JOIN faults f ON p.letter <> 'I' AND f.g = p.g AND f.i = p.i WHERE p.letter <> 'D'),
begun AS (SELECT g, bool_or(o = 0 AND letter = 'K' AND initial = 's')::INT AS b FROM joined GROUP BY g),
lines AS (SELECT j.g, p, CASE WHEN letter = 'K' THEN role WHEN (o - b) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, '') AS line FROM joined j JOIN begun USING (g)),
whole AS (SELECT g, string_agg(line, chr(10) ORDER BY p) AS text FROM lines GROUP BY g)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best[1:9]::BIGINT AS cost, best[10:] AS audit,
  sha256(coalesce(w.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM named) d JOIN found USING (g) LEFT JOIN counted USING (g) LEFT JOIN whole w USING (g)
"""
