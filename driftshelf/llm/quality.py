"""Quality by line labels: a linear-chain conditional random field marks content and boilerplate.

Each line has a few yes/no features; the field weighs them and how labels follow each other,
and Viterbi decoding finds the likeliest labels of all lines of a text together. A text is
kept if lines marked content hold at least half of its characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the contract.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"
LEAST_WORDS, REPEAT_WINDOW, REPEAT_SHARE = 20, 8, 30
#: Content must hold this share of the characters in lines.
CONTENT_SHARE = 0.5
#: What a good text holds at least and a poor one at most while the field is fitted, and the strongest
#: pull on a line of average size that may bring it about.
GOOD_SHARE, POOR_SHARE, MOST_PULL = 0.75, 0.25, 20.0
#: The field is fitted on at most this many labelled texts, of each a run of at most this many lines.
TRAINING_TEXTS, TRAINING_LINES = 2000, 64
FEATURES = (
    "always", "some symbols", "symbols", "many symbols", "capitals", "all capitals", "exclaims", "bars",
    "sentence end", "short", "long", "digits", "seen before", "few different words", "notice", "odd words", "first",
)
#: Weights to begin with: what speaks for content and for boilerplate whatever a text's label.
STARTS = {
    "always": 1.0, "sentence end": 0.5, "some symbols": -0.5, "symbols": -0.5, "many symbols": -1.0, "all capitals": -1.0,
    "exclaims": -1.0, "bars": -1.0, "digits": -1.0, "seen before": -1.0, "few different words": -0.5, "notice": -3.0,
}
_NOTICE = re.compile(r"licen[sc]ed?|copyright|cookie|subscribe|all rights|privacy policy|terms of|click here", re.I)


def line_features(lines: list[str]) -> list[list[int]]:
    """Numbers of the features that each line with a word has."""
    seen: set[str] = set()
    out = []
    for line in lines:
        words = line.split()
        n, size = len(words) or 1, len(line) or 1
        symbols = sum(map(line.count, SYMBOLS)) / size
        capitals = sum(map(str.isupper, words)) / n
        bars = line.count("|") / n
        tests = (
            True, symbols > 0, symbols > 0.02, symbols > 0.1, capitals > 0.3, capitals > 0.7,
            line.count("!") / n > 0.3, bars > 0.2, line.rstrip().endswith((".", "!", "?", '"', "”")),
            n < 5, n > 20, len(re.findall(r"\d", line)) / size > 0.2, line in seen,
            len(set(words)) / n < 0.5 and n > 5, bool(_NOTICE.search(line)), not 2 <= size / n <= 14, not out,
        )
        seen.add(line)
        out.append([i for i, t in enumerate(tests) if t])
    return out


class Field:
    """Weights of content over boilerplate: per feature, per pair of neighbours, at the start.

    Label 1 is content. `step[i][j]` weighs label j after label i.
    """

    def __init__(self, weights: np.ndarray, step: np.ndarray):
        self.weights, self.step = weights.tolist(), step.tolist()

    def viterbi(self, features: list[list[int]]) -> list[int]:
        """The likeliest labels; of two equally likely ones boilerplate."""
        weights, ((s00, s01), (s10, s11)) = self.weights, self.step
        back, a, b = [], 0.0, 0.0
        for i, own in enumerate(features):
            gain = sum([weights[f] for f in own])
            if i:
                from_a, from_b = a + s01, b + s11
                stay, other = a + s00, b + s10
                back.append((int(other > stay), int(from_b > from_a)))
                a, b = max(stay, other), max(from_a, from_b)
            b += gain
        label = int(b > a)
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1] if features else []


def marginals(gain: np.ndarray, step: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of content per line, and of each pair of labels of neighbours summed over a text.

    ``gain`` (texts x lines) weighs content over boilerplate; lines past a text's end have mask 0.
    """
    texts, longest = gain.shape
    zero = np.zeros(texts)
    forward, backward = np.zeros((longest, 2, texts)), np.zeros((longest, 2, texts))
    forward[0, 1] = gain[:, 0]
    for j in range(1, longest):
        a, b = forward[j - 1]
        on = mask[:, j] > 0
        forward[j, 0] = np.where(on, np.logaddexp(a + step[0, 0], b + step[1, 0]), a)
        forward[j, 1] = np.where(on, np.logaddexp(a + step[0, 1], b + step[1, 1]) + gain[:, j], b)
    for j in range(longest - 2, -1, -1):
        a, b = backward[j + 1, 0], backward[j + 1, 1] + gain[:, j + 1]
        on = mask[:, j + 1] > 0
        for i in (0, 1):
            backward[j, i] = np.where(on, np.logaddexp(step[i, 0] + a, step[i, 1] + b), backward[j + 1, i])
    norm = np.logaddexp(*forward[-1])
    node = np.exp(forward[:, 1] + backward[:, 1] - norm).T * mask
    pairs = np.zeros((texts, 2, 2))
    for j in range(1, longest):
        for i in (0, 1):
            for k, own in ((0, zero), (1, gain[:, j])):
                pairs[:, i, k] += np.exp(forward[j - 1, i] + step[i, k] + own + backward[j, k] - norm) * mask[:, j]
    return node, pairs


def held_to_shares(gain: np.ndarray, step: np.ndarray, mask: np.ndarray, sizes: np.ndarray,
                   good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals nearest to the field's under which a good text expects at least `GOOD_SHARE` of its
    characters in content lines and a poor one at most `POOR_SHARE`.

    A text that meets its bound is left as it is; for others the weight on content, in proportion
    to a line's size, that just meets it is found by halving.
    """
    pull = sizes * mask.sum(axis=1, keepdims=True) / sizes.sum(axis=1, keepdims=True)
    share = sizes / sizes.sum(axis=1, keepdims=True)
    sign, bound = np.where(good, 1.0, -1.0), np.where(good, GOOD_SHARE, POOR_SHARE)
    node, pairs = marginals(gain, step, mask)
    low, high = np.zeros(len(gain)), np.where(sign * ((node * share).sum(axis=1) - bound) >= 0, 0.0, MOST_PULL)
    for _ in range(10):
        middle = (low + high) / 2
        node, pairs = marginals(gain + (sign * middle)[:, None] * pull, step, mask)
        met = sign * ((node * share).sum(axis=1) - bound) >= 0
        low, high = np.where(met, low, middle), np.where(met, middle, high)
    return marginals(gain + (sign * high)[:, None] * pull, step, mask)


def fit_field(texts: list[list[list[int]]], sizes: list[list[int]], labels: list[int], rounds: int = 6,
              steps: int = 25, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Weights of a field whose line labels are hidden; a text's label bounds its content share.

    Starting from `STARTS`, each round takes the likely labels of all lines under these bounds
    and moves the weights towards them by gradient steps. A poor text may hold content lines and a
    good one boilerplate. ``sizes`` are the characters of each line. Without texts, the start.
    """
    width = len(FEATURES)
    start = np.concatenate([[STARTS.get(name, 0.0) for name in FEATURES], np.zeros(4)])
    both = start.copy()
    if not texts:
        return Field(both[:width], both[width:].reshape(2, 2))
    longest = max(map(len, texts))
    x = np.zeros((len(texts), longest, width))
    mask, chars = np.zeros((len(texts), longest)), np.zeros((len(texts), longest))
    for i, lines in enumerate(texts):
        mask[i, :len(lines)] = 1
        chars[i, :len(lines)] = sizes[i]
        for j, own in enumerate(lines):
            x[i, j, own] = 1
    good = np.array(labels) > 0
    for _ in range(rounds):
        held = held_to_shares(x @ both[:width], both[width:].reshape(2, 2), mask, chars, good)
        first, second = np.zeros_like(both), np.zeros_like(both)
        for t in range(1, steps + 1):
            slope = slope_of(both, x, mask, held) - penalty * (both - start)
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            both = both + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Field(both[:width], both[width:].reshape(2, 2))


def slope_of(both: np.ndarray, x: np.ndarray, mask: np.ndarray, held: tuple) -> np.ndarray:
    """Slope, per line, of the expected log-likelihood of labels with the marginals ``held``."""
    width = x.shape[2]
    node, pairs = marginals(x @ both[:width], both[width:].reshape(2, 2), mask)
    return np.concatenate([
        np.einsum("ij,ijf->f", held[0] - node, x), (held[1] - pairs).sum(axis=0).ravel(),
    ]) / mask.sum()


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows that occur twice or more; windows are named exactly, by doubling."""
    if len(words) <= window:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    width = 1
    while width < window:
        many = len(ids) + 1
        pairs = ids[:-width] * many + ids[width:]
        kinds, ids = np.unique(pairs, return_inverse=True)
        if len(kinds) == len(pairs):
            return 0
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def lines_of(text: str) -> list[str]:
    """Lines with a word."""
    return [line for line in text.split("\n") if line.strip(SPACES)]


def measure(text: str | None, field: Field) -> tuple:
    """Counts of the text, and the share of its characters in lines marked content."""
    text = text or ""
    words, lines = text.encode().split(), lines_of(text)
    repeated = repeated_words(words)
    labels = field.viterbi(line_features(lines))
    sizes = list(map(len, lines))
    content = sum(n for n, label in zip(sizes, labels) if label)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated,
        len(words) < LEAST_WORDS or 100 * repeated > REPEAT_SHARE * len(words),
        content / sum(sizes) if sizes else 0.0,
    )


MEASURES = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("content_share", pa.float64()),
])


def _measuring(field: Field) -> Callable:
    @F.arrow_udf(
        "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, "
        "n_repeat_words: bigint, base_failed: boolean, content_share: double>"
    )
    def measures(texts: pa.Array) -> pa.Array:
        columns = list(zip(*(measure(t.as_py(), field) for t in texts))) or [[]] * len(MEASURES)
        return pa.StructArray.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, MEASURES)], fields=list(MEASURES)
        )

    return measures


def _training_lines(texts: pa.Array) -> pa.Array:
    """Features and sizes of a run of lines, at a place that depends on the text."""
    out = []
    for text in texts:
        lines = lines_of(text.as_py() or "")
        spare = max(0, len(lines) - TRAINING_LINES)
        start = sum(map(len, lines)) % (spare + 1)
        run = slice(start, start + TRAINING_LINES)
        out.append({"lines": line_features(lines)[run], "sizes": list(map(len, lines[run]))})
    return pa.array(out, pa.struct([("lines", pa.list_(pa.list_(pa.int32()))), ("sizes", pa.list_(pa.int64()))]))


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on a bounded sample of labelled rows, the ones whose ids hash lowest.

    Without labels the weights stay those of the start. A null label, id or text is left out.
    """
    sample = labels.where("quality IN (0, 1)").select("doc_id", "quality").dropna()
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAINING_TEXTS)
    lines = F.arrow_udf(_training_lines, "struct<lines: array<array<int>>, sizes: array<bigint>>")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text IS NOT NULL").select(
        "quality", lines(F.col("text")).alias("run")
    ).select("quality", "run.*").collect()
    # Texts without lines go here: a filter would run the features of all documents before the join.
    rows = sorted((r for r in rows if r["lines"]), key=lambda r: (r["quality"], r["lines"], r["sizes"]))
    return fit_field([r["lines"] for r in rows], [r["sizes"] for r in rows], [r["quality"] for r in rows])


def judge(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """Add struct column `quality` (the measures) and `kept`, replacing columns of these names."""
    return docs.withColumn("quality", _measuring(field)(F.col("text"))).withColumn(
        "kept", ~F.col("quality.base_failed") & (F.col("quality.content_share") >= share)
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document.

    Null, empty and blank texts have no words and fail the base. Repeated rows are judged alike.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "quality.*", "kept")
