"""Token counts of whole texts; huge documents in overlapping chunks that are spliced.

Two chunks share an overlap. Where both encodings have a token boundary at the same place,
and that place is stable, the left encoding is kept up to it and the right one from it.
Stable is a place before white space that follows something else, before a mark such as a
comma that follows a letter or digit, and between letter and digit: the pre-tokeniser never
joins the two and looks no further back than its last match, so what follows such a place does
not depend on what stands before it, nor the reverse. If an overlap holds no such place, it is
widened, at last back to the last cut, and the next chunk is as long as what has none, so that
a text of any length is encoded a few times at most.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters of a chunk and of the first overlap; texts up to a chunk are encoded at once.
CHUNK, OVERLAP = 1 << 15, 1 << 9
# ASCII only, where all libraries agree; marks that occur in special tokens are left out.
_STABLE = re.compile(
    r"""(?<=\S)(?=[ \t\n\r\f\v])|(?<=[A-Za-z0-9])(?=[,.:;?!"/=&%-])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"""
)
#: Texts handed to the library at once; its encodings are much larger than the texts.
_TOGETHER = 64

_tokenizers: dict = {}


def tokenizer(path: str):
    """The library's tokenizer of a vocabulary file, once per worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def spliced_count(encode: Callable[[str], list[tuple[int, int]]], text: str, chunk: int = CHUNK,
                  overlap: int = OVERLAP) -> int:
    """Tokens of `text`; `encode` gives the (first, last) characters of each token of a chunk."""

    def tokens(first: int, last: int) -> list[int]:
        return [first + b for b, _ in encode(text[first:last])]

    total, start, end = 0, 0, chunk
    left = tokens(start, end)
    while end < len(text):
        width, last = overlap, end + max(chunk, end - start)
        while True:
            back = max(start, end - width)
            if back > start and not _STABLE.search(text, back + 1, end):
                width *= 2
                continue
            right = tokens(back, last)
            common = set(left).intersection(right)
            cut = next((m.start() for m in _STABLE.finditer(text, back + 1, end) if m.start() in common), None)
            if cut is not None or back == start:
                break
            width *= 2
        if cut is None:  # no stable place since the last cut: `right` starts there and is right as it is
            left = right
        else:
            total += sum(b < cut for b in left)
            left = [b for b in right if b >= cut]
            start = cut
        end = last
    return total + len(left)


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """UDF: tokens of each text, without special tokens added; null counts as empty."""

    @F.arrow_udf("bigint")
    def n_tokens(texts: pa.Array) -> pa.Array:
        tok = tokenizer(path)

        def offsets(part: str):
            return tok.encode(part, add_special_tokens=False).offsets

        out = np.zeros(len(texts), dtype=np.int64)
        for at in range(0, len(texts), _TOGETHER):
            some = [t or "" for t in texts[at:at + _TOGETHER].to_pylist()]
            short = [i for i, t in enumerate(some) if len(t) <= chunk]
            for i, e in zip(short, tok.encode_batch_fast([some[i] for i in short], add_special_tokens=False)):
                out[at + i] = len(e)
            for i, t in enumerate(some):
                if len(t) > chunk:
                    out[at + i] = spliced_count(offsets, t, chunk, overlap)
        return pa.array(out)

    return n_tokens


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit, replacing columns of these names; no shuffle."""
    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
        "n_tokens": counter(path, chunk, overlap)(F.col("text")),
    }).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document. A null or empty text has none; repeated rows are counted each.

    Very long texts are counted whole, in chunks. Columns beside doc_id and text are not read.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(TOKENIZER)).drop("text")
