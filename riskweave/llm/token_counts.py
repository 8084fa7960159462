"""Token counts by overlap resynchronisation.

A document longer than a chunk is encoded in chunks that overlap, each with its words' offsets.
Two chunks are spliced where both start a word, provided that the left chunk's words up to
there end clear of its cut: from a common start on, both scans match the same text. If no such
place lies in the overlap, the left chunk is widened and encoded again until there is one or
the text ends. The count is that of one whole scan.

Defined results: null or empty text has 0 bytes and 0 tokens; strings of special tokens inside
a text count as one token each, as the vocabulary's library has it by default; repeated rows
are counted each; only the id and the text column are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MARGIN, Encoder, encoder
from .bpe_tree import scan
from .common import map_texts, whole_text

#: Characters of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 65_536, 512


def count_long(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text without special strings."""
    total, begin = 0, 0  # begin: a place where the whole scan starts a word
    left = scan(enc, text, 0, min(len(text), chunk))
    while left.high < len(text):
        wide = overlap
        while True:
            low = max(begin, left.high - wide)
            right = scan(enc, text, low, min(len(text), low + chunk))
            firm = left.starts[(left.starts >= max(low, begin)) & (left.starts <= left.high - MARGIN)]
            common = np.intersect1d(firm, right.starts, assume_unique=True)
            if len(common):
                break
            if left.high == len(text):
                return total + int(left.offset[-1] - left.offset[np.searchsorted(left.starts, begin)])
            wide *= 2
            left = scan(enc, text, left.low, min(len(text), left.high + wide))
        # the latest common place leaves the least to encode twice
        at = int(common[-1])
        total += int(left.offset[np.searchsorted(left.starts, at)] - left.offset[np.searchsorted(left.starts, begin)])
        begin, left = at, right
    return total + int(left.offset[-1] - left.offset[np.searchsorted(left.starts, begin)])


def count(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    if len(text) <= chunk:
        return len(enc.ids(text)) // 4
    return sum(count_long(enc, part, chunk, overlap) if special is None else 1 for part, special in enc.segments(text))


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text."""
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def make():
        enc = encoder(path, pattern, own=False)

        def work(texts):
            n = [count(enc, t, chunk, overlap) for t in texts]
            return None, ([len(t.encode()) for t in texts], n, [x > limit for x in n])

        work.close = enc.forget
        return work

    return map_texts(docs, make, "n_bytes bigint, n_tokens bigint, over_limit boolean")
