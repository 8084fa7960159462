"""Byte-level BPE encoding as a monoid's tree reduction, and decoding up the same tree.

An element is a stretch of text with its words' starts, the ids before each word and the ids.
Texts are halved down to leaves; two neighbours join by encoding anew a window of words around
the cut. The window reaches back to a word whose predecessors all end clear of the cut, and
forward until the new scan starts a word where the right element starts one: from there on both
scans are the same text matched from the same place, so nothing outside can change. Until that
happens, the window doubles. The join is associative in its result (that of one whole scan),
so halves may be reduced in any grouping. A word longer than a leaf is reduced by halves of its own
(see bpe), and so is the decoding of ids.

Defined results: null or empty text has no ids and decodes to nothing; repeated rows are
encoded each; only the id and the text column are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MARGIN, Encoder, encoder
from .common import map_texts, whole_text

#: Characters of a leaf.
LEAF = 4096
#: Words on each side of a cut that a join encodes first.
WINDOW = 8


class Stretch:
    """text[low:high] encoded by itself; offset[i] ids stand before word i, offset[-1] in all."""

    __slots__ = ("high", "ids", "low", "offset", "starts")

    def __init__(self, low, high, starts, offset, ids):
        self.low, self.high, self.starts, self.offset, self.ids = low, high, starts, offset, ids


def scan(enc: Encoder, text: str, low: int, high: int) -> Stretch:
    words = enc.matches(text[low:high])
    parts = list(map(enc.words.__getitem__, words))
    n = len(words)
    starts, offset = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n), out=starts[1:])
    np.cumsum(np.fromiter(map(len, parts), np.int64, n) // 4, out=offset[1:])
    starts = starts[:-1] + low
    return Stretch(low, high, starts, offset, np.frombuffer(b"".join(parts), "<u4"))


def join(enc: Encoder, text: str, a: Stretch, b: Stretch) -> Stretch:
    """The stretch of both, as one scan of text[a.low:b.high] would give it."""
    width = WINDOW
    while True:
        i = max(0, len(a.starts) - width)
        while i and a.starts[i] > a.high - MARGIN:
            i -= 1
        j = width
        low = int(a.starts[i]) if i else a.low
        high = int(b.starts[j]) if j < len(b.starts) else b.high
        new = scan(enc, text, low, high)
        fit = new.starts[(new.starts >= a.high) & (new.starts <= (high - MARGIN if high < b.high else high))]
        common = np.intersect1d(fit, b.starts, assume_unique=True)
        if len(common) or (low == a.low and high == b.high):
            break
        width *= 2
    k, m = (int(np.searchsorted(new.starts, common[0])), int(np.searchsorted(b.starts, common[0]))) if len(common) else (len(new.starts), len(b.starts))
    before, middle = a.offset[i], new.offset[k]
    return Stretch(
        a.low, b.high,
        np.concatenate([a.starts[:i], new.starts[:k], b.starts[m:]]),
        np.concatenate([a.offset[:i], before + new.offset[:k], before + middle + b.offset[m:] - b.offset[m]]),
        np.concatenate([a.ids[:before], new.ids[:middle], b.ids[b.offset[m] :]]),
    )


def encode_tree(enc: Encoder, text: str, low: int, high: int, leaf: int) -> Stretch:
    if high - low <= leaf:
        return scan(enc, text, low, high)
    half = (low + high) // 2
    return join(enc, text, encode_tree(enc, text, low, half, leaf), encode_tree(enc, text, half, high, leaf))


def encode(enc: Encoder, text: str, leaf: int = LEAF) -> np.ndarray:
    if len(text) <= leaf:
        return np.frombuffer(enc.ordinary(text), "<u4")
    return encode_tree(enc, text, 0, len(text), leaf).ids


def decode(enc: Encoder, ids: list[int], leaf: int = LEAF) -> bytes:
    """Bytes of ids: leaves concatenate, and their results again."""
    if len(ids) <= leaf:
        return b"".join(map(enc.bytes_of.__getitem__, ids))
    half = len(ids) // 2
    return decode(enc, ids[:half], leaf) + decode(enc, ids[half:], leaf)


def _arrays(path: str, pattern: str, leaf: int):
    def make():
        enc = encoder(path, pattern)

        def work(texts):
            return None, ([encode(enc, t, leaf).astype(np.int32) for t in texts],)

        work.close = enc.forget
        return work

    return make


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return map_texts(docs, _arrays(path, pattern, leaf), "ids array<int>")


def bpe_decode(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data): the bytes of each row's ids; null ids decode to nothing."""
    ids = ids.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        enc = encoder(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "data": [decode(enc, list(x)) for x in pdf["ids"]]})

    return ids.mapInPandas(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, data binary")


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass.

    The digests are made where the ids are, so no ids leave the workers.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def make():
        enc = encoder(path, pattern)
        decimal = [b"%d," % i for i in range(len(enc.bytes_of))]

        def work(texts):
            n, ids_sha, data_sha = [], [], []
            for text in texts:
                ids = encode(enc, text, leaf).tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b"".join(map(decimal.__getitem__, ids))[:-1]).hexdigest())
                data_sha.append(hashlib.sha256(decode(enc, ids, leaf)).hexdigest())
            return None, (n, ids_sha, data_sha)

        work.close = enc.forget
        return work

    return map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
