"""What the inverted indexes share: terms, variable-byte integers and how segments are written and read.

An index is a table of segments. A segment holds the postings of a stretch of documents, sorted
by term, in a few binary columns: it answers queries about its own documents by itself, so
neither building nor searching shuffles postings, and a lost task rebuilds or rereads segments
alone. Terms are 64-bit hashes; two different words of an index share one with a probability of
about (words searched x words indexed) / 2**64.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import NO_LETTER, Scratch, blocks, word_hashes

#: What parts terms: ASCII other than letters and digits.
NO_TERM = NO_LETTER.copy()
NO_TERM[48:58] = False
#: Characters of a segment, about, or one longer document; bytes of a written row group; segments in one Arrow batch.
SEGMENT, ROW_GROUP, BATCH = 1 << 22, 16 << 20, 4
#: Characters of the query texts that are searched for together.
QUERY_CHARS = 4_000_000


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of seven bits, the last byte of each below 128, and their lengths."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        byte = (v[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[own] + k] = byte.astype(np.uint8) | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts + 1
    out = (data[starts] & 127).astype(np.int64)
    for k in range(1, int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[own] |= (data[starts[own] + k] & 127).astype(np.int64) << 7 * k
    return out


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes starts[i]:ends[i], one after the other."""
    if len(starts) == 1:
        return data[starts[0] : ends[0]]
    size = ends - starts
    at = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    return data[at]


def running_from(deltas: np.ndarray, counts: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    """Running sums that start anew, from ``base``, after each of ``counts`` values."""
    total = np.cumsum(deltas)
    first = np.cumsum(counts) - counts
    return total - np.repeat(total[first] - deltas[first] - base, counts)


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and where each text's begin and the last ends."""
    hashes, first, *_ = word_hashes(texts, lower=True, space=NO_TERM)
    return hashes, first


def texts_of(batches, most: int = SEGMENT):
    """(ids as an Arrow array, texts) of about ``most`` characters each; null is an empty text."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        for cut in blocks(texts, most):
            yield ids.slice(cut.start, cut.stop - cut.start), texts[cut]


def lookup(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted terms among a segment's sorted ones, and which are there."""
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    return at, terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool)


def written(keep: Scratch, df: DataFrame, name: str) -> DataFrame:
    """A table of segments, in small row groups, as a reader holds one whole."""
    at = keep.path(name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(at)
    out = keep.spark.read.schema(df.schema).parquet(at)
    out._riskweave_path = at
    return out


def searched(keep: Scratch, make, name: str) -> DataFrame:
    """The written result of ``make()``, which reads segments: few of them are in memory at a time."""
    conf, key = keep.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH))
    try:
        return keep.put(make(), name)
    finally:
        conf.set(key, before)


def query_blocks(items: DataFrame, id_col: str, text_col: str):
    """(ids, texts) of the query table in blocks of bounded size; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1] or "")
        size += len(texts[-1])
        if size >= QUERY_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
