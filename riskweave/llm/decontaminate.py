"""Benchmark decontamination over a distributed positional inverted index.

The index holds, for every segment of the documents, each term's places in ascending order as
packed differences. A passage's windows are searched in every segment: windows with a term that
the segment lacks fall away by its counts alone; for the others the list of the rarest term gives
the places where the window could begin, and the lists of its further terms, from the rarer to the
more frequent, are intersected with these places, shifted by the term's offset in the window. With
``slop`` a term may stand so many words from its place: proximity matches by the same lists.

The passages are a query set: they come in blocks of bounded size, each broadcast and held against
the whole index. Documents are never grouped or shuffled; between two of them in a segment lie
``GAP`` places that hold no term, so no match crosses them.

Defined results: null and empty texts have no words; an item of fewer words than a window is one
window, one without words is none; rows of one doc_id are documents each; items of one item_id
count once; a null item_id counts as an item and has no text in lists of ids; other columns do not
matter; empty tables give an empty or clean result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back
from .postings import lookup, pack, query_blocks, running_from, searched, slices, terms_of, texts_of, unpack, written

#: Empty places between two documents of a segment, more than a window and its slop; candidates that are intersected together.
GAP, CANDIDATES = 64, 2_000_000
_SHIFT = 40


def _ordered(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, their counts, and all places term by term."""
    sizes = np.diff(first)
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)) * GAP, sizes)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
    return ranked[begin], np.diff(np.concatenate([begin, [len(ranked)]])), place[order]


def positional_index(docs: DataFrame, keep: Scratch) -> DataFrame:
    """Segments (doc_ids, n_words, terms, counts, postings), written."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for ids, texts in texts_of(batches):
            hashes, first = terms_of(texts)
            terms, counts, place = _ordered(hashes, first)
            begin = np.cumsum(counts) - counts
            delta = np.diff(place, prepend=0)
            delta[begin] = place[begin]
            data, size = pack(delta)
            ends = np.cumsum(size)[begin + counts - 1] if len(begin) else begin
            lengths = np.diff(ends, prepend=0)
            row = [pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([np.diff(first).tolist()], pa.list_(pa.int32())), *(pa.array([x.tobytes()], pa.binary()) for x in (terms, counts.astype(np.uint32), lengths.astype(np.uint32), data))]
            yield pa.RecordBatch.from_arrays(row, names=["doc_ids", "n_words", "terms", "counts", "lengths", "postings"])
        give_back()

    made = docs.select("doc_id", "text").mapInArrow(run, f"doc_ids array<{kind}>, n_words array<int>, terms binary, counts binary, lengths binary, postings binary")
    return written(keep, made.withColumn("segment", F.monotonically_increasing_id()), "segments")


class Windows:
    """The windows of a block of items: terms as places in a vocabulary, -1 behind short ones."""

    def __init__(self, texts: list[str], size: int, together: int):
        self.together = together
        hashes, first = terms_of(texts)
        self.vocabulary, word = np.unique(hashes, return_inverse=True)
        n = np.diff(first)
        many = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
        self.item = np.repeat(np.arange(len(texts)), many)
        begin = np.repeat(first[:-1], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.length = np.minimum(n[self.item], size)
        at = begin[:, None] + np.arange(size)
        inside = np.arange(size) < self.length[:, None]
        self.terms = np.where(inside, word[np.minimum(at, max(len(word) - 1, 0))] if len(word) else -1, -1)


def _matches(seg: dict, windows: Windows, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place where it begins, place of its rarest term) of every match in a segment."""
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    terms, counts = np.frombuffer(seg["terms"], np.uint64), np.frombuffer(seg["counts"], np.uint32).astype(np.int64)
    if not len(terms) or not len(windows.terms):
        return none
    at, there = lookup(terms, windows.vocabulary)
    tf = np.where(there, counts[at], 0)
    every = np.where(windows.terms < 0, np.iinfo(np.int64).max, tf[windows.terms])
    live = np.flatnonzero(every.min(axis=1) > 0)
    if not len(live):
        return none
    wanted = np.unique(windows.terms[live])
    wanted = wanted[wanted >= 0]
    ends = np.cumsum(np.frombuffer(seg["lengths"], np.uint32).astype(np.int64))
    data = np.frombuffer(seg["postings"], np.uint8)
    own = at[wanted]
    lists = unpack(slices(data, ends[own] - np.frombuffer(seg["lengths"], np.uint32)[own], ends[own]))
    places = running_from(lists, counts[own])
    first = np.cumsum(counts[own]) - counts[own]
    rank = np.zeros(len(windows.vocabulary), np.int64)
    rank[wanted] = np.arange(len(wanted))
    keys = np.repeat(np.arange(len(wanted)) << _SHIFT, counts[own]) + places  # ascending
    order = np.argsort(every[live], axis=1, kind="stable")
    rarest = order[:, 0]
    anchor = rank[windows.terms[live, rarest]]
    many = counts[own][anchor]
    found = []
    total = np.cumsum(many)
    begin = 0
    while begin < len(live):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + windows.together, "right")))
        size = many[begin:end]
        w = np.repeat(np.arange(begin, end), size)
        place = places[np.arange(int(size.sum())) + np.repeat(first[anchor[begin:end]] - (np.cumsum(size) - size), size)] - rarest[w]
        inside = place >= 0
        w, place = w[inside], place[inside]
        for k in range(1, order.shape[1]):
            offset = order[w, k]
            term = windows.terms[live[w], offset]
            low = (rank[term] << _SHIFT) + np.maximum(place + offset - slop, 0)
            hit = np.searchsorted(keys, low)
            hit[hit == len(keys)] = len(keys) - 1
            value = keys[hit]
            stay = (term < 0) | ((value >= low) & (value <= (rank[term] << _SHIFT) + place + offset + slop))
            w, place = w[stay], place[stay]
            if not len(w):
                break
        found.append((live[w], place, place + rarest[w]))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _by_document(seg: dict, windows: Windows, ids: list, slop: int) -> list[dict]:
    """A row for each document of a segment: its hit stretches [begin, end) of words, and the items found."""
    n_words = np.array(seg["n_words"], np.int64)
    start = np.cumsum(n_words) - n_words + np.arange(len(n_words)) * GAP
    w, place, anchor = _matches(seg, windows, slop)
    rows = [{"segment": seg["segment"], "row": i, "doc_id": d, "n_words": int(n), "hits": [], "items": []} for i, (d, n) in enumerate(zip(seg["doc_ids"], n_words, strict=True))]
    if len(w):
        own = np.searchsorted(start, anchor, "right") - 1
        step = np.zeros(int(start[-1] + n_words[-1]) + 1, np.int64)
        np.add.at(step, np.maximum(place, start[own]), 1)
        np.add.at(step, np.minimum(place + windows.length[w], start[own] + n_words[own]), -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(step) > 0).astype(np.int8)]))
        for begin, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            doc = int(np.searchsorted(start, begin, "right")) - 1
            rows[doc]["hits"].append({"b": begin - int(start[doc]), "e": end - int(start[doc])})
        pairs = np.unique(np.stack([own, windows.item[w]]), axis=1)
        for doc, item in pairs.T.tolist():
            rows[doc]["items"].append(ids[item])
    return rows


def _search(keep: Scratch, index: DataFrame, ids: list, texts: list[str], size: int, slop: int, item_kind: str) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    doc_kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = _parse_datatype_string(f"segment bigint, row int, doc_id {doc_kind}, n_words bigint, hits array<struct<b:bigint,e:bigint>>, items array<{item_kind}>")
    arrow = to_arrow_schema(schema)
    sent = keep.spark.sparkContext.broadcast((Windows(texts, size, CANDIDATES), ids))  # at most QUERY_CHARS characters

    def run(batches):
        windows, own = sent.value
        for batch in batches:
            for seg in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(_by_document(seg, windows, own, slop), schema=arrow)
        give_back()

    return searched(keep, lambda: index.mapInArrow(run, schema), "matches")


def phrase_hits(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits, items) for every document.

    ``hits`` are the stretches [b, e) of word numbers that lie in a window found, joined where they
    touch; ``items`` the ids of the items with such a window. With ``slop`` 0 windows are exact
    phrases; with more, each of a window's terms may stand up to so many words from its place.
    """
    if not 0 <= slop <= GAP - size:
        raise ValueError(f"slop and a window's size must be at most {GAP} together")
    keep = Scratch(docs.sparkSession, "phrases")
    index = positional_index(docs, keep)
    kind = items.schema[item_col].dataType.simpleString()
    found = [_search(keep, index, ids, texts, size, slop, kind) for ids, texts in query_blocks(items, item_col, text_col)]
    found = found or [_search(keep, index, [], [], size, slop, kind)]
    keep.drop(index)
    out = found[0]
    if len(found) > 1:  # one row of each document from each block
        for more in found[1:]:
            out = out.unionByName(more)
        out = out.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        joined = F.aggregate(
            "hits", F.array().cast("array<struct<b:bigint,e:bigint>>"),
            lambda done, h: F.when((F.size(done) > 0) & (F.element_at(done, -1)["e"] >= h["b"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["b"].alias("b"), F.greatest(F.element_at(done, -1)["e"], h["e"]).alias("e"))))).otherwise(F.concat(done, F.array(h))),
        )
        out = out.withColumn("hits", joined)
    return out.select("doc_id", "n_words", "hits", F.array_distinct("items").alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) for every document."""
    out = phrase_hits(docs, items, size)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["e"] - h["b"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "items")
