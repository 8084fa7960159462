"""Ranked lexical search: Block-Max WAND over compressed posting blocks.

The index holds, for every segment of the documents, each term's postings (document, frequency) in
blocks of ``BLOCK``, packed, with the last document and the largest impact of each block beside
them. A query meets a segment in two depths. Shallow: the pointers of its terms move over the
blocks' last documents alone and add up the weighted largest impacts of the blocks that cover each
document; documents whose sum stays below the query's threshold, the score of its k-th best so far,
are left, and so are blocks without any other document. Deep: lists are taken by falling bounds; of
each, the blocks that hold a live document are decompressed, the true impacts replace the bounds,
and documents that fall below the threshold leave. What is alive after the last list has its exact
score. Pointers of a term move over all documents of a segment at once, in vectors.

Thresholds stay from segment to segment within a task and start at nothing, so they rule out only
documents that cannot be among a query's best; tasks are at most ``TASKS`` a core, so the candidates
that meet in the last ranking are at most k of each task.

Numbers of documents, terms and documents of a term are those of the whole table: one pass counts
terms, the index is built with its impacts, one pass over the index's term columns sums up the
documents of the queries' terms. Scores are 64-bit integers.

Defined results: null and empty texts hold no terms and are never found; documents with a score of
0 are not returned; equal scores stand by ascending doc_id, a null one first, rows of one doc_id in
any order; an item without terms has no rows; rows of one item_id are queries each; other columns
do not matter; empty tables give an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back
from .postings import lookup, pack, query_blocks, running_from, searched, slices, terms_of, texts_of, unpack, written

#: Postings of a block; tasks of a search for each core.
BLOCK, TASKS = 128, 4


@dataclass
class Index:
    """Written segments, and the table's numbers of documents with terms, of terms and of postings in a block."""

    segments: DataFrame
    documents: int
    terms: int
    block: int


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, frequency) by term and document, and the documents' lengths."""
    hashes, first = terms_of(texts)
    sizes = np.diff(first)
    order = np.argsort(hashes, kind="stable")
    term, doc = hashes[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    begin = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.zeros(0, int)
    return term[begin], doc[begin], np.diff(np.concatenate([begin, [len(term)]])), sizes


def build_index(docs: DataFrame, keep: Scratch) -> Index:
    """The block-max index of every document."""
    import pyarrow as pa

    texts = docs.select("doc_id", "text")

    def count(batches):
        n = total = 0
        for _, own in texts_of(batches):
            sizes = np.diff(terms_of(own)[1])
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])
        give_back()

    n, total = (x or 0 for x in texts.mapInArrow(count, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first())

    def run(batches):
        for ids, own in texts_of(batches):
            term, doc, tf, sizes = _frequencies(own)
            m = 10 + (90 * sizes.astype(np.int64) * n) // max(total, 1)
            begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, int)
            held = np.diff(np.concatenate([begin, [len(term)]]))
            block = np.arange(len(term)) - np.repeat(begin, held)  # a list's postings, numbered
            heads = np.flatnonzero(block % BLOCK == 0)
            tails = np.concatenate([heads[1:], [len(term)]]) - 1 if len(heads) else heads
            delta = np.diff(doc, prepend=0)
            delta[begin] = doc[begin] + 1  # before a list's first document stands number -1
            pairs = np.empty(2 * len(doc), np.int64)
            pairs[0::2], pairs[1::2] = delta, tf
            data, size = pack(pairs)
            ends = np.cumsum(size)[2 * tails + 1] if len(tails) else tails
            most = np.maximum.reduceat(_impact(tf.astype(np.int64), m[doc]), heads) if len(heads) else heads
            columns = (term[begin], held.astype(np.uint32), doc[tails].astype(np.uint32), most.astype(np.uint32), ends.astype(np.uint64), data)
            yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([m.tolist()], pa.list_(pa.int64())), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["doc_ids", "m", "terms", "held", "lasts", "most", "ends", "postings"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = texts.mapInArrow(run, f"doc_ids array<{kind}>, m array<bigint>, terms binary, held binary, lasts binary, most binary, ends binary, postings binary")
    return Index(written(keep, made, "segments"), n, total, BLOCK)


def _document_counts(index: Index, vocabulary: np.ndarray) -> np.ndarray:
    """In how many documents each of the queries' terms is."""
    import pyarrow as pa

    sent = index.segments.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        wanted = sent.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for seg in batch.to_pylist():
                at, there = lookup(np.frombuffer(seg["terms"], np.uint64), wanted)
                if there.any():
                    total[there] += np.frombuffer(seg["held"], np.uint32)[at[there]]
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], names=["term", "df"])

    out = np.zeros(len(vocabulary), np.int64)
    for term, df in index.segments.select("terms", "held").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():  # at most a block's vocabulary
        out[term] = df
    return out


class Segment:
    """One segment's lists, and counts of blocks met and decompressed."""

    def __init__(self, seg: dict, block: int = BLOCK):
        self.terms, self.held = np.frombuffer(seg["terms"], np.uint64), np.frombuffer(seg["held"], np.uint32).astype(np.int64)
        self.lasts, self.most = np.frombuffer(seg["lasts"], np.uint32).astype(np.int64), np.frombuffer(seg["most"], np.uint32).astype(np.int64)
        self.ends, self.data = np.frombuffer(seg["ends"], np.uint64).astype(np.int64), np.frombuffer(seg["postings"], np.uint8)
        self.m = np.array(seg["m"], np.int64)
        self.ids = seg["doc_ids"]
        self.block, blocks = block, -(-self.held // block)
        self.first = np.cumsum(blocks) - blocks
        self.blocks = blocks
        rank = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] if self.ids[i] is not None else 0))
        self.rank = np.empty(len(rank), np.int64)
        self.rank[rank] = np.arange(len(rank))
        self.met = self.opened = 0

    def postings(self, term: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of some of a term's blocks, decompressed."""
        self.opened += len(blocks)
        own = self.first[term] + blocks
        pairs = unpack(slices(self.data, np.where(own > 0, self.ends[own - 1], 0), self.ends[own]))
        counts = np.minimum(self.held[term] - blocks * self.block, self.block)
        return running_from(pairs[0::2], counts, np.where(blocks > 0, self.lasts[own - 1], -1)), pairs[1::2]

    def best(self, at: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the segment's k best with a score of at least ``least``, for the lists ``at``."""
        bound = np.zeros(len(self.m), np.int64)
        tops = []
        for t, w in zip(at.tolist(), weight.tolist(), strict=True):
            f, n = self.first[t], self.blocks[t]
            lasts, most = self.lasts[f : f + n], self.most[f : f + n] * w
            bound[: lasts[-1] + 1] += most[0] if n == 1 else np.repeat(most, np.diff(lasts, prepend=-1))
            tops.append(int(most.max()))
            self.met += int(n)
        live = np.flatnonzero(bound >= least)
        score = bound[live]
        for i in np.argsort(-np.array(tops, np.int64), kind="stable").tolist():
            if not len(live):
                break
            t, w = int(at[i]), int(weight[i])
            f, n = self.first[t], self.blocks[t]
            block = np.searchsorted(self.lasts[f : f + n], live)
            inside = np.flatnonzero(block < n)
            if not len(inside):
                continue
            own = block[inside]
            docs, tf = self.postings(t, np.unique(own))
            place = np.searchsorted(docs, live[inside])
            place[place == len(docs)] = 0
            there = docs[place] == live[inside]
            true = np.where(there, _impact(tf[place], self.m[live[inside]]), 0)
            score[inside] += w * (true - self.most[f + own])
            stay = score >= least
            live, score = live[stay], score[stay]
        order = np.lexsort((self.rank[live], -score))[:k]
        return live[order], score[order]


class Searcher:
    """A task's queries and the best documents each has found so far."""

    def __init__(self, lists: list[np.ndarray], vocabulary: np.ndarray, weight: np.ndarray, k: int, block: int):
        self.lists, self.vocabulary, self.weight, self.k, self.block = lists, vocabulary, weight, k, block
        self.found: list[list] = [[] for _ in lists]
        self.met = self.opened = 0

    def take(self, row: dict) -> None:
        seg = Segment(row, self.block)
        if len(seg.terms):
            at, there = lookup(seg.terms, self.vocabulary)
            for q, own in enumerate(self.lists):
                own = own[there[own]]
                if len(own):
                    found = self.found[q]
                    docs, scores = seg.best(at[own], self.weight[own], self.k, found[-1][0] if len(found) == self.k else 1)
                    found += [(int(s), seg.ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                    found.sort(key=lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0))
                    del found[self.k :]
        self.met, self.opened = self.met + seg.met, self.opened + seg.opened


def search_index(index: Index, items: DataFrame, keep: Scratch, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_col, rank, doc_id, score): the k best documents of every item."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = keep.spark
    doc_kind, item_kind = index.segments.schema["doc_ids"].dataType.elementType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = _parse_datatype_string(f"query bigint, item {item_kind}, doc_id {doc_kind}, score bigint")
    arrow = to_arrow_schema(schema)
    found, before = [], 0
    for ids, texts in query_blocks(items, item_col, text_col):
        hashes, first = terms_of(texts)
        vocabulary, word = np.unique(hashes, return_inverse=True)
        lists = [np.unique(word[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        df = _document_counts(index, vocabulary)
        weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        sent = spark.sparkContext.broadcast((lists, vocabulary, weight, ids, before, index.block))  # at most QUERY_CHARS characters

        def run(batches, sent=sent):
            lists, vocabulary, weight, ids, before, block = sent.value
            work = Searcher(lists, vocabulary, weight, k, block)
            for batch in batches:
                for row in batch.to_pylist():
                    work.take(row)
            out = [{"query": before + q, "item": ids[q], "doc_id": d, "score": s} for q, best in enumerate(work.found) for s, d in best]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
            give_back()

        tasks = max(1, TASKS * spark.sparkContext.defaultParallelism)
        found.append(searched(keep, lambda run=run, tasks=tasks: index.segments.coalesce(tasks).mapInArrow(run, schema), "candidates"))
        before += len(ids)
    if not found:
        return spark.createDataFrame([], f"{item_col} {item_kind}, rank int, doc_id {doc_kind}, score bigint")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")  # at most k rows of each task
    ranked = every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of every item, over an index that is built and dropped."""
    keep = Scratch(docs.sparkSession, "search")
    index = build_index(docs, keep)
    out = search_index(index, items, keep, k, item_col, text_col)
    keep.drop(index.segments)
    return out
