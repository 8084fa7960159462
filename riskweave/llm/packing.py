"""Best-fit-decreasing packing of token sequences.

Lengths are integers up to the capacity, so equal lengths are interchangeable and so are open
bins of equal remaining room. Best-fit decreasing therefore runs on the driver over the
histogram of lengths alone (at most ``capacity`` numbers, whatever the input's size): for each
length, longest first, a segment tree over remaining capacities gives the tightest open room in
logarithmic time, and all bins of a group are filled at once. That gives the very packing of
document-by-document best fit. The plan, a table of rank intervals, is bounded by the capacity
too and is broadcast; rows get their rank within a length by salted windows, so a length that
holds a third of all rows is spread over many tasks.

Defined results: null or empty text is one piece of the closing id alone; repeated rows are
packed each; a null doc_id is kept; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Scratch, map_texts, whole_text

#: Rows of one length that a task ranks at a time, about.
RANKED = 100_000


class Rooms:
    """A segment tree over remaining capacities: how many groups of open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` with an open bin."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, used before, rows a bin) of best-fit decreasing.

    Row r of an interval goes to bin first + (r - lo) // q, at used + (r - lo) % q * length.
    """
    rooms, open_bins, out, bins = Rooms(capacity), {}, [], 0

    def put(room: int, base: int, n: int) -> None:
        if room and n:
            open_bins.setdefault(room, []).append((base, n))
            rooms.add(room, 1)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, base, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                base, n = open_bins[room].pop()
                rooms.add(room, -1)
            q = room // length
            take = min(left, n * q)
            out.append((length, rank, rank + take, base, capacity - room, q))
            full, part = divmod(take, q)
            put(room - q * length, base, full)
            if part:
                put(room - part * length, base + full, 1)
            put(room, base + full + bool(part), n - full - bool(part))
            rank, left = rank + take, left - take
    return out


def _pieces(path: str, pattern: str, capacity: int, closing: int):
    end = np.uint32(closing).astype("<u4").tobytes()

    def make():
        enc = encoder(path, pattern, own=False)

        def work(texts):
            rows = []
            for i, text in enumerate(texts):
                ids = enc.ids(text) + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            i, *columns = zip(*rows, strict=True)
            return i, columns

        work.close = enc.forget
        return work

    return make


def pack(pieces: DataFrame, capacity: int, keep: Scratch, order: list[str]) -> DataFrame:
    """Add sequence_id and offset to rows that have a length from 1 to ``capacity``.

    ``order`` names columns that tell rows of one length apart; rows alike in all of them are
    interchangeable. ``pieces`` must be a written table.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(64, sum(histogram.values()) // RANKED)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    each = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = each.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)).cast("bigint") - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    intervals = spark.createDataFrame(plan(histogram, capacity), "length bigint, _lo bigint, _hi bigint, _bin bigint, _used bigint, _q bigint")
    placed = ranked.join(F.broadcast(intervals), (ranked["length"] == intervals["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    at = F.col("_rank") - F.col("_lo")
    return placed.select(
        *[pieces[c] if c != "length" else ranked["length"] for c in pieces.columns],
        (F.col("_bin") + F.floor(at / F.col("_q"))).cast("bigint").alias("sequence_id"),
        (F.col("_used") + at % F.col("_q") * ranked["length"]).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    keep = Scratch(docs.sparkSession, "packing")
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    pieces = keep.put(map_texts(docs, _pieces(path, pattern, capacity, closing), "piece int, start bigint, length bigint, ids_crc32 bigint"), "pieces")
    return pack(pieces, capacity, keep, ["doc_id", "piece", "start", "ids_crc32"])
