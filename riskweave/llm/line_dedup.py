"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches of ascending ids, with about the same number of lines each; lines are
written once, with a folder for each batch, so every batch reads its own. A run is a table
of (hash, first document, lines that held it) sorted and bucketed by hash. Each batch reduces its
lines to one row per hash, merge-anti-joins them with the runs (bucketed alike, so the runs are
not shuffled again) and writes what is new as a run of level 0; ``fanout`` runs of a level are
compacted into one of the next. Runs never share a hash, as a batch adds only what none of them
holds, and a hash's first document is the smallest id that holds it. At the end what is left of
the levels becomes one run, with which the lines are joined once, and those whose first document
is another one go.

Hashes are MD5 of the key. A line that a third of all documents hold is one row after the
partial aggregation. In the final join hot hashes are taken out: those that one row in
``HOT_SHARE`` or more lines held in their batch are at most ``HOT_SHARE`` per batch's share of
the lines, so at most ``HOT_SHARE`` in all, and travel to the lines instead of the other way.

Defined results: null or empty text is one empty line; lines of one document never drop each
other; rows of one doc_id are one document, each with its own lines; a null doc_id is one
document that comes last; ids that are no numbers come in one batch; keys shorter than the limit
always stay; columns other than id and text pass through ``keep`` only; an empty table gives an
empty table.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import Scratch, whole_text

#: Lines of a batch, about; batches at least and at most, powers of two, so that levels of two runs end in one.
BATCH_LINES, BATCHES, MOST_BATCHES = 500_000_000, 4, 64
#: Lines for each bucket of the runs, about; there are as many as shuffle partitions at least.
BUCKET_LINES = 20_000_000
#: A hash is hot if more than one line in so many holds it, and at least HOT_LINES do.
HOT_SHARE, HOT_LINES = 10_000, 1000

#: The white space that parts words.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Runs:
    """Levels of sorted runs (h, owner, c) under a scratch folder."""

    def __init__(self, spark: SparkSession, keep: Scratch, fanout: int, total: int):
        self.spark, self.keep, self.fanout = spark, keep, fanout
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []
        self.buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_LINES)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        for run in self.all():
            keys = keys.join(run.select("h").hint("merge"), "h", "left_anti")
        return keys

    def add(self, keys: DataFrame, level: int = 0) -> None:
        """Write a run; compact its level when full."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(keys))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.add(reduce(DataFrame.unionByName, old), level + 1)
            self.keep.drop(*old)

    def one(self) -> DataFrame:
        """All runs as one."""
        old = self.all()
        if len(old) > 1:
            self.levels = [[self._write(reduce(DataFrame.unionByName, old))]]
            self.keep.drop(*old)
        return self.all()[0]

    def _write(self, keys: DataFrame) -> DataFrame:
        name, at = f"riskweave_run_{uuid.uuid4().hex}", self.keep.path("run")
        sorted_keys = keys.select("h", "owner", "c").repartition(self.buckets, "h")
        sorted_keys.write.bucketBy(self.buckets, "h").sortBy("h").option("path", at).format("parquet").saveAsTable(name)
        run = self.spark.table(name)
        run._riskweave_path = at
        self.names.append(name)
        return run

    def forget(self) -> None:
        """Take the runs' names from the catalog; their files stay."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batches(docs: DataFrame, wanted: int | None) -> tuple[int, Column, int]:
    """(number of lines, the batch of a row, number of batches); null ids come last.

    Bounds are approximate quantiles of the ids, each weighed by its lines.
    """
    numeric = isinstance(docs.schema["doc_id"].dataType, NumericType)
    sizes = docs.select("doc_id", F.size("lines").alias("n"))
    total, rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n = wanted or min(max(BATCHES, 1 << (max(-(-total // BATCH_LINES), 1) - 1).bit_length()), MOST_BATCHES)
    if n < 2 or not numeric or not total:
        return total, F.lit(0), 1
    each = max(total // rows, 1)
    weighed = sizes.select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("n") / each), F.lit(1)))).alias("_"))
    marks = sorted(set(weighed.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []))
    at = F.lit(0)
    for m in marks:
        at = at + (F.col("doc_id") > m).cast("int")
    return total, F.coalesce(at, F.lit(len(marks))), len(marks) + 1


def line_dedup(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, n_lines, n_dropped, text): texts without lines that a smaller id holds."""
    spark = docs.sparkSession
    keep = Scratch(spark, "lines")
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *keep_cols).alias("kept"))
    docs = docs.withColumn("th", F.xxhash64("text")).withColumn("lines", F.split("text", "\n", -1))
    key = F.translate(F.btrim("line", F.lit(BLANK)), UPPER, LOWER)
    total, batch, n = _batches(docs, batches)
    lines = docs.select("doc_id", "th", F.posexplode("lines").alias("pos", "line")).withColumn("key", key)
    lines = lines.filter(F.length("key") >= min_chars).select("doc_id", "th", "pos", F.unhex(F.md5("key")).alias("h"), batch.alias("batch"))
    if n > 1:  # each batch in a few files
        parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n)
        lines = lines.repartition("batch", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(parts)))
    lines = keep.put(lines, "lines", "batch")
    runs = Runs(spark, keep, fanout, total)
    try:
        for i in range(n):
            own = lines.filter(F.col("batch") == i)
            runs.add(runs.unseen(own.groupBy("h").agg(F.min("doc_id").alias("owner"), F.count("*").alias("c"))))
        run = runs.one()
        limit = max(HOT_LINES, total // HOT_SHARE)
        hot = keep.put(run.filter(F.col("c") > limit).select("h", F.col("owner").alias("hot_owner")).withColumn("hot", F.lit(True)), "hot")  # at most HOT_SHARE rows
        marked = lines.join(F.broadcast(hot), "h", "left")
        rest = marked.filter("hot is null").select("doc_id", "th", "pos", "h")
        drops = rest.join(run.select("h", "owner").hint("merge"), "h").filter(~F.col("owner").eqNullSafe(F.col("doc_id"))).select("doc_id", "th", "pos")
        drops = drops.unionByName(marked.filter("hot").filter(~F.col("hot_owner").eqNullSafe(F.col("doc_id"))).select("doc_id", "th", "pos"))
        drops = keep.put(drops.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drops")), "drops")
    finally:
        runs.forget()
    left, right = docs.drop("text").alias("l"), drops.alias("r")
    out = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.th") == F.col("r.th")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    text = F.when(F.col("drops").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return out.select(F.col("l.doc_id").alias("doc_id"), *[F.col(f"kept.{c}").alias(c) for c in keep_cols], F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"), text.alias("text"))
