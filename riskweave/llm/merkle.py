"""Merkle manifest of a table: a tree over each source's rows and one over the sources' roots.

Every row is a leaf; runs of ``FAN`` consecutive nodes become their digest until one is left, first
within a source by ascending id, then over the sources. The trees are built in rounds. A round
reduces blocks of ``BLOCK`` nodes on the executors, each block streamed by itself, and leaves one
node a block; when no more than ``TOP`` nodes are left, or every source is at its root, the driver
builds the rest of the trees from them and broadcasts, for each node, the siblings above it. On the
way back the executors read each block again, put its rows' own siblings before those from above
and fold every row up to the root. More sources than ``TOP`` are numbered in order and go through
the same rounds as the nodes of one tree.

Places of rows within their source come from one range sort: rows are dealt by (source, id, leaf),
numbered where they stand, and a small table of counts by source and partition gives the offsets,
so that no source is gathered anywhere. Digests travel as 32 bytes, texts are read once.

Defined results: null values are written ``-``; a null source is a source of its own that comes
first; a null id is the first of its source and is not tampered with; rows of one id stand by
their leaf digests; equal rows are leaves each; other columns do not enter a leaf; an empty table
gives an empty table.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back

#: Nodes that one digest joins; nodes that an executor reduces together, a power of FAN; nodes that the driver takes.
FAN, BLOCK, TOP = 3, 3**7, 3**8
_PATH = "array<struct<l:string,r:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """How many times n nodes are reduced until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def grow(row: list[str], times: int) -> list[list[str]]:
    """The row of nodes and the rows above it."""
    out = [row]
    for _ in range(times):
        row = [digest("".join(row[i : i + FAN])) for i in range(0, len(row), FAN)]
        out.append(row)
    return out


def siblings(rows: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands left and right of node i's run, level by level below the last."""
    out = []
    for row in rows[:-1]:
        first = i - i % FAN
        out.append(("".join(row[first:i]), "".join(row[i + 1 : first + FAN])))
        i //= FAN
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row's values: ``-`` if null, else their UTF-8 byte count, a colon and themselves."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def _numbered(keep: Scratch, rows: DataFrame, tree: Column, order: list[str]) -> DataFrame:
    """(tree, pos, n, columns of rows): places among the rows of one tree and how many there are."""
    by = ["tree", *order]
    rows = rows.withColumn("tree", tree)
    placed = keep.put(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    own = Window.partitionBy("tree")
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a partition
    runs = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    runs = keep.put(runs.select("tree", "_part", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(own).alias("n")), "runs")
    few = F.broadcast(runs) if runs.count() <= TOP else runs
    both = placed.alias("a").join(few.alias("b"), (F.col("a._part") == F.col("b._part")) & F.col("a.tree").eqNullSafe(F.col("b.tree")))
    return both.select("a.tree", (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n", *[f"a.{c}" for c in rows.columns if c != "tree"])


def _blocks(batches, size: int):
    """The rows of each block, whose rows stand together and in order."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["tree"], row["pos"] // size)
            if own != key and rows:
                yield rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield rows


def _reduced(rows: list[dict], size: int) -> list[list[str]]:
    """The tree over a block, as far as its source has levels."""
    return grow([r["h"].hex() for r in rows], min(levels(size), levels(rows[0]["n"])))


def _climb(nodes: DataFrame, work, schema: str) -> DataFrame:
    """What ``work(rows of a block, its tree)`` yields for every block, each in one piece."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    kinds = {f.name: f for f in nodes.schema.fields}
    arrow = to_arrow_schema(StructType([kinds["label"] if f.name == "label" else f for f in fields]))
    out_schema = StructType([kinds["label"] if f.name == "label" else f for f in fields])

    def run(batches):
        out = []
        for rows in _blocks(batches, BLOCK):
            out += work(rows, _reduced(rows, BLOCK))
            if len(out) >= BLOCK:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        give_back()

    dealt = nodes.withColumn("_block", F.floor(F.col("pos") / BLOCK)).repartition("tree", "_block").drop("_block")
    return dealt.sortWithinPartitions("tree", "pos").mapInArrow(run, out_schema)


def _roots(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, h): one node for each block."""

    def work(rows, tree):
        times = len(tree) - 1
        left = -(-rows[0]["n"] // FAN**times)
        return [{"tree": rows[0]["tree"], "pos": rows[0]["pos"] // BLOCK, "n": left, "h": bytes.fromhex(tree[-1][0])}]

    return _climb(nodes.select("tree", "pos", "n", "h"), work, "tree string, pos bigint, n bigint, h binary")


def _with_above(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The first node of each block gets the siblings above it: a broadcast if those are few, else a join of evenly spread keys."""
    above = above.select(F.col("tree").alias("_tree"), (F.col("pos") * BLOCK).alias("_pos"), "path", "subroot", "root")
    return nodes.join(above, (F.col("pos") == F.col("_pos")) & F.col("tree").eqNullSafe(F.col("_tree")), "left").drop("_tree", "_pos")


def _paths(nodes: DataFrame) -> DataFrame:
    """(label, h, path, subroot, root) of every node."""

    def work(rows, tree):
        head = rows[0]
        above = [(s["l"], s["r"]) for s in head["path"]]
        return [{"label": r["label"], "h": r["h"], "path": [{"l": a, "r": b} for a, b in siblings(tree, i) + above], "subroot": head["subroot"], "root": head["root"]} for i, r in enumerate(rows)]

    return _climb(nodes, work, f"label string, h binary, path {_PATH}, subroot string, root string")


def _top(nodes: DataFrame) -> DataFrame:
    """(tree, pos, path, subroot, root): the upper trees, built on the driver from TOP nodes at most."""
    trees: dict = {}
    for tree, pos, n, h in nodes.select("tree", "pos", "n", "h").collect():
        trees.setdefault(tree, [n, {}])[1][pos] = h.hex()
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode("utf-8", "surrogatepass")))
    upper = {t: grow([nodes_[i] for i in range(n)], levels(n)) for t, (n, nodes_) in trees.items()}
    whole = grow([upper[t][-1][0] for t in order], levels(len(order)))
    found = []
    for i, t in enumerate(order):
        above = siblings(whole, i)
        found += [(t, pos, siblings(upper[t], pos) + above, upper[t][-1][0], whole[-1][0]) for pos in range(trees[t][0])]
    return nodes.sparkSession.createDataFrame(found, f"tree string, pos bigint, path {_PATH}, subroot string, root string")


def _above(keep: Scratch, nodes: DataFrame) -> DataFrame:
    """(tree, pos, path, subroot, root) of every node of a forest."""
    if nodes.count() <= TOP:
        return F.broadcast(_top(nodes))
    if nodes.filter("n > 1").isEmpty():  # every source is at its root: they are one tree's nodes
        one = _numbered(keep, nodes.select(F.col("tree").alias("label"), "h"), F.lit(None).cast("string"), ["label"])
        up = keep.put(_roots(one), "roots")
        found = keep.put(_paths(_with_above(one, _above(keep, up))), "paths")
        return found.select(F.col("label").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", F.lower(F.hex("h")).alias("subroot"), "root")
    up = keep.put(_roots(nodes), "roots")
    named = nodes.select("tree", "pos", "n", "h", F.to_json(F.struct("tree", "pos")).alias("label"))
    found = keep.put(_paths(_with_above(named, _above(keep, up))), "paths")
    key = F.from_json("label", "tree string, pos bigint")
    return found.select(key["tree"].alias("tree"), key["pos"].alias("pos"), "path", "subroot", "root")


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "source", order: str = "doc_id", received: dict[str, Column] | None = None, tampered: Column | None = None) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    The proof of a row is the list of its siblings up to the root. ``received`` holds what columns
    have become where ``tampered`` is true; such rows are folded from the leaf of these values.
    """
    keep = Scratch(docs.sparkSession, "merkle")
    values = {c: F.col(c) for c in columns}
    bad = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    other = F.when(bad, leaf_of(list((values | (received or {})).values())))
    leaves = keep.put(docs.select(F.col(order).alias("label"), F.col(tree).cast("string").alias("source"), leaf_of(list(values.values())).alias("h"), other.alias("other")), "leaves")
    nodes = _numbered(keep, leaves, F.col("source"), ["label", "h"]).drop("source")
    above = _above(keep, keep.put(_roots(nodes), "roots"))

    def work(rows, tree):
        head = rows[0]
        upper = [(s["l"], s["r"]) for s in head["path"]]
        out = []
        for i, r in enumerate(rows):
            path, leaf = siblings(tree, i) + upper, r["h"].hex()
            folded = fold(leaf if r["other"] is None else r["other"].hex(), path)
            out.append({"label": r["label"], "leaf": leaf, "subroot": head["subroot"], "root": head["root"], "proof_sha256": digest("".join(a + b for a, b in path)), "folded_root": folded, "verified": folded == head["root"]})
        return out

    done = _climb(_with_above(nodes, above), work, "label string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return done.withColumnRenamed("label", order)
