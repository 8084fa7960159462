"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents with equal
sets are one node from the start, so exact copies never meet in a join. Nodes fall into size
bands such that linked sets lie in one band or in neighbouring ones; a set takes part in its own
band and in the next. In a band whose largest size is r, linked sets differ in at most
k = floor(2 r (1-t) / (1+t)) elements.

First level (PartEnum): the feature domain is hashed into floor(k/2) + g parts and each part into
three cells. k differences leave at least g parts with one difference or none, so such a part has
two equal cells: of its three signatures, one for each subset of two cells, linked sets share
one at least. A set has 3 (floor(k/2) + g) signatures in a band, with g = 2 + floor(k/8): under
1.9 k + 9, whatever the set holds. Linked sets share signatures in g different parts, so a node
that shares some in fewer parts, with anyone, is linked with nothing and goes. (An empty subset
is no signature; a node's need falls by one for each part that has one. Nodes without any need
left go on to the second level at once.) Signatures travel in packed blocks, and a signature that
several nodes of a block hold travels once. Each node that stays is compared with one hub, the
node of its signatures that shares the most parts: that joins the large groups of near copies.

Second level (the finest partitions, single features, for the nodes that stay): a set of n
elements and a linked one share one at least of either's n - ceil(t n) + 1 rarest elements in
the nodes that are left. So passages that many documents share never bring them together here
unless they make up nearly all of a document. Members of such an element and band are compared
with a hub, twice, each with nodes of other components only; groups that still hold several
components are compared across those in bounded lists, by sketches.

A sketch holds 256 counts of elements by hash: summed differences of two sketches never exceed the
sets' difference, so a pair whose sketches lie too far apart cannot be linked. What passes has
its sets brought together. Every pair that shares a second-level element is thus compared
exactly, excluded by an exact bound or already in one component: no link between components is
lost and none is capped.

Defined results: null or empty text has n_shingles 0 and is linked with nothing; fewer than n
words make one shingle of the whole sequence; equal rows stay separate rows of one component;
a null doc_id never names a component while another doc_id is there; columns of the input
other than the id and the text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import U64, Scratch, blocks, give_back, mix, salted_join, stream, whole_text, word_hashes

#: Bytes of packed signatures that one task sorts at a time.
BUCKET_BYTES = 8_000_000
#: Characters whose signatures a task makes at a time.
BLOCK = 1 << 20
#: Lists of at most so many nodes are compared by one task; larger groups are dealt into several.
GROUP = 2000
#: Up to so many ids travel to all executors when texts are fetched (16 bytes each); more are joined.
FETCH = 500_000
_COMBINE = stream(23, 64) | U64(1)
_BAND = stream(41, 4096)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    h, first, *_ = word_hashes(texts, lower=True)
    with np.errstate(over="ignore"):
        if len(h) >= n:
            grams = np.zeros(len(h) - n + 1, U64)
            for j in range(n):
                grams += h[j : len(h) - n + 1 + j] * _COMBINE[j]
            grams = mix(grams)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                out.append(mix((h[a:b] * _COMBINE[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
            else:
                out.append(np.zeros(0, U64))
    return out


def digest(s: np.ndarray) -> int:
    """A set's node: equal sets, equal nodes; 0 is the empty set alone."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        d = mix(mix(s ^ U64(0x632BE59BD9B4E019)).sum(dtype=U64, keepdims=True) + U64(len(s)))[0]
    return int(d.view(np.int64)) or 1


class Bands:
    """Size bands of a threshold num/den and the largest difference in each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.high = [1], [den // num]

    def reach(self, size: int) -> None:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.den * self.low[-1] // self.num)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.reach(int(sizes.max(initial=1)))
        return np.searchsorted(self.high, sizes)

    def largest(self, band: np.ndarray) -> np.ndarray:
        while len(self.high) <= band.max(initial=0):
            self.reach(self.high[-1] + 1)
        return 2 * np.array(self.high)[band] * (self.den - self.num) // (self.den + self.num)


def signatures(sets: list[np.ndarray], bands: Bands, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First-level signatures of many sets, in their own band (ahead 0) or the next one (1).

    Returns (owner, signature, part, need): places of the sets, 64-bit signatures, part numbers
    modulo 256, and for each set in how many parts (modulo 256) linked sets share signatures.
    A need of 0 says that empty subsets take up all of them, a negative one that nothing but an
    equal set can be linked.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    band = bands.of(sizes) + ahead
    k = np.where(sizes > 0, bands.largest(band), 0)
    spare = np.where(k > 0, 2 + k // 8, 0)
    parts = np.where(k > 0, k // 2 + spare, 0)
    first = np.concatenate([[0], np.cumsum(3 * parts)])
    with np.errstate(over="ignore"):
        key = _BAND[band % len(_BAND)] + (band // len(_BAND)).astype(U64)
        x = np.concatenate([*sets, np.zeros(0, U64)])
        at = np.repeat(np.arange(len(sets)), sizes)
        if not parts.all():
            live = parts[at] > 0
            x, at = x[live], at[live]
        h = mix(x ^ key[at])
        cell = first[at] + (((h >> U64(32)) * (3 * parts[at]).astype(U64)) >> U64(32)).astype(np.int64)
        sums = np.zeros(first[-1], U64)
        np.add.at(sums, cell, mix(h + U64(0x1F83D9ABFB41BD6B)))
        count = np.bincount(cell, minlength=first[-1]).reshape(-1, 3)
        sums = sums.reshape(-1, 3)
        # each part's three subsets of two cells
        value = (sums.sum(1, dtype=U64)[:, None] - sums).ravel()
        empty = count.sum(1)[:, None] == count
        owner = np.repeat(np.arange(len(sets)), 3 * parts)
        place = np.arange(first[-1]) - first[owner]
        sig = mix(mix(value + key[owner]) + place.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    lost = np.bincount(owner[::3], weights=empty.any(1), minlength=len(sets)).astype(np.int64)
    folds = np.maximum(1, -(-parts // 256))
    need = np.where(k > 0, -(-np.maximum(spare - lost, 0) // folds), -1)
    there = ~empty.ravel()
    return owner[there], sig[there], (place[there] // 3) & 255, need


_ROWS = [StructField("bucket", IntegerType()), StructField("node", LongType()), StructField("n_shingles", LongType()), StructField("a", BinaryType()), StructField("b", BinaryType())]
_SHARED = [StructField("node", LongType()), StructField("n_shingles", LongType()), StructField("sig", LongType()), StructField("tag", IntegerType())]


def _pack(n: int, num: int, den: int, buckets: int, schema: StructType):
    """A row for each document, and packed signatures by bucket.

    A packed row has in ``a`` the signatures' upper 6 bytes each, their parts, and the places of
    their nodes; in ``b`` the nodes with their needs. Signatures that several nodes of a block hold
    come whole in a row without such a head as well.
    """
    arrow = to_arrow_schema(schema)

    def run(batches):
        bands = Bands(num, den)
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("text")).to_pylist()
            for cut in blocks(texts, BLOCK):
                sets = shingle_sets(texts[cut], n)
                nodes = np.array([digest(s) for s in sets], dtype=np.int64)
                count = len(sets)
                own = ids.slice(cut.start, count).cast(arrow.field("doc_id").type)
                none = pa.nulls(count, pa.binary())
                yield pa.RecordBatch.from_arrays([own, pa.array((nodes.view(U64) % U64(buckets)).astype(np.int32)), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), none, none], schema=arrow)
                once = np.unique(nodes, return_index=True)[1]
                once = once[nodes[once] != 0]
                rows = _blocks([sets[i] for i in once], nodes[once], bands, buckets)
                if rows:
                    bucket, a, b = zip(*rows, strict=True)
                    count = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.nulls(count, own.type), pa.array(bucket, pa.int32()), pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=arrow)
        give_back()

    return run


def _blocks(sets: list[np.ndarray], nodes: np.ndarray, bands: Bands, buckets: int) -> list[tuple[int, bytes, bytes]]:
    if not sets:
        return []
    found = [signatures(sets, bands, ahead) for ahead in (0, 1)]
    needs = np.stack([f[3] for f in found], axis=1)
    owner = np.concatenate([2 * found[0][0], 2 * found[1][0] + 1])  # twice the place, plus the band
    sig, part = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]).astype(np.uint8)
    order = np.argsort(sig, kind="stable")
    sig, owner, part = sig[order], owner[order], part[order]
    tag = (np.maximum(needs.ravel()[owner], 0).astype(np.int32) << 9) | (part.astype(np.int32) << 1) | (owner & 1).astype(np.int32)
    fresh = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    alone = np.concatenate([fresh[1:], [True]]) & fresh
    rows = []
    loose = np.flatnonzero((needs == 0).any(1))
    if len(loose) or not alone.all():
        whole = np.concatenate([np.zeros(len(loose), U64), sig[~alone] >> U64(16)])
        who = np.concatenate([nodes[loose], nodes[owner[~alone] >> 1]])
        tags = np.concatenate([np.zeros(len(loose), np.int32), tag[~alone]])
        rows.append((int(who[0].view(U64) % U64(buckets)), b"", whole.tobytes() + who.tobytes() + tags.tobytes()))
    sig, owner, tag = sig[fresh], owner[fresh], tag[fresh]
    bucket = ((sig >> U64(32)) * U64(buckets)) >> U64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
    upper = sig.view(np.uint8).reshape(-1, 8)[:, 2:]
    parts = ((tag >> 1) & 255).astype(np.uint8)
    for i in np.flatnonzero(np.diff(cuts)):
        x, y = cuts[i], cuts[i + 1]
        own, place = np.unique(owner[x:y], return_inverse=True)
        place = place.astype(np.uint32 if len(own) > 65535 else np.uint16)
        head = np.array([y - x, len(own), place.itemsize, 0], dtype=np.int32).tobytes()
        about = ((np.maximum(needs.ravel()[own], 0).astype(np.int32) << 9) | (own & 1).astype(np.int32)).tobytes()
        rows.append((int(i), head + upper[x:y].tobytes() + parts[x:y].tobytes() + place.tobytes(), nodes[own >> 1].tobytes() + about))
    return rows


def _meet(schema: StructType):
    """Of one bucket: the documents' rows, and the members of signatures that several nodes hold."""
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        a, b = table.column("a"), table.column("b")
        plain = table.filter(pa.compute.is_null(b))
        sigs, nodes, tags, ready = [], [], [], ([], [], [])
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if y is None:
                continue
            if not x:
                m = len(y) // 20
                for to, at, kind in ((0, 0, np.int64), (1, 8 * m, np.int64), (2, 16 * m, np.int32)):
                    ready[to].append(np.frombuffer(y, kind, m, at))
                continue
            m, own, width, _ = np.frombuffer(x, np.int32, 4)
            wide = np.zeros((m, 8), np.uint8)
            wide[:, :6] = np.frombuffer(x, np.uint8, 6 * m, 16).reshape(-1, 6)
            place = np.frombuffer(x, f"u{width}", m, 16 + 7 * m)
            sigs.append(wide.view(np.int64).ravel())
            nodes.append(np.frombuffer(y, np.int64, own)[place])
            tags.append(np.frombuffer(y, np.int32, own, 8 * own)[place] | (np.frombuffer(x, np.uint8, m, 16 + 6 * m).astype(np.int32) << 1))
        if sigs:
            s, v, g = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(tags)
            order = np.argsort(s, kind="stable")
            s, v, g = s[order], v[order], g[order]
            begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            shared = np.repeat(np.minimum.reduceat(v, begin) != np.maximum.reduceat(v, begin), np.diff(np.concatenate([begin, [len(s)]])))
            for to, values in zip(ready, (s, v, g), strict=True):
                to.append(values[shared])
        s, v, g = (np.concatenate([*r, np.zeros(0, k)]) for r, k in zip(ready, (np.int64, np.int64, np.int32), strict=True))
        ids = pa.chunked_array([*plain.column("doc_id").chunks, pa.nulls(len(s), arrow.field("doc_id").type)], arrow.field("doc_id").type)
        del sigs, nodes, tags, ready
        give_back()
        gap, old = pa.nulls(len(s), pa.int64()), len(plain)
        columns = [ids, *(pa.chunked_array([*plain.column(c).chunks, new], pa.int64()) for c, new in (("node", pa.array(v)), ("n_shingles", gap)))]
        return pa.Table.from_arrays([*columns, pa.chunked_array([pa.nulls(old, pa.int64()), pa.array(s)]), pa.chunked_array([pa.nulls(old, pa.int32()), pa.array(g)])], schema=arrow)

    return run


def sketch(s: np.ndarray) -> bytes:
    """How many elements fall to each of 256 values of a hash, at most 255."""
    return np.minimum(np.bincount((mix(s) >> U64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _sets(n: int, num: int, den: int):
    def run(batches):
        bands = Bands(num, den)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for cut in blocks(texts):
                sets = shingle_sets(texts[cut], n)
                band = bands.of(np.array([len(s) for s in sets], dtype=np.int64))
                keep = [(v, len(s), int(b), sketch(s), s.view(np.int64)) for v, s, b in zip(pdf["node"].iloc[cut], sets, band, strict=True) if digest(s) == v]
                yield pd.DataFrame(keep, columns=["node", "n", "band", "sketch", "elements"])
        give_back()

    return run


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a.astype(np.int16) - b).sum(1, dtype=np.int64)


def _rows(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 256)


def _near(num: int, den: int):
    """Drop pairs whose sketches are too far apart."""

    def run(batches):
        for pdf in batches:
            ok = np.zeros(len(pdf), bool)
            for at in range(0, len(pdf), 4096):
                p = pdf.iloc[at : at + 4096]
                ok[at : at + 4096] = _far(_rows(p["sa"]), _rows(p["sb"])) * (den + num) <= (den - num) * (p["na"] + p["nb"]).to_numpy()
            yield pdf.loc[ok, ["a", "b"]]

    return run


def _across(num: int, den: int):
    """Of small groups: the pairs of different components whose sizes and sketches allow a link."""

    def run(batches):
        for pdf in batches:
            found = [np.zeros((0, 2), np.int64)]
            for group in pdf["g"]:
                node, root, n = (np.array([x[c] for x in group], dtype=np.int64) for c in ("node", "root", "n"))
                rows = _rows([x["sketch"] for x in group])
                # the largest component's members come last: they are not compared with each other
                _, place, size = np.unique(root, return_inverse=True, return_counts=True)
                order = np.argsort(place == size.argmax(), kind="stable")
                node, root, n, rows = node[order], root[order], n[order], rows[order]
                for i in range(len(node) - size.max()):
                    open_pair = root[i + 1 :] != root[i]
                    open_pair &= np.abs(n[i + 1 :] - n[i]) * (den + num) <= (den - num) * (n[i + 1 :] + n[i])
                    j = i + 1 + np.flatnonzero(open_pair)
                    j = j[_far(rows[j], rows[i].astype(np.int16)) * (den + num) <= (den - num) * (n[j] + n[i])]
                    found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def components(spark: SparkSession, edges: DataFrame, keep: Scratch) -> DataFrame:
    """(node, root) of every node with an edge (a, b): alternating large and small stars.

    Each pass is two grouped minima and two joins; roots are the smallest nodes.
    """
    now = keep.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = keep.put(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        keep.drop(now)
        now = new
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


class _Links:
    """Components found so far: each node with a link, and its root."""

    def __init__(self, spark: SparkSession, keep: Scratch, sets: DataFrame, num: int, den: int):
        self.spark, self.keep, self.sets, self.num, self.den = spark, keep, sets, num, den
        self.roots = None

    def side(self, name: str, *columns: str) -> DataFrame:
        return self.sets.select(F.col("node").alias(name), *[F.col(c).alias(c[0] + name) for c in columns]).hint("merge")

    def rooted(self, df: DataFrame) -> DataFrame:
        """df with the root of its node, itself if it has no link yet."""
        if self.roots is None:
            return df.withColumn("root", F.col("node"))
        return df.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def near(self, pairs: DataFrame) -> DataFrame:
        both = pairs.join(self.side("b", "n", "sketch"), "b").join(self.side("a", "n", "sketch"), "a")
        return both.select("a", "b", "na", "nb", "sa", "sb").mapInPandas(_near(self.num, self.den), "a bigint, b bigint")

    def add(self, pairs: DataFrame) -> None:
        """Compare the sets of pairs; linked ones join their components."""
        both = pairs.join(self.side("b", "elements"), "b").join(self.side("a", "elements"), "a")
        shared, total = F.size(F.array_intersect("ea", "eb")), F.size("ea") + F.size("eb")
        found = self.keep.put(both.filter(self.den * shared >= self.num * (total - shared)).select("a", "b"), "links")
        if found.isEmpty():
            return
        if self.roots is not None:  # only the roots that the new links bring together
            a = self.roots.withColumnsRenamed({"node": "a", "root": "ra"})
            b = self.roots.withColumnsRenamed({"node": "b", "root": "rb"})
            found = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        new = components(self.spark, found, self.keep)
        new = new.union(new.select(F.col("root").alias("node"), "root")).distinct()
        if self.roots is None:
            self.roots = self.keep.put(new, "roots")
            return
        moved = salted_join(self.roots, new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
        fresh = new.join(self.roots.select("node"), "node", "left_anti")
        old, self.roots = self.roots, self.keep.put(moved.select("node", F.coalesce("to", "root").alias("root")).union(fresh.select("node", "root")), "roots")
        self.keep.drop(old)


def ngram_join(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked when den*|A&B| >= num*|A|B|.

    component_id is the smallest id that links reach, the row's own included.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "ngram")
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    about = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, about * 2 // BUCKET_BYTES)
    id_field = docs.schema["doc_id"]
    rows, shared = StructType([id_field, *_ROWS]), StructType([id_field, *_SHARED])
    packed = docs.mapInArrow(_pack(n, num, den, buckets, rows), rows)
    both = keep.put(packed.groupBy("bucket").applyInArrow(_meet(shared), shared), "members")
    nodes = both.filter("sig is null").select("doc_id", "node", "n_shingles")
    members = both.filter("sig is not null").select("sig", "node", "tag")
    first = keep.put(nodes.filter("node <> 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "first")

    # a tag holds the need, the part and the band; a node stays if it shares as many parts as it needs
    parts = members.select("node", "tag").repartition("node").distinct()
    alive = parts.groupBy("node", F.expr("tag & 1").alias("band"), F.expr("tag >> 9").alias("need")).agg(F.count("*").alias("w")).filter("w >= need")
    alive = keep.put(alive.groupBy("node").agg(F.max("w").alias("w")), "alive")
    wanted = alive.join(first, "node")
    if alive.count() <= FETCH:
        wanted = F.broadcast(wanted)
    sets = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("node", "w", "text")
    sets = sets.select("node", "text").mapInPandas(_sets(n, num, den), "node bigint, n bigint, band int, sketch binary, elements array<bigint>")
    sets = keep.put(sets.dropDuplicates(["node"]), "sets")
    links = _Links(spark, keep, sets, num, den)

    live = keep.put(members.filter("sig <> 0").distinct().join(alive, "node").select("sig", "node", "w"), "live")
    hubs = live.groupBy("sig").agg(F.max(F.struct("w", "node")).alias("hub"), F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("sig", "hub")
    best = live.join(hubs, "sig").filter("node <> hub.node").groupBy("node").agg(F.max("hub").alias("hub"))
    links.add(links.near(best.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()))
    keep.drop(live)

    # second level: the rarest elements of what is left
    each = sets.select("node", "n", "band", F.explode("elements").alias("e"))
    counted = each.groupBy("e").agg(F.count("*").alias("c")).filter("c > 1")
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy("c", "e")) + F.col("n") - F.count("*").over(own)  # unshared elements come first
    # w: how many others hold a node's elements, in all; the middle of a group of near copies has the most
    ranked = each.join(counted, "e").withColumns({"place": place, "w": F.sum("c").over(own)})
    rare = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1)
    rare = keep.put(rare.select(F.explode(F.array("band", F.col("band") + 1)).alias("band"), "e", "node", "w"), "rare")
    for pick in (F.max, F.min):
        marked = links.rooted(rare)
        hubs = marked.groupBy("e", "band").agg(pick(F.struct("w", "node", "root")).alias("hub"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("e", "band", "hub")
        pairs = marked.join(hubs, ["e", "band"]).filter("root <> hub.root")
        links.add(links.near(pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()))

    marked = links.rooted(rare)
    groups = marked.groupBy("e", "band").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("i"))
    # many elements of a passage have the same members: one of them stands for all
    groups = groups.filter("r0 <> r1").groupBy("size", "h", "i").agg(F.min(F.struct("e", "band")).alias("k")).select("k.e", "k.band", "size")
    chunks = F.when(F.col("size") <= GROUP, 1).otherwise(F.ceil(F.col("size") / max(GROUP // 2, 1))).cast("int")
    open_ = marked.join(groups, ["e", "band"]).join(links.side("node", "n", "sketch").withColumnsRenamed({"nnode": "n", "snode": "sketch"}), "node").withColumn("chunks", chunks)
    # every two chunks of a larger group meet in a list of their own
    open_ = open_.withColumn("x", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    lists = open_.groupBy("e", "band", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.collect_list(F.struct("node", "root", "n", "sketch")).alias("g"))
    links.add(lists.select("g").mapInPandas(_across(num, den), "a bigint, b bigint").distinct())

    known = first
    if links.roots is not None:
        least = links.roots.join(first, "node").groupBy("root").agg(F.min("doc_id").alias("least"))
        named = salted_join(links.roots, least, "root", "left").select("node", "least")
        known = first.join(named, "node", "left").select("node", F.coalesce("least", "doc_id").alias("doc_id"))
    named = salted_join(nodes, known.withColumnRenamed("doc_id", "component_id"), "node", "left")
    out = named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    keep.drop(alive, sets, rare)
    return out
