"""Toxicity from the nearest labelled examples.

The labelled examples are a bounded sample (``per_class`` of either label, chosen by a hash of
the id). The vocabulary is every word and word beginning in it. Weights are tf-idf with document
frequencies of all documents; terms that are markedly more frequent in toxic examples count
``MARKED`` times. The examples form a block-max inverted index. Alike examples (by a few rounds of
spherical k-means, mostly those of one language) stand in one block of at most ``BLOCK``. Rare
terms have postings, which a query adds up first. Terms that many examples share are rows of each
block's matrix; what they can add there is bounded by the rows' largest weights, and by the length
of the query's part in them and the greatest length of an example's. A block is multiplied only if
its largest sum so far and the lesser bound together could still reach the k nearest known from
the query's first block. Every example with a term is found by its own text and nothing is cut off: the k
nearest are exact (cosines closer than 1e-5 are ties). A query's length counts its terms in the
vocabulary. The neighbours' votes count by closeness and by how many labelled rows an example
stands for; leave-one-out votes of the examples themselves calibrate the score. The examples' ids
are the evidence.

The index travels to the executors; its size is bounded by the sample, not by the corpus.

Defined results: null or empty text, or text without any term of any example, gets the rate
of toxic labels among examples without terms, and no evidence; without any label the score is 0;
labels that are null or name no document count for nothing; repeated label rows of one document
count once, toxic if any is; a null doc_id is not held out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_LETTER, Scratch, blocks, map_texts, whole_text, word_hashes

#: Examples of either label at most; the bound of the sample.
PER_CLASS = 5000
#: Queries that meet the index at once.
BATCH = 512
#: Clusters of alike examples, and examples of a block at most.
CLUSTERS, BLOCK = 12, 4096
#: A term of more examples than the square root of this many times all examples is a row of the blocks' matrices.
COMMON = 32
#: Blocks of a query that are multiplied before any bound is known.
FIRST = 1
#: How much more a marked term weighs.
MARKED = 4.0
#: Bytes of the word beginnings that are terms too.
BEGINNINGS = (4, 5)
NEIGHBOURS = 15


def text_terms(texts: list[str], vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of letter-run terms; with a sorted vocabulary, only its terms, as places in it."""
    hashes, first, *_ = word_hashes(texts, lower=True, space=NO_LETTER, prefix_bytes=BEGINNINGS)
    owner = np.repeat(np.arange(len(texts)), first[1:] - first[:-1])
    if vocabulary is not None:
        if not len(vocabulary):
            hashes = hashes[:0]
        else:  # each different word of the batch is looked up once
            place, found = pd.factorize(hashes.ravel())
            at = np.searchsorted(vocabulary, found)
            at[at == len(vocabulary)] = 0
            hashes = np.where(vocabulary[at] == found, at, -1)[place].reshape(hashes.shape)
    rows = [owner if vocabulary is None else owner[h >= 0] for h in hashes]
    terms = [h if vocabulary is None else h[h >= 0] for h in hashes]
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    row, term = np.concatenate(rows), np.concatenate(terms)
    if vocabulary is not None:
        place, both = pd.factorize(row * len(vocabulary) + term)
        order, times = np.argsort(both), np.bincount(place, minlength=len(both))
        return both[order] // len(vocabulary), both[order] % len(vocabulary), times[order]
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else np.zeros(0, int)
    return row[fresh], term[fresh], np.diff(np.concatenate([fresh, [len(row)]]))


def marked(a: np.ndarray, b: np.ndarray, n_toxic: int, n_clean: int, least: int = 4, lift: float = 4.0, surprise: float = 12.0) -> np.ndarray:
    """Whether terms, in ``a`` toxic and ``b`` other examples, are much more frequent in toxic ones."""
    total = max(n_toxic + n_clean, 1)
    gain = 2 * a * np.log(np.maximum(a, 1) * total / (np.maximum(a + b, 1) * max(n_toxic, 1)))
    return (a >= least) & (a / max(n_toxic, 1) >= lift * (b + 0.5) / (n_clean + 1)) & (gain >= surprise)


def by_text(texts: list[str], vocabulary: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places in the vocabulary and times of each text's terms."""
    row, term, times = text_terms(texts, vocabulary)
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    return [(term[a:b], times[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Index:
    """Examples by term, and what turns votes into scores."""

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray  # of examples that have a term
    toxic: np.ndarray
    weight: np.ndarray  # labelled rows that an example stands for
    starts: np.ndarray  # [term + 1]: places of postings
    docs: np.ndarray
    times: np.ndarray
    none: float = 0.0  # score of texts without terms
    prior: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def ready(self) -> Index:
        """Weights of the postings, and the blocks; made where they are used, so that they do not travel."""
        if not hasattr(self, "blocks"):
            n = len(self.ids)
            values = (1 + np.log(self.times, dtype=np.float32)) * np.repeat(self.idf.astype(np.float32), np.diff(self.starts))
            values /= np.maximum(np.sqrt(np.bincount(self.docs, values**2, n)), 1e-12).astype(np.float32)[self.docs]
            df = np.diff(self.starts)
            common = np.flatnonzero(df**2 > COMMON * n)
            dense = np.zeros((len(common), n), np.float32)
            for i, t in enumerate(common):
                at = slice(self.starts[t], self.starts[t + 1])
                dense[i, self.docs[at]] = values[at]
            self.row = np.full(len(self.vocabulary), -1, np.int32)
            self.row[common] = np.arange(len(common))
            order, cuts = _alike(dense)
            # examples are numbered anew, block by block
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            self.ids, self.toxic, self.weight = self.ids[order], self.toxic[order], self.weight[order]
            self.blocks = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = dense[:, order[a:b]]
                there = np.flatnonzero(part.any(1))
                part = np.ascontiguousarray(part[there])
                self.blocks.append((a, b, there, part, part.max(1, initial=0), np.sqrt((part**2).sum(0).max(initial=0))))
            rare = np.repeat(self.row < 0, df)
            self.docs, self.values = place[self.docs[rare]].astype(self.docs.dtype), values[rare]
            self.starts = np.concatenate([[0], np.cumsum(np.where(self.row < 0, df, 0))])
        return self

    def vector(self, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A text's terms and their unit-length tf-idf weights."""
        value = (1 + np.log(times)) * self.idf[term]
        return term, value / max(np.sqrt((value**2).sum()), 1e-12)

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.vector(*x) for x in by_text(texts, self.vocabulary)]

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest, ties by place; exact. ``skip`` leaves one example out."""
        return next(self.search([(terms, values)], k, [skip]))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None):
        """What nearest() returns, for each query."""
        n = len(self.ready().ids)
        for at in range(0, len(queries), BATCH):
            part = queries[at : at + BATCH]
            dense, scores = np.zeros((len(part), int(self.row.max(initial=-1)) + 1), np.float32), np.zeros((len(part), n), np.float32)
            for i, (t, v) in enumerate(part):
                row = self.row[t]
                common = row >= 0
                dense[i, row[common]] = v[common]
                self._add(scores[i], t[~common], v[~common])
            reach = np.zeros((len(part), len(self.blocks)))
            if self.blocks:
                reach = np.maximum.reduceat(scores, [b[0] for b in self.blocks], axis=1).astype(float)
                length = np.sqrt((dense.astype(float) ** 2).sum(1))
                reach += np.stack([np.minimum(dense[:, there] @ top, length * longest) for _, _, there, _, top, longest in self.blocks], axis=1)
            wanted, least = np.zeros(reach.shape, bool), np.zeros(len(part))
            near = np.argsort(-reach, axis=1)[:, :FIRST]
            np.put_along_axis(wanted, near, True, 1)
            first = wanted.copy()
            for turn in (0, 1):
                for j, (a, b, there, matrix, *_) in enumerate(self.blocks):
                    q = np.flatnonzero(wanted[:, j])
                    if len(q):
                        scores[q, a:b] += dense[np.ix_(q, there)] @ matrix
                if turn == 0:
                    for i in range(len(part)):  # one more than k, as one example may be skipped
                        seen = np.concatenate([scores[i, self.blocks[j][0] : self.blocks[j][1]] for j in near[i]]) if self.blocks else scores[i]
                        least[i] = np.partition(seen, len(seen) - k - 1)[len(seen) - k - 1] if len(seen) > k else 0
                    wanted = (reach > least[:, None] - 1e-4) & ~first
            for i in range(len(part)):
                score = scores[i]
                if skip is not None and skip[at + i] >= 0:
                    score[skip[at + i]] = 0
                lowest = np.partition(score, n - k)[n - k] - 2e-5 if n > k else 0.0
                best = np.flatnonzero(score > max(lowest, 1e-9))
                best = best[np.lexsort((best, -np.round(score[best], 5)))[:k]]
                yield best, score[best].astype(float)

    def _add(self, score: np.ndarray, t: np.ndarray, v: np.ndarray) -> None:
        """Add the postings of terms to a row of scores."""
        if len(t):
            a, m = self.starts[t], self.starts[t + 1] - self.starts[t]
            rows = np.repeat(a - np.cumsum(m) + m, m) + np.arange(m.sum())
            score += np.bincount(self.docs[rows], np.repeat(v, m) * self.values[rows], len(score))

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic votes; a near example counts more, and one vote at large goes to the prior."""
        w = self.weight[best] / (1.05 - np.minimum(cosine, 1.0))
        lone = self.weight.min() if len(self.weight) else 1.0
        return float(((w * self.toxic[best]).sum() + lone * self.prior) / (w.sum() + lone))

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * _logit(vote) + self.shift))))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _alike(dense: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, list[int]]:
    """An order in which alike columns stand together, and the cuts between blocks."""
    n = dense.shape[1]
    if not n:
        return np.zeros(0, np.int64), []
    seeds = [0]
    near = dense[:, 0] @ dense
    while len(seeds) < min(CLUSTERS, n):  # each seed is the column least like those before
        seeds.append(int(near.argmin()))
        near = np.maximum(near, dense[:, seeds[-1]] @ dense)
    centres = dense[:, seeds]
    for _ in range(rounds):
        own = (centres.T @ dense).argmax(0)
        centres = np.stack([dense[:, own == c].sum(1) for c in range(len(seeds))], axis=1)
        centres /= np.maximum(np.sqrt((centres**2).sum(0)), 1e-12)
    order = np.argsort(own, kind="stable")
    cuts = [0]
    for size in np.bincount(own, minlength=len(seeds)):
        end = cuts[-1] + int(size)
        parts = -(-int(size) // BLOCK)
        start = cuts[-1]
        cuts += [start + (end - start) * i // parts for i in range(1, parts + 1)] if parts else []
    return order, cuts


def build_index(ids: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, weight: np.ndarray, vocabulary: np.ndarray, frequency: np.ndarray, total: int, factor: np.ndarray | float = 1.0) -> Index:
    """Index labelled examples; frequency holds the terms' document counts in the corpus, factor what else weighs them."""
    idf = np.log(1 + total / np.maximum(frequency, 1)) * factor
    index = Index(vocabulary, idf, ids, toxic, weight, *(np.zeros(0, np.int64),) * 3)
    has = np.array([len(t) > 0 for t, _ in terms], dtype=bool)
    bare = ~has
    index.none = float((weight[bare] * toxic[bare]).sum() / max(weight[bare].sum(), 1e-12)) if bare.any() else 0.0
    index.prior = float((weight * toxic).sum() / max(weight.sum(), 1e-12)) if len(weight) else 0.0
    terms = [x for x, h in zip(terms, has, strict=True) if h]
    index.ids, index.toxic, index.weight = ids[has], toxic[has].astype(float), weight[has]
    if not terms:
        terms = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    term, times = np.concatenate([t for t, _ in terms]), np.concatenate([n for _, n in terms])
    order = np.argsort(term, kind="stable")  # by term, then by example
    index.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
    index.docs = np.repeat(np.arange(len(terms), dtype=np.min_scalar_type(len(terms))), [len(t) for t, _ in terms])[order]
    index.times = times[order]
    return index


def _calibrate(index: Index, votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 200) -> None:
    """Logistic calibration of leave-one-out votes, held near the identity by a small penalty."""
    if not 0 < toxic.sum() < len(votes):
        return
    x, y, w = _logit(votes), toxic, weight / weight.sum()
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * x + b)))
        ga, gb = (w * (p - y) * x).sum() + 0.01 * (a - 1), (w * (p - y)).sum() + 0.01 * b
        h = w * p * (1 - p)
        haa, hab, hbb = (h * x * x).sum() + 0.01, (h * x).sum(), h.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(a - np.clip(da, -1, 1), 0.05), b - np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-10:
            break
    index.slope, index.shift = float(a), float(b)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, evidence) of every document.

    Labels are learned only from rows whose crc32 of the id as text is not 2 modulo 4.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(~held_out & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # a bounded sample of either label: at most 2 * per_class ids come to the driver, and no text
    chosen = [r for label in (0, 1) for r in known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    picked = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], known.schema)
    sampled = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    examples = Scratch(spark, "toxicity").put(sampled, "examples")
    n_by = {label: sum(r["toxic"] == label for r in chosen) for label in (0, 1)}

    def example_terms(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for cut in blocks(texts):
                row, term, times = text_terms(texts[cut])
                cuts = np.searchsorted(row, np.arange(1, len(texts[cut])))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[cut], "toxic": pdf["toxic"].iloc[cut], "terms": np.array([*map(np.ndarray.tobytes, np.split(term.astype(np.uint64), cuts))], object), "times": np.array([*map(np.ndarray.tobytes, np.split(times.astype(np.int32), cuts))], object)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = examples.mapInPandas(example_terms, f"doc_id {kind}, toxic int, terms binary, times binary").toLocalIterator()  # a partition at a time
    rows = sorted(((r["doc_id"], r["toxic"], np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["times"], np.int32)) for r in found), key=lambda r: r[0])
    ids = np.array([r[0] for r in rows], dtype=object)
    toxic = np.array([r[1] == 1 for r in rows], dtype=bool)
    weight = np.array([sizes[r[1]] / n_by[r[1]] for r in rows], dtype=float)
    vocabulary = np.unique(np.concatenate([r[2] for r in rows])) if rows else np.zeros(0, np.uint64)
    terms = [(np.searchsorted(vocabulary, r[2]).astype(np.int32), r[3]) for r in rows]
    del rows
    a, b = (np.zeros(len(vocabulary), np.int64) for _ in range(2))
    for (t, _), bad in zip(terms, toxic, strict=True):
        (a if bad else b)[t] += 1
    factor = np.where(marked(a, b, n_by[1], n_by[0]), MARKED, 1.0)
    known_terms = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        vocabulary = known_terms.value
        n, total = np.zeros(len(vocabulary), np.int64), 0
        for pdf in batches:
            everything = pdf["text"].tolist()
            for cut in blocks(everything):
                n += np.bincount(text_terms(everything[cut], vocabulary)[1], minlength=len(vocabulary))
                total += len(everything[cut])
        seen = np.flatnonzero(n)
        yield pd.DataFrame({"place": [-1], "n": [total]})
        for at in range(0, len(seen), 1 << 16):
            yield pd.DataFrame({"place": seen[at : at + (1 << 16)], "n": n[seen[at : at + (1 << 16)]]})

    counted = docs.select("text").mapInPandas(frequencies, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    where, n = counted["place"].to_numpy(), counted["n"].to_numpy()
    frequency = np.zeros(len(vocabulary), np.int64)
    frequency[where[where >= 0]] = n[where >= 0]
    index = build_index(ids, terms, toxic, weight, vocabulary, frequency, int(n[where < 0].sum()), factor)
    del terms
    shared = spark.sparkContext.broadcast(index)
    examples_known = len(index.ids) > 0

    def left_out(batches):
        index = shared.value.ready()
        place = {x: i for i, x in enumerate(index.ids.tolist())}
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for cut in blocks(texts):
                own = [place.get(x, -1) for x in ids[cut]]
                found = list(index.search(index.vectors(texts[cut]), k, own))
                kept = [i for i, p in enumerate(own) if p >= 0]
                yield pd.DataFrame({"vote": [index.vote(*found[i]) for i in kept], "toxic": [index.toxic[own[i]] for i in kept], "weight": [index.weight[own[i]] for i in kept]})

    if examples_known:
        spread = examples.select("doc_id", "text").repartition(max(len(index.ids) // 250, 1), "doc_id")
        voted = spread.mapInPandas(left_out, "vote double, toxic double, weight double").toPandas().sort_values(["vote", "toxic", "weight"])  # bounded by the sample
        _calibrate(index, *(voted[c].to_numpy() for c in ("vote", "toxic", "weight")))
    slope, shift = index.slope, index.shift

    def make():
        index, cache = shared.value, {}
        index.slope, index.shift = slope, shift

        def work(texts):
            vectors = index.vectors(texts)
            keys = [hashlib.blake2b(t.tobytes() + v.tobytes(), digest_size=16).digest() for t, v in vectors]
            new = {key: i for i, key in enumerate(keys) if key not in cache}
            found = {}
            for key, (best, cosine) in zip(new, index.search([vectors[i] for i in new.values()], k), strict=True):
                found[key] = (index.score(index.vote(best, cosine)), [str(x) for x in index.ids[best]]) if len(best) else (index.none, [])
            found = [found[key] if key in found else cache[key] for key in keys]
            if len(cache) > 10_000:
                cache.clear()
            cache.update(zip(keys, found, strict=True))
            return None, ([s for s, _ in found], [e for _, e in found])

        return work

    scored = map_texts(docs, make, "score double, evidence array<string>")
    return scored.select("doc_id", held_out.alias("held_out"), "score", "evidence")
