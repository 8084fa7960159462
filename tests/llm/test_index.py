"""Manifest, decontamination and ranked search against brute force, at the edges and with small limits."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import FOLD, table

from riskweave.llm import decontaminate as leaks
from riskweave.llm import merkle, postings, ranked_search
from riskweave.llm.common import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "h", 1) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, pos int, h string, n int")


def manifest(rows, bad):
    """By the definition: levels of a source, then of the sources."""
    write = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(write, r)))
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    sources = list(dict.fromkeys(r[1] for r in order))

    def above(nodes):
        ways = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                first = p // 3 * 3
                ways[i].append((nodes[first:p], nodes[p + 1 : first + 3]))
            nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
        return nodes[0], ways

    trees = {s: above([leaf(r) for r in order if r[1] == s]) for s in sources}
    root, upper = above([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, upper, strict=True):
        for r, way in zip([r for r in order if r[1] == s], trees[s][1], strict=True):
            own = leaf(r)
            cur = leaf((*r[:4], r[4].replace("\n", "")) if bad(r[0]) and r[4] else r)
            for left, right in way + top:
                cur = sha("".join([*left, cur, *right]))
            out.append((r[0], own, trees[s][0], root, sha("".join(x for left, right in way + top for x in left + right)), cur, cur == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("block", "top"), [(3**7, 3**8), (3, 2), (9, 40), (3, 10_000)])
def test_merkle(spark, monkeypatch, block, top):
    """Small limits take the rounds over blocks, and over sources, to their ends."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "TOP", top)
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "hot", "hot", "hot", "é", None, *map(str, range(12))]), r.choice([None, "de"]), i if i % 3 else None, r.choice([None, "", "x\ny", "ü\n", "plain " * 50])) for i in range(120)]
    rows += [(None, "a", None, None, "no\nid"), (None, "a", None, None, "no\nid"), (5, "b", "en", 1, "same id\n"), (5, "b", "en", 1, "same id\n"), (900, "alone", None, None, "x\n")]
    docs = rows_of(spark, rows)
    out = merkle.merkle_manifest(docs, received={"text": F.translate("text", "\n", "")}, tampered=F.col("doc_id") % 2 == 0).collect()
    assert sorted(repr(tuple(x)) for x in out) == manifest(rows, lambda i: i is not None and i % 2 == 0)
    assert {x.verified for x in out} == {True, False}


def test_merkle_small(spark):
    assert merkle.merkle_manifest(rows_of(spark, [(1, "a", None, None, "x")]).limit(0)).count() == 0
    one = merkle.merkle_manifest(rows_of(spark, [(1, None, None, None, None)])).collect()
    assert len(one) == 1 and one[0].leaf == one[0].root == one[0].folded_root == sha("1:1----") and one[0].proof_sha256 == sha("") and one[0].verified
    assert merkle.levels(1) == 0 and merkle.levels(3) == 1 and merkle.levels(4) == 2 and merkle.levels(28) == 4


def test_pack():
    r = np.random.default_rng(1)
    for values in ([], [0], [127, 128, 16383, 16384, 2**40], r.integers(0, 2 ** r.integers(1, 45, 5000), 5000)):
        data, size = postings.pack(np.array(values, np.int64))
        assert postings.unpack(data).tolist() == list(values) and int(size.sum()) == len(data)
    assert postings.running_from(np.array([3, 1, 1, 5, 2]), np.array([2, 1, 2]), np.array([0, 10, -1])).tolist() == [3, 4, 11, 4, 6]


def corpus(seed=5, n=150):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "a"] * 15
    items = [" ".join(r.choice(words) for _ in range(r.choice([1, 4, 10, 11, 30]))) for _ in range(25)] + ["", "...", "Lone", "the the the the the the the the the the the the"]
    docs = [None, "", "  .. ", "LONE", "the " * 40, "w1-w2_w3"]
    for _ in range(n):
        t = [r.choice(words) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            at, own = r.randrange(len(t) + 1), r.choice(items).upper().split()
            cut = r.randrange(len(own) + 1) if r.random() < 0.3 else len(own)
            t[at:at] = own[:cut]
        docs.append(r.choice([" ", ", ", "\n"]).join(t))
    return docs + docs[10:20] + ["the of a " * 30_000], [*items, None]


def windows(item, size):
    w = terms(item)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("segment", "query", "candidates"), [(1 << 22, 4_000_000, 2_000_000), (300, 60, 7)])
def test_decontaminate(spark, monkeypatch, segment, query, candidates):
    """Small limits make many segments, blocks of items and slices of candidates."""
    monkeypatch.setattr(postings, "QUERY_CHARS", query)
    monkeypatch.setattr(leaks, "CANDIDATES", candidates)
    monkeypatch.setattr(leaks, "texts_of", lambda batches: postings.texts_of(batches, segment))
    docs, items = corpus()
    bench = spark.createDataFrame([(i % 28, t) for i, t in enumerate(items)], "item_id bigint, text string")
    sets = [windows(t, 10) for t in items]
    want = []
    for i, d in enumerate(docs):
        w, hit, found = terms(d), set(), set()
        for n in {len(g) for s in sets for g in s}:
            for at in range(len(w) - n + 1):
                own = [j % 28 for j, s in enumerate(sets) if tuple(w[at : at + n]) in s]
                if own:
                    found |= set(own)
                    hit |= set(range(at, at + n))
        want.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    out = leaks.decontaminate(table(spark, docs), bench)
    assert sorted(tuple(r)[:6] for r in out.collect()) == want
    assert sum(w[5] for w in want) > 30 and any(not w[5] for w in want)


def test_near_phrases(spark):
    """With a slop of 2 terms may stand two words away; documents do not run into each other."""
    phrase = "one two three four five six seven eight nine ten"
    docs = ["zero " + phrase.replace("five", "five so to"), phrase.replace("five", "five a b c"), phrase, "one two three four five", "six seven eight nine ten", phrase.replace("two", "other")]
    bench = spark.createDataFrame([("x", phrase)], "item_id string, text string")
    near = {r.doc_id: r for r in leaks.phrase_hits(table(spark, docs), bench, 10, 2).collect()}
    exact = {r.doc_id: r["items"] for r in leaks.phrase_hits(table(spark, docs), bench, 10).collect()}
    assert [bool(near[i]["items"]) for i in range(6)] == [True, False, True, False, False, False]
    assert [bool(exact[i]) for i in range(6)] == [False, False, True, False, False, False]
    with pytest.raises(ValueError, match="slop"):
        leaks.phrase_hits(table(spark, docs), bench, 10, 64)


def ranking(ids, docs, items, k):
    lists = [terms(d) for d in docs]
    n, total = sum(bool(x) for x in lists), sum(map(len, lists))
    df = {}
    for x in lists:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    out = []
    for j, item in enumerate(items):
        found = []
        for i, x in zip(ids, lists, strict=True):
            if x:
                m = 10 + (90 * len(x) * n) // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) * ((10**9 * x.count(t)) // (1000 * x.count(t) + 8 * m)) for t in set(terms(item)))
                if score > 0:
                    found.append((-score, i is not None, i or 0, i))
        out += [(j, rank + 1, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return out


@pytest.mark.parametrize(("segment", "block", "query"), [(1 << 22, 128, 4_000_000), (2000, 3, 200)])
def test_ranked_search(spark, monkeypatch, segment, block, query):
    """Small limits make many segments, blocks and groups of queries; copies make ties."""
    monkeypatch.setattr(postings, "QUERY_CHARS", query)
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "texts_of", lambda batches: postings.texts_of(batches, segment))
    docs, items = corpus(seed=8)
    docs += [docs[30]] * 40
    ids = [None if i == 60 else 3 * i % len(docs) for i in range(len(docs))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    out = ranked_search.ranked_search(table(spark, docs, ids), bench, 10)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, ranking(ids, docs, items, 10)))


def test_blocks_are_skipped():
    """A threshold leaves blocks compressed, and changes nothing about what reaches it."""
    r = np.random.default_rng(4)
    term, doc = np.repeat(np.arange(1, 4, dtype=np.uint64), 2000), np.tile(np.arange(2000), 3)
    tf, m = r.integers(1, 4, 6000), np.full(2000, 100)
    tf[[700, 2700, 4700]] = 40
    held = np.full(3, 2000, np.uint32)
    blocks = np.concatenate([np.arange(t * 2000, (t + 1) * 2000, ranked_search.BLOCK) for t in range(3)])
    tails = np.concatenate([np.minimum(np.arange(0, 2000, ranked_search.BLOCK) + ranked_search.BLOCK, 2000) - 1 + t * 2000 for t in range(3)])
    delta = np.diff(doc, prepend=0)
    delta[::2000] = 1
    pairs = np.stack([delta, tf], axis=1).ravel()
    data, size = postings.pack(pairs)
    most = np.maximum.reduceat(ranked_search._impact(tf, m[doc]), blocks)
    row = {"terms": np.unique(term).tobytes(), "held": held.tobytes(), "lasts": doc[tails].astype(np.uint32).tobytes(), "most": most.astype(np.uint32).tobytes(), "ends": np.cumsum(size)[2 * tails + 1].astype(np.uint64).tobytes(), "postings": data.tobytes(), "m": m.tolist(), "doc_ids": list(range(2000))}
    at, weight = np.arange(3), np.array([5, 3, 2])
    exact = sum(w * ranked_search._impact(tf[t * 2000 : (t + 1) * 2000], m) for t, w in enumerate(weight))
    every = ranked_search.Segment(row)
    docs, scores = every.best(at, weight, 10, 1)
    assert scores.tolist() == sorted(exact.tolist(), reverse=True)[:10] and docs[0] == 700 and every.opened == every.met == 48
    few = ranked_search.Segment(row)
    docs, scores = few.best(at, weight, 10, int(exact.max()))
    assert docs.tolist() == [700] and few.opened == 3


def test_empty_tables(spark):
    docs, items = table(spark, ["some words here"]), spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert ranked_search.ranked_search(d, i).count() == 0
        assert [r.contaminated for r in leaks.decontaminate(d, i).collect()] == [False] * d.count()


def test_index_serves_again(spark):
    keep = Scratch(spark, "again")
    index = ranked_search.build_index(table(spark, ["red blue", "blue", "green"]), keep)
    ask = lambda t: [r.doc_id for r in ranked_search.search_index(index, spark.createDataFrame([(1, t)], "item_id bigint, text string"), keep).orderBy("rank").collect()]
    assert ask("red") == [0] and ask("blue") == [1, 0] and ask("none") == []
