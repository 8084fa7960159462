"""The n-gram join against brute force, its pigeonhole argument and its numbers of signatures."""

import random

import numpy as np
import pytest
from test_corpus import copies, linked, table

from riskweave.llm import ngram_join


@pytest.mark.parametrize(("n", "num", "den", "group", "fetch"), [(4, 85, 100, 2000, 500_000), (5, 80, 100, 4, 1)])
def test_ngram_join(spark, monkeypatch, n, num, den, group, fetch):
    """Small limits deal leftover groups into chunks and fetch texts by a join of both sides."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "FETCH", fetch)
    texts = copies(n=60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(table(spark, texts), n, num, den).collect()}
    assert got == linked(texts, n, num, den)


def test_group_of_borderline_copies(spark, monkeypatch):
    """Copies of one text whose edits reach beyond the threshold, with a passage that all texts share."""
    monkeypatch.setattr(ngram_join, "GROUP", 20)
    r = random.Random(12)
    words = [f"v{i}" for i in range(3000)]
    base, passage = [r.choice(words) for _ in range(70)], [r.choice(words) for _ in range(40)]
    texts = []
    for i in range(90):
        t = list(base) if i % 2 else [r.choice(words) for _ in range(r.randrange(5, 60))]
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t if i % 2 else t + passage))
    for n, num in ((5, 80), (4, 85)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_join(table(spark, texts), n, num, 100).collect()}
        assert got == linked(texts, n, num, 100)


def test_null_and_repeated_ids(spark):
    """Rows keep their places; a null id names a component only if no other id is there."""
    same, near = "one two three four five six seven eight nine ten", "some other words that stand here for a text of more than a dozen words in a row today"
    texts, ids = [same, same, near, near + " again", "alone here with nobody else", near, "x y z"], [None, 4, 7, None, None, 7, 7]
    got = sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1) for x in ngram_join.ngram_join(table(spark, texts, ids), 4, 85, 100).collect())
    size = len(near.split()) - 3
    assert got == sorted([(-1, 7, 4), (4, 7, 4), (7, size, 7), (-1, size + 1, 7), (-1, 2, -1), (7, size, 7), (7, 1, 7)])


@pytest.mark.parametrize("num", [80, 85, 90])
def test_number_of_signatures(num):
    """At most 1.9 k + 9 in a band, whatever the size."""
    r = np.random.default_rng(num)
    bands = ngram_join.Bands(num, 100)
    for size in (1, 5, 40, 200, 1000, 4000, 8000, 20_000):
        s = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        for ahead in (0, 1):
            _, sig, _, need = ngram_join.signatures([s], bands, ahead)
            k = bands.largest(bands.of(np.array([len(s)])) + ahead)[0]
            assert len(sig) <= 1.9 * k + 9 and need[0] <= 2 + k // 8


@pytest.mark.parametrize("num", [80, 85])
def test_linked_sets_share_as_many_parts_as_they_need(num):
    r = np.random.default_rng(5)
    bands = ngram_join.Bands(num, 100)
    for size in (3, 7, 12, 20, 33, 60, 150, 700, 5000):
        for _ in range(12):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            b = a
            for _ in range(size):  # change elements as far as the threshold allows
                c = np.unique(np.concatenate([np.delete(b, r.integers(len(b))), r.integers(0, 2**63, int(r.integers(0, 3))).astype(np.uint64)]))
                both = len(np.intersect1d(a, c))
                if 100 * both < num * (len(a) + len(c) - both):
                    break
                b = c
            assert np.abs(np.frombuffer(ngram_join.sketch(a), np.uint8).astype(int) - np.frombuffer(ngram_join.sketch(b), np.uint8)).sum() <= len(np.setxor1d(a, b))
            if np.array_equal(a, b):
                continue
            own = bands.of(np.array([len(a), len(b)]))
            low, high = (a, b) if own[0] <= own[1] else (b, a)
            shared = {}
            for s, ahead in ((low, int(abs(own[0] - own[1]))), (high, 0)):
                owner, sig, part, need = ngram_join.signatures([s], bands, ahead)
                for x, p in zip(sig.tolist(), part.tolist(), strict=True):
                    shared.setdefault(x, []).append((p, need[0]))
            met = {v[0][0] for v in shared.values() if len(v) == 2}
            needs = [v[i][1] for v in shared.values() if len(v) == 2 for i in (0, 1)]
            assert not met and not needs or len(met) >= max(needs)
            if not met:  # only sets whose empty subsets take up all parts may share nothing
                assert min(ngram_join.signatures([s], bands, x)[3][0] for s in (a, b) for x in (0, 1)) == 0
