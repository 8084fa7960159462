import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from riskweave.llm import bpe, bpe_tree, packing, token_counts

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN

PIECES = ["the", " The", "'re", "'r", "e", "  ", "\n", "\n\n ", "\t", "é", "ß", "ñandú", "12", "²", "½", "###", "$%", "漢字", "👍🏽", " ", " ", "\x1c", "\x85", "a" * 50, "’s", "_", "<|endoftext|>", "'ll", " '", "á", "ª", "€", "٣", "　", "\x00"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["", " ", "x", " " * 300, "ab" * 400, *("".join(r.choice(PIECES) for _ in range(r.randrange(1, 120))) for _ in range(n))]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_character_is_matched_as_by_the_library(library):
    enc = bpe.encoder(MULTI, PATTERN)
    for c in [*range(0xD800), *range(0xE000, 0x2FFFF)]:
        t = f"a{chr(c)}b {chr(c)}{chr(c)} 1" if c < 0x3400 else f"a{chr(c)} {chr(c)}"
        assert enc.ordinary(t) == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(t)), hex(c)


def test_tree_equals_library_for_every_leaf_size(library):
    enc = bpe.encoder(MULTI, PATTERN)
    for t in random_texts(150):
        want = library.encode_ordinary(t)
        for leaf in (1, 2, 7, 40):
            got = bpe_tree.encode(enc, t, leaf).tolist()
            assert got == want
            assert bpe_tree.decode(enc, got, leaf) == t.encode()


def test_counts_equal_library():
    library = Tokenizer.from_file(JSON)
    enc, core = bpe.Encoder(JSON, PATTERN), bpe.Encoder(JSON, PATTERN, own=False)
    for t in random_texts(150, 2):
        want = library.encode(t, add_special_tokens=False).ids
        assert enc.ids(t) == core.ids(t) == b"".join(i.to_bytes(4, "little") for i in want)
        for chunk, overlap in ((6, 2), (40, 5), (200, 30), (10**6, 10)):
            assert token_counts.count(enc, t, chunk, overlap) == len(want)


def _best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= x]
        if fit:
            i = min(fit, key=rooms.__getitem__)
            rooms[i] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(60):
        capacity = r.choice([7, 20, 64])
        lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 200))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        used = {}
        for length, lo, hi, base, before, q in packing.plan(histogram, capacity):
            for rank in range(lo, hi):
                used.setdefault(base + (rank - lo) // q, []).append((before + (rank - lo) % q * length, length))
        assert sorted(x for b in used.values() for _, x in b) == sorted(lengths)
        for b in used.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) == _best_fit(lengths, capacity)


def test_queries_handle_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (2, None, 6), (None, "x " * 3000, 7), (3, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length bigint")
    packed = packing.pack_documents(docs, JSON, PATTERN).collect()
    by = {}
    for p in packed:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for b in by.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    long = sorted((p for p in packed if p.doc_id is None), key=lambda p: p.piece)
    assert [p.length for p in long][1:] == [2048] * (len(long) - 1) and [p.start for p in long] == [sum(q.length for q in long[:i]) for i in range(len(long))]
    assert sum(p.doc_id == 1 for p in packed) == 2
    counts = {r.doc_id: r for r in token_counts.token_counts(docs, JSON, PATTERN).collect()}
    assert counts[2].n_tokens == 0 and counts[3].n_bytes == 0 and counts[None].over_limit
    trip = {r.doc_id: r for r in bpe_tree.bpe_round_trip(docs, MULTI, PATTERN, leaf=64).collect()}
    assert trip[None].decoded_sha256 == hashlib.sha256(("x " * 3000).encode()).hexdigest()
    assert trip[2].ids_sha256 == hashlib.sha256(b"").hexdigest() and trip[2].n_tokens == 0
    ids = bpe_tree.bpe_encode(docs, MULTI, PATTERN)
    assert {bytes(r.data).decode() for r in bpe_tree.bpe_decode(ids, MULTI, PATTERN).collect()} == {t or "" for _, t, _ in rows}
    empty = docs.limit(0)
    assert packing.pack_documents(empty, JSON, PATTERN).count() == 0 == token_counts.token_counts(empty, JSON, PATTERN).count()
