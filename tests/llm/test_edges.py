"""Cases at the edge: long texts, null ids, empty tables, ids that are no numbers, and checks from definitions."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_corpus import FOLD, SCHEMA, table

from riskweave.llm import bpe_tree, html_text, line_dedup, media, quality_rules, secrets, toxicity

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_long_texts_and_null_ids(spark):
    long = "the river and the stone " * 40_000
    docs = table(spark, [long, None, "x", long], [1, None, None, 2])
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, toxic int")
    for out in (quality_rules.quality_rules(docs), toxicity.toxicity(docs, labels), media.media_columns(docs), secrets.secret_scan(docs)):
        rows = out.collect()
        assert len(rows) == 4 and sum(r.doc_id is None for r in rows) == 2
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert rows[1].n_words == 200_000 and rows[1].n_repeat_words == 200_000 and rows[1].base_failed
    stored = media.media_columns(docs).collect()
    assert {(r.width, r.height, r.bits) for r in stored} == {(576, -(-len(long) // 576), 8), (576, 1, 8)}
    assert all(len(r.digest) == 64 and r.length == r.media_bytes and r.feature.startswith(f"{r.width}x{r.height}x{r.bits} ") for r in stored)


def test_long_page(spark):
    page = "<body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>Paragraph {i} of a very long page, with some words in it.</p>" for i in range(20_000)) + "</article></body>"
    assert html_text.extract(page).count("\n") == 19_999
    deep = "<body>" + "<div>" * 3000 + "<p>Some words at the bottom of it all.</p>" + "</div>" * 3000 + "</body>"
    assert html_text.extract(deep) == "Some words at the bottom of it all."


def test_runs_beside_base_spans():
    """A run that touches a base span is read from its own start, however long it is, and once."""
    key = "Xy9/" * 100
    text = key + "0123456789abcdef01234567" + " and " + "0123456789abcdef01234567" + "QWERTY12345678"
    base = secrets.base_spans(text)
    runs = secrets.candidates(text, base)
    assert (0, 400) in runs and not any(0 < a < 400 for a, _ in runs)
    assert (len(text) - 14, len(text)) in runs


def test_line_batches(spark):
    """Batches hold alike many lines, whatever single texts weigh; null ids are in the last."""
    docs = table(spark, ["a\n" * 50 if i == 3 else "one line of text" for i in range(101)], [*range(100), None])
    docs = docs.select("doc_id", "text").withColumn("lines", line_dedup.F.split("text", "\n", -1))
    total, batch, n = line_dedup._batches(docs, None)
    rows = docs.select("doc_id", batch.alias("b")).collect()
    assert total == 151 and n == 4 and next(r.b for r in rows if r.doc_id is None) == 3
    assert [min(r.doc_id for r in rows if r.b == b and r.doc_id is not None) for b in range(4)] == sorted(min(r.doc_id for r in rows if r.b == b and r.doc_id is not None) for b in range(4))
    assert line_dedup._batches(docs, 1)[2] == 1


def test_more_empty_tables(spark):
    docs = table(spark, ["x"]).limit(0)
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert bpe_tree.bpe_round_trip(docs, MULTI, public_tokenizers.PATTERN).count() == 0
    assert bpe_tree.bpe_decode(bpe_tree.bpe_encode(docs, MULTI, public_tokenizers.PATTERN), MULTI, public_tokenizers.PATTERN).count() == 0
    assert html_text.html_text(pages).count() == 0


def test_pattern_is_honoured():
    """Another pattern than the one of the fast path is matched as it is written."""
    from riskweave.llm import bpe

    own = bpe.Encoder(MULTI, r"\S+|\s+")
    assert own.matches("it's 12 a-b") == ["it's", " ", "12", " ", "a-b"]
    assert bpe.Encoder(MULTI, public_tokenizers.PATTERN).matches("it's 12") == ["it", "'s", " 12"]


def test_words_by_halves():
    """Long words reduced up a tree equal one merge, for every leaf size, and the library's ids."""
    import tiktoken

    from riskweave.llm import bpe

    enc = bpe.encoder(MULTI, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(n)) for n in (1, 2, 9, 60, 700)] + ["ab" * 300, "a" * 513, "\u00e9" * 90]
    for w in words:
        want = library.encode_ordinary(w)
        assert bpe.merge(enc.ranks, w.encode()) == want
        for leaf in (1, 2, 5, 16, 100):
            assert enc.reduce(w.encode(), leaf) == want
    huge = "".join(r.choice("etaoinshrdluabcdefg") for _ in range(1_000_000))
    assert bpe_tree.encode(enc, huge).tolist() == library.encode_ordinary(huge)


def test_line_dedup_of_other_ids_and_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LINES", 1)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 10**9)
    shared = "a line that nearly every document holds"
    texts = [f"{shared}\nown line number {i} of this text" if i % 7 else f"own line number {i - 1} of this text" for i in range(40)]
    for kind, ids in (("string", [f"id{i:03}" for i in range(40)]), ("bigint", list(range(40)))):
        docs = spark.createDataFrame([(i, t, None, "s", None, 1, "x", 2) for i, t in zip(ids, texts, strict=True)], SCHEMA.replace("doc_id bigint", f"doc_id {kind}"))
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, batches=5).collect()}
        seen, want = set(), {}
        for i, t in zip(ids, texts, strict=True):
            want[i] = "\n".join(x for x in t.split("\n") if x not in seen)
            seen |= set(t.split("\n"))
        assert got == want


def test_estimation_against_a_loop_over_documents():
    """Expectation-maximisation over patterns gives what a plain loop over every document gives."""
    r = random.Random(5)
    n = len(quality_rules.RULES)
    rows = [[r.choice([0, 2, 2, 2]) if good else r.choice([0, 1, 1, 2]) for _ in range(n)] for good in (r.random() < 0.7 for _ in range(300))]
    codes = np.array([sum(v * 3 ** (n - 1 - j) for j, v in enumerate(row)) for row in rows])
    values, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
    post, *_ = quality_rules.estimate(values, counts.astype(float), rounds=20)
    right, share = [[0.3, 0.95] for _ in range(n)], 0.8

    def chance(row):
        p = [1 - share, share]
        for j, v in enumerate(row):
            for g in (0, 1):
                p[g] *= 1.0 if v == 0 else right[j][g] if v == g + 1 else 1 - right[j][g]
        return p[1] / (p[0] + p[1])

    for _ in range(20):
        each = [chance(row) for row in rows]
        share = min(max(sum(each) / len(each), 0.05), 0.95)
        for j in range(n):
            for g in (0, 1):
                w = [(p if g else 1 - p) for p in each]
                voted = sum(x for x, row in zip(w, rows, strict=True) if row[j])
                hit = sum(x for x, row in zip(w, rows, strict=True) if row[j] == g + 1)
                right[j][g] = min(max((hit + 1) / (voted + 2), 0.8 if g else 0.02), 0.9995)
            right[j][0] = max(right[j][0], 1 - right[j][1])
    assert np.allclose(post[place], [chance(row) for row in rows], atol=1e-9)


def test_base_patterns_from_their_definition(spark):
    """Counts and digests against patterns written out here."""
    import hashlib

    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    r = random.Random(6)
    parts = ['token = "abc123xyz"', "password:short", "API_KEY='LongEnough/1'", "AKIA" + "B" * 18, "AKIA" + "C" * 3, "0123456789abcdef" * 2, "deadbeef", "plain words", "secret=", "\u017fecret=abcdefgh", "\u00e9\u00e9"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(0, 9))) for _ in range(60)]
    for row in secrets.secret_scan(table(spark, texts)).collect():
        t = texts[row.doc_id]
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert row.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(f[1] == k for f in found) for k in range(3)]


def test_toxicity_neighbours_by_definition(spark):
    """The evidence of every document against cosines over all terms, computed term by term."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(80)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 30))) for _ in range(90)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    got = {x.doc_id: x.evidence for x in toxicity.toxicity(table(spark, texts), labels, k=5).collect()}

    def terms(t):
        out = {}
        for w in re.findall("[a-z\u0080-\U0010ffff]+", t.translate(FOLD)):
            for term in [("w", w), *((n, w[:n]) for n in toxicity.BEGINNINGS)]:
                out[term] = out.get(term, 0) + 1
        return out

    bags = [terms(t) for t in texts]
    known = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    vocabulary = {x for i in known for x in bags[i]}
    toxic = [i for i in known if i % 5 == 0]
    clean = [i for i in known if i % 5]
    weight = {}
    for x in vocabulary:
        a, b = sum(x in bags[i] for i in toxic), sum(x in bags[i] for i in clean)
        marked = bool(toxicity.marked(np.array([a]), np.array([b]), len(toxic), len(clean))[0])
        weight[x] = math.log(1 + 90 / sum(x in bag for bag in bags)) * (toxicity.MARKED if marked else 1)
    vector = lambda bag: {x: (1 + math.log(c)) * weight[x] for x, c in bag.items() if x in weight}
    length = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    vectors = [vector(b) for b in bags]
    for i, v in enumerate(vectors):
        cosine = {str(j): sum(x * vectors[j].get(t, 0) for t, x in v.items()) / length(v) / length(vectors[j]) for j in known}
        best = sorted(cosine.values(), reverse=True)[:5]
        assert np.allclose(sorted((cosine[j] for j in got[i]), reverse=True), [x for x in best if x > 1e-9], atol=3e-5)


@pytest.mark.parametrize("kind", range(12))
def test_secrets_of_kinds_that_training_never_saw(kind, monkeypatch):
    """A network trained without one kind of planted keys still finds most of that kind, in runs of key-like letters."""
    r = random.Random(kind)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    prefix = ["hf_", "npm_", "dop_v1_", "SG.", "shpat_", "EAAC", "ya29.", "pypi-", "lin_api_", "dckr_pat_", "sq0atp-", "AC"][kind]
    net = secrets.network()
    texts = [f"see the {r.choice(['value', 'key', 'login'])} {prefix}{''.join(r.choice(alphabet) for _ in range(32))} for it" for _ in range(40)]
    found = [any(k == 3 for _, k, _ in spans) for spans in secrets.scan(texts, net)]
    assert np.mean(found) >= 0.8


def test_pipeline_edges(spark, tmp_path):
    """An empty table, repeated rows and a null id go through all stages."""
    import corpus_pipeline

    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    r = random.Random(9)
    words = "the of and to in is that for it with garden house river stone window morning letter music winter".split()
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    same = text(60)
    rows = [(1, same), (1, same), (2, text(80)), (None, text(70)), (None, None), (3, "")]
    for name, data in (("empty", []), ("some", rows)):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], columns).write.parquet(f"{at}/documents.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        assert {x.doc_id for x in out} == ({1, 2, None} if data else set())
