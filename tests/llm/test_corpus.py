"""Corpus operators against brute force, on small tables with nulls, repeats, long texts and clashing names."""

import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskweave.llm import html_text, line_dedup, media, ngram_join, quality_rules, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP, LOW = line_dedup.UPPER, line_dedup.LOWER
FOLD = str.maketrans(UP, LOW)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, h string, sig int"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None, 1, "x", 2) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def copies(seed=1, n=60):
    """Families of near copies around shared passages, exact copies, short and empty texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(25)]
    out = [None, "", " \t ", "One", "one", "a b", "A  B", "a b c", "x " * 3000]
    for _ in range(n // 6):
        base = [r.choice(words) for _ in range(r.choice([8, 30, 120, 300]))]
        for _ in range(5):
            t = list(base)
            for _ in range(r.randrange(0, max(1, len(t) // 25) + 1)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t + (passage if r.random() < 0.3 else [])))
    return out + out[10:16]


def shingles(t, n):
    w = WORD.findall((t or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(texts, n, num, den):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_line_dedup(spark):
    r = random.Random(2)
    lines = ["", "short", "  Short ", "a line of more than ten", "A LINE of more than ten\t", "\x0bten chars!", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", *(f"line number {i} of many" for i in range(30))]
    texts = [None, "", "\n", *("\n".join(r.choice(lines) for _ in range(r.randrange(1, 25))) for _ in range(60)), "\n".join(f"own {i} line" * 3 for i in range(5000))]
    key = lambda x: x.strip(line_dedup.BLANK).translate(FOLD)
    split = [(t or "").split("\n") for t in texts]
    first = {}
    for i, own in enumerate(split):
        for x in own:
            first.setdefault(key(x), i)
    want = {i: "\n".join(x for x in own if len(key(x)) < 10 or first[key(x)] == i) for i, own in enumerate(split)}
    for batches, fanout in ((1, 2), (5, 2), (7, 3)):
        got = line_dedup.line_dedup(table(spark, texts), batches=batches, fanout=fanout).collect()
        assert {x.doc_id: x.text for x in got} == want
        assert all(x.n_lines == len(split[x.doc_id]) and x.n_dropped == len(split[x.doc_id]) - sum(len(key(y)) < 10 or first[key(y)] == x.doc_id for y in split[x.doc_id]) for x in got)
    twice = table(spark, ["a line of more than ten", "a line of more than ten\nb", "a line of more than ten"], [1, 1, None])
    assert sorted((x.doc_id or 0, x.text) for x in line_dedup.line_dedup(twice).collect()) == [(0, ""), (1, "a line of more than ten"), (1, "a line of more than ten\nb")]


def test_quality_figures(spark):
    r = random.Random(3)
    texts = ["", " ", "a", "é ñ", *("".join(r.choice(["a ", "b ", "c\n", "# ", "é|", "\n", "\x1c", "dd ", "% "]) for _ in range(r.randrange(1, 80))) for _ in range(200))]
    f = quality_rules.figures(texts)
    for i, t in enumerate(texts):
        w, g = WORD.findall(t), {}
        for j in range(len(w) - 4):
            g.setdefault(tuple(w[j : j + 5]), []).append(j)
        covered = {k for p in g.values() if len(p) > 1 for j in p for k in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert tuple(f.iloc[i][quality_rules.FIGURES]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    out = quality_rules.quality_rules(table(spark, [None, *texts])).collect()
    assert len(out) == len(texts) + 1 and not any(x.kept for x in out if x.base_failed)
    kept = quality_rules.quality_filter(table(spark, [None, *texts]))
    assert kept.columns == table(spark, []).columns and sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in out if x.kept)


def test_estimation_finds_planted_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20_000) < 0.7
    n = len(quality_rules.RULES)
    code = np.zeros(len(good), np.int64)
    for j in range(n):
        accuse = np.where(good, r.random(len(good)) < 0.03, r.random(len(good)) < 0.45)
        code = 3 * code + np.where(r.random(len(good)) < 0.1, 0, np.where(accuse, 1, 2))
    values, place, counts = np.unique(code, return_inverse=True, return_counts=True)
    post, right, share = quality_rules.estimate(values, counts.astype(float))
    assert abs(share - 0.7) < 0.03 and ((post[place] >= 0.5) == good).mean() > 0.95 and np.abs(right[:, 1] - 0.97).max() < 0.03


def test_rows_of_hot_payloads(spark):
    """Hot payloads or not, each row meets its own once."""
    rows = spark.createDataFrame([(i, b"a" if i < 60 else bytes([i, 0])) for i in range(100)], "doc_id bigint, digest binary")
    described = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    for hot in (1, 2, 50, 1000):
        got = media.described_rows(rows, described, hot).select("doc_id", "first", "copies").collect()
        assert sorted(map(tuple, got)) == [(i, 0, 60) if i < 60 else (i, i, 1) for i in range(100)]
    assert media.described_rows(rows.limit(0), described.limit(0)).count() == 0


def test_media(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "a", "long " * 50_000]
    got = media.media_columns(table(spark, texts)).collect()
    assert len(got) == len(texts)
    for x in got:
        data = (texts[x.doc_id] or "").encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert (x.width, x.height) == (576, len(full) // 576)
        stored = media.to_png(full)
        assert media.from_png(stored) == full and hashlib.sha256(stored).hexdigest() == x.media_sha256 and len(stored) == x.media_bytes
    with pytest.raises(ValueError):
        media.from_png(stored[:-20] + b"x" + stored[-19:])
    assert len({(x.shard, x.offset) for x in got if texts[x.doc_id] == "a"}) == 1


def test_secrets(spark):
    key = "a1B2c3D4e5F6a7B8c9D0e1F2a3B4c5D6e7F8"
    texts = [None, "", "token = \"0123abc\" x", "API_KEY:'abcde'", "my apikey: abcdef and Password=hunter22", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "f" * 24 + "g" + "f" * 23, "toKen=abcdef toKen=ghijkl", "ſecret=abcdefgh", f"authorization key {key} end", "see mail7.example.com and 4401553578478930", "word " * 30_000]
    got = {x.doc_id: x for x in secrets.secret_scan(table(spark, texts)).collect()}

    def base(t):
        t = t or ""
        out = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))

    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(base(t).encode()).hexdigest()
        assert set(base(t).split(",")) - {""} <= set(got[i].spans.split(","))
    assert (got[4].n_assign, got[8].n_assign, got[9].n_assign, got[5].n_access, got[6].n_access, got[7].n_hex) == (2, 2, 0, 1, 0, 1)
    assert got[10].n_model == 1 and got[11].n_model == 0
    assert secrets.redact("a token = abcdef b", secrets.base_spans("a token = abcdef b")) == "a [secret] b"


def test_keys_behind_a_harmless_beginning():
    """Keys anywhere in a long run, and long runs without one."""
    r = random.Random(4)
    net = secrets.network()
    path = "docs.example.com/" + "/".join(["guide", "house", "garden", "chapter", "music", "letter", "winter", "morning", "station"])
    keys = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36)) for _ in range(40)]
    runs = [f"{path}/ghp_{k}" for k in keys[:10]] + [f"{path}.{k}.page" for k in keys[10:20]] + [f"{'=' * 70}sk_live_{k}" for k in keys[20:30]] + [f"{path}/x=sk_live_{k}/{path}" for k in keys[30:]]
    found = secrets.scan([f"see {x} now" for x in runs], net)
    assert sum(any(a <= 4 + x.index(k) and b >= 4 + x.index(k) + 36 for a, _, b in s) for x, k, s in zip(runs, keys, found, strict=True)) >= 38


def test_every_run_reaches_the_network():
    """Short values behind a hint, keys without a digit or a letter, and what a pattern's span leaves of a run."""
    net = secrets.network()
    texts = ["my pw = hunter22x ok", 'auth: "qX7vR2mKz9"', "credential = QzXvKpWmRtYbNcGhJdLs", "id 0123456789abcdef01234567-Xy9kLmNoPqRsT end"]
    keys = ["hunter22x", "qX7vR2mKz9", "QzXvKpWmRtYbNcGhJdLs", "Xy9kLmNoPqRsT"]
    for text, key, spans in zip(texts, keys, secrets.scan(texts, net), strict=True):
        assert any(k == 3 and a <= text.index(key) and b >= text.index(key) + len(key) for a, k, b in spans)
        assert key not in secrets.redact(text, spans)
    data = [x for x in secrets.findings(1500, 78) + secrets.more_findings(1500, 79)]
    found = [any(a < e and b > s for a, _, b in spans) for (_, s, e, _), spans in zip(data, secrets.scan([x[0] for x in data], net), strict=True)]
    y = np.array([x[3] for x in data])
    assert np.mean(np.array(found)[y == 1]) > 0.97 and np.mean(np.array(found)[y == 0]) < 0.03


def test_network_on_unseen_findings():
    net = secrets.network()
    data = secrets.findings(600, 77)
    windows = [secrets._window(t, a, b) for t, a, b, _ in data]
    found = net.probability(np.stack([w[0] for w in windows]), np.stack([w[1] for w in windows])) >= net.threshold
    y = np.array([d[3] for d in data])
    assert found[y == 1].mean() > 0.95 and found[y == 0].mean() < 0.05


def test_nearest_examples_are_exact():
    r = np.random.default_rng(3)
    vocabulary = np.sort(r.integers(0, 2**63, 40).astype(np.uint64))
    terms = []
    for _ in range(500):
        t = np.sort(r.choice(40, r.integers(0, 6), replace=False))
        terms.append((t, r.integers(1, 4, len(t))))
    toxic = r.random(500) < 0.3
    index = toxicity.build_index(np.arange(500), terms, toxic, np.ones(500), vocabulary, r.integers(1, 100, 40), 1000).ready()
    dense = np.zeros((len(index.ids), 40))
    for row, i in enumerate(index.ids):
        t, v = index.vector(*terms[i])
        dense[row, t] = v
    for t, n in terms[:80]:
        if not len(t):
            continue
        t, v = index.vector(t, n)
        q = np.zeros(40)
        q[t] = v
        best, cosine = index.nearest(t, v, 15)
        want = np.sort(dense @ q)[::-1][:15]
        assert np.allclose(cosine, want[want > 1e-12][: len(cosine)]) and np.allclose(dense[best] @ q, cosine)


def test_toxicity(spark):
    r = random.Random(5)
    words = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    text = lambda bad: " ".join([r.choice(words) for _ in range(30)] + ([r.choice(["nasty", "vilest", "horrid"]) + "!"] * 3 if bad else []))
    toxic = [i % 4 == 0 for i in range(400)]
    docs = table(spark, [*(text(b) for b in toxic), None, "", "x"])
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic)] + [(0, 1, None), (9999, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 403
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
        if x.doc_id < 400:
            assert (x.score >= 0.3) == toxic[x.doc_id] and (not toxic[x.doc_id] or x.evidence)
    assert {x.score for x in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_every_example_is_found_by_its_text(spark):
    """Also texts of words that no other example holds, or that are as frequent in both labels."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(12)) for _ in range(60)] + ["singular", "Lonely words!"]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(62)], "doc_id bigint, toxic int")
    learned = [i for i in range(62) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = table(spark, texts + [texts[i] for i in learned], [*range(62), *(1000 + i for i in learned)])
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    assert {61} <= set(learned) and len(got) == 62 + len(learned)
    assert all(got[i].evidence[0] == got[1000 + i].evidence[0] == str(i) for i in learned)


def test_html(spark):
    paragraph = "Some words of an article that is long enough to be one, and some more."
    page = (
        "<!doctype html><html><head><title>no</title><style>p{}</style><script>var x='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><div id=wrap><div class='sidebar'><p>{paragraph}</p></div><article><h1>Title &amp; more</h1><p><b>First\n  line<br><p>{paragraph}&nbsp;&lt;end&gt;"
        f"<ul><li>one<li>two</ul><form>Mail <input></form></article><section class=comments><p>{paragraph} {paragraph}</section></div><!-- x --><footer>&copy; me</footer></body>"
    )
    want = f"Title & more\nFirst line\n{paragraph} <end>\none\ntwo"
    assert html_text.extract(page) == want
    assert [html_text.extract(x) for x in (None, "", "<p>", "plain text", "<a", "&lt;b&gt;", "<script>x")] == ["", "", "", "plain text", "", "<b>", ""]
    for n in range(0, len(page), 7):
        html_text.extract(page[:n])
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 6)], "page_id bigint, url string, html string, text int")
    got = {x.page_id: (x.text, x.n_chars) for x in html_text.html_text(df).collect()}
    assert got == {1: (want, len(want)), 2: ("", 0)}


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_keeps_the_whole_article(tag):
    """A headline, short paragraphs and sections beside the densest one; menus and unmarked link lists stay out."""
    p = lambda c: c * 299 + "."
    links = "<div>" + "".join(f"<a href=/{i}>another story {i}</a> " for i in range(9)) + "</div>"
    around = lambda x: f"<html><body><nav><a href=/>Home</a></nav>{links}<div><{tag}>{x}</{tag}></div><footer>me</footer></body></html>"
    body = "".join(f"<p>{p(c)}</p>" for c in "abcde")
    assert html_text.extract(around(f"<h1>{'H' * 30}</h1><div>{body}</div>")).split("\n") == ["H" * 30, *map(p, "abcde")]
    sections = f"<h1>Headline</h1>Lead<section>{body * 2}</section><figure><p>x</p><figcaption>A caption</figcaption></figure><div><div>{''.join(f'<p>{p(c)}</p>' for c in 'fgh')}<p>short</p></div></div><p>End</p>"
    assert html_text.extract(around(sections)).split("\n") == ["Headline", "Lead", *map(p, "abcdeabcde"), "x", "A caption", *map(p, "fgh"), "short", "End"]
    assert html_text.extract(f"<body><div><div><h1>Title</h1></div><div>{body}</div></div></body>").split("\n") == ["Title", *map(p, "abcde")]


@pytest.mark.parametrize("inner", ["article", "div"])
def test_html_marks_do_not_drop_the_page(inner):
    """Words of a class or id, or a form, around the article; marked parts beside or in it still go."""
    p = lambda c: c * 299 + "."
    want = [*map(p, "abcd")]
    text = f"<{inner}>{''.join(f'<p>{x}</p>' for x in want)}</{inner}>"
    beside = f"<div class='sidebar'><p>{p('s')}</p></div><div class='comments'><p>{p('x')}</p><p>{p('y')}</p></div>"
    for mark in ("div class='content has-sidebar'", "div class=no-sidebar", "div class='with-comments'", "div class='social-science'", "div id='page-widget'", "form action=/", "div class=hasSidebar"):
        page = f"<html><body><nav><a href=/>Home</a></nav><{mark}>{text}{beside}</{mark.split()[0]}><footer>me</footer></body></html>"
        assert html_text.extract(page).split("\n") == want, mark
    page = f"<body><article class='post comments-open'>{text}</article>{beside}<aside><article><p>Teaser of another</p></article></aside></body>"
    assert html_text.extract(page).split("\n") == want
    page = f"<body><article><p>{p('a')}</p></article><div class=comments>{''.join(f'<article class=comment><p>{p(c)}</p></article>' for c in 'uvwxyz')}</div></body>"
    assert html_text.extract(page) == p("a")


def test_html_names_inside_an_article():
    """A part of a name only takes away what is mostly links; whole names take away all; density overrides a wrong name."""
    p = lambda c: c * 299 + "."
    kept = "".join(f"<{t}>{p(c)}</{t.split()[0]}>" for t, c in (("p class='share-price'", "a"), ("p class='intro comment-free'", "b"), ("div class='widget-box'", "c")))
    gone = f"<p class=notice>Note {p('x')}</p><div class='share-buttons'><a href=1>Share it</a> <a href=2>Send it</a></div><div class=ad>Buy</div>"
    assert html_text.extract(f"<body><article><h1>T</h1><p>{p('d')}</p>{kept}{gone}</article></body>").split("\n") == ["T", *map(p, "dabc")]
    for wrapper in ("form id=aspnetForm", "div class='page comments-open'", "div class=widget", "aside"):
        page = f"<html><body><nav><a href=/>Home</a></nav><{wrapper}><div><h1>T</h1><p>{p('a')}</p><p>{p('b')}</p></div></{wrapper.split()[0]}><footer>me</footer></body></html>"
        assert html_text.extract(page).split("\n") == ["T", *map(p, "ab")], wrapper


def test_html_densities_of_random_trees():
    """Densities and their sums against the formula, node by node, and the core against the largest sum."""
    import math

    r = random.Random(16)
    for _ in range(40):
        def build(depth):
            out = ""
            for _ in range(r.randrange(1, 4)):
                kind = r.random()
                if depth and kind < 0.5:
                    out += f"<div>{build(depth - 1)}</div>"
                elif kind < 0.75:
                    out += f"<p>{'x' * r.randrange(1, 200)}</p>"
                else:
                    out += f"<p><a href=1>{'y' * r.randrange(1, 40)}</a></p>"
            return out

        root, _ = html_text.parse(f"<body>{build(4)}</body>")
        order = html_text._measure(root)

        def total(n):
            own = (sum(n.runs), 0, 0, 0)
            inner = [total(c) for c in n.children]
            return own[0] + sum(x[0] for x in inner), sum(x[1] + 1 for x in inner), sum(x[2] for x in inner), sum(x[3] for x in inner)

        share = root.link_chars / max(root.chars, 1)
        for n in order:
            assert n.chars == total(n)[0] and n.tags - n.link_tags == total(n)[1]
            if n.chars:
                c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, max(n.link_tags, 1)
                base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
                assert math.isclose(n.density, c / t * math.log(1 + c / max(lc, 1) * t / lt) / (1 + math.log(base)))
            plain = sum(x * math.log(1 + x) / (1 + math.log(math.log(share * x + math.e))) for x in n.runs if x)
            assert math.isclose(n.sum, sum(c.density for c in n.children) + plain)
        assert html_text._core(order).sum == max(n.sum for n in order)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_html_density_decides_on_the_tables():
    """Without any names, density alone leaves something out of nearly all pages, and takes no article away."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    acts = 0
    for page in pages:
        root, items = html_text.parse(page)
        for n in html_text._below(root):
            n.mark = 0
        core = html_text._core(html_text._measure(root))
        order = html_text._leave_out(root, core)
        chosen, own = html_text._chosen(order, core)
        inside = lambda n: id(n) in chosen or (n.parent is not None and inside(n.parent))
        left = [n for n, _, raw in items if not raw.isspace() and not inside(n) and id(n) not in own]
        acts += bool(left)
        kept = " ".join(" ".join(raw for n, _, raw in items if inside(n) or id(n) in own).split())
        assert all(line[:40] in kept for line in html_text.extract(page).split("\n") if "&" not in line and len(line) > 40 and line in page)
    assert acts >= 0.9 * len(pages)


def test_html_of_synthetic_pages():
    r = random.Random(6)
    for _ in range(50):
        blocks = [" ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(1, 60))) for _ in range(r.randrange(1, 8))]
        page = f"<html><body><nav><ul>{''.join(f'<li><a href=/{i}>link {i}</a></li>' for i in range(5))}</ul></nav><div class=ad>Buy this now.</div><article><h1>{html.escape(blocks[0])}</h1>" + "".join(f"<p>{html.escape(b)}</p>" if r.random() < 0.8 else f"<p><b>{html.escape(b)}<br>" for b in blocks) + "</article><footer>&copy; x</footer></body></html>"
        assert html_text.extract(page) == "\n".join([blocks[0], *blocks])


def test_empty_tables(spark):
    docs = table(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for out in (ngram_join.ngram_join(docs, 4, 85, 100), line_dedup.line_dedup(docs), quality_rules.quality_rules(docs), quality_rules.quality_filter(docs), media.media_columns(docs), secrets.secret_scan(docs), toxicity.toxicity(docs, labels)):
        assert out.count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    sentence = lambda k: " ".join(r.choice("the of and to in is that for it with garden house river stone window morning letter music winter".split()) for _ in range(k))
    texts = [sentence(r.randrange(40, 120)) + "\n" + sentence(30) for _ in range(30)]
    texts += [texts[0] + " end", texts[1], "#$% " * 50, None, "", sentence(50) + ' token = "0123456789abcdef0123456789abcdef01234567"']
    table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    ids, content = [], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs = docs.cache()
        ids.append({x.doc_id for x in docs.collect()})
        content.append({x.doc_id: x.text for x in docs.collect()})
    assert ids[0] == set(range(32)) | {35}
    assert ids[1] == ids[0] and content[1][31] == ""
    groups = linked([content[1].get(i) for i in range(36)], 5, 80, 100)
    assert ids[2] == {i for i in ids[1] if groups[i][1] == i}
    assert "[secret]" in content[3][35] and "0123456789abcdef" not in content[3][35] and content[3][2] == texts[2]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == ids[3]
    assert public_tokenizers.path("byte_bpe_50k.json")
