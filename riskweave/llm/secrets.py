"""Secrets: fixed patterns, and a character network over every other candidate.

The patterns' spans always stay. Every run of at least 16 key-like characters is a candidate, as
are runs of at least 6 behind a word that announces a secret, and what the patterns' spans leave
of a run they meet; a one-layer character convolution in NumPy reads it with the
characters around it, in overlapping windows over all of it and over its parts, of which the
largest probability counts. The network is trained here, once a session, on labelled findings: planted
keys of many kinds and look-alikes (words, numbers, addresses, hashes of content, identifiers) in
sentences, all from one seed. Its outputs are calibrated on findings that it did not see, and
the threshold is the highest with which a scan still finds ``recall`` of the planted keys among
those that the patterns do not cover.

Defined results: null or empty text has no spans; offsets count code points, ends are exclusive;
equal texts have equal spans; repeated rows are scanned each.
"""

from __future__ import annotations

import hashlib
import bisect
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_texts, whole_text

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Marks between the parts of a run, and its parts that are long enough for a key.
PARTING, PART = re.compile(r"[/.=_-]"), re.compile(r"[A-Za-z0-9+]{16,}")
#: Least length of a candidate behind a word that announces a secret, and of what is left of a run.
LEAST = 6
HINT = re.compile(r"key|auth|credential|bearer|private|access|signature|aws|pw|pass|secret|token", re.I | re.A)
HINTED = re.compile(r"""(?:key|auth|authorization|credentials?|bearer|private|access|signature|aws|pwd?|passphrase|pass|secret|token)["']?(?:\s*[:=@]\s*|\s+)["']?([A-Za-z0-9+/_.=-]{6,})""", re.I | re.A)
BESIDE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Cheap proof that a text has no assignment: each needs one of these marks behind a name.
_MARK = re.compile(r"""(?:[dD]|[tT]|[nN]|[yY])["']?\x20*[:=]""")

#: Characters before a candidate, of it, and behind it that the network sees.
BEFORE, WITHIN, AFTER = 32, 56, 8
LENGTH = BEFORE + WITHIN + AFTER
KERNEL, FILTERS, EMBED = 5, 24, 8
SEED, FINDINGS, EPOCHS = 20240607, 6000, 6
RECALL = 0.99

_CODE = np.full(256, 1, np.int64)  # 0: nothing there, 1: any other character
for _i, _c in enumerate(range(32, 127)):
    _CODE[_c] = 2 + _i
_CODE[10] = 97
SYMBOLS = 98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    if _MARK.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Key-like runs, or what the base spans leave of them."""
    runs = {m.span() for m in CANDIDATE.finditer(text)}
    if HINT.search(text):
        runs |= {m.span(1) for m in HINTED.finditer(text) if m.end(1) - m.start(1) < 16}
    if base:  # runs that touch a base span, each from its own start to its own end
        near = [m.span() for m in BESIDE.finditer(text)]
        starts = [a for a, _ in near]
        for x, _, y in base:
            before = bisect.bisect_left(starts, x) - 1
            if before >= 0 and near[before][1] >= x and x - near[before][0] >= LEAST:
                runs.add((near[before][0], x))
            if m := BESIDE.match(text, y):
                runs.add(m.span())
    out = set()
    for a, b in runs:
        for x, _, y in base:  # sorted by start
            if x < b and a < y:
                if x - a >= LEAST:
                    out.add((a, x))
                a = max(a, y)
        if b - a >= LEAST:
            out.add((a, b))
    return sorted(out)


def windows(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What the network reads of a run: its stretches of WITHIN characters, each half over the last, and its parts."""
    cuts = [(start, end)]
    if PARTING.search(text, start, end):
        cuts += [m.span() for m in PART.finditer(text, start, end) if m.span() != (start, end)]
        # from each mark on, as a key may hold marks itself
        cuts += [(m.end(), end) for m in PARTING.finditer(text, start, end) if end - m.end() >= 16 and end - start > WITHIN]
    out = []
    for a, b in cuts:
        out += [(i, min(i + WITHIN, b)) for i in range(a, max(b - WITHIN, a), WITHIN // 2)] if b - a > WITHIN else []
        out.append((max(a, b - WITHIN), b))
    return sorted(set(out))


def _window(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    def codes(s: str) -> np.ndarray:
        return _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]

    ids, inside = np.zeros(LENGTH, np.int64), np.zeros(LENGTH, np.float32)
    a, b, c = codes(text[max(0, start - BEFORE) : start]), codes(text[start:end][:WITHIN]), codes(text[end : end + AFTER])
    ids[BEFORE - len(a) : BEFORE] = a
    ids[BEFORE : BEFORE + len(b)] = b
    ids[BEFORE + len(b) : BEFORE + len(b) + len(c)] = c
    inside[BEFORE : BEFORE + len(b)] = 1
    return ids, inside


def findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, secret): half planted keys, half look-alikes."""
    r = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper = lower.upper()
    syllables = "th er in an on re ed is of at nt ou es ti le la ment que oi ie ch ge ver ich cion os ar do st ing al".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))

    def pick(letters: str, k: int) -> str:
        return "".join(r.choice(letters) for _ in range(k))

    def uuid() -> str:
        return "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))

    keys = [
        lambda: pick(upper + lower + digits + "+/", r.randrange(24, 60)),
        lambda: pick(upper + lower + digits, r.randrange(20, 48)),
        lambda: r.choice(["ghp_", "gho_", "github_pat_"]) + pick(upper + lower + digits, 36),
        lambda: r.choice(["sk_live_", "rk_live_", "sk-", "pk_test_"]) + pick(upper + lower + digits, r.randrange(24, 48)),
        lambda: r.choice(["xoxb-", "xoxp-"]) + pick(digits, 11) + "-" + pick(upper + lower + digits, 24),
        lambda: "AIza" + pick(upper + lower + digits + "_-", 35),
        lambda: "eyJ" + pick(upper + lower + digits, 20) + "." + pick(upper + lower + digits + "_-", 30) + "." + pick(upper + lower + digits + "_-", 25),
        lambda: pick(upper + lower + digits + "+/", 43) + "=",
        lambda: "AKIA" + pick(upper + digits, 16),
        lambda: pick("0123456789abcdef", r.choice([32, 40, 64])),
        lambda: "glpat-" + pick(upper + lower + digits + "_-", 20),
        lambda: pick(digits + "ABCDEF", r.choice([32, 40, 64])),
    ]
    likes = [
        lambda: pick(digits, r.randrange(16, 20)),
        lambda: pick(digits, 16),
        lambda: pick(digits, 16),
        lambda: f"{word()}{r.randrange(100)}.{word()}.example.{r.choice(['com', 'org', 'net'])}",
        lambda: f"mail{r.randrange(10)}.example.{r.choice(['com', 'org'])}",
        lambda: "/".join([r.choice(["www.", "m."]) + word() + ".com", *(word() for _ in range(3)), str(r.randrange(2000))]),
        lambda: "_".join(word() for _ in range(3)) + f"_{r.randrange(1000)}",
        lambda: "-".join([word(), word(), word(), f"20{r.randrange(10, 26)}", f"{r.randrange(1, 13):02}", f"{r.randrange(1, 29):02}"]),
        uuid,
        lambda: f"{word()}{word()}-{r.randrange(10)}.{r.randrange(20)}.{r.randrange(20)}.tar.gz",
        lambda: word() + word() + word() + str(r.randrange(10, 99)),
        lambda: "=" * r.randrange(8, 20) + str(r.randrange(100)) + "=" * r.randrange(8, 20),
        lambda: f"20{r.randrange(10, 26)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}T{r.randrange(10, 24)}",
        lambda: ".".join(pick(digits, 3) for _ in range(r.randrange(4, 7))),
        lambda: (word() + word() + word() + word()).upper() + str(r.randrange(100)),
        lambda: "".join(w.capitalize() for w in (word(), word(), word(), word())) + str(r.randrange(10)),
        lambda: "0." + pick(digits, r.randrange(15, 20)),
    ]
    hints = ["key", "auth", "credential", "bearer", "Authorization", "client_key", "private", "access", "signature", "aws", "pw", "export KEY"]
    neutral = ["see", "file", "from", "id", "at", "commit", "version", "date", "page", "call", "number", "ref"]
    out = []
    for i in range(n):
        secret = i % 2 == 0
        before = " ".join(word() for _ in range(r.randrange(0, 8)))
        after = " ".join(word() for _ in range(r.randrange(0, 5)))
        lead = r.choice(hints) if secret and r.random() < 0.6 else r.choice([r.choice(neutral), word() + r.choice(["", "", ",", "."])])
        glue = r.choice([" ", " = ", "=", ": ", ' "', " '", "\n", " @"]) if secret else r.choice([" ", " ", " ", ": ", "@", " (", "\n", " | ", "//"])
        found = r.choice(keys if secret else likes)()
        if len(found) < 16:
            found += pick(digits, 16 - len(found))
        head = f"{before} {lead}{glue}"
        out.append((f"{head}{found}{r.choice(['', '.', ',', chr(34)])} {after}", len(head), len(head) + len(found), int(secret)))
    return out


def more_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings of the other kinds of candidates: short, of letters or digits only, beside a pattern's span."""
    r = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    syllables = "th er in an on re ed is of at nt ou es ti le la ment que oi ie ch ge ver ich cion os ar do st ing al".split()
    hints = ["key", "auth", "credential", "bearer", "Authorization", "client_key", "private", "access", "signature", "aws", "pw", "export KEY"]

    def word(k: int = 4) -> str:
        return "".join(r.choice(syllables) for _ in range(r.randrange(2, k + 2)))

    def pick(letters: str, k: int) -> str:
        return "".join(r.choice(letters) for _ in range(k))

    def spoken(least: int) -> str:
        """A word that could be of some language, in one of three cases."""
        out = ""
        while len(out) < least:
            out += r.choice("b c d f g h j k l m n p r s t v w y z ch sch st pf br cr th wh qu x sh tr pl".split() + [""] * 4) + r.choice("a e i o u au ei ie ou eu ai ea io y".split()) + r.choice("n r s t ng ch st tz nd ly l m tzt ght rk pf chst".split() + [""] * 6)
        return r.choice([str.lower, str.lower, str.capitalize, str.upper])(out)

    glue = lambda: r.choice([" = ", "=", ": ", ' = "', ":", "='"])
    hexed = lambda: pick(digits + "abcdef", r.choice([24, 32, 40]))
    secret = [  # (what stands before, the finding)
        lambda: (r.choice(hints) + glue(), word() + pick(digits, r.randrange(2, 5)) + pick(lower, r.randrange(0, 3))),
        lambda: (r.choice(hints) + glue(), pick(lower + lower.upper() + digits, r.randrange(8, 16))),
        lambda: (r.choice(hints) + glue(), pick(lower + lower.upper(), r.randrange(16, 40))),
        lambda: (r.choice(["see ", "id ", "with "]), pick(lower + lower.upper(), r.randrange(20, 40))),
        lambda: (r.choice(hints) + glue(), pick(digits, r.randrange(20, 40))),
        lambda: (r.choice(["see ", "id ", r.choice(hints) + glue()]) + hexed(), "-" + pick(lower + lower.upper() + digits, r.randrange(10, 30))),
    ]
    harmless = [
        lambda: (r.choice(hints) + r.choice([" ", " ", ": "]), (word() + "xxxxxx")[: r.randrange(6, 14)].rstrip("x").ljust(6, "e")),
        lambda: (r.choice(hints) + " ", word().ljust(6, "s") + r.choice([".", "", "-" + word(), "/" + word()])),
        lambda: ("", (word() + word() + word() + word()).ljust(16, "e")),
        lambda: (r.choice(["", "the ", "see "]), spoken(16) + r.choice(["", "", ".", "...", "="])),
        lambda: (r.choice(["", "the ", "see "]), spoken(16) + r.choice(["", "", ".", "...", "="])),
        lambda: (r.choice(["see ", "at "]), r.choice("/._-").join([*(spoken(5) for _ in range(r.randrange(3, 14))), str(r.randrange(2000))])),
        lambda: ("see ", r.choice("/._-").join([r.choice(["www.", "docs.", ""]) + word() + ".com", *(word(6) for _ in range(r.randrange(3, 14))), str(r.randrange(2000))])),
        lambda: (r.choice(hints) + r.choice([" ", ": "]), spoken(r.randrange(6, 12))),
        lambda: ("the ", "-".join(word() for _ in range(4)).ljust(16, "e")),
        lambda: ("", r.choice("=-_.") * r.randrange(16, 150) + r.choice(["", "x1", str(r.randrange(100))])),
        lambda: (r.choice(["file ", "/cache/", "see "]) + hexed(), r.choice(["/index.html", ".tar.gz", "/image.jpeg", "-thumbnail.png", "/" + word().ljust(6, "e")])),
        lambda: ("number ", pick(digits, r.randrange(16, 24))),
    ]
    out = []
    for i in range(n):
        head, found = r.choice(harmless if i % 2 else secret)()
        before = " ".join(word() for _ in range(r.randrange(0, 8))) + " " + head
        out.append((f"{before}{found}{r.choice(['', '', ',', chr(34)])} {word()} {word()}", len(before), len(before) + len(found), 1 - i % 2))
    return out


@dataclass
class Network:
    """Weights: embedding, convolution, and the output over the filters' maxima and means."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    last: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, ids: np.ndarray, inside: np.ndarray) -> tuple:
        x = np.concatenate([self.embed[ids], inside[:, :, None]], axis=2)
        cols = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(ids), LENGTH - KERNEL + 1, -1)
        z = cols @ self.conv + self.bias
        a = np.maximum(z, 0)
        weight = inside[:, KERNEL // 2 : LENGTH - KERNEL // 2]
        weight = weight / np.maximum(weight.sum(1, keepdims=True), 1)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], (a * weight[:, :, None]).sum(1)], axis=1)
        return cols, z, weight, top, pooled, pooled @ self.out + self.last[0]

    def probability(self, ids: np.ndarray, inside: np.ndarray) -> np.ndarray:
        logit = np.concatenate([self.forward(ids[i : i + 512], inside[i : i + 512])[-1] for i in range(0, len(ids), 512)])
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -60, 60)))


def train(seed: int = SEED, n: int = FINDINGS, epochs: int = EPOCHS, recall: float = RECALL) -> Network:
    """Fit on three quarters of the findings; calibrate and set the threshold on the rest."""
    data = [x for pair in zip(findings(n, seed), more_findings(n, seed + 1), strict=True) for x in pair]
    n = len(data)
    # of a harmless run any window, as a scan reads all of them
    cuts = [[(a, b)] if secret else windows(t, a, b) for t, a, b, secret in data]
    read = [_window(d[0], *c[i % len(c)]) for i, (d, c) in enumerate(zip(data, cuts, strict=True))]
    ids, inside, y = np.stack([w[0] for w in read]), np.stack([w[1] for w in read]), np.array([d[3] for d in data], np.float32)
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (SYMBOLS, EMBED)).astype(np.float32), rng.normal(0, 0.2, (KERNEL * (EMBED + 1), FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), np.zeros(1, np.float32))
    names = ("embed", "conv", "bias", "out", "last")
    moment = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    fit, step = np.arange(n) < n * 3 // 4, 0
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(fit))
        for at in range(0, len(order), 64):
            b = order[at : at + 64]
            cols, z, weight, top, pooled, logit = net.forward(ids[b], inside[b])
            d = (1 / (1 + np.exp(-logit)) - y[b]) / len(b)
            dp = d[:, None] * net.out
            da = dp[:, None, FILTERS:] * weight[:, :, None]
            np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + dp[:, None, :FILTERS], 1)
            dz = da * (z > 0)
            dcols = (dz @ net.conv.T).reshape(len(b), -1, KERNEL, EMBED + 1)
            dx = np.zeros((len(b), LENGTH, EMBED + 1), np.float32)
            for j in range(KERNEL):
                dx[:, j : j + LENGTH - KERNEL + 1] += dcols[:, :, j]
            de = np.zeros_like(net.embed)
            np.add.at(de, ids[b], dx[:, :, :EMBED])
            grads = {"embed": de, "conv": np.einsum("nlc,nlf->cf", cols, dz, optimize=True), "bias": dz.sum((0, 1)), "out": pooled.T @ d, "last": d.sum(keepdims=True)}
            step += 1
            for k in names:
                m, v = moment[k]
                m += 0.1 * (grads[k] - m)
                v += 0.01 * (grads[k] ** 2 - v)
                setattr(net, k, (getattr(net, k) - 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    held = ~fit
    logit = net.forward(ids[held], inside[held])[-1].astype(float)
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a * logit + b)))
        a, b = max(a - 0.05 * (((p - y[held]) * logit).mean() + 0.01 * (a - 1)), 0.05), b - 0.05 * (p - y[held]).mean()
    net.slope, net.shift = float(a), float(b)
    # the threshold by what a scan scores, without keys that the patterns find
    planted = [d for d in data[n * 3 // 4 :] if d[3]]
    base = [base_spans(d[0]) for d in planted]
    best = np.zeros(len(planted))
    for (i, a, b), p in score([d[0] for d in planted], base, net):
        if a < planted[i][2] and planted[i][1] < b:
            best[i] = max(best[i], p)
    best = best[[not any(x <= a and b <= y for x, _, y in own) for (_, a, b, _), own in zip(planted, base, strict=True)]]
    net.threshold = float(np.sort(best)[int((1 - recall) * len(best))])
    return net


_trained: list[Network] = []


def network() -> Network:
    if not _trained:
        _trained.append(train())
    return _trained[0]


def scan(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text, sorted."""
    out = [base_spans(text) for text in texts]
    for (i, a, b), p in score(texts, out, net):
        if p >= net.threshold:
            out[i].append((a, 3, b))
    return [sorted(s) for s in out]


def score(texts: list[str], base: list[list[tuple[int, int, int]]], net: Network) -> list[tuple[tuple[int, int, int], float]]:
    """((text, start, end), largest probability of its windows) of each candidate."""
    place = [(i, a, b) for i, text in enumerate(texts) for a, b in candidates(text, base[i])]
    out, queue, size = [], [], 0
    for p in place:
        queue.append((p, windows(texts[p[0]], *p[1:])))
        size += len(queue[-1][1])
        if size >= 4096 or p is place[-1]:  # bounds memory
            read = [_window(texts[i], a, b) for (i, _, _), cuts in queue for a, b in cuts]
            found = net.probability(np.stack([x for x, _ in read]), np.stack([y for _, y in read]))
            at = np.cumsum([0, *(len(cuts) for _, cuts in queue)])
            out += [(q, float(found[a:b].max())) for (q, _), a, b in zip(queue, at, at[1:], strict=False)]
            queue, size = [], 0
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans) of each document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    net = network()

    def make():
        def work(texts):
            found = scan(texts, net)
            counts = [[sum(s[1] == k for s in x) for x in found] for k in range(4)]
            return None, (*counts, [hashlib.sha256(_joined([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found], [_joined(x) for x in found])

        return work

    return map_texts(docs, make, "n_assign bigint, n_access bigint, n_hex bigint, n_model bigint, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    end = -1
    for a, _, b in spans:
        if a > end:
            out += [text[at : max(a, at)], mark] if a >= at else []
            end = b
        end = max(end, b)
        at = max(at, end)
    return "".join(out) + text[at:]


def secret_redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, secrets in the text replaced; null texts stay null."""
    import pyarrow as pa

    net, columns = network(), docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(columns.index(text_col)).to_pylist()
            done = []
            for cut in blocks([t or "" for t in texts]):
                done += [None if t is None else redact(t, s) for t, s in zip(texts[cut], scan([t or "" for t in texts[cut]], net), strict=True)]
            new = {text_col: pa.array(done, batch.schema.field(text_col).type)}
            if length_col:
                new[length_col] = pa.array([None if t is None else len(t) for t in done], batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
