"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated.

Each rule looks at one figure of a text and votes good, bad, or not at all. The votes of all
documents are counted by pattern (at most 3 to the number of rules, whatever the input), and
expectation-maximisation on those counts estimates how often each rule votes and errs on good
and bad documents, and the share of good ones, without labels. A document's posterior
probability of being good replaces the usual demand that all rules pass.

Defined results: null or empty text has zero figures and fails the base rules; a text without
any vote gets the share of good documents; repeated rows are judged each; only the id and the
text column are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, blocks, map_texts, mix, stream, whole_text, word_hashes

_ROLL = stream(31, 8) | U64(1)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 256)]] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]")
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = "the of and to in is that for it with as was on are by this be le la les des et un une que qui dans pour est sur par avec der die das und in den von zu mit sich des auf ist im nicht el los las que se del y en por con para es al lo".split()
WINDOW = 5

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def figures(texts: list[str]) -> pd.DataFrame:
    """The base figures of each text, and those that only the rules use."""
    h, first, data, starts, ends = word_hashes(texts)
    size = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    before = np.concatenate([[0], np.cumsum(first[1:] - first[:-1])])

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[begin[1:]] - total[begin[:-1]]

    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    in_word = np.cumsum(edge[:-1]).astype(bool)
    word_chars = bytes_in(in_word & ((data & 0xC0) != 0x80))
    n_words = first[1:] - first[:-1]
    # windows: those of one text have WINDOW words in it; equal ones are found by sorting
    owner = np.repeat(np.arange(len(texts)), n_words)
    repeat = np.zeros(len(texts), np.int64)
    if len(h) >= WINDOW:
        with np.errstate(over="ignore"):
            roll = sum((h[j : len(h) - WINDOW + 1 + j] * _ROLL[j] for j in range(1, WINDOW)), h[: len(h) - WINDOW + 1] * _ROLL[0])
            whole = np.flatnonzero(owner[: len(roll)] == owner[WINDOW - 1 :])
            roll = mix(roll[whole]) + mix(owner[whole].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))
        order = np.argsort(roll, kind="stable")
        same = roll[order][1:] == roll[order][:-1]
        twice = np.zeros(len(roll), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, whole[twice], 1)
        np.add.at(cover, whole[twice] + WINDOW, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        repeat = covered[first[1:]] - covered[first[:-1]]
    same = np.concatenate([[0], np.cumsum((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))]) if len(h) else np.zeros(1, np.int64)
    at = np.concatenate([[0], same])  # at[j]: words before place j that equal the word before them
    stutter = np.where(n_words > 0, at[first[1:]] - at[np.minimum(first[:-1] + 1, len(at) - 1)], 0)
    stop = np.isin(h, _stop_hashes())
    stops = np.concatenate([[0], np.cumsum(stop)])
    dup, n_lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if _WORD.search(x)]
        n_lines[i] = len(lines)
        dup[i] = len(lines) - len(set(lines))
    assert before[-1] == len(h)
    return pd.DataFrame({
        "n_words": n_words, "word_chars": word_chars, "n_symbols": bytes_in(_SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": repeat,
        "n_lines": n_lines, "n_upper": bytes_in(_UPPER[data]), "n_letters": bytes_in(_LETTER[data]), "n_stop": stops[first[1:]] - stops[first[:-1]], "n_stutter": stutter,
    })


_stop = None


def _stop_hashes() -> np.ndarray:
    global _stop
    if _stop is None:
        _stop = np.unique(word_hashes([" ".join(STOP_WORDS)])[0])
    return _stop


#: Rules: a figure by row, and its bounds (bad below, good from, good to, bad above); between them no vote.
RULES = {
    "symbols": (lambda f: f.n_symbols / f.words, (-1, 0, 0.02, 0.1)),
    "word_length": (lambda f: f.word_chars / f.words, (2.0, 3.0, 9.0, 14.0)),
    "repeats": (lambda f: f.n_repeat_words / f.words, (-1, 0, 0.03, 0.2)),
    "duplicate_lines": (lambda f: f.n_dup_lines / np.maximum(f.n_lines, 1), (-1, 0, 0.1, 0.3)),
    "letters": (lambda f: f.n_letters / np.maximum(f.word_chars, 1), (0.65, 0.85, 2, 3)),
    "stop_words": (lambda f: np.where(f.n_words < 30, 0.05, f.n_stop / f.words), (0.02, 0.08, 2, 3)),  # short texts may have none
    "stutter": (lambda f: f.n_stutter / f.words, (-1, 0, 0.05, 0.25)),
    "capitals": (lambda f: f.n_upper / np.maximum(f.n_letters, 1), (-1, 0, 0.15, 0.4)),
    "length": (lambda f: f.n_words, (10, 30, np.inf, np.inf)),
}


def votes(f: pd.DataFrame) -> np.ndarray:
    """A code of each row's votes in base 3: 0 no vote, 1 bad, 2 good; the first rule counts most."""
    f = f.assign(words=np.maximum(f.n_words, 1))
    code = np.zeros(len(f), np.int64)
    for figure, (bad_below, good_from, good_to, bad_above) in RULES.values():
        x = np.asarray(figure(f), dtype=float)
        code = 3 * code + np.select([(x < bad_below) | (x > bad_above), (x >= good_from) & (x <= good_to)], [1, 2], 0)
    return code


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: (posterior of each, accuracies [rule, good], share of good).

    A rule's accuracy on a class is how often its vote is right there when it votes; abstaining
    is no evidence. Rules are written to spare good documents and each to catch one kind of bad
    ones, so they start as right on 19 of 20 good ones and 3 of 10 bad ones; a rule is held to
    accusing bad documents more often than good ones, which keeps the classes in place.
    """
    n = len(RULES)
    vote = _votes_of(codes)
    right, share, post = np.tile([0.3, 0.95], (n, 1)), 0.8, np.full(len(codes), 0.8)
    for _ in range(rounds if counts.sum() else 0):
        post = posterior(codes, right, share)
        share = float(np.clip((post * counts).sum() / counts.sum(), 0.05, 0.95))
        for g, weight in enumerate(((1 - post) * counts, post * counts)):
            voted = (weight[:, None] * (vote > 0)).sum(0)
            hit = (weight[:, None] * (vote == g + 1)).sum(0)
            right[:, g] = np.clip((hit + smooth) / (voted + 2 * smooth), 0.8 if g else 0.02, 0.9995)
        # a bad vote is likelier on bad documents than on good ones
        right[:, 0] = np.maximum(right[:, 0], 1 - right[:, 1])
    return posterior(codes, right, share) if len(codes) else post, right, share


def _votes_of(codes: np.ndarray) -> np.ndarray:
    n = len(RULES)
    return np.stack([codes // 3 ** (n - 1 - j) % 3 for j in range(n)], axis=1)


def posterior(codes: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    """Probability of good for vote patterns, by rules' accuracies and the share of good."""
    vote, log = _votes_of(codes), []
    for g in (0, 1):
        p = np.where(vote == g + 1, right[:, g], 1 - right[:, g])
        log.append(np.log(share if g else 1 - share) + np.where(vote == 0, 0.0, np.log(p)).sum(1))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _model(patterns: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(patterns, posteriors, accuracies, share), from counts (votes, n) that are bounded by the number of patterns."""
    seen = patterns.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").toPandas()
    codes = seen["votes"].to_numpy(np.int64)
    return codes, *estimate(codes, seen["n"].to_numpy(float))


def _verdict(f: pd.DataFrame, code: np.ndarray, right: np.ndarray, share: float, least: float) -> np.ndarray:
    failed = ((f.n_words < 10) | (100 * f.n_repeat_words > 20 * f.n_words)).to_numpy()
    return ~failed & (posterior(code, right, share) >= least)


def quality_rules(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, figures, base_failed, posterior, kept) of each document."""
    spark = docs.sparkSession
    keep = Scratch(spark, "quality")
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def make():
        def work(texts):
            f = figures(texts)
            return None, [*(f[c] for c in FIGURES), votes(f)]

        return work

    found = keep.put(map_texts(docs, make, ", ".join(f"{c} bigint" for c in FIGURES) + ", votes bigint"), "figures")
    model = _model(found.groupBy("votes").agg(F.count("*").alias("n")))
    table = spark.createDataFrame(list(zip(model[0].tolist(), model[1].tolist(), strict=True)), "votes bigint, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = found.join(F.broadcast(table), "votes").withColumn("base_failed", failed)
    return out.select("doc_id", *FIGURES, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"))


def quality_filter(docs: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that quality_rules keeps, with all their columns; texts are read twice, never shuffled."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for cut in blocks(texts):
                code, n = np.unique(votes(figures(texts[cut])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["votes", "n"])

    _, _, right, share = _model(docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "votes bigint, n bigint"))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            for cut in blocks(texts):
                f = figures(texts[cut])
                stays = _verdict(f, votes(f), right, share, least)
                yield batch.slice(cut.start, cut.stop - cut.start).filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
