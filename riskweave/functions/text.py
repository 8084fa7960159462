"""Text and parsing functions over sequences of small integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..semantics import col, list_text


def truncate_bracket(s: str | Column) -> Column:
    """The text up to its first ``]``, or all of it."""
    c = col(s)
    return F.when(F.instr(c, "]") > 0, F.substring(c, F.lit(1), F.instr(c, "]"))).otherwise(c)


def truncated_chars(s: str | Column) -> Column:
    """How many characters truncate_bracket cuts."""
    c = col(s)
    return F.when(F.instr(c, "]") > 0, F.length(c) - F.instr(c, "]")).otherwise(F.lit(0))


def _numbers(s: Column) -> Column:
    return F.from_json(s, "array<double>")


def _integral(p: Column) -> Column:
    return p.isNotNull() & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x == F.floor(x)))


def parse_strict(s: str | Column, dim: int, num_states: int | None = None) -> Column:
    """The sequence of a JSON list of exactly ``dim`` integers in range, else null."""
    p = _numbers(col(s))
    ok = _integral(p) & (F.size(p) == dim)
    if num_states is not None:
        ok = ok & F.forall(p, lambda x: (x >= 0) & (x < num_states))
    return F.when(ok, F.transform(p, lambda x: x.cast("int")))


def parse_permissive(s: str | Column, dim: int, pad: int = -1) -> Column:
    """As parse_strict without range; short lists are padded with ``pad``, long ones cut, empty ones null."""
    p = _numbers(col(s))
    whole = F.transform(p, lambda x: x.cast("int"))
    fit = F.when(F.size(p) >= dim, F.slice(whole, 1, dim)).otherwise(F.concat(whole, F.array_repeat(F.lit(pad), F.greatest(F.lit(dim) - F.size(p), F.lit(0)))))
    return F.when(_integral(p) & (F.size(p) > 0), fit)


def scoring_copy(s: str | Column, dim: int, highest: int | None = None) -> Column:
    """What a permissively parsed list is scored as: wrapped around to ``dim``, clipped to [0, highest]."""
    p = _numbers(col(s))
    top = dim - 1 if highest is None else highest
    wrapped = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.get(p, i % F.greatest(F.size(p), F.lit(1))))
    return F.when(_integral(p) & (F.size(p) > 0), F.transform(wrapped, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(top))).cast("int")))


def pair_text(first: str | Column, second: str | Column, prefix: str = "<inc>") -> Column:
    """``<inc> [1, 2]`` and the second list on the next line."""
    return F.concat(F.lit(f"{prefix} " if prefix else ""), list_text(first), F.lit("\n"), list_text(second))


def decimals(x: Column, digits: int) -> Column:
    """A number with up to three decimals, rounded half to even on its exact binary value, as C's printf does.

    0.125 gives 0.12, 0.0625 with three decimals 0.062, and 0.165, which lies above its decimal
    name, 0.17. ``inf``, ``-inf`` and ``nan`` if it is none. The fraction is taken apart into an
    exact integer of 63 bits; magnitudes from 1e15 on are whole numbers.
    """
    big = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    value = F.abs(x)
    whole = F.floor(F.when(value < 1e15, value).otherwise(0.0))
    rest = value - whole
    upper = F.floor(rest * 2.0**31)
    exact = upper.cast("decimal(10,0)") * big(2**32) + ((rest * 2.0**31 - upper) * 2.0**32).cast("bigint").cast("decimal(10,0)")
    scaled = (exact * F.lit(10**digits).cast("decimal(4,0)")).cast("decimal(38,0)")
    units = F.floor(scaled / big(2**63)).cast("bigint")
    over = (scaled - units.cast("decimal(10,0)") * big(2**63)) * F.lit(2).cast("decimal(1,0)")
    units = units + F.when((over > big(2**63)) | ((over == big(2**63)) & (units % 2 == 1)), 1).otherwise(0)
    carry = F.when(units == 10**digits, 1).otherwise(0)
    number = F.concat((whole + carry).cast("string"), F.lit("."), F.lpad((units % 10**digits).cast("string"), digits, "0"))
    number = F.concat(F.when(x < 0, "-").otherwise(""), F.when(value < 1e15, number).otherwise(F.concat(value.cast("decimal(38,0)").cast("string"), F.lit("." + "0" * digits))))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(number)


def score_text(score: Column, particle: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("Score: "), decimals(score, digits), F.lit("\nParticle: "), list_text(particle))


def plain_score(score: Column) -> Column:
    """Three decimals; ``inf`` for infinity, NaN and null."""
    bad = score.isNull() | F.isnan(score) | (score == float("inf"))
    return F.when(bad, "inf").otherwise(decimals(F.when(~bad, score), 3))


def instruction_prompt(about: str, score: Column, constraints: bool = True) -> Column:
    """The text that asks for a solution of a score, below a description of the test function."""
    return F.concat(F.lit(f"{about}\n" if constraints else ""), F.lit("Score: "), decimals(score, 2), F.lit("\nSolution:\n"))


# Fixed value: the request that stands above every edit.
EDIT_REQUEST = "\nGiven the following constraints, score (lower score is better), and original input, \nedit the original input to decrease the score.\n"


def edit_prompt(about: str, original: Column, score: Column) -> Column:
    """The text that asks for a better version of a sequence."""
    return F.concat(F.lit(f"{EDIT_REQUEST}\nConstraints:\n{about}\nOriginal input:\n"), list_text(original), F.lit("\nScore: "), decimals(score, 2), F.lit("\nEdited:\n"))


def preference_prompt(about: str) -> Column:
    return F.lit(f"Constraints:\n{about}\nSolution:\n")


def few_shot_prompt(shots: Column, score: Column) -> Column:
    """Blocks of (score, particle) structs parted by blank lines, then the score that is asked for."""
    block = lambda x: score_text(x["score"], x["particle"], 3)
    shown = F.transform(shots, lambda x: F.concat(block(x), F.lit("\n\n")))
    return F.concat(F.array_join(shown, ""), F.lit("Score: "), decimals(score, 3), F.lit("\nParticle: "))


def first_is_better(score: Column, other: Column) -> Column:
    """Whether the first of a pair is the lower one; ties go to the second."""
    return score < other


def new_tokens(generated: Column, labels: Column, mask: int = -100) -> Column:
    """Generated tokens behind the prompt, which is as long as the labels' masked beginning."""
    kept = F.filter(F.sequence(F.lit(0), F.size(labels)), lambda i: F.coalesce(F.get(labels, i) != mask, F.lit(False)))
    start = F.coalesce(F.get(kept, F.lit(0)), F.size(labels))
    return F.slice(generated, start + 1, F.greatest(F.size(generated) - start, F.lit(0)))


def clean_prompt(s: str | Column) -> Column:
    """Without leading commas, then without a leading ``digits,``."""
    return F.regexp_replace(F.regexp_replace(col(s), "^,+", ""), "^[0-9]+,+", "")


def subject_of(s: str | Column) -> Column:
    """The trimmed rest after the last ``about`` without its final character."""
    last = F.trim(F.element_at(F.split(col(s), "about"), -1))
    return F.substring(last, F.lit(1), F.greatest(F.length(last) - 1, F.lit(0)))


def drop_suffix(s: str | Column, suffix: str = "_qa") -> Column:
    return F.regexp_replace(col(s), f"{suffix}$", "")


def run_keys(path: str | Column) -> list[Column]:
    """alpha, seed and round out of a run's file name; null where absent."""
    c = col(path)
    return [
        F.regexp_extract(c, r"alpha([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"),
        F.regexp_extract(c, r"seed([0-9]+)", 1).try_cast("int"),
        F.regexp_extract(c, r"_r([0-9]+)$", 1).try_cast("int"),
    ]


def score_of_prompt(s: str | Column) -> Column:
    return F.regexp_extract(col(s), r"Score:\s*([^\n]*?)\s*\nParticle:", 1).try_cast("double")


def parse_bool(s: str | Column) -> Column:
    """Words for true and false; anything else is an error."""
    low = F.lower(F.trim(col(s)))
    return F.when(low.isin("y", "yes", "t", "true", "on", "1"), True).when(low.isin("n", "no", "f", "false", "off", "0"), False).otherwise(F.raise_error(F.concat(F.lit("no truth value: "), low)))


def counted_name(name: str | Column, n: str | Column) -> Column:
    """``name_{n}.ext``."""
    return F.regexp_replace(col(name), r"(\.[^./]*)$", F.concat(F.lit("_"), col(n).cast("string"), F.lit("$1")))


def short_hash(s: str | Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(col(s), 256), 1, digits)


def log_tail(s: str | Column, n: int = 30) -> Column:
    lines = F.split(col(s), "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")


def transient_error(message: str | Column, kind: str | Column = "") -> Column:
    """Whether a message, or the name of its error, speaks of a device that may be free later."""
    c = col(message)
    name = F.lit(kind) if isinstance(kind, str) else kind
    return c.contains("CUDA") | F.lower(c).contains("busy") | F.lower(c).contains("unavailable") | name.contains("AcceleratorError")
