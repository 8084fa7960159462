"""Functions of integer sequences and ragged arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import col


def hamming(a: str | Column, b: str | Column) -> Column:
    """Share of places that differ."""
    a, b = col(a), col(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def starts_with(x: str | Column, head: str | Column) -> Column:
    return F.slice(col(x), F.lit(1), F.size(col(head))) == col(head)


def find_sublist(x: str | Column, needle: str | Column) -> Column:
    """First place of ``needle`` in ``x`` from 0, or null."""
    x, n = col(x), col(needle)
    last = F.size(x) - F.size(n)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(places, lambda i: F.slice(x, i + 1, F.size(n)) == n), F.lit(0))


def mask_before(x: str | Column, start: str | Column, mask: int = -100) -> Column:
    """Labels with everything before ``start`` masked; all of it if start is null."""
    return F.transform(col(x), lambda v, i: F.when(F.coalesce(i < col(start), F.lit(True)), mask).otherwise(v))


def pad_to(x: str | Column, n: int, value: int, left: bool = False) -> Column:
    x = col(x)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(x), F.lit(0)))
    return F.concat(fill, x) if left else F.concat(x, fill)


def transitions_allowed(x: str | Column, allowed: str | Column) -> Column:
    """Whether every step between known states is allowed; null states are wildcards."""
    x, allowed = col(x), col(allowed)
    steps = F.when(F.size(x) > 1, F.sequence(F.lit(1), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    return F.forall(steps, lambda i: F.coalesce(F.get(F.get(allowed, F.get(x, i - 1)), F.get(x, i)) > 0, F.get(x, i - 1).isNull() | F.get(x, i).isNull()))


def log_prob_until(tokens: str | Column, logps: str | Column, stop: int, mean: bool = False) -> Column:
    """Sum or mean of token log-probabilities up to and with the first ``stop`` token."""
    tokens, logps = col(tokens), col(logps)
    at = F.array_position(tokens, stop)
    used = F.when(at > 0, F.slice(logps, F.lit(1), at.cast("int"))).otherwise(logps)
    total = F.aggregate(used, F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(F.size(used), F.lit(1)) if mean else total


def gaps(x: str | Column) -> Column:
    """(first, last) places, from 0, of each maximal run of nulls."""
    x = col(x)
    places = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    empty = lambda i: (i >= 0) & (i < F.size(x)) & F.get(x, i).isNull()
    starts = F.filter(places, lambda i: empty(i) & ~F.coalesce(empty(i - 1), F.lit(False)))
    ends = F.filter(places, lambda i: empty(i) & ~F.coalesce(empty(i + 1), F.lit(False)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def place_motif(x: str | Column, motif: list[int], spacing: list[int], allowed: str | Column) -> Column:
    """All copies of a partly known sequence with a spaced motif written into it, at every place where
    it fits over what is known and leaves only allowed steps. ``spacing`` holds the motif's offsets."""
    x = col(x)
    starts = F.when(F.size(x) > max(spacing), F.sequence(F.lit(0), F.size(x) - 1 - max(spacing))).otherwise(F.array().cast("array<int>"))

    def put(out: Column, at: Column, m: int) -> Column:
        return F.transform(out, lambda v, j: F.when(j == at, F.lit(m)).otherwise(v))

    def written(i):
        out = x
        for m, o in zip(motif, spacing, strict=True):
            out = put(out, i + o, m)
        return out

    def fits(i):
        out = F.lit(True)
        for m, o in zip(motif, spacing, strict=True):
            out = out & F.coalesce(F.get(x, i + o) == m, F.lit(True))
        return out

    return F.filter(F.transform(F.filter(starts, fits), written), lambda y: transitions_allowed(y, allowed))


def motif_placements(df: DataFrame, x: str, motifs: list[list[int]], spacings: list[list[int]], allowed: list[list[int]], id_col: str = "id") -> DataFrame:
    """(id, places, placed): all ways to write spaced motifs, one after the other, into each partly known sequence.

    A motif may share places with what is known or written if it agrees with it. ``places`` holds
    where each motif begins; ``placed`` leaves unknown what nothing says, and has only allowed
    steps between neighbours that are known. A table function walks the motifs and leaves a branch
    as soon as it clashes, so nothing is made for the choices behind it; rows come one by one, and
    no row's placements are held together.
    """
    spans = [max(s) for s in spacings]

    @F.udtf(returnType="places array<int>, placed array<int>")
    class Placements:
        def eval(self, sequence):
            if sequence is None or len(sequence) <= max(spans, default=0):
                return
            steps = lambda y, at: all(y[i] is None or y[i + 1] is None or allowed[y[i]][y[i + 1]] for a in at for i in (a - 1, a) if 0 <= i < len(y) - 1)

            def walk(y, places):
                m = len(places)
                if m == len(motifs):
                    yield places, y
                    return
                for start in range(len(y) - spans[m]):
                    at = [start + o for o in spacings[m]]
                    if all(y[i] is None or y[i] == v for i, v in zip(at, motifs[m], strict=True)):
                        new = list(y)
                        for i, v in zip(at, motifs[m], strict=True):
                            new[i] = v
                        if steps(new, at):
                            yield from walk(new, [*places, start])

            if steps(sequence, range(len(sequence))):
                yield from walk(list(sequence), [])

    return df.select(id_col, F.col(x).alias("_x")).lateralJoin(Placements(F.col("_x").outer())).drop("_x")


def _matches(particle: Column, motif: list[int], spacing: list[int]):
    """A function of a place: how many of a motif's elements stand there."""

    def at(i):
        found = F.lit(0)
        for m, o in zip(motif, spacing, strict=True):
            found = found + F.when(F.get(particle, i + o) == m, 1).otherwise(0)
        return found

    return at


def ehrlich(particle: str | Column, motifs: list[list[int]], spacings: list[list[int]], quantisation: int, allowed: str | Column | None = None) -> Column:
    """Minus the product over motifs of the best quantised share of a motif found anywhere; infinite with a banned step.

    ``spacings`` hold each motif's offsets from its first element.
    """
    particle, out = col(particle), F.lit(1.0)
    for motif, spacing in zip(motifs, spacings, strict=True):
        places = F.sequence(F.lit(0), F.size(particle) - 1 - max(spacing))
        out = out * F.floor(F.array_max(F.transform(places, _matches(particle, motif, spacing))) * quantisation / len(motif)) / quantisation
    return -out if allowed is None else F.when(transitions_allowed(particle, allowed), -out).otherwise(float("inf"))


def rough_field(particle: str | Column, optimum: list[int], slope: float, noise: Column) -> Column:
    """A rough, additive landscape: slope for each place that differs from the optimum, and a noise of the sequence's own."""
    differ = F.aggregate(F.zip_with(col(particle), F.array(*[F.lit(v) for v in optimum]), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)
    return slope * differ + noise


def path_counts(allowed: list[list[int]], length: int, start: int | None = None, end: int | None = None) -> list[int]:
    """How many allowed sequences of each length up to ``length`` there are, optionally from a state or to one.

    Exact integers of any size; the states are few and known to the driver.
    """
    states = range(len(allowed))
    ways = [int(start is None or i == start) for i in states]
    out = []
    for _ in range(length):
        out.append(sum(w for i, w in enumerate(ways) if end is None or i == end))
        ways = [sum(w for w, row in zip(ways, allowed, strict=True) if row[j]) for j in states]
    return out


def fillings(sequence: list[int | None], allowed: list[list[int]]) -> int:
    """How many allowed sequences agree with a partly known one: a product over its gaps.

    A sequence without any gap is an error, as there is nothing to count.
    """
    total, found, i = 1, False, 0
    while i < len(sequence):
        if sequence[i] is not None:
            i += 1
            continue
        j = i
        while j < len(sequence) and sequence[j] is None:
            j += 1
        before, after = (sequence[i - 1] if i else None), (sequence[j] if j < len(sequence) else None)
        total *= path_counts(allowed, j - i + (before is not None) + (after is not None), before, after)[-1]
        found, i = True, j
    if not found:
        raise ValueError("the sequence has no gap")
    return total
