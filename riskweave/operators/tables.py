"""Plumbing of wide policy tables: choosing, renaming, joining and flattening columns by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_prompt
from .likelihood import lik_columns
from .ranking import lowest
from .sampling import quantile_filter, uniform


def likelihood_table(df: DataFrame, prefix: str = "lik_r", rounds: int | None = None, keep: tuple[str, ...] = ("id", "particle", "score")) -> DataFrame:
    """The identifying columns and the first ``rounds`` likelihood columns, by name and in round order."""
    return df.select(*[c for c in keep if c in df.columns], *lik_columns(df.columns, prefix)[:rounds])


def next_seeds(pairs: DataFrame) -> DataFrame:
    """Better particles become the next round's worse ones: lower_score_particle is renamed, lower_score becomes score."""
    return pairs.withColumnsRenamed({"lower_score_particle": "higher_score_particle", "lower_score": "score"}).select("higher_score_particle", "score")


def constrained_names(df: DataFrame) -> DataFrame:
    """lik_r<i> as con_lik_r<i>: at the start, both policies are one."""
    return df.withColumnsRenamed({c: f"con_{c}" for c in lik_columns(df.columns)})


def beside(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of one id side by side; columns of both names come from the left."""
    return left.join(right.select(id_col, *[c for c in right.columns if c not in left.columns]), id_col)


def with_likelihood(df: DataFrame) -> DataFrame:
    """``likelihood`` from ``loglikelihood`` where only that is there; without either the table stays as it is."""
    if "likelihood" in df.columns or "loglikelihood" not in df.columns:
        return df
    return df.withColumn("likelihood", F.exp("loglikelihood"))


def prefilter(df: DataFrame, n: int | None, lik: str, lower: float | None = None, band: tuple[float, float] | None = None, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Down to n rows, if there are more: a lower quantile comes before a range of quantiles, then a uniform sample."""
    if n is None or df.count() <= n:
        return df
    if lower is not None:
        df = quantile_filter(df, lik, lower)
    elif band is not None:
        df = quantile_filter(df, lik, *band)
    return uniform(df, n, seed, id_col)


def sanity_head(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The first n rows by id."""
    return lowest(df, n, id_col)


def round_sizes(rounds: DataFrame, rows: DataFrame, key: str = "round") -> DataFrame:
    """(round, n, weight): rows of every listed round; one without rows stays, with weight 0."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    full = rounds.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    total = full.agg(F.sum("n").alias("t"))  # one row
    return full.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") / F.greatest("t", F.lit(1))).alias("weight"))


def usable_prompts(prompts: DataFrame, known: DataFrame) -> DataFrame:
    """Prompts with a known data set, whose scores are there and whose self-evaluations are not all close to -1.

    ``prompts`` holds prompt and, as arrays or null, frequencies, selfevals and logprobs; ``known``
    question and dataset. The result has dataset as well.
    """
    close = F.forall("selfevals", lambda x: F.abs(x + 1) <= 1e-8 + 1e-5)
    there = F.col("frequencies").isNotNull() & F.col("selfevals").isNotNull() & F.col("logprobs").isNotNull()
    named = prompts.withColumn("question", F.trim(clean_prompt("prompt"))).join(known.groupBy("question").agg(F.max("dataset").alias("dataset")), "question")
    return named.filter(there & ~close)


def all_supported(df: DataFrame, facts: str = "facts") -> DataFrame:
    """Rows all of whose claims are supported."""
    return df.filter(F.forall(facts, lambda x: x["is_supported"]))


def prompt_features(df: DataFrame, categories: list[str], dataset: str = "dataset") -> DataFrame:
    """(prompt, features): one, lengths of response and prompt, mean and population deviation of the log-probabilities, and all indicators but the last."""
    n = F.greatest(F.size("logprobs"), F.lit(1))
    mean = F.aggregate("logprobs", F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate("logprobs", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    ones = [(F.col(dataset) == c).cast("double") for c in categories[:-1]]
    return df.select("prompt", F.array(F.lit(1.0), F.length("response").cast("double"), F.length(F.trim(clean_prompt("prompt"))).cast("double"), mean, spread, *ones).alias("features"))


def dummies(df: DataFrame, column: str, categories: list[str], drop_last: bool = False) -> list[Column]:
    """Indicators of a column's values."""
    return [(F.col(column) == c).cast("int").alias(f"is_{c}") for c in (categories[:-1] if drop_last else categories)]


def flatten_config(config: dict, prefix: str = "") -> list[str]:
    """``a.b=c`` of a nested dictionary, in its order."""
    out = []
    for k, v in config.items():
        out += flatten_config(v, f"{prefix}{k}.") if isinstance(v, dict) else [f"{prefix}{k}={v}"]
    return out


# The parameters of the two kinds of test functions.
TEST_FUNCTIONS = {"ehrlich": ("num_states", "dim", "num_motifs", "motif_length", "motifs", "spacings", "quantization", "noise_std", "negate", "random_seed"), "rough_mt_fuji": ("dim", "additive_term", "random_term_std", "noise_std", "negate", "random_seed")}


def test_function_record(spark: SparkSession, kind: str, parameters: dict, schema: str) -> DataFrame:
    """One row of a test function's parameters; an unknown kind, or a parameter that is missing, is an error."""
    if kind not in TEST_FUNCTIONS:
        raise ValueError(f"no such test function: {kind}")
    if missing := [k for k in TEST_FUNCTIONS[kind] if k not in parameters]:
        raise ValueError(f"missing: {missing}")
    return spark.createDataFrame([tuple(parameters[k] for k in TEST_FUNCTIONS[kind])], schema)


def later_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of tables in order, where a later table's row replaces an earlier one's of the same key."""
    out = None
    for i, t in enumerate(tables):
        own = t.withColumn("_at", F.lit(i))
        out = own if out is None else out.unionByName(own)
    rest = [c for c in out.columns if c not in (key, "_at")]
    last = out.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("v"))
    return last.select(key, *[F.col(f"v.{c}").alias(c) for c in rest])


def distinct_text(df: DataFrame, column: str, order: str = "id") -> DataFrame:
    """The first row of each value, values compared as text."""
    first = df.groupBy(F.col(column).cast("string").alias("_k")).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


def mean_by_key(df: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """(key, mean) of stored metrics."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"))


def mean_distance(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mean): over values that are numbers, before any deduplication; null without one."""
    return df.groupBy(*by).agg(F.avg(F.when(~F.isnan(column), F.col(column))).alias("mean"))


def row_counter(df: DataFrame, keep: Column, order: list[str]) -> DataFrame:
    """Rows that ``keep`` holds for, with their number among all rows, kept or not."""
    from .ranking import running

    return running(df, order[0], order[1:], name="counter").filter(keep)


def paired_files(models: list[str], files: list[str]) -> list[tuple[str, str]]:
    """Models and seed files by place; different numbers of them are an error."""
    if len(models) != len(files):
        raise ValueError(f"{len(models)} models and {len(files)} seed files")
    return list(zip(models, files, strict=True))


def lookup(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows with what a dictionary table, the last value of each key in order, says of them."""
    values = [c for c in keys.columns if c not in (on, "ord")]
    last = keys.groupBy(on).agg(F.max_by(F.struct(*values), "ord").alias("_v"))
    return df.join(last, on).select(*df.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


def in_all(df: DataFrame, others: list[DataFrame], on: str) -> DataFrame:
    """Rows whose key every other table holds, with their columns."""
    for o in others:
        df = df.join(o, on)
    return df


def ordered_pairs(df: DataFrame, first: str, second: str) -> DataFrame:
    """Two lists sorted together by the first, ties by the second, with their place from 0."""
    from .ranking import running

    return running(df.select(first, second), first, [second], name="place").withColumn("place", F.col("place") - 1)


def gate_checkpoints(metrics: DataFrame, metric: str, threshold: float, higher: tuple[str, ...], lower: tuple[str, ...], greater_is_better: bool = True, step: str = "step", run: tuple[str, ...] = ()) -> DataFrame:
    """(run, step, is_best): whether a checkpoint is the best so far of its run among those that are valid.

    Valid means that all of the ``higher`` shares reach the threshold and the ``lower`` ones stay
    at or below one minus it; a null share is not looked at. Steps are bounded by a run's length.
    """
    ok = F.lit(True)
    for c in higher:
        ok = ok & F.coalesce(F.col(c) >= threshold, F.lit(True))
    for c in lower:
        ok = ok & F.coalesce(F.col(c) <= 1 - threshold, F.lit(True))
    sign = 1 if greater_is_better else -1
    before = Window.partitionBy(*run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)  # a run's evaluations
    best = F.max(F.when(F.col("_ok"), sign * F.col(metric))).over(before)
    marked = metrics.withColumn("_ok", ok)
    return marked.select(*run, step, (F.col("_ok") & F.coalesce(sign * F.col(metric) > best, F.lit(True))).alias("is_best"))


def checkpoint_files(gpus: int = 2, shards: int = 3) -> list[str]:
    """Names of all files of a complete checkpoint."""
    # The names that a trainer writes.
    names = ["config.json", "generation_config.json", "optimizer.pt", "scheduler.pt", "training_args.bin", "trainer_state.json", "model.safetensors.index.json", "special_tokens_map.json", "tokenizer_config.json", "tokenizer.json"]
    return names + [f"model-{i:05d}-of-{shards:05d}.safetensors" for i in range(1, shards + 1)] + [f"rng_state_{i}.pth" for i in range(gpus)]


def latest_complete(listing: DataFrame, gpus: int = 2, shards: int = 3) -> DataFrame:
    """(checkpoint, missing) of (checkpoint, file) rows of all stores: how many files each lacks; the largest number with none is the latest complete one."""
    spark = listing.sparkSession
    wanted = spark.createDataFrame([(f,) for f in checkpoint_files(gpus, shards)], "file string")
    every = listing.select("checkpoint").distinct().crossJoin(F.broadcast(wanted))  # a checkpoint's few files
    lacking = every.join(listing.select("checkpoint", "file").distinct(), ["checkpoint", "file"], "left_anti").groupBy("checkpoint").agg(F.count("*").alias("missing"))
    return listing.select("checkpoint").distinct().join(lacking, "checkpoint", "left").select("checkpoint", F.coalesce("missing", F.lit(0)).alias("missing"))


def chosen_checkpoints(listing: DataFrame, metrics: DataFrame, metric: str, gpus: int = 2, shards: int = 3, greater_is_better: bool = False) -> DataFrame:
    """(latest, best, n_complete): of the checkpoints that lack no file, the largest number and the one of the best metric, the later of equals.

    A metric that is null or NaN, or a checkpoint without one, cannot be the best; both are null if
    no checkpoint is complete.
    """
    whole = latest_complete(listing, gpus, shards).filter("missing = 0").select("checkpoint")
    value = F.when(~F.isnan(metric), F.col(metric) if greater_is_better else -F.col(metric))
    known = whole.join(metrics.select("checkpoint", value.alias("_m")), "checkpoint", "left")
    rank = F.when(F.col("_m").isNotNull(), F.struct("_m", "checkpoint"))
    return known.agg(F.max("checkpoint").alias("latest"), F.max_by("checkpoint", rank).alias("best"), F.count_distinct("checkpoint").alias("n_complete"))
