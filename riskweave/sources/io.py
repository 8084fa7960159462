"""Readers and writers of the formats that policy experiments use, by any Hadoop path."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

AIRFOIL = ("Frequency", "Angle", "Chord", "Velocity", "Suction", "Sound")


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | StructType | None = None, numbers: tuple[str, ...] = ()) -> DataFrame:
    """Rows of JSON lines; ``numbers`` names columns of numeric text ("0.100", "inf") to read as doubles."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.json(paths)
    return df.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def read_json_documents(spark: SparkSession, paths: str | list[str], schema: str | StructType | None = None) -> DataFrame:
    """One row per whole-file JSON document."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(paths)


def read_named_jsonl(spark: SparkSession, directory: str, key: str) -> DataFrame:
    """(key, dataset): the name of the last file, in name order, that holds each key."""
    rows = spark.read.schema(f"`{key}` string").json(f"{directory.rstrip('/')}/*.jsonl").select(F.col(key), F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1).alias("dataset"))
    return rows.groupBy(key).agg(F.max("dataset").alias("dataset"))


def read_table_text(spark: SparkSession, path: str, names: tuple[str, ...], sep: str = ",", header: bool = False) -> DataFrame:
    """Delimited numbers with given column names."""
    schema = StructType([StructField(n, DoubleType()) for n in names])
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_airfoil(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, without header; frequency and suction as logarithms."""
    df = read_table_text(spark, path, AIRFOIL, "\t")
    return df.withColumns({"Frequency": F.ln("Frequency"), "Suction": F.ln("Suction")})


def read_semicolon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).option("inferSchema", True).csv(path)


def read_without_missing(spark: SparkSession, path: str, skip: int = 5, missing: str = "?") -> DataFrame:
    """CSV as doubles, without the first columns and any column that has a missing mark: one pass finds those."""
    raw = spark.read.csv(path)
    rest = raw.columns[skip:]
    holes = raw.agg(*[F.max((F.trim(F.col(c)) == missing).cast("int")).alias(c) for c in rest]).first()
    return raw.select(*[F.col(c).cast("double").alias(c) for c in rest if not holes[c]])


def read_whitespace(spark: SparkSession, path: str) -> DataFrame:
    """(values): numbers parted by any white space; the label is the last."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("values"))


def read_log_label(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV whose last column becomes ln(1 + y)."""
    df = spark.read.option("inferSchema", True).csv(path)
    last = df.columns[-1]
    return df.withColumn(last, F.log1p(F.col(last).cast("double")))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an ARFF file's data part, numeric attributes as doubles.

    The header is read from the lines before @data; data lines are those that hold as many
    values as there are attributes and start with neither @ nor %.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    names = [r[0] for r in lines.filter(F.lower(F.trim("value")).startswith("@attribute")).select(F.regexp_extract("value", r"(?i)@attribute\s+('[^']+'|\"[^\"]+\"|\S+)", 1)).collect()]
    names = [n.strip("'\"") for n in names]
    parts = F.split("value", r"\s*,\s*")
    data = lines.filter(~F.trim("value").rlike("^[@%]")).select(parts.alias("p")).filter(F.size("p") == len(names))
    return data.select(*[F.trim(F.get("p", F.lit(i))).try_cast("double").alias(n) for i, n in enumerate(names)])


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("name"))


def read_demonstrations(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, fact) of a JSON dictionary of lists."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("sentence", "facts")).select("sentence", F.explode("facts").alias("fact"))


def read_npz(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, values): the arrays of .npz files by name, one dimension only; a file is read by one task."""
    import io as memory

    import numpy as np
    import pandas as pd

    def load(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with np.load(memory.BytesIO(content), allow_pickle=False) as found:
                    rows = [(k, found[k].astype(float).tolist()) for k in found.files if found[k].ndim == 1]
                yield pd.DataFrame(rows, columns=["name", "values"])

    return spark.read.format("binaryFile").load(pattern).select("content").mapInPandas(load, "name string, values array<double>")


def parse_sweep(text: str) -> dict:
    """A sweep's settings: scalars, lists in brackets or with dashes, and one level of named lists.

    That part of YAML is read here, so that no further package is needed.
    """

    def scalar(x: str):
        x = x.strip()
        if x.startswith("[") and x.endswith("]"):
            return [scalar(v) for v in x[1:-1].split(",")] if x[1:-1].strip() else []
        if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"":
            return x[1:-1]
        if x.lower() in ("true", "false"):
            return x.lower() == "true"
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                continue
        return x

    root: dict = {}
    stack: list[tuple[int, dict, str]] = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.strip().startswith("#"):
            continue
        depth, body = len(body) - len(body.lstrip()), body.strip()
        if body.startswith("- "):
            _, owner, key = stack[-1]
            if not isinstance(owner[key], list):
                owner[key] = []
            owner[key].append(scalar(body[2:]))
            continue
        key, colon, value = body.partition(":")
        if not colon:
            raise ValueError(f"no setting: {line}")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        owner = root
        if stack:
            _, above, name = stack[-1]
            if not isinstance(above[name], dict):
                above[name] = {}
            owner = above[name]
        owner[key.strip()] = scalar(value) if value.strip() else None
        stack.append((depth, owner, key.strip()))
    return root


def read_sweep(spark: SparkSession, path: str) -> tuple[str, bool, list[str], list[list[str]]]:
    """(base_config, cache, overrides, jobs) of a sweep file; a job is a list of ``name=value``.

    A file that is missing or holds no settings, no base_config, or parameters that are no lists
    is an error. last_seed follows initial_seed unless it is set.
    """
    from itertools import product

    try:
        text = spark.read.text(path, wholetext=True).first()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from None
        raise
    sweep = parse_sweep(text[0] if text else "")
    if not sweep:
        raise ValueError(f"no settings: {path}")
    if "base_config" not in sweep:
        raise ValueError("base_config is missing")
    fixed, parameters = list(sweep.get("overrides") or []), sweep.get("parameters") or {}
    if wrong := [k for k, v in parameters.items() if not isinstance(v, list)]:
        raise ValueError(f"no lists: {wrong}")
    follow = "initial_seed" in parameters and "last_seed" not in parameters and not any(o.startswith("last_seed=") for o in fixed)
    jobs = []
    for values in product(*parameters.values()):
        own = dict(zip(parameters, values, strict=True))
        jobs.append(fixed + [f"{k}={v}" for k, v in own.items()] + ([f"last_seed={own['initial_seed']}"] if follow else []))
    return sweep["base_config"], bool(sweep.get("cache", False)), fixed, jobs


def train_test_split(df: DataFrame, share: float, seed: int, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(train, test): int(n * share) rows by rank of an MD5 key, and the others."""
    from ..operators.sampling import uniform

    train = uniform(df, int(df.count() * share), seed, id_col)
    return train, df.join(train.select(id_col), id_col, "left_anti")


_KEPT: dict[str, DataFrame] = {}


def read_jsonl_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL table that is kept: up to 32 paths, the one that was asked for least recently goes first."""
    df = _KEPT.pop(path, None)
    if df is None or df.sparkSession is not spark:
        df = read_jsonl(spark, path, schema).cache()
    _KEPT[path] = df
    while len(_KEPT) > 32:
        _KEPT.pop(next(iter(_KEPT))).unpersist()
    return df


def largest_file(spark: SparkSession, pattern: str) -> str | None:
    """The path of the largest file; lengths come from the listing, contents are not read."""
    row = spark.read.format("binaryFile").load(pattern).select("path", "length").agg(F.max_by("path", F.struct("length", "path"))).first()
    return row[0]


def first_file(spark: SparkSession, pattern: str) -> str | None:
    return spark.read.format("binaryFile").load(pattern).select("path").agg(F.min("path")).first()[0]


def for_json(df: DataFrame) -> DataFrame:
    """Doubles that are not finite become null, as in JSON records."""

    def clean(c: str) -> Column:
        return F.when(~F.isnan(c) & (F.abs(c) != math.inf), F.col(c))

    return df.select(*[clean(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_jsonl(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """JSON lines; without ``overwrite`` an existing result stays as it is."""
    for_json(df).write.mode("overwrite" if overwrite else "ignore").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "ignore").option("header", True).csv(path)


def write_csv_indexed(df: DataFrame, path: str, order: str, overwrite: bool = True) -> None:
    """CSV whose first, unnamed column counts the rows from 0."""
    from ..operators.ranking import running

    rest = df.columns
    write_csv(running(df, order, [], name="_rn").select((F.col("_rn") - 1).alias("_c0"), *rest).withColumnRenamed("_c0", "index"), path, overwrite)


def append_seeds(df: DataFrame, path: str, seed: str = "seed") -> None:
    """A checkpoint after some seeds: their partitions are replaced, those of other seeds stay."""
    write_partitioned(df, path, seed)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet by keys (alpha, seed, round, ...) instead of parameters in file names; keys are replaced one by one."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def fill_column(df: DataFrame, values: DataFrame, name: str, path: str, id_col: str = "id") -> DataFrame:
    """The table with one more column, written to a new path (a path that is read can't be overwritten)."""
    df.drop(name).join(values.select(id_col, name), id_col, "left").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def round_document(quality: DataFrame, sizes: DataFrame, timing: dict[str, float], round_idx: int) -> DataFrame:
    """(json): one nested metrics record; numbers that are not finite stand as Infinity and NaN.

    ``quality`` and ``sizes`` hold one row each.
    """
    nested = quality.select(F.struct("*").alias("quality")).crossJoin(sizes.select(F.struct("*").alias("dataset_sizes")))  # one row each
    times = F.struct(*[F.lit(float(v)).alias(k) for k, v in timing.items()])
    record = nested.select(F.lit(round_idx).alias("round_idx"), "quality", "dataset_sizes", times.alias("timing"))
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    for name in ("NaN", "Infinity", "-Infinity"):
        text = F.replace(text, F.lit(f':"{name}"'), F.lit(f":{name}"))
    return record.select(text.alias("json"))


def write_document(df: DataFrame, path: str, column: str = "json", overwrite: bool = True) -> None:
    """One JSON text a row."""
    df.select(F.col(column).alias("value")).write.mode("overwrite" if overwrite else "ignore").text(path)


def metrics_json(record: dict) -> str:
    """A metrics record as JSON with Infinity and NaN as constants; it reads back equal."""
    return json.dumps(record, allow_nan=True)
