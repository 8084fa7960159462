"""Queries that write a table in a format and read it back, each beside the SQL of what must come out."""

from __future__ import annotations

import io
import math

from pyspark.sql import functions as F

from ..operators.sampling import sample_quality
from ..sources import io as IO
from ..storage import new_path
from .catalogue import _r, query, r6
from .derive import CAL, calibration, table


@query("jsonl_round_trip", f"WITH {CAL} SELECT id, CASE WHEN isfinite(score) THEN score END AS score, grp FROM cal")
def jsonl_round_trip(spark, d):
    """Scores that are not finite come back as null."""
    at = new_path(spark, "jsonl")
    IO.write_jsonl(calibration(spark, d).select("id", "score", "grp"), at)
    return IO.read_jsonl(spark, at, "id bigint, score double, grp string")


@query("jsonl_many_files", f"WITH {CAL} SELECT id, TRY_CAST(CASE WHEN isfinite(score) THEN printf('%.3f', score) ELSE 'inf' END AS DOUBLE) < 1e300 AS finite FROM cal")
def jsonl_many_files(spark, d):
    """Two files as one table, numeric text read as numbers."""
    from ..functions.text import plain_score

    at = [new_path(spark, "jsonl"), new_path(spark, "jsonl")]
    rows = calibration(spark, d).select("id", plain_score(F.col("score")).alias("score"))
    for i, p in enumerate(at):
        IO.write_jsonl(rows.filter(F.col("id") % 2 == i), p)
    return IO.read_jsonl(spark, at, "id bigint, score string", ("score",)).select("id", (F.col("score") < 1e300).alias("finite"))


@query("jsonl_kept", f"WITH {CAL} SELECT grp, count(*) AS n FROM cal GROUP BY grp")
def jsonl_kept(spark, d):
    at = new_path(spark, "jsonl")
    IO.write_jsonl(calibration(spark, d).select("id", "grp"), at)
    first = IO.read_jsonl_once(spark, at, "id bigint, grp string")
    return IO.read_jsonl_once(spark, at, "id bigint, grp string").groupBy("grp").agg(F.count("*").alias("n")) if first is not None else first


def _text(df, spark, d, at):
    df.select(F.col("line").alias("value")).write.text(at)
    return at


def _lines(df, *columns, sep):
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]).alias("line"))


@query("airfoil_table", "SELECT round(sum(ln(l_quantity)), 4) AS frequency, round(sum(l_discount), 6) AS angle, round(sum(ln(l_extendedprice)), 4) AS suction, count(*) AS n FROM lineitem")
def airfoil_table(spark, d):
    """Tabs, no header, six named columns, two of them as logarithms."""
    li = table(spark, d, "lineitem")
    at = _text(_lines(li, "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice", "l_tax", sep="\t"), spark, d, new_path(spark, "tab"))
    return IO.read_airfoil(spark, at).agg(F.round(F.sum("Frequency"), 4).alias("frequency"), r6(F.sum("Angle")).alias("angle"), F.round(F.sum("Suction"), 4).alias("suction"), F.count("*").alias("n"))


@query("semicolon_table", "SELECT c_custkey AS id, c_acctbal AS label FROM customer")
def semicolon_table(spark, d):
    at = new_path(spark, "semicolon")
    table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("label")).write.option("sep", ";").option("header", True).csv(at)
    return IO.read_semicolon(spark, at).select(F.col("id").cast("bigint").alias("id"), "label")


@query("columns_without_missing", "SELECT CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part")
def columns_without_missing(spark, d):
    """The first five columns go, and one that has a missing mark somewhere."""
    p = table(spark, d, "part")
    drop = [F.lit(str(i)).alias(f"k{i}") for i in range(5)]
    rows = p.select(*drop, "p_size", F.when(F.col("p_partkey") == 7, "?").otherwise("1").alias("hole"), "p_retailprice")
    at = _text(_lines(rows, *rows.columns, sep=","), spark, d, new_path(spark, "csv"))
    out = IO.read_without_missing(spark, at)
    return out.toDF("a", "b")


@query("white_space_table", "SELECT round(sum(p_size), 6) AS a, round(sum(p_retailprice), 4) AS label, count(*) AS n FROM part")
def white_space_table(spark, d):
    at = _text(table(spark, d, "part").select(F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(" \t "), F.col("p_retailprice").cast("string")).alias("line")), spark, d, new_path(spark, "text"))
    return IO.read_whitespace(spark, at).agg(r6(F.sum(F.get("values", F.lit(0)))).alias("a"), F.round(F.sum(F.element_at("values", -1)), 4).alias("label"), F.count("*").alias("n"))


@query("log_label_table", "SELECT p_size AS a, round(ln(1 + p_retailprice), 9) AS label FROM part")
def log_label_table(spark, d):
    p = table(spark, d, "part")
    at = _text(_lines(p, "p_size", "p_retailprice", sep=","), spark, d, new_path(spark, "csv"))
    out = IO.read_log_label(spark, at)
    return out.select(F.col(out.columns[0]).cast("int").alias("a"), F.round(out.columns[1], 9).alias("label"))


@query("arff_table", "SELECT CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part")
def arff_table(spark, d):
    head = spark.createDataFrame([(i, x) for i, x in enumerate(["@relation r", "@attribute size numeric", "@attribute 'price' real", "% remark", "@data"])], "k int, line string")
    body = table(spark, d, "part").select((F.col("p_partkey") + 10).cast("int").alias("k"), F.concat_ws(", ", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")).alias("line"))
    at = _text(head.union(body).orderBy("k").select("line"), spark, d, new_path(spark, "arff"))
    return IO.read_arff(spark, at)


@query("named_files", "SELECT n_name AS question, CASE WHEN n_nationkey % 3 = 0 THEN 'two' ELSE 'one' END AS dataset FROM nation")
def named_files(spark, d):
    """Questions and the last file, by name, that holds each."""
    at, n = new_path(spark, "sets"), table(spark, d, "nation")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for name, rows in (("one", n), ("two", n.filter("n_nationkey % 3 = 0"))):
        rows.select(F.col("n_name").alias("Question")).coalesce(1).write.json(f"{at}/.{name}")
        source = hadoop.Path(f"{at}/.{name}")
        fs = source.getFileSystem(conf)
        part = next(x.getPath() for x in fs.listStatus(source) if x.getPath().getName().startswith("part-"))
        fs.rename(part, hadoop.Path(f"{at}/{name}.jsonl"))
    return IO.read_named_jsonl(spark, at, "Question").withColumnRenamed("Question", "question")


@query("metrics_document", f"WITH {CAL} SELECT 3 AS round_idx, count(*) AS n, count(*) FILTER (WHERE isfinite(score)) AS n_feasible, round(avg(score) FILTER (WHERE isfinite(score)), 6) AS mean_score, 1.5::DOUBLE AS total FROM cal")
def metrics_document(spark, d):
    """A nested record written as a JSON document and read back."""
    cal, at = calibration(spark, d), new_path(spark, "json")
    sizes = cal.agg(F.count_if(F.col("id") % 4 == 0).alias("n_cal"), F.count_if(F.col("id") % 4 != 0).alias("n_train"))
    IO.write_document(IO.round_document(sample_quality(cal), sizes, {"total": 1.5, "search": math.inf}, 3), at)
    out = IO.read_json_documents(spark, at, "round_idx int, quality struct<n:bigint,n_feasible:bigint,mean_score:double>, timing struct<total:double,search:double>")
    return _r(out.filter("timing.search = double('Infinity')").select("round_idx", "quality.n", "quality.n_feasible", "quality.mean_score", "timing.total"))


@query("listed_files", "SELECT 'b' AS largest, 'a' AS first")
def listed_files(spark, d):
    """The largest file and the first one by name."""
    at = new_path(spark, "files")
    for name, n in (("a", 10), ("b", 1000), ("c", 100)):
        spark.range(n).coalesce(1).selectExpr("cast(id as string) as value").write.text(f"{at}/{name}")
    folder = lambda p: p.split("/")[-2]
    return spark.createDataFrame([(folder(IO.largest_file(spark, f"{at}/*/part-*")), folder(IO.first_file(spark, f"{at}/*/part-*")))], "largest string, first string")


@query("name_list", "SELECT n_name AS name FROM nation")
def name_list(spark, d):
    at = _text(table(spark, d, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("line")), spark, d, new_path(spark, "names"))
    return IO.read_names(spark, at)


@query("demonstration_dictionary", "SELECT n_name AS sentence, unnest(['is a nation', 'key ' || n_nationkey]) AS fact FROM nation")
def demonstration_dictionary(spark, d):
    n = table(spark, d, "nation").select(F.map_from_entries(F.collect_list(F.struct("n_name", F.array(F.lit("is a nation"), F.concat(F.lit("key "), F.col("n_nationkey").cast("string")))))).alias("m"))
    at = _text(n.select(F.to_json("m").alias("line")).coalesce(1), spark, d, new_path(spark, "demos"))
    return IO.read_demonstrations(spark, f"{at}/part-*")


@query("npz_arrays", "SELECT * FROM (VALUES ('a', [0.5::DOUBLE, -1.0]), ('b', [2.0::DOUBLE])) t(name, values)")
def npz_arrays(spark, d):
    """One-dimensional arrays by name; others are left out."""
    import numpy as np

    held, at = io.BytesIO(), new_path(spark, "npz")
    np.savez(held, a=np.array([0.5, -1.0]), b=np.array([2.0]), c=np.zeros((2, 2)))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{at}/scores.npz")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(held.getvalue()))
    out.close()
    return IO.read_npz(spark, f"{at}/*.npz")


@query("sweep_jobs", "SELECT * FROM (VALUES ('model=m initial_seed=3 alpha=0.1 last_seed=3'), ('model=m initial_seed=3 alpha=0.2 last_seed=3'), ('model=m initial_seed=7 alpha=0.1 last_seed=7'), ('model=m initial_seed=7 alpha=0.2 last_seed=7')) t(job)")
def sweep_jobs(spark, d):
    text = "base_config: full  # the name\ncache: true\noverrides:\n  - model=m\nparameters:\n  initial_seed: [3, 7]\n  alpha:\n    - 0.1\n    - 0.2\n"
    at = _text(spark.createDataFrame([(text.rstrip("\n"),)], "line string").coalesce(1), spark, d, new_path(spark, "sweep"))
    return spark.createDataFrame([(" ".join(j),) for j in IO.read_sweep(spark, f"{at}/part-*")[3]], "job string")


@query("train_test_rows", f"WITH {CAL}, r AS (SELECT id, row_number() OVER (ORDER BY md5('5:' || id), id) AS rn, count(*) OVER () AS n FROM cal) SELECT id, CASE WHEN rn <= floor(n * 0.95) THEN 'train' ELSE 'test' END AS part FROM r")
def train_test_rows(spark, d):
    train, test = IO.train_test_split(calibration(spark, d).select("id"), 0.95, 5)
    return train.select("id", F.lit("train").alias("part")).union(test.select("id", F.lit("test").alias("part")))


@query("csv_with_index", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS index, n_name AS name FROM nation")
def csv_with_index(spark, d):
    at = new_path(spark, "csv")
    IO.write_csv_indexed(table(spark, d, "nation").select("n_nationkey", "n_name"), at, "n_nationkey")
    return spark.read.option("header", True).csv(at).select(F.col("index").cast("bigint").alias("index"), F.col("n_name").alias("name"))


@query("csv_without_index", "SELECT n_nationkey, n_name FROM nation")
def csv_without_index(spark, d):
    at = new_path(spark, "csv")
    IO.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), at)
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(at)


@query("written_once", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey < 10")
def written_once(spark, d):
    """A second write without overwriting leaves the first result."""
    at, n = new_path(spark, "once"), table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    IO.write_jsonl(n.filter("id < 10"), at, overwrite=False)
    IO.write_jsonl(n, at, overwrite=False)
    return IO.read_jsonl(spark, at, "id int")


@query("seed_checkpoints", "SELECT CAST(o_custkey % 4 AS INTEGER) AS seed, CASE WHEN o_custkey % 4 = 1 THEN 2 ELSE 1 END * count(*) AS n FROM orders GROUP BY o_custkey % 4")
def seed_checkpoints(spark, d):
    """Runs are written seed by seed; one that is written again replaces itself alone."""
    at = new_path(spark, "seeds")
    rows = table(spark, d, "orders").groupBy((F.col("o_custkey") % 4).cast("int").alias("seed")).agg(F.count("*").alias("n"))
    for part in (rows.filter("seed < 2"), rows.filter("seed >= 2"), rows.filter("seed = 1").withColumn("n", F.col("n") * 2)):
        IO.append_seeds(part, at)
    return spark.read.parquet(at).select("seed", "n")


@query("filled_column", f"WITH {CAL} SELECT id, round(u, 9) AS lik_r0, round(s, 9) AS lik_r1 FROM cal")
def filled_column(spark, d):
    c = calibration(spark, d)
    out = IO.fill_column(c.select("id", F.col("u").alias("lik_r0")), c.select("id", F.col("s").alias("lik_r1")), "lik_r1", new_path(spark, "filled"))
    return out.select("id", F.round("lik_r0", 9).alias("lik_r0"), F.round("lik_r1", 9).alias("lik_r1"))


@query("partitioned_rounds", f"WITH {CAL} SELECT grp, count(*) AS n FROM cal GROUP BY grp")
def partitioned_rounds(spark, d):
    """Partitions by parameter in place of parameters in file names."""
    at = new_path(spark, "rounds")
    IO.write_partitioned(calibration(spark, d).select("id", "grp"), at, "grp")
    return spark.read.parquet(at).groupBy("grp").agg(F.count("*").alias("n"))
