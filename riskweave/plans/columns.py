"""Queries of column plumbing, filters, joins and text, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import neighbors as N
from ..operators import tables as B
from ..semantics import finite
from .catalogue import _r, _texts, _TXT, query, r6
from .derive import CAL, PART, calibration, particles, table

_WIDE = "wide AS (SELECT id, score, s AS lik_r0, u AS lik_r1, value / 50 + 0.1 AS lik_r2, user_id AS note FROM cal)"


def _wide(spark, d):
    return calibration(spark, d).select("id", "score", F.col("s").alias("lik_r0"), F.col("u").alias("lik_r1"), (F.col("value") / 50 + 0.1).alias("lik_r2"), F.col("user_id").alias("note"))


@query("likelihood_columns", f"WITH {CAL}, {_WIDE} SELECT id, round(lik_r0, 9) AS lik_r0, round(lik_r1, 9) AS lik_r1, round(lik_r2, 9) AS lik_r2 FROM wide")
def likelihood_columns(spark, d):
    """By name, without the note."""
    out = B.likelihood_table(_wide(spark, d), keep=("id",))
    return out.select("id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("first_rounds_only", f"WITH {CAL}, {_WIDE} SELECT id, round(lik_r0, 9) AS lik_r0, round(lik_r1, 9) AS lik_r1 FROM wide")
def first_rounds_only(spark, d):
    out = B.likelihood_table(_wide(spark, d), rounds=2, keep=("id",))
    return out.select("id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("seeds_from_pairs", f"WITH {PART} SELECT a.particle AS higher_score_particle, a.score FROM part8 a JOIN part8 b ON b.id = a.id + 1 WHERE a.score < b.score")
def seeds_from_pairs(spark, d):
    p = particles(spark, d)
    pairs = p.select((F.col("id") + 1).alias("id"), F.col("particle").alias("lower_score_particle"), F.col("score").alias("lower_score")).join(p.select("id", F.col("particle").alias("other"), F.col("score").alias("higher_score")), "id").filter("lower_score < higher_score")
    return B.next_seeds(pairs)


@query("constrained_names", f"WITH {CAL}, {_WIDE} SELECT id, round(lik_r0, 9) AS con_lik_r0, round(lik_r1, 9) AS con_lik_r1, round(lik_r2, 9) AS con_lik_r2 FROM wide")
def constrained_names(spark, d):
    out = B.constrained_names(_wide(spark, d).drop("score", "note"))
    return out.select("id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("columns_beside", f"WITH {CAL} SELECT a.id, round(a.u, 9) AS u, round(b.s, 9) AS s FROM cal a JOIN cal b USING (id) WHERE b.value > 20")
def columns_beside(spark, d):
    c = calibration(spark, d)
    out = B.beside(c.select("id", "u"), c.filter("value > 20").select("id", "u", "s"))
    return out.select("id", F.round("u", 9).alias("u"), F.round("s", 9).alias("s"))


@query("likelihood_from_log", f"WITH {CAL} SELECT id, round(exp(ln(u)), 9) AS likelihood FROM cal")
def likelihood_from_log(spark, d):
    return B.with_likelihood(calibration(spark, d).select("id", F.ln("u").alias("loglikelihood"))).select("id", F.round("likelihood", 9).alias("likelihood"))


@query("prompt_features", """WITH p AS (SELECT conv_id || ',' || coalesce(text, '') AS prompt, coalesce(text, '') AS response, [length(role) / 10.0, turn / 7.0, 0.5] AS lp, role AS dataset FROM conversations WHERE turn = 0),
 m AS (SELECT *, list_sum(lp) / 3 AS m FROM p) SELECT prompt, round(list_sum([1.0, length(response), length(trim(regexp_replace(regexp_replace(prompt, '^,+', ''), '^[0-9]+,+', ''))), m, sqrt(list_sum(list_transform(lp, lambda x: (x - m) * (x - m))) / 3), CASE WHEN dataset = 'assistant' THEN 1 ELSE 0 END]), 6) AS total FROM m""")
def prompt_features(spark, d):
    """One, lengths, moments of the log-probabilities and indicators without the last category."""
    c = table(spark, d, "conversations").filter("turn = 0")
    text = F.coalesce("text", F.lit(""))
    rows = c.select(F.concat(F.col("conv_id").cast("string"), F.lit(","), text).alias("prompt"), text.alias("response"), F.array(F.length("role") / 10, F.col("turn") / 7, F.lit(0.5)).alias("logprobs"), F.col("role").alias("dataset"))
    out = B.prompt_features(rows, ["assistant", "user"])
    return out.select("prompt", r6(F.aggregate("features", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("one_hot_drop_last", "SELECT event_id AS id, (event_type = 'click')::INT AS is_click, (event_type = 'error')::INT AS is_error FROM events")
def one_hot_drop_last(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), *B.dummies(table(spark, d, "events"), "event_type", ["click", "error", "view"], drop_last=True))


@query("config_flatten", "SELECT * FROM (VALUES ('model.name=m'), ('model.size.dim=32'), ('alpha=0.2')) t(line)")
def config_flatten(spark, d):
    return spark.createDataFrame([(x,) for x in B.flatten_config({"model": {"name": "m", "size": {"dim": 32}}, "alpha": 0.2})], "line string")


@query("test_function_record", "SELECT 4 AS dim, 1.5::DOUBLE AS additive_term, 0.25::DOUBLE AS random_term_std, 0.0::DOUBLE AS noise_std, true AS negate, 7 AS random_seed")
def test_function_record(spark, d):
    return B.test_function_record(spark, "rough_mt_fuji", {"dim": 4, "additive_term": 1.5, "random_term_std": 0.25, "noise_std": 0.0, "negate": True, "random_seed": 7}, "dim int, additive_term double, random_term_std double, noise_std double, negate boolean, random_seed int")


@query("prefilter_lower", f"WITH {CAL}, q AS (SELECT quantile_cont(u, 0.4) AS q FROM cal) SELECT id FROM cal, q WHERE u >= q ORDER BY md5('3:' || id), id LIMIT 100")
def prefilter_lower(spark, d):
    """The lower quantile comes before the range; both only above n rows."""
    return B.prefilter(calibration(spark, d), 100, "u", 0.4, (0.1, 0.2), 3).select("id")


@query("prefilter_band", f"WITH {CAL}, q AS (SELECT quantile_cont(u, 0.3) AS a, quantile_cont(u, 0.6) AS b FROM cal) SELECT id FROM cal, q WHERE u BETWEEN a AND b ORDER BY md5('3:' || id), id LIMIT 100")
def prefilter_band(spark, d):
    return B.prefilter(calibration(spark, d), 100, "u", None, (0.3, 0.6), 3).select("id")


@query("sanity_head", f"WITH {CAL} SELECT id FROM cal ORDER BY id LIMIT 50")
def sanity_head(spark, d):
    return B.sanity_head(calibration(spark, d).select("id"), 50)


@query("run_filter", f"WITH {CAL} SELECT id FROM cal WHERE grp = 'view' AND user_id < 350")
def run_filter(spark, d):
    return calibration(spark, d).filter((F.col("grp") == "view") & (F.col("user_id") < 350)).select("id")


@query("round_sizes", f"WITH {CAL}, n AS (SELECT r AS round, count(id) AS n FROM range(12) t(r) LEFT JOIN cal ON user_id % 10 = r GROUP BY r) SELECT round, n, round(n / sum(n) OVER (), 9) AS weight FROM n")
def round_sizes(spark, d):
    """Two of twelve rounds are empty and weigh nothing."""
    rows = calibration(spark, d).select((F.col("user_id") % 10).alias("round"))
    return B.round_sizes(spark.range(12).withColumnRenamed("id", "round"), rows).select("round", "n", F.round("weight", 9).alias("weight"))


_ASK = "q AS (SELECT conv_id, turn, ',,' || conv_id || ',' || text AS prompt, text, role, CASE WHEN conv_id % 3 = 0 THEN [-1.0, -1.000001] ELSE [0.5, turn] END AS se, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE [0.25] END AS lp FROM conversations WHERE turn = 0)"


def _asked(spark, d):
    c = table(spark, d, "conversations").filter("turn = 0")
    double = lambda *x: F.array(*[F.lit(v) for v in x])
    return c.select("conv_id", F.concat(F.lit(",,"), F.col("conv_id").cast("string"), F.lit(","), F.col("text")).alias("prompt"), "role", F.when(F.col("conv_id") % 3 == 0, double(-1.0, -1.000001)).otherwise(F.array(F.lit(0.5), F.col("turn").cast("double"))).alias("selfevals"), F.when(F.col("conv_id") % 5 != 0, double(0.25)).alias("logprobs"), double(0.5).alias("frequencies"))


@query("usable_prompts", f"WITH {_ASK}, k AS (SELECT trim(text) AS question, max('set' || (length(text) % 3)) AS dataset FROM q WHERE conv_id % 7 <> 0 GROUP BY 1), c AS (SELECT *, trim(regexp_replace(regexp_replace(prompt, '^,+', ''), '^[0-9]+,+', '')) AS question FROM q) SELECT conv_id, k.dataset FROM c JOIN k USING (question) WHERE lp IS NOT NULL AND NOT (abs(se[1] + 1) <= 1.001e-5 AND abs(se[2] + 1) <= 1.001e-5)")
def usable_prompts(spark, d):
    """Without prompts of unknown questions, missing log-probabilities or self-evaluations of -1 throughout."""
    c = table(spark, d, "conversations").filter("turn = 0 and conv_id % 7 <> 0")
    known = c.select(F.trim("text").alias("question"), F.concat(F.lit("set"), (F.length("text") % 3).cast("string")).alias("dataset"))
    return B.usable_prompts(_asked(spark, d), known).select("conv_id", "dataset")


@query("all_claims_true", "SELECT l_orderkey AS response FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R')")
def all_claims_true(spark, d):
    facts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("response")).agg(F.collect_list(F.struct((F.col("l_returnflag") != "R").alias("is_supported"))).alias("facts"))  # an order's few lines
    return B.all_supported(facts).select("response")


@query("gathered_pairs", f"WITH {PART}, p AS (SELECT a.id AS a, a.id * 7 % 400 AS b FROM part8 a WHERE a.id <> a.id * 7 % 400) SELECT least(x.score, y.score) AS lower_score, greatest(x.score, y.score) AS higher_score, CASE WHEN x.score < y.score THEN x.particle ELSE y.particle END AS lower_particle, CASE WHEN x.score < y.score THEN y.particle ELSE x.particle END AS higher_particle FROM p JOIN part8 x ON x.id = p.a JOIN part8 y ON y.id = p.b WHERE x.score <> y.score")
def gathered_pairs(spark, d):
    """Index pairs turned into records, the lower score first."""
    p = particles(spark, d)
    pairs = p.select(F.col("id").alias("a"), (F.col("id") * 7 % 400).alias("b")).filter("a <> b")
    return N.gather_pairs(pairs, p, ["particle", "score"]).select("lower_score", "higher_score", "lower_particle", "higher_particle")


@query("skipped_pairs", f"WITH {PART}, p AS (SELECT a.id AS a, a.id * 7 % 400 AS b FROM part8 a WHERE a.id <> a.id * 7 % 400) SELECT count(*) AS n_pairs, count(*) FILTER (WHERE x.score = y.score) AS n_skipped FROM p JOIN part8 x ON x.id = p.a JOIN part8 y ON y.id = p.b")
def skipped_pairs(spark, d):
    p = particles(spark, d)
    return N.skipped_pairs(p.select(F.col("id").alias("a"), (F.col("id") * 7 % 400).alias("b")).filter("a <> b"), p)


@query("dictionary_lookup", "WITH k AS (SELECT o_custkey AS key, o_orderstatus AS status, o_orderkey AS ord FROM orders), l AS (SELECT key, max_by(status, ord) AS status FROM k GROUP BY key) SELECT c_custkey AS key, status FROM customer JOIN l ON l.key = c_custkey")
def dictionary_lookup(spark, d):
    """A dictionary whose later entries replace earlier ones."""
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ord"))
    return B.lookup(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), keys, "key")


@query("in_all_dictionaries", f"WITH {CAL} SELECT a.id, round(a.u, 9) AS u, round(b.s, 9) AS s, c.value FROM cal a JOIN cal b USING (id) JOIN cal c USING (id) WHERE b.id % 2 = 0 AND c.id % 3 = 0")
def in_all_dictionaries(spark, d):
    c = calibration(spark, d)
    out = B.in_all(c.select("id", "u"), [c.filter("id % 2 = 0").select("id", "s"), c.filter("id % 3 = 0").select("id", "value")], "id")
    return out.select("id", F.round("u", 9).alias("u"), F.round("s", 9).alias("s"), "value")


@query("first_prefix_match", f"WITH {PART}, i AS (SELECT id, particle[1:1 + id % 3] AS tokens FROM part8 WHERE id % 9 = 0) SELECT i.id, min(g.id) AS match FROM i LEFT JOIN part8 g ON g.id % 9 <> 0 AND g.particle[1:1 + i.id % 3] = i.tokens GROUP BY i.id")
def first_prefix_match(spark, d):
    p = particles(spark, d)
    inputs = p.filter("id % 9 = 0").select("id", F.slice("particle", F.lit(1), (F.col("id") % 3 + 1).cast("int")).alias("tokens"))
    return N.first_with_prefix(inputs, p.filter("id % 9 <> 0").select("id", F.col("particle").alias("tokens")))


@query("model_seed_pairs", "SELECT * FROM (VALUES ('m0', 's0'), ('m1', 's1')) t(model, seeds)")
def model_seed_pairs(spark, d):
    return spark.createDataFrame(B.paired_files(["m0", "m1"], ["s0", "s1"]), "model string, seeds string")


@query("mean_numeric_distance", f"WITH {CAL} SELECT round(avg(score) FILTER (WHERE NOT isnan(score) AND NOT isinf(score)), 6) AS mean FROM cal")
def mean_numeric_distance(spark, d):
    return _r(B.mean_distance(calibration(spark, d).filter("abs(score) < double('Infinity') or isnan(score)"), "score"))


@query("dataset_sizes", f"WITH {CAL} SELECT count(*) FILTER (WHERE id % 4 = 0) AS n_cal, count(*) FILTER (WHERE id % 4 <> 0) AS n_train, count(*) AS n FROM cal")
def dataset_sizes(spark, d):
    own = F.col("id") % 4 == 0
    return calibration(spark, d).agg(F.count_if(own).alias("n_cal"), F.count_if(~own).alias("n_train"), F.count("*").alias("n"))


@query("averaged_metrics", f"WITH {CAL} SELECT grp AS metric, round(avg(value), 6) AS mean FROM cal GROUP BY grp")
def averaged_metrics(spark, d):
    return _r(B.mean_by_key(calibration(spark, d), "grp").withColumnRenamed("grp", "metric"))


@query("score_rmse_pairs", f"WITH {CAL} SELECT round(sqrt(avg((a.score - b.score) ** 2)), 6) AS rmse FROM cal a JOIN cal b ON b.id = a.id + 1 WHERE isfinite(a.score) AND isfinite(b.score)")
def score_rmse_pairs(spark, d):
    """Expected against obtained scores, where both are numbers."""
    c = calibration(spark, d).select("id", finite("score").alias("x"))
    both = c.join(c.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")
    return _r(both.agg(F.sqrt(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("rmse")))


@query("output_counter", f"WITH {PART}, {_TXT}, r AS (SELECT id, s, row_number() OVER (ORDER BY id) AS counter FROM t) SELECT id, counter FROM r WHERE s <> 'junk'")
def output_counter(spark, d):
    """The running number of each output that parses, among all outputs."""
    return B.row_counter(_texts(spark, d), F.col("s") != "junk", ["id"]).select("id", "counter")


@query("sorted_together", f"WITH {CAL} SELECT user_id AS v, id AS w, row_number() OVER (ORDER BY user_id, id) - 1 AS place FROM cal")
def sorted_together(spark, d):
    return B.ordered_pairs(calibration(spark, d).select(F.col("user_id").alias("v"), F.col("id").alias("w")), "v", "w").select("v", "w", "place")


@query("distinct_as_text", f"WITH {PART} SELECT min(id) AS id FROM part8 GROUP BY particle::VARCHAR")
def distinct_as_text(spark, d):
    return B.distinct_text(particles(spark, d), "particle").select("id")


@query("merged_histories", f"WITH {CAL} SELECT a.id, CASE WHEN b.id IS NULL THEN a.value ELSE b.value * 2 END AS value FROM cal a LEFT JOIN (SELECT * FROM cal WHERE id % 3 = 0) b USING (id)")
def merged_histories(spark, d):
    c = calibration(spark, d)
    return B.later_wins([c.select("id", "value"), c.filter("id % 3 = 0").select("id", (F.col("value") * 2).alias("value"))], "id")


@query("pool_without_queried", f"WITH {CAL} SELECT id FROM cal WHERE id NOT IN (SELECT id FROM cal WHERE u > 1.5)")
def pool_without_queried(spark, d):
    c = calibration(spark, d)
    return c.select("id").join(c.filter("u > 1.5").select("id"), "id", "left_anti")


@query("checkpoint_gate", """WITH m AS (SELECT o_custkey AS run, o_orderkey AS step, o_totalprice AS reward, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 10 / 10 END AS pct FROM orders), v AS (SELECT *, coalesce(pct >= 0.3, true) AS ok FROM m)
 SELECT run, step, ok AND coalesce(reward > max(CASE WHEN ok THEN reward END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM v""")
def checkpoint_gate(spark, d):
    """Checkpoints that beat all earlier valid ones of their run and are valid themselves."""
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("reward"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 10 / 10).alias("pct"))
    return B.gate_checkpoints(m, "reward", 0.3, ("pct",), (), run=("run",))


@query("complete_checkpoints", "SELECT * FROM (VALUES (100, 0::BIGINT), (200, 1), (300, 15)) t(checkpoint, missing)")
def complete_checkpoints(spark, d):
    files = B.checkpoint_files()
    rows = [(100, f) for f in files] + [(200, f) for f in files[1:]] + [(300, "other.bin")]
    return B.latest_complete(spark.createDataFrame(rows, "checkpoint int, file string"))


_DEC = "printf('%.{}f', {})"


@query("score_particle_text", f"WITH {PART} SELECT id, 'Score: ' || printf('%.2f', score / 8) || chr(10) || 'Particle: [' || array_to_string(particle, ', ') || ']' AS text FROM part8")
def score_particle_text(spark, d):
    """Two decimals, halves to even."""
    return particles(spark, d).select("id", T.score_text(F.col("score") / 8, F.col("particle")).alias("text"))


@query("plain_records", f"WITH {CAL} SELECT id, CASE WHEN isfinite(score) THEN printf('%.3f', score / 16) ELSE 'inf' END AS score FROM cal")
def plain_records(spark, d):
    return calibration(spark, d).select("id", T.plain_score(F.col("score") / 16).alias("score"))


@query("instruction_prompts", f"WITH {PART} SELECT id, 'fn' || chr(10) || 'Score: ' || printf('%.2f', score / 8) || chr(10) || 'Solution:' || chr(10) AS text FROM part8")
def instruction_prompts(spark, d):
    return particles(spark, d).select("id", T.instruction_prompt("fn", F.col("score") / 8).alias("text"))


@query("edit_prompts", f"""WITH {PART} SELECT a.id, chr(10) || 'Given the following constraints, score (lower score is better), and original input, ' || chr(10) || 'edit the original input to decrease the score.' || chr(10) || chr(10) || 'Constraints:' || chr(10) || 'fn' || chr(10) || 'Original input:' || chr(10)
 || '[' || array_to_string(CASE WHEN a.score < b.score THEN a.particle ELSE b.particle END, ', ') || ']' || chr(10) || 'Score: ' || printf('%.2f', least(a.score, b.score)) || chr(10) || 'Edited:' || chr(10) AS text, CASE WHEN a.score < b.score THEN b.particle ELSE a.particle END AS target FROM part8 a JOIN part8 b ON b.id = a.id + 1""")
def edit_prompts(spark, d):
    """The first of a pair is the original if its score is the lower one; ties go to the second."""
    p = particles(spark, d)
    both = p.join(p.select((F.col("id") - 1).alias("id"), F.col("particle").alias("other"), F.col("score").alias("t")), "id")
    own = T.first_is_better(F.col("score"), F.col("t"))
    pick = lambda a, b: F.when(own, a).otherwise(b)
    return both.select("id", T.edit_prompt("fn", pick(F.col("particle"), F.col("other")), pick(F.col("score"), F.col("t"))).alias("text"), pick(F.col("other"), F.col("particle")).alias("target"))


@query("preference_prompts", f"WITH {PART} SELECT a.id, 'Constraints:' || chr(10) || 'fn' || chr(10) || 'Solution:' || chr(10) AS text, CASE WHEN a.score < b.score THEN a.particle ELSE b.particle END AS chosen, least(a.score, b.score) AS chosen_score, greatest(a.score, b.score) AS rejected_score FROM part8 a JOIN part8 b ON b.id = a.id + 1")
def preference_prompts(spark, d):
    p = particles(spark, d)
    both = p.join(p.select((F.col("id") - 1).alias("id"), F.col("particle").alias("other"), F.col("score").alias("t")), "id")
    return both.select("id", T.preference_prompt("fn").alias("text"), F.when(T.first_is_better(F.col("score"), F.col("t")), F.col("particle")).otherwise(F.col("other")).alias("chosen"), F.least("score", "t").alias("chosen_score"), F.greatest("score", "t").alias("rejected_score"))


_DRAW = "CAST(('0x' || substr(md5('9:' || id || ':' || i), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0"


@query("few_shot_prompts", f"""WITH {PART}, o AS (SELECT *, row_number() OVER (ORDER BY score, md5('9:' || id), id) - 1 AS spot FROM part8), g AS (SELECT *, min(spot) OVER (PARTITION BY score) AS low, count(*) OVER (PARTITION BY score) AS own, count(*) OVER () AS total FROM o),
 s AS (SELECT id, low, own, total - own AS n, i FROM g, range(2) t(i) WHERE total - own >= 2), f AS (SELECT *, i * n // 2 AS a, (i + 1) * n // 2 AS b FROM s),
 p AS (SELECT *, a + CAST(floor({_DRAW} * (b - a)) AS BIGINT) AS place FROM f), x AS (SELECT p.id AS a, o.id AS b, row_number() OVER (PARTITION BY p.id ORDER BY md5('9:' || p.i || ':' || p.id)) AS pos FROM p JOIN o ON o.spot = p.place + CASE WHEN p.place >= p.low THEN p.own ELSE 0 END),
 t AS (SELECT id, 'Score: ' || printf('%.3f', score) || chr(10) || 'Particle: [' || array_to_string(particle, ', ') || ']' AS block FROM part8)
 SELECT a AS id, string_agg(block, chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) || 'Score: ' || printf('%.3f', any_value(o.score)) || chr(10) || 'Particle: ' AS text FROM x JOIN t ON t.id = b JOIN part8 o ON o.id = a GROUP BY a""")
def few_shot_prompts(spark, d):
    """Two examples of other scores for every row, drawn by MD5 keys."""
    p = particles(spark, d)
    shots = N.few_shot(p, 2, 9).select("id", F.posexplode("shots").alias("pos", "b"))
    blocks = shots.join(p.select(F.col("id").alias("b"), "score", "particle"), "b").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "score", "particle"))).alias("shots"))
    return blocks.join(p.select("id", "score"), "id").select("id", T.few_shot_prompt(F.col("shots"), F.col("score")).alias("text"))


@query("subject_names", "SELECT conv_id, turn, left(trim(string_split('tell me about ' || role || ' and about ' || text || ' ', 'about')[-1]), greatest(length(trim(string_split('tell me about ' || role || ' and about ' || text || ' ', 'about')[-1])) - 1, 0)) AS name FROM conversations WHERE text IS NOT NULL")
def subject_names(spark, d):
    c = table(spark, d, "conversations").filter("text is not null")
    return c.select("conv_id", "turn", T.subject_of(F.concat(F.lit("tell me about "), "role", F.lit(" and about "), "text", F.lit(" "))).alias("name"))


@query("dropped_suffixes", "SELECT p_partkey AS id, regexp_replace(p_brand || CASE WHEN p_partkey % 2 = 0 THEN '_qa' ELSE '_qa_x' END, '_qa$', '') AS name FROM part")
def dropped_suffixes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.drop_suffix(F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, "_qa").otherwise("_qa_x"))).alias("name"))


@query("prompt_scores", f"WITH {PART} SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE round(score / 8, 2) END AS score FROM part8")
def prompt_scores(spark, d):
    """Scores read back out of prompts; text without one gives null."""
    text = T.score_text(F.round(F.col("score") / 8, 2), F.col("particle"))
    return particles(spark, d).select("id", T.score_of_prompt(F.when(F.col("id") % 4 == 0, "no score here").otherwise(text)).alias("score"))


@query("truth_words", "SELECT n_nationkey AS id, n_nationkey % 3 = 0 AS truth FROM nation")
def truth_words(spark, d):
    k = F.col("n_nationkey") % 3
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), T.parse_bool(F.when(k == 0, " Yes").when(k == 1, "off").otherwise("0")).alias("truth"))


@query("counted_names", "SELECT n_nationkey AS id, '/out/' || n_name || '_' || n_regionkey || '.jsonl' AS name FROM nation")
def counted_names(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("id"), T.counted_name(F.concat(F.lit("/out/"), "n_name", F.lit(".jsonl")), "n_regionkey").alias("name"))


@query("column_names_checked", "SELECT * FROM (VALUES ('con_lik_r', 2), ('lik_r', 3)) t(prefix, rounds)")
def column_names_checked(spark, d):
    """Likelihood columns by prefix; other columns are passed over, gaps are an error."""
    from ..operators.likelihood import lik_columns

    names = ["id", "lik_r0", "lik_r1", "chosen", "lik_r2", "con_lik_r0", "con_lik_r1", "count_r0"]
    return spark.createDataFrame([(p, len(lik_columns(names, p))) for p in ("con_lik_r", "lik_r")], "prefix string, rounds int")


@query("missing_rounds", "SELECT * FROM (VALUES (false, 'lik_r2'), (true, 'lik_r0 lik_r1 lik_r2')) t(overwrite, compute)")
def missing_rounds(spark, d):
    from ..operators.likelihood import missing_rounds as missing

    return spark.createDataFrame([(o, " ".join(missing(["id", "lik_r0", "lik_r1"], 3, o)[1])) for o in (False, True)], "overwrite boolean, compute string")


@query("short_hashes", "SELECT n_nationkey AS id, left(sha256(n_name), 12) AS hash FROM nation")
def short_hashes(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), T.short_hash("n_name").alias("hash"))


@query("log_tails", "SELECT doc_id, array_to_string(string_split(coalesce(text, ''), chr(10))[-3:], chr(10)) AS tail FROM documents")
def log_tails(spark, d):
    return table(spark, d, "documents").select("doc_id", T.log_tail(F.coalesce("text", F.lit("")), 3).alias("tail"))


_MSG = ["CUDA error", "cuda error", "Device BUSY", "now Unavailable", "out of range", ""]


@query("transient_errors", "SELECT * FROM (VALUES (0, true), (1, false), (2, true), (3, true), (4, false), (5, true)) t(id, again)")
def transient_errors(spark, d):
    """The device's name as written, two words in any case, and one name of an error."""
    rows = spark.createDataFrame([(i, m, "AcceleratorError" if not m else "ValueError") for i, m in enumerate(_MSG)], "id int, message string, kind string")
    return rows.select("id", T.transient_error("message", F.col("kind")).alias("again"))


@query("generated_text", f"WITH {PART}, g AS (SELECT id, particle, list_transform(range(1, 9), lambda i: CASE WHEN i <= id % 5 THEN -100 ELSE 1 END) AS labels FROM part8) SELECT id, particle[1 + id % 5:] AS tokens FROM g")
def generated_text(spark, d):
    """Tokens behind the prompt, as long as the labels' masked beginning."""
    labels = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when(i <= F.col("id") % 5, -100).otherwise(1))
    return particles(spark, d).select("id", T.new_tokens(F.col("particle"), labels).alias("tokens"))


@query("threshold_candidates", "SELECT DISTINCT l_discount AS tau FROM lineitem")
def threshold_candidates(spark, d):
    """Distinct scores out of ragged arrays."""
    ragged = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("scores"))
    return ragged.select(F.explode("scores").alias("tau")).distinct()


@query("prefix_tests", f"WITH {PART} SELECT id, particle[1:2] = [0, 0] AS starts, nullif(list_position(list_transform(range(1, 8), lambda i: particle[i:i + 1] = [0, -1]), true), 0) - 1 AS found FROM part8")
def prefix_tests(spark, d):
    pair = lambda *x: F.array(*[F.lit(v) for v in x])
    return particles(spark, d).select("id", A.starts_with("particle", pair(0, 0)).alias("starts"), A.find_sublist("particle", pair(0, -1)).alias("found"))


@query("masked_padded", f"WITH {PART} SELECT id, list_transform(particle, lambda x, i: CASE WHEN i <= id % 4 THEN -100 ELSE x END) AS masked, list_concat(particle, [9, 9]) AS right_padded, list_concat([9, 9], particle) AS left_padded FROM part8")
def masked_padded(spark, d):
    return particles(spark, d).select("id", A.mask_before("particle", F.col("id") % 4).alias("masked"), A.pad_to("particle", 10, 9).alias("right_padded"), A.pad_to("particle", 10, 9, left=True).alias("left_padded"))


_ALLOWED = [[int((i + 1) % 4 != j) for j in range(4)] for i in range(4)]


@query("allowed_steps", f"WITH {PART}, q AS (SELECT id, list_transform(particle, lambda x: CASE WHEN x = -2 THEN NULL ELSE abs(x) % 4 END) AS p FROM part8) SELECT id, len(list_filter(range(1, 8), lambda i: p[i] IS NOT NULL AND p[i + 1] IS NOT NULL AND (p[i] + 1) % 4 = p[i + 1])) = 0 AS allowed FROM q")
def allowed_steps(spark, d):
    """Unknown states are wildcards."""
    p = F.transform("particle", lambda x: F.when(x != -2, F.abs(x) % 4))
    matrix = F.array(*[F.array(*[F.lit(v) for v in row]) for row in _ALLOWED])
    return particles(spark, d).select("id", p.alias("p")).select("id", A.transitions_allowed("p", matrix).alias("allowed"))


@query("gap_places", f"WITH {PART}, q AS (SELECT id, list_transform(particle, lambda x: x = -1) AS e FROM part8), u AS (SELECT id, unnest(range(1, 9)) AS i, unnest(e) AS e FROM q), s AS (SELECT id, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM u WHERE e) SELECT id, CAST(min(i) - 1 AS INTEGER) AS first, CAST(max(i) - 1 AS INTEGER) AS last FROM s GROUP BY id, k")
def gap_places(spark, d):
    holes = particles(spark, d).select("id", F.transform("particle", lambda x: F.when(x != -1, x)).alias("p"))
    return holes.select("id", F.explode(A.gaps("p")).alias("g")).select("id", "g.first", "g.last")


@query("gap_fillings", """WITH RECURSIVE e AS (SELECT i, j FROM range(4) a(i), range(4) b(j) WHERE (i + 1) % 4 <> j), s(n, p) AS (SELECT 1, [i] FROM range(4) a(i) UNION ALL SELECT n + 1, list_append(p, e.j) FROM s JOIN e ON e.i = p[-1] WHERE n < 6)
 SELECT '1__0__' AS known, count(*) AS ways FROM s WHERE n = 6 AND p[1] = 1 AND p[4] = 0 UNION ALL SELECT '______', count(*) FROM s WHERE n = 6 UNION ALL SELECT '2____1', count(*) FROM s WHERE n = 6 AND p[1] = 2 AND p[6] = 1""")
def gap_fillings(spark, d):
    """How many allowed sequences agree with a partly known one."""
    read = lambda s: [None if c == "_" else int(c) for c in s]
    return spark.createDataFrame([(s, A.fillings(read(s), _ALLOWED)) for s in ("1__0__", "______", "2____1")], "known string, ways bigint")


@query("optimal_placements", """WITH a AS (SELECT i, j FROM range(6) t(i), range(6) u(j)), c AS (SELECT i, j, list_transform(range(6), lambda k: CASE WHEN k = i THEN 0 WHEN k = i + 2 THEN 1 END) AS x, list_transform(range(6), lambda k: CASE WHEN k = j THEN 1 WHEN k = j + 1 THEN 3 END) AS y FROM a WHERE i + 2 < 6 AND j + 1 < 6),
 m AS (SELECT i, j, list_transform(range(1, 7), lambda k: coalesce(x[k], y[k])) AS p, len(list_filter(range(1, 7), lambda k: x[k] IS NOT NULL AND y[k] IS NOT NULL AND x[k] <> y[k])) AS clash FROM c)
 SELECT array_to_string(list_transform(p, lambda v: coalesce(v::VARCHAR, '_')), '') AS placed FROM m WHERE clash = 0 AND len(list_filter(range(1, 6), lambda k: p[k] IS NOT NULL AND p[k + 1] IS NOT NULL AND (p[k] + 1) % 4 = p[k + 1])) = 0""")
def optimal_placements(spark, d):
    """All ways to write two motifs into an empty sequence, one after the other."""
    matrix = F.array(*[F.array(*[F.lit(v) for v in row]) for row in _ALLOWED])
    empty = spark.range(1).select(F.array_repeat(F.lit(None).cast("int"), 6).alias("p"))
    one = empty.select(F.explode(A.place_motif("p", [0, 1], [0, 2], matrix)).alias("p"))
    two = one.select(F.explode(A.place_motif("p", [1, 3], [0, 1], matrix)).alias("p"))
    return two.select(F.array_join(F.transform("p", lambda v: F.coalesce(v.cast("string"), F.lit("_"))), "").alias("placed"))


@query("chosen_checkpoints", """WITH f AS (SELECT l_suppkey AS c, count(DISTINCT l_partkey % 12) AS n FROM lineitem WHERE l_quantity <= 4 GROUP BY 1),
 m AS (SELECT l_suppkey AS c, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE round(avg(l_extendedprice), 2) END AS v FROM lineitem GROUP BY 1), w AS (SELECT f.c, v FROM f LEFT JOIN m USING (c) WHERE n = 12)
 SELECT max(c) AS latest, (SELECT c FROM w WHERE v IS NOT NULL ORDER BY v, c DESC LIMIT 1) AS best, count(*) AS n_complete FROM w""")
def chosen_checkpoints(spark, d):
    """Suppliers play checkpoints, small line items their files, prices their losses."""
    li = table(spark, d, "lineitem")
    names = F.array(*[F.lit(f) for f in B.checkpoint_files(1, 1)])
    listing = li.filter("l_quantity <= 4").select(F.col("l_suppkey").alias("checkpoint"), F.get(names, (F.col("l_partkey") % 12).cast("int")).alias("file"))
    loss = li.groupBy(F.col("l_suppkey").alias("checkpoint")).agg(F.round(F.avg("l_extendedprice"), 2).alias("loss"))
    return B.chosen_checkpoints(listing, loss.withColumn("loss", F.when(F.col("checkpoint") % 7 != 0, F.col("loss"))), "loss", 1, 1)


@query("particle_placements", f"""WITH {PART}, q AS (SELECT id, list_transform(range(1, 9), lambda j: CASE WHEN j % 3 = id % 3 THEN abs(particle[j]) % 4 END) AS x FROM part8),
 a AS (SELECT q.*, i, j FROM q, range(6) t(i), range(7) u(j)),
 w AS (SELECT id, i, j, list_transform(range(8), lambda k: CASE WHEN k = i THEN 0 WHEN k = i + 2 THEN 1 END) AS y, list_transform(range(8), lambda k: CASE WHEN k = j THEN 1 WHEN k = j + 1 THEN 3 END) AS z, x FROM a),
 m AS (SELECT id, i, j, list_transform(range(1, 9), lambda k: coalesce(x[k], y[k], z[k])) AS p, len(list_filter(range(1, 9), lambda k: len(list_distinct(list_filter([x[k], y[k], z[k]], lambda v: v IS NOT NULL))) > 1)) AS clash FROM w)
 SELECT id, i::INT AS first, j::INT AS second, array_to_string(list_transform(p, lambda v: coalesce(v::VARCHAR, '_')), '') AS placed FROM m WHERE clash = 0 AND len(list_filter(range(1, 8), lambda k: p[k] IS NOT NULL AND p[k + 1] IS NOT NULL AND (p[k] + 1) % 4 = p[k + 1])) = 0""")
def particle_placements(spark, d):
    """All ways to write two motifs into every particle of which a third is known."""
    x = F.transform("particle", lambda v, j: F.when((j + 1) % 3 == F.col("id") % 3, F.abs(v) % 4))
    out = A.motif_placements(particles(spark, d).select("id", x.alias("x")), "x", [[0, 1], [1, 3]], [[0, 2], [0, 1]], _ALLOWED)
    text = F.array_join(F.transform("placed", lambda v: F.coalesce(v.cast("string"), F.lit("_"))), "")
    return out.select("id", F.get("places", F.lit(0)).alias("first"), F.get("places", F.lit(1)).alias("second"), text.alias("placed"))


@query("ehrlich_with_bans", f"""WITH {PART}, q AS (SELECT id, list_transform(particle, lambda x: abs(x) % 4) AS p FROM part8), m AS (SELECT id, list_max(list_transform(range(1, 8), lambda i: (p[i] = 0)::INT + (p[i + 1] = 0)::INT)) AS a, len(list_filter(range(1, 8), lambda i: (p[i] + 1) % 4 = p[i + 1])) AS banned FROM q)
 SELECT id, CASE WHEN banned > 0 THEN NULL ELSE -CAST(a / 2 AS DOUBLE) END AS score FROM m""")
def ehrlich_with_bans(spark, d):
    """Sequences with a banned step score infinity, shown as null."""
    matrix = F.array(*[F.array(*[F.lit(v) for v in row]) for row in _ALLOWED])
    p = particles(spark, d).select("id", F.transform("particle", lambda x: F.abs(x) % 4).alias("p"))
    return p.select("id", finite(A.ehrlich("p", [[0, 0]], [[0, 1]], 2, matrix)).alias("score"))


@query("rough_landscape", f"WITH {PART} SELECT id, round(0.5 * len(list_filter(range(1, 9), lambda i: particle[i] <> 0)) + id / 1000, 9) AS score FROM part8")
def rough_landscape(spark, d):
    return particles(spark, d).select("id", F.round(A.rough_field("particle", [0] * 8, 0.5, F.col("id") / 1000), 9).alias("score"))


@query("log_prob_to_bracket", f"WITH {PART}, t AS (SELECT id, particle AS tok, list_transform(particle, lambda x, i: -i / 10.0) AS lp FROM part8), c AS (SELECT id, CASE WHEN list_position(tok, -2) > 0 THEN lp[1:list_position(tok, -2)] ELSE lp END AS used FROM t) SELECT id, round(list_sum(used), 9) AS total, round(list_avg(used), 9) AS mean FROM c")
def log_prob_to_bracket(spark, d):
    """Token log-probabilities up to the first closing token."""
    lp = F.transform("particle", lambda x, i: -(i + 1) / 10)
    t = particles(spark, d).select("id", "particle", lp.alias("lp"))
    return t.select("id", F.round(A.log_prob_until("particle", "lp", -2), 9).alias("total"), F.round(A.log_prob_until("particle", "lp", -2, mean=True), 9).alias("mean"))


__all__ = ["math"]
