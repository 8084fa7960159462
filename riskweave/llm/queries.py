"""The operators' queries over whole tables, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_tree import bpe_round_trip
from .common import table
from .decontaminate import decontaminate
from .html_text import html_text
from .line_dedup import line_dedup
from .media import media_columns
from .merkle import merkle_manifest
from .ngram_join import ngram_join
from .packing import pack_documents
from .quality_rules import quality_rules
from .ranked_search import ranked_search
from .secrets import secret_scan
from .token_counts import token_counts
from .toxicity import toxicity


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity of 85 hundredths."""
    return ngram_join(table(spark, sf_dir, "documents"), 4, 85, 100)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the nearest labelled documents."""
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, each document closed by id 0."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in tar shards, described from what is read back."""
    return media_columns(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and the posterior's verdict."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 10 code points that a smaller doc_id holds."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding with the multilingual vocabulary."""
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base patterns and the network's findings."""
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts against a limit of 1024 tokens."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof, and its fold where every other document has lost its line breaks."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    received = {"text": F.translate("text", "\n", "")}
    return merkle_manifest(table(spark, sf_dir, "documents"), received=received, tampered=even & F.col("text").contains("\n"))  # others are what they were


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of the benchmark in every document."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return out.drop("items")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_media_columns": op4_media_columns,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_html_text": op10_html_text,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_decontamination": op12_decontamination,
    "op13_ranked_search": op13_ranked_search,
}

_OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: list_slice(ws, i, i + 3))
                                      WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.c + b.c - shared)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, r.m AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS m FROM r GROUP BY node) r ON r.node = w.doc_id
"""

_OP6_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
o AS (SELECT k, min(doc_id) AS owner FROM k WHERE length(k) >= 10 GROUP BY k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o USING (k) GROUP BY doc_id
"""

# levels of nodes by source (a) and over sources (t), then each row's way up through both
_OP11_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source,
        sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
          || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
          || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS other,
        list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii(substr(doc_id::VARCHAR, i, 1)) >> b) & 1)))),
          lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)) AS crc
      FROM documents),
p AS (SELECT doc_id, leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN other ELSE leaf END AS seen, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
a AS (SELECT s, 0 AS lvl, pos, n, leaf AS h FROM p
      UNION ALL
      SELECT s, lvl + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY s, lvl, pos // 3),
sub AS (SELECT s, lvl AS depth, h AS subroot FROM a WHERE n = 1),
t AS (SELECT 0 AS lvl, s AS pos, count(*) OVER () AS n, subroot AS h FROM sub
      UNION ALL
      SELECT lvl + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, pos // 3),
nodes AS (SELECT s, lvl, pos, h FROM a WHERE n > 1 UNION ALL SELECT sub.s, sub.depth + t.lvl, t.pos, t.h FROM sub, t WHERE t.n > 1),
way AS (SELECT p.doc_id, p.leaf, p.s, 0 AS step, p.pos AS own, p.seen AS cur, '' AS sibs FROM p
      UNION ALL
      SELECT w.doc_id, w.leaf, w.s, w.step + 1, any_value(CASE WHEN w.step + 1 = sub.depth THEN w.s ELSE w.own // 3 END),
             sha256(string_agg(CASE WHEN x.pos = w.own THEN w.cur ELSE x.h END, '' ORDER BY x.pos)),
             any_value(w.sibs) || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos <> w.own), '')
      FROM (SELECT way.* REPLACE (CASE WHEN way.step = 0 AND sub.depth = 0 THEN way.s ELSE way.own END AS own) FROM way JOIN sub USING (s)) w JOIN sub ON sub.s = w.s JOIN nodes x ON x.s = w.s AND x.lvl = w.step AND x.pos // 3 = w.own // 3
      GROUP BY w.doc_id, w.leaf, w.s, w.step),
r AS (SELECT h AS root FROM t WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM way JOIN sub USING (s), r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) = 1
"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

_OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(len(ws) - 10, 0) + 2), lambda i: list_slice(ws, i, i + least(len(ws), 10) - 1))) AS gram FROM b WHERE len(ws) > 0),
g AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS pos, ws FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k),
m AS (SELECT doc_id, pos, w.k, item_id FROM g JOIN w ON w.k = g.k AND w.gram = list_slice(g.ws, g.pos, g.pos + g.k - 1)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
m AS (SELECT doc_id, 10 + (90 * len(ws)::BIGINT * n_docs) // total AS m FROM d, c WHERE len(ws) > 0),
df AS (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN df USING (term) JOIN f USING (term) JOIN m USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL = {"op1_ngram_jaccard": _OP1_SQL, "op6_line_dedup": _OP6_SQL, "op11_merkle_manifest": _OP11_SQL, "op12_decontamination": _OP12_SQL, "op13_ranked_search": _OP13_SQL}
