"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm.ann import nearest_neighbours
from riskframe.llm.common import table
from riskframe.llm.conversations import damaged, repair_report
from riskframe.llm.hard_negatives import mine_hard_negatives
from riskframe.llm.licenses import find_licenses
from riskframe.llm.mixing import mix
from riskframe.llm.near_dedup import near_duplicates
from riskframe.llm.packing import pack
from riskframe.llm.pii import replace_entities
from riskframe.llm.quality import quality
from riskframe.llm.secrets import find_secrets
from riskframe.llm.sentence_pieces import decode_pieces, encode_pieces, ids_digest
from riskframe.llm.token_scan import document_token_counts
from riskframe.llm.toxicity import held_out, learn, toxicity


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document stands in the stream depends on how rows are dealt out, so it is left out here."""
    return document_token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ended")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op5_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op6_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity(docs, learn(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op11_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has another label than its own."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode_pieces(encode_pieces(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_nn_descent": op1_nn_descent,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_outliers": op5_quality_outliers,
    "op6_toxicity_lexicon": op6_toxicity_lexicon,
    "op7_pack": op7_pack,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_mix_sources": op10_mix_sources,
    "op11_repair_turns": op11_repair_turns,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sentence_pieces": op13_sentence_pieces,
}
OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
c AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
         3 * coalesce(sum(source_size) OVER p, 0)::BIGINT AS given,
         (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER p, 0)::BIGINT AS open
  FROM w WINDOW p AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, (total - given) * weight > 3 * source_size * open AS over_limit FROM c),
l AS (SELECT given AS level_given, open AS level_open FROM o WHERE NOT over_limit ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN over_limit THEN (3 * source_size)::DOUBLE ELSE ((total - level_given) * weight)::DOUBLE / level_open END AS target
  FROM o CROSS JOIN l),
r AS (
  SELECT *, target - whole * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t)),
n AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
f AS (
  SELECT source, size, coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words,
         (sum(n * size * size) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS squares
  FROM n),
h AS (
  SELECT r.source AS s, max_by((f.size, f.words, (rest - words) / squares), f.size) AS c
  FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source WHERE (rest - words) * size < squares GROUP BY r.source),
p AS (SELECT d.*, r.* EXCLUDE (source), coalesce(c[2], 0) AS words, size > c[1] AS certain, c[3] * size AS p
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN h ON d.source IS NOT DISTINCT FROM h.s),
o2 AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS pareto, row_number() OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id, size) AS k FROM p WHERE p > 0 AND p < 1 AND NOT certain),
e AS (SELECT source, k, size, floor(rest - words)::BIGINT AS room FROM o2),
g AS (
  SELECT source, 0::BIGINT AS k, any_value(room) AS room, false AS more FROM e GROUP BY source
  UNION ALL
  SELECT g.source, e.k, CASE WHEN e.size <= g.room THEN g.room - e.size ELSE g.room END, e.size <= g.room FROM g JOIN e ON e.source IS NOT DISTINCT FROM g.source AND e.k = g.k + 1),
y AS (SELECT o2.*, g.more FROM o2 JOIN g ON o2.source IS NOT DISTINCT FROM g.source AND o2.k = g.k),
q AS (SELECT source AS s, any_value(rest) - (any_value(words) + coalesce(sum(size) FILTER (more), 0)) AS gap FROM y GROUP BY source),
z AS (
  SELECT y.source AS s, k AS j, row_number() OVER (PARTITION BY y.source ORDER BY abs(size - gap), pareto, doc_id, size) AS place
  FROM y JOIN q ON y.source IS NOT DISTINCT FROM q.s WHERE NOT more AND abs(size - gap) < gap),
m AS (SELECT doc_id, size, y.source, 1 AS extra FROM y LEFT JOIN (SELECT * FROM z WHERE place = 1) last ON y.source IS NOT DISTINCT FROM last.s AND y.k = last.j WHERE more OR j IS NOT NULL)
SELECT p.doc_id, p.size, source_size, target, (p.size * (whole + CASE WHEN certain OR extra = 1 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p LEFT JOIN m ON p.doc_id = m.doc_id AND p.source IS NOT DISTINCT FROM m.source AND p.size = m.size
"""
#: Row by row, each state of the structure keeps its cheapest (cost, audit, repaired lines); insertions come before a row or at the end.
OP11 = r"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 20 AS kind
  FROM filled),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
judged AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, E' \t\n\x0b\x0c\r') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault FROM judged),
moves(state, pre, entered, ins) AS (VALUES
  ('0', '', '0', ''), ('0', 'I', 'u', 'user:'), ('0', 'II', 'a', E'user:\nassistant:'),
  ('s', '', 's', ''), ('s', 'I', 'u', 'user:'), ('s', 'II', 'a', E'user:\nassistant:'),
  ('u', '', 'u', ''), ('u', 'I', 'a', 'assistant:'), ('a', '', 'a', ''), ('a', 'I', 'u', 'user:')),
best AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS state, {'cost': 0::BIGINT, 'audit': '', 'done': ''} AS way FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT conv_id, i, state, min(way) FROM (
    SELECT b.conv_id, f.i, e.o.state AS state,
           {'cost': b.way.cost + 5 * len(m.pre) + e.o.cost, 'audit': b.way.audit || m.pre || e.o.edit,
            'done': b.way.done || CASE WHEN m.ins = '' THEN '' ELSE m.ins || E'\n' END || CASE WHEN e.o.line IS NULL THEN '' ELSE e.o.line || E'\n' END} AS way
    FROM best b JOIN faulty f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = b.i + 1 JOIN moves m ON m.state = b.state,
    LATERAL (SELECT CASE WHEN m.entered = 'u' THEN 'a' ELSE 'u' END AS want, CASE WHEN f.fault = 't' THEN 5 ELSE 0 END AS more) w,
    LATERAL (SELECT unnest([
      {'edit': 'D', 'cost': 2, 'state': m.entered, 'line': NULL::VARCHAR, 'ok': true},
      {'edit': 'K', 'cost': more, 'state': CASE WHEN f.initial = 's' THEN 's' ELSE want END, 'line': f.role || ':' || f.text, 'ok': f.fault NOT IN ('b', 'd') AND (f.initial = want OR f.initial = 's' AND m.entered = '0')},
      {'edit': 'R', 'cost': 1 + more, 'state': want, 'line': CASE WHEN want = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text, 'ok': f.fault NOT IN ('b', 'd')}]) AS o) e
    WHERE e.o.ok)
  GROUP BY conv_id, i, state),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
ends AS (
  SELECT n.conv_id, min({'cost': way.cost + 5 * len(pre), 'audit': way.audit || pre, 'done': way.done || CASE WHEN ins = '' THEN '' ELSE ins || E'\n' END}) AS way
  FROM best JOIN n ON best.conv_id IS NOT DISTINCT FROM n.conv_id AND i = n JOIN moves ON moves.state = best.state WHERE entered IN ('0', 'a') GROUP BY n.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit, sha256(CASE WHEN coalesce(way.done, '') = '' THEN '' ELSE left(way.done, len(way.done) - 1) END) AS repaired_sha256
FROM ids LEFT JOIN n ON ids.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN ends ON ids.conv_id IS NOT DISTINCT FROM ends.conv_id
"""
OP12 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_sum(list_transform(range(1, 1 + greatest(len(a.e), len(r.e))), lambda i: coalesce(a.e[i], 0) * coalesce(r.e[i], 0)))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5
"""

ORACLES = {"op12_hard_negatives": OP12, "op10_mix_sources": OP10, "op11_repair_turns": OP11}
