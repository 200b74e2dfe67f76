"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .ball_tree import top_k
from .chosen_path import jaccard_join
from .collocations import collocations
from .common import tokenizer_path
from .crf import quality_scores
from .host_rules import host_rules
from .html_tree import extract
from .packing import pack
from .recompression import substring_dedup
from .sentencepieces import encode_decode
from .shards import shard_plan
from .sstable import read_sstables, write_sstables
from .suffix_sort import suffix_dedup
from .vector_codes import vector_codes


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_html_extraction(spark, sf_dir):
    return extract(_table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op3_top_k(spark, sf_dir):
    return top_k(_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op4_host_rules(spark, sf_dir):
    return host_rules(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM w, unnest(generate_series(1, len(ws) - 4)) AS t(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(generate_series(0, 4)) AS t(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS k FROM judged WHERE host IS NOT NULL GROUP BY host),
total AS (SELECT count(*) AS hosts, sum(n)::DOUBLE AS nn, sum(k)::DOUBLE AS kk, sum(n::DOUBLE * n) AS n2, sum(k::DOUBLE * k / n) AS k2 FROM hosts),
m AS (SELECT *, kk / nn AS mean, (k2 - nn * (kk / nn) * (kk / nn) - (hosts - 1) * (kk / nn) * (1 - kk / nn)) / nullif(nn - n2 / nn, 0e0) AS between_hosts FROM total),
prior AS (SELECT mean, CASE WHEN between_hosts > 0 THEN greatest(2e0, least(1000e0, mean * (1 - mean) / nullif(between_hosts, 0e0) - 1)) ELSE 1000e0 END AS weight FROM m),
verdict AS (SELECT host, (k + mean * weight) / (n + weight) > 0.5e0 AND (k + mean * weight) / (n + weight) > 2e0 * mean AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM judged LEFT JOIN verdict USING (host)
"""


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op8_sstable(spark, sf_dir):
    return read_sstables(write_sstables(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op9_sentencepiece(spark, sf_dir):
    return encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_packing(spark, sf_dir):
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_sharding(spark, sf_dir):
    return shard_plan(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def _op12_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds of the contract written out one after another, each from all assignments anew."""
    nearest = """SELECT key, part, v, entry, d FROM (
    SELECT key, part, p.v, entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{r} AS b USING (part))
  QUALIFY row_number() OVER (PARTITION BY key, part ORDER BY d, entry) = 1"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (" + nearest.format(r=r) + ")")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM s{r} GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.v, b{r}.v) AS v FROM b{r} LEFT JOIN m{r} USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS key, vec_id, label, list_transform(embedding, lambda x: CAST(floor({1024} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT key, t.part, v[t.part * len(v) // {parts} + 1 : (t.part + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) AS t(part)),
b0 AS MATERIALIZED (SELECT part, key - 1 AS entry, v FROM p WHERE key <= {entries}),
{", ".join(steps)},
book AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM b{rounds})),
codes AS (SELECT key, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY key)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (key), book
"""


def op13_collocations(spark, sf_dir):
    return collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM p, range(1, 6) AS t(k), unnest(range(1, len(ws) - k + 2)) AS u(i)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, k, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS p1, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS p2
  FROM f, unnest(range(1, k)) AS t(j)),
scored AS (
  SELECT cuts.*, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f AS y ON y.lang = cuts.lang AND y.phrase = p2 JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM best WHERE NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = best.lang AND f.k > best.k AND 100 * f.a >= 100 * best.a AND contains(' ' || f.phrase || ' ', ' ' || best.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""


OP2_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i AS pos, array_to_string(ws[i:i + 49], ' ') AS win FROM w, unnest(generate_series(1, len(ws) - 49)) AS t(i)),
least AS (SELECT win, min(doc_id) AS least FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM win JOIN least USING (win), unnest(generate_series(0, 49)) AS t(k) WHERE doc_id > least),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w) AS x ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(kept, '') AS text
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_top_k": op3_top_k,
    "op4_host_rules": op4_host_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality": op6_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_sstable": op8_sstable,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_packing": op10_packing,
    "op11_sharding": op11_sharding,
    "op12_vector_codes": op12_vector_codes,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op2_substring_dedup": OP2_SQL, "op3_top_k": OP3_SQL, "op4_host_rules": OP4_SQL, "op12_vector_codes": _op12_sql(), "op13_collocations": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
