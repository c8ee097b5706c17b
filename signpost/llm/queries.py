"""The operators applied to the whole benchmark tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signpost.llm import clusters, language, licenses, mixing, negatives, neighbours, packing, passages, quality, ranking, sharding, simhash, suffix
from signpost.llm.license_rules import BASE, CONFIDENCE, SPAN, STEMS, rules


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(spark.read.parquet(f"{folder}/{name}.parquet"))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_of(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


def _ranking(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ranked_documents(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix": _on("documents", suffix.repeated_passages),
    "op2_sharding": _on("documents", sharding.byte_shards),
    "op3_simhash": _on("documents", simhash.near_duplicates),
    "op4_language": _on("documents", language.languages_of),
    "op5_neighbours": _on("embeddings", neighbours.nearest_to_every),
    "op6_quality": _quality,
    "op7_packing": _on("documents", packing.packed_documents),
    "op8_mixing": _on("documents", mixing.mix_report),
    "op9_passages": _on("documents", passages.fuzzy_passages),
    "op10_clusters": _on("embeddings", clusters.near_duplicates),
    "op11_ranking": _ranking,
    "op12_licenses": _on("documents", licenses.license_report),
    "op13_negatives": _on("embeddings", negatives.hard_negatives),
}

_PLAIN = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_VECTORS = """v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

_RULES = ", ".join(f"({r.id}, {r.level}, '{r.label}', '{r.keyword}', '^(?:{r.pattern}) ', {r.base})" for r in rules())
_STEMS = " OR ".join(f"contains({_PLAIN}, '{stem}')" for stem in STEMS)
_case = lambda value, of: f"CASE {value} {' '.join(f'WHEN {k} THEN {v}' for k, v in of.items())} END"

#: What SQL can state. Hashes, models, tokens and approximate neighbours are tested against brute force.
SQL: dict[str, str] = {
    "op2_sharding": """
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    [n::BIGINT] || range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS steps),
bytes AS (
  SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
sized AS (
  SELECT doc_id, (coalesce(strlen(text), 0) + 16)::BIGINT AS size,
    CASE WHEN len(b) > 0 THEN xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295)
         WHEN text IS NOT NULL THEN 0 END::BIGINT AS text_crc32
  FROM bytes, bits),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) AS nth, sum(size) OVER () AS total
  FROM sized),
cut AS (SELECT *, (((2 * upto - size) * 40) // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (nth - min(nth) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut""",
    "op10_clusters": f"""
WITH RECURSIVE {_VECTORS},
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id""",
    "op11_ranking": rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_PLAIN}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
held AS (SELECT r, doc_id, len(t)::HUGEINT AS n, t FROM words WHERE len(t) > 0),
every AS (SELECT count(*)::BIGINT AS docs, sum(n)::HUGEINT AS terms FROM held),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_PLAIN}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counted AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM held)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, doc_id, n, term),
weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, every GROUP BY term, docs),
impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)::BIGINT))) AS impact
  FROM counted JOIN weighed USING (term), every),
scored AS (
  SELECT item_id, doc_id, r, sum(impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY item_id, doc_id, r HAVING sum(impact) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS nth FROM scored)
SELECT item_id, nth::INTEGER AS rank, doc_id, score FROM ranked WHERE nth <= 50""",
    "op12_licenses": rf"""
WITH rules(rule, level, label, keyword, pattern, base) AS (VALUES {_RULES}),
words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_STEMS}, false) AS held,
    coalesce(regexp_extract_all({_PLAIN}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (SELECT r, unnest(range(len(w))) AS start, unnest(w) AS word FROM words WHERE held),
tried AS (
  SELECT r, start, rules.*, regexp_extract(array_to_string(w[start + 1:start + {SPAN}], ' ') || ' ', pattern) AS m
  FROM places JOIN rules ON keyword = word JOIN words USING (r)),
met AS (SELECT r, start, start + len(m) - len(replace(m, ' ', '')) AS stop, rule, level, label, base FROM tried WHERE m <> ''),
kept AS (
  SELECT r, level, label FROM met a WHERE NOT EXISTS (
    SELECT 1 FROM met b WHERE b.r = a.r AND b.start <= a.start AND b.stop >= a.stop
      AND (b.level, b.start - b.stop, b.rule) < (a.level, a.start - a.stop, a.rule))),
based AS (SELECT r, start, {_case("rule", {r.id: f"'{BASE[r.pattern]}'" for r in rules() if r.base})} AS label FROM met WHERE base),
listed AS (
  SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM (SELECT r, label FROM kept UNION ALL SELECT r, label FROM based) GROUP BY r),
sure AS (SELECT r, max({_case("level", CONFIDENCE)})::DOUBLE AS score FROM kept GROUP BY r),
counted AS (
  SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM based GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM words LEFT JOIN counted USING (r) LEFT JOIN listed USING (r) LEFT JOIN sure USING (r)""",
    "op13_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positives AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
mined AS (
  SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.r, positive_id ORDER BY score DESC, vec_id) AS nth
  FROM positives p JOIN scored s ON s.r = p.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, nth::INTEGER AS rank, negative_id, positive_score, negative_score FROM mined WHERE nth <= 10""",
}
