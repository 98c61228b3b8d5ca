"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm import (
    centroids, kd_shards, licenses, mixing, packing, periodic, preference, quality_rules, sentence_pieces, simhash, templates, top_k,
    toxicity,
)
from rosterline.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), word_bpe())


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = top_k.whole_vectors(read(spark, sf_dir, "embeddings"))
    return top_k.top_k(vectors, F.col("vec_id") % 50 == 0)


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(read(spark, sf_dir, "documents"), shards=16)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(read(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


# The words of a text, and those of a copy that repeats its words from number a on with period p.
_PLANTED = r"""
CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 10 = 0 THEN element_at(transform(
  array(named_struct('w', regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0),
    'g', crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) div 10)),
  s -> CASE WHEN size(s.w) = 0 THEN '' ELSE array_join(flatten(transform(
    array(named_struct('w', s.w, 'a', CAST(s.g % size(s.w) AS INT),
      'p', CAST(1 + (size(s.w) - s.g % size(s.w)) div (3 + s.g % 8) AS INT))),
    t -> transform(t.w, (word, i) -> CASE WHEN i < t.a THEN word ELSE t.w[t.a + (i - t.a) % t.p] END))), ' ') END), 1)
ELSE text END
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(_PLANTED).alias("text"))
    found = periodic.periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[name].cast("string") for name in ("start", "length", "period")]), F.lit("\n")))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    first = found.withColumn("best", F.when(F.size("runs") > 0, best)).withColumn("length", -F.col("best.shorter"))
    return first.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length",
        F.col("best.period").alias("period"), F.expr("1000 * length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.whole_vectors(read(spark, sf_dir, "embeddings"), length=64, scale=64)
    return centroids.clustering(vectors, k=16, rounds=3, seed=1).drop("rescans")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_pieces.encoded(read(spark, sf_dir, "documents"), piece_bpe())
    ids = F.array_join(F.transform("ids", lambda each: each.cast("string")), ",")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    query.__name__: query
    for query in (
        op1_quality_rules, op2_source_mix, op3_mixture_packing, op4_exact_top_k, op5_pairwise_quality,
        op6_kd_shards, op7_license_scan, op8_toxicity, op9_main_text, op10_simhash, op11_periodic_runs,
        op12_centroid_clustering, op13_sentence_pieces,
    )
}

def _clustering_sql(k: int, rounds: int, length: int, scale: int, seed: int) -> str:
    """Every round compares all vectors with all centroids."""
    parts = [f"""vectors AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(CAST({scale} AS DOUBLE) * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY key, v) - 1 AS INT) AS cluster, v
  FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS key, v FROM vectors ORDER BY key, v LIMIT {k}))"""]
    for turn in range(rounds + 1):
        parts.append(f"""a{turn} AS MATERIALIZED (
  SELECT vec_id, v, n.cluster, CAST(n.distance AS BIGINT) AS distance FROM (
    SELECT any_value(x.vec_id) AS vec_id, any_value(x.v) AS v, min({{'distance': list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v)
      + list_dot_product(c.v, c.v), 'cluster': c.cluster}}) AS n FROM vectors x, c{turn} c GROUP BY x.rid))""")
        if turn < rounds:
            parts.append(f"""m{turn} AS MATERIALIZED (
  SELECT cluster, list(mean ORDER BY place) AS v FROM (
    SELECT cluster, place, floor(sum(x) / count(*)) AS mean FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{turn})
    GROUP BY cluster, place) GROUP BY cluster)""")
            parts.append(f"""c{turn + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{turn} c LEFT JOIN m{turn} m ON c.cluster = m.cluster)""")
    return f"""
WITH {", ".join(parts)}
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
"""


SQL = {
    "op12_centroid_clustering": _clustering_sql(16, 3, 64, 64, 1),
    # The rules' reaches and events.
    "op1_quality_rules": r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i:i + 7], ' ')) AS times
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM texts)),
repeated AS (
  SELECT rid, sum(added) AS n FROM (
    SELECT rid, least(8, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 8)) AS added FROM windows WHERE times > 1)
  GROUP BY rid),
measured AS (
  SELECT t.doc_id, t.lang, t.source, CAST(len(t.words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(t.words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(t.lines) - len(list_distinct(t.lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t LEFT JOIN repeated r ON t.rid = r.rid),
judged AS MATERIALIZED (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    1000 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(word_chars, 1) AS symbols,
    1000 * n_dup_lines // greatest(n_words, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats
  FROM measured),
bins AS (
  SELECT lang, source, rule, (value >> greatest(0, length(bin(value)) - 7)) << greatest(0, length(bin(value)) - 7) AS bin, count(*) AS n
  FROM (UNPIVOT (SELECT lang, source, word_length, symbols, dup_lines, repeats, n_words, word_chars FROM judged WHERE NOT base_failed)
    ON word_length, symbols, dup_lines, repeats, n_words, word_chars INTO NAME rule VALUE value)
  GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM bins),
quartiles AS (
  SELECT lang, source, rule, CAST(max(total) AS DOUBLE) AS total, min(bin) FILTER (4 * upto >= total) AS low,
    min(bin) FILTER (4 * upto >= 2 * total) AS middle, min(bin) FILTER (4 * upto >= 3 * total) AS high
  FROM ranked GROUP BY ALL),
rules(rule, reach, counted, event) AS (
  VALUES ('word_length', 8, NULL, 0), ('symbols', 3, 'word_chars', 5), ('dup_lines', 3, 'n_words', 3), ('repeats', 3, 'n_words', 16)),
spreads AS (
  SELECT q.lang, q.source, q.rule, q.low, q.high, r.reach * greatest(
    greatest(q.high - q.low, CAST(1 AS BIGINT) << greatest(0, length(bin(q.high)) - 7)) * (1 + 2 / sqrt(q.total)),
    coalesce(CAST(1000 * r.event AS DOUBLE) / greatest(s.middle, 1), 0)) AS spread
  FROM quartiles q JOIN rules r ON q.rule = r.rule
  LEFT JOIN quartiles s ON s.rule = r.counted AND s.lang IS NOT DISTINCT FROM q.lang AND s.source IS NOT DISTINCT FROM q.source),
limits AS (
  SELECT lang, source,
    max(high + CAST(floor(spread) AS BIGINT)) FILTER (rule = 'word_length') AS length_most,
    max(low - CAST(floor(spread) AS BIGINT)) FILTER (rule = 'word_length') AS length_least,
    max(high + CAST(floor(spread) AS BIGINT)) FILTER (rule = 'symbols') AS symbols_most,
    max(high + CAST(floor(spread) AS BIGINT)) FILTER (rule = 'dup_lines') AS lines_most,
    max(high + CAST(floor(spread) AS BIGINT)) FILTER (rule = 'repeats') AS repeats_most
  FROM spreads GROUP BY lang, source)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
  NOT j.base_failed AND coalesce(j.word_length BETWEEN l.length_least AND l.length_most AND j.symbols <= l.symbols_most
    AND j.dup_lines <= l.lines_most AND j.repeats <= l.repeats_most, false) AS kept
FROM judged j LEFT JOIN limits l ON j.lang IS NOT DISTINCT FROM l.lang AND j.source IS NOT DISTINCT FROM l.source
""",
    "op2_source_mix": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, row_number() OVER w AS rank,
    coalesce(sum(source_size * 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    sum(source_size) OVER () AS total
  FROM sources WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)),
leveled AS (
  SELECT *, CAST(1.5 AS DOUBLE) * CAST(total AS DOUBLE) - CAST(full_words AS DOUBLE) AS words_left FROM filled),
hit AS (
  SELECT rank AS first_rank, words_left AS at_left, open_weight AS at_open FROM leveled
  WHERE weight * words_left / open_weight <= source_size * 2 ORDER BY rank LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN rank >= first_rank THEN weight * at_left / at_open ELSE CAST(source_size * 2 AS DOUBLE) END AS target
  FROM leveled, hit),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS copies,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(copies * size + least(greatest(CAST(floor(target) AS BIGINT) - copies * source_size - before, 0), size) AS BIGINT) AS taken
FROM placed
""",
    "op4_exact_top_k": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
""",
}
