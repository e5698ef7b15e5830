"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.llm import (
    byte_bpe,
    ctph,
    merkle,
    mixing,
    near_dedup,
    packing,
    pii,
    sharding,
    spelling,
    substring_dedup,
    token_counts,
    topk,
    weak_labels,
)
from forewarn.llm.common import documents, embeddings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKEN_LIMIT = 4096
SHARDS = 16


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(documents(spark, sf_dir), shingle=3, percent=85)


@query
def op2_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return weak_labels.score(docs, weak_labels.fit_scorers(docs, table(spark, sf_dir, "labels")))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir), *files), *files)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.extract(docs, pii.pattern_table(docs))
    return found.select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans"
    )


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0, k=5)


SQL["op5_exact_top_k"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op7_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup.without_passages(docs, removed="removed")


@query
def op8_piecewise_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ctph.compare_with_next(documents(spark, sf_dir), ranges)


@query
def op9_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False
    )
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are neighbours in the order (text digest, doc_id), so a copy mostly shares its original's shard."""
    docs = documents(spark, sf_dir).select(
        "doc_id",
        F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"),
        F.xxhash64("text").alias("digest"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes"),
    )
    sharded = sharding.shard_by_bytes(
        docs, [F.col("digest"), F.col("doc_id")], F.col("bytes"), SHARDS, carry=("doc_id", "text_crc32")
    )
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 of a list of bytes in SQL: its table from the polynomial, one step a byte.
CRC_TABLE = """
crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))))"""


def crc_sql(bytes_list: str) -> str:
    """Needs ``crc_table`` in the FROM clause."""
    return f"""xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_list}),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def _leaf_sql(chars: str) -> str:
    fields = ("doc_id", "source", "lang", chars, "text")
    texts = [f"CAST({field} AS VARCHAR)" for field in fields]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + "))"


def _levels_sql(source: str) -> str:
    return f"""
  SELECT tree, 0 AS lvl, place, h, total FROM {source}
  UNION ALL
  SELECT tree, lvl + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 1) // 2
  FROM {{levels}} WHERE total > 1 GROUP BY tree, lvl, place // 2"""


def _climb_sql(climb: str, levels: str) -> str:
    return f"""
  SELECT c.id, c.tree, c.lvl + 1, c.place // 2, (c.total + 1) // 2,
    sha256(CASE WHEN c.place % 2 = 1 THEN concat(s.h, c.folded) ELSE concat(c.folded, s.h) END),
    concat(c.proof, s.h)
  FROM {climb} c LEFT JOIN {levels} s ON s.tree = c.tree AND s.lvl = c.lvl AND s.place = xor(c.place, 1)
  WHERE c.total > 1"""


SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE {CRC_TABLE},
numbered AS MATERIALIZED (
  SELECT row_number() OVER () AS id, documents.*, coalesce('=' || lang, '-') AS tree, {_leaf_sql("n_chars")} AS leaf,
    {crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 7 = 0
      AS chosen
  FROM documents, crc_table),
leaves AS MATERIALIZED (
  SELECT id, doc_id, tree, leaf AS h,
    CASE WHEN chosen THEN {_leaf_sql("(n_chars + 1)")} ELSE leaf END AS now,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS total
  FROM numbered),
levels AS ({_levels_sql("leaves").format(levels="levels")}),
subroots AS MATERIALIZED (
  SELECT 'top' AS tree, tree AS named, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total
  FROM levels WHERE total = 1),
top_levels AS ({_levels_sql("subroots").format(levels="top_levels")}),
climb AS (
  SELECT id, tree, 0 AS lvl, place, total, now AS folded, '' AS proof FROM leaves
  UNION ALL {_climb_sql("climb", "levels")}),
top_climb AS (
  SELECT c.id, s.tree, 0 AS lvl, s.place, s.total, c.folded, c.proof
  FROM climb c JOIN subroots s ON s.named = c.tree WHERE c.total = 1
  UNION ALL {_climb_sql("top_climb", "top_levels")})
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(t.proof) AS proof_sha256, t.folded AS folded_root,
  t.folded = r.h AS verified
FROM leaves l JOIN subroots s ON s.named = l.tree
  JOIN top_climb t ON t.id = l.id AND t.total = 1
  JOIN top_levels r ON r.total = 1"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


_UTF8 = "list_transform(range(1, strlen({text}) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"

SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS MATERIALIZED (
  SELECT run, concat(doc_id, ':', run) AS seed, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents)
  GROUP BY ALL),
drawn AS MATERIALIZED (SELECT run, n, {crc_sql(_UTF8.format(text="seed"))} AS h FROM runs, crc_table),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM drawn)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (
  SELECT word, spot, left(word, spot) || substr(word, spot + 2) AS rest
  FROM (SELECT word, unnest(range(0, length(word))) AS spot FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
  UNION SELECT DISTINCT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT DISTINCT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
best AS MATERIALIZED (
  SELECT near.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS form, max(w.n) AS form_n
  FROM near JOIN words w ON w.word = near.near GROUP BY near.word),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form,
    CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = chain.root WHERE f.form IS NOT NULL),
ends AS (
  SELECT chain.word, chain.root FROM chain JOIN formed f ON f.word = chain.root WHERE f.form IS NULL)
SELECT word, form, coalesce(ends.root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)"""


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(documents(spark, sf_dir), mixing.word_count(F.col("text")))
    decided = mixing.decisions(sized, mixing.targets(sized))
    return decided.select("doc_id", "size", "source_size", "target", "taken")


def _mix_draw(name: str) -> str:
    text = f"concat('{mixing.SEED}:', coalesce(CAST({name} AS VARCHAR), '-'))"
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


SQL["op13_source_mix"] = f"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sized GROUP BY source),
shared AS (
  SELECT *, sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER upto, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0) AS free
  FROM sources
  WINDOW upto AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bound AS (SELECT *, weight * rest > 3 * source_size * free AS is_bound FROM shared),
level AS (
  SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (is_bound), 0) AS rest,
    coalesce(sum(weight) FILTER (NOT is_bound), 1) AS free FROM bound),
targets AS (
  SELECT source, source_size, CASE WHEN is_bound THEN CAST(3 * source_size AS DOUBLE)
    ELSE weight * CAST(level.rest AS DOUBLE) / CAST(level.free AS DOUBLE) END AS target
  FROM bound, level),
placed AS (
  SELECT doc_id, size, source_size, target, rate - floor(rate) AS fraction, floor(rate) AS whole,
    row_number() OVER (PARTITION BY source ORDER BY size, turn, doc_id NULLS FIRST) - 1 AS place, start
  FROM (
    SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      {_mix_draw("doc_id")} AS turn, {_mix_draw("s.source")} AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source))
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + floor(start + (place + 1) * fraction) - floor(start + place * fraction)) AS BIGINT) AS taken
FROM placed"""
