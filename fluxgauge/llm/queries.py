"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.llm import bpe, class_lm, embeddings, exact_dedup, language, mixing, personal_data, repeats, search, sharding, simhash, token_files, whitening

QUERIES = {}
ORACLES = {}
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.write_and_read(documents(spark, sf_dir), vocabulary())
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_embedding_grid")
def op2_embedding_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op3_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(documents(spark, sf_dir))


@query("op4_sampled_splitters")
def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query("op6_class_lm")
def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(documents(spark, sf_dir))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_bpe_round_trip")
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(documents(spark, sf_dir), vocabulary())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(documents(spark, sf_dir))
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        personal_data.written(F.col("spans")).alias("spans"))


# The same draw in SQL: 52 bits of an MD5 against the sums of the Poisson terms. Rates stay below one piece here.
@query("op10_poisson_mix", """
WITH s AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS b FROM documents GROUP BY source),
t AS (SELECT sum(b)::DOUBLE AS all_b, sum(sqrt(b::DOUBLE)) AS all_w FROM s),
r AS (SELECT source, round(sqrt(b::DOUBLE) * (all_b / all_w) / b, 9) AS rate FROM s, t),
k AS (SELECT source, rate, i, exp(-rate) * CASE WHEN i = 0 THEN 1.0 ELSE pow(rate, i) / gamma(i + 1) END AS p
      FROM r, range(0, 64) AS x(i)),
c AS (SELECT source, rate, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS cdf FROM k),
d AS (SELECT doc_id, source, ('0x' || substr(md5('mix-1|' || doc_id || '|1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.source, any_value(c.rate) AS rate, count(*) FILTER (WHERE c.cdf <= d.u) AS copies
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id, d.source)
SELECT doc_id, source, rate, copies, copy, md5('mix-1|' || doc_id || '|copy|' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n WHERE copies > 0)""")
def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    found = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source", crc.alias("text_crc32")))
    # read after the sort, so that whole texts are exploded and shuffled
    arrived = F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")) == F.col("row.text_crc32")
    doc_id = F.when(arrived, F.col("row.doc_id")).otherwise(F.raise_error(F.lit("a mixed text differs from its document's")))
    return found.select(doc_id.alias("doc_id"), "source", "rate", "copies", "copy", "mix_key")


@query("op11_repeats", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
s AS (SELECT w.r, w.i FROM w JOIN (SELECT win, min(doc_id) AS least FROM w GROUP BY win) m ON w.win = m.win WHERE w.doc_id > m.least),
c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS at FROM s),
p AS (SELECT r, unnest(range(1, len(ws) + 1)) AS at, unnest(ws) AS word FROM d),
k AS (SELECT p.r, string_agg(p.word, ' ' ORDER BY p.at) AS kept, count(*)::BIGINT AS n FROM p ANTI JOIN c ON p.r = c.r AND p.at = c.at GROUP BY p.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r""")
def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = F.when(F.col("kept").isNull(), F.col("words_sha256")).otherwise(F.sha2(F.col("kept").cast("binary"), 256))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_bloom_search", f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
d AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS cn, sum(n)::BIGINT AS cl FROM d),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
q AS (SELECT i, item_id, unnest(list_distinct(ts)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM f WHERE term IN (SELECT term FROM q) GROUP BY term), s),
p AS (SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * cn) // cl))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (r), s GROUP BY i, item_id, doc_id, r)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10""")
def op12_bloom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    models = whitening.fit(vectors)
    error = whitening.identity_error(vectors, models)
    return whitening.whiten(vectors, models).withColumn("identity_error", F.lit(error))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
