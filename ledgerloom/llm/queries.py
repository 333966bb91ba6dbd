"""The queries of the thirteen operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, html_extraction, language_id, neighbours, packing, periodic_runs, pieces, quality_rules, secret_scans, sharding, simhash, url_filters, whitening
from .common import WORD, read

#: Rules of op3: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SHARD_BYTES = 16 << 20


def tokenizer_file(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(table, table.filter(F.col("vec_id") % 20 == 0).select("vec_id"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("anomaly"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read(spark, sf_dir, "pages"), url_filters.rules_frame(spark, URL_RULES))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of ids, their CRC-32 (unsigned, as little-endian unsigned 32-bit integers), and whether they decode to the text."""
    coded = pieces.encode(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))

    def run(batches):
        for b in batches:
            ids = b.column(1)
            flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy()
            at = at - at[0]
            crc = [zlib.crc32(flat[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), b.column(2)], names=["doc_id", "n_ids", "ids_crc32", "decodes"])

    return coded.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decodes boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "documents")
    out = language_id.identify(table, language_id.learn(table))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as two runs of a ledger: those of even ids, then the others, of which only texts not seen yet are scanned."""
    table = read(spark, sf_dir, "documents")
    first = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    found, _ = secret_scans.scan_runs([table.filter(first), table.filter(~first)])
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scans.BASE))
    counts = [_count_of(k).alias(f"n_{k}") for k in secret_scans.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scans.digest(base), 256).alias("base_sha256"), secret_scans.digest(F.col("spans")).alias("spans"))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "pages")
    return html_extraction.extract(table, html_extraction.learn(table))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    out = compression.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def planted_runs(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) in which, of a tenth of the ids, the words from some place on are repeated periodically."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    g, n = F.floor(h / 10).cast("long"), F.size("_words")
    some = documents.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    some = some.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    place = lambda i: F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i).cast("int")
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.get("_words", place(i))), " ")
    return some.select("doc_id", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.detect(planted_runs(read(spark, sf_dir, "documents"))).withColumn("_best", periodic_runs.longest())
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = {c: F.col(f"_best.{c}") for c in ("start", "length", "period")}
    exponent = F.floor(1000 * best["length"] / best["period"]).cast("long")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *(c.alias(k) for k, c in best.items()), exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long; null where it is beyond one."""
    out = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours, op2_quality_rules, op3_url_filters, op4_sentencepiece, op5_language_id, op6_sharding,
        op7_secret_scans, op8_html_extraction, op9_simhash_near_dedup, op10_best_fit_packing, op11_quality_classifier, op12_periodic_runs, op13_embedding_whitening,
    )
}

ORACLE_SQL = {
    "op3_url_filters": r"""
        WITH parsed AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages),
        rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        fits AS (
            SELECT host, path, max_by(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS best
            FROM (SELECT DISTINCT host, path FROM parsed), rules
            WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            GROUP BY host, path)
        SELECT page_id, parsed.host, parsed.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
        FROM parsed LEFT JOIN fits ON parsed.host = fits.host AND parsed.path = fits.path
    """,
    # Buckets of up to 24 bits, deeper than any table here needs; rows with equal hashes that overflow a bucket aren't covered.
    "op6_sharding": f"""
        WITH hashed AS (
            SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
            FROM documents),
        sized AS (
            SELECT d.depth, h >> (60 - d.depth)::INTEGER AS bucket, sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1 AS fits
            FROM hashed, (SELECT unnest(range(0, 25)) AS depth) d GROUP BY ALL),
        leaf AS (
            SELECT c.depth, c.bucket FROM sized c LEFT JOIN sized p ON p.depth = c.depth - 1 AND p.bucket = c.bucket >> 1
            WHERE c.fits AND (c.depth = 0 OR NOT p.fits))
        SELECT doc_id, n_bytes, depth::INTEGER AS depth, bucket::BIGINT AS bucket, 0::BIGINT AS overflow,
               's' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), depth::INTEGER, '0') END AS shard
        FROM hashed JOIN leaf ON h >> (60 - depth)::INTEGER = bucket
    """,
}
