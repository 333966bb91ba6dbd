"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

Every row hashes to BITS bits. A bucket is a prefix of them; it splits on the next bit only while it holds more than
``max_bytes``. The sizes are first summed for prefixes of STEP bits (at most 2**STEP rows, partial sums before the
shuffle); where such a prefix is still oversized, and only there, the next STEP bits are summed. A row's bucket is the
shortest prefix that fits. Rows that share all bits, such as many copies of one row, can't be told apart by a hash: they
go to overflow shards of their bucket by a running count, which needs no window over them (equal rows are counted, then
numbered). A single row above the limit is a shard of its own. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, octets

#: Bits of a row's hash, and bits of the directory that are looked at together.
BITS, STEP = 60, 12


def row_hash(key: Column, text: Column) -> Column:
    """BITS leading bits of the MD5 of key and text, as a long of 0 or more."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\\N")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def directory(sizes: DataFrame, max_bytes: int) -> DataFrame:
    """The buckets (depth int, bucket long, bytes long, n_rows long) for ``sizes`` (h long, n_bytes long)."""
    leaves, rest, low = None, sizes, 0
    while True:
        high = min(low + STEP, BITS)
        fine = rest.groupBy(prefix(F.col("h"), F.lit(high)).alias("fine")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n_rows"))
        depths = F.explode(F.sequence(F.lit(low), F.lit(high)))
        level = (
            fine.select("fine", "bytes", "n_rows", depths.alias("depth"))
            .groupBy("depth", F.call_function("shiftright", "fine", F.lit(high) - F.col("depth")).alias("bucket"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        )
        level = cut(level)
        fits = (F.col("bytes") <= max_bytes) | (F.col("n_rows") == 1) | (F.col("depth") == BITS)
        # A leaf fits and its parent doesn't; above the first bits of this round, the parent is known not to fit.
        parents = level.filter(~fits).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket"))
        found = level.filter(fits & (F.col("depth") > low)).join(parents, ["depth", "bucket"], "left_semi")
        found = found if low else found.unionByName(level.filter(fits & (F.col("depth") == 0)))
        leaves = found if leaves is None else leaves.unionByName(found)
        open_ = level.filter(~fits & (F.col("depth") == high)).select("bucket")
        if high == BITS or open_.isEmpty():
            return leaves.select("depth", "bucket", "bytes", "n_rows")
        rest = rest.withColumn("bucket", prefix(F.col("h"), F.lit(high))).join(open_, "bucket", "left_semi").select("h", "n_bytes")
        low = high


def shard(df: DataFrame, max_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, ``n_bytes`` (UTF-8 bytes of the text), ``depth``, ``bucket``, ``overflow`` and ``shard`` (its name).

    Every shard holds at most ``max_bytes``, or one larger row. Null texts and empty texts are 0 bytes, null keys hash as
    such, repeated rows stay repeated (and overflow where they must), other columns are ignored, no rows give no rows.
    The result doesn't depend on how the table is partitioned.
    """
    rows = df.select(F.col(f"`{key}`").alias("k"), octets(F.col(f"`{text}`")).alias("n_bytes"), row_hash(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h"))
    rows = cut(rows)
    buckets = cut(directory(rows.select("h", "n_bytes"), max_bytes))
    depths = {r.depth: r.n for r in buckets.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # at most BITS + 1 rows
    deepest = max(depths, default=0)
    # The directory proper: an entry for each prefix of as many bits as the deepest bucket, so long as that is a small multiple
    # of the buckets; the few rows of deeper ones are looked up by the depths there are. It has about total bytes / max_bytes
    # rows and Spark broadcasts it if small.
    reach = min(deepest, max(12, (16 * sum(depths.values())).bit_length() - 1))
    span = F.expr(f"shiftleft(1L, greatest({reach} - depth, 0))")
    shallow = buckets.filter(F.col("depth") <= reach).select("depth", "bucket", "bytes", "n_rows", F.explode(F.sequence(F.col("bucket") * span, (F.col("bucket") + 1) * span - 1)).alias("entry"))
    placed = rows.withColumn("entry", prefix(F.col("h"), F.lit(reach))).join(shallow, "entry", "left")
    if deepest > reach:
        deep = buckets.filter(F.col("depth") > reach)
        homeless = placed.filter(F.col("depth").isNull()).select("k", "n_bytes", "h", F.explode(F.array(*(F.lit(d) for d in sorted(depths) if d > reach))).alias("depth"))
        homeless = homeless.withColumn("bucket", F.expr(f"shiftright(h, {BITS} - depth)")).join(deep, ["depth", "bucket"])
        placed = placed.filter(F.col("depth").isNotNull()).select("k", "n_bytes", "h", "depth", "bucket", "bytes", "n_rows").unionByName(homeless.select("k", "n_bytes", "h", "depth", "bucket", "bytes", "n_rows"))
    crowded = (F.col("depth") == BITS) & (F.col("bytes") > max_bytes)
    settled = placed.filter(~crowded).select("k", "n_bytes", "depth", "bucket", F.lit(0).cast("long").alias("overflow"))
    if deepest < BITS:
        return _named(settled, key)
    # Equal hashes: equal (key, bytes) rows are interchangeable, so they are counted and numbered again from the count.
    each = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest("n_bytes", F.lit(1)))).cast("long")
    copies = placed.filter(crowded).groupBy("k", "n_bytes", "depth", "bucket", "h").agg(F.count("*").alias("n"))
    filled = copies.withColumn("overflow", F.explode(F.expr("sequence(0L, (n - 1) div cast(greatest(1, floor({m} / greatest(n_bytes, 1))) as bigint))".format(m=max_bytes))))
    again = filled.withColumn("here", F.least(each, F.col("n") - F.col("overflow") * each)).withColumn("_", F.explode(F.expr("sequence(1L, here)")))
    named = again.select("k", "n_bytes", "depth", "bucket", F.concat_ws("-", F.col("n_bytes"), F.col("k").cast("string"), "overflow").alias("lane"), "overflow")
    return _named(settled, key).unionByName(_named(named, key))


def _named(df: DataFrame, key: str) -> DataFrame:
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(bucket), depth, '0')"))
    name = F.concat_ws("-", F.concat(F.lit("s"), bits), *(["lane"] if "lane" in df.columns else []))
    return df.select(F.col("k").alias(key), "n_bytes", "depth", "bucket", "overflow", name.alias("shard"))


def write_shards(df: DataFrame, path: str, max_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text") -> None:
    """The rows of ``df`` (unique keys) with their shards as Parquet, a folder a shard."""
    placed = df.join(shard(df, max_bytes, key, text).select(key, "shard"), key)
    placed.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
