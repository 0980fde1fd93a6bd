"""Sharding by extendible hashing (operator 5), in DataFrame functions only.

Every row has a bit string: 32 bits of md5 of its id, then 32 bits of md5 of the
id and a row number fixed when the rows are staged, so that repeated ids part as
well.  The directory starts as one bucket; a bucket over the byte limit splits
on its next bit, the others stay.  Splits are found LEVEL bits at a time: one
map-side combined aggregation sums the bytes of each open bucket's children at
LEVEL further bits, and their sums give every bucket between.  Only rows of
buckets that are still too large go to the next round, so all rounds together
read little more than the rows once.

Cases: a null text has 0 bytes; a null id hashes as the empty text; an empty
table gives no rows; other columns are not read; a single row above the limit ends alone in a shard, marked
`oversize` (it can't be split without cutting a text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

LIMIT_BYTES = 1 << 20
BITS = 64
LEVEL = 16


def _bits(df: DataFrame, id_col: str) -> DataFrame:
    """64 characters 0 or 1 a row."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    binary = lambda c: F.lpad(F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 2), 32, "0")
    return df.withColumn("_bits", F.concat(binary(key), binary(F.concat_ws("#", key, F.col("_row").cast("string")))))


def directory(rows: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(prefix, depth, bytes, n_docs) of the final buckets, from staged rows
    with _bits and _bytes."""
    done = None
    open_rows = rows.select("_bits", "_bytes")
    for base in range(0, BITS, LEVEL):
        top = base + LEVEL
        cells = open_rows.groupBy(F.substring("_bits", 1, top).alias("cell")).agg(
            F.sum("_bytes").alias("bytes"), F.count("*").alias("n_docs"))
        # every bucket from `base` (at the start only) to `top` bits that holds the cell
        depths = F.sequence(F.lit(base if base == 0 else base + 1), F.lit(top))
        buckets = (cells.withColumn("depth", F.explode(depths))
                   .withColumn("prefix", F.expr("substring(cell, 1, depth)"))
                   .groupBy("prefix", "depth").agg(F.sum("bytes").alias("bytes"), F.sum("n_docs").alias("n_docs")))
        buckets = stage(buckets)
        # a bucket ends the splitting if it fits and the one above it didn't
        small = buckets.where((F.col("bytes") <= limit) | (F.col("n_docs") == 1) | F.lit(top == BITS) & (F.col("depth") == top))
        above = buckets.where((F.col("bytes") > limit) & (F.col("n_docs") > 1)).select(
            F.col("prefix").alias("up"), (F.col("depth") + 1).alias("depth"))
        first = small.withColumn("up", F.expr("substring(prefix, 1, depth - 1)"))
        leaves = first.where(F.col("depth") == (0 if base == 0 else base + 1)).drop("up")
        lower = first.where(F.col("depth") > (0 if base == 0 else base + 1)).join(above, ["up", "depth"], "left_semi")
        leaves = leaves.unionByName(lower.drop("up"))
        done = leaves if done is None else done.unionByName(leaves)
        if top == BITS:
            break
        large = buckets.where((F.col("depth") == top) & (F.col("bytes") > limit) & (F.col("n_docs") > 1))
        if large.isEmpty():
            break
        open_rows = open_rows.join(large.select(F.col("prefix").alias("_p")),
                                   F.substring("_bits", 1, top) == F.col("_p"), "left_semi")
    return stage(done)


def shard_documents(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, oversize): shard is the bit
    prefix of the row's bucket ("" for the undivided directory)."""
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("_bytes"),
                       F.monotonically_increasing_id().alias("_row"))
    rows = stage(_bits(rows, "doc_id").drop("_row"))
    leaves = directory(rows, limit)
    # exactly one leaf is a prefix of a row's bits; leaves have at most BITS + 1 depths
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())
    tried = F.array(*[F.expr(f"substring(_bits, 1, {d})") for d in depths]) if depths else F.array(F.lit(""))
    return (rows.withColumn("_prefix", F.explode(tried)).join(leaves.withColumnRenamed("prefix", "_prefix"), "_prefix")
            .select("doc_id", F.col("_bytes").alias("bytes"), F.col("_prefix").alias("shard"), F.col("depth").cast("int").alias("depth"),
                    F.col("bytes").cast("long").alias("shard_bytes"), (F.col("bytes") > limit).alias("oversize")))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """One folder of Parquet files for every shard; ids must be unique here."""
    home = shard_documents(docs, limit, id_col, text_col).select(F.col("doc_id").alias(id_col), "shard")
    docs.join(home, id_col).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def op5_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH bits AS (
  SELECT doc_id, CAST(COALESCE(strlen(text), 0) AS BIGINT) AS bytes,
         lpad(bin(CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)), 32, '0') AS b
  FROM documents),
sums AS (
  SELECT d.depth, substr(b, 1, d.depth) AS prefix, SUM(bytes) AS shard_bytes, COUNT(*) AS n
  FROM bits, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 33)) d GROUP BY 1, 2),
small AS (SELECT * FROM sums WHERE shard_bytes <= {LIMIT_BYTES} OR n = 1),
first AS (
  SELECT doc_id, MIN(depth) AS depth FROM bits JOIN small ON substr(b, 1, depth) = prefix GROUP BY doc_id)
SELECT bits.doc_id, bytes, prefix AS shard, small.depth, CAST(shard_bytes AS BIGINT) AS shard_bytes,
       shard_bytes > {LIMIT_BYTES} AS oversize
FROM bits JOIN first USING (doc_id) JOIN small ON small.depth = first.depth AND prefix = substr(b, 1, first.depth)
"""
