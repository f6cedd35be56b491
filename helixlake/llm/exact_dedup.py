"""Exact deduplication with an extendible-hash index on shared files.

A directory over the top bits of the texts' 64-bit hashes is doubled, level by level,
until each bucket holds at most ``capacity`` hash values; each bucket is one range of hash
values.  Texts find their bucket by the directory and are grouped by bucket, hash *and*
bytes, so that the many copies of a hot text are combined before the shuffle and texts
whose hashes collide stay apart: that grouping compares the bytes and decides which texts are
equal.  Owner tasks take whole buckets, number the entries that chain on one hash value,
and write them to files that all executors share.  Documents then look up their entry
by bucket (from the directory), hash and the digest of their text, which tells the
entries of a chain apart; the chain's numbers are there for other readers of the index.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixlake.llm.common import discard, stored, table, text_or_empty


def directory(entries: DataFrame, capacity: int, depth: int) -> DataFrame:
    """The directory: for each cell of the deepest level, its bucket and local depth.

    ``entries`` needs ``hash``.  A bucket is the shallowest prefix of the hash that holds
    at most ``capacity`` entries; at ``depth`` it stays overfull.  The result has at
    most ``2 ** depth`` rows: (cell, bucket, local_depth).
    """
    cells = entries.groupBy(F.shiftrightunsigned("hash", 64 - depth).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - depth)"))
    filled = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    fits = levels.drop("n").join(filled, ["depth", "prefix"]).filter((F.col("n") <= capacity) | (F.col("depth") == depth))
    chosen = fits.groupBy("cell").agg(F.min("depth").alias("local_depth"))
    low = F.expr(f"shiftleft(shiftrightunsigned(cell, {depth} - local_depth), {depth} - local_depth)")
    return chosen.select("cell", low.alias("bucket"), "local_depth")


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 4096) -> tuple[DataFrame, DataFrame, int]:
    """Writes the index of all distinct texts; returns it, the directory and the directory's depth.

    Columns: bucket, local_depth, hash, chain (place among the entries of one hash
    value), text_sha256, keep_id (largest id), group_size, n_bytes.  A null text counts
    as empty.  Every row counts, repeated rows too.  Above 2 ** 26 hash values buckets grow
    with their number instead of the directory, so that this has 2 ** 17 rows at most.
    """
    texts = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("t")).withColumn("hash", F.xxhash64("t"))
    hashes = stored(texts.groupBy("hash").agg(F.count("*").alias("n_rows")), "hashes")
    n = max(1, hashes.count())
    capacity = max(capacity, n >> 14)
    depth = max(1, (n // capacity).bit_length() + 2)
    where = stored(directory(hashes, capacity, depth), "directory")
    dealt = in_bucket(texts, where, depth)
    distinct = dealt.groupBy("bucket", "local_depth", "hash", "t").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = distinct.select("bucket", "local_depth", "hash", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size", F.octet_length("t").cast("long").alias("n_bytes")).repartition("bucket")
    chained = entries.withColumn("chain", F.row_number().over(W.partitionBy("bucket", "hash").orderBy("text_sha256")))
    index = stored(chained.select("bucket", "local_depth", "hash", "chain", "text_sha256", "keep_id", "group_size", "n_bytes"), "index")
    discard(hashes)
    return index, where, depth


def in_bucket(rows: DataFrame, where: DataFrame, depth: int) -> DataFrame:
    """Adds bucket and local_depth to rows with ``hash``, by the directory (2 ** 17 rows at most, so it is broadcast)."""
    return rows.withColumn("_cell", F.shiftrightunsigned("hash", 64 - depth)).join(F.broadcast(where.withColumnRenamed("cell", "_cell")), "_cell").drop("_cell")


def _looked_up(docs: DataFrame, text: str, doc_id: str, capacity: int, *more: str) -> DataFrame:
    """The rows of ``exact_duplicates``, with the columns ``more`` of their documents."""
    index, where, depth = build_index(docs, text, doc_id, capacity)
    t = text_or_empty(text)
    probes = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("hash"), F.sha2(t, 256).alias("text_sha256"), *more)
    found = in_bucket(probes, where, depth).drop("local_depth").join(index.select("bucket", "hash", "text_sha256", "keep_id", "group_size").hint("merge"), ["bucket", "hash", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *more)


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest id stays.  Null texts count as
    empty; a null id is never larger than another; rows that repeat an id and a text
    are kept or dropped together.  No rows in, no rows out; further columns are ignored.
    """
    return _looked_up(docs, text, doc_id, capacity)


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 4096) -> DataFrame:
    """One row of each text, with all its columns: of the largest id, and of several rows with that any one.

    Rows are known by a stored number, so ids may be null or stand at several texts.
    """
    rows = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    texts = rows.select(F.col("doc")[doc_id].alias("id"), F.col("doc")[text].alias("text"), "row")
    kept = _looked_up(texts, "text", "id", capacity, "row").filter("kept")
    stay = kept.groupBy("text_sha256").agg(F.max("row").alias("row"))
    return rows.join(stay.select("row").hint("merge"), "row", "left_semi").select("doc.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
               CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
}
