"""What the operators share: reading tables, shared folders, small column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the control characters 9 to 13.
BLANK = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by whatever path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only in a local session without it (as
    in tests) a temporary folder is made and set; elsewhere its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again; cuts the lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more; where that fails, they stay."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if name.startswith(shared_root(spark).replace("file:///", "file:/")) or name.startswith(shared_root(spark)):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_cached: dict[str, Callable[[], None]] = {}


def keep_cache(owner: str, clear: Callable[[], None]) -> None:
    """Called by a task that uses a worker's cache: what other operators have cached in the worker is cleared, so that caches don't add up."""
    others = [name for name in _cached if name != owner]
    for name in others:
        _cached.pop(name)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    _cached[owner] = clear


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about ``most`` bytes of text in ``column``, so that no more are held as Python objects."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)) // most
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(batch)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end > begin:
                yield batch.slice(begin, end - begin)


def unique_ids(docs: DataFrame, doc_id: str) -> bool:
    """Whether each row has an id of its own."""
    return docs.groupBy(F.col(doc_id).alias("i")).count().filter("count > 1 OR i IS NULL").limit(1).count() == 0


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(c: Column) -> Column:
    """Number of maximal runs of characters other than BLANK; null counts as none.

    Runs are cut down to one mark each, so no array of words is built.
    """
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^ \t-\r]+", "\x00"), r"[ \t-\r]+", "")).cast("long")


def running_start(df: DataFrame, groups: list[str], order: list[Column], size: str, out: str, spread: Column | None = None, rows: int = 50_000) -> DataFrame:
    """Adds the sum of ``size`` over all earlier rows of the same group, as ``out``.

    A group may hold most rows, so it is dealt over cells of about ``rows`` rows by a
    hash: cells are summed (with map-side combining), the sums of earlier cells are
    accumulated over the few cells of a group, and the rest is a window inside a cell.
    The order within a group is by cell, then by ``order``: fixed, but not sorted overall.
    """
    from pyspark.sql import Window as W

    total = df.count()
    cells = max(1, -(-total // rows))
    cut = df.withColumn("_cell", F.pmod(F.xxhash64(*([spread] if spread is not None else order)), F.lit(cells)).cast("int"))
    by_cell = cut.groupBy(*groups, "_cell").agg(F.sum(size).alias("_n"))
    before = W.partitionBy(*groups).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    bases = by_cell.select(*groups, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*groups, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    here = cut.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    match = [here[g].eqNullSafe(bases[g]) for g in groups] + [here["_cell"] == bases["_cell"]]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return here.join(bases, on).select(*[here[c] for c in df.columns], (F.col("_in") + F.col("_base")).cast("long").alias(out))


def matching(rows: DataFrame, key: str, ids: DataFrame, id_: str, more: tuple[str, ...] = (), bits: int = 1 << 22) -> DataFrame:
    """The rows whose ``key`` is among the distinct, stored ``ids``, with the columns ``more`` of these.

    A bitmap of hashed ids, of fixed size (64 K words of 64 bits, broadcast), first leaves out
    most rows without a match, so that not all texts are shuffled; the join behind it is exact.
    It is a merge join at every size.
    """
    place = f"pmod(xxhash64({{}}), {bits})"
    bit = "shiftleft(1L, cast({} % 64 as int))"
    hashed = ids.selectExpr(f"cast({id_} as long) AS _k").selectExpr(f"{place.format('_k')} AS _h")
    words = hashed.selectExpr("cast(_h div 64 as int) AS _word", f"{bit.format('_h')} AS _bit").groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_h", F.expr(place.format(f"cast({key} as long)"))).withColumn("_word", F.expr("cast(_h div 64 as int)"))
    likely = marked.join(F.broadcast(words), "_word").filter(f"(_bits & {bit.format('_h')}) != 0").select(*rows.columns)
    # An inner join: a semi join would be moved below the bitmap.
    return likely.join(ids.select(F.col(id_).alias("_match"), *more).hint("merge"), F.col(key) == F.col("_match")).drop("_match")
