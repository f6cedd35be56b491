"""Dropping lines that many documents share.

A text is split once: its rows are stored with a number and the hashes of their normalised
lines, in order.  The hashes are exploded, a document counting once for each, and the
counts are combined before the shuffle, so that a line of a third of all documents is one
row per task.  The common hashes are stored, which leaves Spark free to split a hot one's
rows when they look it up.  Only positions of dropped lines travel back; the texts are put
together again from the kept positions, in order.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.common import BLANK, stored, table, text_or_empty

def folded(text: Column) -> Column:
    """One to one with the text with A-Z lower-cased, and equal for texts that differ in the case of A-Z alone.

    The bytes of the UTF-8 are read as Latin-1 and put in lower case.  Besides A-Z that moves
    the first bytes C0-DE of two-byte characters by 32, to those of longer ones; the number
    of bytes that follow still tells them apart.
    """
    return F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))


def line_hashes(text: Column) -> Column:
    """Of each line in order 128 bits of its key, as hexadecimal digits; null for an empty key, which is never dropped.

    The key is the line without BLANK at either end, A-Z lower-cased; its folded form is hashed.
    """
    keys = F.transform(F.split(folded(text), "\n"), lambda line: F.btrim(line, F.lit(BLANK)))
    return F.transform(keys, lambda key: F.when(F.length(key) >= 1, F.md5(key)))


def common_lines(hashed: DataFrame, min_docs: int = 10) -> DataFrame:
    """Hashes that stand in the array ``hashes`` of at least ``min_docs`` rows: (hash, n_docs)."""
    lines = hashed.select(F.explode(F.array_distinct("hashes")).alias("hash")).filter(F.col("hash").isNotNull())
    return lines.groupBy("hash").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def drop_common_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10) -> DataFrame:
    """Adds n_lines (before), n_dropped and kept_text to ``docs``, in place of columns of these names.

    Every row is a document of its own, known by a stored number, whatever its ``doc_id``,
    so ids may be null or stand at several rows.  A null or empty text is one empty line, and
    lines that are blank stay.  Repeated lines of one document count once.  Other columns
    stay, whatever their names.  No rows in, no rows out.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    t = text_or_empty(text)
    rows = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"), line_hashes(t).alias("hashes")), "rows")
    common = stored(common_lines(rows, min_docs).select("hash"), "common")
    lines = rows.select("row", F.posexplode("hashes").alias("pos", "hash")).filter(F.col("hash").isNotNull())
    drop = lines.join(common.hint("merge"), "hash").groupBy("row").agg(F.collect_list("pos").alias("drop"))
    t = F.coalesce(F.col("doc")[text], F.lit(""))
    both = rows.select("doc", "row").join(drop, "row", "left").withColumn("lines", F.split(t, "\n"))
    keep = F.expr("array_except(sequence(0, size(lines) - 1), drop)")
    kept = F.when(F.col("drop").isNull(), t).otherwise(F.array_join(F.transform(keep, lambda i: F.get(F.col("lines"), i)), "\n"))
    dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long")
    out = both.select("doc", F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept_text"))
    return out.select(*[F.col("doc")[c].alias(c) for c in columns], "n_lines", "n_dropped", "kept_text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE = {
    "op7_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
             k AS (SELECT doc_id, pos, line, translate(trim(line, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(c.key) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id"""
}
