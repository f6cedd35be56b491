"""Attention heads: outputs, categories of sources, classes, writing events.

Tables: attention(protein_id, pos, layer, head, src, weight), values(protein_id, pos, layer, head, token, vec),
head_out(protein_id, pos, layer, head, vec), edges(protein_id, kind, pos, partner) with kinds
'structural' and 'coevolving'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixlake.functions import vectors as V
from helixlake.functions.blocks import matrix, vector_blocks

KEY = ("protein_id", "pos")
HEAD = (*KEY, "layer", "head")


def head_outputs(attention: DataFrame, values: DataFrame, weights: DataFrame, block: int = 512) -> DataFrame:
    """(sum of weighted values) times the head's block of the output weights, plus its share of the bias.

    ``attention`` has the masked row over all tokens (token, weight); ``weights`` has a row per
    (layer, head): rows (head_dim arrays of the output dimension) and bias_share.  Weighted
    values are summed in the JVM, so a group never gathers its tokens in Python.  The sums
    of a (layer, head) are packed into blocks where they lie; a block meets its weights once and
    is one product, and a head that holds most rows has as many blocks as it needs.
    """
    unit = lambda df: df.withColumn("unit", F.col("layer").cast("long") * (1 << 20) + F.col("head"))
    mixed = attention.join(values, [*HEAD, "token"]).select(*HEAD, F.posexplode("vec").alias("dim", "x"), "weight")
    mixed = mixed.groupBy(*HEAD, "dim").agg(F.sum(F.col("x").cast("double") * F.col("weight")).alias("x"))
    sums = mixed.groupBy(*HEAD).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))
    flat = unit(weights).select("unit", F.flatten("rows").cast("array<double>").alias("w"), F.col("bias_share").cast("array<double>").alias("b"))
    pairs = vector_blocks(unit(sums), "unit", HEAD, block).join(flat, "unit").select("n", *HEAD, "vecs", "w", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x = matrix(batch.column(5), k, batch.column(0)[k].as_py())
                out = x @ matrix(batch.column(6), k, x.shape[1]) + matrix(batch.column(7), k, 1)
                ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[k].values for c in range(1, 5)), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [*HEAD, "vec"])

    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    return pairs.mapInArrow(work, ", ".join(f"{k} {kinds[k]}" for k in HEAD) + ", vec array<double>")


def head_projections(head_out: DataFrame, answers: DataFrame) -> DataFrame:
    return head_out.join(answers.select(*KEY, "direction"), list(KEY)).select(*HEAD, V.dot("vec", "direction").alias("projection"))


def labelled_attention(attention: DataFrame, edges: DataFrame, reach: int = 5) -> DataFrame:
    """Adds structural, coevolving, local (0 or 1); a source may be of several kinds."""
    kinds = edges.groupBy("protein_id", "pos", F.col("partner").alias("src")).agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("structural", "coevolving")])
    both = attention.join(kinds, [*KEY, "src"], "left").fillna(0, ["structural", "coevolving"])
    return both.withColumn("local", F.abs(F.col("src") - F.col("pos")).between(1, reach).cast("int"))


def attention_by_category(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(*HEAD).agg(*[F.sum(F.col("weight") * F.col(k)).alias(f"attn_{k}") for k in ("structural", "coevolving", "local")])


def source_importance(attention: DataFrame, scored: DataFrame, least: float = 0.1) -> DataFrame:
    """Per source the sums of |projection| x weight over heads above ``least``; all, structural and coevolving heads."""
    both = attention.join(scored.filter(F.abs("projection") > least), list(HEAD))
    part = F.abs("projection") * F.col("weight")
    when = lambda k: F.sum(F.when(F.col(f"attn_{k}") > 0.1, part).otherwise(0.0)).alias(k)
    return both.groupBy(*KEY, "src").agg(F.sum(part).alias("total"), when("structural"), when("coevolving"))


def top_sources(labelled: DataFrame, scored: DataFrame, proteins: DataFrame, least: float = 0.3, most: int = 8, weight: float = 0.01) -> DataFrame:
    """Of heads with |projection| >= ``least`` the ``most`` heaviest sources, those below ``weight`` dropped, with letter and labels."""
    w = W.partitionBy(*HEAD).orderBy(F.desc("weight"), "src")
    heads = scored.filter(F.abs("projection") >= least).select(*HEAD)
    top = labelled.join(heads, list(HEAD)).withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= most) & (F.col("weight") >= weight))
    labels = F.filter(F.array(*[F.when(F.col(k) == 1, k) for k in ("structural", "coevolving", "local")]), lambda x: x.isNotNull())
    return top.join(proteins.select("protein_id", "sequence"), "protein_id").select(*HEAD, "src", "weight", F.expr("substr(sequence, src + 1, 1)").alias("aa"), labels.alias("labels"), "rank")


def classify_heads(scored: DataFrame, least: float = 0.3) -> DataFrame:
    """Heads with |projection| >= ``least`` and their class; at exactly +-``least`` it is 'other'."""
    c, s, n = F.col("attn_coevolving") > 0.10, F.col("attn_structural") > 0.10, F.col("attn_local") > 0.15
    out = None
    for verb, sign in (("writes", F.col("projection") > least), ("erases", F.col("projection") < -least)):
        for what, flag in (("coevolving", c), ("structural", s & ~c), ("local", n & ~s & ~c), ("no_clear_source", ~n & ~s & ~c)):
            out = F.when(sign & flag, f"{verb}_{what}") if out is None else out.when(sign & flag, f"{verb}_{what}")
    return scored.filter(F.abs("projection") >= least).withColumn("type", out.otherwise("other"))


def writing_events(classified: DataFrame, most: int = 30) -> DataFrame:
    """The ``most`` heads with the largest |projection| per position; ties by layer, head."""
    w = W.partitionBy(*KEY).orderBy(F.desc(F.abs("projection")), "layer", "head")
    return classified.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
