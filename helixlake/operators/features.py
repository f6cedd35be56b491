"""Sparse features and neurons.

Tables: feature_act(protein_id, pos, sae_layer, feature_id, act), sae_decoder(sae_layer, feature_id, vec),
mlp_act(protein_id, pos, layer, neuron, act), gain(layer, neuron, aa, gain), answers(protein_id, pos, aa, direction).
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
from helixlake.functions.kernels import best_of_rows, unit_rows
from helixlake.storage import stored

KEY = ("protein_id", "pos")


def _sorted_join(table: DataFrame) -> DataFrame:
    """For tables with a row per layer and entry: joined by sorting.

    Where such a table is exploded from a smaller one, Spark takes its size for that of the
    smaller one and would send all of it through the driver.
    """
    return table.hint("merge")


def hidden_top_features(feature_act: DataFrame, decoder: DataFrame, answers: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` largest activations per (pos, SAE layer), zeros included, with the direction's part in the answer."""
    w = W.partitionBy(*KEY, "sae_layer").orderBy(F.desc("act"), "feature_id")
    top = feature_act.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    both = top.join(decoder, ["sae_layer", "feature_id"]).join(answers.select(*KEY, "direction"), list(KEY))
    return both.select(*KEY, "sae_layer", "feature_id", "act", V.dot("vec", "direction").alias("answer_dot"), "rank")


def dictionary_parts(decoder: DataFrame, size: int = 1024) -> DataFrame:
    """(sae_layer, part, ids, rows, centre, radius): up to ``size`` unit rows in order of their ids, flattened, within ``radius`` of ``centre``."""
    parts = decoder.groupBy("sae_layer", F.expr(f"cast(feature_id div {size} as int)").alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col("feature_id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))).alias("items"))
    kind = decoder.schema["sae_layer"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows = unit_rows(matrix(batch.column(3), k, len(batch.column(2)[k])))
                centre = rows.mean(0)
                radius = float(np.linalg.norm(rows - centre, axis=1).max())
                one = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (rows.ravel(), centre)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)), *one, pa.array([radius])], ["sae_layer", "part", "ids", "rows", "centre", "radius"])

    flat = parts.select("sae_layer", "part", F.col("items.id").alias("ids"), F.flatten("items.vec").alias("vecs"))
    return flat.mapInArrow(work, f"sae_layer {kind}, part int, ids array<bigint>, rows array<double>, centre array<double>, radius double")


def needed_parts(x: np.ndarray, centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Flags of the parts that can hold one of the ``most`` largest projections of a vector of x.

    All projections on a part lie within |x| * radius of that on its centre.  A part with ``most``
    rows therefore has ``most`` projections above its lower bound; a part whose upper bound
    is below that holds none of the largest.
    """
    middle, reach = x @ centres.T, np.linalg.norm(x, axis=1)[:, None] * radii[None, :]
    slack = 1e-9 * (1 + np.abs(middle) + reach)
    full = sizes >= most
    if not full.any():
        return np.ones(len(radii), bool)
    least = (middle - reach - slack)[:, full].max(1)
    return ((middle + reach + slack) >= least[:, None]).any(0)


def feature_projections(vectors: DataFrame, decoder: DataFrame, keys: tuple[str, ...], most: int = 20, lowest: int = 0, size: int = 1024, block: int = 512) -> DataFrame:
    """Signed projections of vectors on all unit decoder rows of their layer: the ``most`` largest and ``lowest`` smallest, ties by feature_id.

    ``vectors`` has the keys, sae_layer and vec; vectors without a dictionary for their layer drop out.
    Blocks of vectors meet parts of the dictionary: a block is sent once to each part that its
    bounds can't rule out, one product a pair, and the best of each part are ranked again.
    So no task holds a whole dictionary, and no vector or dictionary row travels by itself.
    """
    parts = stored(dictionary_parts(decoder, size), "parts")
    bounds = parts.groupBy("sae_layer").agg(F.sort_array(F.collect_list(F.struct("part", "centre", "radius", F.size("ids").alias("size")))).alias("bounds"))  # a row per layer, one vector a part
    blocks = vector_blocks(vectors, "sae_layer", keys, block).join(bounds, "sae_layer")
    names = ["sae_layer", "n", *keys, "vecs"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = []
            for k, b in enumerate(batch.column(len(names)).to_pylist()):
                x = matrix(batch.column(len(names) - 1), k, batch.column(1)[k].as_py())
                of = lambda f, b=b: np.array([p[f] for p in b])
                flags = np.zeros(len(b), bool)
                for sign, n in ((1, most), (-1, lowest)):
                    if n:
                        flags |= needed_parts(sign * x, of("centre"), of("radius"), of("size"), n)
                wanted.append(of("part")[flags].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(names))), pa.array(wanted, pa.list_(pa.int32()))], [*names, "wanted"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x, ids = matrix(batch.column(len(names) - 1), k, batch.column(1)[k].as_py()), batch.column(len(names))[k].values
                scores = x @ matrix(batch.column(len(names) + 1), k, len(ids)).T
                for sign, n in ((1, most), (-1, lowest)):
                    if n:
                        r, c = best_of_rows(sign * scores, n)
                        layer = pa.array([batch.column(0)[k].as_py()] * len(r), batch.column(0).type)
                        at = pa.array(r)
                        yield pa.RecordBatch.from_arrays([*(batch.column(i + 2)[k].values.take(at) for i in range(len(keys))), layer, ids.take(pa.array(c)), pa.array(scores[r, c]), pa.array(np.full(len(r), sign, np.int32))], [*keys, "sae_layer", "feature_id", "projection", "side"])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    chosen = blocks.mapInArrow(choose, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", wanted array<int>")
    pairs = chosen.select(*names, F.explode("wanted").alias("part")).join(parts, ["sae_layer", "part"]).select(*names, "ids", "rows")
    own = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    found = pairs.mapInArrow(work, ", ".join(f"`{k}` {own[k]}" for k in (*keys, "sae_layer")) + ", feature_id long, projection double, side int")
    w = W.partitionBy(*keys, "sae_layer", "side").orderBy(F.col("side") * F.col("projection") * -1, "feature_id")
    limit = F.when(F.col("side") == 1, most).otherwise(lowest)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def head_features(head_out: DataFrame, scored: DataFrame, decoder: DataFrame, least: float = 0.3) -> DataFrame:
    """Top 10 and lowest 5 features of heads with |projection| >= ``least`` at layers with a dictionary (model layer + 1)."""
    heads = head_out.join(scored.filter(F.abs("projection") >= least).select(*KEY, "layer", "head"), [*KEY, "layer", "head"], "left_semi")
    return feature_projections(heads.withColumn("sae_layer", F.col("layer") + 1), decoder, (*KEY, "layer", "head"), most=10, lowest=5)


def feature_summary(lists: DataFrame, labels: DataFrame, each: int = 8, most: int = 8) -> DataFrame:
    """Per (pos, layer) the ``most`` features of the first ``each`` of both sources by |proj|, once each, with labels.

    ``lists``: protein_id, pos, layer, source ('attn' or 'mlp'), feature_id, proj.
    """
    w = W.partitionBy(*KEY, "layer", "source").orderBy(F.desc(F.abs("proj")), "feature_id")
    best = lists.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= each)
    once = W.partitionBy(*KEY, "layer", "feature_id").orderBy(F.desc(F.abs("proj")), "source")
    order = W.partitionBy(*KEY, "layer").orderBy(F.desc(F.abs("proj")), "source", "feature_id")
    kept = best.withColumn("_d", F.row_number().over(once)).filter("_d = 1").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    ref = F.concat(F.lit("F"), F.col("layer").cast("string"), F.lit(":"), F.col("feature_id").cast("string"))
    return kept.withColumn("ref", ref).drop("_n", "_d").join(_sorted_join(labels), ["layer", "feature_id"], "left")


def patch_hidden_features(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Puts hidden_state_top_features into sae_features, a map by layer; layers that lack are made, other keys stay.

    ``records`` (protein_id, position, sae_features map<string, struct<hidden_state_top_features, attn_top_features, mlp_top_features>>),
    ``fresh`` (protein_id, position, layer string, features).
    """
    old = records.select("protein_id", "position", F.explode_outer("sae_features").alias("layer", "v")).filter("layer IS NOT NULL")
    both = old.join(fresh, ["protein_id", "position", "layer"], "full")
    kind = records.schema["sae_features"].dataType.valueType
    fields = [F.coalesce("features", "v.hidden_state_top_features").alias("hidden_state_top_features")] + [F.col(f"v.{f.name}").alias(f.name) for f in kind.fields if f.name != "hidden_state_top_features"]
    merged = both.groupBy("protein_id", "position").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer", F.struct(*fields).alias("value"))))).alias("_map"))
    out = records.join(merged, ["protein_id", "position"], "left")
    return out.withColumn("sae_features", F.coalesce("_map", "sae_features")).select(*records.columns)


def neuron_push(mlp_act: DataFrame, gain: DataFrame, answers: DataFrame) -> DataFrame:
    """contribution = activation x gain towards the position's letter, per neuron."""
    return mlp_act.join(answers.select(*KEY, "aa"), list(KEY)).join(_sorted_join(gain), ["layer", "neuron", "aa"]).select(*KEY, "layer", "neuron", "act", (F.col("act") * F.col("gain")).alias("contribution"))


def neuron_census(pushed: DataFrame) -> DataFrame:
    return pushed.groupBy(*KEY, "layer").agg(F.count(F.when(F.col("act") > 0, 1)).alias("n_active"), F.sum(F.when(F.col("act") != 0, F.col("contribution")).otherwise(0.0)).alias("total_answer_proj"))


def top_neurons(pushed: DataFrame, first: int = 20, most: int = 10) -> DataFrame:
    """Writers and erasers: the ``first`` highest and lowest of all neurons, inactive ones dropped, the ``most`` left."""
    out = None
    for kind, order in (("writer", F.desc("contribution")), ("eraser", F.asc("contribution"))):
        w = W.partitionBy(*KEY, "layer").orderBy(order, "neuron")
        part = pushed.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= first) & (F.col("act") != 0))
        part = part.withColumn("rank", F.row_number().over(W.partitionBy(*KEY, "layer").orderBy("_n"))).filter(F.col("rank") <= most).drop("_n").withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def neuron_letters(top: DataFrame, gain: DataFrame, most: int = 5) -> DataFrame:
    """The letters that a listed neuron pushes most; ties by letter."""
    both = top.join(_sorted_join(gain), ["layer", "neuron"]).withColumn("letter_push", F.col("act") * F.col("gain"))
    w = W.partitionBy(*KEY, "layer", "kind", "neuron").orderBy(F.desc("letter_push"), "aa")
    return both.withColumn("letter_rank", F.row_number().over(w)).filter(F.col("letter_rank") <= most)


def neuron_summary(letters: DataFrame, neurons: int = 3, votes: int = 3, first_layer: int = 10) -> DataFrame:
    """Evidence: the first writers and erasers with references and their first letters, from ``first_layer`` on."""
    kept = letters.filter((F.col("rank") <= neurons) & (F.col("letter_rank") <= votes) & (F.col("layer") >= first_layer))
    ref = F.concat(F.lit("N"), F.col("layer").cast("string"), F.lit(":"), F.col("neuron").cast("string"))
    per = kept.groupBy(*KEY, "layer", "kind", "rank", "neuron").agg(F.transform(F.sort_array(F.collect_list(F.struct("letter_rank", "aa"))), lambda s: s["aa"]).alias("votes"))
    return per.withColumn("ref", ref)
