"""Groups of heads that write into nearly orthogonal directions, within and across positions.

groupings(protein_id, pos, layer, isolated, main, inter_cos, iso_mag, main_mag) has one row per
detection; cores(protein_id, layer, core, consistency).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.functions import kernels
from helixlake.functions.blocks import stacked, whole_series

KEY = ("protein_id", "pos", "layer")


def _per_layer(head_out: DataFrame, work: Callable[[np.ndarray, np.ndarray], list[tuple]], fields: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Runs ``work(heads, vectors, extra values)`` on every (protein_id, pos, layer), many groups a call."""
    grouped = head_out.groupBy(*KEY, *extra).agg(F.sort_array(F.collect_list(F.struct("head", "vec"))).alias("rows"))
    rows = grouped.select(*KEY, *extra, F.transform("rows", lambda r: r["head"]).alias("heads"), F.transform("rows", lambda r: r["vec"]).alias("vecs"))
    names = [*KEY, *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                r = row._asdict()
                out += [(*(r[k] for k in KEY), *x) for x in work(np.asarray(r["heads"]), np.stack(r["vecs"]).astype(float), *[r[k] for k in extra])]
            yield pd.DataFrame(out, columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", " + fields)


def centroid_cosines(head_out: DataFrame) -> DataFrame:
    """head, magnitude, centroid_cosine; layers without a head of 0.01 are left out."""

    def work(heads: np.ndarray, vectors: np.ndarray) -> list[tuple]:
        found = kernels.anchor_split(vectors)
        return [] if found is None else [(int(h), float(s), float(c)) for h, s, c in zip(heads, found[0], found[1], strict=True)]

    return _per_layer(head_out, work, "head int, magnitude double, centroid_cosine double")


def isolated_heads(head_out: DataFrame) -> DataFrame:
    """anchor, isolated, main, inter_cos, iso_mag, main_mag of the layers with an isolated head."""

    def work(heads: np.ndarray, vectors: np.ndarray) -> list[tuple]:
        found = kernels.anchor_split(vectors)
        if found is None or found[2] is None:
            return []
        anchor, a, b, cos, nx, ny = found[2]
        return [(int(heads[anchor]), heads[a].tolist(), heads[b].tolist(), cos, nx, ny)]

    return _per_layer(head_out, work, "anchor int, isolated array<int>, main array<int>, inter_cos double, iso_mag double, main_mag double")


def cross_layer_profiles(cosines: DataFrame, below: float = 0.2) -> DataFrame:
    """Per head its cosines by layer, where the smallest is below the limit."""
    per = cosines.groupBy("protein_id", "pos", "head").agg(F.sort_array(F.collect_list(F.struct("layer", "centroid_cosine"))).alias("series"), F.min("centroid_cosine").alias("lowest"))
    return per.filter(F.col("lowest") < below)


def cluster_heads(head_out: DataFrame, limit: float = 0.15, least: float = 1.0) -> DataFrame:
    """Groupings: layers whose heads fall into two nearly orthogonal groups of at least length ``least``; the layers of a batch with equally many heads are split together."""
    keys = list(KEY)
    kinds = {f.name: f.dataType.simpleString() for f in head_out.schema.fields}
    rows = whole_series(head_out, KEY, "head", "vec").select(*keys, "head", "n", "vecs")
    names = [*keys, "isolated", "main", "inter_cos", "iso_mag", "main_mag"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in stacked(batch.column(4).to_numpy(zero_copy_only=False), batch.column(5)):
                found = [(int(k), f) for k, f in zip(at, kernels.split_heads(x, limit, least=least), strict=True) if f is not None]
                heads = [np.asarray(batch.column(3)[k].as_py()) for k, _ in found]
                sides = [pa.array([h[f[s]].tolist() for h, (_, f) in zip(heads, found, strict=True)], pa.list_(pa.int32())) for s in (0, 1)]
                numbers = [pa.array([f[s] for _, f in found], pa.float64()) for s in (2, 3, 4)]
                mine = batch.take(pa.array([k for k, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in range(3)), *sides, *numbers], names)

    return rows.mapInArrow(work, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", isolated array<int>, main array<int>, inter_cos double, iso_mag double, main_mag double")


def detection_rates(groupings: DataFrame, analysed: DataFrame, least: float = 0.30) -> DataFrame:
    """Layers split at ``least`` of the positions of ``analysed`` (protein_id, pos) or more."""
    n = analysed.groupBy("protein_id").agg(F.countDistinct("pos").alias("n_positions"))
    per = groupings.groupBy("protein_id", "layer").agg(F.countDistinct("pos").alias("detections")).join(n, "protein_id")
    return per.withColumn("rate", F.col("detections") / F.col("n_positions")).filter(F.col("rate") >= least)


def assignments(groupings: DataFrame) -> DataFrame:
    """(protein_id, pos, layer, head, side) in long form."""
    side = lambda c, v: groupings.select(*KEY, F.explode(c).alias("head"), F.lit(v).alias("side"))
    return side("isolated", 1).unionByName(side("main", 0))


def co_clustering(assigned: DataFrame) -> DataFrame:
    """Per (protein_id, layer, head_i, head_j): times both assigned, share of these in the same group."""
    x = assigned.select(*KEY, F.col("head").alias("head_i"), F.col("side").alias("side_i"))
    y = assigned.select(*KEY, F.col("head").alias("head_j"), F.col("side").alias("side_j"))
    both = x.join(y, list(KEY))
    return both.groupBy("protein_id", "layer", "head_i", "head_j").agg(F.count("*").alias("n"), F.avg((F.col("side_i") == F.col("side_j")).cast("double")).alias("frequency"))


def consistent_cores(groupings: DataFrame, least: float = 0.20, detections: int = 3) -> DataFrame:
    """(protein_id, layer, core, consistency) of the layers with a set of heads that stays together.

    Equal groupings of a layer are counted before the shuffle, so a layer sends its different
    groupings with their numbers, not its positions; the search works on these, many layers a call.
    """
    kinds = {f.name: f.dataType.simpleString() for f in groupings.schema.fields}
    key = ("protein_id", "layer")
    sides = [F.sort_array(F.col(c).cast("array<int>")).alias(c) for c in ("isolated", "main")]
    counted = groupings.select(*key, *sides).groupBy(*key, "isolated", "main").agg(F.count("*").alias("n"))
    rows = counted.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("isolated", "main", "n"))).alias("g"))
    rows = rows.select(*key, F.col("g.isolated").alias("isolated"), F.col("g.main").alias("main"), F.col("g.n").alias("n"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, (a, b, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                core = kernels.consistent_core(list(zip(a, b, strict=True)), least, detections, n)
                found += [] if core is None else [(k, *core)]
            mine = batch.take(pa.array([k for k, _, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), pa.array([c for _, c, _ in found], pa.list_(pa.int32())), pa.array([s for _, _, s in found], pa.float64())], [*key, "core", "consistency"])

    return rows.mapInArrow(work, f"protein_id {kinds['protein_id']}, layer {kinds['layer']}, core array<int>, consistency double")


def group_consistency(groupings: DataFrame, cores: DataFrame) -> DataFrame:
    """Share of a layer's detections of which one group holds the whole core."""
    held = lambda side: F.size(F.array_except("core", side)) == 0
    both = groupings.join(cores.select("protein_id", "layer", "core"), ["protein_id", "layer"])
    return both.groupBy("protein_id", "layer").agg(F.avg((held("isolated") | held("main")).cast("double")).alias("consistency"))


def core_statistics(groupings: DataFrame, cores: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and number of the cosines where one group holds the core."""
    held = lambda side: F.size(F.array_except("core", side)) == 0
    both = groupings.join(cores.select("protein_id", "layer", "core"), ["protein_id", "layer"]).filter(held("isolated") | held("main"))
    c = "inter_cos"
    return both.groupBy("protein_id", "layer").agg(F.avg(c).alias("mean_cos"), F.stddev_pop(c).alias("std_cos"), F.min(c).alias("min_cos"), F.max(c).alias("max_cos"), F.count(c).alias("n"))


def core_metrics(head_out: DataFrame, cores: DataFrame) -> DataFrame:
    """For every position with a core in its layer: cosine of core and rest, norms, anchor, magnitudes."""

    def work(heads: np.ndarray, vectors: np.ndarray, core) -> list[tuple]:
        inside = np.isin(heads, np.asarray(core))
        x, y = vectors[inside].sum(0), vectors[~inside].sum(0)
        nx, ny = float(np.linalg.norm(x)), float(np.linalg.norm(y))
        size = np.linalg.norm(vectors, axis=1)
        if not inside.any():
            return []
        cos = float(x @ y / (nx * ny)) if nx >= 0.01 and ny >= 0.01 else 0.0
        return [(cos, nx, ny, int(heads[inside][size[inside].argmax()]), size.tolist())]

    rows = head_out.join(cores.select("protein_id", "layer", "core"), ["protein_id", "layer"])
    return _per_layer(rows, work, "inter_cos double, iso_mag double, main_mag double, anchor int, magnitudes array<double>", ("core",))


def patch_streams(records: DataFrame, streams: DataFrame, metadata: DataFrame) -> DataFrame:
    """Replaces stream_analysis.layer_streams and adds validation_metadata; other fields stay.

    ``streams`` (protein_id, pos, layer_streams) and ``metadata`` (protein_id, validation_metadata).
    Records have protein_id, position and a struct stream_analysis.
    """
    both = records.join(streams.withColumnRenamed("pos", "position"), ["protein_id", "position"], "left").join(metadata, "protein_id", "left")
    patched = F.col("stream_analysis").withField("layer_streams", F.col("layer_streams")).withField("validation_metadata", F.col("validation_metadata"))
    return both.withColumn("stream_analysis", F.when(F.col("layer_streams").isNotNull(), patched).otherwise(F.col("stream_analysis").withField("validation_metadata", F.lit(None).cast(metadata.schema["validation_metadata"].dataType)))).select(*records.columns)


def patch_missing(records: DataFrame, fresh: DataFrame, force: bool = False) -> DataFrame:
    """Fills stream_analysis from ``fresh`` where it is missing, or everywhere if forced."""
    both = records.join(fresh.select("protein_id", "position", F.col("stream_analysis").alias("_new")), ["protein_id", "position"], "left")
    value = F.coalesce("_new", "stream_analysis") if force else F.coalesce("stream_analysis", "_new")
    return both.withColumn("stream_analysis", value).select(*records.columns)
