"""The whole job from alignments to coevolution results, in stages that are stored and can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.operators import coevolution as C
from helixlake.sources import writers
from helixlake.storage import Stages


def _sample(msa: DataFrame, max_seqs: int) -> DataFrame:
    return C.pad_sequences(C.sample_sequences(msa, max_seqs))


def _cells(sample: DataFrame, columns: DataFrame) -> DataFrame:
    return C.cell_counts(C.aligned_positions(sample, columns))


def _edges(scores: DataFrame, curated: DataFrame, proteins: DataFrame, top_k: int, mi_threshold: float, local_window: int) -> DataFrame:
    """Edges with their method: computed and curated ones, both ways; the curated ones alone where nothing was computed."""
    computed = C.select_partners(scores, top_k, mi_threshold, local_window)
    known = C.symmetrize(curated, proteins)
    found = computed.select("protein_id").distinct()
    merged = C.merge_edges(computed, known.join(found, "protein_id", "left_semi"), proteins).withColumn("method", F.lit("MI+APC"))
    return merged.unionByName(known.join(found, "protein_id", "left_anti").withColumn("method", F.lit("curated_only")))


def _results(proteins: DataFrame, edges: DataFrame, scores: DataFrame, sample: DataFrame, columns: DataFrame, descriptions: DataFrame, source: str, top_k: int, mi_threshold: float, local_window: int) -> DataFrame:
    aligned = sample.groupBy("protein_id").agg(F.lit(source).alias("source"), F.count("*").cast("int").alias("n_sequences"), F.max(F.length("aligned")).cast("int").alias("alignment_length"))
    mapped = columns.groupBy("protein_id").agg(F.count("*").cast("int").alias("mapped_positions"))
    named = proteins.join(edges.select("protein_id", "method").distinct(), "protein_id", "left").withColumn("method", F.coalesce("method", F.lit("curated_only")))
    return writers.coevolution_result(named, edges, scores, C.coverage(edges, proteins), "curated_only", mi_threshold, top_k, local_window, aligned.join(mapped, "protein_id"), descriptions)


def coevolution_results(
    stages: Stages, msa: DataFrame, proteins: DataFrame, curated: DataFrame, descriptions: DataFrame, source: str = "", max_seqs: int = 5000, top_k: int = 8, mi_threshold: float = 0.1, local_window: int = 5,
) -> DataFrame:
    """One nested result per protein of ``proteins`` (protein_id, sequence, seq_len).

    ``msa``: protein_id, seq_id, seq_name, aligned; ``curated``: protein_id, pos, partner;
    ``descriptions``: protein_id, pos, description.  Families are sampled, padded, mapped to
    their protein's sequence, counted, scored and selected, each a stage; the counts and
    scores that later stages read more than once are stored tables.
    """
    msa, proteins, curated, descriptions = (stages.stage(n, lambda x: x, x) for n, x in (("msa", msa), ("proteins", proteins), ("curated", curated), ("descriptions", descriptions)))
    chosen = {"top_k": top_k, "mi_threshold": mi_threshold, "local_window": local_window}
    sample = stages.stage("sample", _sample, msa, max_seqs=max_seqs)
    columns = stages.stage("columns", lambda s, p: C.column_map(C.reference_rows(s, p)), sample, proteins)
    cells = stages.stage("cells", _cells, sample, columns)
    scores = stages.stage("scores", lambda c, p: C.coevolution(c, p.select("protein_id", "pos")), cells, columns)
    edges = stages.stage("edges", _edges, scores, curated, proteins, **chosen)
    return stages.stage("results", _results, proteins, edges, scores, sample, columns, descriptions, source=source, **chosen)
