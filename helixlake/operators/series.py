"""Predictions and series over layers.

Tables: logits(protein_id, pos, layer, token_id, token, logit), hidden(protein_id, pos, layer, vec),
component_out(protein_id, pos, layer, component, vec), answers(protein_id, pos, aa, direction),
running(protein_id, pos, layer, aa, prob).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixlake.functions import vectors as V
from helixlake.functions.blocks import stacked, whole_series
from helixlake.functions.kernels import cosine_transform

KEY = ("protein_id", "pos")


def softmax(logits: DataFrame, *keys: str) -> DataFrame:
    """Adds prob over each (protein_id, pos, layer), or the given keys, without overflow."""
    w = W.partitionBy(*(keys or (*KEY, "layer")))
    e = F.exp(F.col("logit") - F.max("logit").over(w))
    return logits.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def correct_rank(probs: DataFrame, truth: DataFrame) -> DataFrame:
    """correct_prob and correct_rank = 1 + number of tokens strictly more probable; truth has (protein_id, pos, token)."""
    w = W.partitionBy(*KEY, "layer").orderBy(F.desc("prob"))
    ranked = probs.withColumn("correct_rank", F.rank().over(w))
    return ranked.join(truth, [*KEY, "token"]).select(*KEY, "layer", "token", F.col("prob").alias("correct_prob"), "correct_rank")


def top_tokens(probs: DataFrame, most: int = 5) -> DataFrame:
    """The most probable tokens of the whole vocabulary; ties by token id."""
    w = W.partitionBy(*KEY, "layer").orderBy(F.desc("prob"), "token_id")
    return probs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def letter_probabilities(probs: DataFrame, directions: DataFrame) -> DataFrame:
    """Probabilities of the letters alone, per layer: running predictions."""
    return probs.join(directions.select(F.col("aa").alias("token")).distinct(), "token").select(*KEY, "layer", F.col("token").alias("aa"), "prob")


def answer_directions(positions: DataFrame, directions: DataFrame) -> DataFrame:
    """Unit direction of each position's true letter; positions with other letters drop out."""
    return positions.join(directions.select("aa", V.unit("vec").alias("direction")), "aa").select(*KEY, "aa", "direction")


def velocity(hidden: DataFrame, answers: DataFrame) -> DataFrame:
    """Per layer step: projection of the change on the answer direction, and its length."""
    w = W.partitionBy(*KEY).orderBy("layer")
    step = hidden.withColumn("before", F.lag("vec").over(w)).filter(F.col("before").isNotNull()).join(answers.select(*KEY, "direction"), list(KEY))
    change = step.select(*KEY, (F.col("layer") - 1).alias("layer"), V.minus("vec", "before").alias("v"), "direction")
    return change.select(*KEY, "layer", V.dot("v", "direction").alias("answer"), V.norm("v").alias("magnitude"))


def component_projections(components: DataFrame, answers: DataFrame) -> DataFrame:
    """attention, mlp (projections on the answer direction) and attn_mlp_cosine per layer."""
    of = lambda name: components.filter(F.col("component") == name).select(*KEY, "layer", F.col("vec").alias(name))
    both = of("attn").join(of("mlp"), [*KEY, "layer"]).join(answers.select(*KEY, "direction"), list(KEY))
    return both.select(*KEY, "layer", V.dot("attn", "direction").alias("attention"), V.dot("mlp", "direction").alias("mlp"), V.cosine("attn", "mlp").alias("attn_mlp_cosine"))


def _on_series(rows: DataFrame, keys: tuple[str, ...], fields: str, work: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
    """(keys, fields) of ``work`` on whole series of vectors over layers, those of equal shape of a batch at once; a row per series in arrays.

    ``work`` gets (series, layers, dim) and returns an Arrow array of lists per field.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    series = whole_series(rows, keys, "layer", "vec").select(*keys, "layer", "n", "vecs")
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in stacked(batch.column(len(keys) + 1).to_numpy(zero_copy_only=False), batch.column(len(keys) + 2)):
                mine = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in range(len(keys) + 1)), *work(x)], [*keys, "layers", *names])

    return series.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", layers array<{kinds['layer']}>, {fields}")


def _lists(x: np.ndarray) -> pa.Array:
    """An Arrow list array of a matrix's rows, or a list of lists of a cube's."""
    inner = pa.array(x.ravel())
    for size in x.shape[:0:-1]:
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(inner) // size + 1, dtype=np.int32) * size), inner)
    return inner


def cumulative_components(components: DataFrame) -> DataFrame:
    """c_0 = 0, c_(l+1) = c_l + x_l per component: (…, component, layer, vec), the first at the least layer.

    A position's series is one row of arrays, as many vectors as the model has layers; running sums
    are of whole vectors, many positions at once.
    """

    def work(x: np.ndarray) -> list[pa.Array]:
        return [_lists(np.concatenate([np.zeros_like(x[:, :1]), np.cumsum(x, axis=1)], axis=1))]

    sums = _on_series(components, (*KEY, "component"), "sums array<array<double>>", work)
    places = F.concat(F.slice("layers", 1, 1), F.transform("layers", lambda l: l + 1))
    return sums.select(*KEY, "component", F.inline(F.arrays_zip(places.alias("layer"), F.col("sums").alias("vec"))))


def spectrum(series: DataFrame, kind: str = "kind") -> DataFrame:
    """Power of the layer-axis cosine transform per (protein_id, pos, kind): (…, k, power).

    ``series`` has vec per layer; a position's series has as many rows as the model has layers.
    Series of equal shape are transformed together, by a fast transform.
    """

    def work(x: np.ndarray) -> list[pa.Array]:
        return [_lists(np.linalg.norm(cosine_transform(x), axis=2))]

    power = _on_series(series, (*KEY, kind), "power array<double>", work)
    return power.select(*KEY, kind, F.posexplode("power").alias("k", "power"))


def scalar_spectrum(series: DataFrame, value: str, *keys: str) -> DataFrame:
    """Orthonormal cosine transform (type II) of a scalar series over layers, by a join of each group with its frequencies."""
    w = W.partitionBy(*keys)
    n = F.count("*").over(w)
    at = F.row_number().over(W.partitionBy(*keys).orderBy("layer")) - 1
    rows = series.select(*keys, "layer", F.col(value).alias("_x")).withColumn("_n", n).withColumn("_at", at)
    wide = rows.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    scale = F.when(F.col("k") == 0, F.sqrt(F.lit(1.0) / F.col("_n"))).otherwise(F.sqrt(F.lit(2.0) / F.col("_n")))
    term = F.col("_x") * scale * F.cos(F.lit(np.pi) * F.col("k") * (2 * F.col("_at") + 1) / (2 * F.col("_n")))
    return wide.groupBy(*keys, "k").agg(F.sum(term).alias("coefficient"))


def race(running: DataFrame) -> DataFrame:
    """Letters of each layer by descending probability, ties in order of the alphabet: adds place."""
    return running.withColumn("place", F.row_number().over(W.partitionBy(*KEY, "layer").orderBy(F.desc("prob"), "aa")))


def lead_changes(running: DataFrame) -> DataFrame:
    """Layers where the leader differs from the layer before: from_aa, to_aa and both leaders' percentages."""
    lead = running.groupBy(*KEY, "layer").agg(F.min(F.struct((-F.col("prob")).alias("m"), "aa")).alias("l")).select(*KEY, "layer", F.col("l.aa").alias("to_aa"), (-F.col("l.m")).alias("to_prob"))
    w = W.partitionBy(*KEY).orderBy("layer")
    both = lead.withColumn("from_aa", F.lag("to_aa").over(w)).withColumn("from_prob", F.lag("to_prob").over(w))
    pct = lambda c: F.round(F.col(c) * 100, 1).alias(c.replace("prob", "pct"))
    return both.filter(F.col("from_aa") != F.col("to_aa")).select(*KEY, "layer", "from_aa", "to_aa", pct("from_prob"), pct("to_prob"))


#: The letters' names and groups.
AMINO_ACIDS = {
    "A": ("Alanine", "hydrophobic"), "C": ("Cysteine", "special"), "D": ("Aspartate", "negative"), "E": ("Glutamate", "negative"), "F": ("Phenylalanine", "aromatic"),
    "G": ("Glycine", "special"), "H": ("Histidine", "positive"), "I": ("Isoleucine", "hydrophobic"), "K": ("Lysine", "positive"), "L": ("Leucine", "hydrophobic"),
    "M": ("Methionine", "hydrophobic"), "N": ("Asparagine", "polar"), "P": ("Proline", "special"), "Q": ("Glutamine", "polar"), "R": ("Arginine", "positive"),
    "S": ("Serine", "polar"), "T": ("Threonine", "polar"), "V": ("Valine", "hydrophobic"), "W": ("Tryptophan", "aromatic"), "Y": ("Tyrosine", "aromatic"),
}


def trajectories(running: DataFrame, top_n: int = 5, shown: tuple[int, ...] = (0, 8, 17, 23, 29, 33)) -> DataFrame:
    """The ``top_n`` letters by final probability: final, peak, first peak layer, values at the shown layers there are."""
    per = running.groupBy(*KEY, "aa").agg(
        F.max_by("prob", "layer").alias("final"), F.max("prob").alias("peak"), F.max_by("layer", F.struct(F.col("prob"), -F.col("layer"))).alias("peak_layer"),
        F.sort_array(F.collect_list(F.when(F.col("layer").isin(*shown), F.struct("layer", "prob")))).alias("_at"),
    )
    ranked = per.withColumn("rank", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("final"), "aa"))).filter(F.col("rank") <= top_n)
    return ranked.withColumn("values", F.map_from_entries("_at")).drop("_at")


def named_trajectories(trajectories_: DataFrame) -> DataFrame:
    """Trajectories for evidence: name and group of the letter, probabilities in percent with 2 places, waypoints by layer."""
    of = lambda i, absent: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for a, n in AMINO_ACIDS.items() for x in (a, n[i])]), F.col("aa")), absent)
    pct = lambda c: F.round(c * 100, 2)
    waypoints = F.transform_values(F.transform_keys("values", lambda k, _: k.cast("string")), lambda _, v: pct(v))
    return trajectories_.select(*KEY, "aa", of(0, F.col("aa")).alias("name"), of(1, F.lit("unknown")).alias("group"), pct(F.col("final")).alias("final_prob"), pct(F.col("peak")).alias("peak_prob"), "peak_layer", waypoints.alias("waypoints"), "rank")


def key_velocity_events(velocity_: DataFrame, least: float = 0.5, most: int = 10) -> DataFrame:
    """Steps with |answer| >= ``least``: driver, direction; the ``most`` largest after rounding to 2 places, then by layer.

    Input: protein_id, pos, layer, answer, attention, mlp.  The event's layer is the step's plus one.
    """
    a, m = F.abs("attention"), F.abs("mlp")
    driver = F.when(a > 1.5 * m, "attention").when(m > 1.5 * a, "MLP").otherwise("both")
    w = W.partitionBy(*KEY).orderBy(F.desc(F.abs(F.round("answer", 2))), "layer")
    events = velocity_.filter(F.abs("answer") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return events.select(*KEY, (F.col("layer") + 1).alias("layer"), F.round("answer", 2).alias("total_delta"), F.round("attention", 2).alias("attn_delta"), F.round("mlp", 2).alias("mlp_delta"), driver.alias("driver"), F.when(F.col("answer") > 0, "toward").otherwise("away from").alias("direction"), "rank")
