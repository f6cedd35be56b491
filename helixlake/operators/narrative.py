"""Evidence documents, parsing of generated text and clean-up of bare references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("protein_id", "pos")

#: Schema of a narrative, for parsing.
NARRATIVE = (
    "headline string, story string, resolution string, perception_phase struct<summary:string,context_character:string,key_information_sources:array<string>>, "
    "decision_phase struct<summary:string,transition:string>, candidates array<struct<aa:string,role:string,narrative:string,key_layers:array<string>,key_evidence:array<string>>>, "
    "turning_points array<struct<layer_range:string,description:string>>, deep_dives array<struct<id:string,label:string,type:string,layers:array<string>,feature_ids:array<int>,caption:string>>"
)
REQUIRED = ("headline", "story", "resolution", "perception_phase", "decision_phase", "candidates", "turning_points", "deep_dives")


def sequence_context(sequence: Column, pos: Column, reach: int = 5) -> Column:
    """'...abc[K]def...': the letters around a position, which is in brackets."""
    low = F.greatest(pos - reach, F.lit(0))
    high = F.least(pos + reach + 1, F.length(sequence))
    before, at, after = F.substr(sequence, low + 1, pos - low), F.substr(sequence, pos + 1, F.lit(1)), F.substr(sequence, pos + 2, high - pos - 1)
    return F.concat(F.when(low > 0, "...").otherwise(""), before, F.lit("["), at, F.lit("]"), after, F.when(high < F.length(sequence), "...").otherwise(""))


def evidence(positions: DataFrame, **sections: DataFrame) -> DataFrame:
    """One JSON document per position: scalar fields of ``positions`` and, per section, its rows in order of rank or layer."""
    out = positions
    names = [c for c in positions.columns if c not in KEY]
    for name, rows in sections.items():
        fields = [c for c in rows.columns if c not in KEY]
        order = [c for c in ("rank", "layer", "kind") if c in fields]
        item = F.struct(*[F.col(c) for c in order + [c for c in fields if c not in order]])
        out = out.join(rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias(name)), list(KEY), "left")
        names.append(name)
    return out.select(*KEY, F.to_json(F.struct(*names)).alias("evidence"))


def parse_generated(rows: DataFrame, raw: str = "raw", schema: str = NARRATIVE, required: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """(accepted with narrative, rejected with reason): fences removed, JSON parsed, required fields present."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.col(raw)), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    parsed = rows.withColumn("_text", text).withColumn("_n", F.from_json("_text", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    missing = F.filter(F.array(*[F.when(F.col(f"_n.{c}").isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    reason = F.when(F.col(raw).isNull(), "no text").when(F.col("_n").isNull() | F.col("_n._corrupt").isNotNull(), "not JSON").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    judged = parsed.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").select(*rows.columns, F.col("_n").dropFields("_corrupt").alias("narrative"))
    return good, judged.filter("reason IS NOT NULL").select(*rows.columns, "reason")


def attach(records: DataFrame, narratives: DataFrame, trajectories: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds equation_narrative, candidate_trajectories (6 at most) and lead_changes to records (protein_id, position)."""
    key = ["protein_id", "position"]
    t = trajectories.filter(F.col("rank") <= 6).groupBy("protein_id", F.col("pos").alias("position")).agg(F.sort_array(F.collect_list(F.struct("rank", "aa", "final", "peak", "peak_layer"))).alias("candidate_trajectories"))
    c = changes.groupBy("protein_id", F.col("pos").alias("position")).agg(F.sort_array(F.collect_list(F.struct("layer", "from_aa", "to_aa", "from_pct", "to_pct"))).alias("lead_changes"))
    n = narratives.select("protein_id", F.col("pos").alias("position"), F.col("narrative").alias("equation_narrative"))
    return records.join(n, key, "left").join(t, key, "left").join(c, key, "left")


def reference_map(features: DataFrame) -> DataFrame:
    """(protein_id, pos, kind, ref_id, layer, strength): a row for each list that holds an id.

    ``features``: protein_id, pos, kind ('F' or 'N'), layer, ref_id, proj.
    """
    return features.select(*KEY, "kind", "ref_id", "layer", F.abs("proj").alias("strength"))


def _named_items(path: str, texts: Column) -> Column:
    return F.coalesce(F.transform(texts, lambda t: F.struct(F.lit(path).alias("path"), t.alias("text"))), F.array().cast("array<struct<path:string,text:string>>"))


def text_leaves(narratives: DataFrame, paths: dict[str, Column]) -> DataFrame:
    """(protein_id, pos, path, text) of the listed text or text-array columns."""
    items = F.flatten(F.array(*[_named_items(path, c if many else F.array(c)) for path, (c, many) in paths.items()]))
    return narratives.select(*KEY, F.posexplode(items).alias("leaf", "i")).select(*KEY, F.concat_ws("#", "i.path", F.col("leaf").cast("string")).alias("path"), "i.text").filter("text IS NOT NULL")


def _matches(leaves: DataFrame, pattern: str) -> DataFrame:
    """(…, path, number, at, size): the pattern's numbers with the offset and length of each match.

    A text is split at its matches; offsets are running sums of the lengths between and of the
    matches, so the work is linear in their number.
    """
    whole = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.length)
    numbers = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    between = F.transform(F.split("text", pattern), F.length)
    pieces = leaves.select(*KEY, "path", F.posexplode(F.arrays_zip(between.alias("between"), whole.alias("size"), numbers.alias("number"))).alias("i", "m")).filter("m.size IS NOT NULL")
    so_far = W.partitionBy(*KEY, "path").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = F.sum(F.col("m.between") + F.col("m.size")).over(so_far) - F.col("m.size")
    return pieces.select(*KEY, "path", F.col("m.number").cast("int").alias("number"), at.cast("int").alias("at"), F.col("m.size").alias("size"))


def bare_references(leaves: DataFrame) -> DataFrame:
    """F123 and N123 without a layer: (…, path, kind, ref_id, at, size)."""
    of = lambda kind: _matches(leaves, rf"(?U)\b{kind}(?!\d+:)(\d+)\b").select(*KEY, "path", F.lit(kind).alias("kind"), F.col("number").alias("ref_id"), "at", "size")
    return of("F").unionByName(of("N"))


def layer_mentions(leaves: DataFrame) -> DataFrame:
    """'L12' and 'layer 12' (any case): (…, path, mentioned, form, m_at, m_size)."""
    of = lambda form, pattern: _matches(leaves, pattern).select(*KEY, "path", F.col("number").alias("mentioned"), F.lit(form).alias("form"), F.col("at").alias("m_at"), F.col("size").alias("m_size"))
    return of(0, r"(?U)\bL(\d+)\b").unionByName(of(1, r"(?iU)\blayer\s+(\d+)\b"))


def nearest_mention(references: DataFrame, mentions: DataFrame, window: int = 80) -> DataFrame:
    """Adds near: the layer mentioned nearest within ``window`` characters, wholly inside; form 'L' first on ties.

    An as-of join: references and mentions of a text are put in order once, and each reference
    takes the last mention before and the first behind it, per form.  Mentions of a form
    don't overlap, so the others lie farther off, and the work is linear in a text.
    """
    key = [*KEY, "path"]
    marks = references.select(*key, "at", "kind", "ref_id", "size", F.lit(None).cast("int").alias("form"), F.lit(None).cast("int").alias("mentioned"), F.lit(None).cast("int").alias("m_size"))
    marks = marks.unionByName(mentions.select(*key, F.col("m_at").alias("at"), "form", "mentioned", "m_size"), allowMissingColumns=True)
    told = F.struct(F.col("at").alias("m_at"), "m_size", "mentioned", "form")
    found = []
    for name, order in (("before", F.asc("at")), ("behind", F.desc("at"))):
        so_far = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        for form in (0, 1):
            marks = marks.withColumn(f"_{name}{form}", F.last(F.when(F.col("form") == form, told), ignorenulls=True).over(so_far))
            found.append(f"_{name}{form}")
    inside = lambda m: (m["m_at"] >= F.col("at") - window) & (m["m_at"] + m["m_size"] <= F.col("at") + window)
    ranked = F.transform(F.filter(F.array(*found), lambda m: m.isNotNull() & inside(m)), lambda m: F.struct(F.abs(m["m_at"] - F.col("at")).alias("d"), m["form"], m["m_at"], m["mentioned"]))
    return marks.filter("form IS NULL").select(*references.columns, F.array_min(ranked)["mentioned"].alias("near"))


def resolve_references(references: DataFrame, id_map: DataFrame) -> DataFrame:
    """The layer of each reference: the only candidate, that equal to or nearest the mention (lowest on ties), else the strongest."""
    both = references.join(id_map, [*KEY, "kind", "ref_id"])
    w = W.partitionBy(*KEY, "path", "kind", "at").orderBy(F.coalesce(F.abs(F.col("layer") - F.col("near")), F.lit(0)), F.when(F.col("near").isNull(), -F.col("strength")).otherwise(F.lit(0.0)), "layer")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*references.columns, "layer")


def rewrite_references(leaves: DataFrame, resolved: DataFrame) -> DataFrame:
    """Adds rewritten and replacements: each resolved reference becomes kind layer:id; the others stay.

    References are applied from left to right over the pieces between them, in the JVM.
    """
    per = resolved.groupBy(*KEY, "path").agg(F.sort_array(F.collect_list(F.struct("at", "size", "kind", "layer", "ref_id"))).alias("refs"))
    both = leaves.join(per, [*KEY, "path"], "left")
    step = F.aggregate(
        "refs", F.struct(F.lit("").alias("out"), F.lit(0).alias("done")),
        lambda s, r: F.struct(F.concat(s["out"], F.substr(F.col("text"), s["done"] + 1, r["at"] - s["done"]), r["kind"], r["layer"].cast("string"), F.lit(":"), r["ref_id"].cast("string")).alias("out"), (r["at"] + r["size"]).alias("done")),
        lambda s: F.concat(s["out"], F.substr(F.col("text"), s["done"] + 1, F.length("text"))),
    )
    return both.withColumn("rewritten", F.when(F.col("refs").isNull(), F.col("text")).otherwise(step)).withColumn("replacements", F.when(F.col("refs").isNull(), 0).otherwise(F.size("refs"))).drop("refs")


def qualify(leaves: DataFrame, id_map: DataFrame, window: int = 80) -> DataFrame:
    """The whole clean-up: find, locate, resolve, rewrite."""
    return rewrite_references(leaves, resolve_references(nearest_mention(bare_references(leaves), layer_mentions(leaves), window), id_map))


def replacement_totals(qualified: DataFrame) -> DataFrame:
    """(protein_id, pos, texts, changed, replacements): texts, changed texts and replacements of each record, and of all in a row without keys."""
    sums = [F.count("*").alias("texts"), F.sum((F.col("replacements") > 0).cast("long")).alias("changed"), F.sum("replacements").alias("replacements")]
    per = qualified.groupBy(*KEY).agg(*sums)
    whole = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("texts", "changed", "replacements")])
    return per.unionByName(whole.select(*[F.lit(None).cast(per.schema[k].dataType).alias(k) for k in KEY], "texts", "changed", "replacements"))
