"""Tables of the library's contract, projected from the driver's tables; SQL holds the same for DuckDB.

Each projection is deterministic and grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixlake.functions import vectors as V
from helixlake.operators.coevolution import LETTERS

_IN = ", ".join(f"'{a}'" for a in LETTERS)
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WIDTH, TIMES = 24, 1_000_000


def windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, seq_id, lang, source, s): whole texts, cut into pieces of ``width`` characters."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    return docs.select("doc_id", "lang", "source", F.posexplode(cut).alias("w", "s")).select("doc_id", (F.col("doc_id") * TIMES + F.col("w")).alias("seq_id"), "lang", "source", "s")


def _windows_sql(width: int) -> str:
    return f"(SELECT doc_id * {TIMES} + w AS seq_id, lang, source, substr(text, CAST(w * {width} AS INTEGER) + 1, {width}) AS s FROM (SELECT *, unnest(range(0, (length(text) + {width - 1}) // {width})) AS w FROM documents))"


#: What becomes one of A-Z in capitals, letter by letter.
_LOW, _HIGH = "abcdefghijklmnopqrstuvwxyz\u0131\u017f", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS"


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in rows of 24 characters as aligned residues; a family per language.

    Neighbours in the text stand 12 columns apart, so that distant columns depend on each other.
    """
    letters = F.split(F.translate("s", _LOW, _HIGH), "")
    cells = windows(read(spark, sf_dir, "documents"), WIDTH).select(F.col("lang").alias("protein_id"), "seq_id", F.posexplode(letters).alias("i", "aa"))
    cells = cells.select("protein_id", "seq_id", F.expr("cast(i % 2 * 12 + i div 2 as int)").alias("pos"), "aa")
    return cells.filter(F.col("aa").isin(*LETTERS))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``residues`` as strings of 24 characters in the text's order; see ``column``."""
    rows = windows(read(spark, sf_dir, "documents"), WIDTH)
    return rows.select(F.col("lang").alias("protein_id"), "seq_id", F.translate("s", _LOW, _HIGH).alias("aligned"))


def column(i: Column) -> Column:
    """The position of character ``i`` of a row: neighbours stand 12 apart."""
    return (i % 2 * (WIDTH // 2) + (i - i % 2) / 2).cast("int")


SQL["residues"] = f"""residues AS (SELECT * FROM (SELECT lang AS protein_id, seq_id, CAST(p.i % 2 * 12 + p.i // 2 AS INTEGER) AS pos, upper(substr(s, CAST(p.i AS INTEGER) + 1, 1)) AS aa
    FROM {_windows_sql(WIDTH)}, range({WIDTH}) AS p(i)) WHERE aa IN ({_IN}))"""


def positions(residues_: DataFrame) -> DataFrame:
    return residues_.select("protein_id", "pos").distinct()


SQL["letters"] = "letters AS (SELECT unnest([" + _IN + "]) AS aa)"
SQL["freq"] = """freq AS (SELECT g.protein_id, g.pos, g.aa, (count(r.aa) + 1) / (sum(count(r.aa)) OVER (PARTITION BY g.protein_id, g.pos) + 20.0) AS f
    FROM (SELECT * FROM (SELECT DISTINCT protein_id, pos FROM residues), letters) g LEFT JOIN residues r USING (protein_id, pos, aa) GROUP BY g.protein_id, g.pos, g.aa)"""
SQL["counts"] = """counts AS (SELECT x.protein_id, x.pos AS pos_i, y.pos AS pos_j, x.aa AS aa_i, y.aa AS aa_j, count(*) AS n FROM residues x JOIN residues y ON x.protein_id = y.protein_id AND x.seq_id = y.seq_id AND x.pos < y.pos GROUP BY ALL)"""
SQL["mi"] = """totals AS (SELECT protein_id, pos_i, pos_j, sum(n) AS total FROM counts GROUP BY ALL),
  mi AS (SELECT t.protein_id, t.pos_i, t.pos_j, CAST(t.total AS BIGINT) AS total, CASE WHEN t.total >= 10 THEN sum(((coalesce(c.n, 0) + 0.05) / (t.total + 1)) * ln(((coalesce(c.n, 0) + 0.05) / (t.total + 1)) / (a.f * b.f))) ELSE 0.0 END AS mi
    FROM totals t JOIN freq a ON a.protein_id = t.protein_id AND a.pos = t.pos_i JOIN freq b ON b.protein_id = t.protein_id AND b.pos = t.pos_j
    LEFT JOIN counts c ON c.protein_id = t.protein_id AND c.pos_i = t.pos_i AND c.pos_j = t.pos_j AND c.aa_i = a.aa AND c.aa_j = b.aa GROUP BY t.protein_id, t.pos_i, t.pos_j, t.total)"""
SQL["apc"] = """npos AS (SELECT protein_id, count(DISTINCT pos) AS n FROM residues GROUP BY protein_id),
  rowsum AS (SELECT protein_id, pos, sum(mi) AS s FROM (SELECT protein_id, pos_i AS pos, mi FROM mi UNION ALL SELECT protein_id, pos_j, mi FROM mi) GROUP BY ALL),
  allsum AS (SELECT protein_id, sum(s) / (any_value(n) * any_value(n)) AS m, any_value(n) AS n FROM rowsum JOIN npos USING (protein_id) GROUP BY protein_id),
  apc AS (SELECT mi.*, CASE WHEN m > 0 THEN greatest(mi - (a.s / n) * (b.s / n) / m, 0) ELSE mi END AS mi_apc FROM mi JOIN allsum USING (protein_id)
    JOIN rowsum a ON a.protein_id = mi.protein_id AND a.pos = pos_i JOIN rowsum b ON b.protein_id = mi.protein_id AND b.pos = pos_j)"""
SQL["partners"] = """partners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protein_id, pos ORDER BY mi_apc DESC, partner DESC) AS rank FROM
    (SELECT protein_id, pos_i AS pos, pos_j AS partner, round(mi_apc, 8) AS mi_apc FROM apc UNION ALL SELECT protein_id, pos_j, pos_i, round(mi_apc, 8) FROM apc) WHERE abs(pos - partner) > 5) WHERE rank <= 8 AND mi_apc > 0.01)"""


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in rows of 40 characters with blanks, breaks and a letter whose capital is two as gaps; a family per source."""
    rows = windows(read(spark, sf_dir, "documents"), 40)
    return rows.select(F.col("source").alias("protein_id"), "seq_id", F.concat(F.lit("seq"), "seq_id").alias("seq_name"), F.translate("s", " .\n\u00df", "----").alias("aligned"))


SQL["msa"] = f"msa AS (SELECT source AS protein_id, seq_id, 'seq' || seq_id AS seq_name, translate(s, ' .' || chr(10) || chr(223), '----') AS aligned FROM {_windows_sql(40)})"


def targets(msa_: DataFrame) -> DataFrame:
    """Target sequence of a family: the ungapped letters of its row with the largest id."""
    last = msa_.groupBy("protein_id").agg(F.max_by("aligned", "seq_id").alias("a"))
    return last.select("protein_id", F.upper(F.regexp_replace("a", "[-.]", "")).alias("sequence"))


SQL["targets"] = "targets AS (SELECT protein_id, upper(replace(replace(arg_max(aligned, seq_id), '-', ''), '.', '')) AS sequence FROM msa GROUP BY protein_id)"


def numbered(spark: SparkSession, sf_dir: str, span: int = 4096) -> DataFrame:
    """Embeddings with their number within a label, from 0, in order of vec_id.

    Ids are cut into spans; rows are counted per label and span, and numbered within
    these, so that the few labels don't each have to lie in one task.
    """
    rows = read(spark, sf_dir, "embeddings").withColumn("_span", F.floor(F.col("vec_id") / span))
    before = F.sum("_n").over(W.partitionBy("label").orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    counts = rows.groupBy("label", "_span").agg(F.count("*").alias("_n")).select("label", "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("label", "_span").orderBy("vec_id")) - 1
    placed = rows.withColumn("_within", within).join(counts, ["label", "_span"])
    return placed.select("vec_id", "embedding", "label", (F.col("_within") + F.col("_before")).cast("int").alias("rn"))


SQL["numbered"] = "numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS rn FROM embeddings)"


def ca(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered(spark, sf_dir)
    return e.select(F.col("label").cast("string").alias("structure_id"), F.col("rn").alias("pos"), *[(F.get("embedding", F.lit(i)).cast("double") * 30).alias(c) for i, c in enumerate("xyz")])


SQL["ca"] = "ca AS (SELECT CAST(label AS VARCHAR) AS structure_id, rn AS pos, CAST(embedding[1] AS DOUBLE) * 30 AS x, CAST(embedding[2] AS DOUBLE) * 30 AS y, CAST(embedding[3] AS DOUBLE) * 30 AS z FROM numbered)"


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select(F.lit("p").alias("protein_id"), F.col("label").alias("pos"), F.col("rn").alias("layer"), F.col("embedding").alias("vec"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = numbered(spark, sf_dir).filter("rn = 0")
    return first.select(F.lit("p").alias("protein_id"), F.col("label").alias("pos"), F.expr("substr('ACD', label % 3 + 1, 1)").alias("aa"), V.unit("embedding").alias("direction"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden(spark, sf_dir).select("protein_id", "pos", F.expr("cast(layer div 2 as int)").alias("layer"), F.when(F.col("layer") % 2 == 0, "attn").otherwise("mlp").alias("component"), "vec")


SQL["cells"] = "cells AS (SELECT label, rn, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM numbered)"
SQL["direction"] = "direction AS (SELECT label, dim, x / (sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-10) AS d FROM cells WHERE rn = 0)"


def head_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten heads per layer; a layer is a label, a position a run of ten vectors."""
    return numbered(spark, sf_dir).select(F.lit("p").alias("protein_id"), F.expr("cast(rn div 10 as int)").alias("pos"), F.col("label").alias("layer"), (F.col("rn") % 10).cast("int").alias("head"), F.col("embedding").alias("vec"))


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a day's value by type of event, per group of users: letters are types, layers days."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("protein_id"), F.unix_date(F.to_date("ts")).alias("layer"), F.col("event_type").alias("aa"), F.abs("value").alias("v"))
    per = e.groupBy("protein_id", "layer", "aa").agg(F.sum("v").alias("v"))
    share = F.round(F.col("v") / F.sum("v").over(W.partitionBy("protein_id", "layer")), 6)
    return per.select("protein_id", F.lit(0).alias("pos"), "layer", "aa", share.alias("prob"))


SQL["running"] = """running AS (SELECT protein_id, 0 AS pos, layer, aa, round(v / sum(v) OVER (PARTITION BY protein_id, layer), 6) AS prob FROM
    (SELECT CAST(user_id % 5 AS VARCHAR) AS protein_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS layer, event_type AS aa, sum(abs(value)) AS v FROM events GROUP BY ALL))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of value by type of event, per position (user mod 50) and layer (day mod 34); letters are the types' initials.

    Shares have 3 places and a fourth of 1, so that no rounding of percentages is a tie.
    """
    layer, aa = F.pmod(F.unix_date(F.to_date("ts")), F.lit(34)).alias("layer"), F.upper(F.substring("event_type", 1, 1)).alias("aa")
    per = read(spark, sf_dir, "events").groupBy(F.lit("p").alias("protein_id"), (F.col("user_id") % 50).cast("int").alias("pos"), layer, aa).agg(F.sum(F.abs("value")).alias("v"))
    return per.select("protein_id", "pos", "layer", "aa", (F.round(F.col("v") / F.sum("v").over(W.partitionBy("pos", "layer")), 3) + 0.0001).alias("prob"))


SQL["runs"] = """runs AS (SELECT pos, layer, aa, round(v / sum(v) OVER (PARTITION BY pos, layer), 3) + 0.0001 AS prob FROM
    (SELECT CAST(user_id % 50 AS INTEGER) AS pos, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 34 AS INTEGER) AS layer, upper(substr(event_type, 1, 1)) AS aa, sum(abs(value)) AS v FROM events GROUP BY ALL))"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by type of event, per user and day; token ids in order of the types' names."""
    e = read(spark, sf_dir, "events")
    per = e.groupBy(F.col("user_id").cast("string").alias("protein_id"), F.unix_date(F.to_date("ts")).alias("layer"), F.col("event_type").alias("token")).agg(F.round(F.avg("value") / 50, 6).alias("logit"))
    return per.select("protein_id", F.lit(0).alias("pos"), "layer", F.crc32("token").alias("token_id"), "token", "logit")


SQL["logits"] = "logits AS (SELECT CAST(user_id AS VARCHAR) AS protein_id, 0 AS pos, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS layer, event_type AS token, round(avg(value) / 50, 6) AS logit FROM events GROUP BY ALL)"
SQL["probs"] = """probs AS (SELECT *, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY protein_id, layer) AS prob FROM (SELECT *, max(logit) OVER (PARTITION BY protein_id, layer) AS m FROM logits))"""


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of quantity of a head's sources; rows of lineitem are dealt by their keys."""
    li = read(spark, sf_dir, "lineitem").select(F.lit("p").alias("protein_id"), (F.col("l_suppkey") % 50).cast("int").alias("pos"), (F.col("l_linenumber") % 4).alias("layer"), (F.col("l_orderkey") % 20).cast("int").alias("head"), (F.col("l_partkey") % 60).cast("int").alias("src"), "l_quantity")
    per = li.groupBy("protein_id", "pos", "layer", "head", "src").agg(F.sum("l_quantity").alias("q"))
    return per.select("protein_id", "pos", "layer", "head", "src", F.round(F.col("q") / F.sum("q").over(W.partitionBy("protein_id", "pos", "layer", "head")), 6).alias("weight"))


SQL["attention"] = """attention AS (SELECT protein_id, pos, layer, head, src, round(q / sum(q) OVER (PARTITION BY pos, layer, head), 6) AS weight FROM
    (SELECT 'p' AS protein_id, CAST(l_suppkey % 50 AS INTEGER) AS pos, CAST(l_linenumber % 4 AS INTEGER) AS layer, CAST(l_orderkey % 20 AS INTEGER) AS head, CAST(l_partkey % 60 AS INTEGER) AS src, sum(l_quantity) AS q FROM lineitem GROUP BY ALL))"""


def attention_edges(attention_: DataFrame) -> DataFrame:
    pairs = attention_.select("protein_id", "pos", F.col("src").alias("partner")).distinct()
    s = pairs.filter((F.col("pos") + F.col("partner")) % 7 == 0).withColumn("kind", F.lit("structural"))
    return s.unionByName(pairs.filter((F.col("pos") * F.col("partner")) % 5 == 1).withColumn("kind", F.lit("coevolving")))


SQL["labelled"] = "labelled AS (SELECT *, CAST((pos + src) % 7 = 0 AS INTEGER) AS structural, CAST((pos * src) % 5 = 1 AS INTEGER) AS coevolving, CAST(abs(src - pos) BETWEEN 1 AND 5 AS INTEGER) AS local FROM attention)"


def head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection per head from its mean discount, 2 places."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.lit("p").alias("protein_id"), (F.col("l_suppkey") % 50).cast("int").alias("pos"), (F.col("l_linenumber") % 4).alias("layer"), (F.col("l_orderkey") % 20).cast("int").alias("head"))
    return li.agg(F.round(F.avg("l_discount") * 20 - 1, 4).alias("projection"))


SQL["scores"] = "scores AS (SELECT 'p' AS protein_id, CAST(l_suppkey % 50 AS INTEGER) AS pos, CAST(l_linenumber % 4 AS INTEGER) AS layer, CAST(l_orderkey % 20 AS INTEGER) AS head, round(avg(l_discount) * 20 - 1, 4) AS projection FROM lineitem GROUP BY ALL)"
SQL["categories"] = "categories AS (SELECT protein_id, pos, layer, head, sum(weight * structural) AS attn_structural, sum(weight * coevolving) AS attn_coevolving, sum(weight * local) AS attn_local FROM labelled GROUP BY ALL)"


def mlp_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neurons are parts, layers line numbers, positions the low digits of orders; the mean discount less 0.05 is the activation."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.lit("p").alias("protein_id"), (F.col("l_orderkey") % 500).cast("int").alias("pos"), F.col("l_linenumber").alias("layer"), F.col("l_partkey").alias("neuron"))
    return li.agg(F.round(F.avg("l_discount") - 0.05, 4).alias("act"))


SQL["mlp"] = "mlp AS (SELECT 'p' AS protein_id, CAST(l_orderkey % 500 AS INTEGER) AS pos, l_linenumber AS layer, l_partkey AS neuron, round(avg(l_discount) - 0.05, 4) AS act FROM lineitem GROUP BY ALL)"


def gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("neuron"), "p_size", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("layer"))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return p.select("layer", "neuron", F.expr("substr('ACD', k + 1, 1)").alias("aa"), (((F.col("p_size") * (F.col("k") + 2) + F.col("layer")) % 23) / 23.0 - 0.5).alias("gain"))


SQL["gain"] = "gain AS (SELECT CAST(l.layer AS INTEGER) AS layer, p_partkey AS neuron, substr('ACD', CAST(k.k + 1 AS INTEGER), 1) AS aa, ((p_size * (k.k + 2) + l.layer) % 23) / 23.0 - 0.5 AS gain FROM part, range(1, 8) AS l(layer), range(3) AS k(k))"


def position_letters(rows: DataFrame) -> DataFrame:
    return rows.select("protein_id", "pos").distinct().withColumn("aa", F.expr("substr('ACD', pos % 3 + 1, 1)"))


SQL["pushed"] = "pushed AS (SELECT protein_id, pos, layer, neuron, act, act * gain AS contribution FROM mlp JOIN gain USING (layer, neuron) WHERE gain.aa = substr('ACD', pos % 3 + 1, 1))"


def feature_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features are parts, layers the suppliers' regions, the source by return flag."""
    where = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("layer"))
    li = read(spark, sf_dir, "lineitem").join(where, "l_suppkey")
    keys = [F.lit("p").alias("protein_id"), (F.col("l_orderkey") % 300).cast("int").alias("pos"), "layer", F.when(F.col("l_returnflag") == "N", "attn").otherwise("mlp").alias("source"), F.col("l_partkey").alias("feature_id")]
    return li.groupBy(*keys).agg(F.round(F.avg("l_discount") * 10 - 0.4, 4).alias("proj"))


SQL["lists"] = """lists AS (SELECT 'p' AS protein_id, CAST(l_orderkey % 300 AS INTEGER) AS pos, n_regionkey AS layer, CASE WHEN l_returnflag = 'N' THEN 'attn' ELSE 'mlp' END AS source, l_partkey AS feature_id, round(avg(l_discount) * 10 - 0.4, 4) AS proj
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""


def feature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the features with even numbers."""
    p = read(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("summary"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("layer"))
    return p.select("layer", "feature_id", "summary")


def groupings(spark: SparkSession, sf_dir: str, heads: int = 25) -> DataFrame:
    """Per segment, position (custkey mod 60) and layer: nations (mod ``heads``) with a customer in debt against the others."""
    per = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("protein_id"), (F.col("c_custkey") % 60).cast("int").alias("pos"), (F.col("c_custkey") % 2).cast("int").alias("layer"), (F.col("c_nationkey") % heads).cast("int").alias("head")).agg(F.max((F.col("c_acctbal") < 2000).cast("int")).alias("side"), F.avg("c_acctbal").alias("bal"))
    return per.groupBy("protein_id", "pos", "layer").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, F.col("head")))).alias("isolated"), F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.col("head")))).alias("main"), (F.floor(F.avg("bal") / 10 + 1e-7) / 1000).alias("inter_cos")
    ).filter((F.size("isolated") > 0) & (F.size("main") > 0))


SQL["sides"] = """sides AS (SELECT c_mktsegment AS protein_id, CAST(c_custkey % 60 AS INTEGER) AS pos, CAST(c_custkey % 2 AS INTEGER) AS layer, c_nationkey AS head, max(CAST(c_acctbal < 2000 AS INTEGER)) AS side, avg(c_acctbal) AS bal FROM customer GROUP BY ALL),
  groupings AS (SELECT protein_id, pos, layer, floor(avg(bal) / 10 + 1e-7) / 1000 AS inter_cos FROM sides GROUP BY ALL HAVING sum(side) > 0 AND sum(side) < count(*)),
  assigned AS (SELECT sides.* FROM sides JOIN groupings USING (protein_id, pos, layer))"""


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with references, from events: every second names a layer."""
    k = (F.col("event_id") % 40).cast("string")
    text = F.concat(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("At L"), k, F.lit(" "))).otherwise(F.lit("Here ")), F.lit("F"), F.col("user_id").cast("string"), F.lit(" fires, not F7:"), k, F.lit(", while N"), (F.col("user_id") % 10).cast("string"), F.lit(" rests"))
    return read(spark, sf_dir, "events").select(F.lit("p").alias("protein_id"), F.col("event_id").alias("pos"), F.lit("story").alias("path"), text.alias("text"))


def reference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers in which a user's number is a feature: two of them for users divisible by 3, none for multiples of 7."""
    e = read(spark, sf_dir, "events").filter("user_id % 7 != 0").select(F.lit("p").alias("protein_id"), F.col("event_id").alias("pos"), F.lit("F").alias("kind"), F.col("user_id").cast("int").alias("ref_id"), "user_id")
    one = e.withColumn("layer", F.lit(10)).withColumn("proj", F.lit(0.5))
    two = e.filter("user_id % 3 = 0").withColumn("layer", F.lit(30)).withColumn("proj", F.lit(-0.9))
    return one.unionByName(two).drop("user_id")
