"""Joins that have to hold where tables are large: how they are planned, on small rows."""

import math
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from helixlake.functions import kernels
from helixlake.operators import coevolution as C
from helixlake.operators import contacts, features
from helixlake.plans import projections as P
from helixlake.plans import registry
from helixlake.sources import readers, writers


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _join_lines(df, key):
    return [line for line in _plan(df).splitlines() if "Join" in line and f"{key}#" in line]


def test_exploded_tables_are_not_broadcast(spark, sf):
    """Gains and labels are exploded from a table whose size Spark takes for theirs."""
    joins = _join_lines(registry._letters(spark, sf), "neuron")
    assert len(joins) >= 3
    joins += _join_lines(features.feature_summary(P.feature_lists(spark, sf), P.feature_labels(spark, sf)), "feature_id")
    assert all("SortMergeJoin" in j for j in joins), joins


def test_census_adds_contributions_as_they_are(spark, sf):
    one = registry._contributions(spark, sf).filter("act != 0").agg(F.max(F.abs(F.col("contribution") - F.round("contribution", 8))).alias("d")).first()
    assert one.d > 0


def test_limits_of_clusters_hold_for_rounded_cosines(spark):
    """A cosine of 0.150003 is 0.15 to five places, as in the SQL."""
    c = 0.150003
    vecs = [[2.0, 0.0], [2.0, 0.0], [2 * c, 2 * (1 - c * c) ** 0.5], [2 * c, 2 * (1 - c * c) ** 0.5]]
    out = spark.createDataFrame([("p", 0, 1, h, v) for h, v in enumerate(vecs)], "protein_id string, pos int, layer int, head int, vec array<double>")
    assert [(r.isolated, r.main, r.inter_cos) for r in registry._clusters(out, 0.15).collect()] == [("0,1", "2,3", 0.15)]


def test_residue_numbers_go_on_beyond_four_digits(spark):
    numbers = [0, 9998, 9999, 10000, 10036, 123456, 1223055, 1223056, 1300000]
    n = spark.createDataFrame([(x,) for x in numbers], "n int").withColumn("t", writers.pdb_number(F.col("n"), 4))
    told = {r.n: r.t for r in n.collect()}
    assert (told[0], told[9999], told[10000], told[10036], told[1223055], told[1223056]) == ("   0", "9999", "A000", "A010", "ZZZZ", "a000")
    line = F.format_string("ATOM  %s  CA  ALA A%s    %8.3f%8.3f%8.3f  1.00", writers.pdb_number(F.col("n"), 5), "t", F.lit(1.5), F.lit(2.5), F.lit(3.5))
    lines = n.select(F.lit("s").alias("structure_id"), F.col("n").alias("line_no"), line.alias("value"))
    proteins = spark.createDataFrame([("s", 2_000_000)], "structure_id string, seq_len int")
    got = sorted((r.pos + 1, r.x, r.z) for r in readers.parse_pdb(lines, proteins).collect())
    assert got == [(x, 1.5, 3.5) for x in numbers if x > 0]


def test_families_are_not_dealt_by_protein(spark):
    """What is known of a protein is sent to its sequences; a join by protein would read a family in one task."""
    msa = spark.range(9).selectExpr("concat('p', id % 2) AS protein_id", "id AS seq_id", "'s' || id AS seq_name", "'ACD-' AS aligned")
    maps, proteins = C.column_map(C.reference_rows(msa, P.targets(msa))), P.targets(msa)
    for made in (C.sample_sequences(msa, 3), C.pad_sequences(msa), C.reference_rows(msa, proteins), C.melt_residues(msa, maps), C.aligned_positions(msa, maps)):
        joins = [line for line in _plan(made).splitlines() if "Join" in line and "protein_id#" in line]
        assert joins and all("BroadcastHashJoin" in j for j in joins)


def test_residues_are_read_once_for_frequencies(spark, sf):
    plan = _plan(registry.column_frequencies(spark, sf))
    assert "letters-" in plan and "documents.parquet" not in plan


def test_pair_counts_move_sequences_and_not_residues(spark):
    """Sequences of which parts lie in several tasks; both ways against a count by hand."""
    data = [("p" if s % 3 else None, s, p, "ACDY"[(s * 7 + p * p) % 4]) for p in (0, 2, 5, 9) for s in range(40) if (s + p) % 5]
    r = spark.createDataFrame(data, "protein_id string, seq_id long, pos int, aa string").repartition(5)
    want = Counter((a[0], a[2], b[2], a[3], b[3]) for a in data for b in data if a[1] == b[1] and a[2] < b[2])
    for count in (C.pair_counts, C.pair_counts_joined):  # a join leaves out what has no protein
        assert {tuple(x)[:5]: x.n for x in count(r).collect()} == {k: n for k, n in want.items() if k[0] or count is C.pair_counts}
        below = _plan(count(r)).rpartition("Exchange hashpartitioning(protein_id")[2]
        assert "MapInArrow" in below and "SortMergeJoin" not in _plan(count(r))


def test_joined_sequences_are_not_exploded(spark, sf):
    """Neither residues nor their pairs become rows: the windows of a text are all that is generated."""
    plan = _plan(registry.pair_counts_joined(spark, sf))
    assert plan.count("Generate ") == 1 and "explode(cells" not in plan


def test_rows_of_a_sequence_meet_in_any_block(spark):
    """Rows that share an id are one sequence, also where they overlap, lie in several tasks or end a block."""
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("ACDYW-. \u00e9") for _ in range(rng.randrange(14)))
    data = [(rng.choice(["p", "q", None]), rng.choice([None, *range(50)]), rng.choice([text(), text(), None])) for _ in range(200)]
    single = [(p, s, i, a) for p, s, t in data if p and s is not None for i, a in enumerate(t or "") if a in C.LETTERS]
    want = Counter((x[0], x[2], y[2], x[3], y[3]) for x in single for y in single if x[:2] == y[:2] and x[2] < y[2])
    rows = spark.createDataFrame(data, "protein_id string, seq_id long, aligned string").repartition(3)
    for block in (100, 1 << 25):
        assert {tuple(r)[:5]: r.n for r in C.joined_counts(rows, block_bytes=block).collect()} == want
    far = spark.createDataFrame([(p, s, i * 10**8 - 10**8, a) for p, s, i, a in single], "protein_id string, seq_id long, pos int, aa string").repartition(3)
    assert {(r[0], r[1] // 10**8 + 1, r[2] // 10**8 + 1, r[3], r[4]): r.n for r in C.pair_counts_joined(far).collect()} == want


def test_pairs_are_found_behind_many_empty_ones(spark):
    rows = spark.createDataFrame([("p", 1, "-" * 60 + "A" + "-" * 18 + "C")], "protein_id string, seq_id long, aligned string")
    assert [tuple(r) for r in C.joined_counts(rows).collect()] == [("p", 60, 79, "A", "C", 1)]


def test_bitmaps_take_little_beside_them():
    strings = pa.array(["ACDEFGHIKLMNPQRSTVWY-ACD"] * 300_000)
    tracemalloc.start()
    kernels.letter_bits(strings, C.LETTERS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


POINTS = "structure_id string, pos int, x double, y double, z double"


def test_contacts_of_a_dense_cell_are_spread_over_tasks(spark):
    """Three thousand points of one cell, as a shuffle joins them where neither side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ca = spark.range(3000).selectExpr("string(id div 3000) AS structure_id", "int(id) AS pos", "id / 1000 AS x", "id % 7 / 10 AS y", "id % 5 / 10 AS z")
        told = contacts.structural_contacts(ca).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in told) == 3000 * 2999 - 2 * (2999 + 2998)
    assert max(r["count"] for r in told) < 0.9 * 3000 * 2999


def _shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_points_are_sent_once_to_each_cell_around(spark):
    """Eight cells of 300 points in ten slices each: a point goes to eight cells and to the slices of its own, not to all eighty."""
    ca = spark.range(2400).selectExpr("'s' AS structure_id", "int(id) AS pos", "id % 2 * 8 + 1D AS x", "id div 2 % 2 * 8 + 1D AS y", "id div 4 % 2 * 8 + 1D + id / 1000 AS z")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled_rows(spark)
        contacts.structural_contacts(ca, tile=30).write.format("noop").mode("overwrite").save()
        sent = _shuffled_rows(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 2400 * (8 + 10) <= sent < 2400 * 30


def test_contacts_are_whole_in_many_tiles_and_slices(spark):
    rng = random.Random(6)
    data = [("s", i, *[rng.uniform(-9, 9) for _ in "xyz"]) for i in range(120)]
    want = sorted((a[1], b[1]) for a in data for b in data if abs(a[1] - b[1]) > 2 and sum((a[i] - b[i]) ** 2 for i in (2, 3, 4)) < 64)
    got = contacts.structural_contacts(spark.createDataFrame(data, POINTS), tile=2, most=7)
    assert sorted((r.pos, r.partner) for r in got.collect()) == want


def test_contacts_are_the_same_for_any_tile(spark):
    """Also with places that are null, not finite or beyond the numbers of cells."""
    rng = random.Random(5)
    data = [(s, i, *[rng.uniform(-12, 12) for _ in "xyz"]) for s in "ab" for i in range(90)]
    data += [("a", 100 + i, x, 0.0, 0.0) for i, x in enumerate([1e300, math.inf, -math.inf, math.nan, None])] + [("a", 110, 1e300, 0.0, 0.0), (None, 5, 0.0, 0.0, 0.0), (None, 9, 0.0, 0.0, 0.0)]
    whole = [r for r in data if r[0] and r[2] is not None]
    apart = lambda a, b: sum((a[i] - b[i]) * (a[i] - b[i]) for i in (2, 3, 4))
    want = sorted((a[0], a[1], b[1]) for a in whole for b in whole if a[0] == b[0] and abs(a[1] - b[1]) > 2 and apart(a, b) < 64)
    ca = spark.createDataFrame(data, POINTS)
    for tile in (5, 1024):
        assert sorted((r.structure_id, r.pos, r.partner) for r in contacts.structural_contacts(ca, tile=tile).collect()) == want
    assert ("a", 100, 110) in want
