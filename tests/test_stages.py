"""Stages that are resumed, and families read in pieces."""

import pytest
from pyspark.sql import functions as F

from helixlake.functions import kernels
from helixlake.operators import coevolution as C
from helixlake.sources import readers
from helixlake.storage import Stages


def _run(stages, source, factor=2, broken=False):
    def third(b):
        if broken:
            raise RuntimeError("lost")
        return b.agg(F.sum("x").alias("total"))

    a = stages.stage("first", lambda s: s.select((F.col("id") + 1).alias("x")), source)
    b = stages.stage("second", lambda t, factor: t.select((F.col("x") * factor).alias("x")), a, factor=factor)
    return stages.stage("third", third, b)


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    source, folder = spark.read.parquet(str(tmp_path / "in")), f"file://{tmp_path}/run"
    first = Stages(spark, folder)
    with pytest.raises(RuntimeError):
        _run(first, source, broken=True)
    assert first.computed == ["first", "second"]
    again = Stages(spark, folder)
    assert _run(again, source).first().total == 30 and again.computed == ["third"]
    rest = Stages(spark, folder)
    assert _run(rest, source).first().total == 30 and rest.computed == []
    assert {(r.stage, r.n_rows) for r in rest.manifest().collect()} == {("first", 5), ("second", 5), ("third", 1)}
    other = Stages(spark, folder)
    assert _run(other, source, factor=3).first().total == 45 and other.computed == ["second", "third"]
    spark.range(7).write.mode("append").parquet(str(tmp_path / "in"))
    grown = Stages(spark, folder)
    _run(grown, spark.read.parquet(str(tmp_path / "in")))
    assert grown.computed == ["first", "second", "third"]
    grown.forget("third")
    last = Stages(spark, folder)
    _run(last, spark.read.parquet(str(tmp_path / "in")))
    assert last.computed == ["third"]


def _bulk(n=30, lines=40):
    text, want = [], []
    for k in range(n):
        text += ["# STOCKHOLM 1.0", f"#=GF ID fam{k}", f"#=GF AC PF{k:05}.{k % 4}"]
        text += [f"s{i}  {'ACDE'[i % 4] * 9}" for i in range(lines)] + ["", "#=GC x y"] + [f"s{i} {'KLMN'[i % 4] * 3}" for i in range(lines)] + ["//"]
        want += [(f"PF{k:05}", f"s{i}", "ACDE"[i % 4] * 9 + "KLMN"[i % 4] * 3) for i in range(lines)]
    return "\n".join(text) + "\n", want


@pytest.mark.parametrize("size", ["700b", "128m"])
def test_families_across_input_splits(spark, tmp_path, size):
    """Splits of 700 bytes begin amid families of 1.3 kB."""
    text, want = _bulk()
    (tmp_path / "bulk").mkdir()
    (tmp_path / "bulk" / "a.txt").write_text(text)
    (tmp_path / "bulk" / "b.txt").write_text("lost x\n//\n#=GF AC PF00001.9\ns0 WWW\n//\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "700b" else "4m")
        scanned = readers.scan_lines(spark, str(tmp_path / "bulk"))
        assert (scanned.select("file", "block").distinct().count() > 10) == (size == "700b")
        one = readers.read_family_lines(spark, str(tmp_path / "bulk" / "a.txt"))
        assert sorted((r.protein_id, r.seq_name, r.aligned) for r in readers.parse_stockholm_lines(one).collect()) == sorted(want)
        chosen = readers.read_family_lines(spark, str(tmp_path / "bulk"), ["PF00001", "PF00007"])
        assert {(r.family, r.accession) for r in chosen.select("family", "accession").distinct().collect()} == {("fam1", "PF00001"), ("PF00001", "PF00001"), ("fam7", "PF00007")}
        assert readers.read_family_lines(spark, str(tmp_path / "bulk"), ["PF9"]).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", ["150b", "128m"])
def test_families_are_named_as_lines_are_read(spark, tmp_path, size):
    """Fields that stand late, twice or not at all, in small batches and splits, against a reading by hand; what was found out before is stored."""
    rng = __import__("random").Random(3)
    (tmp_path / "bulk").mkdir()
    want = []
    for name in "ab":
        text = []
        for k in range(60):
            family = [f"s{i} {'ACDE'[i % 4] * rng.randint(1, 9)}" for i in range(rng.randint(0, 12))]
            for field in (f"#=GF AC PF{k % 9}.{k}", f"#=GF ID fam{k}", f"#=GF  AC\tX{k}", "#=GF DE more", f"#=GF ID late{k}", ""):
                if rng.random() < 0.6:
                    family.insert(rng.choice([0, 0, rng.randint(0, len(family))]), field)
            fields = [line.split() for line in family if line.startswith(("#=GF AC", "#=GF  AC", "#=GF ID"))]
            accession = next((f[2].split(".")[0] for f in fields if f[1] == "AC"), None)
            family = [*family, "//"] if k < 59 else family
            known = next((f[2] for f in fields if f[1] == "ID"), accession)
            want += [(known, accession, line) for line in family if known]
            text += family
        (tmp_path / "bulk" / f"{name}.txt").write_text("\n".join(text) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "150b" else "4m")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        lines = readers.read_family_lines(spark, str(tmp_path / "bulk"))
        assert lines._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
        told = lambda rows: sorted(map(str, rows))
        assert told((r.family, r.accession, r.value) for r in lines.collect()) == told(want)
        some = readers.read_family_lines(spark, str(tmp_path / "bulk"), ["PF3"])
        assert told((r.family, r.accession, r.value) for r in some.collect()) == told(w for w in want if w[1] == "PF3")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bitmaps_count_as_gathered_rows(spark):
    rng = __import__("random").Random(5)
    rows = [(f"f{i % 3}" if i % 7 else None, i, "".join(rng.choices(C.LETTERS + "-.xé", k=rng.randint(0, 12)))) for i in range(300)]
    msa = spark.createDataFrame([*rows, ("f1", 999, None)], "protein_id string, seq_id long, aligned string")
    got = {tuple(r)[:5]: r.n for r in C.cell_counts(msa, block_bytes=50).collect()}
    want = {}
    for protein, _, s in rows:
        cells = [(p, c) for p, c in enumerate(s) if c in C.LETTERS]
        for x, (i, a) in enumerate(cells):
            for j, b in cells[x:]:
                want[protein, i, j, a, b] = want.get((protein, i, j, a, b), 0) + 1
    assert got == want
    assert C.cell_counts(msa.filter("false")).count() == 0
    assert kernels.letter_bits(__import__("pyarrow").array([], "string"), "AC").shape == (0, 2, 0)


def test_sample_is_the_first_by_digest(spark):
    import hashlib

    msa = spark.createDataFrame([(f"f{i % 2}", i, f"s{i // 4}", "A") for i in range(400)], "protein_id string, seq_id long, seq_name string, aligned string")
    for digits in (1, 4):
        got = {(r.protein_id, r.seq_id) for r in C.sample_sequences(msa, 30, digits=digits).collect()}
        rank = lambda i: (hashlib.md5(f"42:s{i // 4}".encode()).hexdigest(), f"s{i // 4}", i)
        assert got == {(f"f{k}", i) for k in (0, 1) for i in sorted(range(k, 400, 2), key=rank)[:30]}


def test_chosen_records(spark, tmp_path):
    from helixlake.sources import writers

    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": '), (3, '{"a": 3}'), (5, "")], "position int, text string")
    folder = writers.write_position_files(rows, f"file://{tmp_path}/positions")
    (tmp_path / "positions" / "pos_x.json").write_text("no position")
    chosen = spark.createDataFrame([(1,), (1,), (2,), (4,), (5,), (None,)], "position long")
    good, bad = readers.choose_records(spark, folder, "a int", chosen)
    assert [(r.position, r.a) for r in good.collect()] == [(1, 1)]
    assert sorted((r.position, r.reason) for r in bad.collect()) == [(2, "broken"), (4, "absent"), (5, "absent")]


def test_chosen_records_are_opened_by_name(spark, tmp_path):
    """No folder gets large and no names are listed; files that lie flat are found too."""
    from helixlake.sources import writers

    numbers = [1, 9_999, 10_000, 25_000, 25_001]
    rows = spark.createDataFrame([(p, f'{{"a": {p}}}') for p in [*numbers, None]], "position int, text string").coalesce(1)
    folder = writers.write_position_files(rows, f"file://{tmp_path}/positions")
    at = tmp_path / "positions"
    assert {p.name: len(list(p.glob("pos_*.json"))) for p in at.iterdir()} == {"0": 2, "1": 1, "2": 2}
    (at / "pos_77.json").write_text('{"a": 77}')
    good, bad = readers.choose_records(spark, folder, "a int", spark.createDataFrame([(p,) for p in (1, 10_000, 25_001, 77, 3, 123_456)], "position int"))
    assert sorted((r.position, r.a) for r in good.collect()) == [(1, 1), (77, 77), (10_000, 10_000), (25_001, 25_001)]
    assert sorted((r.position, r.reason) for r in bad.collect()) == [(3, "absent"), (123_456, "absent")]
    assert all("binaryFile" not in df._jdf.queryExecution().toString() for df in (good, bad))
    assert {r.position for r in readers.read_records(spark, folder, "a int").collect()} == {*numbers, 77}
