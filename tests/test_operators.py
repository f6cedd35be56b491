"""Operators on small rows made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.functions import kernels
from helixlake.operators import coevolution as C
from helixlake.operators import contacts, features, heads, narrative, series, streams
from helixlake.sources import readers, writers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def _family(spark, n=60, width=14, seed=1):
    r = np.random.default_rng(seed)
    codes = r.integers(-1, 20, (n, width)).astype(np.int8)
    codes[:, 9] = codes[:, 1]
    data = [("f", s, p, C.LETTERS[codes[s, p]]) for s in range(n) for p in range(width) if codes[s, p] >= 0]
    return codes, spark.createDataFrame(data, "protein_id string, seq_id long, pos int, aa string")


def test_sparse_scores_equal_dense_ones(spark):
    codes, res = _family(spark)
    pos = res.select("protein_id", "pos").distinct()
    want = kernels.mutual_information_dense(codes, 20)
    for joined in (False, True):
        got = C.coevolution(C.cells_of_residues(res, joined=joined), pos).collect()
        for r in got:
            assert r.mi == pytest.approx(want[r.pos_i, r.pos_j], abs=1e-9)
    m = want.mean()
    for r in got:
        fixed = max(want[r.pos_i, r.pos_j] - want[r.pos_i].mean() * want[r.pos_j].mean() / m, 0)
        assert r.mi_apc == pytest.approx(fixed, abs=1e-9)
    best = C.select_partners(C.coevolution(C.cells_of_residues(res), pos), mi_threshold=0.3).select("pos", "partner")
    assert (1, 9) in rows(best) and (9, 1) in rows(best)


def test_few_pairs_score_zero_and_few_columns_give_nothing(spark):
    res = spark.createDataFrame([("f", s, p, "A") for s in range(9) for p in range(10)], "protein_id string, seq_id long, pos int, aa string")
    pos = res.select("protein_id", "pos").distinct()
    assert {r.mi for r in C.coevolution(C.cells_of_residues(res), pos).collect()} == {0.0}
    assert C.coevolution(C.cells_of_residues(res.filter("pos < 9")), pos.filter("pos < 9")).count() == 0


def test_partner_selection_rules(spark):
    mi = spark.createDataFrame([("p", 0, j, 0.5) for j in range(1, 20)] + [("p", 30, 40, 0.1)], "protein_id string, pos_i int, pos_j int, mi_apc double")
    got = C.select_partners(mi, top_k=3, mi_threshold=0.1, local_window=5).filter("pos = 0")
    assert sorted(r.partner for r in got.collect()) == [17, 18, 19]  # ties to the higher partner, near ones left out
    assert C.select_partners(mi).filter("pos = 30").count() == 0  # 0.1 is not above 0.1


def test_edges(spark):
    e = spark.createDataFrame([("p", 0, 5), ("p", 5, 0), ("p", 1, 99)], "protein_id string, pos int, partner int")
    p = spark.createDataFrame([("p", 10), ("q", 4)], "protein_id string, seq_len int")
    assert rows(C.symmetrize(e, p)) == [("p", 0, 5), ("p", 5, 0)]
    cover = {r.protein_id: r for r in C.coverage(C.symmetrize(e, p), p).collect()}
    assert (cover["p"].positions_with_partners, cover["p"].total_pairs, cover["p"].sparse) == (2, 1, True)
    assert cover["q"].mean_partners == 0.0
    other = spark.createDataFrame([("p", 2, 3), ("q", 1, 2)], "protein_id string, pos int, partner int")
    assert {(r.protein_id, r.method) for r in C.first_source(("a", e), ("b", other)).collect()} == {("p", "a"), ("q", "b")}
    assert C.overlay_edges(e, other).count() == 5


def test_reference_row_and_columns(spark):
    msa = spark.createDataFrame([("f", 1, "a", "-AC.DE"), ("f", 2, "b", "AC-DEF"), ("f", 3, "c", "ACdE--")], "protein_id string, seq_id long, seq_name string, aligned string")
    prot = spark.createDataFrame([("f", "ACDE", 4)], "protein_id string, sequence string, seq_len int")
    ref = C.reference_rows(msa, prot)
    assert ref.first().seq_id == 1 and ref.first().score == 4
    assert rows(C.column_map(ref)) == [("f", 1, 0), ("f", 2, 1), ("f", 4, 2), ("f", 5, 3)]
    melted = C.melt_residues(msa, C.column_map(ref))
    assert ("f", 3, 0, "C") in rows(melted) and melted.filter("seq_id = 3").count() == 2


def test_sample_and_pad(spark):
    msa = spark.createDataFrame([("f", i, f"s{i}", "A" * (i % 5 + 1)) for i in range(40)], "protein_id string, seq_id long, seq_name string, aligned string")
    assert C.sample_sequences(msa, 7).count() == 7
    assert {len(r.aligned) for r in C.pad_sequences(msa).collect()} == {5}


def test_contacts_at_the_limits(spark):
    ca = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0), ("s", 2, 1.0, 0.0, 0.0), ("s", 3, 7.9, 0.0, 0.0), ("s", 9, 8.0, 0.0, 0.0), ("s", 20, -7.0, 0.0, 0.0)], "structure_id string, pos int, x double, y double, z double")
    got = {(r.pos, r.partner) for r in contacts.structural_contacts(ca).collect()}
    assert (0, 3) in got and (3, 0) in got and (0, 20) in got
    assert (0, 2) not in got and (0, 9) not in got


def test_softmax_and_ranks(spark):
    logits = spark.createDataFrame([("p", 0, 0, i, t, x) for i, (t, x) in enumerate([("A", 1000.0), ("C", 1000.0), ("D", 999.0)])], "protein_id string, pos int, layer int, token_id int, token string, logit double")
    probs = series.softmax(logits)
    assert probs.agg(F.sum("prob")).first()[0] == pytest.approx(1)
    truth = lambda t: spark.createDataFrame([("p", 0, t)], "protein_id string, pos int, token string")
    assert series.correct_rank(probs, truth("C")).first().correct_rank == 1
    assert series.correct_rank(probs, truth("D")).first().correct_rank == 3
    assert [r.token for r in series.top_tokens(probs, 2).orderBy("rank").collect()] == ["A", "C"]


def test_velocity_and_spectra(spark):
    vec = [[1.0, 0.0], [3.0, 0.0], [3.0, 4.0]]
    hidden = spark.createDataFrame([("p", 0, i, v) for i, v in enumerate(vec)], "protein_id string, pos int, layer int, vec array<float>")
    ans = spark.createDataFrame([("p", 0, "A", [1.0, 0.0])], "protein_id string, pos int, aa string, direction array<double>")
    assert rows(series.velocity(hidden, ans)) == [("p", 0, 0, 2.0, 2.0), ("p", 0, 1, 0.0, 4.0)]
    power = series.spectrum(hidden.withColumn("kind", F.lit("total")))
    assert power.agg(F.sum(F.col("power") * F.col("power"))).first()[0] == pytest.approx(np.square(vec).sum())
    c = series.scalar_spectrum(hidden.select("pos", "layer", F.get("vec", F.lit(0)).cast("double").alias("x")), "x", "pos")
    assert [r.coefficient for r in c.orderBy("k").collect()] == pytest.approx((kernels.cosine_basis(3) @ [1, 3, 3]).tolist())


def test_race_and_trajectories(spark):
    run = spark.createDataFrame([("p", 0, l, a, p) for l, a, p in [(0, "A", 0.5), (0, "C", 0.5), (1, "A", 0.2), (1, "C", 0.8), (2, "A", 0.2), (2, "C", 0.8)]], "protein_id string, pos int, layer int, aa string, prob double")
    change = series.lead_changes(run).first()
    assert (change.layer, change.from_aa, change.to_aa, change.from_pct, change.to_pct) == (1, "A", "C", 50.0, 80.0)
    best = series.trajectories(run, 1).first()
    assert (best.aa, best.peak_layer, best.final) == ("C", 1, 0.8)
    named = series.named_trajectories(series.trajectories(run, 1)).first()
    assert (named.name, named.group, named.final_prob, named.peak_prob, named.waypoints) == ("Cysteine", "special", 80.0, 80.0, {"0": 50.0})
    other = series.named_trajectories(series.trajectories(run.filter("aa = 'A'").withColumn("aa", F.lit("click")), 1)).first()
    assert (other.name, other.group) == ("click", "unknown")


def test_velocity_events(spark):
    v = spark.createDataFrame([("p", 0, 0, 0.5, 1.0, 0.1), ("p", 0, 1, -0.9, 0.1, 0.1), ("p", 0, 2, 0.49, 1.0, 1.0)], "protein_id string, pos int, layer int, answer double, attention double, mlp double")
    assert rows(series.key_velocity_events(v), "rank") == [("p", 0, 2, -0.9, 0.1, 0.1, "both", "away from", 1), ("p", 0, 1, 0.5, 1.0, 0.1, "attention", "toward", 2)]


def test_head_classes_at_the_limits(spark):
    data = [(0, 0.3, 0.5, 0.5, 0.5), (1, 0.31, 0.1, 0.11, 0.0), (2, 0.31, 0.11, 0.0, 0.0), (3, -0.5, 0.0, 0.0, 0.16), (4, -0.5, 0.0, 0.0, 0.15), (5, 0.29, 1.0, 1.0, 1.0)]
    scored = spark.createDataFrame([("p", 0, 0, *r) for r in data], "protein_id string, pos int, layer int, head int, projection double, attn_structural double, attn_coevolving double, attn_local double")
    got = {r.head: r.type for r in heads.classify_heads(scored).collect()}
    assert got == {0: "other", 1: "writes_coevolving", 2: "writes_structural", 3: "erases_local", 4: "erases_no_clear_source"}


def test_sources_of_several_kinds(spark):
    att = spark.createDataFrame([("p", 5, 0, 0, 6, 0.01), ("p", 5, 0, 0, 5, 0.5), ("p", 5, 0, 0, 9, 0.009)], "protein_id string, pos int, layer int, head int, src int, weight double")
    edges = spark.createDataFrame([("p", "structural", 5, 6), ("p", "coevolving", 5, 6)], "protein_id string, kind string, pos int, partner int")
    lab = heads.labelled_attention(att, edges)
    cat = heads.attention_by_category(lab).first()
    assert (cat.attn_structural, cat.attn_coevolving, cat.attn_local) == (0.01, 0.01, pytest.approx(0.019))
    scored = spark.createDataFrame([("p", 5, 0, 0, 0.3)], "protein_id string, pos int, layer int, head int, projection double")
    prot = spark.createDataFrame([("p", "ACDEFGHIKL")], "protein_id string, sequence string")
    top = heads.top_sources(lab, scored, prot).orderBy("rank").collect()
    assert [(r.src, r.aa, r.labels) for r in top] == [(5, "G", []), (6, "H", ["structural", "coevolving", "local"])]


def test_head_outputs_equal_numpy(spark):
    r = np.random.default_rng(0)
    att, val, w, b = r.random(5), r.random((5, 3)), r.random((3, 4)), r.random(4)
    a = spark.createDataFrame([("p", 0, 0, 0, t, float(att[t])) for t in range(5)], "protein_id string, pos int, layer int, head int, token int, weight double")
    v = spark.createDataFrame([("p", 0, 0, 0, t, val[t].tolist()) for t in range(5)], "protein_id string, pos int, layer int, head int, token int, vec array<double>")
    weights = spark.createDataFrame([(0, 0, w.tolist(), b.tolist())], "layer int, head int, rows array<array<double>>, bias_share array<double>")
    assert np.allclose(heads.head_outputs(a, v, weights).first().vec, att @ val @ w + b)


def test_streams_recover_the_planted_core(spark):
    r = np.random.default_rng(1)
    data = []
    for pos in range(5):
        for h in range(8):
            v = r.normal(size=12) * 0.02
            v[0 if h < 3 else 1] += 1
            data.append(("p", pos, 0, h, v.tolist()))
    ho = spark.createDataFrame(data, "protein_id string, pos int, layer int, head int, vec array<double>")
    g = streams.cluster_heads(ho).persist()
    assert g.count() == 5 and all(r.isolated == [0, 1, 2] for r in g.collect())
    cores = streams.consistent_cores(g)
    assert cores.first().core == [0, 1, 2] and cores.first().consistency == 1.0
    assert streams.group_consistency(g, cores).first().consistency == 1.0
    assert streams.core_statistics(g, cores).first().n == 5
    m = streams.core_metrics(ho, cores).collect()
    assert len(m) == 5 and all(abs(x.inter_cos) < 0.1 and x.anchor in (0, 1, 2) for x in m)
    assert streams.detection_rates(g, ho.select("protein_id", "pos")).first().rate == 1.0
    assert streams.co_clustering(streams.assignments(g)).filter("head_i = 0 AND head_j = 2").first().frequency == 1.0
    assert streams.centroid_cosines(ho).count() == 40


def test_patches_keep_other_fields(spark):
    records = spark.createDataFrame([("p", 0, ("old", 7, None)), ("p", 1, None)], "protein_id string, position int, stream_analysis struct<layer_streams:string,keep:int,validation_metadata:string>")
    out = streams.patch_streams(records, spark.createDataFrame([("p", 0, "new")], "protein_id string, pos int, layer_streams string"), spark.createDataFrame([("p", "m")], "protein_id string, validation_metadata string"))
    assert tuple(out.filter("position = 0").first().stream_analysis) == ("new", 7, "m")
    fresh = spark.createDataFrame([("p", 0, ("x", 1, None)), ("p", 1, ("y", 2, None))], records.schema)
    got = {r.position: r.stream_analysis.layer_streams for r in streams.patch_missing(records, fresh).collect()}
    assert got == {0: "old", 1: "y"}
    assert {r.stream_analysis.layer_streams for r in streams.patch_missing(records, fresh, force=True).collect()} == {"x", "y"}


def test_feature_operators(spark):
    dec = spark.createDataFrame([(1, i, [float(i == 0), float(i == 1), 0.1 * i]) for i in range(5)], "sae_layer int, feature_id long, vec array<double>")
    vec = spark.createDataFrame([("p", 0, 1, [1.0, 2.0, 0.0])], "protein_id string, pos int, sae_layer int, vec array<double>")
    top = features.feature_projections(vec, dec, ("protein_id", "pos"), most=2, lowest=1).orderBy("side", "rank").collect()
    assert [r.feature_id for r in top if r.side == 1] == [1, 0]
    lists = spark.createDataFrame([("p", 0, 3, "attn", 5, 0.5), ("p", 0, 3, "mlp", 5, -0.7), ("p", 0, 3, "mlp", 6, 0.1)], "protein_id string, pos int, layer int, source string, feature_id long, proj double")
    labels = spark.createDataFrame([(3, 5, "helix")], "layer int, feature_id long, summary string")
    s = features.feature_summary(lists, labels).orderBy("rank").collect()
    assert [(r.ref, r.source, r.summary) for r in s] == [("F3:5", "mlp", "helix"), ("F3:6", "mlp", None)]
    recs = spark.createDataFrame([("p", 0, {"9": (["h"], ["a"])})], "protein_id string, position int, sae_features map<string,struct<hidden_state_top_features:array<string>,attn_top_features:array<string>>>")
    fresh = spark.createDataFrame([("p", 0, "9", ["H"]), ("p", 0, "18", ["N"])], "protein_id string, position int, layer string, features array<string>")
    m = features.patch_hidden_features(recs, fresh).first().sae_features
    assert tuple(m["9"]) == (["H"], ["a"]) and tuple(m["18"]) == (["N"], None)


def test_projections_in_blocks_equal_full_products(spark):
    """Features in tight clusters, so that bounds rule parts out; ties go to the lower id; layers without a dictionary drop out."""
    rng = np.random.default_rng(4)
    centres = np.eye(6) * 5
    dictionary = {(l, f): (centres[f // 8] + rng.normal(0, 0.05, 6)).tolist() for l in (1, 2) for f in range(48)}
    dictionary[1, 9] = dictionary[1, 8]
    vecs = {(l, n): rng.normal(0, 1, 6).tolist() for l in (1, 2, 3) for n in range(25)}
    v = spark.createDataFrame([(f"k{n}", n, l, x) for (l, n), x in vecs.items()], "name string, n2 int, sae_layer int, vec array<double>")
    d = spark.createDataFrame([(l, f, x) for (l, f), x in dictionary.items()], "sae_layer int, feature_id long, vec array<double>")
    got = features.feature_projections(v, d, ("name", "n2"), most=4, lowest=3, size=8, block=3).collect()
    want = set()
    for (l, n), x in vecs.items():
        p = sorted((-float(np.dot(x, y) / (np.linalg.norm(y) + 1e-10)), f) for (m, f), y in dictionary.items() if m == l)
        want |= {(f"k{n}", n, l, f, 1, r + 1) for r, (_, f) in enumerate(p[:4])} | {(f"k{n}", n, l, f, -1, r + 1) for r, (_, f) in enumerate(sorted((-q, f) for q, f in p)[:3])}
    assert {(r.name, r.n2, r.sae_layer, r.feature_id, r.side, r.rank) for r in got} == want
    x = np.array([[1.0, 0, 0, 0, 0, 0]])
    assert features.needed_parts(x, np.eye(6), np.full(6, 0.1), np.full(6, 8), 4).tolist() == [True] + [False] * 5
    assert features.needed_parts(x, np.eye(6), np.full(6, 0.1), np.full(6, 3), 4).all()


def test_neurons(spark):
    act = spark.createDataFrame([("p", 0, 12, n, a) for n, a in enumerate([0.5, -0.2, 0.0, 1.0])], "protein_id string, pos int, layer int, neuron int, act double")
    gain = spark.createDataFrame([(12, n, a, g) for n in range(4) for a, g in (("A", 1.0), ("C", -1.0))], "layer int, neuron int, aa string, gain double")
    ans = spark.createDataFrame([("p", 0, "A")], "protein_id string, pos int, aa string")
    pushed = features.neuron_push(act, gain, ans)
    assert tuple(features.neuron_census(pushed).first())[3:] == (2, pytest.approx(1.3))
    top = features.top_neurons(pushed)
    assert [r.neuron for r in top.filter("kind = 'writer'").orderBy("rank").collect()] == [3, 0, 1]  # the inactive one is dropped
    summary = features.neuron_summary(features.neuron_letters(top, gain)).filter("kind = 'eraser' AND rank = 1").first()
    assert (summary.ref, summary.votes) == ("N12:1", ["C", "A"])


def test_references(spark):
    text = "F5 and F18:5372 near L30 then F5372, N9; layer 18 F5372 but F777"
    leaves = spark.createDataFrame([("p", 0, "story", text)], "protein_id string, pos int, path string, text string")
    ids = spark.createDataFrame([("p", 0, "F", 5372, 18, 0.4), ("p", 0, "F", 5372, 33, 0.9), ("p", 0, "F", 5, 9, -0.1), ("p", 0, "N", 9, 20, 0.3)], "protein_id string, pos int, kind string, ref_id int, layer int, proj double")
    out = narrative.qualify(leaves, narrative.reference_map(ids)).first()
    assert out.rewritten == "F9:5 and F18:5372 near L30 then F33:5372, N20:9; layer 18 F18:5372 but F777"
    assert out.replacements == 4


def test_nearest_mentions_equal_all_pairs(spark):
    """Against every reference with every mention of a text."""
    import random
    import re

    rng = random.Random(2)
    texts = ["".join(rng.choice([f"F{rng.randint(1, 99)} ", f"L{rng.randint(0, 33)} ", f"layer {rng.randint(0, 33)} ", "layer" + " " * 70 + "7 ", "N5, ", "x" * rng.randint(1, 60) + " ", "F3:4 "]) for _ in range(60)) for _ in range(12)]
    leaves = spark.createDataFrame([("p", i, "story", t) for i, t in enumerate(texts)], "protein_id string, pos int, path string, text string")
    got = {(r.pos, r.kind, r.at): (r.ref_id, r.near) for r in narrative.nearest_mention(narrative.bare_references(leaves), narrative.layer_mentions(leaves)).collect()}
    want = {}
    for i, t in enumerate(texts):
        mentions = [(m.start(), m.end(), f, int(m[1])) for f, p in enumerate((r"\bL(\d+)\b", r"(?i)\blayer\s+(\d+)\b")) for m in re.finditer(p, t)]
        for m in re.finditer(r"\b([FN])(?!\d+:)(\d+)\b", t):
            near = [(abs(a - m.start()), f, a, n) for a, e, f, n in mentions if a >= m.start() - 80 and e <= m.start() + 80]
            want[i, m[1], m.start()] = (int(m[2]), min(near)[3] if near else None)
    assert got == want


def test_a_text_with_very_many_references(spark):
    text = "L7 " + "F1 N2 " * 50_000
    leaves = spark.createDataFrame([("p", 0, "story", text)], "protein_id string, pos int, path string, text string")
    near = narrative.nearest_mention(narrative.bare_references(leaves), narrative.layer_mentions(leaves))
    assert near.count() == 100_000 and near.filter("near = 7").count() == 26


def test_text_leaves_and_attached_narratives(spark):
    rows_ = spark.createDataFrame([("p", 0, "s", ["a", None, "b"]), ("p", 1, None, None)], "protein_id string, pos int, story string, key_layers array<string>")
    leaves = narrative.text_leaves(rows_, {"story": (F.col("story"), False), "key_layers": (F.col("key_layers"), True)})
    assert rows(leaves) == [("p", 0, "key_layers#1", "a"), ("p", 0, "key_layers#3", "b"), ("p", 0, "story#0", "s")]
    run = spark.createDataFrame([("p", 0, l, a, x) for l, a, x in [(0, "A", 0.6), (0, "C", 0.4), (1, "A", 0.3), (1, "C", 0.7)]], "protein_id string, pos int, layer int, aa string, prob double")
    records = spark.createDataFrame([("p", 0), ("p", 5)], "protein_id string, position int")
    told = spark.createDataFrame([("p", 0, "n")], "protein_id string, pos int, narrative string")
    out = {r.position: r for r in narrative.attach(records, told, series.trajectories(run), series.lead_changes(run)).collect()}
    assert (out[0].equation_narrative, [t.aa for t in out[0].candidate_trajectories], [tuple(c) for c in out[0].lead_changes]) == ("n", ["C", "A"], [(1, "A", "C", 60.0, 70.0)])
    assert tuple(out[5])[2:] == (None, None, None)


def test_parsing_and_context(spark):
    data = spark.createDataFrame([(1, '```json\n{"k": 1}\n```'), (2, '{"k": '), (3, '{"j": 1}'), (4, None)], "id int, raw string")
    good, bad = narrative.parse_generated(data, schema="k int", required=("k",))
    assert [(r.id, r.narrative.k) for r in good.collect()] == [(1, 1)]
    assert {r.id: r.reason for r in bad.collect()} == {2: "not JSON", 3: "missing k", 4: "no text"}
    seq = spark.createDataFrame([("ABCDEFGHIJKLM", 0), ("ABCDEFGHIJKLM", 7)], "s string, p int")
    assert [r[0] for r in seq.select(narrative.sequence_context(F.col("s"), F.col("p"))).collect()] == ["[A]BCDEF...", "...CDEFG[H]IJKLM"]


def test_readers(spark, tmp_path):
    sto = "# STOCKHOLM 1.0\n#=GF ID Fam\n#=GF AC PF1.25\nA/1 AC-\nB/1 ACD\n#=GC c x\n\nA/1 DE\nB/1 EF\none two three\n//\n# STOCKHOLM 1.0\n#=GF AC PF2.1\nZ AA\n//\n"
    (tmp_path / "a.sto").write_text(sto)
    fam = readers.read_families(spark, str(tmp_path / "a.sto"))
    assert sorted(r.accession for r in fam.collect()) == ["PF1", "PF2"]
    one = readers.select_families(fam, ["PF1"])
    assert rows(readers.parse_stockholm(one).select("seq_name", "aligned")) == [("A/1", "AC-DE"), ("B/1", "ACDEF")]
    (tmp_path / "a.fa").write_text(">x\nAC\nDE\n>empty\n>y z\nGG\n")
    assert rows(readers.read_fasta(spark, str(tmp_path / "a.fa"), "f").select("seq_name", "aligned")) == [("x", "ACDE"), ("y z", "GG")]
    files = spark.createDataFrame([("f", "a", ">x\nAC\n>e\n"), ("g", "b", sto), ("h", "c", "what")], "protein_id string, path string, text string")
    msa, bad = readers.parse_alignments(files)
    assert msa.filter("protein_id = 'f'").count() == 1 and [r.path for r in bad.collect()] == ["c"]


def test_pdb(spark):
    line = lambda rec, atom, chain, num, x: f"{rec:<6}    1 {atom:<4} ALA {chain}{num:>4}    {x:8.3f}{0:8.3f}{0:8.3f}"
    data = [line("ATOM", " CA", "A", 1, 1), line("ATOM", " CA", " ", 2, 2), line("ATOM", " CA", "B", 3, 3), line("HETATM", " CA", "A", 4, 4), line("ATOM", " CB", "A", 5, 5), line("ATOM", " CA", "A", 0, 6), line("ATOM", " CA", "A", 1, 7), line("ATOM", " CA", "A", 99, 8)]
    lines = spark.createDataFrame([("s", i, v) for i, v in enumerate(data)], "structure_id string, line_no int, value string")
    prot = spark.createDataFrame([("s", 10)], "structure_id string, seq_len int")
    ca = readers.parse_pdb(lines, prot)
    assert rows(ca) == [("s", 0, 7.0, 0.0, 0.0), ("s", 1, 2.0, 0.0, 0.0)]
    assert readers.structure_coverage(ca, prot).first().sparse


def test_results_and_records_round_trip(spark, tmp_path):
    prot = spark.createDataFrame([("p", "ACDEFGHIKL", 10)], "protein_id string, sequence string, seq_len int")
    edges = spark.createDataFrame([("p", 0, 9), ("p", 9, 0)], "protein_id string, pos int, partner int")
    mi = spark.createDataFrame([("p", 0, 9, 0.12345), ("p", 1, 2, 0.01)], "protein_id string, pos_i int, pos_j int, mi_apc double")
    out = writers.coevolution_result(prot, edges, mi, C.coverage(edges, prot))
    out.write.json(str(tmp_path / "r"))
    back = readers.read_coevolution(spark, str(tmp_path / "r" / "*.json"))
    assert rows(readers.map_edges(back, "coevolution_map", "protein")) == [("p", 0, 9), ("p", 9, 0)]
    assert [tuple(r) for r in readers.matrix_scores(back).collect()] == [("p", 0, 9, 0.1234)]
    meta = writers.metadata(prot, edges, edges, C.LETTERS).first()
    assert meta.structural_contacts == {"0": [9], "9": [0]} and len(meta.amino_acids) == 20
    cells = spark.createDataFrame([("p", 0, 1, 2, 0.5)], "protein_id string, pos int, layer int, head int, v double")
    assert writers.matrix(cells, "v", 2, 3).first().matrix == [[0, 0, 0], [0, 0, 0.5]]
    rec = writers.position_records(edges.select("protein_id", "pos").distinct(), {"m": writers.matrix(cells, "v", 2, 3)})
    writers.write_records(rec, str(tmp_path / "records"))
    assert spark.read.json(str(tmp_path / "records")).count() == 2
    (tmp_path / "pos").mkdir()
    (tmp_path / "pos" / "pos_3.json").write_text('{"a": 1}')
    (tmp_path / "pos" / "pos_4.json").write_text('{"a": 2}')
    assert [(r.a, r.position) for r in readers.read_records(spark, str(tmp_path / "pos"), "a int", [4, 77]).collect()] == [(2, 4)]
    (tmp_path / "labels.json").write_text('{"features": {"9": {"5": {"summary": "s", "top_aas": [{"aa": "A", "enrichment": 2.0}]}}}}')
    lab = readers.read_feature_labels(spark, str(tmp_path / "labels.json")).first()
    assert (lab.layer, lab.feature_id, lab.summary) == (9, 5, "s")
