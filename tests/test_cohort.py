from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import identifiers as I
from fieldloom.operators import cohort as C
from fieldloom.operators import effects as E
from fieldloom.operators import matching as N
from fieldloom.operators import negbin as B
from fieldloom.plans import differential as D
from fieldloom.sources import files as S


def test_names(spark):
    df = spark.createDataFrame([("Run_FOV00012__x.csv",), ("a_F0007_patch_3.txt",), ("none",)], "n string")
    n = F.col("n")
    rows = df.select(I.fov_token(n).alias("t"), I.fov_index(n).alias("i"), I.patch_index(n).alias("p"), I.image_stem(n).alias("s")).collect()
    assert [(r["t"], r["i"], r["p"]) for r in rows] == [("F00012", 12, None), ("F0007", None, 3), (None, None, None)]
    assert rows[0]["s"] == "Run_FOV00012__x"
    assert I.column_fragment(" a/b-c ") == "a_b_c"
    names = spark.createDataFrame([("f10",), ("f2",), ("f002b",), ("F1",)], "n string")
    assert [r[0] for r in names.orderBy(I.natural_key(n), "n").collect()] == ["F1", "f2", "f002b", "f10"]


def test_crop_round_trip(spark):
    df = spark.createDataFrame([("F1", 3, "C 1_x", 7)], "f string, p int, c string, l int")
    stem = df.select(I.crop_key(*(F.col(c) for c in "fpcl")).alias("s"))
    assert stem.first()["s"] == "field_F1_patch_3_cellline_C_1_x_localid_7"
    assert tuple(stem.select(*I.crop_fields(F.col("s")).values()).first()) == ("F1", 3, "C_1_x", 7)


def test_classifier_errors(spark):
    good = spark.createDataFrame([("x/field_F1_patch_0_cellline_A_localid_2.png", "1", "0.5"), ("x/bad.png", "0", None)], "image_name string, predicted_class string, sigmoid_logits string")
    with pytest.raises(ValueError, match="bad.png"):
        C.classifier_table(good, "T5R5")
    row = C.classifier_table(good.limit(1), "T5R5").first()
    assert (row["slide"], row["local_id"], row["labels"]) == ("t5r5", 2, "A")
    with pytest.raises(ValueError, match="predicted_class"):
        C.classifier_table(good.drop("predicted_class"), "x")


def test_merge_takes_first_row(spark):
    cells = spark.createDataFrame([("T5R5", 1), ("T5R5", 2)], "slide string, local_id int")
    classes = spark.createDataFrame([("t5r5", 1, "b", 2), ("t5r5", 1, "a", 1)], "slide string, local_id int, predicted_class string, line int")
    merged = {r["local_id"]: r["predicted_class"] for r in C.merge_classes(cells, classes, ["slide", "local_id"], ["line"]).collect()}
    assert merged == {1: "a", 2: None}


def test_adjustment_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", None), ("a", 0.04), ("b", 0.5)], "line string, p double")
    got = sorted((r["line"], r["p"], r["p_adj"]) for r in E.adjusted(df, ["line"]).where("p is not null").collect())
    assert got == [("a", 0.01, 0.04), ("a", 0.03, 0.04), ("a", 0.04, 0.04), ("a", 0.04, 0.04), ("b", 0.5, 0.5)]
    assert E.adjusted(df, ["line"]).where("p is null").first()["p_adj"] is None


def test_size_factors(spark):
    cells = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "cell long, cell_line string")
    counts = spark.createDataFrame([(1, "g", 2), (2, "g", 6)], "cell long, gene string, n int")
    assert {r["cell"]: r["size_factor"] for r in E.size_factors(cells, counts).collect()} == {1: 0.5, 2: 1.5, 3: 0.5e-3}


def test_name_matching(spark):
    left = spark.createDataFrame([("abcdefghij.tif",), ("abcdefghix.tif",), ("zzz.tif",), ("abcdefghijklmnopqrstuv.tif",)], "name string")
    right = spark.createDataFrame([("abcdefghij.txt",), ("abcdefghij.csv",), ("abcdefghijklmnopqrstux.txt",)], "name string")
    got = {r["name"]: (r["match"], r["mode"]) for r in N.match_names(left, right).collect()}
    assert got["abcdefghij.tif"] == ("abcdefghij.csv", "exact")
    assert got["abcdefghix.tif"] == (None, "none")  # a ratio of just 0.9 isn't above it
    assert got["abcdefghijklmnopqrstuv.tif"] == ("abcdefghijklmnopqrstux.txt", "fuzzy") and got["zzz.tif"] == (None, "none")


def test_alignment_error(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "fov int, object_idx int")
    with pytest.raises(ValueError, match="differ"):
        N.aligned(a, a.limit(1).withColumn("polygon", F.lit(0)), ["fov", "object_idx"], ["fov"])


def test_log_gamma():
    x = np.array([0.01, 0.5, 1.0, 3.3, 12.0, 400.0])
    assert B.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)


def simulated(spark, effect: float, n: int = 160, genes: int = 12, seed: int = 1):
    rng = np.random.default_rng(seed)
    group = np.arange(n) % 2
    depth = rng.uniform(0.6, 1.6, n)
    rows = []
    for g in range(genes):
        mu = 8 * depth * np.exp(effect * group * (g < 3))
        y = rng.negative_binomial(4, 4 / (4 + mu))
        rows += [(int(c), f"g{g:02d}", int(v)) for c, v in enumerate(y) if v]
    cells = spark.createDataFrame([(int(c), "L", int(k)) for c, k in enumerate(group)] + [(1000 + c, "one class", 1) for c in range(5)], "cell long, cell_line string, group int")
    return cells, spark.createDataFrame(rows, "cell long, gene string, n int")


def test_two_groups_finds_the_effect(spark):
    cells, counts = simulated(spark, 1.0)
    result, skipped = D.two_groups(cells, counts, min_cells=20)
    rows = {r["names"]: r for r in result.collect()}
    assert len(rows) == 12
    assert all(rows[f"g{g:02d}"]["significant"] and rows[f"g{g:02d}"]["up"] for g in range(3))
    base = np.mean([rows[f"g{g:02d}"]["beta1"] for g in range(3, 12)])
    assert all(rows[f"g{g:02d}"]["beta1"] - base == pytest.approx(1.0, abs=0.3) for g in range(3))
    assert [tuple(r) for r in skipped.collect()] == [("one class", "a class is missing")]


def test_null_p_values_spread(spark):
    cells, counts = simulated(spark, 0.0, genes=30, seed=4)
    p = np.array([r["pvals"] for r in D.two_groups(cells, counts, min_cells=20)[0].collect()])
    assert len(p) == 30 and 0.25 < p.mean() < 0.75 and (p < 0.01).mean() < 0.1


def test_trend_with_guards_and_predictions(spark):
    rng = np.random.default_rng(3)
    n = 240
    abnormal = np.arange(n) % 2
    nuclei = 1 + rng.integers(0, 5, n)
    share = (abnormal * nuclei + 0.5) / (nuclei + 1)
    depth = rng.uniform(0.6, 1.6, n)
    entries = []
    for g in range(10):
        mu = 10 * depth * np.exp(1.2 * share * (g < 2))
        entries += [(int(c), f"g{g}", int(v)) for c, v in enumerate(rng.negative_binomial(6, 6 / (6 + mu))) if v]
    tubes = [(c, "L", int(nuclei[c] * (1 - abnormal[c])), int(nuclei[c] * abnormal[c]), int(1 + abnormal[c]), 9.0) for c in range(n)]
    tubes += [(1000, "mixed", 1, 1, -1, 9.0), (1001, "bare", 0, 0, 1, 9.0), (1002, "silent", 1, 0, 1, 9.0), (1003, "rare", 1, 0, 1, 9.0), (1004, "small", 1, 0, 1, 1.0), (1005, None, 1, 0, 1, 9.0)]
    counts = spark.createDataFrame([*entries, (1003, "g0", 2), (1004, "g0", 2)], "cell long, gene string, n int")
    table = spark.createDataFrame(tubes, "cell long, cell_line string, n_normal_nuclei int, n_abnormal_nuclei int, morphology_class int, area double")
    result, skipped, tested = D.trend(table, counts, min_tubes=50, min_area=5.0, slide=None)
    assert {tuple(r) for r in skipped.collect()} == {
        ("mixed", "no tube of class 1 or 2"),
        ("bare", "no tube with nuclei"),
        ("silent", "no counts"),
        ("rare", "no gene passes"),
        ("small", "no tube is large enough"),
    }
    rows = {r["gene"]: r for r in result.collect()}
    assert len(rows) == 10 and {r["cell_line"] for r in rows.values()} == {"L"}
    base = np.mean([rows[f"g{g}"]["beta_prop_abn"] for g in range(2, 10)])
    assert all(rows[f"g{g}"]["beta_prop_abn"] - base == pytest.approx(1.2, abs=0.4) and rows[f"g{g}"]["fdr_prop_abn"] < 0.05 for g in range(2))
    grid = D.trend_predictions(result, tested, top=3, steps=5, reference="mean").orderBy("rank", "prop_abn").collect()
    assert len(grid) == 15 and {r["gene"] for r in grid} >= {"g0", "g1"}
    for r in grid:
        own = rows[r["gene"]]
        assert r["mu"] == pytest.approx(math.exp(own["beta_intercept"] + own["beta_prop_abn"] * r["prop_abn"]))
    assert [r["prop_abn"] for r in grid[:5]] == pytest.approx(np.linspace(share.min(), share.max(), 5))
    with pytest.raises(ValueError, match="median or mean"):
        D.trend_predictions(result, tested, reference="mode")


def test_slide_term(spark):
    cells = spark.createDataFrame([(1, "a", 1.0, "s1"), (2, "a", 1.0, " "), (3, "a", 2.0, None)], "cell long, cell_line string, size_factor double, slide string")
    assert B.design_table(cells, [], slide="slide")[1] == ["intercept", "slide_s1"]
    assert B.design_table(cells.where("slide = 's1'"), [], slide="slide")[1] == ["intercept"]


def test_files_round_trip(spark, tmp_path):
    for fov, name, text in (("FOV00001", "b.csv", "target,x,y\nno,1,1\n"), ("FOV00001", "a_target_call_coord.csv", "target,x,y\nG1,1.5,2\nG2,3,4\n"), ("FOV00002", "z.csv", "target,x,y\nG3,5,6\n")):
        (tmp_path / "tx" / fov).mkdir(parents=True, exist_ok=True)
        (tmp_path / "tx" / fov / name).write_text(text)
    got = sorted((r["fov"], r["target"], r["x"]) for r in S.read_transcripts(spark, str(tmp_path / "tx")).collect())
    assert got == [("F00001", "G1", 1.5), ("F00001", "G2", 3.0), ("F00002", "G3", 5.0)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x_F00001_patch_2.txt").write_text("0 0.5 0.5 1 0.5 1 1\n\n0 0.1 0.1 0.2\n1 0 0 0.25 0 0.25 0.25 0 0.25\n")
    objects = S.read_outlines(spark, str(tmp_path / "m")).orderBy("line_no")
    rows = objects.collect()
    assert [(r["line_no"], r["fov"], r["patch_idx"], r["cls"], len(r["polygon"])) for r in rows] == [(0, "F00001", 2, "0", 3), (3, "F00001", 2, "1", 4)]
    assert rows[0]["polygon"][0]["x"] == 512.0
    S.write_outlines(objects.withColumn("object_idx", F.col("line_no")), str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).select("value").collect()
    assert text[0][0].startswith("0 512.000000 512.000000")
    S.write_result(spark.createDataFrame([("g", "L")], "gene string, cell_line string"), str(tmp_path / "r"), {"eps": 1e-6})
    assert spark.read.option("header", True).csv(str(tmp_path / "r/result")).columns == ["cell_line", "gene"]


def test_names_against_all_pairs(spark):
    """Names with one long common beginning: the best ratio of all pairs, candidates first, ties by name."""
    import difflib
    import random

    from fieldloom.operators import matching as N

    rng = random.Random(2)
    stem = lambda: "field_F0" + "".join(rng.choice("abcdef0123456789") for _ in range(rng.randint(10, 24)))
    right = [stem() for _ in range(60)]
    left = [stem() for _ in range(20)] + right[:5]
    for name in right[5:50]:
        k = rng.randrange(4, len(name))
        left.append(rng.choice([name[:k] + name[k + 1 :], name[:k] + "z" + name[k:], name[:k] + "zz" + name[k + 2 :], name[k:] + name[:k]]))
    left = list(dict.fromkeys(left))
    a, b = (spark.createDataFrame([(x + e,) for x in v], "name string") for v, e in ((left, ".tif"), (right, ".txt")))
    for threshold in (0.9, 0.8):
        got = {r["name"][:-4]: (r["match"] and r["match"][:-4], r["score"], r["mode"]) for r in N.match_names(a, b, threshold).collect()}
        for x in left:
            scores = {y: difflib.SequenceMatcher(None, y, x).ratio() for y in right}
            best = max(scores.values())
            want = (x, 1.0, "exact") if x in right else (min(y for y in right if scores[y] == best), best, "fuzzy") if best > threshold else (None, best, "none")
            assert got[x] == want


def test_best_ratios_against_all_pairs(spark):
    """300 x 300 names: the best ratio of each, 0 where nothing is alike, without comparing all pairs."""
    import difflib
    import random

    from fieldloom.operators import matching as N

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    parts = [word() for _ in range(60)]
    name = lambda: "_".join(rng.choice(parts) for _ in range(3)) + str(rng.randint(0, 99))
    left = list(dict.fromkeys([*(name() for _ in range(296)), "##", "!", "", "é"]))
    right = list(dict.fromkeys(name() for _ in range(300)))
    a = spark.createDataFrame([(f"{x}.tif", x) for x in left], "name string, stem string")
    b = spark.createDataFrame([(x,) for x in right], "_stem string")
    got = {r["name"][:-4]: r["best"] for r in N.best_ratios(a, b).collect()}
    assert len(got) == len(left)
    for x in left:
        assert got[x] == max((difflib.SequenceMatcher(None, y, x).ratio() for y in right), default=0.0), x


def test_characters_of_one_list_join_nothing(spark, monkeypatch):
    """Names of which only a few first characters are in any candidate: once these are matched, no pair is left to compare."""
    import difflib
    import hashlib

    from fieldloom.operators import matching as N

    right = [hashlib.md5(str(k).encode()).hexdigest()[:20] for k in range(40)]
    left = [right[k % 40][: 4 + k % 7] + "".join(chr(ord("k") + (k * j) % 15) for j in range(16 - k % 7)) for k in range(120)]
    a = spark.createDataFrame([(f"{x}.tif", x) for x in left], "name string, stem string")
    b = spark.createDataFrame([(x,) for x in right], "_stem string")
    compared = []

    def spread(df):
        compared.extend([df.count()] * ("_first" in df.columns and "_stem" in df.columns))
        return df

    monkeypatch.setattr(N, "spread", spread)
    got = {r["name"][:-4]: r["best"] for r in N.best_ratios(a, b).collect()}
    for x in left:
        assert got[x] == max(difflib.SequenceMatcher(None, y, x).ratio() for y in right)
    assert compared and sum(compared) < 100  # of 4,800 pairs
