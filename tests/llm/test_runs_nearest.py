import random

from pyspark.sql import functions as F

from turnloom.llm import nearest, runs

SENT = "episode string, scene_id int, sentence_id int, speaker string, start_s double, end_s double, entity string, symbol string"


def collapse(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SENT)
    out = runs.collapse_runs(df, "episode", "scene_id", runs.speaker_key(F.col("speaker")), "sentence_id", "start_s", "end_s")
    return sorted((r.entity, int(r.grp), r.first_pos, r.last_pos, r.n_events) for r in out.collect())


def brute(rows):
    import re

    out, seen, last = [], set(), None
    for e, sc, i, sp, *_ in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[0], r[2])):
        if (e, i) in seen:
            continue
        seen.add((e, i))
        key = re.sub(r"[\W_]", "", re.sub(r"\([^)]*\)|\[[^\]]*\]", "", sp or "").lower()) or None
        if key is None or sc is None:
            last = None
        elif last and last[:3] == (e, sc, key):
            out[-1][3], out[-1][4] = i, out[-1][4] + 1
        else:
            out.append([e, sc, i, i, 1])
            last = (e, sc, key)
    return sorted(map(tuple, out))


def test_runs_small_cases(spark):
    rows = [("a", 1, 1, "Ann", 0.0, 1.0), ("a", 1, 2, "ANN.", 1.0, None), ("a", 1, 2, "ANN.", 1.0, None), ("a", 1, 3, "(x)", 2.0, 3.0), ("a", 1, 4, "ann (V.O.)", 3.0, 4.0), ("a", 2, 5, "ann", 4.0, 5.0), ("a", None, 6, "ann", 5.0, 6.0), ("a", 2, 7, "ann", 6.0, 7.0), (None, 1, 1, "z", 0.0, 1.0), ("b", 1, None, "z", 0.0, 1.0)]
    assert collapse(spark, rows) == brute(rows) == [("a", 1, 1, 2, 2), ("a", 1, 4, 4, 1), ("a", 2, 5, 5, 1), ("a", 2, 7, 7, 1)]
    assert collapse(spark, []) == []


def test_runs_over_block_edges(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("m", 1 + i // 300, i, rng.choice(["A", "B", None]) if i % 90 > 60 else "A", float(i), i + 0.5) for i in range(1, 900)]
    rows += [("long", 1, i, "same", float(i), i + 1.0) for i in range(1, 700)]
    monkeypatch.setattr(runs, "BLOCK_BITS", 4)
    monkeypatch.setattr(runs, "FAN_BITS", 3)
    assert collapse(spark, rows) == brute(rows)


def test_run_durations(spark):
    df = spark.createDataFrame([("a", 1, 1, "x", 2.0, 3.0, "", ""), ("a", 1, 2, "x", None, 5.5, "", ""), ("a", 1, 3, "y", None, None, "", "")], SENT)
    out = {r.symbol: r for r in runs.collapse_runs(df, "episode", "scene_id", F.col("speaker"), "sentence_id", "start_s", "end_s").collect()}
    assert out["x"].duration_s == 3.5 and out["y"].duration_s is None


def near(spark, left, right, tolerance, partitions):
    schema = "entity string, t double, id bigint, kind string"
    a = spark.createDataFrame([(*r, "extra") for r in left], schema)
    b = spark.createDataFrame([(*r, "extra") for r in right], schema)
    return sorted((r.left_id, r.right_id) for r in nearest.nearest_records(a, b, tolerance, partitions).collect())


def test_nearest_against_brute_force(spark):
    rng = random.Random(5)
    left = [(rng.choice("abcde"), round(rng.uniform(0, 300), 3), i) for i in range(600)]
    right = [(rng.choice("abcd"), round(rng.uniform(0, 300), 3) + 0.0005, i) for i in range(200)]
    left += [("big", i * 0.7, 1000 + i) for i in range(500)] + left[:20]
    right += [("big", i * 3.1 + 0.05, 5000 + i) for i in range(40)]
    want = []
    for e, t, i in dict.fromkeys(left):
        best = min(((abs(t - u), j) for f, u, j in right if f == e), default=None)
        if best and best[0] <= 1.5:
            want.append((i, best[1]))
    for n in (1, 7, 40):
        assert near(spark, left, right, 1.5, n) == sorted(want)


def test_nearest_edge_cases(spark):
    nan = float("nan")
    left = [("a", 1.0, 1), ("a", None, 2), (None, 1.0, 3), ("a", nan, 4), ("b", 1.0, 5), ("a", 3.0, None), ("a", 5.0, 6)]
    right = [("a", 0.0, 10), ("a", 2.0, 11), ("a", None, 12), ("a", nan, 13), ("a", 5.0, 14)]
    assert near(spark, left, right, 1.5, 3) == [(1, 10), (6, 14)]
    assert near(spark, [], right, 1.5, 3) == [] and near(spark, left, [], 1.5, 3) == []


def test_runs_over_sparse_positions(spark):
    step = 1_700_000_000_000_000 // 97
    rng = random.Random(8)
    rows = [("e", 1, i * step, rng.choice("AAB"), None, None) for i in range(97)] + [("e", 1, -i * 1000, "A", None, None) for i in range(1, 40)]
    wide = "episode string, scene_id int, sentence_id bigint, speaker string, start_s double, end_s double"
    out = runs.collapse_runs(spark.createDataFrame(rows, wide), "episode", "scene_id", runs.speaker_key(F.col("speaker")), "sentence_id", "start_s", "end_s")
    assert sorted((r.entity, int(r.grp), r.first_pos, r.last_pos, r.n_events) for r in out.collect()) == brute(rows)
