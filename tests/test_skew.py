"""Hot keys: one task / one group holding a large share of the rows must give
exactly the results of a brute-force computation (no row dropped or capped)."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions.stats import pass_at_k_value
from tessera.operators import candidates as C
from tessera.operators.ordering import with_row_index


def _attempts(spark):
    rows = []
    for i in range(3000):                       # one hot task: 3000 candidates
        rows.append(("hot", i, 1 if i % 7 == 0 else 0, 1 if i % 5 == 0 else 0))
    for t in range(40):                         # many small tasks
        for i in range(1, 1 + t % 9):
            rows.append((f"t{t}", 10000 + 100 * t + i, (t + i) % 2, (t * i) % 3 == 0))
    return spark.createDataFrame([(a, b, c, int(d)) for a, b, c, d in rows],
                                 "task_id string, candidate long, easy_pass int, hard_pass int"), rows


def test_pass_at_k_hot_task(spark):
    df, rows = _attempts(spark)
    outcomes = df.select("task_id", "candidate", F.inline(F.array(
        F.struct(F.lit("easy").alias("kind"), F.lit(0).alias("assert_idx"), F.col("easy_pass").alias("passed")),
        F.struct(F.lit("hard").alias("kind"), F.lit(0).alias("assert_idx"), F.col("hard_pass").alias("passed")))))
    got = {r["k"]: r["pass_at_k"] for r in C.pass_at_k(df, "task_id", "easy_pass", (1,)).collect()}
    per = defaultdict(lambda: [0, 0])
    for t, _, e, _ in rows:
        per[t][0] += 1
        per[t][1] += e
    exp = sum(pass_at_k_value(n, c, 1) for n, c in per.values()) / len(per)
    assert got[1] == pytest.approx(exp, abs=1e-12)


def test_best_candidate_hot_task(spark):
    df, rows = _attempts(spark)
    outcomes = df.select("task_id", "candidate", F.inline(F.array(
        F.struct(F.lit("easy").alias("kind"), F.lit(0).alias("assert_idx"), F.col("easy_pass").alias("passed")),
        F.struct(F.lit("hard").alias("kind"), F.lit(0).alias("assert_idx"), F.col("hard_pass").alias("passed")))))
    tasks = df.select("task_id").distinct().select(
        "task_id", F.array(F.lit("e")).alias("test_list"), F.array(F.lit("h")).alias("challenge_test_list"))
    best = {(r["task_id"], r["kind"]): r["best_candidate"]
            for r in C.best_candidate(C.candidate_assertions(outcomes, tasks)).collect()}
    for kind, col in (("easy", 2), ("hard", 3)):
        by = defaultdict(list)
        for r in rows:
            by[r[0]].append((int(r[col]), -r[1]))
        for t, v in by.items():
            assert best[(t, kind)] == -max(v)[1]


def test_row_index_with_a_dominant_group(spark):
    data = [("big", i) for i in range(5000)] + [(f"g{i % 7}", i) for i in range(700)]
    df = spark.createDataFrame(data, "g string, k long").repartition(13)
    idx = with_row_index(df, ["k"], ["g"]).collect()
    by = defaultdict(list)
    for r in idx:
        by[r["g"]].append((r["k"], r["row_idx"]))
    for g, v in by.items():
        v.sort()
        assert [i for _, i in v] == list(range(len(v)))
