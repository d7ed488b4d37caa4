"""Scores of many scenarios in one file: what a task holds, and arms against a plainer fold."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import scoring as sc
from factloom.queries import QUERIES

SUMMARY = "scenario long, baseline string, minutes double, correct_pct double, hallucinations long, hallucination_rate double, stale long, tokens long"


def peaks(spark, query, folder):
    """Peak execution memory in MB of the stages that one task ran, while ``query`` is computed."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    before = set(stages())
    query(spark, folder).write.format("noop").mode("overwrite").save()
    new = [s for k, s in stages().items() if k not in before]
    assert new
    return [s.peakExecutionMemory() / 1e6 for s in new if s.numTasks() == 1]


@pytest.mark.parametrize("name", ["best_baseline", "scenario_verdict", "completeness_audit", "benchmark_verdict"])
def test_a_file_is_not_grouped_in_the_task_that_reads_it(spark, many_ranges, tmp_path, name):
    spark.range(60_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert max(peaks(spark, QUERIES[name], str(tmp_path)), default=0) < 4


def random_summary(seed, scenarios=60):
    """Arms with ties, absent values, absent arms and repeated ones."""
    draw = random.Random(seed)
    return [
        (s, b, draw.choice([None, 1.0, 2.0, 3.0]), draw.choice([0.5, 0.75, None]), draw.choice([None, 0, 1, 2]), draw.choice([0.0, 0.5]), draw.choice([None, 0, 1]), draw.randrange(3))
        for s in range(scenarios) for b in draw.choice(["ABCD", "ABCD", "BD", "AD", "ABC", "D", "ABBCD", "ABCDD", "BBDD"])
    ]


def goods(row):
    _, _, minutes, correct, _, rate, stale, tokens = row
    low, high = lambda v: -float("inf") if v is None else -v, lambda v: -float("inf") if v is None else v
    return {"minutes": low(minutes), "correct_pct": high(correct), "hallucination_rate": low(rate), "stale": low(stale), "tokens": low(tokens)}


def best(rows):
    """(arm, good) by scenario and metric."""
    out = {}
    for row in sorted(rows, key=lambda r: r[1]):
        for m, good in goods(row).items() if row[1] != "D" else ():
            if (row[0], m) not in out or good > out[row[0], m][1]:
                out[row[0], m] = (row[1], good)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_best_of_others(spark, seed):
    rows = random_summary(seed)
    got = sc.best_of_others(spark.createDataFrame(rows, SUMMARY))
    assert sorted((r.scenario, r.metric, r.best, r.best_good) for r in got.collect()) == sorted((s, m, *b) for (s, m), b in best(rows).items())


def verdicts(rows):
    """Every judged arm beside every guard of its scenario."""
    top, of = best(rows), defaultdict(list)
    for r in rows:
        of[r[0]].append(r)
    out = []
    for s, arms in of.items():
        judged, guards = [r for r in arms if r[1] == "D"], [r for r in arms if r[1] == "B"]
        wins = sum(good > top[s, m][1] for r in judged for m, good in goods(r).items() if (s, m) in top)
        for d in judged:
            for b in guards:
                fine, fresh = None if None in (d[4], b[4]) else d[4] <= b[4], None if None in (d[6], b[6]) else d[6] < b[6]
                parts = (wins >= 3, fine, fresh)
                out.append((s, wins, fine, fresh, False if False in parts else None if None in parts else True))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_scenario_verdicts(spark, seed):
    rows = random_summary(seed)
    nowhere = [(None, b, *r[2:]) for b, r in zip("ABCD", rows)]
    got = sc.scenario_verdicts(spark.createDataFrame(rows + nowhere, SUMMARY)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, verdicts(rows)))


def test_a_benchmark_without_scenarios_has_no_row(spark, tmp_path):
    spark.createDataFrame([(1,), (3,), (13,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert [r.group for r in QUERIES["benchmark_verdict"](spark, str(tmp_path)).collect()] == [False]


def test_verdicts_are_not_broadcast(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    plan = QUERIES["benchmark_verdict"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("FileScan") == 2
