"""Independent brute-force folds of the write-side rules on small random logs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, resolve, sequence, supersession, validation


def random_log(seed, n=120, keys=6, days=12):
    draw = random.Random(seed)
    clock, out = 0, []
    for i in range(n):
        clock += draw.randint(0, 2)
        out.append((i, draw.randrange(keys), "p", float(i), draw.randrange(days) * 10, clock, i))
    return out


SEM = "memory_id long, s long, p string, o double, valid_at long, committed_at long, log_pos long"


def fold(log):
    """kind, head and head id of each row, and the edges, one row at a time."""
    heads, kinds, edges = {}, {}, []
    for m, s, p, _, v, c, _ in sorted(log, key=lambda r: (r[5], r[6])):
        head = heads.get((s, p))
        if head is None:
            kinds[m], heads[s, p] = ("first", None, None), (v, m)
        elif v > head[0]:
            kinds[m] = ("forward", head[0], head[1])
            edges.append((m, head[1], c, v))
            heads[s, p] = (v, m)
        elif v < head[0]:
            kinds[m] = ("retro", head[0], head[1])
            edges.append((m, head[1], c, v))
        else:
            kinds[m] = ("conflict", head[0], head[1])
    return kinds, edges


@pytest.mark.parametrize("hot", [None, 3, 30])
@pytest.mark.parametrize("seed", range(3))
def test_semantic_history(spark, many_ranges, seed, hot):
    log = random_log(seed)
    kinds, edges = fold(log)
    history = supersession.semantic_history(spark.createDataFrame(log, SEM), hot)
    links = {to: f for f, to, _, v in edges if kinds[f][0] == "forward"}
    assert {r.memory_id: r.closed_by for r in history.collect()} == {m: links.get(m) for m in kinds}
    assert {r.memory_id: (r.kind, r.head, r.head_id) for r in history.collect()} == kinds
    got = {(r.from_id, r.to_id, r.at, r.from_valid_at) for r in supersession.supersession_edges(history).collect()}
    assert got == set(edges)


@pytest.mark.parametrize("mode", [resolve.SPEC, resolve.REFERENCE])
@pytest.mark.parametrize("seed", range(3))
def test_bitemporal_resolution(spark, seed, mode):
    log = random_log(seed, 80)
    kinds, edges = fold(log)
    rows = {r[0]: r for r in log}
    history = supersession.semantic_history(spark.createDataFrame(log, SEM)).cache()
    for t, tc in ((55, None), (None, 40), (70, 60), (200, None), (35, 90)):
        best = {}
        for m, s, p, _, v, c, pos in log:
            kind, head, _ = kinds[m]
            if kind == "conflict" or tc is not None and c > tc or t is not None and v > t:
                continue
            closing = [fv for f, to, at, fv in edges if to == m and (tc is None or at <= tc) and (mode == resolve.REFERENCE or fv > v)]
            ends = min([*closing, *([head] if kind == "retro" else [])], default=None)
            if t is not None and ends is not None and ends <= t:
                continue
            if (s, p) not in best or (c, -pos) > (rows[best[s, p]][5], -rows[best[s, p]][6]):
                best[s, p] = m
        got = {(r.s, r.p): r.memory_id for r in resolve.resolve(history, t, tc, mode).collect()}
        assert got == best, (t, tc)


@pytest.mark.parametrize("hot", [None, 2, 10])
@pytest.mark.parametrize("seed", range(2))
def test_procedural_history(spark, many_ranges, seed, hot):
    draw = random.Random(seed)
    log = [(i, draw.randrange(5), draw.randrange(3), draw.randrange(3), i * 2, i) for i in range(80)]
    closed, live = {}, {}
    for m, rule, trigger, scope, c, _ in log:
        for other in [o for o, r in live.items() if r[1] == rule or (r[2], r[3]) == (trigger, scope)]:
            closed[other] = m
            del live[other]
        live[m] = log[m]
    df = spark.createDataFrame(log, "memory_id long, rule_id long, trigger long, scope long, committed_at long, log_pos long")
    history = supersession.procedural_history(df, hot)
    assert {r.memory_id: r.closed_by for r in history.collect()} == {m: closed.get(m) for m, *_ in log}
    assert {r.memory_id for r in resolve.resolve_procedural(history).collect()} == set(live)


def test_monotonic_clock_over_blocks(spark):
    draw = random.Random(1)
    walls = [(n, draw.randrange(200_000)) for n in range(140_000)]
    want, last = {}, -1
    for n, w in walls:
        last = max(w, last + 1)
        want[n] = last
    got = supersession.monotonic_clock(spark.createDataFrame(walls, "n long, w long"), "w", "n")
    assert {r.n: r.clock for r in got.collect()} == want


def test_staleness_against_positions(spark):
    edges = spark.createDataFrame([(10, 1, 100, 5), (11, 1, 101, 9), (12, 2, 102, 3)], "from_id long, to_id long, at long, at_pos long")
    inf = spark.createDataFrame([(50, [1, 1, 2], 4), (51, [1], 7), (52, [3], 1)], "memory_id long, derived_from array<long>, log_pos long")
    got = sorted((r.inf_id, r.parent_id, r["at"]) for r in graph.stale_parent_edges(inf, edges).collect())
    assert got == [(50, 1, 100), (50, 1, 100), (50, 1, 101), (50, 1, 101), (51, 1, 101)]
    assert {r.inf_id: r.stale for r in graph.born_stale(inf, edges).collect()} == {50: True, 51: True, 52: False}


def test_walk_over_a_deep_chain(spark):
    links = spark.range(1, 301).select("id", (F.col("id") - 1).alias("to"))
    start = spark.createDataFrame([(7, 300), (8, 5)], "root long, id long")
    got = defaultdict(list)
    for r in graph.walk(links, start).collect():
        got[r.root].append((r.depth, r.id))
    assert sorted(got[7]) == [(d, 300 - d) for d in range(301)] and sorted(got[8]) == [(d, 5 - d) for d in range(6)]


def test_suspect_edges_find_cycles(spark):
    at = spark.createDataFrame([(i, i, i) for i in range(6)], "memory_id long, committed_at long, log_pos long")
    edges = spark.createDataFrame([(3, 1), (5, 3), (1, 5), (4, 4)], "from_id long, to_id long")
    assert {(r.from_id, r.to_id) for r in graph.suspect_edges(edges, at).collect()} == {(1, 5), (4, 4)}


def test_window_duplicates_on_bucket_borders(spark):
    fields = {"s": 1, "p": "p", "o": 1.0, "source": "document", "confidence": 5, "projected": False}
    full = lambda df: df.withColumns({c: F.lit(v) for c, v in fields.items()})
    store = full(spark.createDataFrame([(0, 1000), (0, 5999)], "memory_id long, valid_at long"))
    own = full(spark.createDataFrame(list(enumerate((0, 1999, 2000, 2001, 4998, 4999, 7000))), "memory_id long, valid_at long"))
    got = {r.memory_id for r in validation.duplicates(own, store, "sem", 1000).collect() if r.duplicate}
    assert got == {0, 1, 2, 5} and validation.duplicates(own, store, "sem").filter("duplicate").count() == 0
    other = own.withColumn("o", F.lit(2.0))
    assert validation.duplicates(other, store, "sem", 1000).filter("duplicate").count() == 0
    assert validation.duplicates(store, store.withColumn("o", F.lit(None).cast("double")), "sem").filter("duplicate").count() == 0


def test_numbers_over_many_ranges(spark, many_ranges):
    draw = random.Random(4)
    rows = [(i, draw.randrange(50), draw.randrange(10**6)) for i in range(3000)]
    got = sequence.numbered(spark.createDataFrame(rows, "i long, a long, b long"), "n", "a", "b").collect()
    assert [r.i for r in sorted(got, key=lambda r: r.n)] == [i for i, *_ in sorted(rows, key=lambda r: r[1:])] and sorted(r.n for r in got) == list(range(3000))
