"""Functions, front end, log codec, streams."""

import json
import math
import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from factloom.functions import decay, inference, text
from factloom.operators import drafts, logs, sessions
from factloom.plans.lisp import LispError, Symbol, Timestamp, parse, parse_batch, read_spec
from factloom.plans.read import ReadError, ReadSpec, execute
from factloom.sources import record_log as rl
from factloom.streaming import supersede


def test_decay_factor_against_integers(spark):
    table = [round(2 ** (-i / 256) * 65535) for i in range(256)]
    draw = random.Random(1)
    rows = [(e, h) for e in (0, 1, 999, 10**9, 10**12, 1 << 60) for h in (0, 1, 7, 86_400_000, 10**10)] + [(draw.randrange(10**11), draw.randrange(1, 10**10)) for _ in range(300)]

    def want(e, h):
        if h == 0:
            return 65535
        k = min(e, (1 << 54) - 1) * 256 // h
        return 0 if k >> 8 >= 16 else table[k & 255] >> (k >> 8)

    got = spark.createDataFrame(rows, "e long, h long").select("e", "h", decay.decay_factor(F.col("e"), F.col("h")).alias("f")).collect()
    assert all(r.f == want(r.e, r.h) for r in got) and [r.e for r in got] == [e for e, _ in rows]


def test_half_life_overrides(spark):
    got = {(r.kind, r.source): r.half_life_ms for r in decay.half_lives(spark, {("sem", "profile"): 0, ("sem", "document"): 2, ("x", "y"): 5}).collect()}
    assert got["sem", "profile"] == 0 and got["sem", "document"] == 2 * decay.DAY_MS and ("x", "y") not in got
    with pytest.raises(ValueError):
        decay.half_lives(spark, {("sem", "profile"): -1})


def test_inferred_confidence_folds_in_order(spark):
    draw = random.Random(2)
    mul = lambda a, b: (a * b + 32767) // 65535
    rows = [(m, [draw.randrange(65536) for _ in range(draw.randint(1, 9))]) for m in inference.PARENT_RULES for _ in range(6)]
    got = spark.createDataFrame(rows, "m string, ps array<long>").select("m", "ps", inference.inferred_confidence(F.col("m"), F.col("ps")).alias("c"), inference.pattern_summarize(F.col("ps")).alias("g")).collect()
    for r in got:
        if r.m in inference.PRODUCT_SCALES or r.m == "multi_source_consensus":
            acc = 65535
            for p in r.ps:
                acc = mul(acc, p if r.m != "multi_source_consensus" else 65535 - p)
            a, b = inference.PRODUCT_SCALES.get(r.m, (1, 1))
            want = None if len(r.ps) > 8 else 65535 - acc if r.m == "multi_source_consensus" else (acc * a + b // 2) // b
            assert r.c == want
        if r.m in inference.MIN_SCALES:
            a, b = inference.MIN_SCALES[r.m]
            assert r.c == (min(r.ps) * a + b // 2) // b
        root = None if len(r.ps) > 8 else inference.geometric_mean_root(r.ps)
        assert r.g == (None if root is None else (root * 4 + 2) // 5)
        if root is not None:
            assert root ** len(r.ps) <= math.prod(r.ps) < (root + 1) ** len(r.ps) or root == 65535


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.terminal_safe(F.lit("a\x1b[31mred\x1b[0m\x1b]0;t\x07b\x1b]x\x1b\\c\x01\td\x1bZe\n"))) == "aredbc\tde\n"
    assert one(text.terminal_safe(F.lit("\x1b\x1b[31m|\x1b]a\x1bb\x07c\x1b]open"))) == "[31m|c"
    assert one(text.preview(F.lit("  a \n b "))) == "a b" and one(text.preview(F.lit("x" * 81))) == "x" * 77 + "..." and one(text.preview(F.lit("y" * 80))) == "y" * 80
    assert one(text.lisp_string(F.lit('a"\\\n\r\t'))) == '"a\\"\\\\\\n\\r\\t"'
    assert one(text.like_pattern(F.lit("a%_\\"))) == "%a\\%\\_\\\\%"
    assert [one(text.repository_slug(F.lit(u))) for u in ("https://h.x/o/r.git", "git@h.x:o/r", "nothing")] == ["o/r", "o/r", None]
    assert one(text.workspace_id(F.lit(" HTTPS://H/o/r.GIT "))) == one(text.workspace_id(F.lit("https://h/o/r")))
    assert [one(text.parse_iso(F.lit(s))) for s in ("1970-01-02", "1970-01-01T00:00:01.5Z", "1970-01-01T00:00:01.12349Z", "x", "1970-13-01")] == [86_400_000, 1500, 1123, None, None]
    assert [one(text.confidence_units(F.lit(x))) for x in (0.5, 1.0, 1.01, -0.1, float("nan"))] == [32768, 65535, None, None, None]
    assert one(text.quorum_slug(F.lit("a b/ü"))).startswith("a_b__-")


def test_lisp_forms():
    sem, epi = parse('(sem @alice @knows @bob :src @observation :c 0.8 :v 2024-01-15) ; note\n(epi @ev1 @meeting (@a @b) @room :at 2024-01-15T10:00:00.25Z :obs 2024-01-15 :src @o :c 1)')
    assert sem.positional == (Symbol("alice"), Symbol("knows"), Symbol("bob")) and sem.keywords["c"] == 0.8
    assert epi.positional[2] == (Symbol("a"), Symbol("b")) and epi.keywords["at"] == Timestamp(1705312800250)
    assert parse('(episode :start :label "x \\"y\\"" :retracts (@e))')[0].keywords == {"start": True, "label": 'x "y"', "retracts": (Symbol("e"),)}
    for bad in ("(sem", "(what @a)", "sem", "(sem @a :c 1 :c 2)", '(sem "open)', "(pin @a :v 2024-13-01)", "(sem " + "(" * 300):
        with pytest.raises(LispError):
            parse(bad)


def test_forms_have_the_shape_of_their_opcode():
    good = (
        "(sem @a knows @b :src @o :c 0.5 :v 2024-01-01 :projected true)", "(pro @r \"t\" 5 :scp @s :src @o :c 1.0 :pre \"x\")", "(inf @a @p 1 (@m1 @m2) @majority_vote :c 0.5 :v 2024-01-01)",
        "(alias @a @b) (rename @a @b) (retire @a :reason \"old\") (promote @a) (pin @m :actor @a)", "(correct @ep (epi @e @k (@a) @l :at 2024-01-01 :obs 2024-01-01 :src @o :c 1.0))",
        "(episode :close)", "(episode :start :retracts (@a @b) :parent_episode @p)", "(query :limit 3)",
    )
    assert all(parse_batch(text) for text in good)
    bad = (
        "(sem @a @p @o :c 0.5 :v 2024-01-01)", "(sem a @p @o :src @o :c 0.5 :v 2024-01-01)", "(sem @a @p @o @x :src @o :c 0.5 :v 2024-01-01)", "(sem @a @p @o :src @o :c 0.5 :v 2024-01-01 :scp @x)",
        "(sem @a @p word :src @o :c 0.5 :v 2024-01-01)", "(epi @e @k @a @l :at 2024-01-01 :obs 2024-01-01 :src @o :c 1.0)", "(inf @a @p 1 (@m1 5) @x :c 0.5 :v 2024-01-01)", "(alias @a)", "(pin @m)",
        "(correct @ep (sem @a @p 1 :src @o :c 0.5 :v 2024-01-01))", "(episode :label \"x\" :start)", "(episode :close :label \"x\")", "(episode :start :label @x)", "(episode :start :retracts @x)", "(episode)",
    )
    for text in bad:
        parse(text)
        with pytest.raises(LispError):
            parse_batch(text)


def test_read_specifications():
    spec = read_spec("(query :kind sem :s @alice :as_of 2024-01-15 :limit 3 :debug_mode true :in_episode @__ep_7)")
    assert (spec.kind, spec.s, spec.as_of, spec.limit, spec.show_framing, spec.explain_filtered, spec.in_episode) == ("sem", "alice", 1705276800000, 3, True, True, 7)
    assert ReadSpec().threshold_units == 32768
    for bad in ("(query @a)", "(query :what 1)", "(query :timeout_ms 4)", "(query :kind x)", "(query :kind pro :s @a)", "(query :in_episode @e_1 :after_episode @e_2)", "(query) (query)", "(query :limit -1)"):
        with pytest.raises(ReadError):
            read_spec(bad)
    with pytest.raises(ReadError):
        replace(ReadSpec(), confidence_threshold=2.0).checked()


RECORDS = [
    ("symbol_alloc", {"symbol_id": 1, "name": "é", "kind": 3, "at": 5}),
    ("sem", {"memory_id": 300, "s": 1, "p": 2, "o": ("integer", -7), "source": 4, "confidence": 65535, "valid_at": 1, "observed_at": 2, "committed_at": 3, "invalid_at": None, "projected": True}),
    ("epi", {"memory_id": 5, "event_id": 1, "kind": 2, "participants": [1, 2, 1 << 40], "location": 3, "at_time": 1, "observed_at": 2, "source": 3, "confidence": 1, "committed_at": 9, "invalid_at": 4}),
    ("pro", {"memory_id": 6, "rule_id": 1, "trigger": ("string", "t"), "action": ("float", 1.5), "precondition": None, "scope": 3, "source": 4, "confidence": 0, "valid_at": 1, "observed_at": 1, "committed_at": 1, "invalid_at": None}),
    ("supersedes", {"from": 1, "to": 2, "at": 3}),
    ("checkpoint", {"episode_id": 1, "at": 3, "memory_count": 2}),
    ("pin", {"memory_id": 1, "at": 4, "actor": 2}),
]


def plain(fields):
    return json.loads(json.dumps(fields))


def test_log_round_trip_and_sources(spark, tmp_path):
    path = str(tmp_path / "a.log")
    rl.write_log(path, RECORDS)
    with open(path, "rb") as f:
        raw = f.read()
    got = list(rl.decode_all(raw))
    assert [(k, plain(f)) for _, _, k, f, _ in got] == [(k, plain(f)) for k, f in RECORDS]
    spark.dataSource.register(rl.RecordLogSource)
    rows = spark.read.format("record_log").option("path", path).load().orderBy("log_pos").collect()
    assert [(r.kind, json.loads(r.fields)) for r in rows] == [(k, plain(f)) for k, f in RECORDS]
    same = rl.read_logs(spark, path).orderBy("log_pos").collect()
    assert [(r.kind, r.fields) for r in same] == [(r.kind, r.fields) for r in rows]
    assert logs.committed_prefix(rl.read_logs(spark, path)).count() == 6


def test_log_in_ranges_appends_and_orphan_tails(spark, tmp_path):
    path = str(tmp_path / "b.log")
    batch = [RECORDS[1], RECORDS[5]]
    rl.write_log(path, RECORDS[:6] + batch * 40)
    rl.write_index(path, every=300)
    spark.dataSource.register(rl.RecordLogSource)
    ranged = spark.read.format("record_log").option("path", path).load()
    assert ranged.rdd.getNumPartitions() > 3
    want = [(n, at, k, plain(f)) for n, at, k, f, _ in rl.decode_all(open(path, "rb").read())]
    assert [(r.log_pos, r.offset, r.kind, json.loads(r.fields)) for r in ranged.orderBy("log_pos").collect()] == want
    assert rl.committed_end(path)[1] == "clean" and rl.truncate_orphan_tail(path) == 0
    size = (tmp_path / "b.log").stat().st_size
    rl.append_log(path, [RECORDS[1]])
    assert not (tmp_path / "b.log.idx").exists() and rl.committed_end(path) == (size, "orphan")
    assert rl.truncate_orphan_tail(path) > 0 and (tmp_path / "b.log").stat().st_size == size
    with open(path, "ab") as out:
        out.write(rl.encode_record(*RECORDS[1])[:-3])
    assert rl.truncate_orphan_tail(path) > 0 and rl.committed_end(path) == (size, "clean")
    with open(path, "ab") as out:
        out.write(b"\x77\x00")
    with pytest.raises(ValueError):
        rl.truncate_orphan_tail(path)
    # Pieces of any size give the same rows.
    whole = rl.READ_BYTES
    try:
        for rl.READ_BYTES in (1, 7, 64):
            stream, size = rl._opened(path)
            with stream:
                assert [x[:3] + x[4:] for x in rl.decode_stream(stream, size)] == [x[:3] + x[4:] for x in rl.decode_all(open(path, "rb").read())]
    finally:
        rl.READ_BYTES = whole


def test_log_errors():
    good = rl.encode_record(*RECORDS[4])
    last = lambda raw: list(rl.decode_all(rl.HEADER + raw))[-1][4]
    assert last(good + good[:-2]) == "truncated" and last(b"\x77\x00") == "unknown_opcode"
    assert last(bytes([good[0], good[1] + 1]) + good[2:] + b"\0") == "length_mismatch" and last(b"\x10\x81\x00\x00") == "non_canonical_varint"
    assert last(b"\x10" + b"\xff" * 10) == "varint_overflow" and last(b"\x10\x01\x01") == "body_underflow"
    assert last(rl.encode_record("pin", {"memory_id": 1, "at": rl.NULL_CLOCK, "actor": 1})) == "reserved_clock"
    assert next(iter(rl.decode_all(b"x")))[4] == "bad_header"
    for n in (0, 1, 127, 128, 300, (1 << 64) - 1):
        assert rl.decode_varint(rl.encode_varint(n), 0)[0] == n
    assert all(rl.unzigzag(rl.zigzag(n) & rl.NULL_CLOCK) == n for n in (0, -1, 5, -(1 << 40)))
    draw = random.Random(3)
    for _ in range(500):  # no input makes the decoder fail
        list(rl.decode_all(rl.HEADER + bytes(draw.randrange(256) for _ in range(40))))


def test_tail_status(spark):
    rows = spark.createDataFrame([(None, 0), (None, 3), ("truncated", 3), ("length_mismatch", 1), ("unknown_opcode", 1)], "e string, n long")
    assert [r.x for r in rows.select(logs.tail_status(F.col("e"), F.col("n")).alias("x")).collect()] == ["clean", "orphan", "orphan", "orphan", "corrupt"]


def test_stream_equals_batch(spark, tmp_path):
    from factloom.operators.supersession import semantic_history

    draw = random.Random(5)
    log = [(i, draw.randrange(4), "p", draw.randrange(9), i // 2, i) for i in range(90)]
    schema = "memory_id long, s long, p string, valid_at long, committed_at long, log_pos long"
    whole = spark.createDataFrame(log, schema)
    for k in range(3):
        spark.createDataFrame(log[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # One file a batch, oldest first: rows arrive in log order between batches.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = supersede.supersede_stream(rows).writeStream.format("memory").queryName("heads").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.memory_id: (r.kind, r.head_id, r["head"]) for r in spark.table("heads").collect()}
    assert got == {r.memory_id: (r.kind, r.head_id, r["head"]) for r in semantic_history(whole).collect()}
    # A row behind what was folded is told, and changes nothing.
    spark.createDataFrame([(900, 0, "p", 99, 0, 0), (901, 0, "p", 99, 90, 90)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = supersede.supersede_stream(rows).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.memory_id: (r.kind, r.head_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    again = {r.memory_id: (r.kind, r.head_id) for r in semantic_history(whole.unionByName(spark.createDataFrame([(901, 0, "p", 99, 90, 90)], schema))).collect()}
    assert got.pop(900) == ("late", None) and got == again


def test_runner_over_a_stream(spark, tmp_path):
    from factloom.streaming import runner as watching

    rows = [(f"d{i}", "pending" if i % 3 else "processing", 5 if i % 3 == 0 else None) for i in range(30)]
    spark.createDataFrame(rows, "id string, state string, claimed_at long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, state string, claimed_at long").parquet(f"{tmp_path}/in")
    decide = lambda batch: batch.filter("id <> 'd4'").select("id", F.lit("accepted").alias("decision"))
    run = watching.watch(stream, decide, lambda: 10_000_000, f"{tmp_path}/items", f"{tmp_path}/sums").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    total = spark.read.parquet(f"{tmp_path}/sums").first()
    assert (total.recovered_processing, total.pending_seen, total.claimed, total.accepted, total.deferred, total.claim_misses) == (10, 30, 30, 29, 1, 0)
    assert {r.final_state for r in spark.read.parquet(f"{tmp_path}/items").filter("id = 'd4'").collect()} == {"pending"}


def test_bindings_against_one_batch_at_a_time(spark):
    from factloom.operators import bind

    draw = random.Random(8)
    mentions = [(b, f"n{draw.randrange(12)}", draw.choice("abc" if draw.random() < 0.3 else "a")) for b in range(150) for _ in range(draw.randint(1, 3))]
    locks, want = {}, {}
    for b in range(150):
        own, bad = dict(locks), False
        for _, name, kind in (m for m in mentions if m[0] == b):
            bad |= own.setdefault(name, kind) != kind
        want[b] = bad
        locks = locks if bad else own
    got = {r.batch: r.rejected for r in bind.audit(spark.createDataFrame(mentions, "batch long, name string, kind string")).collect()}
    assert got == want and 0 < sum(want.values()) < 150


def test_half_lives_in_a_read(spark):
    from factloom.queries.reads import store

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables aren't here")
    own = store(spark, "/root/testdata/sf0.001")
    low = lambda **kw: execute(own, ReadSpec(kind="sem", confidence_threshold=1.0, limit=None, **kw)).records.filter("source = 'document'").agg(F.sum("effective")).first()[0]
    assert low(half_life_days=((("sem", "document"), 1),)) < low() < low(half_life_days=((("sem", "document"), 0),))


def test_draft_rules(spark):
    moves = spark.createDataFrame([("a", i, s) for i, s in enumerate(("pending", "processing", "accepted", "pending"))] + [("b", 0, "failed")], "id string, position long, state string")
    assert [r.allowed for r in drafts.audit_moves(moves).orderBy("id", "position").collect()] == [True, True, True, False, False]
    assert sessions.clamp(None) == 10 and sessions.clamp(0) == 1 and sessions.clamp(999) == 100
    assert sessions.schema_problems({k: list(v) for k, v in sessions.EXPECTED.items()}) == []
