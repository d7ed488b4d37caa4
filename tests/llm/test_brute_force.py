"""Results against independent, plainer computations; hot keys, odd rows and very long texts."""

import base64
import gzip
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import boosting, byte_bpe, common, decontamination, exact_dedup, language_id, license_scan, near_dedup, secret_scan, sharding, token_files, toxicity

from test_operators import SCHEMA, _texts, brute_components, brute_windows, lower_ascii


@pytest.fixture
def all_heavy(monkeypatch):
    """Nearly every repeated key counts as heavy."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 1)
    monkeypatch.setattr(common, "HEAVY_SHARE", 50)


def brute_shards(rows, shards):
    """(doc_id, size, crc, shard, slot) of rows (doc_id, size, crc, source, mix), by sorting lists."""
    of_source = defaultdict(list)
    for r in rows:
        of_source[r[3]].append(r)
    placed = []
    for own in of_source.values():
        own.sort(key=lambda r: (r[4] % (1 << 64), (r[0] is not None, r[0]), r[2], r[1]))
        placed += [((k + 0.5) / len(own), r) for k, r in enumerate(own)]
    placed.sort(key=lambda x: (x[0], x[1][4] % (1 << 64), (x[1][0] is not None, x[1][0]), x[1][2], x[1][1]))
    n, out, filled = len(placed), [], Counter()
    for k, (_, r) in enumerate(placed):
        shard = k * shards // n
        out.append((r[0], r[1], r[2], shard, filled[shard]))
        filled[shard] += 1
    return out


def test_sharding_against_sorted_lists(spark, many_ranges):
    draw = random.Random(6)
    rows = [(i, "t" * draw.randrange(50), f"own{i}" if i % 2 else ("hot", "b", None)[i % 3]) for i in range(1500)]
    rows += [(None, "same", "hot")] * 200 + [(7, "again", "b")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    thin = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), "source")
    thin = [tuple(r) for r in thin.withColumn("mix", F.xxhash64(F.lit(20_240_229), "doc_id", "crc", "size")).collect()]
    got = sharding.interleave_shards(docs, 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == Counter(brute_shards(thin, 7))


def test_sharding_has_no_hot_range(spark, many_ranges):
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    ranked = docs.select("doc_id", F.xxhash64("doc_id").alias("mix"), F.lit(0.5).alias("fraction"))
    sizes = sharding._numbered(ranked, F.col("fraction"), F.col("mix")).groupBy("range").count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 6_000
    same = spark.range(4_000).select(F.lit(1).alias("a"), F.monotonically_increasing_id().alias("row"))
    assert max(r["count"] for r in sharding._numbered(same, F.col("a"), F.col("row")).groupBy("range").count().collect()) < 2_500


def test_dedup_with_heavy_keys(spark, all_heavy):
    texts = _texts()
    rows = [(i, t, "en", None, None, "s", "k", "d", "no") for i, t in enumerate(texts)] + [(2, texts[2], "en", None, None, "s", "k", "d", "no")] * 30 + [(None, "no id at all", "en", None, None, "s", "k", "d", "no")] * 20
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and Counter(lower_ascii(r.text) for r in left.collect()) == Counter({lower_ascii(t): 1 for _, t, *_ in rows})
    got = near_dedup.near_groups(docs, 2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)
    stay = near_dedup.drop_near_copies(docs, 2)
    want = {r.doc_id for r in got if r.kept and r.doc_id is not None}
    assert stay.columns == docs.columns and Counter(r.doc_id for r in stay.collect()) == Counter(want) + Counter({None: 20})


def test_sieve_loses_nothing(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("word"), F.lit("y").alias("mask"))
    wanted = rows.filter("id % 50 = 0").select("id", "h")
    left = common.sieved(rows, wanted, ["id", "h"])
    assert left.columns == rows.columns and left.filter("id % 50 = 0").count() == 400 and left.count() < 600


def test_sample_is_bounded_in_rows_whatever_the_ids(spark):
    docs = spark.range(3_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 900).cast("string")).alias("text"), F.lit("en").alias("lang"))
    got = common.sampled_rows(docs, 100, 1, "lang").collect()
    assert len(got) == 100 == len({r.text for r in got})


def test_other_patterns_are_split_by_whole_texts():
    tiktoken = pytest.importorskip("tiktoken")
    path, _ = byte_bpe.vocabulary()
    pattern = r"\p{L}+ \p{L}+|[^\p{L}]+|\p{L}+"
    coder, draw = byte_bpe.BytePairCoder(byte_bpe.read_ranks(path), pattern), random.Random(1)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    for _ in range(100):
        text = " ".join(draw.choice(["the", "cat", "sat", "1", "é."]) for _ in range(draw.randint(0, 20)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == own.encode_ordinary(text)


def test_first_tree_is_the_best_split():
    draw = np.random.default_rng(3)
    x, y = draw.integers(0, 6, (80, 3)).astype(float), draw.integers(0, 2, 80).astype(float)
    made = boosting.BoostedTrees(trees=1, depth=1, rate=1.0, ridge=1.0, least=2.0).fit(x, y)
    p = y.mean()
    g, h, best = p - y, np.full(80, p * (1 - p)), (0.0, None)
    for f in range(3):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) >= 2.0:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, (f, cut)), key=lambda b: b[0])
    f, cut = best[1]
    left = x[:, f] <= cut
    want = made.start + np.where(left, -g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1))
    assert np.allclose(made.margin(x), want)


def test_isotonic_steps_are_pooled_means():
    score, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 1, 1, 1])
    made = boosting.Isotonic().fit(score, y)
    assert np.all(np.diff(made(np.linspace(0, 7, 50))) >= 0) and np.isclose(made(np.array([2.5]))[0], 1.25 / 2.5)


def test_toxicity_features_by_hand():
    lexicon = toxicity.Lexicon({"zargl*": 2.0, "mock": 1.0})
    x = lexicon.features("YOU are an idiot, zargling! 1d10t? mock")
    words = ["you", "are", "an", "idiot", "zargling", "d", "t", "mock"]
    assert np.allclose(x[:7], [np.log1p(8), 100 / 8, np.log1p(1), 100 * 2 / 8, np.log1p(2), 3 / 8, np.log1p(3)]) and x[7] == 2.0 and len(words) == 8
    # The three hits within four words of "you": idiot and zargling; masked: d10t alone, which no word is.
    assert np.isclose(x[9], 2 / 8 * 100) and np.isclose(x[14], 2 / 8) and np.isclose(x[13], 1 / 8) and np.isclose(x[17], 1 / 8)
    assert toxicity.masked_words("1d10t! a1b, c2 x@y$ plain 12 q1") == ["d10t", "a1b", "x@y"]
    signs = lambda t: lexicon.features(t)[14]
    assert signs("六个汉字词语") == signs("hello") == signs("“quoted” — text…") == 0 and signs("so?") == 1


def test_language_scores_by_hand():
    counts = [(0, "karo", "xx", 9), (0, "karo", "yy", 1), (0, "berung", "yy", 5), (5, "^baro", "xx", 3), (5, "baro$", "xx", 2), (5, "baro$", "yy", 4), (1, "q", "yy", 3)]
    kinds, entries, languages, n = (list(c) for c in zip(*counts))
    model = language_id.LanguageModel(np.array(kinds), entries, languages, np.array(n))
    log = lambda k, total, size: np.log((k + 0.5) / (total + 0.5 * (size + 1)))
    karo = np.array([log(9, 9, 2), log(1, 6, 2)])
    baro = np.mean([[log(3, 5, 2), log(0, 4, 2)], [log(2, 5, 2), log(4, 4, 2)]], axis=0)
    want = (karo - karo.max()) + (baro - baro.max())
    share = np.exp((want - want.max()) / np.sqrt(2))
    lang, score = model.predict("Karo, baro!")
    assert lang == ("xx", "yy")[int(want.argmax())] and np.isclose(score, share.max() / share.sum(), atol=1e-5)
    assert model.predict("½ ² Ⅷ ③ 12")[0] == "und" and model.predict("q½q")[0] == "yy" and language_id.letter_words("a½b ²") == ["a", "b"]


def test_added_secrets_where_they_were_put():
    draw = random.Random(12)
    plain = ("password=hunter%04d", "AKIAABCDEFGHIJ%08d", "token: %012d")
    wraps = [
        lambda b: base64.b64encode(b).decode(), lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="), lambda b: "".join(f"%{x:02X}" for x in b),
        lambda b: "".join(f"\\x{x:02x}" for x in b), lambda b: "".join(f"&#{x};" for x in b), lambda b: "".join(f"&#x{x:X};" for x in b), lambda b: base64.b64encode(gzip.compress(b)).decode(),
    ]
    for _ in range(60):
        text, want = "", set()
        for _ in range(draw.randint(1, 6)):
            text += " ".join(draw.choice(("plain", "words", "é", "über")) for _ in range(draw.randint(1, 4))) + " "
            kind = draw.randrange(3)
            layer = draw.choice(wraps)((plain[kind] % draw.randrange(1000)).encode())
            if draw.random() < 0.4:
                layer = draw.choice(wraps[:4])(layer.encode())
            want.add((len(text), (0, 1, 0)[kind], len(text) + len(layer)))
            text += layer + " "
        base, added = secret_scan.find_secrets(text)
        assert not base and {x[:3] for x in added} == want
    # Two pieces of one start and content have spans of their own, and so have pieces behind a name.
    path = "dir/" + base64.b64encode(b"password=hunter2222").decode()
    assert [x[:3] for x in secret_scan.find_secrets(path)[1]] == [(0, 0, len(path))]
    assert secret_scan.find_secrets("&#" + "1" * 9000 + "; &#99999999;")[1] == []


def brute_labels(text):
    """Labels by every rule, ungated but for its hint, and suppression pair by pair."""
    joined = b" " + b" ".join(license_scan.words_of(text)) + b" "
    hinted, kept = any(h in joined for h in license_scan.HINTS), []
    for rule in license_scan.rules():
        if hinted or not rule.hinted:
            found = [m.span() for m in rule.pattern.finditer(joined)]
            kept += [(s, e, rule) for s, e in found if not any(a <= s and e <= b for a, b, _ in kept)]
    return sorted((joined.count(b" ", 0, s) - 1, joined.count(b" ", 0, e) - 1, r.label, r.priority) for s, e, r in kept)


def test_license_rules_without_gates_give_the_same():
    draw = random.Random(2)
    parts = ("GNU General Public License", "v2", "version 3", "or later", "MIT", "License", "Apache", "2.0", "under the", "licensed", "BSD", "3-clause", "SPDX-License-Identifier:", "cc by nc", "4.0", "Mozilla Public", "all rights reserved", "word", "LGPL", "2.1", "Creative Commons Attribution", "zlib", "Python")
    for _ in range(400):
        text = " ".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))
        assert [tuple(d) for d in license_scan.scan_text(text)[2]] == brute_labels(text), text


def test_short_items_repeated_items_and_other_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x y z"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "x y"), ("i", "x y"), ("j", "z"), ("k", "a b c d")], "item_id string, text string")
    found = lambda **kw: sorted((r.doc_id, r.item_id) for r in decontamination.contained_items(docs, items, **kw).collect())
    assert found() == [(1, "k")] and found(shortest=1) == [(1, "k"), (2, "i"), (2, "j")] and found(shortest=1, block_bytes=3) == found(shortest=1)
    import pickle

    draw = random.Random(1)
    many = decontamination.BenchmarkIndex([(k, " ".join(f"w{draw.randrange(5000)}" for _ in range(n))) for k, n in enumerate((2000, 20, 20, 400) * 10)])
    assert len(pickle.dumps(many)) < 60 * int(many.n.sum()) + (2 << 20)


def test_window_recall_at_the_most_edits():
    """Windows with all the edits that they may have: candidates must come of the sampled embeddings."""
    draw, lost, tried = random.Random(10), 0, 0
    for n in (7, 8, 9, 13, 14, 15):
        items = [(k, " ".join(f"v{draw.randrange(3000)}" for _ in range(n))) for k in range(60)]
        index = decontamination.BenchmarkIndex(items)
        for k, text in items:
            words = text.split()
            for _ in range(decontamination.allowed_edits(n)):
                at, what = draw.randrange(len(words)), draw.choice("sid")
                words[at : at + (what != "i")] = [] if what == "d" else [f"v{draw.randrange(3000)}"]
            host = " ".join(f"v{draw.randrange(3000)}" for _ in range(20)) + " " + " ".join(words) + " end of it"
            if k in brute_windows(index, host):
                tried, lost = tried + 1, lost + (k not in {i for i, *_ in index.search(host)})
    assert tried > 300 and lost <= 1


def test_word_coder_on_signs_and_spaces():
    pytest.importorskip("tokenizers")
    coder, draw = token_files.WordCoder(token_files.vocabulary()), random.Random(15)
    parts = ["a", "Bé", "word", "1", " ", " ", ". ", ", ", ".", ",", "..", "_", "-", "\x1c", "\x85", "\xa0", "\t", "\n", "'t", "²", "ª", "?", "x.y", "Ω"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    assert coder.encode(texts) == coder._whole(texts)


def test_token_files_whatever_the_session_limits(spark, tmp_path):
    pytest.importorskip("tokenizers")
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "5")
    try:
        token_files.write_token_files(docs, token_files.vocabulary(), f"file://{tmp_path}/ids")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    at = 0
    for r in token_files.read_token_files(spark, f"file://{tmp_path}/ids").orderBy("doc_id").collect():
        assert r.start == at
        at += r.n_tokens
    plan = token_files.find_document(spark, f"file://{tmp_path}/ids", 12)._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,12)" in plan


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    texts = _texts() + ["word " * 60_000, "x" * 300_000, "password=hunter2222 under the mit license " * 3_000]
    rows = [(i, t, "en" if i % 2 else "fr", "s", None, "v", "k", "d", "no") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, "no id", "en", "s", None, "v", "k", "d", "no"), (None, "no id", None, None, None, "v", "k", "d", "no")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ids = Counter(r[0] for r in rows)
    model = language_id.fit(docs)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(texts))] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (
        secret_scan.secret_digests(docs), license_scan.license_digests(docs), language_id.identify(docs, model), toxicity.score_documents(docs, toxicity.fit(docs, labels)),
        byte_bpe.token_digests(docs, *byte_bpe.vocabulary()), sharding.interleave_shards(docs, 3), exact_dedup.exact_groups(docs),
    ):
        got = out.collect()
        assert Counter(r.doc_id for r in got) == ids
        same = [tuple(x for c, x in zip(out.columns, r) if c not in ("shard", "slot")) for r in got if r.doc_id == 2]
        assert len(same) == 3 and len(set(same)) == 1
    token_files.write_token_files(docs, token_files.vocabulary(), f"file://{tmp_path}/ids")
    assert Counter(r.doc_id for r in token_files.token_file_digests(spark, f"file://{tmp_path}/ids").collect()) == ids
    found = decontamination.contained_items(docs, spark.createDataFrame([(1, texts[14])], "item_id long, text string")).collect()
    assert 14 in {r.doc_id for r in found}
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() <= len(rows)


def test_long_texts_take_linear_time():
    n, lexicon = 1 << 20, toxicity.Lexicon({})
    index = decontamination.BenchmarkIndex([(1, "a b c d e f g h i j")])
    lines = "\n".join(base64.b64encode(gzip.compress(b"password=hunter%d" % k)).decode() for k in range(n // 64))
    for text in ("a" * n, "a" * n + "%41", "a" * n + "\\x41", "%41" * (n // 3), "password=hunter2222 " * (n // 20), lines, "cc by nc " * (n // 9), "gpl 2 " * (n // 6), "a1" * (n // 2), " " * n, "a b c d " * (n // 8)):
        for scan in (secret_scan.find_secrets, license_scan.scan_text, lexicon.features, language_id.letter_words, index.search, lambda t: near_dedup.shingle_set(t, 5)):
            began = time.perf_counter()
            scan(text)
            assert time.perf_counter() - began < 15, (scan, text[:20])


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    draw = random.Random(21)
    words = ["".join(draw.choice(["the", "an", "er", "on", "st", "ou", "ea"]) for _ in range(3)) for _ in range(400)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(i, text(60), "en") for i in range(60)]
    passage = text(30)
    for i in range(60, 90):
        base = rows[draw.randrange(60)][1].split(" ")
        what = i % 5
        if what == 0:
            base[draw.randrange(60)] = "other"
        elif what == 1:
            base = [w.upper() for w in base]
        elif what == 2:
            base = base[:20] + passage.split(" ") + base[20:]
        elif what == 3:
            base = ["12", "½", "--"]
        rows.append((i, " ".join(base), "en"))
    rows += [(91, None, None), (None, text(40), "en"), (None, rows[3][1], "en"), (95, rows[5][1], "en"), (95, rows[5][1], "en"), (96, text(30) + " " + "é" * 200_000, "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0, "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = language_id.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    left = [r for r in rows if (lambda p: p[0] != "und" and p[1] >= language_id.LEAST)(model.predict(r[1]))]
    groups = defaultdict(list)
    for r in left:
        groups[lower_ascii(r[1])].append(r)
    left = [max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    sets = [(r, {tuple(w[k : k + 5]) for w in [lower_ascii(r[1]).split()] for k in range(max(1, len(w) - 4))}) for r in left]
    root = {}
    for r, s in sorted((x for x in sets if x[0][0] is not None), key=lambda x: x[0][0]):
        near = {root[q[0]] for q, t in sets if q[0] in root and 100 * len(s & t) >= 80 * len(s | t)}
        root[r[0]] = min(near, default=r[0])
        root = {i: root[r[0]] if of in near else of for i, of in root.items()}
    left = [r for r in left if r[0] is None or root[r[0]] == r[0]]
    index = decontamination.BenchmarkIndex([(1, passage)])
    left = [r for r in left if not brute_windows(index, r[1][:4000])]
    own = byte_bpe.coder(*byte_bpe.vocabulary())
    want = Counter((r[0], len(own.encode(r[1])) // 4, hashlib.sha256(r[1].encode()).hexdigest()) for r in left)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == want and 40 < len(got) < len(rows)
