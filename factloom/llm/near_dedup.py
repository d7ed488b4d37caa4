"""Near-duplicate groups by SetSketch registers, banding and full verification.

Shingles. Texts are lower-cased in A-Z and cut into words at ASCII white
space; a document's set holds its distinct runs of ``width`` words (with fewer
words, the whole sequence), as 64-bit hashes of the words.

SetSketch. Register i keeps the minimum over the set of an exponential variate
of the element, on the scale floor(1 - log_b x), truncated to 0 .. q + 1. It
is mergeable by maximum, and two registers agree with a probability close to
the Jaccard similarity for b near 1.

1. Documents with the same set are one class; only its smallest id goes on.
2. Bands of 7 registers are hashed to keys; 56 bands miss a pair of similarity
   0.8 with probability (1 - 0.8^7)^56 < 2e-6. Keys that only one class has
   are dropped.
3. Each key's members are compared with its hub, the member that meets most
   others over all keys: linear in the members, and near copies of one text
   find that text. Then, in keys that still hold several components, all
   members outside the largest one are compared with all. So no pair that
   shares a key is left out, and members of a component are never compared
   with each other in vain.
4. Comparisons are made by set size first: only sets whose sizes may reach the
   threshold meet, so a group is cut into levels of size, and a level into blocks
   of bounded bytes on either side. No pair is ever a row. A pair is first judged
   by the joint likelihood of its registers given both set sizes; only one whose
   estimate is more than five standard errors below the threshold goes. The others
   are verified on their full sets.

Groups and keys with very many rows are found by exact counts; there are few of
them, so they are joined by broadcast and their rows are dealt by block.

Defined results: a null or wordless text has the empty set (0 shingles) and is
linked with nothing; a null doc_id cannot name a component: such a row is
linked with nothing, has a null component and stays; rows that repeat a doc_id
are judged each by its own text; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: SetSketch parameters: base b, rate a, largest register q + 1.
BASE, RATE, TOP = 1.001, 20.0, 65_535
BANDS, BAND_ROWS = 56, 7
#: Registers that the likelihood reads, and standard errors that it forgives.
ESTIMATE, FORGIVE = 128, 5.0
#: Bytes of the sets of a block, on either side, and its rows at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 512
_CHUNK = 1 << 15


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7_919)
    scale = draw.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
    fold = draw.integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return scale, fold


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def set_sketches(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """SetSketch registers (uint16) of each non-empty set."""
    scale = _constants()[0][:registers]
    least = np.full((len(sets), registers), 0xFFFFFFFF, dtype=np.uint32)
    at = 0
    while at < len(sets):
        # As many sets at once as stay in the processor's cache; a longer one in pieces.
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= _CHUNK:
            size += len(sets[to])
            to += 1
        if to > at + 1 or size <= _CHUNK:
            parts = [np.concatenate(sets[at:to])]
        else:
            parts = [sets[at][k : k + _CHUNK] for k in range(0, size, _CHUNK)]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:to]])[:-1]]).astype(np.int64)
        for part in parts:
            element = (part >> np.uint64(32)).astype(np.uint32)
            room = np.empty_like(element)
            for i in range(registers):
                np.multiply(element, scale[i], out=room)
                np.minimum(least[at:to, i], np.minimum.reduceat(room, starts), out=least[at:to, i])
        at = to
    uniform = (least + 0.5) / 4_294_967_296.0
    level = np.floor(1.0 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    fold = _constants()[1]
    rows = sketches[:, : BANDS * BAND_ROWS].reshape(len(sketches), BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.zeros((len(sketches), BANDS), dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys += (rows[:, :, k] + np.uint64(1)) * fold[:, k]
    return _mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches, set sizes given."""
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - up - down
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    grid = np.linspace(0.0, 0.9995, 81)[None, :] * np.minimum(u / v, v / u)
    over = lambda x: -np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)
    p, q = over(u - v * grid), over(v - u * grid)
    score = up * np.log(p) + down * np.log(q) + same * np.log(np.clip(1.0 - p - q, 1e-12, 1.0))
    return np.take_along_axis(grid, score.argmax(axis=1)[:, None], axis=1)[:, 0]


# -- the corpus ------------------------------------------------------------------


def _sketch_documents(docs: DataFrame, width: int) -> DataFrame:
    """id, text hash, set size, set digest (null if empty) and band keys of every row."""

    def run(batches):
        common.held_alone("near_dedup", dict)
        for batch in batches:
            sets = [shingle_set(text, width) for text in batch.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            keys = band_keys(set_sketches(full, BANDS * BAND_ROWS)) if full else np.empty((0, BANDS), dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum([BANDS if len(s) else 0 for s in sets])])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.ravel(), pa.int64())),
                ],
                ["id", "text_hash", "n", "digest", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "id long, text_hash long, n long, digest binary, keys array<long>"
    )


def _member_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, set size, registers and full set of the classes that share a key."""

    def run(batches):
        common.held_alone("near_dedup", dict)
        for batch in batches:
            ids, sets = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, width)
                if len(s):
                    ids.append(i)
                    sets.append(s)
            registers = set_sketches(sets, ESTIMATE) if sets else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in registers], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["id", "n", "registers", "members"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    # A class' text is found by id and hash; rows that repeat both give it once. Most texts are left where they lie.
    found = common.one_of_each(common.sieved(texts, wanted, ["id", "text_hash"]), wanted, ["id", "text_hash"]).select("id", "text")
    return found.mapInArrow(run, "id long, n long, registers binary, members binary")


def _compare(threshold: float):
    """Links (a, b) of one block: rows of side 0 against rows of side 1.

    One link from a row to a component is enough, so the others aren't made.
    """
    percent = round(100 * threshold)
    floor = threshold - FORGIVE * np.sqrt(threshold * (1 - threshold) / ESTIMATE)

    def run(block):
        common.held_alone("near_dedup", dict)
        side, ids, part, n = (block.column(c).to_numpy() for c in ("side", "id", "part", "n"))
        registers = np.frombuffer(b"".join(block.column("registers").to_pylist()), np.uint16).reshape(len(ids), ESTIMATE)
        members = [np.frombuffer(x, np.uint64) for x in block.column("members").to_pylist()]
        right = np.flatnonzero(side == 1)
        out = []
        for x in np.flatnonzero(side == 0).tolist():
            fits = (part[right] != part[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))
            near = right[fits]
            if len(near):
                j = estimated_jaccard(np.broadcast_to(registers[x], (len(near), ESTIMATE)), registers[near], np.full(len(near), float(n[x])), n[near].astype(float))
                near = near[j >= floor][np.argsort(-j[j >= floor], kind="stable")]
            done = set()
            for y in near.tolist():
                if part[y] not in done:
                    both = len(np.intersect1d(members[x], members[y], assume_unique=True))
                    if 100 * both >= percent * (n[x] + n[y] - both):
                        done.add(part[y])
                        out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _level(threshold: float):
    """Level of a set size: sizes that differ by more than the threshold allows are never in the same or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / (math.log(1 / threshold) * 1.0001)).cast("int")


def _cuts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Each (group, level) of left rows that right rows of this or a neighbouring level (beside) may meet, and its numbers of blocks."""
    size = lambda df, name: df.groupBy("group", "level").agg(F.count(F.lit(1)).alias(name))
    level = F.col("level")
    near = size(left, "left_rows").withColumn("beside", F.explode(F.array(level - 1, level, level + 1)))
    met = near.join(size(right, "n").withColumnRenamed("level", "beside"), ["group", "beside"])
    # A set of this level has 8 bytes a shingle; so many fit in a block.
    step = math.log(1 / threshold) * 1.0001
    fit = F.greatest(F.least(F.floor(BLOCK_BYTES / (8 * F.exp((level + 1) * step))), F.lit(BLOCK_ROWS)), F.lit(1))
    right_rows = F.sum("n").over(Window.partitionBy("group", "level"))
    blocks = lambda rows: F.ceil(rows / fit).cast("int")
    return met.select("group", "level", "beside", "left_rows", "n", blocks(F.col("left_rows")).alias("left_blocks"), blocks(right_rows).alias("right_blocks"))


def _compare_groups(left: DataFrame, right: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the left and the right rows (group, id, n, part) of each group.

    Each pair of blocks of a level is a task's work; a set is sent once for
    each block that it meets, not for each pair.
    """
    level = _level(threshold)
    left, right = (df.select("group", level.alias("level"), "id", "part") for df in (left, right))
    cuts = common.materialise(_cuts(left, right, threshold), "cuts")
    keys = ["group", "level"]
    of_left = cuts.groupBy(*keys).agg(F.first("left_rows").alias("left_rows"), F.first("left_blocks").alias("left_blocks"), F.first("right_blocks").alias("right_blocks"))
    total = cuts.agg(F.coalesce(F.sum("left_rows") + F.sum("n"), F.lit(0))).first()[0]
    number = lambda n: F.pmod(F.xxhash64(F.lit(5), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = common.join_split(left, common.materialise(of_left, "left-cuts"), keys, "left_rows", total)
    other = common.join_split(right.withColumnRenamed("level", "beside"), cuts, ["group", "beside"], "n", total)
    rows = one.select(*keys, "id", "part", F.lit(0).alias("side"), number("left_blocks").alias("left_block"), every("right_blocks").alias("right_block")).unionByName(
        other.select(*keys, "id", "part", F.lit(1).alias("side"), every("left_blocks").alias("left_block"), number("right_blocks").alias("right_block"))
    )
    return rows.join(sets, "id").groupBy(*keys, "left_block", "right_block").applyInArrow(_compare(threshold), "a long, b long")


def _links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Roots of the classes: (id, root) for every class that is not its component's smallest."""
    # 1. Each key's members against its hub, the member that meets most others in all keys.
    weight = members.groupBy("id").agg(F.sum("key_rows").alias("met"))
    met = common.materialise(members.join(weight, "id").select("key", "key_rows", "id", "n", "met"), "met")
    total = met.count()
    hubs = met.groupBy("key").agg(F.max_by(F.struct("id", "n"), F.struct("met", -F.col("id"))).alias("hub"), F.count(F.lit(1)).alias("rows"))
    hubs = common.materialise(hubs.select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), "rows"), "hubs")
    pairs = common.join_split(met.select("key", "id", "n"), hubs, ["key"], "rows", total).filter("id <> hub")
    pairs = common.materialise(pairs.select(F.col("hub").alias("group"), "hub_n", "id", "n", F.col("id").alias("part")).distinct(), "hub-pairs")
    own = pairs.select("group", F.col("group").alias("id"), F.col("hub_n").alias("n"), F.col("group").alias("part")).distinct()
    links = common.materialise(_compare_groups(own, pairs.drop("hub_n"), sets, threshold), "hub-links")
    roots = connected_components(links)

    # 2. In keys with several components, what is outside the largest one against all. A
    # group is a component with the outsiders of all keys in which it is the largest, so
    # a pair that shares many keys is compared once.
    placed = met.join(roots, "id", "left").select("key", "id", "n", "met", F.coalesce("root", "id").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo < hi").select("key", "rows")
    placed = common.materialise(common.join_split(placed, common.materialise(mixed, "mixed"), ["key"], "rows", total), "mixed-keys")
    parts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("part_rows"), F.max("met").alias("met"))
    tops = parts.groupBy("key").agg(F.max_by("part", F.struct("part_rows", "met", -F.col("part"))).alias("group"), F.sum("part_rows").alias("rows"))
    tops = common.materialise(tops, "tops")
    outside = common.join_split(placed.drop("rows"), tops, ["key"], "rows", total).filter(F.col("part") != F.col("group")).select("group", "id", "n", "part").distinct()
    outside = common.materialise(outside, "outsiders")
    whole = common.materialise(placed.select("id", "n", F.col("part").alias("group"), "part").distinct(), "mixed-whole")
    wanted = whole.groupBy("group").agg(F.count(F.lit(1)).alias("rows")).join(outside.select("group").distinct(), "group", "left_semi")
    whole = common.join_split(whole, common.materialise(wanted, "mixed-groups"), ["group"], "rows", total)
    more = common.materialise(_compare_groups(outside, outside.unionByName(whole.select(*outside.columns)), sets, threshold), "outsider-links")
    if more.isEmpty():
        return roots
    return connected_components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_groups(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of every row."""
    with common.scope() as made:
        sketches, named = _classes_and_components(docs, width, threshold)
    common.free_all(made, sketches, named)
    full = sketches.filter("digest is not null and id is not null")
    own = ("id", "text_hash", "n")
    linked = common.join_split(full.select(*own, "digest"), named, ["digest"], "rows", sketches.count()).select(*own, "of_class")
    alone = sketches.filter("digest is null or id is null").select(*own, F.col("id").alias("of_class"))
    return linked.unionByName(alone).select(
        F.col("id").alias("doc_id"), "text_hash", F.col("n").alias("n_shingles"), F.col("of_class").alias("component_id"), F.col("id").eqNullSafe(F.col("of_class")).alias("kept")
    )


def _classes_and_components(docs: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and for each digest of a set its rows and its component."""
    common.bound_batches(docs.sparkSession)
    sketches = common.materialise(_sketch_documents(docs, width), "sketches")
    full = sketches.filter("digest is not null and id is not null")
    # Rows that repeat an id and a text count once; how often they come is kept, for the joins.
    repeats = full.groupBy("digest", "n", "id", "text_hash").agg(F.count(F.lit(1)).alias("repeats"))
    classes = repeats.groupBy("digest", "n").agg(F.min(F.struct("id", "text_hash", "repeats")).alias("first"), F.sum("repeats").alias("rows"))
    classes = common.materialise(classes.select("digest", F.col("n").alias("size"), "rows", "first.*"), "classes")
    chosen = classes.select("digest", "id", "text_hash", F.col("repeats").alias("n"))
    one = common.one_of_each(full.select("digest", "id", "text_hash", "n", "keys"), chosen, ["digest", "id", "text_hash"])
    banded = common.materialise(one.select("id", "n", F.explode("keys").alias("key")), "bands")
    shared = common.materialise(banded.groupBy("key").agg(F.count(F.lit(1)).alias("key_rows")).filter("key_rows > 1"), "shared-keys")
    total = shared.agg(F.coalesce(F.sum("key_rows"), F.lit(0))).first()[0]
    members = common.materialise(common.join_split(banded, shared, ["key"], "key_rows", total), "members")
    wanted = classes.select("id", "text_hash", F.col("repeats").alias("n")).join(members.select("id").distinct(), "id", "left_semi")
    sets = common.materialise(_member_sets(docs, common.materialise(wanted, "wanted"), width), "member-sets")
    roots = _links(members, sets, threshold)
    named = classes.join(roots, "id", "left").select("digest", "rows", F.coalesce("root", "id").alias("of_class"))
    return sketches, common.materialise(named, "named")


def drop_near_copies(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one document of each group, and every row without an id."""
    key, of_text = (common.fresh_name(docs, x) for x in ("key", "hash"))
    with common.scope() as made:
        stay = near_groups(docs, width, threshold).filter("kept and doc_id is not null")
        stay = common.materialise(stay.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(of_text)).agg(F.count(F.lit(1)).alias("n")), "near-stay")
    common.free_all(made, stay)
    known = docs.filter("doc_id is not null").withColumns({key: F.col("doc_id").cast("long"), of_text: F.xxhash64("text")})
    return common.one_of_each(known, stay, [key, of_text]).select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.documents(spark, sf_dir), width=2, threshold=0.8).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS meet FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * meet >= 80 * (x.n + y.n - meet)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
