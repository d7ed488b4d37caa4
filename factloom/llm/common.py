"""Shared helpers of the training-data operators.

Everything here is driver-side plumbing: where intermediate tables live, how
large an Arrow batch may get, and how a documents table is read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows and bytes of an Arrow batch that carries whole texts. A batch is the unit
#: of memory in a Python worker: it ends at whichever bound comes first, so only
#: a text that is longer by itself makes a larger one.
BATCH_ROWS, BATCH_BYTES = 64, 16 << 20

#: Keys with more than one in so many of the rows are heavy: no more than so many exist.
HEAVY_SHARE, HEAVY_ROWS = 16_384, 1_024
#: Bits of a sieve: 2 MB, in 262,144 rows.
SIEVE_BITS = 1 << 24


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small for the plans that this session will make.

    The settings are the session's: other queries get the same small batches,
    which cost them a little time and change no result. Local Python workers
    also learn where this package lies; on a cluster it is installed or shipped
    with the job.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster
    session fails, since no machine-local folder can stand in for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="factloom-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    _delete_at_exit(spark, root)
    return root


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_root(spark)}/factloom/{label}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A lost executor then costs the tasks that were running, not the stages
    that made the table.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    for scope in _SCOPES:
        scope.append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """The tables that ``materialise`` makes inside, for ``free_all``."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not made]


def free_all(made: list[DataFrame], *but: DataFrame) -> None:
    """Delete the tables of a scope, but those that plans still read."""
    kept = {df.scratch for df in but}
    free(*(df for df in made if df.scratch not in kept))


def free(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def heavy(counts: DataFrame, rows: str, total: int) -> DataFrame:
    """The rows of ``counts`` that hold more than a share of all ``total`` rows: HEAVY_SHARE at most, so they may be broadcast."""
    return counts.filter(F.col(rows) > max(HEAVY_ROWS, total // HEAVY_SHARE))


def join_split(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined to ``counts``, one row a key, whose column ``n`` says how many rows have the key.

    Heavy keys are joined by broadcast, wherever their rows lie; the others are few each and shuffle.
    """
    hot = materialise(heavy(counts, n, total), "heavy-keys")
    if hot.isEmpty():
        return rows.join(counts, keys)
    light = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counts.join(F.broadcast(hot.select(*keys)), keys, "left_anti"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(light)


def sieved(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose keys aren't in ``wanted``: a semi-join still decides.

    The sieve has one bit for each hash, SIEVE_BITS of them at most whatever the
    input, so it is broadcast; a crowded one lets more rows through and loses none.
    """
    bit = F.pmod(F.xxhash64(F.lit(41), *keys), F.lit(SIEVE_BITS))
    word, mask = fresh_name(rows, "word"), fresh_name(rows, "mask")
    one = F.expr(f"shiftleft(1L, cast({word}_bit & 63 as int))")
    words = wanted.select(bit.alias(f"{word}_bit")).groupBy(F.shiftright(f"{word}_bit", 6).alias(word)).agg(F.bit_or(one).alias(mask))
    found = rows.withColumn(f"{word}_bit", bit).withColumn(word, F.shiftright(f"{word}_bit", 6)).join(F.broadcast(words), word)
    return found.filter(F.col(mask).bitwiseAND(one) != 0).select(*rows.columns)


def one_of_each(docs: DataFrame, stay: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ``docs`` for each key that ``stay`` (keys, n rows of it) has.

    Rows of a key are equal in everything that matters, so any one will do.
    A key with very many rows is reduced in each map task before it moves.
    """
    turn = fresh_name(docs, "turn")
    total = stay.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = materialise(heavy(stay, "n", total).select(*keys), "repeated-rows")
    rest, pick = stay.select(*keys), docs
    many = not hot.isEmpty()
    if many:
        pick, rest = docs.join(F.broadcast(hot), keys, "left_anti"), rest.join(F.broadcast(hot), keys, "left_anti")
    # The window needs the join's own partitioning, so rows move once. Keys are there once, and an inner join stays
    # where it is written: a semi-join would be moved ahead of a sieve.
    one = Window.partitionBy(*keys).orderBy(F.lit(0))
    out = pick.join(rest, keys).withColumn(turn, F.row_number().over(one)).filter(F.col(turn) == 1).select(*docs.columns)
    if many:
        whole = fresh_name(docs, "whole")
        first = docs.join(F.broadcast(hot), keys, "left_semi").groupBy(*keys).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(whole))
        out = out.unionByName(first.select(f"{whole}.*"))
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(column):
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(column, UPPER, LOWER)


def sampled_rows(docs: DataFrame, rows: int, seed: int, *columns: str) -> DataFrame:
    """``text`` and ``columns`` of at most ``rows`` rows of ``docs``, those with the smallest hash of id and text.

    Rows that repeat id, text and ``columns`` count once, so that the bound is one of rows whatever the ids.
    """
    at = F.xxhash64("text")
    draw = F.xxhash64(F.lit(seed), "doc_id", at)
    thin = docs.select("doc_id", at.alias("__text"), *columns, draw.alias("__draw")).distinct()
    picked = thin.orderBy("__draw", "doc_id", "__text", *columns).limit(rows).drop("__draw")
    keys = ["doc_id", "__text", *columns]
    found = docs.select("doc_id", at.alias("__text"), "text", *columns).join(F.broadcast(picked), keys, "left_semi")
    sample = found.groupBy(*keys).agg(F.first("text").alias("text")).drop("__text")
    # Few rows, but much work for each: they are dealt over all cores.
    return sample.repartition(shuffle_partitions(docs.sparkSession), "doc_id")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        name, k = f"__{stem}{k}", k + 1
    return name


def held_out(doc_id):
    """Fold rule: crc32 of the id as text, modulo 5, is 0. Null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


class Remembered:
    """A bounded table of answers: when the young half is full, it becomes the
    old half and the old one goes. What is asked for again moves back."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def recall(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key, answer) -> None:
        if len(self.young) >= self.entries:
            self.young, self.old = {}, self.young
        self.young[key] = answer


_HELD: dict = {}


def held_alone(key, make):
    """What one operator keeps in a Python worker between tasks.

    Workers outlive stages, so what the operator before left there goes first:
    a worker never holds the tables of two operators.
    """
    if key not in _HELD:
        for other in _HELD.values():
            if hasattr(other, "forget"):
                other.forget()
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
