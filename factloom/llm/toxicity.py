"""Toxicity scores by gradient-boosted trees over dense features.

Features of a whole text: densities of a hand-written and of a learned
lexicon, how near lexicon words stand to second-person words, capitals,
punctuation, and obfuscation rates (letters swapped for digits and signs, with
the restored word looked up in the lexicon). Trees score them; an isotonic
calibration turns margins into frequencies.

Learning. Of the labelled rows that aren't held out, those with the smallest
hash of id and text are taken, ``sample`` rows at most. One half teaches the lexicon
(words and word beginnings whose document log-odds stand out), the other half
the trees and the calibration, so trees see lexicon features as they are on
unseen texts. Labels, language, source and id are never inputs of a score.

Defined results: a null text scores as the empty one, which has features as
any other text; a null id is held out; rows without a label aren't learned
from; contradicting labels of an id count 1 if any is 1; without labels of
both kinds every score is the observed rate; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .boosting import _sigmoid, fit_calibrated

#: Bound of the training sample in rows; what is learned from it is bounded with it.
SAMPLE = 16_000
#: Word beginnings that are learned beside whole words, by length.
STEMS = (5, 6, 7)

# Insults and second-person words of English, French, German and Spanish.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown clowns garbage filth "
    "vermin imbecile fool fools jerk freak creep coward ugly hate crétin imbécile ordure abruti minable débile trottel dumm "
    "versager abschaum widerlich arschloch blöd idiota estúpido estúpida imbécil basura patético patética asqueroso payaso".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself ya u tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer ihr ti tú usted ustedes vosotros tus".split()
)
PLAIN = str.maketrans("013457@$!|", "oieastasil", "*_-")

_WORD = re.compile(r"[^\W\d_]+")
# From the first letter of a run on, each run once; signs at its end are cut off behind.
_MASKED = re.compile(r"(?<![A-Za-z])[A-Za-z]++[0-9@$!|*][A-Za-z0-9@$!|*]*+")
_SIGNS = "0123456789@$!|*"
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_REPEAT = re.compile(r"([!?.,])\1+")
FEATURES = 19


def masked_words(text: str) -> list[str]:
    """Words of ASCII letters with digits or signs between their letters."""
    return [x for m in _MASKED.findall(text) if not (x := m.rstrip(_SIGNS)).isalpha()]


def entries_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


class Lexicon:
    """Word to (insult, learned weight, second person), remembered by word."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, 3), dtype=np.float32)

    def weight(self, word: str) -> float:
        return max((self.weights.get(x, 0.0) for x in entries_of(word)), default=0.0)

    def _add(self, word: str) -> int:
        at = len(self.index)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = (word in INSULTS, self.weight(word), word in SECOND_PERSON)
        self.index[word] = at
        return at

    def features(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if len(self.index) > 200_000:
            self.forget()
        get, add = self.index.get, self._add
        at = np.array([add(w) if (i := get(w)) is None else i for w in words], dtype=np.int64)
        rows = self.rows[at]
        n, chars = max(1, len(words)), max(1, len(text))
        insult, weight, second = rows[:, 0], rows[:, 1], rows[:, 2]
        hits = np.flatnonzero((insult > 0) | (weight > 0))
        persons = np.flatnonzero(second > 0)
        near = 0
        if len(hits) and len(persons):
            right = np.searchsorted(persons, hits)
            gap = np.minimum(np.abs(persons[np.minimum(right, len(persons) - 1)] - hits), np.abs(persons[np.maximum(right - 1, 0)] - hits))
            near = int((gap <= 4).sum())
        masked = masked_words(text)
        unmasked = [x.lower().translate(PLAIN) for x in masked]
        restored = sum(x in INSULTS or self.weight(x) > 0 for x in unmasked)
        kinds = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
        log = np.log1p
        return np.array(
            [
                log(len(words)), 100 * insult.sum() / n, log(insult.sum()),
                100 * (weight > 0).sum() / n, log((weight > 0).sum()), weight.sum() / n, log(weight.sum()),
                weight.max() if len(words) else 0.0, log(len(np.unique(at[hits]))), near / n * 100, log(near),
                100 * len(persons) / n, kinds[65:91].sum() / chars, len(_SHOUT.findall(text)) / n,
                (kinds[33] + kinds[63]) / n, (kinds[33:48].sum() + kinds[58:65].sum()) / chars,
                len(_REPEAT.findall(text)) / n, len(masked) / n, log(restored),
            ]
        )


class ToxicityModel:
    def __init__(self, weights: dict[str, float], x: np.ndarray, y: np.ndarray):
        self.lexicon = Lexicon(weights)
        self.rate = float(y.mean()) if len(y) else 0.0
        self.trees = self.calibration = None
        if 0 < self.rate < 1:
            self.trees, self.calibration = fit_calibrated(x, y)

    def forget(self) -> None:
        self.lexicon.forget()

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        margin = self.trees.margin(np.stack([self.lexicon.features(text or "") for text in texts])) if texts else np.zeros(0)
        # The isotonic steps are flat; a little of the margin keeps the order within a step.
        step = self.calibration(margin)
        return np.clip(0.999 * step + 0.001 * _sigmoid(margin), 0.0, 1.0)


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """half, text, toxic and doc_id of the bounded sample."""
    known = labels.filter(F.col("toxic").isNotNull() & ~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64(F.lit(23), "doc_id")
    picked = known.orderBy(draw, "doc_id").limit(sample)
    labelled = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    half = F.pmod(F.shiftright(draw, 7), F.lit(2)).cast("int").alias("half")
    return common.sampled_rows(labelled, sample, 23, "toxic").select(half, F.coalesce("text", F.lit("")).alias("text"), "toxic", "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    spark = docs.sparkSession
    common.bound_batches(spark)
    rows = common.materialise(training_sample(docs, labels, sample), "toxicity-sample")

    def count(batches):
        for batch in batches:
            n: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[int(toxic > 0)].update({x for w in set(_WORD.findall(text.lower())) for x in entries_of(w)} | {""})
            keys = sorted(set(n[0]) | set(n[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])

    counted = rows.filter("half = 0").select("text", "toxic").mapInArrow(count, "entry string, toxic long, clean long")
    counted = counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic >= 3")
    # The empty entry counts documents: one in each text.
    totals = rows.filter("half = 0").agg(F.count(F.when(F.col("toxic") > 0, 1)), F.count(F.when(F.col("toxic") <= 0, 1))).first()
    odds = F.expr(f"ln((toxic + 0.5) / ({totals[0]} - toxic + 0.5)) - ln((clean + 0.5) / ({totals[1]} - clean + 0.5))")
    spread = F.expr("sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))")
    best = counted.filter("entry <> ''").select("entry", odds.alias("odds"), (odds / spread).alias("z")).filter("z >= 3.5 and odds >= 1.5")
    weights = {r["entry"]: float(r["odds"]) for r in best.collect()}

    def measure(batches):
        lexicon = Lexicon(weights)
        for batch in batches:
            x = [lexicon.features(text).tolist() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([int(v > 0) for v in batch.column(2).to_pylist()], pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    # At most ``sample`` rows of FEATURES numbers come to the driver.
    measured = rows.filter("half = 1").select("text", "doc_id", "toxic").mapInArrow(measure, f"doc_id {kind}, toxic int, x array<double>").collect()
    measured.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in measured], dtype=float).reshape(-1, FEATURES)
    return ToxicityModel(weights, x, np.array([r["toxic"] for r in measured], dtype=float))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""
    common.bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = common.held_alone(("toxicity", shipped.value), lambda: shipped.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_documents(docs, model)
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
