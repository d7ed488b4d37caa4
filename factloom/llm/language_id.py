"""Language identification: known words first, then ever shorter n-grams.

Training counts words by language. A known word adds its smoothed
log-probability under each language. An unseen word backs off: it is covered
by its character n-grams of the longest length (5 down to 1) of which the
model knows any, each with its own per-language log-probability.

The model is fitted on a bounded sample of labelled rows: of the rows that
have a text and a language and aren't held out, the ``sample`` with the
smallest hash of id and text. Every word and n-gram of the sample is learned;
the model goes to the executors with the function.

Scores: the mean log-probability of the document's letters' words under the
best language, as a softmax over languages of the per-word evidence; 1 means
that one language explains all words.

Defined results: a null text, or one without a letter, is ``und`` with score
0; null ids are held out; rows with a null language aren't learned from; with
nothing to learn from every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the training sample in rows.
SAMPLE = 6_000
LONGEST = 5
#: Words that a worker remembers, besides those of the text at hand.
REMEMBERED = 200_000
_RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: A language that explains a text no better than this share isn't told.
LEAST = 0.5


def letter_words(text: str) -> list[str]:
    """Runs of letters, lower-cased. Numerals that aren't digits, as in "½" or "Ⅷ", are no letters."""
    words = _RUN.findall(text.lower())
    if words and not "".join(words).isalpha():
        words = [x for w in words for x in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return words


def word_grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


class LanguageModel:
    """counts: columns kind, entry, language and n; kind 0 is words, n n-grams."""

    def __init__(self, kinds: np.ndarray, entries: list[str], languages: list[str], n: np.ndarray):
        self.languages = sorted(set(languages))
        at = {x: i for i, x in enumerate(self.languages)}
        column = np.fromiter((at[x] for x in languages), np.int64, len(languages))
        self.index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        self.logs: list[np.ndarray] = []
        for kind, index in enumerate(self.index):
            own = np.flatnonzero(kinds == kind)
            row = np.fromiter((index.setdefault(entries[k], len(index)) for k in own.tolist()), np.int64, len(own))
            counts = np.zeros((len(index), len(self.languages)))
            np.add.at(counts, (row, column[own]), n[own])
            total = counts.sum(axis=0) + 0.5 * (len(index) + 1)
            self.logs.append(np.log((counts + 0.5) / total).astype(np.float32))
        self.forget()

    def forget(self) -> None:
        """Let go of the words remembered."""
        self.rows = np.zeros((1024, len(self.languages)))
        self.known: dict[str, int] = {}

    def word(self, word: str) -> np.ndarray:
        """Log-probability of one word under each language, less that of the best."""
        at = self.index[0].get(word)
        if at is not None:
            found = self.logs[0][at]
            return found - found.max()
        for n in range(LONGEST, 0, -1):
            index = self.index[n]
            known = [x for g in word_grams(word, n) if (x := index.get(g)) is not None]
            if known:
                found = self.logs[n][known].mean(axis=0)
                return found - found.max()
        return np.zeros(len(self.languages))

    def _row(self, word: str) -> int:
        at = len(self.known)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.word(word)
        self.known[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letter_words(text) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if len(self.known) >= REMEMBERED:
            self.forget()
        get, row = self.known.get, self._row
        at = [row(w) if (i := get(w)) is None else i for w in words]
        evidence = self.rows[at].sum(axis=0)
        # Words of a text aren't independent; the evidence counts by its square root.
        share = np.exp((evidence - evidence.max()) / np.sqrt(len(words)))
        best = int(evidence.argmax())
        return self.languages[best], float(share[best] / share.sum())


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and lang of the bounded sample; everything else is held out or left."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")))
    return common.sampled_rows(labelled, sample, 17, "lang").select("text", "lang")


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    common.bound_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            n: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, k in Counter(letter_words(text)).items():
                    n[0, word, lang] += k
                    for length in range(1, LONGEST + 1):
                        for gram in word_grams(word, length):
                            n[length, gram, lang] += k
            keys = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())],
                ["kind", "entry", "lang", "n"],
            )

    rows = common.materialise(training_sample(docs, sample), "language-sample")
    counted = rows.mapInArrow(count, "kind int, entry string, lang string, n long")
    # What the bounded sample holds comes to the driver, as Arrow columns.
    summed = counted.groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n")).toArrow()
    common.free(rows)
    return LanguageModel(summed["kind"].to_numpy(), summed["entry"].to_pylist(), summed["lang"].to_pylist(), summed["n"].to_numpy())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    common.bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = common.held_alone(("language", shipped.value), lambda: shipped.value)
        for batch in batches:
            found = [own.predict(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more; ``und`` goes."""
    common.bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(texts):
        own = common.held_alone(("language", shipped.value), lambda: shipped.value)
        found = (own.predict(text) for text in texts)
        return pd.Series([lang != UNKNOWN and score >= least for lang, score in found], dtype=bool)

    return docs.filter(told("text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = identify(docs, fit(docs))
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
