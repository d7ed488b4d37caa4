"""Token ids in ORC files: write in id order, read back, look up.

The format is plain ORC with columns doc_id, before (ids of the documents
ahead in the same file), n_tokens and ids (array<int>, which ORC stores as
run-length encoded integers in stripes). Row indexes and Bloom filters are
kept on doc_id, so a reader prunes stripes and row groups from metadata and
stripes are read in parallel.

Documents are dealt to files by ranges of (doc_id, hash of the text), so files
ascend with doc_id, a repeated id has a fixed order, and no task holds more
than its range. Positions in the whole corpus are file totals summed over
files plus ``before``; no window runs over documents.

Defined results: a null text has no ids but the end id; null doc_ids come
first; an empty table gives files without rows and no result.
"""

from __future__ import annotations

import json
import os
import string
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END_ID = 2
#: Words that a worker remembers; about 150 MB.
REMEMBERED = 400_000


#: Latin-1 with every sign that is no letter, digit or white space as "!".
_SIGNS = bytes(b if chr(b).isalnum() or b in b"\t\n\x0b\x0c\r " else 33 for b in range(256))


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters: printable Latin-1 stands for itself, other bytes for 256, 257, ..."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


class WordCoder:
    """Encodes by the tokenizers library, each space-separated word once.

    The vocabulary's normaliser and splitter never join across a space and
    drop it, so the ids of a text are those of its words in turn. In Latin-1
    texts no character composes with another and lower case is letter by
    letter, so these are lower-cased first: fewer words are new. A new word of
    letters is one match of the splitter and goes to the library's BPE model
    at once; a run of ASCII signs behind it is the splitter's next match. Any
    other word takes the library's whole path.

    All that holds for a tokenizer of the description checked below; with any
    other one, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        splits = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
            and splits[0]["behavior"] == "Removed"
            and splits[0]["invert"]
            and splits[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and not splits[1]["add_prefix_space"]
            and not made.get("post_processor")
        )
        self.special = [x["content"] for x in made.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.model = self.tokenizer.model.tokenize
        self.words = _Words(self._word)
        self.tails: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_packed(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes | None:
        """Ids of a lower-case word of Latin-1 letters; null for any other word."""
        if not word.isalpha():
            return None
        if not word.isascii():
            if max(word) >= "\u0100":
                return None
            plain, word = word, word.encode().decode("latin-1").translate(self.letters)
            if plain != plain.lower():
                return None
        elif not word.islower():
            return None
        return _packed([x.id for x in self.model(word)])

    def _plain(self, word: str) -> bool:
        """Whether ``_letters`` answers for a word of letters."""
        if word.isascii():
            return word.islower()
        return max(word) < "\u0100" and word == word.lower()

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = self._whole([tail])[0]
            if len(self.tails) < 10_000 and len(tail) < 16:
                self.tails[tail] = ids
        return ids

    def _word(self, word: str) -> bytes:
        stem = word.rstrip(string.punctuation)
        if len(stem) == len(word):
            ids = self._letters(word)
            return self._whole([word])[0] if ids is None else ids
        # The stem is mostly known by itself.
        return self.words[stem] + self._tail(word[len(stem) :]) if stem.isalpha() and self._plain(stem) else self._whole([word])[0]

    def _split(self, text: str) -> list[str]:
        text = text.replace("\n", " ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split(" ")
        # A special token's string may hold capitals of its own.
        if any(x in text for x in self.special):
            return text.split(" ")
        text = text.lower()
        # Where no two signs stand together, a stop or a comma ahead of a space is a match by itself: set off, it makes no new words.
        if b"!!" not in text.encode("latin-1").translate(_SIGNS):
            text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        of = self.words.__getitem__
        return [b"".join(map(of, self._split(text))) for text in texts]


class _Words(dict):
    """Ids by word, asked for when first met; a bounded table in two halves."""

    def __init__(self, ask):
        super().__init__()
        self.ask, self.old = ask, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.ask(word)
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def coder(path: str) -> WordCoder:
    return common.held_alone(("token_files", path), lambda: WordCoder(path))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> None:
    spark = docs.sparkSession
    common.bound_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        own, before = coder(tokenizer), 0
        for batch in batches:
            end = np.array([end_id], dtype="<u4").tobytes()
            raw = [x + end for x in own.encode([text or "" for text in batch.column(1).to_pylist()])]
            sizes = np.array([len(x) // 4 for x in raw], dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before + bounds[:-1], pa.int64()), pa.array(sizes, pa.int64()), ids], ["doc_id", "before", "n_tokens", "ids"])
            before += int(bounds[-1])

    # A task writes one file, whatever the session says: ``before`` counts in it.
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, f"doc_id {kind}, before long, n_tokens long, ids array<int>").write.options(
        **{"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "maxRecordsPerFile": "0"}
    ).orc(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start in the corpus, n_tokens and ids of every document."""
    kept = spark.read.orc(folder).withColumn("file", F.input_file_name())
    return _with_start(kept).select("doc_id", "start", "n_tokens", "ids")


def _file_number(column):
    return F.regexp_extract(column, r"part-(\d+)", 1).cast("long"), column


def _file_bases(kept: DataFrame) -> DataFrame:
    """Ids ahead of each file; a row for each file, not for documents."""
    totals = kept.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    ahead = Window.orderBy(*_file_number(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("file_tokens").over(ahead), F.lit(0)).alias("base"))


def _with_start(kept: DataFrame) -> DataFrame:
    return kept.join(_file_bases(kept), "file").withColumn("start", F.col("base") + F.col("before"))


def find_document(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """One document's ids; the filter prunes files, stripes and row groups by metadata."""
    return spark.read.orc(folder).filter(F.col("doc_id") == F.lit(doc_id)).select("doc_id", "n_tokens", "ids")


def token_file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids, all from the files."""
    common.bound_batches(spark)

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            bounds = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            n = pa.array(np.diff(bounds).astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), n, pa.array(sums, pa.int64())], ["file", "doc_id", "before", "n_tokens", "ids_crc32"])

    kept = spark.read.orc(folder)
    kind = dict(kept.dtypes)["doc_id"]
    read = kept.select(F.input_file_name().alias("file"), "doc_id", "before", "ids").mapInArrow(run, f"file string, doc_id {kind}, before long, n_tokens long, ids_crc32 long")
    bases = _file_bases(kept.select(F.input_file_name().alias("file"), "n_tokens"))
    return read.join(bases, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "token-files")
    write_token_files(common.documents(spark, sf_dir), vocabulary(), folder)
    return token_file_digests(spark, folder)
