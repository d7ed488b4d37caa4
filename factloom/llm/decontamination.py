"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Words are runs of ASCII letters and digits and of non-ASCII characters, after
lower-casing A-Z; scripts without spaces between words are cut into characters.
An item of n words is contained in a document if some place there is within
floor(EDIT_RATE n) word edits of it, for items under 7 words an exact place.

1. Windows. An item is cut into windows of 8 to 15 words (a shorter item is one
   window). Some window of m has no more than edits / m of the item's edits, so
   it is enough to find windows with 2 edits at most, however long the item.
   Such a window holds a run of its words unchanged, of 4 words if it has 8 or
   more; only starts that such a run of a document allows, give or take the
   window's edits, are looked at. This loses nothing.
2. Each such place is embedded by the CGK random walk: at step j the current
   word is written out and the pointer advances if the j-th random function of
   that word says so. Edit distance becomes Hamming distance: after an edit, two
   walks meet again within a few steps.
3. Bit-sampling LSH: ``WALKS`` walks, each sampled in ``TABLES`` sets of
   ``SAMPLED`` steps; a place that equals a window in one set is a candidate.
   The numbers give a recall over 0.9999 for a window at its largest number of
   edits; tests measure it. A long item has several such windows.
4. Round a candidate the whole item is compared by exact word edit distance, all
   starts at once: costs and starts are kept in one number, so the least cost
   comes with its first start. Only this decides.

The benchmark is a stated query set. It is read in blocks of bounded size, and
each block is searched against all documents, whole texts. A block's index has
about 45 bytes for a word of an item, whatever the items' lengths.

Defined results: null or wordless texts hold no item; a null item id is
reported as null; items that repeat id and text are one item, repeated
documents are reported each; items shorter than ``shortest`` words match
nothing; an item that occurs several times in a document is one row, with its
best place; an empty table or benchmark gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Share of an item's words that may be edited, and the words of a window at least.
EDIT_RATE, WINDOW = 0.15, 8
WALKS, TABLES, SAMPLED = 8, 8, 3
#: Longest runs that the first filter reads.
RUN = 4
#: Items of fewer words are too short to tell a passage by: a parameter of the searches.
SHORTEST = 4
#: Bytes of item text in a block.
BLOCK_BYTES = 8 << 20
#: Places that are embedded at once.
_PLACES = 4096

# Thai to Burmese, Khmer, ideographs with their radicals and marks, kana, bopomofo.
_UNSPACED = re.compile("([\u0e00-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_SPLIT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    text = text or ""
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", text)
    return text.encode().translate(_SPLIT).split()


def symbols(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def allowed_edits(n: int) -> int:
    return int(EDIT_RATE * n)


def windows_of(n: int) -> list[tuple[int, int, int, int]]:
    """(first word, words, edits, run) of the windows of an item of n words; some window's ``run`` words stand unchanged."""
    m = max(1, n // WINDOW)
    edits = allowed_edits(n) // m
    bounds = [k * n // m for k in range(m + 1)]
    return [(a, b - a, edits, min(RUN, -(-(b - a - edits) // (edits + 1)))) for a, b in zip(bounds, bounds[1:])]


def _runs(s: np.ndarray, size: int) -> np.ndarray:
    if len(s) < size:
        return np.empty(0, dtype=np.uint64)
    h = np.full(len(s) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ s[k : len(s) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class BenchmarkIndex:
    """A block of items: their windows, the windows' runs of words and sampled embeddings."""

    def __init__(self, items: list[tuple[int | None, str | None]], shortest: int = SHORTEST, seed: int = 404):
        kept = [(i, s) for i, s in ((i, symbols(text)) for i, text in items) if len(s) >= max(1, shortest)]
        self.ids = [i for i, _ in kept]
        self.items = [s for _, s in kept]
        self.n = np.array([len(s) for s in self.items], dtype=np.int64)
        self.edits = np.array([allowed_edits(n) for n in self.n.tolist()], dtype=np.int64)
        cut = [(k, *w) for k, s in enumerate(self.items) for w in windows_of(len(s))]
        self.item_of, self.first, self.words, self.slack, runs = (np.array(c, dtype=np.int64) for c in zip(*cut)) if cut else [np.empty(0, np.int64)] * 5
        draw = np.random.default_rng(seed)
        self.walk = draw.integers(0, 1 << 63, (WALKS, 4 * WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # Steps as shares of a window's 2n; a later one is rarer, as it needs a longer walk.
        self.share = np.sort(draw.random((WALKS, TABLES, SAMPLED)), axis=2)
        self.code = self._codes(np.concatenate(self.items), np.concatenate([[0], np.cumsum(self.n)[:-1]])[self.item_of] + self.first, self.words) if cut else None
        # For each size of runs: sorted hashes, and the window and offset of each.
        self.runs = {}
        for size in np.unique(runs).tolist():
            found = [(h, w, at) for w in np.flatnonzero(runs == size).tolist() for at, h in enumerate(_runs(self._words(w), size).tolist())]
            found.sort()
            h = np.array([x[0] for x in found], dtype=np.uint64)
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.runs[size] = h, np.array([x[1] for x in found], np.int32), np.array([x[2] for x in found], np.int16), sieve

    def _words(self, w: int) -> np.ndarray:
        return self.items[self.item_of[w]][self.first[w] : self.first[w] + self.words[w]]

    def _codes(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """16 bits of every table's sampled steps, of the CGK walks over flat[start : start + length]."""
        out = np.zeros((len(start), WALKS * TABLES), dtype=np.uint16)
        flat = np.concatenate([flat, np.zeros(1, np.uint64)])
        for w in range(WALKS):
            # Windows are embedded step by step; 0 stands behind a window's or the text's end.
            steps = np.zeros((int(2 * length.max()) if len(length) else 0, len(start)), dtype=np.uint64)
            at = np.zeros(len(start), dtype=np.int64)
            for j in range(len(steps)):
                steps[j] = np.where(at < length, flat[np.minimum(start + at, len(flat) - 1)], np.uint64(0))
                at += ((steps[j] * self.walk[w, j]) >> np.uint64(63)).astype(np.int64)
            every = np.arange(len(start))
            for t in range(TABLES):
                h = np.full(len(start), t + 1, dtype=np.uint64)
                for share in self.share[w, t]:
                    h = (h ^ steps[(share * 2 * length).astype(np.int64), every]) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(31)
                out[:, w * TABLES + t] = (h >> np.uint64(40)).astype(np.uint16)
        return out

    def _places(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every place that an unchanged run allows, each once."""
        codes = [np.empty(0, np.int64)]
        wide = len(s) + 2 * WINDOW
        for size, (hashes, window_of, offset_of, sieve) in self.runs.items():
            h = _runs(s, size)
            hit = np.flatnonzero(sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(hit):
                continue
            low, high = np.searchsorted(hashes, h[hit], "left"), np.searchsorted(hashes, h[hit], "right")
            many = high - low
            if not many.any():
                continue
            run = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            window, start = window_of[run].astype(np.int64), np.repeat(hit, many) - offset_of[run]
            for shift in range(-int(self.slack[window].max()), int(self.slack[window].max()) + 1):
                fits = np.flatnonzero((np.abs(shift) <= self.slack[window]) & (start + shift >= 0) & (start + shift < len(s)))
                codes.append(window[fits] * wide + start[fits] + shift)
        code = np.unique(np.concatenate(codes))
        return code // wide, code % wide

    def _regions(self, s: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, end) of every part of a text round a candidate of the item."""
        window, start = self._places(s)
        good = [np.empty(0, np.int64)]
        for part in range(0, len(window), _PLACES):
            w = window[part : part + _PLACES]
            same = self._codes(s, start[part : part + _PLACES], np.minimum(self.words[w], len(s) - start[part : part + _PLACES])) == self.code[w]
            good.append(part + np.flatnonzero(same.any(axis=1)))
        good = np.concatenate(good)
        if not len(good):
            return []
        w = window[good]
        k, begin = self.item_of[w], start[good] - self.first[w]
        first = np.maximum(begin - self.edits[k], 0)
        end = np.minimum(begin + self.n[k] + self.edits[k], len(s))
        order = np.lexsort((first, k))
        k, first, end = k[order], first[order], end[order]
        # Overlapping parts of an item are one; a new one starts behind all ends before it.
        far = np.maximum.accumulate(end + k * (len(s) + 1)) - k * (len(s) + 1)
        fresh = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (first[1:] > far[:-1])]))
        return list(zip(k[fresh].tolist(), first[fresh].tolist(), far[np.append(fresh[1:], len(k)) - 1].tolist()))

    def _best(self, s: np.ndarray, k: int) -> tuple[int, int]:
        """Least word edits of item k over every place in s, and its first start there."""
        one = len(s) + 1
        row = np.arange(one, dtype=np.int64)
        step = row * one
        for word in self.items[k]:
            nxt = row + one
            np.minimum(nxt[1:], row[:-1] + (s != word) * one, out=nxt[1:])
            row = np.minimum.accumulate(nxt - step) + step
        return divmod(int(row.min()), one)

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, start in words, edits) of every contained item, its best place first met."""
        if not self.items:
            return []
        s = symbols(text)
        best: dict[int, tuple[int, int]] = {}
        for k, first, end in self._regions(s):
            edits, start = self._best(s[first:end], k)
            if edits <= self.edits[k]:
                best[k] = min(best.get(k, (edits, first + start)), (edits, first + start))
        return [(k, start, edits) for k, (edits, start) in best.items()]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST):
    """The benchmark's items as indexes, a block of bounded size at a time; repeated items are one."""
    items = benchmark.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.count(F.lit(1))).first()
    n = max(1, -(-int(size[0] or 0) // block_bytes), -(-size[1] // 100_000))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield BenchmarkIndex([tuple(r) for r in items.filter(part == k).collect()], shortest)


def contained_items(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, start_word, item_words and edits of every item that a document contains."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    names = ["doc_id", "item_id", "start_word", "item_words", "edits"]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def search_in(shipped):
        def run(batches):
            index = common.held_alone(("benchmark", shipped.value), lambda: shipped.value)
            for batch in batches:
                rows = [
                    (d, index.ids[k], start, int(index.n[k]), edits)
                    for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for k, start, edits in index.search(text)
                ]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [batch.column(0).type, item_type, pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        return run

    out = None
    for index in blocks(benchmark, block_bytes, shortest):
        found = docs.select("doc_id", "text").mapInArrow(
            search_in(spark.sparkContext.broadcast(index)), f"doc_id {kind}, item_id {item_kind}, start_word long, item_words long, edits long"
        )
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    common.bound_batches(docs.sparkSession)

    def filter_by(shipped):
        @F.pandas_udf("boolean")
        def clean(texts):
            index = common.held_alone(("benchmark", shipped.value), lambda: shipped.value)
            return texts.map(lambda text: not index.search(text)).astype(bool)

        return clean

    for index in blocks(benchmark, block_bytes, shortest):
        docs = docs.filter(filter_by(docs.sparkSession.sparkContext.broadcast(index))("text"))
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
