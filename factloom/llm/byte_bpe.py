"""Byte-level BPE by rank files: encode whole texts, decode ids.

Two-tier lookup. A minimal perfect hash over the vocabulary maps a pre-token to
its only possible slot; if the slot holds the same bytes, its rank is the
answer. A miss is merged by a heap over a doubly linked list of its bytes, in
O(n log n) for n bytes, so one pre-token of megabytes is no special case.

Answers are remembered per Python worker in two bounded tables (pre-tokens,
and space-separated chunks whose split cannot depend on their neighbours);
they only save time. Chunks are used with the pattern that they were proved
for; with any other one whole texts are split.

Defined results: a null text is encoded as the empty text; repeated rows and
ids are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Answers that a worker remembers, of texts up to LONG characters; about 150 MB.
PIECES, CHUNKS, LONG = 140_000, 250_000, 64
_MASK = (1 << 64) - 1
#: Odd 64-bit multipliers of the slot hash.
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys, n slots.

    128 bits are drawn from a key; the first half picks a bucket, and the
    bucket's displacement moves the mixed second half to the slot. Buckets of
    one key are put into the slots left over.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = max(1, len(keys)), max(1, len(keys) // 3)
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            bits = xxhash.xxh3_128_intdigest(key)
            groups[(bits >> 64) % self.buckets].append((bits & _MASK, key))
        self.shift = array("q", [0]) * self.buckets
        self.slots: list[bytes | None] = [None] * self.n
        taken = np.zeros(self.n, dtype=bool)
        order = sorted(range(self.buckets), key=lambda k: -len(groups[k]))
        left = 0
        for k in order:
            if len(groups[k]) > 1:
                d, spots = self._displace(np.array([a for a, _ in groups[k]], dtype=np.uint64), taken)
                self.shift[k] = d
                taken[spots] = True
                for at, (_, key) in zip(spots.tolist(), groups[k]):
                    self.slots[at] = key
            elif groups[k]:
                while taken[left]:
                    left += 1
                taken[left] = True
                self.shift[k], self.slots[left] = -left - 1, groups[k][0][1]

    def _displace(self, low: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
        start = 1
        while True:
            d = np.arange(start, start + 256, dtype=np.uint64)[:, None]
            h = low[None, :] + d * np.uint64(_STEP)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
            spots = ((h ^ (h >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)
            free = np.flatnonzero(~taken[spots].any(axis=1))
            for row in free.tolist():
                if len(set(spots[row].tolist())) == len(low):
                    return start + row, spots[row]
            start += 256

    def slot(self, key: bytes) -> int:
        """The slot of ``key``, or -1 if it is none of the keys."""
        bits = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(bits >> 64) % self.buckets]
        if d < 0:
            at = -d - 1
        else:
            h = (bits + d * _STEP) & _MASK
            h = ((h ^ (h >> 32)) * _MIX) & _MASK
            at = (h ^ (h >> 32)) % self.n
        return at if self.slots[at] == key else -1


# Fixed value: the pattern whose matches between two spaces depend on what stands there only.
_BY_SPACES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BytePairCoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.by_chunks = pattern == _BY_SPACES
        self.ranks = ranks
        self.perfect = PerfectHash(list(ranks))
        self.slot_rank = [ranks.get(token, -1) for token in self.perfect.slots]
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces, self.chunks = common.Remembered(PIECES), common.Remembered(CHUNKS)

    def _merge(self, piece: bytes) -> list[int]:
        # A heap entry is rank << 32 | position: lowest rank first, then leftmost.
        rank_of = self.ranks.get
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            left = parts[i]
            if left is None or (j := after[i]) >= n:
                continue
            both = left + parts[j]
            if rank_of(both) != entry >> 32:  # an entry of a pair that is gone
                continue
            parts[i], parts[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(both + parts[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (k := before[i]) >= 0 and (r := rank_of(parts[k] + both)) is not None:
                heappush(heap, r << 32 | k)
        ranks = self.ranks
        return [ranks[part] for part in parts if part is not None]

    def _piece(self, text: str) -> bytes:
        found = self.pieces.recall(text)
        if found is None:
            raw = text.encode()
            at = self.perfect.slot(raw)
            ids = array("I", [self.slot_rank[at]] if at >= 0 else self._merge(raw))
            if sys.byteorder == "big":
                ids.byteswap()
            found = ids.tobytes()
            if len(text) < LONG:
                self.pieces.keep(text, found)
        return found

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        if not self.by_chunks or not first or first[-1].isspace():
            return self._pieces(text)
        get, out = self.chunks.young.get, [self._pieces(first)]
        for chunk in rest:
            ids = get(chunk)
            if ids is None:
                ids = self.chunks.recall(chunk)
                if ids is None:
                    # Between two spaces, text that neither starts nor ends with
                    # white space is split as if it stood alone after a space.
                    if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                        return self._pieces(text)
                    # A run of letters is one match, and so is a stop or comma behind it.
                    if chunk.isalpha():
                        ids = self._piece(" " + chunk)
                    elif chunk[-1] in ".," and chunk[:-1].isalpha():
                        ids = self._piece(" " + chunk[:-1]) + self._piece(chunk[-1])
                    else:
                        ids = self._pieces(" " + chunk)
                    if len(chunk) < LONG:
                        self.chunks.keep(chunk, ids)
                get = self.chunks.young.get
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def coder(path: str, pattern: str) -> BytePairCoder:
    return common.held_alone(("byte_bpe", path, pattern), lambda: BytePairCoder(read_ranks(path), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and the decoded bytes of every text."""
    common.bound_batches(docs.sparkSession)

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            ids = [own.encode(text or "") for text in batch.column(1).to_pylist()]
            decoded = [own.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded bytes.

    As ``encode_documents``, with the digests made where the ids are: ids and
    bytes needn't travel back to the JVM.
    """
    common.bound_batches(docs.sparkSession)

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(common.documents(spark, sf_dir), *vocabulary())
