"""Secret scans through layers of encoding.

Every text is scanned for three kinds: assignments of credentials, access key
ids, and long hexadecimal runs. Then a worklist unwraps what is encoded in it:
percent-encoded tokens, Unicode escapes, base64 runs, also over line
breaks, and compressed bytes inside base64. Each layer is scanned and unwrapped in turn until nothing new
comes up; layers are remembered by content, so a cycle ends. A secret found in
a layer is reported at the span of the outermost encoded piece of the text.

Decoded bytes are scanned whatever they are: binary parts between texts, other
encodings and archives hide nothing.

Defined results: a null text is empty; offsets are code points, ends exclusive;
an added span that repeats a span of the text itself is reported once;
compressed bytes are inflated to their end, member by member; what is behind
them, or doesn't inflate, is scanned as it is; repeated rows are scanned each;
an empty table gives no rows.

Long layers are decoded in chunks and cut only where no secret and no encoded
piece can lie across, so memory grows with the longest run without such a
place and not with the layer.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from html.entities import html5
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("assign", "access", "hex")
CHUNK = 1 << 20
#: Characters of base64 that are decoded at once where the end isn't known; a multiple of 4.
_PART = 1 << 12

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 24 or more is a match of [0-9a-f]+ that isn't dropped, and the reverse.
_HEX = re.compile(r"[0-9a-f]{24,}")

# Encoded tokens are looked for token by token, so that a text is read once however long its tokens are.
_TOKEN = re.compile(r"[^\s\"'<>]+")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]0*([0-9A-Fa-f]{1,6});|&#0*([0-9]{1,7});")
_NAMED = re.compile(r"&([A-Za-z][A-Za-z0-9]{1,30});")
# 12 bytes, the shortest secret, are 16 characters.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_SIGN = re.compile(r"[/_+-]")
_RUN, _BREAK = "[A-Za-z0-9+/_-]", r"(?:\r\n?|\n|\\r\\n|\\n)[\x20\t]*"
# Runs over line breaks: the first and the last line may be short. No backtracking into a run.
_WRAPPED = re.compile(rf"(?<!{_RUN})(?:{_RUN}++(?:{_BREAK}{_RUN}{{16,}}+)++(?:{_BREAK}{_RUN}++)?|{_RUN}{{16,}}+{_BREAK}{_RUN}++)={{0,2}}")
_LINE_END = re.compile(_BREAK)


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, matched text) of the three kinds, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if ":" in text or "=" in text:
        if "token" in low or "secret" in low or "passw" in low or "api" in low:
            out += [(m.start(), 0, m.end(), m.group()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.group()) for m in _ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(text)]
    return sorted(out)


# Characters that stay what they are in every deeper layer and are part of no secret; a space between words likewise.
_CUT = re.compile(r"""[^A-Za-z0-9+/_.=:"'%\\&#;\t\r\n\x20-]|(?<=[A-Za-z0-9_])\x20(?=[A-Za-z0-9_])""")


class _Decoder:
    """Bytes to texts that end where a cut loses nothing."""

    def __init__(self, encoding: str):
        self.decode = codecs.getincrementaldecoder(encoding)("replace").decode
        self.held: list[str] = []
        self.size = 0

    def feed(self, raw: bytes, final: bool = False) -> str:
        text = self.decode(raw, final)
        self.size += len(text)
        self.held.append(text)
        cut = len(text) if final else 0
        for width in (1 << 12, len(text)):
            if self.size >= CHUNK and not cut:
                cut = max((m.start() for m in _CUT.finditer(text, max(0, len(text) - width))), default=0)
        if not cut and not final:
            return ""
        out = "".join(self.held)
        self.held, self.size = [text[cut:]], len(text) - cut
        return out[: len(out) - self.size]


def _texts(chunks: Iterable[bytes]) -> Iterator[str]:
    """Bytes as texts: as UTF-8, and from the first NUL on as UTF-16 of either byte order from either byte.

    Undecodable bytes become a replacement character, which is part of no secret and ends any.
    """
    streams, before = [_Decoder("utf-8")], b""
    for chunk in chunks:
        fed = [chunk]
        if len(streams) == 1 and b"\0" in chunk:
            streams += [_Decoder(order) for _ in range(2) for order in ("utf-16-le", "utf-16-be")]
            whole = before + chunk
            fed += [whole, whole, whole[1:], whole[1:]]
        for k, stream in enumerate(streams):
            if text := stream.feed(fed[k] if len(fed) > 1 else chunk):
                yield text
        before = chunk[-1:] or before
    for stream in streams:
        if text := stream.feed(b"", final=True):
            yield text


def _compressed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0)


def _inflate(raw: bytes) -> Iterator[bytes]:
    """Compressed members one after another, in chunks; the rest, and what fails to inflate, as it is."""
    while _compressed(raw):
        stream = zlib.decompressobj(47)
        try:
            left = raw
            while (piece := stream.decompress(left, CHUNK)) or stream.unconsumed_tail:
                yield piece
                left = stream.unconsumed_tail
        except zlib.error:
            break
        raw = stream.unused_data
    if raw:
        yield raw


def _unit(m: re.Match) -> str:
    code = int(m.group(4)) if m.group(4) else int(m.group(1) or m.group(2) or m.group(3), 16)
    return chr(code) if code < 0x110000 else m.group()


def _unescape(piece: str) -> str:
    plain = _UNIT.sub(_unit, piece)
    if "&#" in piece:
        plain = _NAMED.sub(lambda m: html5.get(f"{m.group(1)};", m.group()), plain)
    # Escaped surrogate pairs become their character; lone ones stay harmless.
    return plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def unwrap(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, decoded text) of every encoded piece of ``text``."""
    percent, escaped = "%" in text, "\\u" in text or "\\x" in text or "&#" in text
    if percent or escaped:
        for m in _TOKEN.finditer(text):
            token = m.group()
            if percent and "%" in token and _PERCENT.search(token):
                for plain in _texts([unquote_to_bytes(token)]):
                    if plain != token:
                        yield m.start(), m.end(), plain
            if escaped and ("\\" in token or "&#" in token) and _UNIT.search(token) and (plain := _unescape(token)) != token:
                yield m.start(), m.end(), plain
    for m in _BASE64.finditer(text):
        for at in _alignments(m.group()):
            for plain in _texts(_inflate(_unbase64(m.group()[at:]))):
                yield m.start(), m.end(), plain
    if "\n" in text or "\r" in text or "\\n" in text:
        for m in _WRAPPED.finditer(text):
            yield from _unwrap_lines(m)


def _alignments(run: str) -> list[int]:
    """Where the groups of four of a run may start: at its start, and behind signs that may be a path's or a name's."""
    out = {0: 0}
    for m in _SIGN.finditer(run):
        if len(run) - m.end() >= 16:
            out.setdefault(m.end() % 4, m.end())
        if len(out) == 4:
            break
    return list(out.values())


def _unbase64(piece: str) -> bytes:
    piece = piece.rstrip("=")
    piece = piece[: len(piece) - (len(piece) % 4 == 1)]
    return base64.b64decode(piece.replace("-", "+").replace("_", "/") + "=" * (-len(piece) % 4))


def _unwrap_lines(m: re.Match) -> Iterator[tuple[int, int, str]]:
    """The lines of a wrapped run as one piece.

    Words may stand before the encoded lines, so each of the four ways to count off groups of four characters is
    tried from the first line that gives it, and every line that opens compressed bytes.
    """
    starts, lines, at = [], [], m.start()
    for brk in [*_LINE_END.finditer(m.group()), None]:
        starts.append(at)
        lines.append(m.string[at : m.start() + brk.start() if brk else m.end()])
        at = m.start() + brk.end() if brk else at
    joined, offset, tried = "".join(lines), 0, set()
    for start, line in zip(starts, lines):
        if offset % 4 not in tried:
            tried.add(offset % 4)
            for plain in _texts(_inflate(_unbase64(joined[offset:]))):
                yield start, m.end(), plain
        elif _opens(line):
            # Only to the end of what opens here: a run of many such lines is read once.
            for plain in _texts(_one_member(joined, offset)):
                yield start, m.end(), plain
        offset += len(line)


def _one_member(joined: str, offset: int) -> Iterator[bytes]:
    stream = zlib.decompressobj(47)
    for at in range(offset, len(joined), _PART):
        left = _unbase64(joined[at : at + _PART])
        try:
            while (piece := stream.decompress(left, CHUNK)) or stream.unconsumed_tail:
                yield piece
                left = stream.unconsumed_tail
        except zlib.error:
            return
        if stream.eof:
            return


def _opens(line: str) -> bool:
    head = _unbase64(line[:64])
    try:
        return _compressed(head) and zlib.decompressobj(47).decompress(head) is not None
    except zlib.error:
        return False


class _Places:
    """Spans by kind and value: whether one lies within a span, without reading all of them."""

    def __init__(self):
        self.spans: dict[tuple[int, str], list[tuple[int, int]]] = {}

    def add(self, kind: int, value: str, span: tuple[int, int]) -> None:
        spans = self.spans.setdefault((kind, value), [])
        if not spans or spans[-1] < span:
            spans.append(span)
        elif (at := bisect_left(spans, span)) == len(spans) or spans[at] != span:
            spans.insert(at, span)

    def within(self, kind: int, value: str, span: tuple[int, int]) -> bool:
        """Whether a span other than ``span`` itself lies in it."""
        spans = self.spans.get((kind, value), ())
        at = bisect_left(spans, (span[0], span[0]))
        while at < len(spans) and spans[at][0] < span[1]:
            if spans[at][1] <= span[1] and spans[at] != span:
                return True
            at += 1
        return False


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """Secrets of the text itself, and those of its layers at the spans of the outermost pieces."""
    text = text or ""
    base = scan(text)
    known = {x[:3] for x in base}
    standing = _Places()
    for start, kind, end, value in base:
        standing.add(kind, value, (start, end))
    added: dict[tuple[int, int, int], str] = {}
    # Layers come up one at a time: of a long layer only a part is held.
    work = [unwrap(text)]
    seen: set[tuple[int, int, bytes]] = set()
    outer: tuple[int, int] = (0, 0)
    # Secrets of the lines of wrapped runs: the whole run, which comes later, doesn't repeat them.
    wrapped = bool(_WRAPPED.search(text))
    single = _Places()
    while work:
        if (piece := next(work[-1], None)) is None:
            work.pop()
            continue
        if len(work) == 1:
            outer = piece[:2]
        start, end = outer
        layer = piece[2]
        mark = (start, end, hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if mark in seen:
            continue
        seen.add(mark)
        for _, kind, _, value in scan(layer):
            span = (start, kind, end)
            # What stands in the text unchanged has been reported where it stands.
            if span not in known and not standing.within(kind, value, outer) and not single.within(kind, value, outer):
                added.setdefault(span, value)
                if wrapped:
                    single.add(kind, value, outer)
        work.append(unwrap(layer))
    return base, [(*span, value) for span, value in sorted(added.items())]


def render(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in sorted(spans))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id and a row for each secret: kind, start, end, layered, and a digest of its value."""
    common.bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for layered, found in zip((False, True), find_secrets(text)):
                    rows += [(d, KINDS[k], s, e, layered, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()) for s, k, e, v in found]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [batch.column(0).type, pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "kind", "start", "end", "layered", "value_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, kind string, start long, end long, layered boolean, value_sha256 string")


def secret_digests(docs: DataFrame) -> DataFrame:
    """One row per document: counts and spans of the text itself, and all spans."""
    common.bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column(1).to_pylist():
                base, added = find_secrets(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(render(base).encode()).hexdigest())
                spans.append(render(base + added))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(common.documents(spark, sf_dir))
