"""License scans by ordered signature rules.

A text is lower-cased in A-Z and cut into words, runs of ASCII letters and
digits and of non-ASCII characters; rules are regular expressions over the
words joined by single spaces, so punctuation, case and line ends don't
matter. A rule is tried only if its keyword occurs, words that stand in each of
its matches. Names that are plain words or products as well ("the general
public", "Python 2") count in a text that hints at a license somewhere, and
after "under" in any. Detections are spans of words with a priority; one
that lies inside an accepted detection of the same or a higher priority is
suppressed, so "gnu lesser general public license" is not reported as the
general one, and a bare "apache license" not beside its version 2.

Base phrases are found by themselves, wherever their words stand, and are
never suppressed.

Defined results: a null or wordless text has no words, no labels and score 0;
repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Phrases and labels of the contract.
BASE = ((b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc"))

#: A text with any of these speaks of licenses; only rules of _PLAIN names ask for it.
HINTS = (b"licen", b"copyright", b"spdx", b"gpl", b"public domain", b"cc by", b"cc0", b"creative commons", b"redistribution", b"permission is hereby", b"all rights reserved", b"unlicense", b"proprietary")


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: bytes
    pattern: re.Pattern
    hinted: bool = False


_GRANT = r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?"

_DATE = r"(?:[0-3]?\d(?:st|nd|rd|th)? (?:of )?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*|(?:19|20)\d\d)(?!\S)"

# Products with versions of their own, and names that without a version are plain words, products or owners.
_PRODUCTS = {"boost", "python", "php", "unicode", "elastic", "libpng"}
_PLAIN = _PRODUCTS | {
    "apache", "apache software", "general public", "common public", "berkeley software distribution", "freebsd", "original bsd", "internet systems consortium", "zlib libpng",
    "artistic", "boost software", "python software foundation", "postgresql", "openssl", "w3c software", "open font", "open software", "academic free", "microsoft public",
    "open database", "business source", "polyform", "educational community", "q public", "ibm public",
}

# Families: label, names of the license in words, versions ("" for none).
_FAMILIES = (
    ("mit", ("mit", "mit x11", "expat"), ("",)),
    ("mit-0", ("mit no attribution", "mit 0"), ("",)),
    ("apache", ("apache", "apache software", "asl"), ("", "1 0", "1 1", "2", "2 0")),
    ("gpl", ("gnu general public", "gnu gpl", "gpl", "general public"), ("", "1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", ("gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl", "lesser general public"), ("", "2", "2 0", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public", "gnu agpl", "agpl", "affero general public"), ("", "1", "1 0", "3", "3 0")),
    ("gfdl", ("gnu free documentation", "gfdl"), ("", "1 1", "1 2", "1 3")),
    ("mpl", ("mozilla public", "mpl"), ("", "1 0", "1 1", "2", "2 0")),
    ("epl", ("eclipse public", "epl"), ("", "1 0", "2 0")),
    ("edl", ("eclipse distribution", "edl"), ("", "1 0")),
    ("cddl", ("common development and distribution", "cddl"), ("", "1 0", "1 1")),
    ("cpl", ("common public", "cpl"), ("", "1 0")),
    ("eupl", ("european union public", "eupl"), ("", "1 0", "1 1", "1 2")),
    ("bsd", ("bsd", "berkeley software distribution"), ("",)),
    ("bsd-2-clause", ("bsd 2 clause", "simplified bsd", "freebsd", "2 clause bsd", "two clause bsd"), ("",)),
    ("bsd-3-clause", ("bsd 3 clause", "new bsd", "modified bsd", "revised bsd", "3 clause bsd", "three clause bsd"), ("",)),
    ("bsd-4-clause", ("bsd 4 clause", "original bsd", "4 clause bsd", "four clause bsd"), ("",)),
    ("isc", ("isc", "internet systems consortium"), ("",)),
    ("zlib", ("zlib", "zlib libpng"), ("",)),
    ("libpng", ("libpng",), ("", "2 0")),
    ("artistic", ("artistic", "perl artistic"), ("", "1 0", "2 0")),
    ("boost", ("boost software", "bsl", "boost"), ("", "1 0")),
    ("python", ("python software foundation", "psf", "python"), ("", "2", "2 0")),
    ("openssl", ("openssl",), ("",)),
    ("postgresql", ("postgresql",), ("",)),
    ("unicode", ("unicode", "unicode dfs"), ("", "2015", "2016", "3 0")),
    ("w3c", ("w3c software", "w3c software notice and", "w3c"), ("",)),
    ("ofl", ("sil open font", "open font", "ofl"), ("", "1 0", "1 1")),
    ("osl", ("open software", "osl"), ("", "1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free", "afl"), ("", "1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ms-pl", ("microsoft public", "ms pl"), ("",)),
    ("ms-rl", ("microsoft reciprocal", "ms rl"), ("",)),
    ("odbl", ("open database", "odbl", "odc open database"), ("", "1 0")),
    ("odc-by", ("open data commons attribution", "odc by"), ("", "1 0")),
    ("pddl", ("public domain dedication and", "pddl"), ("", "1 0")),
    ("ncsa", ("university of illinois ncsa open source", "ncsa"), ("",)),
    ("wtfpl", ("do what the fuck you want to public", "wtfpl"), ("", "2")),
    ("unlicense", ("unlicense",), ("",)),
    ("beerware", ("beer ware", "beerware"), ("",)),
    ("qpl", ("q public", "qpl"), ("", "1 0")),
    ("sspl", ("server side public", "sspl"), ("", "1 0")),
    ("busl", ("business source", "busl"), ("", "1 1")),
    ("elastic", ("elastic", "elv2"), ("", "2", "2 0")),
    ("polyform", ("polyform noncommercial", "polyform small business", "polyform"), ("", "1 0 0")),
    ("upl", ("universal permissive", "upl"), ("", "1 0")),
    ("vim", ("vim",), ("",)),
    ("ruby", ("ruby",), ("",)),
    ("php", ("php",), ("", "3 0", "3 01")),
    ("zope", ("zope public", "zpl"), ("", "2 0", "2 1")),
    ("curl", ("curl",), ("",)),
    ("ecl", ("educational community", "ecl"), ("", "1 0", "2 0")),
    ("ipl", ("ibm public", "ipl"), ("", "1 0")),
    ("npl", ("netscape public", "npl"), ("", "1 0", "1 1")),
    ("apsl", ("apple public source", "apsl"), ("", "1 0", "1 1", "1 2", "2 0")),
    ("cecill", ("cecill",), ("", "1 0", "1 1", "2 0", "2 1")),
    ("mulan", ("mulan permissive software", "mulan psl", "mulanpsl"), ("", "1", "2")),
)
_COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution (?:share ?alike)"),
    ("cc-by-nc", "by nc", "attribution (?:non ?commercial)"),
    ("cc-by-nd", "by nd", "attribution (?:no ?deriv(?:ative)?s?)"),
    ("cc-by-nc-sa", "by nc sa", "attribution (?:non ?commercial) (?:share ?alike)"),
    ("cc-by-nc-nd", "by nc nd", "attribution (?:non ?commercial) (?:no ?deriv(?:ative)?s?)"),
)
# Sentences of license texts themselves.
_SENTENCES = (
    ("mit", b"permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", b"above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", b"permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", b"redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", b"redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", b"neither the name", "neither the name of (?:\\S+ ){1,12}nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", b"advertising", "all advertising materials mentioning features or use of this software must display the following"),
    ("apache-2", b"apache org licenses", "www apache org licenses license 2 0"),
    ("apache-2", b"compliance with the license", "you may not use this file except in compliance with the license"),
    ("gpl", b"you can redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", b"you can redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", b"you can redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", b"any later version", "either version [123] of the license or at your option any later version"),
    ("mpl-2.0", b"mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", b"as is without", "this software is provided as is without any express or implied warranty in no event"),
    ("unlicense", b"unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0", b"cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", b"creative commons zero", "creative commons zero(?: v?1 0)?"),
    ("wtfpl", b"what the fuck", "you just do what the fuck you want to"),
    ("beerware", b"buy me a beer", "you can buy me a beer in return"),
    ("public-domain", b"public domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("all-rights-reserved", b"all rights reserved", "all rights reserved"),
    ("proprietary", b"proprietary", "(?:proprietary and confidential|proprietary license)"),
)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """Every rule, highest priority first; longer names and versions come before shorter ones."""
    made: list[Rule] = []

    def add(priority: int, label: str, keyword: str | bytes, pattern: str, hinted: bool = False) -> None:
        key = keyword if isinstance(keyword, bytes) else keyword.encode()
        made.append(Rule(priority, label, key, re.compile(rf"(?<!\S)(?:{pattern})(?!\S)".encode()), hinted))

    for family, names, versions in _FAMILIES:
        for version in versions:
            label = family if not version else f"{family}-{'.'.join(version.split())}"
            label = {"apache-2.0": "apache-2"}.get(label, label)
            # "2" also stands for "2 0" and the reverse, but never for "2 1"; a date may follow.
            v = rf" (?:licen[sc]e )?(?:version |ver |v |v)?{version}(?! (?!{_DATE})\d)" if version else ""
            for name in names:
                long = "licen[sc]e" if len(name) < 6 or name in ("python", "elastic", "unicode", "openssl") else "(?:licen[sc]e)?"
                plain = name in (_PRODUCTS if version else _PLAIN)
                if version:
                    priority, pattern = 72 + len(name.split()), rf"(?:{_GRANT})?(?:the )?{name}{v}(?: or (?:any )?later(?: version)?)?"
                    add(80, label, f"spdx license identifier {name}", rf"spdx license identifier {name}{v}(?: or later| only)?")
                else:
                    priority, pattern = 40 + 2 * len(name.split()), rf"(?:the )?{name} {long}".replace(" (?:licen[sc]e)?", "(?: licen[sc]e)?")
                    add(70, label, name, rf"{_GRANT}{name} licen[sc]e")
                    add(79, label, f"spdx license identifier {name}", rf"spdx license identifier {name}")
                add(priority, label, name, pattern, plain)
                if plain:
                    add(priority, label, name, rf"under (?:the )?(?:terms of )?{pattern}")
    for label, short, long in _COMMONS:
        for version in ("", "1 0", "2 0", "2 5", "3 0", "4 0"):
            full = label if not version else f"{label}-{version.replace(' ', '.')}"
            v = rf" {version}" if version else ""
            add((50 if version else 30) + 2 * len(short.split()), full, "cc by", rf"cc {short}{v}")
            add((50 if version else 30) + 2 * len(short.split()), full, "creative commons", rf"creative commons {long}{v}(?: international| unported)?(?: public)?(?: licen[sc]e)?")
    for label, keyword, sentence in _SENTENCES:
        add(90 if len(sentence) > 40 else 20, label, keyword, sentence)
    return tuple(sorted(made, key=lambda r: (-r.priority, -len(r.pattern.pattern), r.label)))


@lru_cache(maxsize=1)
def _by_first_word() -> tuple[tuple[bytes, Rule], ...]:
    """The rules behind the first word of their keyword; keywords are whole words."""
    return tuple((rule.keyword.split()[0], rule) for rule in rules())


class Detection(NamedTuple):
    first_word: int
    last_word: int
    label: str
    priority: int


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPLIT).split()


def word_starts(joined: bytes) -> np.ndarray:
    """Offsets of the spaces of ``joined``; word k starts behind the k-th."""
    return np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)


def base_places(joined: bytes, starts: np.ndarray) -> list[tuple[int, str]]:
    """(start in words, label) of every place of a base phrase; ``joined`` has a space at either end."""
    out = []
    for phrase, label in BASE:
        found, at = [], joined.find(b" " + phrase + b" ")
        while at >= 0:
            found.append(at)
            at = joined.find(b" " + phrase + b" ", at + 1)
        out += [(k, label) for k in np.searchsorted(starts, found).tolist()]
    return out


def detect(joined: bytes, starts: np.ndarray) -> list[Detection]:
    """Detections of the rules that survive suppression, by place.

    Rules come by falling priority, so any accepted detection may suppress a
    later one: the farthest end of all that start no later decides.
    """
    words, hinted = set(joined.split()), any(hint in joined for hint in HINTS)
    begin, reach = np.empty(0, np.int64), np.empty(0, np.int64)
    kept: list[tuple[np.ndarray, np.ndarray, Rule]] = []
    for first, rule in _by_first_word():
        if first in words and (hinted or not rule.hinted) and rule.keyword in joined:
            spans = np.array([m.span() for m in rule.pattern.finditer(joined)], dtype=np.int64).reshape(-1, 2)
            if len(begin) and len(spans):
                at = np.searchsorted(begin, spans[:, 0], "right") - 1
                spans = spans[(at < 0) | (reach[at] < spans[:, 1])]
            if len(spans):
                kept.append((spans[:, 0], spans[:, 1], rule))
                begin, reach = np.concatenate([begin, spans[:, 0]]), np.concatenate([reach, spans[:, 1]])
                order = np.argsort(begin, kind="stable")
                begin, reach = begin[order], np.maximum.accumulate(reach[order])
    return sorted(
        Detection(s, e, rule.label, rule.priority)
        for a, b, rule in kept
        for s, e in zip((np.searchsorted(starts, a) - 1).tolist(), (np.searchsorted(starts, b) - 1).tolist())
    )


def scan_text(text: str | None) -> tuple[int, list[tuple[int, str]], list[Detection]]:
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    starts = word_starts(joined)
    return len(words), base_places(joined, starts), detect(joined, starts)


def confidence(places: list[tuple[int, str]], found: list[Detection]) -> float:
    """The best detection's priority as a share; a base phrase alone counts 0.8."""
    return min(1.0, max([0.8 * bool(places), *(0.1 + d.priority / 100 for d in found)]))


def license_digests(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places, base labels, all labels and score."""
    common.bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, places, found = scan_text(text)
                base = {label for _, label in places}
                starts = [at for at, _ in places]
                rows.append((d, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x.label for x in found})), confidence(places, found)))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [batch.column(0).type, *[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digests(common.documents(spark, sf_dir))
