"""Inputs that the operators once left out."""

import base64
import gzip
import io
import random
import tarfile
import zlib

from factloom.llm import decontamination, license_scan, secret_scan


def kinds(text):
    return [kind for _, kind, _, _ in secret_scan.find_secrets(text)[1]]


def pack(raw):
    return f"x {base64.b64encode(raw).decode()} y"


def test_secrets_in_layers_that_are_not_plain_utf8():
    made = io.BytesIO()
    with tarfile.open(fileobj=made, mode="w:gz") as tar:
        body = "".join(f"password=hunter{k:04d}\n" for k in range(400)).encode()
        info = tarfile.TarInfo(".env")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    assert kinds(pack(made.getvalue())) == [0]
    for order in ("utf-16", "utf-16-le", "utf-16-be"):
        assert kinds(pack("é password=hunter2222 中".encode(order))) == [0]
        assert kinds(pack(b"\xff" + "password=hunter2222".encode(order))) == [0]
    assert kinds("q=caf%E9&password%3Dhunter2222") == [0]
    assert kinds(pack(b"\x01" * 5000 + b"password=hunter2222")) == [0]
    assert secret_scan.find_secrets(pack(b"\xff\xfe nothing here \x00\x01" * 20)) == ([], [])


def test_secrets_behind_long_layers_and_in_later_members():
    secret = b"password=hunter2222"
    line = "2024-01-01 é some line of a log, nothing in it\n".encode()
    # Beyond 32 MB, and with chunks that end inside a character.
    assert kinds(pack(gzip.compress(line * 750_000 + secret + b"\n" + line, 1))) == [0]
    assert kinds(pack(gzip.compress(b"nothing") + gzip.compress(secret))) == [0] == kinds(pack(zlib.compress(b"nothing") + secret))
    assert kinds(pack(gzip.compress(b"\0" * (33 << 20) + secret, 1)[:-8])) == [0]


def test_secrets_across_the_ends_of_chunks():
    for shift in range(-24, 4):
        for encoding in ("utf-8", "utf-16-le", "utf-16-be"):
            raw = ("é, " * secret_scan.CHUNK).encode(encoding)[: secret_scan.CHUNK + shift]
            inner = "password" + "".join(f"%{b:02x}" for b in b"=hunter2222") + " , "
            found = secret_scan.find_secrets(pack(gzip.compress(raw + inner.encode(encoding) + raw, 1)))[1]
            assert "password=hunter2222" in {value for *_, value in found}, (shift, encoding)


def test_secrets_in_short_and_in_wrapped_base64():
    for secret in ("token=abcdef", "secret=abcdef", "api_key=abcdef", "password:abcdef"):
        assert kinds(pack(secret.encode())) == kinds(pack(secret.encode()).replace("=", "")) == [0]
    draw = random.Random(3)
    noise = "".join(draw.choice("abcdefghij ,.\n") for _ in range(3000))
    for raw in (f"{noise[:70]}password=hunter2222{noise}".encode(), gzip.compress(f"{noise}password=hunter2222".encode()), zlib.compress(noise.encode() + b" token=abcdef")):
        whole = base64.b64encode(raw).decode()
        for width in (64, 76):
            for line_end in ("\n", "\r\n", "\n    ", "\\n"):
                block = line_end.join(whole[k : k + width] for k in range(0, len(whole), width))
                for before in ("data: ", "-----BEGIN-----\n", "a word\n", "some words\n", "Authorization: "):
                    assert kinds(f"{before}{block}\nnext line") == [0], (width, line_end, before)
    # What one line holds is reported at that line, once.
    lines = [base64.b64encode(b"password=hunter%05d" % k).decode() for k in range(3)]
    spans = secret_scan.find_secrets("\n".join(lines))[1]
    assert [(s, e) for s, _, e, _ in spans] == [(len(x + "\n") * k, len(x + "\n") * k + len(x)) for k, x in enumerate(lines)]
    # A secret over two lines is reported whole, at the run; what a line holds of it may stand at the line as well.
    found = secret_scan.find_secrets(base64.encodebytes(b"-" * 40 + b" password=hunter2222 " + b"-" * 40).decode())[1]
    assert "password=hunter2222" in {value for *_, value in found}


def labels(text):
    return {d.label for d in license_scan.scan_text(text)[2]}


def test_licenses_without_the_word():
    want = {
        "Released under Apache 2.0": "apache-2", "under MPL 2.0": "mpl-2.0", "Eclipse Public v2.0": "epl-2.0", "BSD 3-Clause": "bsd-3-clause", "under Python 2.0": "python-2.0", "Artistic 2.0": "artistic-2.0", "Academic Free v3.0": "afl-3.0",
        "This software is provided 'as-is', without any express or implied warranty. In no event": "zlib", "you can buy me a beer in return": "beerware",
        "you just DO WHAT THE FUCK YOU WANT TO.": "wtfpl", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "Neither the name of the owner nor the names of its contributors may be used to endorse or promote": "bsd-3-clause",
        "GNU General Public License Version 3, 29 June 2007": "gpl-3", "GPL v2, 1991": "gpl-2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    }
    want |= {f"SPDX-License-Identifier: {name}": name.lower() for name in ("MIT", "ISC", "Zlib", "curl", "MIT-0", "BSD-2-Clause")}
    assert {text: labels(text) for text in want} == {text: {label} for text, label in want.items()}
    assert labels("the general public likes Python 2, boost 1.0 and artistic open software") == set()
    assert labels("GPL 2.1 2010") == set() and labels("LGPL 2.1, 3 May 1999") == {"lgpl-2.1"}


def test_every_license_match_holds_its_keyword():
    for rule in license_scan.rules():
        assert rule.keyword in rule.pattern.pattern.replace(b"(?:", b"").replace(b"[sc]", b"s"), rule


def test_long_and_unspaced_items_are_all_found():
    draw = random.Random(5)
    vocab = [f"v{k}" for k in range(2000)]
    for n in (8, 14, 60, 150, 300, 600, 1000):
        items = [(k, " ".join(draw.choice(vocab) for _ in range(n))) for k in range(12)]
        index = decontamination.BenchmarkIndex(items)
        for k, text in items:
            words = text.split()
            for _ in range(decontamination.allowed_edits(n)):
                at, what = draw.randrange(len(words)), draw.choice("sid")
                words[at : at + (what != "i")] = [] if what == "d" else [draw.choice(vocab)]
            host = " ".join(draw.choice(vocab) for _ in range(100)) + " " + " ".join(words) + " " + " ".join(draw.choice(vocab) for _ in range(50))
            assert k in {i for i, *_ in index.search(host)}, n
    index = decontamination.BenchmarkIndex([(1, "人工知能は人間の知能を模倣する技術である"), (2, "ภาษาไทยไม่มีช่องว่าง")])
    assert index.search("昔々、人工知能は人間の知識を模倣する技術であるといわれた。")[0][2] == 1 and index.search("ก่อนภาษาไทยไม่มีช่องว่างหลัง")[0][0] == 1


def test_decontamination_equals_brute_force():
    draw = random.Random(11)
    vocab = [f"w{k}" for k in range(6)]  # many ties and repeated runs
    index = decontamination.BenchmarkIndex([(k, " ".join(draw.choice(vocab) for _ in range(4 + k))) for k in range(24)])
    for size in (0, 3, 9, 40, 70, 90):
        text = " ".join(draw.choice(vocab) for _ in range(size))
        words, want = decontamination.symbols(text).tolist(), []
        for k, item in enumerate(index.items):
            found = []
            for start in range(len(words) + 1):
                row = list(range(len(words) - start + 1))
                for i, w in enumerate(item.tolist(), 1):
                    nxt = [i]
                    for j, v in enumerate(words[start:], 1):
                        nxt.append(min(row[j - 1] + (v != w), row[j] + 1, nxt[-1] + 1))
                    row = nxt
                found.append((min(row), start))
            if found and min(found)[0] <= index.edits[k]:
                want.append((k, min(found)[1], min(found)[0]))
        assert sorted(index.search(text)) == want
