"""Secrets and licenses against brute-force versions on random texts, and on odd inputs."""

import itertools
import math
import random
import re
import textwrap
import time
from collections import Counter

from lodestream.llm import licenses, secrets


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, k) for a, _, k, b in sorted(out)]


def brute_spans(text):
    """Every window's entropy from scratch, letter by letter marks in place of spans."""
    base = brute_base(text)
    mark, off = [False] * len(text), [False] * len(text)
    grow, tokens = [], set()
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        for i in range(m.start(), m.end() - 19):
            w = text[i : i + 20]
            upper, lower, digit = (sum(a <= c <= b for c in w) for a, b in ("AZ", "az", "09"))
            odd, beyond = 20 - upper - lower - digit, sum(c.isalpha() and c not in "abcdefABCDEF" for c in w)
            least = secrets._class(upper, lower, digit, odd, beyond)
            if least is not None and -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values()) >= least - 1e-12:
                mark[i : i + 20] = [True] * 20
                grow.append((m.start(), m.end(), i))
        for x in secrets.ALLOWED:
            for i in range(m.start(), m.end() - len(x) + 1):
                if text.startswith(x, i):
                    a, b = max(m.start(), i - 40), min(m.end(), i + len(x) + 40)
                    off[a:b] = [True] * (b - a)
    for a, b, _ in base:
        off[a:b] = [True] * (b - a)
    for word in re.finditer(r"[^\s\"'<>]+", text):
        for i in range(word.start(), word.end()):
            if text.startswith(("http://", "https://", "www."), i) and not (i and text[i - 1].isascii() and text[i - 1].isalnum()):
                off[i : word.end()] = [True] * (word.end() - i)
    # A window's token, letter by letter: what may be passed is any letter but an equals sign, and a slash before an odd part.
    odd = lambda part: re.search("[0-9+]|[a-z][A-Z]|[A-Z][A-Z]", part) is not None
    for low, high, i in grow:
        joined = [j for j in range(low, high) if mark[j]]
        a, b = i, i + 20
        while a - 1 in joined:
            a -= 1
        while b in joined:
            b += 1
        while a > low and text[a - 1] != "=" and (text[a - 1] != "/" or odd(re.split("[/=]", text[low : a - 1])[-1])):
            a -= 1
        while b < high and text[b] != "=" and text[b - 1] != "=" and (text[b] != "/" or odd(re.split("[/=]", text[b + 1 : high])[0])):
            b += 1
        for _ in range(2):
            b += b < high and text[b] == "="
        tokens.add((a, b))
    mark = [False] * len(text)
    for a, b in sorted(tokens):
        mark[a:b] = [True] * (b - a)
    for on, run in itertools.groupby(range(len(text)), key=mark.__getitem__):
        run = list(run)
        part = text[run[0] : run[-1] + 1]
        words = sum(len(w) for w in re.findall("[A-Z]?[a-z][a-z][a-z]+", part))
        if on and re.search("[a-z]", part) and re.search("[A-Z]", part) and words >= 0.7 * sum(c.isalpha() for c in part):
            mark[run[0] : run[-1] + 1] = [False] * len(run)
    for m in re.finditer("-".join(f"[0-9a-fA-F]{{{n}}}" for n in (8, 4, 4, 4, 12)), text):
        off[m.start() : m.end()] = [True] * 36
    more = []
    live = [x and not y for x, y in zip(mark, off, strict=True)]
    for on, run in itertools.groupby(range(len(text)), key=live.__getitem__):
        run = list(run)
        part = text[run[0] : run[-1] + 1]
        if on and any(c in "0123456789" for c in part) and len(set(part)) >= 8:
            more.append((run[0], run[-1] + 1, "entropy"))
    return base, sorted(base + more, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secrets_by_brute_force():
    rnd = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    draw = lambda n, pool=letters: "".join(rnd.choice(pool) for _ in range(n))
    parts = [
        lambda: draw(rnd.randint(1, 60)), lambda: "AKIA" + draw(rnd.randint(10, 22), letters[:26] + "0123456789"), lambda: draw(rnd.randint(20, 50), "0123456789abcdef"), lambda: "EXAMPLE",
        lambda: rnd.choice([" ", "\n", ".", " and ", "\U0001f600", "token: ", 'api_key="', "PASSWORD=", "https://a.b/", "www.", "placeholder", "deadbeef"]), lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: draw(rnd.randint(1, 40), "abc"),
    ]
    texts = ["".join(rnd.choice(parts)() for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    for t in texts:
        assert secrets.spans_of(t) == brute_spans(t), t


def test_an_example_takes_its_surroundings_only():
    rnd = random.Random(1)
    key = "".join(rnd.choice("ABCDEFGHJKLMabcdefghjklm0123456789") for _ in range(200))
    spans = secrets.spans_of(key + "EXAMPLE" + key)[1]
    assert [(a, b) for a, b, _ in spans] == [(0, 160), (247, 407)]
    assert secrets.spans_of("(https://example.org/a1B2c3D4e5F6g7H8i9J0k1L2m3) 'www.a.b/Q1w2E3r4T5y6U7i8O9p0'")[1] == []
    assert secrets.spans_of("k wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")[1] == []
    assert secrets.spans_of("https://host/" + "a1B2c3D4/" * 60)[1] == []
    began = time.process_time()
    secrets.spans_of((key + " EXAMPLE ") * 5000)
    assert time.process_time() - began < 30


def test_whole_tokens_are_told():
    rnd = random.Random(2)
    pool = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n: "".join(rnd.choice(pool) for _ in range(n))
    whole = 0
    for _ in range(500):
        key = rnd.choice(["ghp_" + draw(36), "eyJ" + draw(50), "sk-" + draw(40), draw(38) + "==", draw(12) + "+" + draw(9) + "/1" + draw(20)])
        spans = secrets.spans_of(f"the key is {key}, so")[1]
        whole += spans == [(11, 11 + len(key), "entropy")]
        assert all((a, b) == (11, 11 + len(key)) for a, b, _ in spans)
    assert whole >= 495
    assert secrets.spans_of("QWxhZGRpbjpvcGVuIHNlc2FtZQ==")[1] == [(0, 28, "entropy")]
    for name in ("ThisIsALongJavaClassNameWithV2AndMore", "getHttpResponseCodeFor404Pages", "AbstractSingletonProxyFactoryBean2Test"):
        assert secrets.spans_of(name)[1] == []


def test_scans_of_odd_tables(spark):
    rows = [(1, None, "x", 1), (1, "", "x", 1), (None, "Released under the MIT License.", "x", 1), (2, "token=abcdef12 " + "word " * 1_000_000, "x", 1), (2, "token=abcdef12 " + "word " * 1_000_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, findings int")
    found = sorted((r.doc_id or 0, r.n_assign, r.spans) for r in secrets.scan(df).collect())
    assert found == [(0, 0, ""), (1, 0, ""), (1, 0, ""), (2, 1, "assign:0:14"), (2, 1, "assign:0:14")]
    assert sorted((r.doc_id or 0, len(r.findings)) for r in licenses.scan(df).collect()) == [(0, 1), (1, 0), (1, 0), (2, 0), (2, 0)]
    assert secrets.scan(df.where("false")).count() == licenses.scan(df.where("false")).count() == 0


def test_licenses_by_brute_force():
    """Exact wordings: every place where a template's words stand, longest first, none overlapping."""
    rnd = random.Random(3)
    rows = [(name, t) for name, texts in licenses.TEMPLATES.items() for t in texts]
    scanner = licenses.Scanner(licenses.TEMPLATES)
    fill = ["the house was cold", "number 12 of 4", "on copyright and such", "we sail\n", "\n\n", "License of no kind."]
    for _ in range(150):
        text = " ".join(rnd.choice(rows)[1] if rnd.random() < 0.4 else rnd.choice(fill) for _ in range(rnd.randint(1, 9)))
        tokens = [(m[0].lower(), *m.span()) for m in re.finditer(r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)*", text)]
        every = []
        for name, t in rows:
            own = licenses.words(t)
            every += [(-len(own), i, name) for i in range(len(tokens) - len(own) + 1) if [w for w, _, _ in tokens[i : i + len(own)]] == own]
        taken, want = set(), []
        for n, i, name in sorted(every):
            if not taken & set(range(i, i - n)):
                taken |= set(range(i, i - n))
                want.append((tokens[i][1], tokens[i - n - 1][2], name))
        assert [x[:3] for x in scanner.find(text) if not x[4]] == sorted(want), text


#: Notices as files hold them, with what must be told of each.
WHOLE = {
    "MIT": ("Permission is hereby", "DEALINGS IN THE SOFTWARE"), "BSD-2-Clause": ("Redistribution and use", "POSSIBILITY OF SUCH DAMAGE"), "BSD-3-Clause": ("Redistribution and use", "POSSIBILITY OF SUCH DAMAGE"),
    "Apache-2.0": ("Licensed under the Apache", "under the License"), "GPL-2.0": ("This program is free", "for more details"), "GPL-3.0": ("This program is free", "for more details"), "AGPL-3.0": ("This program is free", "for more details"),
    "LGPL-2.1": ("This library is free", "for more details"), "MPL-2.0": ("This Source Code Form", "mozilla.org/MPL/2.0"), "ISC": ("Permission to use", "PERFORMANCE OF THIS SOFTWARE"), "0BSD": ("Permission to use", "PERFORMANCE OF THIS SOFTWARE"),
    "Zlib": ("This software is provided", "any source distribution"), "MIT-0": ("Permission is hereby", "DEALINGS IN THE SOFTWARE"), "Unlicense": ("This is free", "by any means"), "BSL-1.0": ("Permission is hereby", "subject to the following"),
}


def test_notices_over_many_lines():
    """Wrapped at several widths, in comments of several languages, indented, in paragraphs and with other text around."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    prose = "The house was cold and the road was long, so that they went on by sea. "
    for name, (first, last) in WHOLE.items():
        whole = max(licenses.TEXTS[name], key=len)
        marked = whole.replace(" Redistributions", "\n\n1. Redistributions").replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS").replace(" Unless req", "\n\nUnless req")
        for width in (50, 72, 80):
            lines = [x for part in marked.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
            for mark, before, behind in (("", "", ""), (" * ", "/*\n", "\n */"), ("# ", "#!/bin/sh\n", "\n"), ("// ", "", "\n"), ("    ", "\n\n", ""), (";; ", "", ""), ("> ", "", "")):
                text = f"{prose * 30}\n{before}Copyright (c) 2021 Jo Doe\n" + "\n".join(mark + x for x in lines) + f"{behind}\n\n{prose * 30}"
                found = scanner.find(text)
                assert [x[2] for x in found] == [name], (name, width, mark, found)
                a, b = found[0][:2]
                assert text[a:].startswith(first[:10]) and text[:b].endswith(last.split()[-1].split("/")[-1]) and found[0][4] <= 6, (name, text[a:b])


def test_blocks_are_all_within_reach():
    rnd = random.Random(9)
    for _ in range(400):
        text = "".join(rnd.choice(["license", "word", "a", "7", "  ", "\n", "\n\n", " ", " ", " * ", "permission ", "x" * 40]) for _ in range(rnd.randint(0, 120)))
        reach = rnd.randint(1, 9)
        tokens = [m.span() for m in re.finditer(r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)*", text)]
        mark = [False] * (len(text) + 1)
        for m in licenses._TRIGGER.finditer(text):
            before, behind = [s for s in tokens if s[0] < m.start()][-reach:], [s for s in tokens if s[0] >= m.end()][:reach]
            a = min([m.start(), *(s[0] for s in before)])
            b = max([m.end(), *(s[1] for s in behind)])
            mark[a:b] = [True] * (b - a)
        blocks = licenses.blocks_of(text, reach)
        assert all(a <= b for a, b in blocks) and all(x[1] < y[0] for x, y in zip(blocks, blocks[1:], strict=False))
        assert all(any(a <= i < b for a, b in blocks) for i, x in enumerate(mark) if x), (text, reach, blocks)


def test_tags_and_catalogue():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert len(licenses.TEXTS) >= 40
    for name in licenses.TEXTS:
        assert [x[2] for x in scanner.find(f"x = 1\n# SPDX-License-Identifier: {name}\ny = 2")] == [name]
    assert all(licenses._TRIGGER.search(t) for texts in licenses.TEMPLATES.values() for t in texts)
    assert scanner.find("We read a license for the boat, and the permission to sail; all rights were kept.") == []


def test_notices_in_a_very_long_line():
    s = licenses.Scanner(licenses.TEMPLATES)
    long = "some words of prose that go on and on " * 20_000
    began = time.process_time()
    assert [x[2] for x in s.find(long + "Released under the MIT License. " + long + "Licensed under CC BY 4.0. " + long)] == ["MIT", "CC-BY-4.0"]
    assert time.process_time() - began < 60
