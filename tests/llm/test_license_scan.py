import re
import textwrap
from math import log, sqrt
from collections import Counter

import pytest

from wordloom.llm import license_scan as S

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
FILES = [("a/LICENSE", MIT), ("a/x.txt", "some text of the day"), ("a/b/y.txt", "more text\n" + GPL + "\nand text " * 20), ("a/b/c/z.txt", "words"),
         ("d/LICENSE", GPL), ("d/e/LICENSE", MIT), ("d/e/f/g/h.txt", "deep"), ("d/i.txt", None), ("top.txt", "nothing"), ("k/l.txt", ""),
         (None, MIT), (None, None), ("a/x.txt", "some text of the day"), ("ab/x.txt", "no relation to a"),
         ("m/long.txt", "word " * 200_000 + "\n" + "Licensed under the Apache License, Version 2.0.")]


@pytest.fixture(scope="module")
def got(spark):
    files = spark.createDataFrame([(i, p, t, "c", "d") for i, (p, t) in enumerate(FILES)],
                                  "doc_id long, path string, text string, license string, above string")
    out = S.scan(files, S.template_table(spark))
    assert out.columns == ["doc_id", "path", "above", "own_license", "cosine", "is_license_file", "license", "inherited_from"]
    return {r["doc_id"]: r for r in out.collect()}


def test_own_and_inherited(got):
    assert len(got) == len(FILES)
    want = {0: ("MIT", None), 1: ("MIT", "a"), 2: ("GPL-3.0", None), 3: ("MIT", "a"), 4: ("GPL-3.0", None), 5: ("MIT", None), 6: ("MIT", "d/e"),
            7: ("GPL-3.0", "d"), 8: (None, None), 9: (None, None), 10: ("MIT", None), 11: (None, None), 12: ("MIT", "a"), 13: (None, None),
            14: ("Apache-2.0", None)}
    assert {i: (r["license"], r["inherited_from"]) for i, r in got.items()} == want
    assert sorted(i for i, r in got.items() if r["is_license_file"]) == [0, 4, 5, 10]


def brute(texts, templates, least):
    statements = [S.terms(s) for t in texts for s in S.STATEMENT.split(t or "")]
    statements = [s for s in statements if s]
    n, vocabulary = len(statements), {w for _, t in templates for w in S.terms(t)}
    df = Counter(w for s in statements for w in set(s))
    weigh = lambda words: {w: k * (log((1 + n) / (1 + df[w])) + 1 if w in vocabulary else log((1 + n) / 2) + 1) for w, k in Counter(words).items()}
    out = []
    for t in texts:
        found = []
        for s in S.STATEMENT.split(t or ""):
            a = weigh(S.terms(s))
            for name, text in templates:
                b = weigh(S.terms(text))
                if a:
                    c = sum(x * b.get(w, 0) for w, x in a.items()) / sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                    if c >= least - 1e-12:
                        found.append((-round(c, 9), name))
        out.append(min(found)[::-1] if found else None)
    return out


@pytest.mark.parametrize("least", [0.3, 0.6, 0.95])
def test_cosine_equals_brute_force(spark, least):
    texts = [t for _, t in FILES if not t or len(t) < 1000] + [MIT] * 30 + [
        "the License of the MIT", "under the CC BY", "Licensed under CC BY 4.0. Or under the GNU General Public License.", "this is a work",
        "Permission is hereby granted to use, copy and modify this software for a fee", "version 3"]
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in S.own_licenses(files, S.template_table(spark), least=least).collect()}
    for i, want in enumerate(brute(texts, sorted(S.TEMPLATES), least)):
        mine = rows[i]
        assert (mine["own_license"], mine["cosine"]) == ((want[0], pytest.approx(-want[1], abs=1e-6)) if want else (None, None)), texts[i]


def test_empty(spark):
    files = spark.createDataFrame([], "path string, text string")
    assert S.scan(files, S.template_table(spark)).count() == 0
    some = spark.createDataFrame([("a", MIT)], "path string, text string")
    assert S.scan(some, S.template_table(spark).limit(0)).first()["license"] is None


FULL = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "ISC", "MPL-2.0"]
FSF = """Copyright (C) 2019 Some Author <some@author.example>

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {0} as published by
the Free Software Foundation, either version {1} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {0} for more details.

You should have received a copy of the GNU {0}
along with this program.  If not, see <http://www.gnu.org/licenses/>."""


def test_full_texts_and_headers(spark):
    texts, names = dict(S.full_texts()[len(S.HEADERS):]), [("GPL-3.0", "General Public License", 3), ("GPL-2.0", "General Public License", 2),
                                                          ("LGPL-2.1", "Lesser General Public License", 2.1), ("AGPL-3.0", "Affero General Public License", 3)]
    code = "\n\ndef f(x):\n    return x + 1\n" + "".join(f"value_{i} = call(value_{i - 1}, other)\n" for i in range(60))
    rows = []
    for name in FULL:
        body = re.sub(r"<year>|<copyright holders>|<owner>|<copyright notice>", "2021 Jane Doe and others", texts[name])
        for width in (40, 72, 10_000):
            rows.append((f"{name}-{width}/LICENSE", name, True, "\n\n".join(textwrap.fill(p, width) for p in body.split("\n\n"))))
        rows.append((f"{name}-72/src/main.c", name, False, "int main() { return 0; }"))
    commented = "".join(f"# {line}\n" for line in texts["MIT"].splitlines())
    rows.append(("own/mit.py", "MIT", False, commented + code))
    for name, title, version in names:
        header = FSF.format(title, version)
        rows.append((f"own/{name}.py", name, False, "#!/usr/bin/python\n" + "".join(f"# {line}\n" for line in header.splitlines()) + code))
        rows.append((f"own/{name}.c", name, False, "/*\n" + "".join(f" * {line}\n" for line in header.splitlines()) + " */" + code))
    rows.append(("own/title.txt", "GPL-1.0-or-later", False, "GNU GENERAL PUBLIC LICENSE\n" + code))
    rows.append(("none/prose.txt", None, False, "the license of the software and of the work is in the hands of the public and of the authors " * 40))
    files = spark.createDataFrame([(p, t) for p, _, _, t in rows], "path string, text string")
    got = {r["path"]: r for r in S.scan(files, S.template_table(spark)).collect()}
    assert {p: (r["license"], r["is_license_file"]) for p, r in got.items()} == {p: (name, whole) for p, name, whole, _ in rows}
    assert all(got[f"{name}-72/src/main.c"]["inherited_from"] == f"{name}-72" for name in FULL)


def test_leading_comment():
    assert S.leading_comment("/* a\n b\n\n c */\n// d\n\nint x; // e") == "/* a\n b\n\n c */\n// d"
    assert S.leading_comment('"""a\nb\n"""\nx = 1') == '"""a\nb\n"""'
    assert S.leading_comment("plain\n# no") == S.leading_comment("") == ""
