import dataclasses
import itertools
import re
import time
from re import _parser

import pytest

from corpusloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_by_brute_force(spark, table, messy):
    extra = spark.createDataFrame([(1, "mit license mit license MIT License mit-license"), (2, "general public licenses general public LICENSE x " * 3)], "doc_id long, text string")
    for docs in (table("documents"), messy, extra):
        out = licenses.scan_licenses(docs).collect()
        expected = sorted(((r["doc_id"], *base(r["text"])) for r in docs.select("doc_id", "text").collect()), key=str)
        assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out), key=str) == expected
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)
    assert licenses.scan_licenses(messy.limit(0)).count() == 0


def labels(text):
    rules = licenses._compiled()
    line = b" " + b" ".join(licenses.fold(text)) + b" "
    return [(d[1], d[2], d[3]) for d in licenses.detect(line, rules)]


def test_rules():
    assert len(licenses.build_rules()) > 200
    assert labels("Licensed under the Apache License, Version 2.0.") == [("apache", 0, 8)]
    assert labels("SPDX-License-Identifier: MPL-2.0") == [("mpl", 0, 6)]
    assert [x[0] for x in labels("Permission is hereby granted, free of charge, to any person obtaining a copy")] == ["mit"]
    assert labels("nothing to see here") == []


def test_contained_detections_are_suppressed():
    found = labels("under the GNU Lesser General Public License version 2.1 here")
    assert [x[0] for x in found] == ["lgpl"]


def test_many_places_stay_linear():
    found = labels("the mit license and " * 20_000)
    assert len(found) == 20_000


def test_time_grows_with_the_text():
    rules = licenses._compiled()

    def seconds(n):
        line = b" " + b"the mit license and " * n
        began = time.process_time()
        assert len(licenses.base_places(line)) == len(licenses.detect(line, rules)) == n
        return time.process_time() - began

    seconds(1000)
    assert seconds(80_000) < 12 * seconds(20_000)  # 16 times if it were quadratic, 4 if linear


def test_places_of_ties():
    """Equal priority, length and place: by the name of the rule."""
    rules = [(licenses.Rule(n, n, b"x", "x y", 5, 0.5), re.compile(rb"(?<= )x y(?= )")) for n in ("b", "a")]
    assert [d[0] for d in licenses.detect(b" x y x y ", rules, gated=False)] == ["a", "a"]


def test_gates_change_nothing_on_the_fixtures(table):
    rules = licenses._compiled()
    for r in table("documents").select("text").collect():
        line = b" " + b" ".join(licenses.fold(r["text"])) + b" "
        assert licenses.detect(line, rules) == licenses.detect(line, rules, gated=False)


def test_rules_match_with_and_without_the_prefilter():
    everything = [(r, p) for r, p in licenses._compiled()]
    text = "Released under the MIT License. See the GNU General Public License v3, or the BSD 3-Clause License; all rights reserved."
    line = b" " + b" ".join(licenses.fold(text)) + b" "
    direct = {r.label for r, p in everything if p.search(line)}
    assert {d[1] for d in licenses.detect(line, everything)} <= direct
    assert {"mit", "gpl", "bsd"} <= {d[1] for d in licenses.detect(line, everything)}


def spellings(tree):
    """Strings a parsed pattern matches: all alternatives, repeats as short and one longer, the first of a set's characters and its last."""
    parts = []
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(value)])
        elif op == "ANY":
            parts.append(["x"])
        elif op == "IN":
            ends = [v if str(o) == "LITERAL" else v[k] for o, v in value for k in (0, -1) if str(o) == "RANGE" or k == 0]
            parts.append([chr(ends[0]), chr(ends[-1])])
        elif op == "SUBPATTERN":
            parts.append(list(spellings(value[3])))
        elif op == "BRANCH":
            parts.append([x for branch in value[1] for x in spellings(branch)])
        else:
            assert op == "MAX_REPEAT", op
            parts.append(["".join(x) for n in (value[0], value[0] + 1) for x in itertools.product(list(spellings(value[2])), repeat=n)])
    return ("".join(x) for x in itertools.product(*parts))


def names():
    for _, _, name, _ in licenses.LICENSES:
        yield from (f"the {x} license" for x in spellings(_parser.parse(name)))
    for _, _, pattern, *_ in licenses.SENTENCES:
        yield from spellings(_parser.parse(pattern))
    for _, pattern in licenses.SPDX:
        yield from (f"spdx license identifier {x}" for x in spellings(_parser.parse(pattern)))


def test_every_spelling_is_detected_as_without_the_prefilter(monkeypatch):
    rules = licenses._compiled()
    bare = [(dataclasses.replace(r, keyword=b""), p) for r, p in rules]
    lines = [b" " + x.encode() + b" " for x in sorted(set(names()))]
    gated = [licenses.detect(x, rules) for x in lines]
    monkeypatch.setattr(licenses, "STEMS", (b"",))
    assert all(gated)
    assert gated == [licenses.detect(x, bare) for x in lines]


@pytest.mark.parametrize("text, label", [("Creative Commons Attribution Non-Commercial License", "cc-by-nc"), ("Creative Commons Attribution Share-Alike License", "cc-by-sa"), ("Creative Commons Attribution No Derivatives License", "cc-by-nd"), ("Internet Systems Consortium License", "isc"), ("SSLeay License", "openssl"), ("granted, free of charge, to any person or organization obtaining a copy", "boost")])
def test_other_spellings(text, label):
    assert label in [x[0] for x in labels(text)]
