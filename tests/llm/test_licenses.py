import itertools
import re
from re import _parser

from tidemark.llm.license_rules import GATE, PHRASES, signatures
from tidemark.llm.licenses import SURE, license_labels

TEXTS = [
    None, "", "...", "plain words only", "All rights reserved.", "all rights\n\nreserved all rights reserved ALL-RIGHTS-RESERVED", "Licensed under CC BY-NC 4.0.",
    "cc by cc by cc by", "xcc by", "cc byx", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0. And licensed under the MIT license",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "é cc by é general public license ünd all rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, all rights reserved", "word " * 30_000 + "cc by", "Copyright (c) 2020 Someone. Some rights reserved",
    "the mit license, the MIT licence; licensed under the terms of the mit", "No part of this book may be reproduced", "CC0 license", "general public license 2.0 license", "\x00cc\x00by\x00",
    "cc by sa 4 0 license cc by nc", "placed in the public domain",
]


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    base = sorted({label for _, label in places})
    joined = " " + " ".join(words) + " "
    found = []
    for s in signatures():
        for m in re.finditer(f"(?<= )(?:{s.regex})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, s.priority, s.label, s.regex))
    found.sort(key=lambda d: (d[0], -d[1], d[2:]))
    kept = [d for k, d in enumerate(found) if not any(e[1] >= d[1] and e[2] <= d[2] for e in found[:k])]
    labels = sorted({*base, *(d[3] for d in kept)})
    score = max([0.0, *(SURE[d[2]] for d in kept), *([SURE[4]] if base else [])])
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), score)


def test_labels_equal_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, TEXTS[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as label").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in license_labels(df).collect()]
    assert sorted(got, key=str) == sorted([(k, *plain(t)) for k, t in rows], key=str)


def test_rules_are_gated_by_words_they_need():
    assert len(signatures()) > 200
    for t in TEXTS[:16] + TEXTS[17:]:
        joined = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) + " "
        for s in signatures():
            if re.search(f"(?<= )(?:{s.regex})(?= )", joined):
                assert s.keyword in joined.split(), (s, t)
                assert any(g in joined for g in GATE), (s, t)


def test_empty_table(spark):
    assert license_labels(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def spelled(items):
    """A text for each way through a parsed regex; repeats once at least and twice at most."""
    ways = []
    for op, arg in items:
        if op is _parser.LITERAL:
            ways.append([chr(arg)])
        elif op is _parser.IN:
            ways.append([chr(a) if o is _parser.LITERAL else "7" for o, a in arg])
        elif op is _parser.BRANCH:
            ways.append([t for branch in arg[1] for t in spelled(branch)])
        elif op is _parser.SUBPATTERN:
            ways.append(spelled(arg[3]))
        else:
            assert op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT), op
            low, high, inner = arg
            ways.append([t * n for n in sorted({low, min(high, low + 1)}) for t in spelled(inner)])
    return ["".join(way) for way in itertools.product(*ways)]


def test_gates_let_every_way_through_a_rule_pass():
    for s in signatures():
        for text in spelled(_parser.parse(s.regex)):
            assert re.fullmatch(s.regex, text)
            assert s.keyword in text.split(), (s, text)
            assert any(g in f" {text} " for g in GATE), (s, text)


def test_names_without_the_word_license(spark):
    told = {
        "This work is licensed under CC0 1.0": "cc0-1.0", "licensed under the WTFPL": "wtfpl", "WTFPL": "wtfpl", "released under OpenRAIL": "openrail", "released under Open RAIL": "openrail",
        "CC0 licence": "cc0-1.0", "FreeBSD license": "bsd-2-clause", "zero clause BSD license": "0bsd", "for noncommercial use only": "non-commercial", "Mulan PSL v2": "mulanpsl-2.0",
    }
    rows = list(enumerate(told))
    got = {r.doc_id: (r.labels, r.score) for r in license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(told[t] in got[k][0].split(",") and got[k][1] >= 0.7 for k, t in rows), got
    assert {k: got[k] for k, _ in rows} == {k: plain(t)[-2:] for k, t in rows}
