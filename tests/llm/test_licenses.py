import re

from labelloom.llm.license_rules import SIGNATURES, literals, spaced
from labelloom.llm.licenses import BASE, GATE_PATTERN, LEVELS, gate_words, license_scan, rules


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for label, p in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    spans = []
    for order, (label, _, pattern, priority) in enumerate(rules()):
        spans += [(*m.span(), label, priority, order) for m in re.compile("(?a)" + pattern).finditer(text)]
    rank = lambda s: (-s[3], s[0] - s[1], s[0], s[4])
    kept = [s for s in spans if not any(o is not s and o[0] <= s[0] and o[1] >= s[1] and o[3] >= s[3] and rank(o) < rank(s) for o in spans)]
    base = sorted({label for _, label in places})
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    score = max([0.5 * bool(base), *(s[3] / LEVELS for s in kept)])
    return len(words), len(places), first, last, ",".join(base), ",".join(sorted({*base, *(s[2] for s in kept)})), score, sorted(s[:4] for s in kept)


TEXTS = [
    None, "", "no words of interest", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.", "cc, by! CC\nBy ccby cc by2 ñcc by ccñ by cc by", "general  PUBLIC\tlicense public license general public license",
    "SPDX-License-Identifier: Apache-2.0\nCopyright (c) 2019, 2020 X", "GNU Lesser General Public License v2.1 and the GNU Affero General Public License, version 3",
    "license: MIT / License: BSD license", "Creative Commons Attribution-ShareAlike 4.0", "é ü 😀 All rights reserved. 😀 all rights reserved", "subject to the Mozilla Public License 2.0 license",
    "Three-clause BSD license, new BSD license", "MIT " * 50 + "license", "copyright " * 40, "dedicated to the public domain", "\x00all\x01rights\x7freserved\x00",
    "you may not copy this without permission of the rights holder", "word " * 30000 + "the MIT license",
]


def test_against_brute_force(docs):
    rows = list(enumerate(TEXTS)) + [(500, "\n".join(t or "" for t in TEXTS[:-1])), (None, TEXTS[4]), (3, TEXTS[3])]
    got = license_scan(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        r = by[i]
        own = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted((s.start, s.end, s.label, s.priority) for s in r.spans))
        assert own == brute(t), (i, (t or "")[:80])


FOUND = [
    ("Licensed under the GNU Library General Public License, version 2.1", "lgpl-2.1"), ("this may not be copied without permission", "no-redistribution"), ("no right to copy it without permission", "no-redistribution"),
    ("CC0 1.0", "cc0"), ("cc0", "cc0"), ("Creative Commons", "cc"), ("dedicated to the public\n domain", "public-domain"), ("the simplified license", "bsd-2-clause"), ("under a Two-Clause license", "bsd-2-clause"),
    ("2-clause licence", "bsd-2-clause"), ("cc-by-sa", "cc-by-sa"), ("cc by 4.0", "cc-by-4.0"),
]


def test_gate_and_keywords_lose_nothing(docs):
    got = {r.doc_id: r for r in license_scan(docs([(i, t) for i, (t, _) in enumerate(FOUND)])).collect()}
    for i, (t, label) in enumerate(FOUND):
        want = brute(t)
        assert label in {s[2] for s in want[7]}, (t, want)
        assert sorted((s.start, s.end, s.label, s.priority) for s in got[i].spans) == want[7] and got[i].labels == want[5], t


def test_rules():
    found = rules()
    assert len(found) >= 200 and {n for *_, n in found} == {1, 2, 3, 4, 5}


def test_empty(docs):
    assert license_scan(docs([])).count() == 0


# Written by hand from what license notices say, not from the rules: text, labels.
NOTICES = [
    ("License: MIT", "mit"), ("license:MIT", "mit"), ("License = Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier:MIT", "mit"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
    ("Apache-2.0 license", "apache-2.0"), ("license: apache-2.0", "apache-2.0"), ("GNU GPL v3", "gpl-3.0"), ("GPLv3", "gpl-3.0"), ("LGPL-2.1", "lgpl-2.1"), ("License: BSD-3-Clause", "bsd-3-clause"), ("BSD 2-Clause License", "bsd-2-clause"),
    ("# SPDX-License-Identifier : BSD-2-Clause", "bsd-2-clause"), ("distributed under the terms of the MPL 2.0 license", "mpl-2.0"), ("Licensed under the EUPL", "eupl"),
    ("Permission is hereby granted, free of charge, to any person\n obtaining a copy of this software and associated documentation files", "mit"),
    ("you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by", "gpl,gpl-any"),
    ("either version 2 of the License, or (at your option) any later version.", "gpl-2.0"),
    ("Redistribution and use in source and binary forms, with or without\n  modification, are permitted provided that", "bsd"),
    ("Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("https://creativecommons.org/licenses/by-nc/4.0/", "cc-by-nc"), ("No part of this publication may be reproduced in any form", "no-redistribution"), ("Alle Rechte vorbehalten.", "reserved-all"),
    ("if the library is simplified, the example is simple", ""), ("the general is in public", ""), ("a mitten and an apache helicopter", ""), ("the museum of new bsds", ""), ("she was permitted to go", ""),
]


def test_hand_written_labels(docs):
    got = {r.doc_id: r.labels for r in license_scan(docs([(i, t) for i, (t, _) in enumerate(NOTICES)])).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(NOTICES)} == dict(NOTICES)


def test_every_rule_is_reached_by_its_keyword():
    words = gate_words()
    assert all(" " not in w and len(w) > 2 for w in words) and len(words) < 60
    for label, keyword, pattern, _ in rules():
        assert all(len(k) > 2 for k in keyword.split("|")), label
        runs = [[k] for k in keyword.split("|")] if keyword not in {literals(p)[0] for _, _, p in SIGNATURES} else [next(literals(p) for _, _, p in SIGNATURES if spaced(p) in pattern)]
        for own in runs:
            assert "licen" in pattern or any(w in run for w in words for run in own) or re.search(GATE_PATTERN, own[0]), (label, own)
    for label, _, pattern in SIGNATURES:
        assert len(literals(pattern)[0]) > 4 and "|" not in re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", "", pattern), label


EVERYDAY = [
    ("The Unlicense", "unlicense"), ("this module is MIT-licensed.", "mit"), ("Mozilla Public License 2.0", "mpl-2.0"), ("the Mozilla Public License, version 2.0", "mpl-2.0"),
    ("Eclipse Public License 2.0", "epl-2.0"), ("Eclipse Public License - v 2.0", "epl-2.0"), ("Creative Commons Attribution 4.0", "cc-by-4.0"),
]


def test_everyday_names_by_hand(docs):
    got = {r.doc_id: r.labels.split(",") for r in license_scan(docs([(i, t) for i, (t, _) in enumerate(EVERYDAY)])).collect()}
    assert all(label in got[i] for i, (_, label) in enumerate(EVERYDAY)), got


def test_thousands_of_findings_in_a_text(docs):
    import time

    unit = "MIT license. All rights reserved. cc by 4.0 x "
    took = []
    for n in (60, 700):
        text = unit * n
        began = time.time()
        r = license_scan(docs([(1, text)])).first()
        took.append(time.time() - began)
        assert sorted((s.start, s.end, s.label, s.priority) for s in r.spans) == brute(text)[7]
    frame, began = docs([(1, unit * 6000)]), time.time()
    assert len(license_scan(frame).first().spans) == 18_000
    assert time.time() - began < took[1] + 20
