import re

from conftest import SF
from odd import documents, empty, plain

from topicloom.llm import licenses as li
from topicloom.llm.registry import QUERIES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORDS.findall((text or "").translate(ASCII))


def base(text):
    words, places, labels = words_of(text), [], set()
    for phrase, label in li.BASE.items():
        own = phrase.split()
        for k in range(len(words)):
            if words[k:k + len(own)] == own:
                places.append(k)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def method(text):
    """Detections by brute force: all rules on all texts, then containment pair by pair."""
    joined = " " + " ".join(words_of(text)) + " "
    found = []
    for priority, _, _, label, pattern, _ in li.RULES:
        for m in re.finditer(rf"(?<= )(?:{pattern})(?= )", joined):
            first = joined[:m.start()].count(" ") - 1
            found.append((first, first + m.group().count(" "), priority, label))
    found = sorted(set(found), key=lambda d: (d[0], -d[1], d[2], d[3]))
    return [d for k, d in enumerate(found)
            if not any(e[0] <= d[0] and e[1] >= d[1] for e in found[:k])]


TEXTS = [
    "The MIT License. mit license mit license", None, "", "Licensed under the Apache License, Version 2.0!",
    "SPDX-License-Identifier: GPL-3.0-or-later\nsee https://www.gnu.org/licenses/gpl-3.0.html",
    "GNU Lesser General Public License v2.1 and the GNU General\nPublic License", "released under MIT",
    "BSD-style license; 3-clause BSD license; new bsd licence", "in the public domain. all rights reserved",
    "CC BY-NC-SA 4.0 licensed, Creative Commons Attribution ShareAlike 4.0 License", "mit mir mit dir license",
    "This is free and unencumbered software released into the public domain (unlicense.org)",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "GENERAL PUBLIC LICENSE ÄÖÜ apache  license", "mit license " * 300, "the mozilla public license version 2.0",
]


def test_against_brute_force(spark):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in li.scan(documents(spark, rows)).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        want = method(text)
        assert [(d.first, d.last, d.priority, d.label) for d in r.detections] == want, text
        labels = {d[3] for d in want} | set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(labels)) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(want)


def test_keywords_and_anchors_are_in_every_match():
    for _, anchor, keyword, _, pattern, _ in li.RULES:
        plain_pattern = pattern.replace("[sc]", "s")
        assert anchor in plain_pattern and keyword in pattern
    assert len(li.RULES) > 400
    assert li.keyword_of(r"(?:gnu )?affero general public licen[sc]e(?: v)? 3") == "affero general public licen"
    assert li.anchor_of(r"bsd(?: style)? licen[sc]e") == "bsd"


def test_query_base_columns(spark):
    docs = plain(spark.read.parquet(f"{SF}/documents.parquet")).set_index("doc_id")
    got = QUERIES["op5_license_scan"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(docs.text[r.doc_id])


def test_odd_rows(spark):
    df = documents(spark)
    assert li.scan(df).count() == df.count()
    assert li.scan(empty(spark)).count() == 0
