"""License scan with ordered signature rules, in DataFrame expressions only.

Texts are lowered (A-Z) and cut into words; signatures are regular expressions over the words joined by
single blanks, so punctuation and line breaks do not matter. One intersection of a
text's words with the anchor words of all rules lets most texts through untouched. In the others a rule
runs only where its anchor and its keyword occur. Detections are intervals
of words; one that lies within another is suppressed, and of equal intervals the rule of higher priority
stays. The labels of the base phrases are kept in any case.

A rule is (priority, anchor, keyword, label, pattern, weight); rules are data, and ``scan`` takes any list.

Defined cases: null and empty texts have no words and no labels; repeated rows get equal results;
overlapping detections that do not contain each other both stay; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import table
from topicloom.llm.quality import let, plain_text
from topicloom.llm.registry import query

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrase -> label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Family:
    """A license: its names, its short identifiers and its addresses, as patterns over words."""

    label: str
    names: tuple[str, ...]
    ids: tuple[str, ...] = ()
    sites: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()


V = r"(?: version| v)?"
FAMILIES = (
    Family("mit", (r"mit licen[sc]e", r"expat licen[sc]e", r"x11 licen[sc]e"), ("mit", "mit 0"),
           (r"opensource org licenses mit(?: license php)?",),
           (r"permission is hereby granted free of charge to any person obtaining a copy of this software",
            r"the above copyright notice and this permission notice shall be included in all copies")),
    Family("apache", (r"apache (?:software )?licen[sc]e",), ("apache", "asl"), (r"apache org licenses",)),
    Family("apache-1.1", (rf"apache (?:software )?licen[sc]e{V} 1 1",), ("apache 1 1",),
           (r"apache org licenses license 1 1",)),
    Family("apache-2.0", (rf"apache (?:software )?licen[sc]e{V} 2(?: 0)?",), ("apache 2 0", "asl 2 0"),
           (r"apache org licenses license 2 0(?: html| txt)?",),
           (r"unless required by applicable law or agreed to in writing software distributed under the license",)),
    Family("gpl", (r"(?:gnu )?general public licen[sc]e", r"gnu gpl"), ("gpl", "gnu gpl"),
           (r"gnu org (?:licenses|copyleft) gpl(?: html| txt)?",),
           (r"free software you can redistribute it and or modify it under the terms of the gnu general public license",)),
    Family("gpl-1.0", (rf"(?:gnu )?general public licen[sc]e{V} 1(?: 0)?",), ("gpl 1 0", "gplv1"),
           (r"gnu org licenses old licenses gpl 1 0",)),
    Family("gpl-2.0", (rf"(?:gnu )?general public licen[sc]e{V} 2(?: 0)?",), ("gpl 2 0", "gplv2", "gpl 2"),
           (r"gnu org licenses (?:old licenses )?gpl 2 0",)),
    Family("gpl-3.0", (rf"(?:gnu )?general public licen[sc]e{V} 3(?: 0)?",), ("gpl 3 0", "gplv3", "gpl 3"),
           (r"gnu org licenses gpl 3 0",)),
    Family("lgpl", (r"(?:gnu )?(?:lesser|library) general public licen[sc]e",), ("lgpl", "gnu lgpl"),
           (r"gnu org (?:licenses|copyleft) lesser",)),
    Family("lgpl-2.1", (rf"(?:gnu )?lesser general public licen[sc]e{V} 2 1",), ("lgpl 2 1", "lgplv2 1"),
           (r"gnu org licenses (?:old licenses )?lgpl 2 1",)),
    Family("lgpl-3.0", (rf"(?:gnu )?lesser general public licen[sc]e{V} 3(?: 0)?",), ("lgpl 3 0", "lgplv3"),
           (r"gnu org licenses lgpl 3 0",)),
    Family("agpl", (r"(?:gnu )?affero general public licen[sc]e",), ("agpl", "gnu agpl"),
           (r"gnu org licenses agpl",)),
    Family("agpl-3.0", (rf"(?:gnu )?affero general public licen[sc]e{V} 3(?: 0)?",), ("agpl 3 0", "agplv3"),
           (r"gnu org licenses agpl 3 0",)),
    Family("gfdl", (r"(?:gnu )?free documentation licen[sc]e",), ("gfdl", "gfdl 1 3", "gnu fdl"),
           (r"gnu org licenses fdl",)),
    Family("bsd", (r"bsd(?: style)? licen[sc]e", r"berkeley software distribution licen[sc]e"), ("bsd",),
           (r"opensource org licenses bsd license",),
           (r"redistribution and use in source and binary forms with or without modification are permitted",)),
    Family("bsd-2-clause", (r"(?:bsd )?2 clause bsd licen[sc]e", r"simplified bsd licen[sc]e", r"bsd 2 clause licen[sc]e"),
           ("bsd 2 clause",), (r"opensource org licenses bsd 2 clause",)),
    Family("bsd-3-clause", (r"(?:bsd )?3 clause bsd licen[sc]e", r"(?:new|modified|revised) bsd licen[sc]e",
                            r"bsd 3 clause licen[sc]e"), ("bsd 3 clause",), (r"opensource org licenses bsd 3 clause",)),
    Family("bsd-4-clause", (r"(?:original|4 clause) bsd licen[sc]e", r"bsd 4 clause licen[sc]e"), ("bsd 4 clause",)),
    Family("0bsd", (r"zero clause bsd(?: licen[sc]e)?", r"free public licen[sc]e"), ("0bsd",)),
    Family("isc", (r"isc licen[sc]e", r"internet systems consortium licen[sc]e"), ("isc",),
           (r"opensource org licenses isc",)),
    Family("mpl", (r"mozilla public licen[sc]e",), ("mpl",), (r"mozilla org mpl",)),
    Family("mpl-1.1", (rf"mozilla public licen[sc]e{V} 1 1",), ("mpl 1 1",), (r"mozilla org mpl mpl 1 1",)),
    Family("mpl-2.0", (rf"mozilla public licen[sc]e{V} 2(?: 0)?",), ("mpl 2 0",), (r"mozilla org mpl 2 0",),
           (r"this source code form is subject to the terms of the mozilla public license v 2 0",)),
    Family("epl", (r"eclipse public licen[sc]e",), ("epl",), (r"eclipse org legal epl",)),
    Family("epl-1.0", (rf"eclipse public licen[sc]e{V} 1(?: 0)?",), ("epl 1 0",), (r"eclipse org legal epl v10",)),
    Family("epl-2.0", (rf"eclipse public licen[sc]e{V} 2(?: 0)?",), ("epl 2 0",), (r"eclipse org legal epl 2 0",)),
    Family("cddl", (r"common development and distribution licen[sc]e",), ("cddl", "cddl 1 0", "cddl 1 1")),
    Family("cpl", (r"common public licen[sc]e",), ("cpl 1 0",)),
    Family("eupl", (r"european union public licen[sc]e",), ("eupl", "eupl 1 1", "eupl 1 2")),
    Family("artistic", (r"artistic licen[sc]e",), ("artistic", "artistic 1 0", "artistic 2 0"),
           (r"perlfoundation org artistic license",)),
    Family("zlib", (r"zlib(?: libpng)? licen[sc]e",), ("zlib",), (r"opensource org licenses zlib",)),
    Family("boost", (r"boost software licen[sc]e",), ("bsl 1 0",), (r"boost org license 1 0",)),
    Family("unlicense", (r"the unlicense", r"unlicense licen[sc]e"), ("unlicense",), (r"unlicense org",),
           (r"this is free and unencumbered software released into the public domain",)),
    Family("wtfpl", (r"do what the fuck you want to public licen[sc]e",), ("wtfpl",), (r"wtfpl net",)),
    Family("cc0", (r"cc0 1 0 universal", r"creative commons zero"), ("cc0", "cc0 1 0"),
           (r"creativecommons org publicdomain zero",)),
    Family("cc", (r"creative commons licen[sc]e",), (), (r"creativecommons org licenses",)),
    Family("cc-by", (r"creative commons attribution(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?",),
           ("cc by", "cc by 3 0", "cc by 4 0"), (r"creativecommons org licenses by",)),
    Family("cc-by-sa", (r"creative commons attribution share ?alike(?: [1-4] 0)?(?: licen[sc]e)?",),
           ("cc by sa", "cc by sa 3 0", "cc by sa 4 0"), (r"creativecommons org licenses by sa",)),
    Family("cc-by-nc", (r"creative commons attribution non ?commercial(?: [1-4] 0)?(?: licen[sc]e)?",),
           ("cc by nc", "cc by nc 4 0"), (r"creativecommons org licenses by nc",)),
    Family("cc-by-nd", (r"creative commons attribution no ?derivatives(?: [1-4] 0)?(?: licen[sc]e)?",),
           ("cc by nd", "cc by nd 4 0"), (r"creativecommons org licenses by nd",)),
    Family("cc-by-nc-sa", (r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?",),
           ("cc by nc sa", "cc by nc sa 4 0"), (r"creativecommons org licenses by nc sa",)),
    Family("cc-by-nc-nd", (r"creative commons attribution non ?commercial no ?derivatives(?: [1-4] 0)?",),
           ("cc by nc nd", "cc by nc nd 4 0"), (r"creativecommons org licenses by nc nd",)),
    Family("public-domain", (r"(?:in|into) the public domain", r"public domain dedication"), ("public domain",)),
    Family("python", (r"python software foundation licen[sc]e", r"psf licen[sc]e"), ("psf 2 0", "python 2 0")),
    Family("php", (r"php licen[sc]e",), ("php 3 0", "php 3 01")),
    Family("ruby", (r"ruby licen[sc]e",), ("ruby",)),
    Family("postgresql", (r"postgresql licen[sc]e",), ("postgresql",)),
    Family("openssl", (r"openssl licen[sc]e",), ("openssl",)),
    Family("ofl", (r"(?:sil )?open font licen[sc]e",), ("ofl", "ofl 1 1"), (r"scripts sil org ofl",)),
    Family("odbl", (r"open (?:data commons open )?database licen[sc]e",), ("odbl", "odbl 1 0")),
    Family("ms-pl", (r"microsoft public licen[sc]e",), ("ms pl",)),
    Family("ms-rl", (r"microsoft reciprocal licen[sc]e",), ("ms rl",)),
    Family("osl", (r"open software licen[sc]e",), ("osl 3 0",)),
    Family("afl", (r"academic free licen[sc]e",), ("afl 3 0", "afl 2 1")),
    Family("ecl", (r"educational community licen[sc]e",), ("ecl 2 0",)),
    Family("upl", (r"universal permissive licen[sc]e",), ("upl 1 0",)),
    Family("sspl", (r"server side public licen[sc]e",), ("sspl", "sspl 1 0")),
    Family("bsl", (r"business source licen[sc]e",), ("busl 1 1",)),
    Family("elastic", (r"elastic licen[sc]e",), ("elastic 2 0",)),
    Family("proprietary", (r"all rights reserved", r"proprietary and confidential")),
)

# How a family is spoken of: (kind, priority, weight, pattern around it).
GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?"


def _rules():
    """(priority, anchor words, label, pattern, weight)"""
    for family in FAMILIES:
        for text in family.texts:
            yield 1, text, family.label, text, 1.0
        for short in family.ids:
            word = short.split()[0]
            yield 2, word, family.label, rf"spdx license identifier {short}(?: only| or later)?", 1.0
            yield 4, word, family.label, rf"{GRANT}{short}(?: licen[sc]es?)?", 0.9
            yield 7, word, family.label, rf"licen[sc]e {short}", 0.8
            yield 8, word, family.label, rf"{short} licen[sc]ed?", 0.7
        for site in family.sites:
            yield 3, site, family.label, rf"(?:https? )?(?:www )?{site}", 0.95
        for name in family.names:
            yield 5, name, family.label, rf"{GRANT}(?:gnu )?{name}", 0.9
            yield 6, name, family.label, name, 0.6


def keyword_of(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern contains."""
    runs, depth, k = [""], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c in "([":
            depth += 1
            runs.append("")
        elif c in ")]":
            depth -= 1
        elif c == "?":
            runs[-1] = runs[-1][:-1] if pattern[k - 1] not in ")]" else runs[-1]
            runs.append("")
        elif not depth:
            runs[-1] += c
        k += 1
    return max((r.strip() for r in runs), key=len)


def anchor_of(words: str) -> str:
    """The longest whole word that every match contains."""
    # Groups stand between words; a blank that may be missing leaves no whole word around it.
    plain = re.sub(r"\S+ \?\S+", " ", re.sub(r"\(\?:[^()]*\)\??", " ", words))
    return max((w for w in plain.split() if w.isalnum()), key=len)


# (priority, anchor, keyword, label, pattern, weight); of equal intervals the smallest priority stays.
RULES = tuple((p, anchor_of(anchor), keyword_of(pattern), label, pattern, w)
              for p, anchor, label, pattern, w in sorted(set(_rules()), key=lambda r: (r[0], r[3])))

PLACES = "array<struct<first:int,last:int>>"
FOUND = "array<struct<first:int,longest:int,priority:int,label:string,weight:double>>"
SHOWN = "array<struct<first:int,last:int,label:string,priority:int>>"


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(words: Column, pattern: Column) -> Column:
    """First and last word of each match of ``pattern`` in words that have a blank on both sides."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    found = F.regexp_extract_all(words, whole, F.lit(0))
    steps = F.zip_with(F.split(words, whole, -1), found,
                       lambda gap, x: F.struct(blanks(gap).alias("gap"), blanks(x).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out"))

    def add(state, step):
        # The blank in front of a word has the word's number.
        first = state["at"] + step["gap"] - 1
        place = F.struct(first.alias("first"), (first + step["own"]).alias("last"))
        return F.struct((state["at"] + step["gap"] + step["own"]).alias("at"),
                        F.concat(state["out"], F.array(place)).alias("out"))

    return F.aggregate(F.filter(steps, lambda x: x["own"].isNotNull()), start, add, lambda state: state["out"])


def detections(words: Column, anchors: Column, rules=RULES) -> Column:
    """What the rules find, without what lies within another detection."""
    known = F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(a).alias("anchor"), F.lit(k).alias("keyword"),
                               F.lit(x).alias("label"), F.lit(r).alias("pattern"), F.lit(w).alias("weight"))
                      for p, a, k, x, r, w in rules))
    reached = F.filter(known, lambda r: F.array_contains(anchors, r["anchor"]) & F.contains(words, r["keyword"]))
    found = F.flatten(F.transform(reached, lambda r: F.transform(
        places(words, r["pattern"]), lambda x: F.struct(
            x["first"].alias("first"), (-x["last"]).alias("longest"), r["priority"].alias("priority"),
            r["label"].alias("label"), r["weight"].alias("weight")))))
    start = F.struct(F.lit(-1).alias("last"), F.array().cast(FOUND).alias("out"))
    # Sorted by start, longest first: what ends no later than an earlier one lies within it.
    return F.aggregate(
        F.sort_array(found), start,
        lambda a, x: F.when(-x["longest"] > a["last"], F.struct(
            (-x["longest"]).alias("last"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a),
        lambda a: a["out"])


def findings(words: Column, anchors: Column, rules=RULES) -> Column:
    """Base places and detections of one text."""
    base = F.array(*(F.struct(F.lit(x).alias("label"), places(words, F.lit(p)).alias("places"))
                     for p, x in BASE.items()))
    base = F.when(F.contains(words, F.lit(" license ")), base)
    return F.struct(base.alias("base"), detections(words, anchors, rules).alias("found"))


def scan(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections."""
    anchors = F.array(*(F.lit(x) for x in sorted({r[1] for r in rules} | {"license"})))
    # lower() also lowers letters beyond ASCII: they stay parts of words, and no signature holds any.
    cut = F.split(F.lower(plain_text(F.col(text))), NOT_WORD)

    def of_words(words):
        # A blank before, between and after the words.
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        found = let(F.array_intersect(words, anchors), lambda met: F.when(
            F.size(met) > 0, let(joined, lambda j: findings(j, met, rules))))
        return F.struct(F.size(words).cast("long").alias("n_words"), found.alias("x"))

    def summary(row):
        found = row["x"]["found"]
        base = row["x"]["base"]
        firsts = F.flatten(F.transform(base, lambda b: b["places"]["first"]))
        own = F.transform(F.filter(base, lambda b: F.size(b["places"]) > 0), lambda b: b["label"])
        none = F.array().cast("array<string>")
        joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
        return F.struct(
            row["n_words"].alias("n_words"),
            F.when(firsts.isNull(), 0).otherwise(F.size(firsts)).cast("long").alias("n_base"),
            F.array_min(firsts).cast("long").alias("first_word"),
            F.array_max(firsts).cast("long").alias("last_word"),
            joined(F.coalesce(own, none)).alias("base_labels"),
            joined(F.concat(F.coalesce(own, none), F.coalesce(F.transform(found, lambda x: x["label"]), none)))
            .alias("labels"),
            F.coalesce(F.array_max(F.transform(found, lambda x: x["weight"])), F.lit(0.0)).alias("score"),
            F.coalesce(F.transform(found, lambda x: F.struct(
                x["first"].alias("first"), (-x["longest"]).alias("last"), x["label"].alias("label"),
                x["priority"].alias("priority"))), F.array().cast(SHOWN)).alias("detections"))

    result = let(let(F.filter(cut, lambda w: w != ""), of_words), summary)
    return docs.select("doc_id", result.alias("__scan")).select("doc_id", "__scan.*")


@query("op5_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
