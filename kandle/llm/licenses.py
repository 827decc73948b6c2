"""License scan (operator 9, DataFrame operations only): ordered signature rules.

A text is reduced to its words (ASCII letters lower-cased, everything else that is no letter, digit
or non-ASCII character taken as a separator). A rule is a regular expression over those words with
a keyword, a label, a priority and a confidence: hand-written signatures (``license_signatures``: sentences and headings, a rule
each, with its own exceptions) and names with their versions (``rules``). A document that holds none of a few stems is done;
otherwise the rules whose keyword it holds are tried, all their matches become intervals, and a
match is suppressed if one of the same or a higher priority contains it (of equal intervals the
higher priority, then the first label, stands). The labels of what is left are the findings.

Three base phrases are counted apart from the rules and always keep their labels.

Everything happens inside the row: no join, no shuffle, whole texts.

Edge cases: null and empty texts have no words, no labels ('') and score 0; a text without base
phrase has null first_word and last_word; repeated rows get equal findings; an empty table gives no
rows; further columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kandle.llm.license_signatures import SIGNATURES, STRONG

# fixed values: phrase -> label
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: priority 3: a named license with its version; 2: named without version; 1: generic wording
_VERSIONED = {
    # label stem: (names, versions)
    "apache": (["apache", "apache software", "asl"], ["1.0", "1.1", "2.0"]),
    "gpl": (["gpl", "gnu gpl", "gnu general public"], ["1.0", "2.0", "3.0"]),
    "lgpl": (["lgpl", "gnu lgpl", "gnu lesser general public", "gnu library general public"], ["2.0", "2.1", "3.0"]),
    "agpl": (["agpl", "gnu agpl", "gnu affero general public", "affero general public"], ["1.0", "3.0"]),
    "gfdl": (["gfdl", "gnu free documentation"], ["1.1", "1.2", "1.3"]),
    "mpl": (["mpl", "mozilla public"], ["1.0", "1.1", "2.0"]),
    "epl": (["epl", "eclipse public"], ["1.0", "2.0"]),
    "cddl": (["cddl", "common development and distribution"], ["1.0", "1.1"]),
    "eupl": (["eupl", "european union public"], ["1.0", "1.1", "1.2"]),
    "osl": (["osl", "open software"], ["1.0", "2.0", "2.1", "3.0"]),
    "afl": (["afl", "academic free"], ["1.2", "2.0", "2.1", "3.0"]),
    "artistic": (["artistic", "perl artistic"], ["1.0", "2.0"]),
    "ofl": (["ofl", "sil open font", "open font"], ["1.0", "1.1"]),
    "bsl": (["bsl", "boost software"], ["1.0"]),
    "lppl": (["lppl", "latex project public"], ["1.0", "1.1", "1.2", "1.3"]),
    "cpl": (["cpl", "common public"], ["1.0"]),
    "ecl": (["ecl", "educational community"], ["1.0", "2.0"]),
    "zpl": (["zpl", "zope public"], ["1.1", "2.0", "2.1"]),
    "php": (["php"], ["3.0", "3.01"]),
    "odbl": (["odbl", "open database"], ["1.0"]),
    "w3c": (["w3c software"], ["1.0"]),
    "cecill": (["cecill"], ["1.0", "2.0", "2.1"]),
}
_NAMED = {
    "mit": ["mit license", "mit licence", "expat license", "the mit licensed"], "isc": ["isc license", "isc licence"],
    "x11": ["x11 license"], "zlib": ["zlib license", "zlib libpng license"], "unlicense": ["the unlicense", "unlicense org"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public license"], "beerware": ["beer ware license", "beerware license"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd license"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd", "new bsd license", "modified bsd license"],
    "bsd-4-clause": ["bsd 4 clause", "4 clause bsd", "original bsd license"], "0bsd": ["bsd zero clause", "0bsd"],
    "bsd": ["bsd license", "bsd style license", "bsd licence"], "ncsa": ["university of illinois ncsa open source license"],
    "postgresql": ["postgresql license"], "python-2.0": ["python software foundation license", "psf license"],
    "ruby": ["ruby license"], "openssl": ["openssl license"], "vim": ["vim license"], "curl": ["curl license"],
    "ms-pl": ["microsoft public license"], "ms-rl": ["microsoft reciprocal license"], "json": ["the software shall be used for good not evil"],
    "cc0": ["cc0", "creative commons zero", "creative commons cc0"],
    "mit-text": ["permission is hereby granted free of charge to any person obtaining a copy"],
    "isc-text": ["permission to use copy modify and or distribute this software for any purpose"],
    "bsd-text": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "apache-text": ["you may not use this file except in compliance with the license"],
    "gpl-text": ["this program is free software you can redistribute it and or modify it"],
    "zlib-text": ["this software is provided as is without any express or implied warranty"],
}
_GENERIC = [
    # label, keyword that every match holds, regex
    ("public-domain", "the public domain", "(?:in|into|to) the public domain"),
    ("public-domain", "public domain dedication", "public domain dedication"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("all-rights-reserved", "alle rechte vorbehalten", "alle rechte vorbehalten"),
    ("all-rights-reserved", "tous droits réservés", "tous droits réservés"),
    ("all-rights-reserved", "todos los derechos reservados", "todos los derechos reservados"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("proprietary", "proprietary", "proprietary (?:license|software|and confidential)"),
    ("proprietary", "confidential and proprietary", "confidential and proprietary"),
    ("non-commercial", "commercial", "(?:for )?non ?commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "not for commercial use", "not for commercial use"),
    ("no-derivatives", "derivative", "no derivative works?"),
    ("no-derivatives", "derivative", "may not create derivative"),
    ("share-alike", "alike", "share ?alike"),
    ("attribution", "attribution required", "attribution required"),
    ("free-license", "licen", "licen[cs]ed under (?:a|the|an) [^ ]+(?: [^ ]+){0,3} licen[cs]e"),
]
_CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:s|atives)",
       "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike",
       "by-nc-nd": "attribution non ?commercial no ?deriv(?:s|atives)"}
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


def rules() -> list[tuple]:
    """(keyword, regex, label, priority, confidence). Regexes see ' w1 w2 ... '."""
    out = []

    def add(keyword, body, label, priority, confidence):
        out.append((keyword, f"(?<= )(?:{body})(?= )", label, priority, confidence))

    def words(v):  # "2.0" -> "2 0", with a bare "2" meaning the same
        major, minor = v.split(".")
        return f"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}"

    for stem, (names, versions) in _VERSIONED.items():
        for name in names:
            lic = "(?: public)?(?: licen[cs]e)?"
            between = f"{lic}(?: version| v)? v?"
            if " " not in name:  # GPLv3, LGPL2.1; a longer name only before a v (apache2 and php3 are programs)
                between = f"(?:{between}|{'(?:v ?)?' if len(name) <= 4 and name != 'php' else 'v ?'})"
            for v in versions:
                add(name, f"{name}{between}{words(v)}(?! [0-9])", f"{stem}-{v}", 3, 0.95)
            add(name, f"{name} licen[cs]e" if len(name) > 4 else name, stem, 2, 0.8)
        for v in versions:
            add("spdx", f"spdx license identifier {stem} {v.replace('.', ' ')}(?: only| or later)?", f"{stem}-{v}", 3, 1.0)
    for label, names in _NAMED.items():
        for name in names:
            add(name, name, label, 2, 0.9)
        add("spdx", f"spdx license identifier {label.replace('-', ' ').replace('.', ' ')}", label, 3, 1.0)
    for kind, spelled in _CC.items():
        short = kind.replace("-", " ")
        for v in _CC_VERSIONS:
            add("cc by", f"cc {short} {words(v)}", f"cc-{kind}-{v}", 3, 0.95)
            add("creative commons", f"creative commons {spelled} {words(v)}", f"cc-{kind}-{v}", 3, 0.95)
            add("creativecommons", f"creativecommons org licenses {short} {words(v)}", f"cc-{kind}-{v}", 3, 1.0)
        add("cc by", f"cc {short}(?! (?:sa|nd|nc) )", f"cc-{kind}", 2, 0.85)
        add("creative commons", f"creative commons {spelled}", f"cc-{kind}", 2, 0.85)
    for label, keyword, body in _GENERIC:
        add(keyword, body, label, 1, 0.4)
    return out


#: every keyword holds one of these
STEMS = ("licen", "gpl", "gnu ", "apache", "mozilla", "mpl", "creative", "cc by", "cc0", "bsd", "public", "copyright", "rights",
         "rechte", "droits", "derechos", "proprietary", "confidential", "commercial", "spdx", "redistrib", "wtfpl", "permission",
         "deriv", "alike", "attribution", "epl", "cddl", "eupl", "osl", "afl", "artistic", "ofl", "open font", "bsl", "boost",
         "lppl", "latex", "cpl", "ecl", "zpl", "zope", "php", "odbl", "open database", "open software", "w3c", "cecill", "asl",
         "common development", "affero", "gfdl", "academic free", "educational community", "good not evil", "as is without",
         "free software")


def signatures() -> list[tuple]:
    """The hand-written rules (``license_signatures``), in the form of ``rules``."""
    return [(keyword, f"(?<= )(?:{body})(?= )", label, priority, confidence) for label, priority, confidence, keyword, body in SIGNATURES]


def normal_words(text: str) -> Column:
    """' w1 w2 ... ' ('' without words). ``lower`` also folds other letters, which keeps them word characters."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(t == "", F.lit("")).otherwise(F.concat(F.lit(" "), t, F.lit(" ")))


def _count(s: Column, what: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))


def _base(norm: Column) -> list[Column]:
    """Per phrase: struct(label, n, first, last), null if absent. Words stand between spaces of their own
    ('  ' between words), so matches that share a border do not hide each other."""
    d = F.concat(F.lit(" "), F.replace(F.trim(norm), F.lit(" "), F.lit("  ")), F.lit(" "))
    out = []
    for phrase, label in BASE.items():
        p = " " + phrase.replace(" ", "  ") + " "
        first = F.substring(d, F.lit(1), F.instr(d, F.lit(p)) - 1)
        last = F.substring(d, F.lit(1), F.length(d) - F.instr(F.reverse(d), F.lit(p[::-1])) - len(p) + 1)
        out.append(F.when(F.contains(norm, F.lit(f" {phrase} ")), F.struct(
            F.lit(label).alias("label"), (_count(d, p) / len(p)).cast("long").alias("n"),
            (_count(first, " ") / 2).cast("long").alias("first"), (_count(last, " ") / 2).cast("long").alias("last"))))
    return out


def _matches(norm: Column, rule: Column) -> Column:
    """Intervals of a rule: struct(start, -end, -priority, label, confidence)."""
    marked = F.regexp_replace(norm, F.concat(F.lit("("), rule["re"], F.lit(")")), F.lit("\x01$1\x02"))
    parts = F.split(marked, "\x01")
    row = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("p"), F.lit("").alias("l"), F.lit(0.0).alias("c"))
    start = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.filter(F.array(row), lambda x: F.lit(False)).alias("out"))

    def step(acc, part):
        n = F.instr(part, F.lit("\x02")) - 1
        hit = F.struct(acc["at"].alias("s"), (-(acc["at"] + n)).alias("e"), (-rule["p"]).alias("p"), rule["l"].alias("l"), rule["c"].alias("c"))
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), start, step, lambda a: a["out"])).otherwise(
        start["out"])


def _findings(norm: Column) -> Column:
    """struct(labels, conf) of the matches that no match of the same or a higher priority contains."""
    def tried_of(table: list[tuple]) -> Column:
        rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("re"), F.lit(lab).alias("l"), F.lit(p).alias("p"), F.lit(c).alias("c"))
                         for k, r, lab, p, c in table])
        return F.filter(rows, lambda r: F.contains(norm, r["k"]))

    strong = F.lit(False)
    for stem in STRONG:
        strong = strong | F.contains(norm, F.lit(stem))
    named = tried_of(rules())
    tried = F.when(strong, F.concat(named, tried_of(signatures()))).otherwise(named)
    hits = F.array_sort(F.flatten(F.transform(tried, lambda r: _matches(norm, r))))
    # in this order a containing match comes first; reach_p: furthest end so far of priority p or higher
    zero = F.struct(F.lit(-1).alias("r1"), F.lit(-1).alias("r2"), F.lit(-1).alias("r3"),
                    F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("conf"))

    def step(acc, h):
        prio, end = -h["p"], -h["e"]
        reach = F.when(prio == 1, acc["r1"]).when(prio == 2, acc["r2"]).otherwise(acc["r3"])
        out = reach >= end

        def upto(p):
            return F.when(prio >= p, F.greatest(acc[f"r{p}"], end)).otherwise(acc[f"r{p}"]).alias(f"r{p}")

        return F.struct(upto(1), upto(2), upto(3),
                        F.when(out, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(h["l"]))).alias("labels"),
                        F.when(out, acc["conf"]).otherwise(F.greatest(acc["conf"], h["c"])).alias("conf"))

    return F.aggregate(hits, zero, step, lambda a: F.struct(a["labels"].alias("labels"), a["conf"].alias("conf")))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    norm = F.col("__norm")
    rows = docs.select(id_col, normal_words(text).alias("__norm"))
    gate = F.lit(False)
    for s in dict.fromkeys((*STEMS, *STRONG)):
        gate = gate | F.contains(norm, F.lit(s))
    rows = rows.select(
        id_col, F.when(norm == "", 0).otherwise(_count(norm, " ") - 1).cast("long").alias("n_words"),
        F.when(gate, F.struct(F.array_compact(F.array(*_base(norm))).alias("base"), _findings(norm).alias("found"))).alias("x"))
    base = F.coalesce(F.col("x.base"), F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>"))
    base_labels = F.transform(base, lambda b: b["label"])
    found = F.coalesce(F.col("x.found.labels"), F.array().cast("array<string>"))
    conf = F.greatest(F.coalesce(F.col("x.found.conf"), F.lit(0.0)), F.when(F.size(base) > 0, 1.0).otherwise(0.0))
    return rows.select(
        id_col, "n_words", F.aggregate(base, F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, found)), ",").alias("labels"), conf.alias("score"))
