"""Licence detection by ordered signature rules, in DataFrame operations only.

A text becomes its lower-case words joined by single spaces. A rule is a regular expression over such
words with a label, a priority and a keyword; rules run only on texts that hold their keyword, and
texts that hold none at the start of a word skip all of them. Detections are word intervals. One that lies
within another goes; of partly overlapping ones that with the higher priority (then the earlier one) stays.
Everything happens within a row, so nothing is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgraph.llm.quality_rules import let
from shoalgraph.llm.runtime import prepare, text_or_empty

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def versions(*found: str) -> list[tuple[str, str]]:
    """(label part, words) of version numbers; a point separates words."""
    return [(v, v.replace(".", " ")) for v in found]


def rules() -> list[tuple[str, str, int, str]]:
    """(label, regular expression, priority, keyword) in order; written as families times versions times forms."""
    out: list[tuple[str, str, int, str]] = []
    lic = "licen[sc]e"
    for short, name, vs in (
        ("gpl", "general public", ("1.0", "2.0", "3.0")),
        ("lgpl", "(?:lesser|library) general public", ("2.0", "2.1", "3.0")),
        ("agpl", "affero general public", ("1.0", "3.0")),
    ):
        for v, w in versions(*vs):
            number = w.removesuffix(" 0") + "(?: 0)?"
            forms = (
                f"(?:gnu )?{name} {lic}(?: as published by the free software foundation)?(?: either)? (?:v|version )?{number}",
                f"(?:gnu )?{short} ?v?{number}",
                f"spdx {lic} identifier {short} {number}",
            )
            for form, keyword in zip(forms, ("public licen", short, "spdx"), strict=True):
                out.append((f"{short}-{v}-or-later", f"{form}(?: of the {lic})? (?:or (?:at your option )?(?:any )?later|or later)(?: version)?", 90, keyword))
                out.append((f"{short}-{v}-only", f"{form} only", 90, keyword))
                out.append((f"{short}-{v}", form, 80, keyword))
        out.append((short, f"(?:released|licensed|distributed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{name} {lic}", 50, "public licen"))
        out.append((short, f"gnu {name} {lic}", 40, "public licen"))
        out.append((short, f"gnu {short}", 40, short))
    for parts, names in (
        ("by", "attribution"),
        ("by-sa", "attribution share ?alike"),
        ("by-nc", "attribution non ?commercial"),
        ("by-nd", "attribution no ?deriv(?:ative|ativ|s)(?:es|s)?"),
        ("by-nc-sa", "attribution non ?commercial share ?alike"),
        ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative|s)(?:s)?"),
    ):
        w = parts.replace("-", " ")
        for v, number in versions("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append((f"cc-{parts}-{v}", f"cc {w} {number}", 80, f"cc {w}"))
            out.append((f"cc-{parts}-{v}", f"creative commons {names}(?: {number}| (?:version )?{number}| international {lic} {number}| \\w+ {lic} {number})", 80, "creative commons"))
            out.append((f"cc-{parts}-{v}", f"spdx {lic} identifier cc {w} {number}", 85, "spdx"))
        out.append((f"cc-{parts}", f"(?:licensed|released|available) under (?:a |the )?cc {w}", 50, f"cc {w}"))
        out.append((f"cc-{parts}", f"cc {w}", 40, f"cc {w}"))
        out.append((f"cc-{parts}", f"creative commons {names}", 40, "creative commons"))
    for label, name, vs in (
        ("apache", "apache(?: software)?", ("1.0", "1.1", "2.0")),
        ("mpl", "mozilla public", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse public", ("1.0", "2.0")),
        ("cddl", "common development and distribution", ("1.0", "1.1")),
        ("artistic", "(?:perl )?artistic", ("1.0", "2.0")),
        ("bsl", "boost software", ("1.0",)),
        ("eupl", "european union public", ("1.0", "1.1", "1.2")),
        ("ofl", "(?:sil )?open font", ("1.0", "1.1")),
        ("afl", "academic free", ("2.0", "2.1", "3.0")),
        ("osl", "open software", ("1.0", "2.0", "2.1", "3.0")),
        ("cpl", "common public", ("1.0",)),
        ("zpl", "zope public", ("2.0", "2.1")),
        ("php", "php", ("3.0", "3.01")),
        ("psf", "python software foundation", ("2.0",)),
        ("lppl", "latex project public", ("1.0", "1.3")),
    ):
        for v, number in versions(*vs):
            n = number.removesuffix(" 0") + "(?: 0)?"
            out.append((f"{label}-{v}", f"(?:licensed under |released under |under )?(?:the )?{name} {lic}(?: agreement)? (?:v|version )?{n}", 80, "licen"))
            out.append((f"{label}-{v}", f"{label} {number}", 60, f"{label} "))
            out.append((f"{label}-{v}", f"spdx {lic} identifier {label} {number}", 85, "spdx"))
        out.append((label, f"(?:released|licensed|distributed) under (?:the )?(?:terms of (?:the )?)?{name} {lic}", 50, "licen"))
        out.append((label, f"{name} {lic}", 40, "licen"))
    for label, name in (
        ("mit", "mit"),
        ("mit", "expat"),
        ("isc", "isc"),
        ("zlib", "zlib"),
        ("x11", "x11"),
        ("ncsa", "ncsa"),
        ("ruby", "ruby"),
        ("vim", "vim"),
        ("w3c", "w3c"),
        ("curl", "curl"),
        ("icu", "icu"),
        ("postgresql", "postgresql"),
        ("bsd-2-clause", "(?:simplified|2 clause) bsd"),
        ("bsd-3-clause", "(?:new|modified|revised|3 clause) bsd"),
        ("bsd-4-clause", "(?:original|4 clause) bsd"),
        ("0bsd", "(?:0bsd|zero clause bsd)"),
        ("bsd", "bsd"),
        ("openssl", "openssl"),
        ("json", "json"),
        ("beerware", "beer ?ware"),
    ):
        out.append((label, f"(?:released|licensed|distributed|available) under (?:the )?(?:terms of (?:the )?)?{name} {lic}", 50, "licen"))
        out.append((label, f"{name}(?: style)? {lic}", 40, "licen"))
        out.append((label, f"spdx {lic} identifier {name}", 85, "spdx"))
    for label, form, keyword in (
        ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
        ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use"),
        ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use"),
        ("cc0-1.0", "(?:cc0|cc zero|creative commons zero)(?: v?1 0)?(?: universal)?", "cc"),
        ("unlicense", "this is free and unencumbered software released into the public domain", "public domain"),
        ("public-domain", "(?:dedicated to|released into|placed in|in) the public domain", "public domain"),
        ("wtfpl", "do what the fuck you want to public license", "licen"),
        ("proprietary", "all rights reserved", "all rights reserved"),
        ("proprietary", "(?:proprietary and confidential|unauthorized copying of this file)", "proprietary"),
    ):
        out.append((label, form, 70, keyword))
    return out


def framed(regex: str) -> str:
    return f"(?<= )(?:{regex})(?= )"


def n_words(s: Column) -> Column:
    return F.regexp_count(s, F.lit("[^ ]+"))


def places(text: Column, regex: Column, extra: list[Column]) -> Column:
    """Structs (start, end, ...) of all matches in text (words framed by spaces), in words from 0."""

    def of_both(found: Column) -> Column:
        gaps = F.split(text, regex, -1)
        width = lambda x: F.struct(n_words(x["g"]).alias("g"), F.coalesce(n_words(x["f"]), F.lit(0)).alias("f"), F.coalesce(x["f"], F.lit("")).alias("t"))
        widths = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("f")), width)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["g"]
            end = start + x["f"]
            return F.struct(end.alias("at"), F.when(x["t"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"))))).alias("out"))

        return F.transform(F.aggregate(widths, zero, step, lambda acc: acc["out"]), lambda p: F.struct(p["s"].alias("s"), (-p["e"]).alias("minus_e"), *extra))

    none = F.array().cast("array<struct<s:int,minus_e:int>>") if not extra else None
    found = let(F.regexp_extract_all(text, regex, F.lit(0)), lambda f: F.when(F.size(f) > 0, of_both(f)) if none is None else F.when(F.size(f) > 0, of_both(f)).otherwise(none))
    return found


def resolved(detections: Column) -> Column:
    """Detections (sorted by start, then longest, then highest priority) that no other one suppresses.

    First those within another one go. Then the others are taken by priority (then by start), and each stays unless it overlaps
    one that stays; so what a suppressed one overlapped is not lost with it.
    """
    kind = "array<struct<s:int,minus_e:int,minus_p:int,label:string>>"
    none = F.array().cast(kind)

    def outermost(acc: Column, d: Column) -> Column:
        more = F.struct((-d["minus_e"]).alias("m"), F.concat(acc["out"], F.array(d)).alias("out"))
        return F.when(-d["minus_e"] <= acc["m"], acc).otherwise(more)

    def strongest(kept: Column, d: Column) -> Column:
        overlaps = F.exists(kept, lambda k: (k["s"] < -d["minus_e"]) & (d["s"] < -k["minus_e"]))
        return F.when(overlaps, kept).otherwise(F.concat(kept, F.array(d)))

    def by_priority(outer: Column) -> Column:
        ranked = F.sort_array(F.transform(outer, lambda d: F.struct(d["minus_p"].alias("p"), d["s"].alias("s"), d.alias("d"))))
        return F.aggregate(F.transform(ranked, lambda r: r["d"]), none, strongest)

    return let(F.aggregate(detections, F.struct(F.lit(-1).alias("m"), none.alias("out")), outermost, lambda acc: acc["out"]), by_priority)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, base places and labels of every document.

    A null text is an empty one: no words, null first_word and last_word, empty labels, score 0. Ids may be null
    or repeat; an empty table gives no rows; other columns don't matter.
    """
    prepare(docs.sparkSession)
    every = rules()
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keywords = sorted({k for _, _, _, k in every})
    gate = f"(?:^|{NOT_WORD[:-1]})(?:" + "|".join(k.strip().replace(" ", NOT_WORD) for k in keywords if not any(o != k and k.startswith(o) for o in keywords)) + ")"
    base_regex = framed("|".join(BASE))
    lowered = F.translate(text_or_empty(text_col), upper, upper.lower())

    table = [{"k": f" {k}", "rules": [{"r": framed(r), "p": -p, "l": label} for label, r, p, key in every if key == k]} for k in keywords]
    groups = F.from_json(F.lit(json.dumps(table)), "array<struct<k:string,rules:array<struct<r:string,p:int,l:string>>>>")  # one literal

    def by_rules(text: Column) -> Column:
        called = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(text, g["k"])), lambda g: g["rules"]))
        found = F.transform(called, lambda x: places(text, x["r"], [x["p"].alias("minus_p"), x["l"].alias("label")]))
        return resolved(F.sort_array(F.flatten(F.array_compact(found))))

    def of_text(lower: Column) -> Column:
        words = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))

        def of_framed(text: Column) -> Column:
            labels = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]))
            return F.struct(places(text, F.lit(base_regex), []).alias("base"), labels.alias("labels"), by_rules(text).alias("found"))

        return F.struct(F.regexp_count(lower, F.lit(WORD)).cast("long").alias("n"), F.when(lower.rlike(gate), let(words, of_framed)).alias("x"))

    found = docs.select(F.col(id_col).alias("doc_id"), let(lowered, of_text).alias("_f"))
    x = F.col("_f")["x"]
    base = F.coalesce(F.size(x["base"]), F.lit(0))
    base = F.when(base < 0, 0).otherwise(base)
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    every_label = F.concat(x["labels"], F.transform(x["found"], lambda d: d["label"]))
    best = F.array_max(F.transform(x["found"], lambda d: -d["minus_p"]))
    return found.select(
        "doc_id",
        F.col("_f")["n"].alias("n_words"),
        base.cast("long").alias("n_base"),
        F.get(x["base"], F.lit(0))["s"].cast("long").alias("first_word"),
        F.when(base > 0, F.get(x["base"], base - 1)["s"]).cast("long").alias("last_word"),
        F.coalesce(names(x["labels"]), F.lit("")).alias("base_labels"),
        F.coalesce(names(every_label), F.lit("")).alias("labels"),
        (F.greatest(F.coalesce(best, F.lit(0)), F.when(base > 0, 40).otherwise(0)) / F.lit(100.0)).alias("score"),
    )
