r"""Operator 4: license scans by ordered signature rules, in DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased; a text is matched as its words between
single blanks. Rules are regexes over that form, each a literal of its own, so that a task compiles it once. A keyword prefilter goes
first: a text without any keyword is not kept for the rules, and a rule is tried only on texts that hold its own keyword. The prefilter is
made of the keywords of all rules; plain searches for their first words spare most texts its regex. Detections are word intervals; one
that lies within another of higher priority (or of the same priority, if longer or of an earlier rule) is suppressed.

Base phrases are rules too, but their places are reported as they are, suppressed or not.

Null text counts as empty: no words, no labels, score 0. Rows are kept one by one, repeated rows and ids included; other columns
are kept, those named as the outputs are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.common import cut

#: Characters of a word, and what stands between words once A-Z are lower-cased.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, keyword (whole words, one of which every match holds), and a pattern for the license's name in words; versions follow as words of their own.
NAMES = (
    ("apache-1.1", "apache", "apache (?:software )?licen[cs]e(?: version)? 1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?"),
    ("mit", "mit", "mit(?: x11)?(?: licen[cs]e)?"),
    ("x11", "x11", "x11(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd|freebsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd(?: style)?(?: licen[cs]e)?"),
    ("isc", "isc", "isc(?: licen[cs]e)?"),
    ("zlib", "zlib", "zlib(?: libpng)?(?: licen[cs]e)?"),
    ("gpl-2.0", "gpl|general", "(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl|general", "(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?"),
    ("gpl", "gpl|general", "(?:gnu )?(?:gpl|general public licen[cs]e)"),
    ("lgpl-2.1", "lgpl|lesser", "(?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?v?2 1"),
    ("lgpl-3.0", "lgpl|lesser", "(?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?"),
    ("lgpl", "lgpl|lesser|library", "(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)"),
    ("agpl-3.0", "agpl|affero", "(?:gnu )?(?:agpl|affero general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?"),
    ("agpl", "agpl|affero", "(?:gnu )?(?:agpl|affero general public licen[cs]e)"),
    ("gfdl", "gfdl|free documentation", "(?:gnu )?(?:gfdl|free documentation licen[cs]e)"),
    ("mpl-1.1", "mozilla|mpl", "(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?1 1"),
    ("mpl-2.0", "mozilla|mpl", "(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", "eclipse|epl", "(?:epl|eclipse public licen[cs]e)(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse|epl", "(?:epl|eclipse public licen[cs]e)(?: version| v)? ?2(?: 0)?"),
    ("cddl", "cddl|common development", "(?:cddl|common development and distribution licen[cs]e)"),
    ("artistic", "artistic", "artistic licen[cs]e(?: 2(?: 0)?)?"),
    ("boost", "boost", "boost software licen[cs]e(?: version)?(?: 1(?: 0)?)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("python", "python|psf", "(?:psf|python software foundation) licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("sil-ofl", "ofl|open font", "(?:ofl|sil open font licen[cs]e|open font licen[cs]e)(?: version)?(?: 1 1)?"),
    ("eupl", "eupl|european union", "(?:eupl|european union public licen[cs]e)"),
    ("odbl", "odbl|open database", "(?:odbl|open database licen[cs]e)"),
    ("ogl", "open government", "open government licen[cs]e"),
    ("cc0", "cc0|creative", "(?:cc0|creative commons zero)(?: 1 0)?"),
    ("cc-by", "cc|creative", "(?:cc|creative commons) (?:by|attribution)(?: [1-4] [05])?"),
    ("cc-by-sa", "cc|creative", "(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nd", "cc|creative", "(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("cc-by-nc", "cc|creative", "(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc|creative", "(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc|creative", "(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("public-domain", "public domain", "public domain"),
)
#: How a license is named: key, priority, confidence, pattern around the name.
FORMS = (
    ("tag", 4, 0.99, "spdx license identifier {name}"),
    ("grant", 3, 0.95, "(?:is |are )?(?:licen[cs]ed|released|distributed|published|available|made available|provided|redistributed)(?: only)? under(?: the)?(?: terms of)?(?: the)? {name}"),
    ("terms", 3, 0.9, "(?:under|subject to|in accordance with) the terms(?: and conditions)? of the {name}"),
    ("see", 2, 0.8, "(?:see|read|refer to|covered by|governed by|use of this (?:software|source code|work) is governed by)(?: the| a)? {name}"),
    ("header", 2, 0.75, "licen[cs]e {name}"),
    ("name", 1, 0.6, "{name}"),
)
#: Rules that name no license of their own: label, keyword, pattern, priority, confidence.
PHRASES = (
    ("reserved", "reserved", "(?:all|no|some) rights reserved", 1, 0.5),
    ("copyright", "copyright", "copyright(?: c)?(?: [12][0-9]{3})+", 1, 0.5),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 3, 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 3, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 3, 0.9),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it", 3, 0.9),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)", 2, 0.8),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|distribution)", 2, 0.7),
)
#: Names that are also plain words; alone they say nothing.
NEEDS_FORM = ("mit", "isc", "x11", "bsd")
#: Of these, those in so many texts that their keyword takes in the word that a form has before the name.
COMMON = ("mit", "isc", "x11")
BEFORE = "under|of|the|see|read|to|by|a|licen[cs]e|identifier"
#: A version may follow a keyword without a blank.
VERSION = "(?:v?[0-9])?"


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    base: bool = False


def signature_rules() -> list[Rule]:
    """Base phrases, then every license name in every form, then phrases without a name; earlier rules win ties."""
    found = [(label, max(phrase.split(), key=len), phrase, 0, 0.7, True) for phrase, label in BASE.items()]
    for key, priority, confidence, around in FORMS:
        for label, keyword, name in NAMES:
            if key == "name" and label in NEEDS_FORM:
                name = name.removesuffix("(?: licen[cs]e)?") + " licen[cs]e"
            if label in COMMON:
                keyword = name if key == "name" else f"(?:{BEFORE}) {keyword}"
            found.append((label, keyword, around.format(name=f"(?:{name})"), priority, confidence, False))
    found += [(label, keyword, pattern, priority, confidence, False) for label, keyword, pattern, priority, confidence in PHRASES]
    return [Rule(i, label, keyword, f" (?:{pattern})(?= )", priority, confidence, base) for i, (label, keyword, pattern, priority, confidence, base) in enumerate(found)]


RULES = signature_rules()
#: One scan that most texts fail: the keywords of all rules as whole words of a text with A-Z lower-cased.
PREFILTER = rf"(?<!{ANY_WORD[:-1]})(?:{'|'.join(sorted({r.keyword for r in RULES}))}){VERSION}(?!{ANY_WORD[:-1]})".replace(" ", BETWEEN)


def heads(keyword: str) -> list[str]:
    """What each alternative of a keyword starts with, as plain words; a text with the keyword holds one of them after a blank."""
    return [re.match("[a-z0-9]+(?: [a-z]+)*", part).group() for part in keyword.removeprefix(f"(?:{BEFORE}) ").split("|")]


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalised(text: Column) -> Column:
    """' word word ... word ' with A-Z lower-cased; ' ' for a text without words."""
    return F.regexp_replace(F.concat(F.lit(" "), lowered(text), F.lit(" ")), BETWEEN, " ")


def _holds(norm: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(norm, F.lit(f" {word}"))
    return found


def may_match(norm: Column) -> Column:
    """Whether a normalised text holds the keyword of any rule."""
    return _holds(norm, sorted({h for r in RULES for h in heads(r.keyword)})) & F.rlike(norm, F.lit(PREFILTER))


def _tried(norm: Column) -> Column:
    """Numbers of the rules whose keyword a normalised text holds."""
    by_keyword: dict[str, list[int]] = {}
    for r in RULES:
        by_keyword.setdefault(r.keyword, []).append(r.number)
    none = F.array().cast("array<int>")
    return F.concat(*[F.when(_holds(norm, heads(k)) & F.rlike(norm, F.lit(f" (?:{k}){VERSION} ")), F.array(*map(F.lit, numbers))).otherwise(none) for k, numbers in by_keyword.items()])


def _pattern() -> Column:
    """The pattern of the rule that column `rule` numbers: a look-up in one constant, as a branch for each rule would be beyond what Spark compiles."""
    return F.get(F.array(*[F.lit(r.pattern) for r in RULES]), F.col("rule"))


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def detections(texts: DataFrame) -> DataFrame:
    """(uid, norm) -> uid, label, priority, confidence, base, rule, start and stop (words, stop exclusive), kept (not suppressed)."""
    tried = texts.select("uid", "norm", F.explode(_tried(F.col("norm"))).alias("rule"))
    hits = tried.withColumn("pattern", _pattern()).withColumn("hits", F.regexp_extract_all("norm", F.col("pattern"), F.lit(0))).where(F.size("hits") > 0)
    gaps = F.transform(F.split("norm", F.col("pattern"), F.lit(-1)), _blanks)
    found = hits.select("uid", "rule", gaps.alias("gaps"), F.transform("hits", _blanks).alias("widths"))
    # words before hit i: the blanks before it, which are those of gaps 0..i and of hits 0..i-1
    places = F.aggregate(
        F.sequence(F.lit(0), F.size("widths") - 1),
        F.struct(F.array().cast("array<struct<start:int,stop:int>>").alias("out"), F.lit(0).alias("at")),
        lambda acc, i: F.struct(
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.get("gaps", i)).alias("start"), (acc["at"] + F.get("gaps", i) + F.get("widths", i)).alias("stop")))).alias("out"),
            (acc["at"] + F.get("gaps", i) + F.get("widths", i)).alias("at"),
        ),
        lambda acc: acc["out"],
    )
    told = F.struct(F.lit("").alias("label"), F.lit(0).alias("priority"), F.lit(0.0).alias("confidence"), F.lit(False).alias("base"))
    about = F.coalesce(F.get(F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(r.base).alias("base")) for r in RULES]), F.col("rule")), told)
    spans = found.select("uid", "rule", about.alias("about"), F.explode(places).alias("p")).select("uid", "rule", "about.*", "p.start", "p.stop")
    earlier = Window.partitionBy("uid").orderBy("start", F.desc("stop"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for level in sorted({r.priority for r in RULES}):
        reach = F.max(F.when(F.col("priority") >= level, F.col("stop"))).over(earlier)
        inside = inside | ((F.col("priority") == level) & F.coalesce(reach >= F.col("stop"), F.lit(False)))
    return spans.withColumn("kept", ~inside)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double)."""
    outputs = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [c for c in docs.columns if c not in (text_col, *outputs)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    spaced = docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in kept], normalised(text).alias("norm"))
    # the rest of the plan reads this twice, so it is written once; only texts past the prefilter are in it
    norm = F.when(may_match(F.col("norm")), F.col("norm"))
    n_words = (_blanks(F.col("norm")) - 1).cast("long")
    rows = cut(spaced.select(F.monotonically_increasing_id().alias("uid"), *[F.col(f"`k_{c}`") for c in kept], n_words.alias("n_words"), norm.alias("norm")))
    found = detections(rows.where(F.col("norm").isNotNull()).select("uid", "norm"))
    base, own = F.col("base"), F.col("kept") | F.col("base")
    summed = found.groupBy("uid").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(own, F.col("label")))), ",").alias("labels"),
        F.max(F.when(own, F.col("confidence"))).alias("score"),
    )
    out = rows.drop("norm").join(summed, "uid", "left")
    return out.select(
        *[F.col(f"`k_{c}`").alias(c) for c in kept],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
