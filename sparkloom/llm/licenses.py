"""License scan by ordered signature rules.

Texts are lower-cased and brought to words that each have a blank on both sides. A rule
is a regex over such text, gated by a keyword: only rules whose keyword stands in a text are
tried on it. Each match is an interval; an interval inside another one of higher
priority (or of the same priority and longer, or the same and from an earlier rule) is
suppressed, and what is left gives the labels. A text gives its matches as counts of
words, running sums over a rule's matches make places of them, and a running maximum over
a text's matches says how far those of each priority reach, so the time grows with the
text and the order of its matches. DataFrame functions only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases that always count, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A signature: a pattern of words, tried where the keyword stands, which every match must contain; priority decides overlaps, confidence the score."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float

    @property
    def regex(self) -> str:
        """The pattern over words with blanks: `a|b` is a choice, `w?` may be missing, `*` is any one word, `19*` any that begins so."""
        out = ""
        for word in self.pattern.split():
            optional, word = word.endswith("?"), word.removesuffix("?")
            word = word.replace("*", "[^ ]+")
            core = "(?:" + word + ")" if "|" in word else word
            out += f"(?: {core} )?" if optional else f" {core} "
        return out


def _rules() -> list[Rule]:
    rules: list[Rule] = []

    def add(label: str, keyword: str, *patterns: str, priority: int = 50, confidence: float = 0.9) -> None:
        rules.extend(Rule(label, keyword, p, priority, confidence) for p in patterns)

    # Named licenses: identifiers, names and how texts refer to them.
    def named(label: str, *names: str) -> None:
        for name in names:
            keyword = max((w for w in name.split() if w not in {"license", "public", "version?", "software", "common", "open", "source"}), key=len)
            add(label, keyword, f"spdx license identifier {name}", priority=90, confidence=0.99)
            add(label, keyword, f"licensed|released|distributed|available|published|provided under the? terms? of? the? {name}", priority=80, confidence=0.97)
            add(label, keyword, f"{name} license|licence", priority=60, confidence=0.9)

    named("mit", "mit")
    named("x11", "x11")
    named("isc", "isc")
    named("apache-2.0", "apache 2 0", "apache license version? 2 0")
    named("apache-1.1", "apache 1 1", "apache software license version? 1 1")
    named("apache", "apache")
    named("bsd-2-clause", "bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd")
    named("bsd-3-clause", "bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd")
    named("bsd-4-clause", "bsd 4 clause", "4 clause bsd", "original bsd")
    named("bsd", "bsd")
    named("mpl-2.0", "mpl 2 0", "mozilla public license version? 2 0")
    named("mpl-1.1", "mpl 1 1", "mozilla public license version? 1 1")
    named("epl-2.0", "epl 2 0", "eclipse public license version? 2 0")
    named("epl-1.0", "epl 1 0", "eclipse public license version? 1 0")
    named("cddl-1.0", "cddl 1 0", "common development and distribution license version? 1 0")
    named("cpl-1.0", "cpl 1 0", "common public license version? 1 0")
    named("artistic-2.0", "artistic 2 0", "artistic license 2 0")
    named("artistic-1.0", "artistic 1 0", "artistic license 1 0")
    named("zlib", "zlib")
    named("bsl-1.0", "boost software", "bsl 1 0")
    named("postgresql", "postgresql")
    named("python-2.0", "python software foundation", "psf 2 0")
    named("openssl", "openssl")
    named("wtfpl", "wtfpl")
    named("unlicense", "unlicense")
    named("ofl-1.1", "ofl 1 1", "sil open font license version? 1 1", "open font")
    named("odbl-1.0", "odbl 1 0", "open database license version? 1 0", "open data commons open database")
    named("eupl-1.2", "eupl 1 2", "european union public licence version? 1 2")
    named("cecill-2.1", "cecill 2 1", "cecill")
    named("upl-1.0", "universal permissive")
    named("ncsa", "university of illinois ncsa open source", "ncsa")
    named("afl-3.0", "academic free license version? 3 0", "academic free")
    named("ms-pl", "microsoft public")
    named("ms-rl", "microsoft reciprocal")

    # The GNU family, by version.
    for short, words in (("gpl", "gnu general public license"), ("lgpl", "gnu lesser general public license"), ("agpl", "gnu affero general public license"), ("gfdl", "gnu free documentation license")):
        for version in ("1", "1 1", "1 2", "1 3") if short == "gfdl" else ("2 1", "3") if short == "lgpl" else ("2", "3"):
            label = f"{short}-{version.replace(' ', '.')}"
            add(label, "gnu", f"{words} version|v {version}", f"{words} v{version}", priority=85, confidence=0.97)
            add(label, short, f"{short} {version}", f"{short} v{version}", f"spdx license identifier {short} {version}", priority=75, confidence=0.92)
            add(label, f"{short}v{version.split()[0]}", f"{short}v{version}", priority=75, confidence=0.92)
            add(f"{label}-or-later", short, f"{short} {version} 0? or later", priority=88, confidence=0.97)
            add(f"{label}-only", short, f"{short} {version} 0? only", priority=88, confidence=0.97)
        add(short, "gnu", f"{words}", priority=70, confidence=0.93)
    add("gpl", "general", "general public license|licence", priority=55, confidence=0.9)

    # Creative Commons: every combination of conditions and version.
    for conditions in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        short = "cc-" + conditions.replace(" ", "-")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            add(f"{short}-{version.replace(' ', '.')}", "cc", f"cc {conditions} {version}", priority=85, confidence=0.97)
            add(f"{short}-{version.replace(' ', '.')}", "creativecommons", f"creativecommons org licenses {conditions} {version}", priority=88, confidence=0.99)
        add(short, "cc", f"cc {conditions}", priority=60 + 2 * len(conditions.split()), confidence=0.9)
    for words, short in (("attribution", "by"), ("attribution sharealike", "by-sa"), ("attribution noncommercial", "by-nc"), ("attribution noderivs|noderivatives", "by-nd"), ("attribution noncommercial sharealike", "by-nc-sa"), ("attribution noncommercial noderivs|noderivatives", "by-nc-nd")):
        add(f"cc-{short}", "creative", f"creative commons {words}", f"creative commons {words} * * international|unported? license|licence", priority=70 + 2 * len(words.split()), confidence=0.95)
    add("cc0-1.0", "cc0", "cc0 1 0 universal?", "cc0", priority=70, confidence=0.93)
    add("cc", "creative", "creative commons license|licence", priority=50, confidence=0.8)

    # Notices, dedications and sentences of license texts.
    add("reserved", "reserved", "all rights reserved", priority=50, confidence=0.85)
    add("reserved", "reserved", "some rights reserved", priority=50, confidence=0.6)
    add("copyright", "copyright", "copyright c? 19*|20* *", "copyright c * *", priority=20, confidence=0.4)
    add("public-domain", "public", "released|placed|dedicated|dedicate|given to|into|in the public domain", "is in the public domain", "public domain dedication", priority=60, confidence=0.85)
    add("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", priority=95, confidence=0.99)
    add("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", priority=95, confidence=0.99)
    add("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", priority=95, confidence=0.99)
    add("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", priority=95, confidence=0.98)
    add("warranty-disclaimer", "warranty", "without warranty of any kind", priority=30, confidence=0.5)
    add("warranty-disclaimer", "warranties", "without warranties or conditions of any kind", priority=30, confidence=0.5)
    add("warranty-disclaimer", "warranty", "without any warranty", priority=30, confidence=0.5)
    add("warranty-disclaimer", "provided", "provided as is without", priority=30, confidence=0.5)
    add("proprietary", "proprietary", "proprietary and confidential", "confidential and proprietary", priority=65, confidence=0.9)
    add("proprietary", "permission", "may not be reproduced without permission", priority=60, confidence=0.85)
    add("proprietary", "reproduced", "no part of this * may be reproduced", priority=60, confidence=0.85)
    add("proprietary", "permission", "reproduction without permission is prohibited", priority=60, confidence=0.85)
    add("proprietary", "commercial", "not for commercial use", "non commercial use only", priority=55, confidence=0.7)
    add("proprietary", "personal", "for personal use only", priority=55, confidence=0.7)
    add("all-purpose", "details", "see the? license|licence file? for details", priority=10, confidence=0.3)
    add("all-purpose", "licensed", "licensed under", priority=10, confidence=0.3)
    return rules


RULES = _rules()
#: The base phrases as rules of their own: they are counted wherever they stand.
BASE_RULES = [Rule(label, max(phrase.split(), key=len), phrase, 0, 0.8) for phrase, label in BASE.items()]


def normalised(text: Column) -> Column:
    """Each word with a blank on both sides: ` a  b  c `. Lower-cases A-Z only; empty without words."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(low, _NON_WORD, " "))


def _words(spaced: Column) -> Column:
    """Number of words in text where each has a blank on both sides."""
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


class LicenseScan:
    """Licenses, with their places, in whole texts.

    Null and empty texts have no words and no matches. Texts of any length, repeated rows
    and ties are scanned as they are; a null doc_id keeps its row. A text's matches, not
    the text, meet in one task and one row. Empty tables give no rows; further columns are ignored.
    """

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = RULES if rules is None else rules

    def _places(self, t: Column, gated: Column) -> Column:
        """Matches of all gated rules in t: of each, the words since the rule's match before and the words of the match. One pass over t for each rule."""

        def places(rule: Column) -> Column:
            hits = F.regexp_extract_all(t, rule["regex"], F.lit(0))
            pairs = F.arrays_zip(F.slice(F.split(t, rule["regex"], -1), F.lit(1), F.size(hits)).alias("piece"), hits.alias("hit"))
            return F.transform(pairs, lambda x, k: F.struct(k.alias("nth"), *[rule[c].alias(c) for c in ("rule", "label", "priority", "confidence", "base")], _words(x["piece"]).alias("gap"), _words(x["hit"]).alias("size")))

        return F.flatten(F.transform(gated, places))

    def _judged(self, matches: DataFrame) -> DataFrame:
        """Adds to matches, dealt by text: first and last word, and whether another match holds this one.

        In order of start and then from the longest down, whatever holds a match comes before
        it, so a match goes if one of its priority or a higher one before it reached its end.
        Base phrases hold nothing and are not held.
        """
        of_rule = Window.partitionBy("row", "rule").orderBy("nth")
        first = F.sum(F.col("gap") + F.col("size")).over(of_rule) - F.col("size")
        placed = matches.withColumn("first_word", first).withColumn("last_word", F.col("first_word") + F.col("size") - 1)
        before = Window.partitionBy("row").orderBy("first_word", F.desc("last_word"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
        reach = F.lit(None).cast("long")
        for p in sorted({r.priority for r in self.rules}):
            reach = F.when(F.col("priority") == p, F.max(F.when(~F.col("base") & (F.col("priority") >= p), F.col("last_word"))).over(before)).otherwise(reach)
        return placed.withColumn("left", ~F.col("base") & ~F.coalesce(reach >= F.col("last_word"), F.lit(False)))

    def run(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_words, n_base, first_word, last_word, base_labels, found, labels, score).

        base_labels and labels are sorted arrays; found has the places left after suppression,
        by start: rule label, priority, confidence, first and last word.
        """
        own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"))
        own = own.withColumn("t", F.when(F.col("t") == "", "").otherwise(F.concat(F.lit(" "), F.replace("t", F.lit(" "), F.lit("  ")), F.lit(" "))))
        t, rules = F.col("t"), [*((r, True) for r in BASE_RULES), *((r, False) for r in self.rules)]

        # Constants in one literal each, which the optimiser reads once.
        table = [{"rule": k, "keyword": r.keyword, "regex": r.regex, "label": r.label, "priority": r.priority, "confidence": r.confidence, "base": base} for k, (r, base) in enumerate(rules)]
        wanted = F.from_json(F.lit(json.dumps(table)), "array<struct<rule:int,keyword:string,regex:string,label:string,priority:int,confidence:double,base:boolean>>")
        keywords = F.from_json(F.lit(json.dumps(sorted({r.keyword for r, _ in rules}))), "array<string>")
        own = own.withColumn("present", F.array_intersect(F.split(F.trim(t), "  "), keywords))
        gated = F.filter(wanted, lambda r: F.array_contains("present", r["keyword"]))
        places = F.when(F.size("present") > 0, self._places(t, gated))
        # Texts stay behind; a text without matches is one row.
        matches = own.select("row", "doc_id", _words(t).alias("n_words"), places.alias("places")).select("row", "doc_id", "n_words", F.explode_outer("places").alias("m")).select("row", "doc_id", "n_words", "m.*")
        judged = self._judged(matches.repartition("row"))

        base, left = F.coalesce("base", F.lit(False)), F.coalesce("left", F.lit(False))
        place = F.struct("first_word", "last_word", "label", "priority", "confidence")
        out = judged.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
            F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_list(F.when(left, place))).alias("found"), F.array_sort(F.collect_set(F.when(base | left, F.col("label")))).alias("labels"),
        )
        doubt = F.aggregate("found", F.when(F.col("n_base") > 0, F.lit(0.2)).otherwise(F.lit(1.0)), lambda p, m: p * (1 - m["confidence"]))
        return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "found", "labels", (1 - doubt).alias("score"))
