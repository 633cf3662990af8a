"""Operators on texts against brute force, with odd rows, clashing column names and empty tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import queries
from sparkloom.llm.decontamination import Decontamination
from sparkloom.llm.licenses import BASE, RULES, LicenseScan
from sparkloom.llm.ngram_join import NgramJaccardJoin
from sparkloom.llm.recompression import SubstringDedup, plan_rounds, recompress, spell
from tests.llm import helpers as H

CLASH = {"node": "1", "chunk": "'x'", "_part": "cast(null as string)", "size": "2.5", "t": "'t'", "score": "true"}


@pytest.fixture(scope="module")
def docs(spark):
    return H.corpus()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns({k: F.expr(v) for k, v in CLASH.items()}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(frame, docs, n, percent):
    sets = {i: H.shingles(t, n) for i, t in docs}
    want = H.components(sets, percent, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in NgramJaccardJoin(n, percent).run(frame).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_links_are_exact(frame, docs):
    join = NgramJaccardJoin(4, 85)
    sets = {i: H.shingles(t, 4) for i, t in docs}
    links = join.links(frame, join.rows(frame, join.signatures(frame))).collect()
    assert links
    for r in links:
        a, b = sets[r["a"]], sets[r["b"]]
        assert (r["overlap"], r["n_union"]) == (len(a & b), len(a | b)) and r["overlap"] * 100 >= 85 * r["n_union"]


def test_jaccard_of_long_and_short_sets(spark):
    """Sets of unlike size, so that their column blocks fold, with links on both sides of the bound."""
    rng = random.Random(11)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 90, 105, 400, 1500]))]
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**9), " ".join(words[rng.randrange(1 + len(words) // 15) :])))
    sets = {i: H.shingles(t, 4) for i, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in NgramJaccardJoin(4, 85).run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == H.components(sets, 85, 100) and 60 < len(set(got.values())) < 240


def test_jaccard_of_shared_passages(spark):
    """Documents of common passages: many columns with the same rows, few links."""
    rng = random.Random(4)
    passages = [H.prose(rng, 40, 10**6) for _ in range(12)]
    rows = [(k, " ".join(rng.sample(passages, 4))) for k in range(300)]
    sets = {i: H.shingles(t, 4) for i, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in NgramJaccardJoin(4, 85).run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == H.components(sets, 85, 100)


THUE = ["ab", "ba"]
for _ in range(11):
    THUE = [THUE[0] + THUE[1], THUE[1] + THUE[0]]


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words are told apart, by their letters and by their words."""
    common = [f"w{k}" for k in range(19)]
    letters = [(1, " ".join([*common, THUE[0]])), (2, " ".join([*common, THUE[1]]))]
    words = [(3, " ".join(THUE[0])), (4, " ".join(THUE[1]))]
    for rows in (letters, words):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in SubstringDedup(20).run(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
        assert got == H.repeats(rows, 20)
    whole = [(1, THUE[0]), (2, THUE[1])]
    assert {r["doc_id"]: r["component_id"] for r in NgramJaccardJoin(4, 85).run(spark.createDataFrame(whole, "doc_id long, text string")).collect()} == {1: 1, 2: 2}


def test_jaccard_odd_tables(spark, empty):
    assert NgramJaccardJoin().run(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in NgramJaccardJoin().run(rows).collect() if r["doc_id"] is not None)
    assert got == [(False, 3, 3), (False, 7, 7), (False, 7, 7)]
    versions = [(7, "a b c d e f"), (7, "one text of another kind"), (9, "one text of another kind"), (8, "no link to any of these"), (7, "")]
    assert sorted((r["doc_id"], r["component_id"]) for r in NgramJaccardJoin().run(spark.createDataFrame(versions, "doc_id long, text string")).collect()) == [(7, 7), (7, 7), (7, 7), (8, 8), (9, 7)]


@pytest.mark.parametrize("window", [1, 5, 20, 50])
def test_repeats(frame, docs, window):
    want = H.repeats(docs, window)
    rows = SubstringDedup(window).run(frame, with_text=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in rows} == want
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest() for r in rows)


def test_repeats_windows_are_spelled_alike_wherever_they_stand():
    """Names of windows agree exactly where their words do, in texts with long runs and periods."""
    import pyarrow as pa

    from sparkloom.llm import kernels as K

    rng = random.Random(8)
    for window in (1, 2, 5, 8, 20, 33):
        texts = [" ".join(rng.choice("ab" if k % 3 else "abcdefgh") * (1 if k % 2 else 1) for _ in range(rng.randrange(0, 150))) for k in range(40)] + ["a " * 90, "a b " * 60, "b a a " * 30]
        names, words = {}, {}
        for row, w in K.steps(pa.array(texts), K.BLANK_WORD, K.IDENTITY, 700):
            rounds, top = recompress(w.name, w.doc, plan_rounds(window))
            own = [x for t in texts[row : row + len(w.counts)] for x in t.split()]
            at = [k for k in range(len(own) - window + 1) if w.doc[k] == w.doc[k + window - 1]]
            if at:
                low, high = spell(rounds, top, np.array(at), np.array(at) + window)
                for k, name in zip(at, zip(low.tolist(), high.tolist())):
                    key = tuple(own[k : k + window])
                    assert names.setdefault(name, key) == key and words.setdefault(key, name) == name


def test_repeats_many_periodic_texts(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["a", "b"] if k % 2 else ["a"]) for _ in range(rng.randrange(10, 120)))) for k in range(60)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in SubstringDedup(20).run(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got == H.repeats(rows, 20)


def test_repeats_odd_tables(spark, empty):
    assert SubstringDedup().run(empty).count() == 0
    words = " ".join(map(str, range(30)))
    same = spark.createDataFrame([(1, words), (1, words), (None, words), (2, words)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = sorted((str(r["doc_id"]), r["n_removed"], r["lang"]) for r in SubstringDedup(20).run(same, carry=("lang",)).collect())
    assert got == [("1", 0, "en"), ("1", 0, "en"), ("2", 30, "en"), ("None", 30, "en")]


def test_leaks(spark, frame, docs):
    texts = [t for _, t in docs if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[3].split()[5:25])), (22, texts[-1].upper()), (3, "one two"), (4, None), (5, ""), (13, "one two"), (6, "nowhere to be found at all in any of these long texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = H.leaks(docs, items, 10)
    rows = Decontamination(10).run(frame, bench).collect()
    assert {r["doc_id"]: (r["n_words"], sum(s["last_word"] - s["first_word"] + 1 for s in r["spans"]), r["items"]) for r in rows} == want
    text = dict(docs)
    for r in rows:  # offsets point at the words in the original
        for s in r["spans"]:
            part = text[r["doc_id"]].encode()[s["start"] : s["end"]].decode()
            assert len(H.ALNUM.findall(H.lower(part))) == s["last_word"] - s["first_word"] + 1


def test_leaks_in_rounds(spark, frame, docs, monkeypatch):
    from sparkloom.llm import decontamination

    items = [(k, " ".join(t.split()[:15])) for k, (_, t) in enumerate(docs) if t]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = H.leaks(docs, items, 10)
    monkeypatch.setattr(decontamination, "ROUND_NODES", 2000)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 4)
    rows = Decontamination(10).run(frame, bench).collect()
    assert {r["doc_id"]: (r["n_words"], sum(s["last_word"] - s["first_word"] + 1 for s in r["spans"]), r["items"]) for r in rows} == want


def test_leaks_of_a_benchmark_with_very_many_words():
    """More distinct words than there are characters."""
    from sparkloom.llm.decontamination import Automaton

    n = 1_150_000
    machine = Automaton([(k, f"q{k}") for k in range(n)] + [(n, "one two three four")], 3)
    assert machine.scan([b"q7", b"x", f"q{n - 1}".encode(), b"two", b"three", b"four"]) == ([(0, 1), (2, 6)], {7, n - 1, n})


def test_leaks_odd_tables(spark, empty, frame, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert Decontamination().run(empty, bench).count() == 0
    assert all(not r["spans"] for r in Decontamination().run(frame, bench).collect())


def test_license_base_phrases(spark, docs):
    rng = random.Random(9)
    rows = list(docs) + [(20000 + k, f"{H.prose(rng, k)} CC-BY, {H.prose(rng, 3)} General\nPublic  License cc by cc by; ALL rights reserved") for k in range(5)] + [(30000, "accc by bycc byx"), (30001, "cc by"), (30002, "écc by")]
    got = {r["doc_id"]: r for r in LicenseScan().run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = H.ALNUM.findall(H.lower(text))
        starts = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(starts))
        assert (r["first_word"], r["last_word"]) == ((min(starts)[0], max(starts)[0]) if starts else (None, None))
        assert r["base_labels"] == sorted({x for _, x in starts})
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1


def test_license_overlaps(spark, empty):
    assert LicenseScan().run(empty).count() == 0 and len(RULES) > 200
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "text is CC BY-NC-SA 4.0"), (3, "SPDX-License-Identifier: MIT"), (4, "GPL-3.0-or-later"), (5, "no notice")]
    got = {r["doc_id"]: r["labels"] for r in LicenseScan().run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["apache-2.0"], 2: ["cc-by", "cc-by-nc-sa-4.0"], 3: ["mit"], 4: ["gpl-3-or-later"], 5: []}


def test_license_keywords_lose_no_match(spark):
    for r in RULES:
        assert r.keyword in {w for w in r.pattern.split() if not w.endswith("?") and "|" not in w and "*" not in w}, r
    rows = [
        (1, "distributed on an as is basis, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"), (2, "No part of this book may be reproduced"), (3, "For personal use only."), (4, "see the LICENCE file for details"),
        (5, "Licensed under terms below"), (6, "see license for details"), (7, "warranties reproduced personal details licensed"),
    ]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 6)) for r in LicenseScan().run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (["warranty-disclaimer"], 0.5), 2: (["proprietary"], 0.85), 3: (["proprietary"], 0.7), 4: (["all-purpose"], 0.3), 5: (["all-purpose"], 0.3), 6: (["all-purpose"], 0.3), 7: ([], 0.0)}


def test_queries_have_contract_columns():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


def suppressed(text, rules):
    """Places of rules in a text, read one by one, without those that another one beats."""
    import re

    words = H.ALNUM.findall(H.lower(text))
    spaced = "".join(f" {w} " for w in words)
    found = [(m.start(), m.end(), k, r) for k, r in enumerate(rules) if r.keyword in words for m in re.finditer(r.regex, spaced)]
    beats = lambda o, m: o[0] <= m[0] and o[1] >= m[1] and (o[3].priority > m[3].priority or (o[3].priority == m[3].priority and (o[1] - o[0] > m[1] - m[0] or (o[:2] == m[:2] and o[2] < m[2]))))
    left = [m for m in found if not any(beats(o, m) for o in found)]
    at = lambda x: spaced[:x].count(" ") // 2
    return sorted((at(a), at(b) - 1, r.label, r.priority, r.confidence) for a, b, _, r in left)


def test_license_suppression_against_all_pairs(spark):
    """Texts of fragments of notices, with many overlaps, and every rule's own pattern."""
    rng = random.Random(21)
    parts = sorted({r.pattern.replace("?", "").replace("*", "any") for r in RULES})
    plain = [" ".join(w.split("|")[0] for w in p.split()) for p in parts]
    bits = plain + ["gnu general public license version 2 or later", "cc by nc sa 4 0", "all rights reserved", "mit", "license", "the", "under", "é"]
    rows = [(k, "; ".join(rng.choices(bits, k=rng.randrange(0, 14)))) for k in range(120)] + [(1000 + k, p) for k, p in enumerate(plain)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"left": F.lit(1), "every": F.lit("x"), "present": F.lit(True), "base": F.lit(None).cast("int")}).repartition(4)
    got = {r["doc_id"]: [tuple(x) for x in r["found"]] for r in LicenseScan().run(df).collect()}
    for i, text in rows:
        assert got[i] == suppressed(text, RULES), (i, text)


def test_license_long_text_of_notices(spark):
    """A text of a megabyte with tens of thousands of matches; twice the text takes about twice the time."""
    import time

    notice, took = "Licensed under the Apache License, Version 2.0. GPL-3.0-or-later. CC BY-SA 4.0; all rights reserved. ", {}
    for n in (100, 5000, 10000):
        rows = spark.createDataFrame([(1, notice * n)], "doc_id long, text string")
        began = time.perf_counter()
        r = LicenseScan().run(rows).first()
        took[n] = time.perf_counter() - began
        assert (r["n_words"], r["n_base"], r["last_word"]) == (n * 21, 2 * n, n * 21 - 3) and r["labels"] == ["apache-2.0", "cc-by", "cc-by-sa-4.0", "gpl-3-or-later", "reserved"] and len(r["found"]) == n * 4
    print(took)
    assert took[10000] < 25 and took[10000] - took[100] < 3 * max(took[5000] - took[100], 1.0), took


def test_queries_of_text_operators_on_small_tables(spark, tmp_path, docs):
    """Each opN_ query on a fixture, with the columns and types of its contract."""
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{tmp_path}/documents.parquet")
    item = [t for _, t in docs if t and len(t.split()) > 30][2]
    spark.createDataFrame([(5, item), (44, item.upper()), (6, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path))

    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run("op4_recompression").collect()}
    assert got == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in H.repeats(docs, 20).items()}

    out = run("op7_aho_corasick_decontamination")
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {i: (n, hit, len(who), hashlib.sha256(",".join(who).encode()).hexdigest(), hit > 0) for i, (n, hit, who) in H.leaks(docs, [(5, item), (44, item)], 10).items()}

    out = run("op10_ngram_jaccard_join")
    sets = {i: H.shingles(t, 4) for i, t in docs}
    want = H.components(sets, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == {i: (len(sets[i]), want[i]) for i in sets}

    out = run("op8_license_signatures")
    assert [c for c, _ in out.dtypes] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and out.count() == len(docs)

    out = run("op5_hilbert_sharding").toPandas()
    assert set(out.columns) >= {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} and set(out["shard"]) == set(range(40)) and (out["law"] == "rows").all()


def test_components_of_chains_stars_and_cliques(spark):
    from sparkloom.llm.components import connected_components

    rng = random.Random(17)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, 501 + k) for k in range(80)] + [(900 - k, 700) for k in range(50)] + [(a, b) for a in range(1000, 1012) for b in range(1000, a)] + [(160, 130), (3, 3), (None, 4), (5, None), (7, 6), (6, 7)]
    rng.shuffle(links)
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "x long, y long").repartition(4), "x", "y").collect()}
    want = {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 581)} | {700: 700} | {900 - k: 700 for k in range(50)} | {k: 1000 for k in range(1000, 1012)} | {6: 6, 7: 6}
    assert got == want
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
