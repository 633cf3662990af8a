"""Ranked search, hard negatives and chat formatting against brute force."""

import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, hard_negatives, lexical_search, queries
from sparkloom.llm.chat_format import ChatFormat, Layout, signature
from sparkloom.llm.hard_negatives import HardNegatives, strassen
from sparkloom.llm.lexical_search import RankedSearch
from tests.llm import helpers as H


def ranked(docs, items, k):
    found = [(i, Counter(H.ALNUM.findall(H.lower(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(found, sizes):
            score = 0
            for t in set(H.ALNUM.findall(H.lower(text))) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def search_input():
    rng = random.Random(8)
    docs = H.corpus()
    docs += [(None, docs[-5][1]), (None, "one two"), *[(20000 + k, "one two three w1 w2 w3") for k in range(40)], docs[20], docs[20]]
    items = [(k, H.prose(rng, rng.randrange(1, 40))) for k in range(12)]
    items += [(100, "One TWO unheard"), (101, None), (102, ""), (103, "- -"), (104, "the a b c"), (105, docs[10][1]), (105, "Großes à"), (None, "one two"), (106, items[0][1]), (107, "unheard-of")]
    return docs, items


@pytest.mark.parametrize(("k", "share"), [(10, 16), (1, 1), (3, 1000)])
def test_search(spark, k, share):
    docs, items = search_input()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "terms": F.lit(1)}).repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit("x"), "score": F.lit(0.5)})
    got = RankedSearch(k, share).run(df, bench)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(docs, items, k)


def test_search_in_rounds_and_odd_tables(spark, monkeypatch):
    docs, items = search_input()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "ROUND_TERMS", 100)
    assert sorted((tuple(r) for r in RankedSearch(10).run(df, bench).collect()), key=repr) == ranked(docs, items, 10)
    for d, b in ((df.limit(0), bench), (df, bench.limit(0)), (df.where("text = ''"), bench), (df, bench.where("text is null"))):
        assert RankedSearch().run(d, b).count() == 0


def test_search_prunes_without_loss():
    """What a bucket returns are all rows that reach the score, whatever the bound."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        rows, terms = int(rng.integers(1, 60)), 25
        dense = np.where(rng.random((rows, terms)) < 0.3, rng.integers(1, 10**9, (rows, terms)), 0)
        dense = dense[np.argsort(-np.linalg.norm(dense.astype(float), axis=1), kind="stable")]
        row, term = np.nonzero(dense)
        bucket = lexical_search.Bucket(np.linalg.norm(dense.astype(float), axis=1) * lexical_search.ABOVE, term, dense[row, term], np.searchsorted(row, np.arange(rows + 1)))
        query = rng.permutation(terms + 3)[: rng.integers(1, 20)]
        truth = dense[:, query[query < terms]].sum(axis=1)
        for least in (0, 1, int(np.median(truth)), int(truth.max()), int(truth.max()) + 1):
            got, scores = bucket.search(query, least)
            assert list(got) == list(np.flatnonzero(truth >= max(least, 1)))
            assert all(scores[r] == truth[r] for r in got)


def test_strassen():
    rng = np.random.default_rng(3)
    for m, k, n in ((1, 1, 1), (3, 70, 5), (33, 31, 67), (64, 64, 64), (9, 200, 130)):
        a, b = rng.integers(-(1 << 24), 1 << 24, (m, k)), rng.integers(-(1 << 24), 1 << 24, (k, n))
        for leaf in (1, 3, 16):
            assert (strassen(a, b, leaf) == a @ b).all()


def vectors():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(9, 12))
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in base[rng.integers(0, 9)] + rng.normal(size=12) * 0.4]) for i in rng.choice(900, 260, replace=False)]
    rows += [(1000 + k, k % 3, rows[0][2]) for k in range(60)] + [(1100, 1, rows[0][2]), (1200, 2, rows[5][2])]
    rows += [(1300, None, rows[0][2]), (1400, 1, None), (1500, 1, []), (1600, 1, [float("nan")] * 12), (1601, 1, [None] + [1.0] * 11), (1602, 1, [float("inf")] * 12), (None, 1, rows[0][2]), (1700, 1, [1e300] * 12), (1800, 1, [0.0] * 12)]
    rows += [(1900, 1, [1.0, 2.0]), (1901, 1, [1.0, 2.5]), (1902, 2, [1.0, 1.0]), (1902, 2, [1.0, 1.0]), (1900, 1, [1.0, 2.0]), (1900, 1, [3.0, 1.0])]
    return rows


def mined(rows, positives, negatives):
    good = [(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if i is not None and y is not None and v and None not in v and all(map(math.isfinite, v)) and len(v) * max(abs(math.floor(256 * x)) for x in v) ** 2 <= 2**56]
    out = []
    for i, y, v in sorted({r for r in good if r[0] % 100 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, u)), j, z) for j, z, u in good if j != i and len(u) == len(v))
        for s, j in [(s, j) for s, j, z in scored if z == y][:positives]:
            ok = [(t, m) for t, m, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(ok, 1)]
    return sorted(out)


@pytest.mark.parametrize(("kind", "cells"), [("double", 1 << 20), ("double", 24)])
def test_hard_negatives(spark, monkeypatch, kind, cells):
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", cells)  # 24: several blocks
    rows = vectors()
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumns({"score": F.lit("x"), "key": F.lit(0), "v": F.lit(1)}).repartition(4)
    got = HardNegatives(5, 10).run(df, F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 5, 10)
    assert mined(rows, 5, 10)


def test_hard_negatives_of_odd_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(100, 1, [1.0])], [(100, 1, None)], [(1, 1, [1.0]), (2, 1, [1.0])], [(100, 1, [1.0]), (1, 2, [0.5])]):
        assert HardNegatives().run(spark.createDataFrame(rows, kind), F.col("vec_id") % 100 == 0).count() == 0
    zero = spark.createDataFrame([(100, 1, [0.0]), (1, 1, [1.0]), (3, 2, [7.0]), (2, 2, [5.0])], kind)  # a positive of score 0 takes negatives of score 0
    assert [r["negative_id"] for r in HardNegatives().run(zero, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [2, 3]


def test_heaps_keep_the_first_of_ties():
    heaps = hard_negatives.Heaps(3)
    for part in (range(50, 100), range(0, 50)):
        heaps.add(7, np.array([5] * 50, np.int64), np.array(list(part), np.int64))
    assert list(heaps.kept[7][1]) == [0, 1, 2] and heaps.least(7) == 5 and heaps.least(8) is None


CONTROL = ["<|start|>", "<|text|>", "<|end|>", "<|im_start|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\|end|>", "<\\\\/s>", "[\\INST]", "<", "[", "\\", "|", "|>", "<|", "<|end", "s>", "\n", "é", "日本", "a", " "]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choice(CONTROL) for _ in range(rng.randrange(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("safe", chat_format.escape(F.col("text"))).withColumn("back", chat_format.unescape(F.col("safe")))
    control = re.compile(r"<\|\w+\|>|</?s>|\[/?INST\]|<</?SYS>>", re.ASCII)
    for r in df.collect():
        assert r["back"] == r["text"] and not control.search(r["safe"])
        assert control.search(r["text"]) or "\\" in r["text"] or r["safe"] == r["text"] or re.search(r"\[\||<INST|</INST|\[s>|\[/s>|\[</?SYS", r["text"])
    assert len({r["safe"] for r in df.collect()}) == len(set(texts))


def conversation(rows):
    turns = [(role or "", text or "") for _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))]
    learned = "".join(t for r, t in turns if r == "assistant")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned)


def test_conversations(spark, tmp_path):
    rng = random.Random(2)
    say = lambda: None if rng.random() < 0.1 else "".join(rng.choice(CONTROL) for _ in range(rng.randrange(0, 30)))
    talks = {i: [(t, rng.choice(["user", "assistant", "assistant", "system", None, "<|end|>"]), say()) for t in rng.sample([*range(n), None], n)] for i, n in ((k, rng.randrange(1, 9)) for k in range(60))}
    talks[500] = [(k, "assistant" if k % 2 else "user", "x" * 40 + "</s>") for k in range(3000)]  # a long one
    talks[501], talks[502] = [(None, None, None)], [(1, "user", "same"), (1, "user", "same"), (1, "assistant", "same")]
    rows = [(i, *t) for i, own in talks.items() for t in own]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "loss": F.lit("x")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op13_schema_fingerprint_chat(spark, str(tmp_path)).collect()}
    talks[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(talks)
    for i, own in talks.items():
        assert tuple(got[i][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == conversation(own), i
    none = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert [len(r["turns"]) for r in ChatFormat().from_rows(none).collect()] == [1, 1]
    assert ChatFormat().from_rows(none.limit(0)).count() == 0


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"content": "yo", "role": "assistant", "name": "x"}]}, "messages", [("user", "hi"), ("assistant", "yo")]),
    ({"id": 3, "messages": [{"role": "user", "content": None}]}, "messages", [("user", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "source": "s"}, "from and value", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"output": "done", "instruction": "do", "input": "", "system": "be"}, "instruction", [("system", "be"), ("user", "do"), ("assistant", "done")]),
    ({"output": "done", "instruction": "do", "input": None}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "response": 5}, "prompt and response", [("user", "p"), ("assistant", "5")]),
    ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ({"system_prompt": "s", "question": "q", "answer": "a"}, "question and answer", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "response": "r", "other": 1}, None, None),
    ({"messages": []}, None, None),
    ({"messages": "text"}, None, None),
    ({"a b: STRING": None, "x": {"y": [1, "b"]}}, None, None),
    ([1, 2], None, None),
]


def test_layouts(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(90, "{bad"), (91, None), (92, ""), (93, "null")]
    chat = ChatFormat()
    df = chat.from_json(spark.createDataFrame(rows, "k long, record string").withColumn("turns", F.lit(1)), keys=("k",))
    got = {r["k"]: r for r in df.collect()}
    assert len(got) == len(rows)
    for k, (_, layout, turns) in enumerate(RECORDS):
        assert got[k]["layout"] == layout and (None if got[k]["turns"] is None else [tuple(t) for t in got[k]["turns"]]) == turns, RECORDS[k]
    assert all(got[k]["layout"] is None and got[k]["turns"] is None for k in (90, 91, 92, 93))
    assert got[0]["signature"] == "{messages[{content,name,role>>>" == signature(["messages[].role", "messages[].content", "messages[].name"])
    assert got[12]["signature"] == "{x{y[>>>"
    shown = {(r["signature"], r["layout"]): r["records"] for r in chat.fingerprints(df).collect()}
    assert shown[("{other,prompt,response>", None)] == 1 and sum(shown.values()) == len(rows)
    texts = {r["k"]: r["formatted"] for r in chat.format(df).collect()}
    assert texts[6] == "<|start|>user<|text|>p<|end|><|start|>assistant<|text|>5<|end|>" and texts[9] == ""


def test_typed_records_of_many_layouts(spark):
    """One wide table, where each row fills the columns of its own layout."""
    kind = "messages array<struct<role:string,content:string,name:string>>, conversations array<struct<from:string,value:string>>, instruction string, input string, output string, prompt string, response string"
    rows = [([("user", "hi", None), ("assistant", "yo", None)], None, None, None, None, None, None), (None, [("human", "q"), ("gpt", "a")], None, None, None, None, None), (None, None, "do", None, "done", None, None), (None, None, None, None, None, "p", "r"), (None, None, None, None, None, "p", None), (None,) * 7]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k long, record struct<{kind.replace(' array', ':array').replace(' string', ':string')}>")
    got = {r["k"]: r for r in ChatFormat().from_struct(df, keys=("k",)).collect()}
    assert [got[k]["layout"] for k in range(6)] == ["messages", "from and value", "instruction", "prompt and response", None, None]
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "q"), ("assistant", "a")] and [tuple(t) for t in got[2]["turns"]] == [("user", "do"), ("assistant", "done")]
    as_json = {r["k"]: r for r in ChatFormat().from_json(df.select("k", F.to_json("record").alias("record")), keys=("k",)).collect()}
    assert all(as_json[k]["fingerprint"] == got[k]["fingerprint"] and as_json[k]["turns"] == got[k]["turns"] for k in range(5))


def test_own_layout_and_roles(spark):
    chat = ChatFormat((Layout("talk", "talk", "who", "said"),), learned=("bot",))
    df = chat.format(chat.from_json(spark.createDataFrame([('{"talk":[{"who":"a","said":"1"},{"who":"bot","said":"<s>"}]}',)], "record string")))
    row = chat.read_back(df).first()
    assert row["read_turns"][1]["role"] == "assistant" and row["read_loss"] == []  # names of roles are mapped first
    row = chat.read_back(ChatFormat(learned=("a", "assistant")).format(df.drop("formatted", "loss"))).first()
    assert row["read_loss"] == ["1", "<s>"]


def test_formatting_time_grows_with_the_text(spark):
    import time

    chat, took = ChatFormat(), []
    for n in (4000, 16000):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("word </s> " * 20).alias("text"))
        for _ in range(2):
            began = time.perf_counter()
            got = chat.read_back(chat.format(chat.from_rows(rows)).select("conv_id", "formatted", "loss")).select(F.size("read_turns").alias("n"), F.length(F.array_join("read_loss", "")).alias("chars")).first()
            last = time.perf_counter() - began
        assert (got["n"], got["chars"]) == (n, n // 2 * 200)
        took.append(last)
    assert took[1] < 8 * took[0] + 1, took
