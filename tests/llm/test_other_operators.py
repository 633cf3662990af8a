"""Embeddings, packing, archives, shards, learned scores and the pipeline."""

import gzip
import hashlib
import io
import itertools
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import packing, quality, toxicity, warc_zip
from sparkloom.llm.embedding_dedup import EmbeddingDedup
from sparkloom.llm.packing import LengthBuckets
from sparkloom.llm.sharding import HilbertShards, hilbert_index
from tests.llm import helpers as H


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(120, 24))
    near = base[rng.integers(0, 120, 60)] + rng.normal(size=(60, 24)) * 0.25
    hot = base[0] + rng.normal(size=(80, 24)) * 0.2
    rows = [[float(np.float32(v)) for v in r] for r in np.concatenate([base, near, hot, base[:9], 2 * base[:4]])]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    return list(enumerate(rows + odd))


@pytest.mark.parametrize(("kind", "block"), [("float", 8), ("double", 5), ("double", 24)])
def test_embedding_links(spark, kind, block):
    rows = vectors()
    got = {r["vec_id"]: r for r in EmbeddingDedup(0.95, block).run(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("node", F.lit(1)).repartition(4)).collect()}
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.95 * np.linalg.norm(good[i]) * np.linalg.norm(good[j])} for i in good}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, ())), min(seen), min(seen) == i), i


def test_embedding_odd_tables(spark):
    assert EmbeddingDedup().run(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    none = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(str, EmbeddingDedup().run(none).collect())) == sorted(map(str, none.selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id", "if(vec_id = 1, true, null) AS kept").collect()))
    some = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [0.0, 1.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in EmbeddingDedup(0.95, 1).run(some).collect()) == [("3", 1, 3), ("4", 1, 3), ("4", 1, 3), ("None", 0, None)]


def test_embedding_cosine_of_just_the_bound(spark):
    """A cosine of exactly the bound links; the next smaller one does not."""
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0]), (4, [-3.0, -3.9999999999])]
    got = {r["vec_id"]: r["n_links"] for r in EmbeddingDedup(0.8, 1).run(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(150):
        h = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        k, lengths = rng.randint(1, 5), sorted(h)
        cost = lambda b: sum(n * (min(x for x in b if x >= length) - length) for length, n in h.items())  # noqa: B023, E731
        best = min(cost((*c, lengths[-1])) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m))
        assert cost(packing.optimal_bounds(h, k)) == best
    assert packing.optimal_bounds({}, 3) == []


def test_batches(spark):
    docs = [(k, t) for k, (_, t) in enumerate(H.corpus())]
    got = LengthBuckets(buckets=4, max_tokens=100, token_budget=400).run(spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit("x"))).toPandas()
    for i, t in docs:
        own = got[got.doc_id == i].sort_values("piece")
        n = len(H.BLANK.findall(t or ""))
        assert own.n_tokens.sum() == n and list(own.first_token) == list(range(0, max(n, 1), 100))
        assert own.bucket.isna().all() == (n == 0)
    full = got[got.n_tokens > 0]
    for _, g in full.groupby(["bucket", "batch"]):
        assert g.bucket_tokens.sum() <= 400 and sorted(g.slot) == list(range(len(g))) and (g.n_tokens <= g.bucket_tokens).all()
    assert LengthBuckets().run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hilbert_curve_is_continuous(spark):
    for bits in (1, 2, 3):
        points = [(x, y, z) for x in range(1 << bits) for y in range(1 << bits) for z in range(1 << bits)]
        rows = sorted(spark.createDataFrame(points, "x int, y int, z int").withColumn("h", hilbert_index([F.col("x"), F.col("y"), F.col("z")], bits)).collect(), key=lambda r: r["h"])
        assert [r["h"] for r in rows] == list(range(len(points)))
        assert all(sum(abs(a - b) for a, b in zip(p[:3], q[:3])) == 1 for p, q in zip(rows, rows[1:]))


def test_shards(spark):
    import zlib

    docs = [(k, t, [None, "a", "b"][k % 3], "hot") for k, (_, t) in enumerate(H.corpus())]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumns({"cell": F.lit("x"), "_part": F.lit(0)})
    for shards in (1, 7, 40, 500):
        got = HilbertShards(shards).run(df).toPandas()
        assert len(got) == len(docs) and got.doc_id.is_unique
        sizes = got.groupby("shard").size().reindex(range(shards), fill_value=0)
        assert sizes.max() - sizes.min() <= 1
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        ordered = got.sort_values("position")
        assert (ordered.curve.diff().dropna() >= 0).all() and list(ordered.position) == list(range(len(docs))) and (ordered.shard.diff().dropna() >= 0).all()
        text = {i: (t or "").encode() for i, t, *_ in docs}
        for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"]):
            assert (s, c) == (len(text[i]) + 16, zlib.crc32(text[i]))
    assert HilbertShards().run(df.limit(0)).count() == 0


def test_shards_prune_files(spark):
    """How many of 40 files a filter on each dimension opens, by their smallest and largest values."""
    rng = random.Random(5)
    sources = [f"https://site-{k:03}.example" for k in range(60)]
    rows = [(k, "x" * int(16 * 2 ** rng.uniform(0, 11)), rng.choice(["de", "en", "es", "fr"]), sources[0] if k % 3 == 0 else rng.choice(sources)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    files = HilbertShards(40).run(df).join(df, "doc_id").groupBy("shard").agg(*[f(c) for c in ("source", "lang", "size") for f in (F.min, F.max)]).toPandas()
    opened = lambda c, v: int(((files[f"min({c})"] <= v) & (files[f"max({c})"] >= v)).sum())
    assert len(files) == 40
    assert np.mean([opened("lang", v) for v in ("de", "en", "es", "fr")]) <= 22
    assert np.mean([opened("source", v) for v in sources[1:]]) <= 14 and opened("source", sources[0]) <= 24
    assert np.mean([opened("size", 16 * 2**k) for k in range(1, 11)]) <= 25


def test_archives(spark, tmp_path):
    same = "x" * 1200
    pages = [(1, "u1", same), (5, "u2", same), (3, None, same), (2, "u3", "y" * 999), (4, "u\r\n4", "y" * 999), (6, "u6", None), (7, "u7", "é" * 700), (8, "", "\r\n\r\nWARC/1.1\r\n"), (9, "u9", "é" * 700), (None, "n", same)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0)).repartition(3)
    made = warc_zip.write_packages(df, f"{tmp_path}/store")
    for r in made.collect():  # any ZIP reader opens them
        with zipfile.ZipFile(warc_zip.store(r["path"])[1]) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc_zip.DATA, warc_zip.INDEX} and len(z.read(warc_zip.INDEX).splitlines()) == r["records"]
    got = {r["page_id"]: r for r in warc_zip.read_packages(made, with_payload=True).collect()}
    assert len(got) == len(pages)
    assert {i: got[i]["refers_to"] for i in got} == {1: 5, 5: None, 3: 5, 2: None, 4: None, 6: None, 7: 9, 8: None, 9: None, None: 5}
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["record_type"] == ("response" if got[i]["refers_to"] is None else "revisit")
        assert got[i]["payload"] == (data if got[i]["refers_to"] is None else None)
    assert warc_zip.read_packages(warc_zip.write_packages(df.limit(0), f"{tmp_path}/none")).count() == 0


def test_archives_roll_over_and_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "PACKAGE_BYTES", 4000)
    monkeypatch.setattr(warc_zip, "RANGE_RECORDS", 3)
    rng = random.Random(2)
    pages = [(k, f"u{k}", H.prose(rng, rng.randrange(0, 200), 10**6)) for k in range(90)]
    made = warc_zip.write_packages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/many")
    assert made.count() > 8 and made.agg(F.sum("records")).first()[0] == 90 and made.agg(F.max("records")).first()[0] > 3
    assert {r["page_id"]: r["payload"].decode() for r in warc_zip.read_packages(made, with_payload=True).collect()} == {i: h for i, _, h in pages}


def test_archives_elsewhere_and_damaged(tmp_path):
    for path in ("dbfs:/mnt/x", "ftp://host/x"):
        with pytest.raises(ValueError, match="no file system"):
            warc_zip.store(path)
    assert warc_zip.store(f"file:{tmp_path}/a")[1] == warc_zip.store(f"file://{tmp_path}/a")[1] == f"{tmp_path}/a"
    out = io.BytesIO()
    package = warc_zip.Package(out)
    package.record("1", warc_zip.warc_record(1, "u", b"abc", "a9993e364706816aba3e25717850c26c9cd0d89d", None), "response")
    package.close()
    data = out.getvalue()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    where = warc_zip.members(Source(data))
    with pytest.raises(ValueError, match="local header"):
        warc_zip.members(Source(b"XX" + data[2:]))
    start, length = where[warc_zip.INDEX]
    (tmp_path / "p.wacz").write_bytes(data[:start] + b"?" * length + data[start + length :])
    import pyarrow as pa

    with pytest.raises(ValueError, match="damaged"):
        list(warc_zip._locate([pa.RecordBatch.from_pydict({"path": [str(tmp_path / "p.wacz")]})]))


def foreign_record(kind, record_id, body, http=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", more=(), zipped=True):
    block = http + body
    head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2020-01-02T03:04:05Z", "WARC-Target-URI: https://example.com/a b", *more, f"Content-Length: {len(block)}"])
    data = head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data) if zipped else data


def foreign_package(path, index, name="indexes/index.cdxj", archive="archive/rec-20200102.warc.gz", zipped=True, comment=b""):
    """As other writers make them, with zipfile; index: a function of (offset, length) pairs that gives the bytes."""
    records = [
        foreign_record("warcinfo", "<urn:uuid:0>", b"software: x", b"", ["Content-Type: application/warc-fields"], zipped), foreign_record("response", "<urn:uuid:1>", b"hello", zipped=zipped, more=["Content-Type: application/http; msgtype=response"]),
        foreign_record("response", "<urn:uuid:2>", b"wide", more=["WARC-Payload-Digest: sha256:00"], zipped=zipped),
        foreign_record("revisit", "<urn:uuid:3>", b"", more=["WARC-Refers-To: <urn:uuid:1>", "WARC-Payload-Digest: sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N"], zipped=zipped),
    ]
    starts = [sum(map(len, records[:k])) for k in range(len(records))]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("archive/", "")
        z.writestr(archive, b"".join(records))
        z.writestr(name, index([(a, len(r)) for a, r in zip(starts, records)]))
        z.comment = comment


def cdxj(places, filename='"filename": "rec-20200102.warc.gz", ', quote=str, length=True):
    return "".join(f'com,example)/?q={k} 20200102030405 {{"url": "https://example.com/", {filename}"offset": {quote(a)}' + (f', "length": {quote(n)}' if length else "") + "}\n" for k, (a, n) in enumerate(places)).encode()


@pytest.mark.parametrize("case", ["cdxj", "quoted", "gzipped", "no name", "no length", "letters", "plain", "whole path", "comment"])
def test_packages_of_other_writers(spark, tmp_path, case):
    text = lambda x: f'"{x}"'
    letters = lambda places: (" CDX N b a m s k r M S V g\n" + "".join(f"com,example)/ 20200102030405 https://example.com/ text/html 200 X - - {n} {a} rec-20200102.warc.gz\n" for a, n in places)).encode()
    made = {
        "cdxj": (cdxj, {}), "quoted": (lambda p: b'!meta {"format": "cdxj"}\n' + cdxj(p, quote=text), {}), "gzipped": (lambda p: gzip.compress(cdxj(p[:2])) + gzip.compress(cdxj(p[2:])), {"name": "indexes/index.cdx.gz"}), "no name": (lambda p: cdxj(p, ""), {}),
        "no length": (lambda p: cdxj(p, length=False), {}), "letters": (letters, {"name": "indexes/all.cdx"}), "plain": (lambda p: cdxj(p, '"filename": "a.warc", '), {"archive": "archive/a.warc", "zipped": False}),
        "whole path": (lambda p: cdxj(p, '"filename": "archive/rec-20200102.warc.gz", '), {}), "comment": (cdxj, {"comment": b"PK\x05\x06 and more of it, long enough to look like an end"}),
    }
    index, options = made[case]
    foreign_package(tmp_path / "f.wacz", index, **options)
    got = {r["record_id"]: r for r in warc_zip.read_packages(spark.createDataFrame([(str(tmp_path / "f.wacz"),)], "path string"), with_payload=True).collect()}
    assert {i: (r["record_type"], r["payload"], r["payload_bytes"]) for i, r in got.items()} == {
        "<urn:uuid:0>": ("warcinfo", b"software: x", 11), "<urn:uuid:1>": ("response", b"hello", 5), "<urn:uuid:2>": ("response", b"wide", 4), "<urn:uuid:3>": ("revisit", None, None),
    }
    assert all(r["page_id"] is None and r["refers_to"] is None and r["stamp"] == "2020-01-02T03:04:05Z" and r["url"] == "https://example.com/a b" for r in got.values())
    assert got["<urn:uuid:3>"]["refers_to_id"] == "<urn:uuid:1>" and got["<urn:uuid:3>"]["payload_digest"] == got["<urn:uuid:1>"]["payload_digest"] == hashlib.sha1(b"hello").hexdigest()


def test_packages_that_cannot_be_read_say_so(tmp_path):
    import pyarrow as pa

    read = lambda: list(warc_zip._locate([pa.RecordBatch.from_pydict({"path": [str(tmp_path / "f.wacz")]})]))
    for options, match in ((({"index": lambda p: cdxj(p, '"filename": "other.warc.gz", ')}), "does not store"), ({"index": lambda p: b"what is this\n"}, "unknown form"), ({"index": lambda p: cdxj([(10**9, 5)])}, "names byte"), ({"index": cdxj, "name": "other/index.cdxj"}, "no index")):
        foreign_package(tmp_path / "f.wacz", **options)
        with pytest.raises(ValueError, match=match):
            read()


def test_packages_without_a_scheme_lie_where_spark_resolves_them(spark, tmp_path):
    made = warc_zip.write_packages(spark.createDataFrame([(1, "http://www.Example.com:80/a?b#c", "x")], "page_id long, url string, html string"), f"{tmp_path}/p")
    assert made.first()["path"].startswith("file:/")
    assert [warc_zip.index_key(u) for u in ("http://www.Example.com:80/a?b#c", None, "", "x.y", "data:{")] == ["com,example)/a?b", ")/", ")/", "y,x)/", "data):%7B"]


def test_zip64_directory():
    for wide in (False, True):
        out = io.BytesIO()
        package = warc_zip.Package(out, zip64=wide)
        record = warc_zip.warc_record(1, "u", b"abc", "a9993e364706816aba3e25717850c26c9cd0d89d", None)
        package.record("1", record, "response")
        package.close()

        class Source(io.BytesIO):
            def size(self):
                return len(self.getvalue())

        source = Source(out.getvalue())
        where = warc_zip.members(source)
        assert set(where) == {warc_zip.DATA, warc_zip.INDEX}
        start, length = where[warc_zip.DATA]
        assert warc_zip.parse_record(out.getvalue()[start : start + length])["payload"] == b"abc"
        with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
            assert z.testzip() is None
    with pytest.raises(ValueError, match="central directory"):
        warc_zip.members(Source(b"no archive"))


def paid(scorer, text):
    return sum(w * scorer.factors[kind][context] for clause in scorer.clauses(text)[0] for kind, context, w in clause)


def test_grammar_contexts():
    scorer = toxicity.Scorer(toxicity.Model())
    total = lambda t: paid(scorer, t)
    assert total("you are an idiot.") > total("an idiot.") > total("someone said an idiot.") > total("someone said not an idiot.") > 0
    assert total("he is not an idiot.") < total("he is an idiot.")
    assert total("they will kill time.") > 0 == total("we kill time.") == total("we kill.")  # they are a target, whichever way the verb goes
    assert total("I will kill. You stay.") == 0 < total("you I will kill.")
    assert scorer.clauses(None) == ([], 0) and scorer.clauses("") == ([], 0)


def test_grammar_reads_targets_on_both_sides():
    scorer = toxicity.Scorer(toxicity.Model())
    total = lambda t: paid(scorer, t)
    for text in ("I will kill you.", "we will destroy them", "Wir vernichten euch!", "Ich werde dich töten.", "Je vais tuer toi et les autres.", "Je vais te tuer.", "Voy a matar a ustedes.", "Te voy a matar."):
        assert total(text) == 2.0 and scorer.score(text) > 0.5, text
    assert total("I will kill. You stay.") == total("I will kill time.") == 0 < total("I will not kill you.") < total("I will kill you.")
    assert scorer.score("I will kill time.") < 0.5
    assert total("idiot, you are") == total("you are an idiot") == total("you idiot you") == 3.0 and total("idiot a b c d e you") == total("you a b c d e idiot") == 2.0


def test_grammar_against_a_plain_reader():
    """Class, context and weight of every match, where words are looked at one by one."""
    model = toxicity.Model(words={"lout": (toxicity.INSULT, 1.5), "smite": (toxicity.THREAT, 2.5)}, prefixes={"grob": (toxicity.INSULT, 1.25)})
    scorer = toxicity.Scorer(model)
    kinds = {"idiot": (toxicity.INSULT, 2.0), "lout": (toxicity.INSULT, 1.5), "grobx": (toxicity.INSULT, 1.25), "kill": (toxicity.THREAT, 2.0), "smite": (toxicity.THREAT, 2.5)}
    others = {"you": toxicity.TARGET, "not": toxicity.NEGATION, "said": toxicity.REPORT, "a": toxicity.OTHER, "gro": toxicity.OTHER}
    classes = {w: k for w, (k, _) in kinds.items()} | others
    rng = random.Random(6)
    for _ in range(700):
        clauses = [rng.choices(list(classes), (1, 1, 1, 2, 1, 1, 1, 0.5, 8, 1), k=rng.randrange(1, 16)) for _ in range(3)]
        want = []
        for clause in clauses:
            read = [classes[w] for w in clause]
            found = []
            for i, w in enumerate(clause):
                if w in kinds:
                    near = read[max(0, i - 5) : i + 6] if read[i] == toxicity.INSULT else read
                    context = toxicity.AIMED * (toxicity.TARGET in near) | toxicity.NEGATED * (toxicity.NEGATION in read[max(0, i - 3) : i]) | toxicity.REPORTED * (toxicity.REPORT in read[:i])
                    found.append((read[i], context, kinds[w][1]))
            want += [found] * bool(found)
        text = ". ".join(" ".join(c) for c in clauses)
        assert scorer.clauses(text) == (want, sum(map(len, clauses))), text
        factors = {toxicity.INSULT: (1.5, 0.3, 0.6), toxicity.THREAT: (1.0, 0.3, 0.4)}
        by_hand = [sum(w * (context & 1 or kind == toxicity.INSULT) * np.prod([f for k, f in enumerate(factors[kind]) if context >> k & 1]) for kind, context, w in clause) for clause in want]
        x = scorer.features(text)
        assert x[4] == pytest.approx(max(by_hand, default=0.0)) and np.expm1(x[1]) == pytest.approx(sum(by_hand))


def test_toxicity_learns_contexts(spark):
    """Labels that depend on contexts alone: a word that is toxic unless it is reported, and one that is toxic only at a target."""
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(900):
        clauses = [H.prose(rng, rng.randrange(4, 9), 60) for _ in range(6)]
        case = i % 12
        if case in (0, 1, 4):
            clauses[rng.randrange(6)] = f"{'someone said that ' * (case == 1)}w1 a zounder w2"
        elif case in (2, 3, 6):
            clauses[rng.randrange(6)] = f"w1 flimmer {'w2' if case == 3 else 'you'} w3"
        docs.append((i, ". ".join(clauses)))
        labels.append((i, int(case in (0, 2, 4, 6))))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.ToxicityGrammar().fit(docs, labels)
    assert model.words["flimmer"][0] == toxicity.THREAT and model.words["zounder"][0] == toxicity.INSULT
    scorer = toxicity.Scorer(model)
    filler = ". w5 w6 w7 w8. w9 w10 w11 w12. w13 w14 w15"
    assert scorer.score("w1 a zounder w2" + filler) > 0.5 > scorer.score("someone said that w1 a zounder w2" + filler)
    assert scorer.score("w1 flimmer you w3" + filler) > 0.5 > scorer.score("w1 flimmer w2 w3" + filler)


def test_toxicity_odd_rows(spark):
    rows = [(1, "you idiot " * 30000), (1, "you idiot " * 30000), (None, "I will kill you"), (2, None), (3, ""), (4, "...!!!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "scored_text": F.lit(1), "carried_0": F.lit(None).cast("string")})
    got = toxicity.ToxicityGrammar().score(df, toxicity.Model(), carry=("text",)).collect()
    assert len(got) == 6 and [r["text"] for r in got] == [t for _, t in rows]
    assert got[0]["score"] == got[1]["score"] > 0.5 and got[2]["score"] > 0.5 and got[3]["score"] == got[4]["score"] == got[5]["score"] < 0.5


def labelled(spark, seed=4, n=700):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = H.prose(rng, rng.randrange(20, 120)).split()
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "grobianx", "moron", "lout"]))
        if bad:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), spark.createDataFrame(labels + [(n, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    grammar = toxicity.ToxicityGrammar(fit_rows=600)
    model = grammar.fit(docs, labels)
    from sparkloom.llm.labelled import fold

    out = grammar.score(docs, model).join(labels, "doc_id").where((fold(F.col("doc_id"), 5) == 0) & F.col("toxic").isNotNull()).toPandas()
    assert ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.95
    scores = grammar.score(docs, model)
    assert scores.count() == docs.count() and scores.where("score is null or score < 0 or score > 1").count() == 0
    assert grammar.fit(docs, labels.limit(0)) == toxicity.Model() and grammar.score(docs.limit(0), model).count() == 0


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    ranking = quality.QualityRanking(fit_rows=600)
    model = ranking.fit(docs, labels)
    from sparkloom.llm.labelled import fold

    out = ranking.score(docs, model).join(labels, "doc_id").where((fold(F.col("doc_id"), 4) == 2) & F.col("quality").isNotNull()).toPandas()
    assert ((out.score >= 0.7) == (out.quality == 1)).mean() > 0.95
    assert ranking.score(docs, ranking.fit(docs, labels.limit(0))).where("abs(score - 0.7) > 1e-9").count() == 0


def test_pair_weights_are_of_all_pairs():
    """The gradient of the loss over all pairs, taken one by one, vanishes at the weights."""
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.7, 1, (40, 4)), rng.normal(0, 1, (23, 4))
    w = quality.pair_weights(good, bad, step_rows=7)
    diff = (good[:, None] - bad[None]).reshape(-1, 4)
    lose = 1 / (1 + np.exp(diff @ w))
    assert np.abs(lose @ diff * 63 / len(diff) - w).max() < 1e-6


def test_quality_learns_from_all_labelled_rows(spark):
    """Bad documents come only after the first 12000 labelled ones in the order of a hash; weights and threshold are those of all pairs, taken one by one."""
    from sparkloom.llm.labelled import fold

    rng = random.Random(6)
    ids = [r["id"] for r in spark.range(17000).where(fold(F.col("id"), 4) != 2).orderBy(F.xxhash64("id"), "id").collect()]
    bad = set(ids[12000:])
    assert len(bad) > 200
    word = lambda i: rng.choice(("$$$", "BUY!!!", "w1") if i in bad else ("w1", "other", "BUY!!!", "longer"))
    texts = {i: " ".join(word(i) for _ in range(rng.randrange(4, 12))) for i in range(17000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int").repartition(3)
    ranking = quality.QualityRanking()
    model = ranking.fit(docs, labels)

    x, y = quality.features(pa.array([texts[i] for i in ids])), np.array([i not in bad for i in ids])
    assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-6) and np.allclose(model.spread, np.maximum(x.std(axis=0), 1e-6), rtol=1e-6)
    win, lost = model.expand(x[y]), model.expand(x[~y])
    lose = 1 / (1 + np.exp((win @ model.weights)[:, None] - (lost @ model.weights)[None, :]))
    scale = len(ids) / len(win) / len(lost)
    gradient = scale * (lose.sum(axis=1) @ win - lose.sum(axis=0) @ lost) - model.weights
    lose *= 1 - lose
    cross = win.T @ (lose @ lost)
    curve = scale * ((win.T * lose.sum(axis=1)) @ win + (lost.T * lose.sum(axis=0)) @ lost - cross - cross.T) + np.eye(len(model.weights))
    assert np.abs(np.linalg.solve(curve, gradient)).max() < 1e-5
    assert abs(model.threshold - np.quantile(model.strength(x), len(bad) / len(ids))) < 1e-9
    got = {r["doc_id"]: r["score"] for r in ranking.run(docs, labels).collect()}
    assert got == {r["doc_id"]: r["score"] for r in ranking.score(docs, model).collect()} and len(got) == 17000
    assert np.mean([(got[i] >= 0.7) == (i not in bad) for i in ids]) > 0.95


def test_quality_odd_rows(spark):
    """Null, empty, repeated and long texts under a fitted model, and columns with clashing names."""
    docs, labels = labelled(spark, n=200)
    model = quality.QualityRanking().fit(docs, labels)
    rows = [(1, "w1 w2 w3"), (1, "w1 w2 w3"), (None, "w5 " * 200000), (2, None), (3, ""), (4, "\t\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "label": F.lit(1), "x": F.lit(0)})
    got = quality.QualityRanking().score(df, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["score"] == got[1]["score"] and got[3]["score"] == got[4]["score"] == got[5]["score"]


def test_batches_of_repeated_rows(spark):
    rows = [(1, "a b c")] * 5 + [(None, "a b c")] * 2 + [(2, "a " * 10)]
    got = LengthBuckets(buckets=2, max_tokens=4, token_budget=8).run(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == 10 and got.n_tokens.sum() == 31 and not got.duplicated(["bucket", "batch", "slot"]).any()


def test_queries_of_other_operators_on_small_tables(spark, tmp_path):
    """Each opN_ query on a fixture, with the columns and types of its contract."""
    from sparkloom.llm import queries

    docs, labels = labelled(spark, n=300)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "u", "x" * 1000), (2, "u", "x" * 1000), (3, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path))

    out = run("op1_subspace_pigeonhole_join")
    assert dict(out.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"} and out.count() == len(vectors())
    out = run("op2_optimal_length_buckets").toPandas()
    assert out.bucket.nunique() <= 16 and out.groupby(["bucket", "batch"]).bucket_tokens.sum().max() <= 65536
    got = {r["page_id"]: tuple(r)[1:] for r in run("op3_warc_zip_reader").collect()}
    assert {i: (g[0], g[2], g[3]) for i, g in got.items()} == {1: (1000, "revisit", 2), 2: (1000, "response", None), 3: (0, "response", None)} and got[3][1] == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    for name, folds, fold, at in (("op6_toxicity_grammar", 5, 0, 0.5), ("op9_bradley_terry_quality", 4, 2, 0.7)):
        import zlib

        out = run(name)
        assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
        rows = out.collect()
        assert len(rows) == 302 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) and r["predicted"] == int(r["score"] >= at) for r in rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, n=400)
    rng = random.Random(8)
    passage, leak = H.prose(rng, 70), H.prose(rng, 25)
    extra = [(1000 + k, f"{H.prose(rng, 60)} {passage} {H.prose(rng, 60)}", "en", "s", 1) for k in range(4)] + [(2000, f"{H.prose(rng, 40)} {leak} {H.prose(rng, 40)}", "en", "s", 1)]
    copy = H.prose(rng, 90)
    extra += [(3000 + k, copy, "en", "s", 1) for k in range(5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert set(out.columns) == set(corpus_pipeline.COLUMNS)
        kept[name] = {r["doc_id"]: r.asDict() for r in out.collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(toxic & kept["toxicity"].keys()) < 0.1 * len(toxic) and len(clean - kept["toxicity"].keys()) < 0.05 * len(clean)
    assert {i for i in kept["ngram_jaccard_join"] if 3000 <= i < 3005} == {3000}
    texts = {i: r["text"] for i, r in kept["substring_dedup"].items()}
    assert sum(passage in (t or "") for t in texts.values()) == 1 and passage in texts[1000]
    assert 2000 not in kept["benchmark_decontamination"] and set(kept["substring_dedup"]) - set(kept["benchmark_decontamination"]) == {2000}
    assert set(kept["packing"]) == set(kept["benchmark_decontamination"])
    # Every stage but the learned one, row by row against brute force on what the one before kept.
    before = {i: r["text"] for i, r in kept["toxicity"].items()}
    groups = H.components({i: H.shingles(t, 5) for i, t in before.items()}, 80, 100)
    assert kept["ngram_jaccard_join"].keys() == {i for i in before if groups[i] == i}
    before = {i: r["text"] for i, r in kept["ngram_jaccard_join"].items()}
    cut = H.repeats(list(before.items()), 20)
    assert texts == {i: left if gone else before[i] for i, (n, gone, left) in cut.items() if not n or gone < n}
    found = H.leaks(list(texts.items()), [(1, leak)], 10)
    assert kept["benchmark_decontamination"].keys() == {i for i, (_, hit, _) in found.items() if not hit}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r.asDict() for r in whole.collect()} == kept["packing"]
    assert all(r["n_tokens"] == len(H.BLANK.findall(texts[i] or "")) for i, r in kept["packing"].items())


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Stages on null and repeated doc_ids, empty texts and empty tables."""
    import corpus_pipeline

    rng = random.Random(3)
    leak, copy = H.prose(rng, 25), H.prose(rng, 60)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(7, copy), (7, copy), (9, copy), (None, copy), (4, f"x {leak} y"), (4, H.prose(rng, 40)), (None, leak), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    assert ids(stages["toxicity"](spark, docs, str(tmp_path))) == sorted(str(i) for i, _ in rows)
    assert ids(stages["ngram_jaccard_join"](spark, docs, str(tmp_path))) == ["4", "4", "5", "6", "7", "7", "None", "None"]
    assert ids(stages["substring_dedup"](spark, docs, str(tmp_path))) == ["4", "4", "5", "6", "7", "7"]
    assert ids(stages["benchmark_decontamination"](spark, docs, str(tmp_path))) == ["5", "6", "7", "7", "9", "None", "None"]
    assert ids(stages["packing"](spark, docs, str(tmp_path))) == sorted(str(i) for i, _ in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
