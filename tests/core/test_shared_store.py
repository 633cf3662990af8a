"""Datasets and experiments through Spark's file systems: documents are whole, folders may be URIs, digests are streamed."""

import hashlib

import pytest

from sparkloom.engine import Engine
from sparkloom.registry import Registry
from sparkloom.sources.shared import Files
from sparkloom.sources.tables import Store, UploadError


def test_files(spark, tmp_path):
    f, path = Files(spark), f"file://{tmp_path}/a/b/x.json"
    assert not f.exists(path) and f.matching(f"{tmp_path}/a/*/*.json") == []
    for text in ("first é", "second", ""):
        f.write(path, text.encode())
        assert f.read(path).decode() == text and f.size(path) == len(text.encode()) and f.digest(path) == hashlib.sha256(text.encode()).hexdigest()
    assert [p.split("/")[-1] for p in f.matching(f"file://{tmp_path}/a/b/*")] == ["x.json"]  # nothing is left beside it
    data = bytes(range(256)) * 400
    (tmp_path / "bytes").write_bytes(data)
    assert f.read(str(tmp_path / "bytes"), 1000) == data[:1000] and f.read(str(tmp_path / "bytes")) == data


def test_a_second_process_finds_datasets_and_runs(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{k},x{k % 3}\n" for k in range(40)))
    root = f"file://{tmp_path}/store"
    meta = Store(spark, root).ingest(f"file://{tmp_path}/t.csv")
    assert meta["sha256"] == hashlib.sha256((tmp_path / "t.csv").read_bytes()).hexdigest() and meta["size"] == (tmp_path / "t.csv").stat().st_size and meta["filename"] == "t.csv"
    other = Store(spark, str(tmp_path / "store"))  # the same folder by its plain path
    assert [m["id"] for m in other.list()] == [meta["id"]] and other.typed(meta["id"]).count() == 40
    doc = Registry(spark, root).create("t.csv", {"target": "b"})
    again = Registry(spark, tmp_path / "store")
    assert again.get(doc["id"]) == doc and again.create("t.csv", {"target": "b"})["model"]["version"] == 2
    with pytest.raises(KeyError):
        again.get("0" * 10)
    with pytest.raises(UploadError):
        other.folder("../x")
    assert Engine(spark, tmp_path / "store").datasets()[0]["id"] == meta["id"] and Engine(spark, tmp_path / "new").datasets() == []
