"""Quoted line breaks read in pieces give the rows that one task gives for a whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import quoted_csv, tables


def write(path, rows, rng, end="\n", sep=",", encoding="utf-8", header=("id", "a b", "c")):
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))


def made(rng, n, sep=","):
    bits = ["x", "é", sep, '"', '""', "\n", "\n\n", " ", "long text without quotes ", "\r\n"]
    field = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))
    return [(str(k), field(), field()) for k in range(n)]


def one_task(spark, path, sep=",", encoding="UTF-8"):
    df = spark.read.options(header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"', nullValue="", emptyValue="").csv(str(path))
    return df.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in df.columns])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def small_pieces(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("end", "sep", "encoding"), [("\n", ",", "utf-8"), ("\r\n", ";", "utf-8"), ("\n", "|", "latin-1"), ("\n", "\t", "utf-8")])
def test_pieces_equal_one_task(spark, tmp_path, small_pieces, end, sep, encoding):
    rng = random.Random(hash((end, sep)) % 1000)
    for f in range(3):
        write(tmp_path / f"{f}.csv", made(rng, 60, sep), rng, end, sep, encoding)
    write(tmp_path / "3.csv", [("7", "one field over many pieces " + "\n" * 900 + "end", "z"), ("8", "", "")], rng, end, sep, encoding)
    write(tmp_path / "4.csv", [], rng, end, sep, encoding)
    name = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}[encoding]
    found = quoted_csv.records(spark, str(tmp_path), name)
    assert found.rdd.getNumPartitions() > 10
    got = quoted_csv.parse(found, ["id", "a b", "c"], sep)
    truth = [(str(r[0]), r[1] or None, r[2] or None) for f in sorted(tmp_path.glob("*.csv")) for r in list(csv.reader(io.StringIO(f.read_text(encoding=encoding, newline=""), newline=""), delimiter=sep))[1:]]
    clean = got.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in got.columns])
    assert rows_of(clean) == sorted(truth, key=repr)
    if end == "\n":  # Spark's reader makes line feeds of line ends inside quotes where lines end otherwise
        assert rows_of(clean) == rows_of(one_task(spark, tmp_path, sep, name))
    assert rows_of(tables.read_csv(spark, str(tmp_path), name, sep)) == rows_of(clean)


def test_a_header_over_many_pieces(spark, tmp_path, small_pieces):
    write(tmp_path / "a.csv", [("1", "x\ny", "z"), ("2", "", 'q"')], None, header=("id", "a\n" * 300 + "b", "c"))
    got = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows_of(got) == [("1", "x\ny", "z"), ("2", None, 'q"')]


def test_quotes_that_cannot_be_counted_go_to_one_task(spark, tmp_path, small_pieces):
    (tmp_path / "a.csv").write_text('id,v\n1,5" pipe\n2,"a\nb"\n3,6" pipe\n' + "".join(f"{k},v\n" for k in range(4, 60)))
    assert not quoted_csv.records(spark, str(tmp_path / "a.csv")).where(quoted_csv.improper(F.col("text"), ",")).isEmpty()
    assert rows_of(tables.read_csv(spark, str(tmp_path / "a.csv"))) == rows_of(one_task(spark, tmp_path / "a.csv"))
    for text in ('a,"b",c', '"a""b",""', '""""', '"",x', "plain", '"a\nb",c', '"x"\r'):
        assert not spark.createDataFrame([(text,)], "text string").select(quoted_csv.improper(F.col("text"), ",")).first()[0], text
    for text in ('a"b', '"a"b', 'x"a"', '"open', 'a,b"c"'):
        assert spark.createDataFrame([(text,)], "text string").select(quoted_csv.improper(F.col("text"), ",")).first()[0], text


def test_carriage_returns_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,v\r1,"a\rb"\r2,c\r')
    assert rows_of(tables.read_csv(spark, str(tmp_path / "a.csv"))) == rows_of(one_task(spark, tmp_path / "a.csv"))
