"""Sources and sinks: CSV, XLSX and Parquet tables, records, and a store of ingested datasets.

Raw tables are all strings; only the empty field is null. `_row_id` gives rows an
identity at ingest, as Spark keeps no order.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zipfile
from collections import OrderedDict
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.config import DEFAULT, Config
from sparkloom.operators import quality, typing
from sparkloom.sources import quoted_csv, workbooks
from sparkloom.sources.scratch import qualified
from sparkloom.sources.shared import Files
from sparkloom.sources.workbooks import clean_names

ROW_ID = "_row_id"


class UploadError(ValueError):
    """The input is not a usable table."""


def safe_filename(name: str | None) -> str:
    """The base name, with other than word characters, dots, dashes and blanks replaced, at most 120 characters."""
    base = re.sub(r"[^\w.\- ]", "_", os.path.basename((name or "").replace("\\", "/")))[:120]
    return base or "upload"


def sniff(head: bytes) -> tuple[str, str]:
    """Encoding and separator from the first bytes; a character cut at the end does not count against UTF-8."""
    import codecs

    try:
        text, encoding = codecs.getincrementaldecoder("utf-8-sig")().decode(head), "UTF-8"
    except UnicodeDecodeError:
        text, encoding = head.decode("latin-1"), "ISO-8859-1"
    line = text.splitlines()[0] if text.splitlines() else ""
    return encoding, max(",;\t|", key=line.count)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",", names: list[str] | None = None) -> DataFrame:
    """All columns as strings, quotes doubled to escape, line breaks allowed inside quotes.

    Files are read in parallel pieces. Where a line has an odd number of quotes, and so
    quotes that go on in the next one, records are put together from the pieces' lines.
    One task reads a whole file only if its quotes cannot be counted: where some stand
    inside a field that does not begin with one, where a carriage return alone ends lines,
    or in encodings that may hide line ends.
    """
    plain = encoding.upper() in ("UTF-8", "ISO-8859-1")
    seen = spark.read.option("lineSep", "\n").text(path).agg(F.max(quoted_csv.quotes(F.col("value")) % 2).alias("odd"), F.max(F.col("value").rlike("\r(?!$)")).alias("returns")).first() if plain else None
    spans = not plain or seen["odd"] == 1 or bool(seen["returns"])
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, multiLine=spans, quote='"', escape='"', nullValue="", emptyValue="", inferSchema=False)
    df = reader.csv(path)
    names = names or clean_names([re.sub(r"^_c\d+$", "", c) for c in df.columns])
    if plain and spans and not seen["returns"]:
        found = quoted_csv.records(spark, path, encoding)
        if found.where(quoted_csv.improper(F.col("text"), sep)).isEmpty():
            df = quoted_csv.parse(found, names, sep)
    df = df.toDF(*names)
    return df.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_xlsx(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int = workbooks.ROWS) -> DataFrame:
    """First sheets of the workbooks at a path, in ranges of `rows` rows; first rows are names. All columns, or some of them, as strings."""
    workbooks.register(spark)
    reader = spark.read.format("workbook").option("rowsPerPartition", rows)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.load(qualified(spark, path))


def write_workbooks(df: DataFrame, path: str) -> None:
    """A workbook of strings for each partition with rows, in a new folder."""
    workbooks.register(df.sparkSession)
    df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).write.format("workbook").mode("append").save(qualified(df.sparkSession, path))


def _checked_workbook(data: bytes) -> None:
    """Raises UploadError unless a file is a workbook with data rows."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if workbooks.row_count(z) < 2:
                raise UploadError("no data rows")
            next(workbooks.rows_of(z, 0, 1), None)
    except (zipfile.BadZipFile, ValueError, IndexError, ElementTree.ParseError) as e:
        raise e if isinstance(e, UploadError) else UploadError("the workbook can't be read") from e


def parse_upload(spark: SparkSession, path: str, cfg: Config = DEFAULT) -> DataFrame:
    """A validated all-string table from a .csv or .xlsx file of at most max_upload_mb, at a path that Spark can read. Raises UploadError."""
    ext = Path(path).suffix.lower()
    if ext not in (".csv", ".xlsx"):
        raise UploadError(f"{ext or 'this'} is no supported file type; use .csv or .xlsx")
    files = Files(spark)
    size = files.size(path)
    if not size:
        raise UploadError("the file is empty")
    if size > cfg.max_upload_mb * 1024 * 1024:
        raise UploadError(f"the file is larger than {cfg.max_upload_mb} MB")
    if ext == ".csv":
        encoding, sep = sniff(files.read(path, 20000))
        df = read_csv(spark, qualified(spark, path), encoding, sep)
    else:
        _checked_workbook(files.read(path))
        df = read_xlsx(spark, path)
    if len(df.columns) > cfg.max_cols:
        raise UploadError(f"{len(df.columns)} columns; the limit is {cfg.max_cols}")
    rows = df.limit(cfg.max_rows + 1).count()
    if not rows or not df.columns:
        raise UploadError("no data rows")
    if rows > cfg.max_rows:
        raise UploadError(f"more than {cfg.max_rows} rows")
    return df


def with_row_id(df: DataFrame) -> DataFrame:
    """Adds _row_id, increasing along the input."""
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """1 to 1000 records as strings, for predictions."""
    if not 1 <= len(records) <= 1000:
        raise ValueError("1 to 1000 records")
    names = list(dict.fromkeys(k for r in records for k in r))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in records], schema)


def jsonable(o):
    """Plain JSON values: NaN and infinities become null, stamps ISO text, anything unknown text."""
    if o is None or isinstance(o, (bool, int, str)):
        return o
    if isinstance(o, float):
        return o if o == o and abs(o) != float("inf") else None
    if isinstance(o, dict):
        return {str(k): jsonable(v) for k, v in o.items()}
    if isinstance(o, (list, tuple, set)):
        return [jsonable(v) for v in o]
    if hasattr(o, "asDict"):
        return jsonable(o.asDict(recursive=True))
    if hasattr(o, "isoformat"):
        return o.isoformat()
    return jsonable(o.item()) if hasattr(o, "item") else str(o)


def write_json(files: Files, path: str, document) -> None:
    """Whole or not at all."""
    files.write(path, json.dumps(jsonable(document)).encode())


@dataclass
class Store:
    """Datasets under a folder that Spark can write, shared or local: raw Parquet with row ids, and a metadata document that is inferred once and replayed."""

    spark: SparkSession
    root: str | Path
    cfg: Config = DEFAULT

    def __post_init__(self):
        self.root = qualified(self.spark, str(self.root))
        self.files = Files(self.spark)
        self._typed: OrderedDict[str, DataFrame] = OrderedDict()

    def folder(self, dataset_id: str) -> str:
        if not re.fullmatch(r"[0-9a-f]{12}", dataset_id):
            raise UploadError("no such dataset id")
        return f"{self.root}/datasets/{dataset_id}"

    def save(self, filename: str, df: DataFrame, digest: str = "", size: int = 0) -> dict:
        """Writes the raw table, infers its types and keeps both."""
        dataset_id = uuid.uuid4().hex[:12]
        folder = self.folder(dataset_id)
        with_row_id(df).write.parquet(f"{folder}/raw")
        raw = self.spark.read.parquet(f"{folder}/raw")
        clean = quality.normalize_placeholders(raw.drop(ROW_ID))
        meta = {
            "id": dataset_id, "filename": safe_filename(filename), "sha256": digest, "size": size, "created": datetime.now(timezone.utc).isoformat(), "rows": raw.count(),
            "columns": [m.as_dict() for m in typing.infer_types(clean, self.cfg)],
        }
        write_json(self.files, f"{folder}/meta.json", meta)  # last: a dataset that is listed is whole
        return meta

    def ingest(self, path: str) -> dict:
        df = parse_upload(self.spark, path, self.cfg)
        return self.save(os.path.basename(path), df, self.files.digest(path), self.files.size(path))

    def meta(self, dataset_id: str) -> dict:
        return self.files.read_json(f"{self.folder(dataset_id)}/meta.json")

    def list(self) -> list[dict]:
        """Newest first."""
        return sorted(map(self.files.read_json, self.files.matching(f"{self.root}/datasets/*/meta.json")), key=lambda m: m["created"], reverse=True)

    def raw(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(dataset_id)}/raw")

    def typed(self, dataset_id: str) -> DataFrame:
        """Typed by the stored metadata; the four last used stay cached."""
        if dataset_id in self._typed:
            self._typed.move_to_end(dataset_id)
            return self._typed[dataset_id]
        meta = [typing.ColumnMeta(**m) for m in self.meta(dataset_id)["columns"]]
        df = typing.coerce_types(quality.normalize_placeholders(self.raw(dataset_id)), meta).persist()
        self._typed[dataset_id] = df
        if len(self._typed) > 4:
            self._typed.popitem(last=False)[1].unpersist()
        return df


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions beside their input columns, as CSV with a header; maps are left out."""
    df.select(*[c for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))]).write.mode("overwrite").option("header", True).csv(path)
