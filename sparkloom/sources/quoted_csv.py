"""CSV files with line breaks inside quotes, read in parallel pieces.

Whether a piece of a file begins inside quotes is known from the number of quotes before
it: one aggregate counts them by piece, and the parities add up along the file. Each
task then joins the lines of its pieces to records. Records that cross the end of a piece
leave fragments, at most two a piece, which are put together afterwards. Line ends inside
quotes stay as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pieces whose state the driver holds at most; at 128 MB a piece this is 128 TB.
PIECES = 1 << 20
#: Kinds of rows: a whole record, the end of one begun before the piece, the inside of one, the beginning of one, and the beginning of a file's header.
WHOLE, HEAD, MIDDLE, TAIL, HEADER = range(5)


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(value, file, piece) in the order of the files; lines end with a line feed, and a carriage return before it stays."""
    value = F.make_valid_utf8("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.option("lineSep", "\n").text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"))


def quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _joined(open_pieces: set[tuple[str, int]]):
    """(file, piece, kind, text) of the lines' records and fragments. Headers are left out."""

    def run(batches):
        at, state, first, held = None, 0, False, []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def emit(kind: int, text: str) -> None:
            for column, v in zip(out, (*at, kind, text)):
                column.append(v)

        def ended() -> None:
            """The piece ends inside a record."""
            if held:
                emit(MIDDLE if began else HEADER if first else TAIL, "\n".join(held))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["file", "piece", "kind", "text"])
            for column in out:
                column.clear()
            return batch

        began = False  # whether what is held began before the piece
        for batch in batches:
            files, pieces = batch.column("file").to_pylist(), batch.column("piece").to_numpy()
            lines = batch.column("value")
            odd = (pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1).astype(np.int64)
            new = [k for k in range(batch.num_rows) if k == 0 or pieces[k] != pieces[k - 1] or files[k] != files[k - 1]]
            for start, end in zip(new, [*new[1:], batch.num_rows]):
                if at != (files[start], int(pieces[start])):
                    ended() if at else None
                    at = (files[start], int(pieces[start]))
                    state, held, first = int(at in open_pieces), [], at[1] == 0
                    began = bool(state)
                inside = (state + np.cumsum(odd[start:end])) & 1
                texts = lines.slice(start, end - start).to_pylist()
                for text, still in zip(texts, inside):
                    if still:
                        held.append(text)
                        continue
                    whole = "\n".join([*held, text]) if held else text
                    kind = HEAD if began else WHOLE
                    began, held = False, []
                    if first:
                        first = False  # the header
                    elif whole not in ("", "\r") or kind == HEAD:
                        emit(kind, whole)
                state = int(inside[-1]) if len(inside) else state
            yield flush()
        if at:
            ended()
            yield flush()

    return run


def records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(text): the records of all files, without each file's first one."""
    lines = _lines(spark, path, encoding)
    parity = lines.groupBy("file", "piece").agg((F.sum(quotes(F.col("value"))) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    states = parity.select("file", "piece", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("inside"))
    found = states.where("inside = 1").select("file", "piece").limit(PIECES + 1).collect()
    if len(found) > PIECES:
        raise ValueError(f"more than {PIECES} pieces begin inside quotes; read the files in parts")
    parts = lines.mapInArrow(_joined({(r["file"], r["piece"]) for r in found}), "file string, piece long, kind int, text string")
    order = Window.partitionBy("file").orderBy("piece", "kind")  # at most two rows a piece
    chained = parts.where(F.col("kind") != WHOLE).withColumn("chain", F.sum(F.col("kind").isin(TAIL, HEADER).cast("int")).over(order))
    fragment = F.struct("piece", "kind", "text")
    crossing = chained.groupBy("file", "chain").agg(F.array_sort(F.collect_list(fragment)).alias("f")).where(F.col("f")[0]["kind"] != HEADER)
    return parts.where(F.col("kind") == WHOLE).select("text").unionByName(crossing.select(F.array_join(F.transform("f", lambda x: x["text"]), "\n").alias("text")))


def improper(record: Column, sep: str) -> Column:
    """Whether a record has quotes that neither open nor close a field, so that counting them says nothing."""
    s = re.escape(sep)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(record, "\r$", ""), '""', ""), '"[^"]*+"', "\x01")
    return bare.rlike(f'"|[^{s}\x01]\x01|\x01[^{s}\x01]')


def parse(found: DataFrame, names: list[str], sep: str) -> DataFrame:
    """Fields of records as strings."""
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    fields = F.from_csv(F.regexp_replace("text", "\r$", ""), schema, {"sep": sep, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "maxCharsPerColumn": "-1"})
    return found.select(fields.alias("r")).select(*[F.col(f"r.c{k}").alias(n) for k, n in enumerate(names)])
