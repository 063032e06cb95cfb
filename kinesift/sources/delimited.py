"""CSV with line breaks inside quoted fields, read by as many tasks as the files have splits.

A line break ends a record where the quotes before it, counted from the start of the file, are even. A task cannot know
that count for its split, so it first takes stock of the split under both answers: its number of quotes, and how many
records begin in it after an even and after an odd count. These rows, one per split, are added up along each file and
tell every split where it stands. Records inside a split are then put together by its task; only the pieces of
records that lie across a border of splits are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(pc.fill_null(values, ""), '"').to_numpy(zero_copy_only=False)


def _stock(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, src, block) in order -> per split: quotes odd, records begun after even and after odd counts."""
    done: list[tuple] = []
    at, odd, starts = None, 0, [0, 0]
    for batch in batches:
        counts = _quotes(batch.column(0))
        places = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        edges = [0, *[i for i in range(1, len(places)) if places[i] != places[i - 1]], len(places)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if places[a] != at:
                if at:
                    done.append((*at, odd == 1, *starts))
                at, odd, starts = places[a], 0, [0, 0]
            before = (odd + np.concatenate([[0], np.cumsum(counts[a:b])])) % 2
            starts = [starts[0] + int((before[:-1] == 0).sum()), starts[1] + int((before[:-1] == 1).sum())]
            odd = int(before[-1])
    if at:
        done.append((*at, odd == 1, *starts))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["src", "block", "odd", "after_even", "after_odd"])


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, src, block, inside, begun) in order -> (src, record, block, text, whole)."""
    at, odd, number, here, lines = None, 0, 0, True, []
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["src", "record", "block", "text", "whole"]
        )

    for batch in batches:
        out = []
        columns = [c.to_pylist() for c in batch.columns]
        for value, src, block, inside, begun, quotes in zip(*columns, (_quotes(batch.column(0)) % 2).tolist(), strict=True):
            if (src, block) != at:
                if lines:
                    out.append((at[0], number, at[1], "\n".join(lines), False))
                at, odd, number, here, lines = (src, block), int(inside), begun - 1, False, []
            if not odd:
                number, here = number + 1, True
            lines.append(value)
            odd ^= quotes
            if not odd:
                out.append((src, number, block, "\n".join(lines), here))
                lines = []
        yield packed(out)
    if lines:
        yield packed([(at[0], number, at[1], "\n".join(lines), False)])


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(src, record, text): the records of quoted text files, numbered per file from 0; quotes must be doubled inside fields."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("block")
    )
    stock = lines.mapInArrow(_stock, "src string, block long, odd boolean, after_even long, after_odd long")
    earlier = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = stock.select("*", F.coalesce(F.sum(F.col("odd").cast("int")).over(earlier) % 2 == 1, F.lit(False)).alias("inside"))
    begins = F.when(F.col("inside"), F.col("after_odd")).otherwise(F.col("after_even"))
    numbered = known.select("src", "block", "inside", begins.alias("begins"))
    offsets = numbered.select("src", "block", "inside", F.coalesce(F.sum("begins").over(earlier), F.lit(0)).alias("begun"))
    # One row per split: the splits of a job are listed by the driver anyway.
    placed = lines.join(F.broadcast(offsets), ["src", "block"]).select("value", "src", "block", "inside", "begun")
    found = placed.mapInArrow(_records, "src string, record long, block long, text string, whole boolean")
    pieces = F.array_sort(F.collect_list(F.struct("block", "text")))
    across = found.filter(~F.col("whole")).groupBy("src", "record").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
    return found.filter("whole").select("src", "record", "text").unionByName(across)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of CSV files with a header, with the columns of ``schema`` in the files' order. Blank records are skipped.

    Quotes are doubled inside quoted fields, which may hold any text, line breaks too. A file of any size is read by
    many tasks.
    """
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    records = read_records(spark, path).filter((F.col("record") > 0) & (F.col("text").rlike(r"\S")))
    # A carriage return before the last line break belongs to the break.
    text = F.regexp_replace("text", r"\r\z", "")
    return records.select(F.from_csv(text, ddl, {"escape": '"'}).alias("_row")).select("_row.*")
