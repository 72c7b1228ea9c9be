"""Tables from delimited text, JSON records and spreadsheets: every column text, headers made clean and unique."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")
COLUMNS, CELL = 256, 2000
RECORD_KEYS = ("data", "records", "rows", "items")
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def spread(df: DataFrame) -> DataFrame:
    """A table whose files give half as many splits as there are cores, or fewer, dealt over all cores; others as they are.

    Only small tables have so few splits, so what is shuffled stays small. Rows, not splits, are what the work grows with.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def clean_header(names: list[str | None]) -> list[str]:
    """Trimmed; blank ones numbered by place; repeated ones by count; at most 256."""
    out, seen = [], {}
    for i, name in enumerate(names[:COLUMNS]):
        base = clean_text(name or "").strip() or f"column_{i + 1}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def clean_text(x: str) -> str:
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", x)


#: What bytes 80 to 9F stand for in the Western code page; five stand for nothing (fixed value).
WESTERN = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def decoded(c: Column) -> Column:
    """A cell that was read byte by byte (ISO-8859-1) as UTF-8 where it is that, else by the Western code page."""
    text = F.encode(c, "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.translate(c, "".join(map(chr, range(0x80, 0xA0))), WESTERN))


def decode_bytes(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def clean_cell(c: Column) -> Column:
    """Control characters but tab and line ends dropped, cut to 2000 characters, null as empty."""
    return F.left(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), F.lit(CELL))


def sniff(line: str) -> str:
    """The most frequent delimiter of the first line, earlier ones first on ties, else a comma."""
    counts = [line.count(d) for d in DELIMITERS]
    return DELIMITERS[counts.index(max(counts))] if max(counts) else ","


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All columns as text. Only the first line comes to the driver, for the delimiter and the header.

    Files are read byte by byte and decoded by cell, since one cell may be in another code page than the next.
    """
    first = spark.read.option("encoding", "ISO-8859-1").text(path).where("trim(value) <> ''").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "column_1 string")
    sep = delimiter or sniff(first[0].value)
    raw = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").option("inferSchema", False).option("encoding", "ISO-8859-1")
    header = raw.option("header", False).csv(path).first()
    names = clean_header([decode_bytes((x or "").encode("iso-8859-1")) for x in header])
    body = raw.option("header", True).csv(path)
    body = body.toDF(*[f"_{i}" for i in range(len(body.columns))]).select(*(clean_cell(decoded(F.col(f"_{i}"))).alias(n) for i, n in enumerate(names)))
    return body.where(F.concat(*(F.trim(F.col(f"`{n}`")) for n in names)) != "")


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of objects, bare or under data, records, rows or items; nested values as JSON text, null as empty.

    Columns stand in the order in which keys are first seen; only their names come to the driver. What isn't an object
    is skipped. A file is one row until its records are apart.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    listed = F.coalesce(*(F.get_json_object("value", f"$.{k}") for k in RECORD_KEYS))
    records = files.select("file", F.posexplode(F.from_json(F.when(F.col("value").startswith("["), F.col("value")).otherwise(listed), "array<string>")).alias("nth", "record"))
    records = records.withColumn("keys", F.json_object_keys("record")).where("keys IS NOT NULL")
    seen = records.select("file", "nth", F.posexplode("keys").alias("at", "key")).groupBy("key").agg(F.min(F.struct("file", "nth", "at")).alias("first"))
    keys = [r["key"] for r in seen.orderBy("first").limit(COLUMNS).collect()]
    if not keys:
        return spark.createDataFrame([], "column_1 string")
    cells = records.select(F.from_json("record", "map<string,string>").alias("m"))
    return cells.select(*(clean_cell(F.element_at("m", F.lit(k))).alias(n) for k, n in zip(keys, clean_header(keys), strict=True)))


def column_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return max(n - 1, 0)


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """Rows of a workbook's first sheet, gaps filled, dates as their serial numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for row in ElementTree.fromstring(z.read(sheets[0])).iter(f"{SHEET}row"):
            cells: list[str] = []
            for c in row.iter(f"{SHEET}c"):
                at = column_index(c.get("r", "")) if c.get("r") else len(cells)
                if at >= COLUMNS:
                    break
                cells += [""] * (at + 1 - len(cells))
                value, kind = c.find(f"{SHEET}v"), c.get("t")
                if kind == "s" and value is not None:
                    cells[at] = shared[int(value.text)]
                elif kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                elif value is not None:
                    cells[at] = value.text or ""
            yield cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, names, cells map): one row a data row of each workbook, a file a task; the header names the cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for where, content in zip(files["path"], files["content"], strict=True):
                rows = [r for r in sheet_rows(content) if any(x.strip() for x in r)]
                if rows:
                    names = clean_header(rows[0])
                    maps = [dict(zip(names, [clean_text(x)[:CELL] for x in r[: len(names)]] + [""] * (len(names) - len(r)), strict=True)) for r in rows[1:]]
                    yield pd.DataFrame({"path": where, "row": range(1, len(maps) + 1), "names": [names] * len(maps), "cells": maps})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, names array<string>, cells map<string,string>")


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """One workbook as a table, in the order of its header; only the header comes to the driver."""
    rows = read_workbooks(spark, path)
    first = rows.select("names").first()
    if first is None:
        return spark.createDataFrame([], "column_1 string")
    return rows.select(*(F.coalesce(F.element_at("cells", F.lit(n)), F.lit("")).alias(n) for n in first["names"]))


def measured(df: DataFrame, cap: int | None = None) -> DataFrame:
    """One row: row_count, kept (rows that a reader with a cap would keep), truncated."""
    kept = F.col("row_count") if cap is None else F.least(F.col("row_count"), F.lit(cap))
    return df.agg(F.count("*").alias("row_count")).select("row_count", kept.cast("bigint").alias("kept")).withColumn("truncated", F.col("kept") < F.col("row_count"))
