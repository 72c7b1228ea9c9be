"""Files to documents: kind by content, text by kind, repairs of broken encodings."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 500 * 1024 * 1024
#: Bytes that the kind of a file is read from.
HEAD = 8192
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Media types by kind (fixed values).
MEDIA = {"PDF": "application/pdf", "DOCX": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "XLSX": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "CSV": "text/csv", "TSV": "text/tab-separated-values", "JSON": "application/json", "MD": "text/markdown", "TXT": "text/plain"}


def kind_of(content: Column, path: Column) -> Column:
    """PDF, DOCX, XLSX, MD, CSV, TSV, JSON, TXT, or null for binary files of unknown kind.

    Text is valid UTF-8 without control characters in its first bytes, the last of which may be cut short.
    """
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.substring(content, 1, HEAD)
    cut = F.octet_length(head) == HEAD
    valid = lambda less: F.is_valid_utf8(F.substring(head, F.lit(1), F.octet_length(head) - less).cast("string"))
    utf8 = valid(0) | (cut & (valid(1) | valid(2) | valid(3)))
    clean = utf8 & ~F.decode(head, "ISO-8859-1").rlike(r"[\x00-\x08\x0E-\x1F]")
    start = F.hex(F.substring(content, 1, 4))
    zipped = F.when(ext.isin("xlsx", "xls"), "XLSX").when(ext.isin("csv", "tsv"), F.upper(ext)).otherwise("DOCX")
    return F.when(start == "25504446", "PDF").when(start == "504B0304", zipped).when(ext == "md", "MD").when(clean & ext.isin("csv", "tsv", "json"), F.upper(ext)).when(clean, "TXT")


def inspect(files: DataFrame) -> DataFrame:
    """path, kind, media type, size and fingerprint of readable files of at most 500 MB."""
    media = F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv))
    kinds = files.where(F.col("length") <= LIMIT).withColumn("kind", kind_of(F.col("content"), F.col("path"))).where("kind IS NOT NULL")
    return kinds.select("path", "kind", F.coalesce(media[F.col("kind")], F.lit("application/octet-stream")).alias("media_type"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("fingerprint"))


def repair(x: str) -> str:
    """Text that was decoded once too often by a Western code page, undone run by run, at most twice."""
    run = re.compile("(?:[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,3})+")

    def undo(m: re.Match) -> str:
        try:
            return bytes(b for ch in m[0] for b in (ch.encode("cp1252") if ord(ch) > 255 else ch.encode("latin-1"))).decode("utf-8")
        except UnicodeError:
            return m[0]

    for _ in range(2):
        new = run.sub(undo, x)
        if new == x:
            break
        x = new
    return x


def decode_bytes(raw: bytes) -> str:
    """UTF-8, else the Western code page; control characters go, composed form."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("cp1252", "replace")
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", repair(text))
    return unicodedata.normalize("NFC", text)


def docx_blocks(content: bytes) -> list[dict]:
    """Blocks (type, text, level, rows) in order. A table of two columns or more keeps its rows, those without a text left out;
    one of a single column is layout, and what its cells hold counts as any other content."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    text = lambda e: "".join("\t" if t.tag == f"{WORD}tab" else t.text or "" for t in e.iter() if t.tag in (f"{WORD}t", f"{WORD}tab"))
    out: list[dict] = []

    def walk(elements) -> None:
        for e in elements:
            if e.tag == f"{WORD}p" and text(e).strip():
                style = e.find(f"{WORD}pPr/{WORD}pStyle")
                name = (style.get(f"{WORD}val") if style is not None else "") or ""
                level = re.search(r"\d", name)
                head = "heading" in name.lower()
                out.append({"type": "heading" if head else "paragraph", "text": space_repair(text(e).strip()), "level": (int(level[0]) if level else 1) if head else None, "rows": None})
            elif e.tag == f"{WORD}tbl":
                rows = [r.findall(f"{WORD}tc") for r in e.findall(f"{WORD}tr")]
                if max(map(len, rows), default=0) >= 2:
                    grid = [[" ".join(filter(None, (space_repair(text(p).strip()) for p in c.iter(f"{WORD}p")))) for c in r] for r in rows]
                    filled = [r for r in grid if any(r)]
                    if filled:
                        out.append({"type": "table", "text": None, "level": None, "rows": filled})
                else:
                    for r in rows:
                        for c in r:
                            walk(c)

    walk(body if body is not None else ())
    return out


def docx_title(content: bytes) -> str | None:
    """The title among a document's core properties."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "docProps/core.xml" not in z.namelist():
            return None
        found = ElementTree.fromstring(z.read("docProps/core.xml")).find("{http://purl.org/dc/elements/1.1/}title")
    return (found.text or "").strip() or None if found is not None else None


def space_repair(x: str) -> str:
    """Blanks that run-in extraction lost: after colons but between digits, and between sentences."""
    x = re.sub(r"(?<!\d):(?=\S)|:(?=[^\s\d])", ": ", x)
    x = re.sub(r"(?<=[a-z)\]])([.!?])(?=[A-Z])", r"\1 ", x)
    return re.sub(r"[ \t]+", " ", re.sub(r"\s*\|\s*", " | ", x))


def pdf_text(content: bytes) -> str:
    """Literal strings of a PDF's content streams, for files with a simple text layer."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", content, re.S):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\\.|[^\]])*)\]\s*TJ", data):
            piece = s[0] or b"".join(re.findall(rb"\(((?:\\.|[^\\()])*)\)", s[1]))
            out.append(re.sub(rb"\\(.)", rb"\1", piece).decode("latin-1"))
    return "\n".join(out)


def is_readable(x: str) -> bool:
    raw = x.strip().encode()
    return len(raw) >= 20 and sum(32 <= b < 127 or b in (9, 10, 13) for b in raw) >= 0.7 * len(raw)


def pdf_pages(content: bytes) -> int:
    """Page objects of a PDF, at least one."""
    return max(1, len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", content)))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, text, meta_title, source_blocks (of DOCX files) and pages (of PDF files) of text, Markdown, DOCX and PDF
    files; a file is one row of a task's batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for path, kind, content in zip(files["path"], files["kind"], files["content"], strict=True):
                text, title, blocks, pages = None, None, None, None
                if kind == "DOCX":
                    title, blocks = docx_title(content), docx_blocks(content)
                    cells = lambda b: [c for r in b["rows"] for c in r if c]
                    text = "\n".join("\n".join(cells(b)) if b["type"] == "table" else b["text"] for b in blocks)
                elif kind == "PDF":
                    found = pdf_text(content)
                    text, pages = found if is_readable(found) else "", pdf_pages(content)
                else:
                    text = decode_bytes(content)
                rows.append((path, kind, text, title, blocks, pages))
            out = pd.DataFrame(rows, columns=["path", "kind", "text", "meta_title", "source_blocks", "pages"])
            yield out.astype({"pages": "Int32"})

    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= LIMIT)
    kinds = files.withColumn("kind", kind_of(F.col("content"), F.col("path"))).where(F.col("kind").isin("TXT", "MD", "DOCX", "PDF"))
    schema = "path string, kind string, text string, meta_title string, source_blocks array<struct<type:string,text:string,level:int,rows:array<array<string>>>>, pages int"
    return kinds.select("path", "kind", "content").mapInPandas(run, schema)
