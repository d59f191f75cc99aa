"""Files of many kinds as rows of (path, part, kind, content, error), zip members included, and delimited tables.

Paths and sizes are listed by Spark; each file, and each member of an archive, is a row that is read and parsed in a task of
its own, so an archive with very many members is many tasks' work. What can't be read is a row with its error, never a
failed job. Content is JSON text for what has structure (records of json, jsonl, delimited and xml files) and plain text
otherwise, cut at `max_chars` with a note of the whole length.

Formats that need packages which aren't here (office documents, PDF) are rows with an error.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from netquarry.sources.captures import _opened

MAX_CHARS = 100_000
SNIFFED = 1024  # characters from which a delimiter is told
_MEMBERS = "path string, member string, size long"
_ROWS = "path string, part string, kind string, content string, error string"
TEXT, TABLES = {"txt", "py", "pdb", "md", "log"}, {"csv", "tsv"}


def decoded(data: bytes) -> str:
    """UTF-8 without a byte-order mark, else GBK, else Latin-1."""
    for encoding in ("utf-8-sig", "gbk"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def sniffed(text: str) -> str:
    """The delimiter of a table's first lines, a comma if none stands out."""
    try:
        return csv.Sniffer().sniff(text[:SNIFFED], ",;\t|:").delimiter
    except csv.Error:
        return ","


def records(text: str) -> list[dict]:
    return [dict(r) for r in csv.DictReader(io.StringIO(text), delimiter=sniffed(text))]


def _tree(node: ElementTree.Element) -> dict:
    out: dict = {"@attributes": node.attrib} if node.attrib else {}
    if text := (node.text or "").strip():
        out["#text"] = text
    for child in node:
        value = _tree(child)
        if child.tag not in out:
            out[child.tag] = value
        elif isinstance(out[child.tag], list):
            out[child.tag].append(value)
        else:
            out[child.tag] = [out[child.tag], value]
    return out


def content(kind: str, data: bytes, max_chars: int) -> str:
    """What a file of a kind says, as text or JSON, cut at max_chars."""
    text = decoded(data)
    if kind in ("json", "jsonld"):
        text = json.dumps(json.loads(text), ensure_ascii=False)
    elif kind == "jsonl":
        text = json.dumps([json.loads(line) for line in text.splitlines() if line.strip()], ensure_ascii=False)
    elif kind in TABLES:
        text = json.dumps(records(text), ensure_ascii=False)
    elif kind == "xml":
        if "<!DOCTYPE" in text or "<!ENTITY" in text:
            raise ValueError("documents with entities aren't read")
        root = ElementTree.fromstring(text)
        text = json.dumps({"root_tag": root.tag, "content": _tree(root)}, ensure_ascii=False)
    elif kind not in TEXT:
        raise ValueError(f"unsupported file format: .{kind}")
    return text if len(text) <= max_chars else f"{text[:max_chars]}\n... (truncated, original length: {len(text)} chars)"


def _kind(name: str) -> str:
    return name.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_files(spark: SparkSession, folder: str, pattern: str = "*", max_chars: int = MAX_CHARS) -> DataFrame:
    """One row for each file below folder, and for each member of its archives (part: the member's name)."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")
    member_type = to_arrow_schema(spark.createDataFrame([], _MEMBERS).schema)
    row_type = to_arrow_schema(spark.createDataFrame([], _ROWS).schema)

    def members(paths: list[str], sizes: list[int]) -> Iterator[tuple]:
        for path, size in zip(paths, sizes, strict=True):
            if _kind(path) != "zip":
                yield path, None, size
                continue
            try:
                with _opened(path) as f, zipfile.ZipFile(f) as archive:
                    for info in archive.infolist():
                        if not info.is_dir():
                            yield path, info.filename, info.file_size
            except (zipfile.BadZipFile, OSError, ValueError):
                yield path, "", 0

    def one(path: str, member: str | None) -> tuple:
        kind = _kind(member or path)
        try:
            with _opened(path) as f:
                if member is None:
                    data = f.read()
                else:
                    with zipfile.ZipFile(f) as archive:
                        data = archive.read(member)
            return path, member, kind, content(kind, data, max_chars), None
        except Exception as e:  # whatever is wrong with a file is its row
            return path, member or None, kind, None, f"{type(e).__name__}: {e}"[:500]

    def list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(members(*(c.to_pylist() for c in batch.columns)), member_type)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches((one(p, m) for p, m, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True)), row_type)

    found = listed.repartition("path").mapInArrow(list_members, _MEMBERS)
    return found.repartition("path", "member").mapInArrow(read, _ROWS)


def write_archives(rows: DataFrame, folder: str, archive: str, name: str, text: str) -> None:
    """Zip archives from (archive, name, text): one task writes an archive, as it is one stream of bytes; a task that runs again
    writes the same file again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        system, inside = fs.FileSystem.from_uri(uri)
        system.create_dir(inside, recursive=True)
        key, out, target, n = None, None, None, 0
        for batch in batches:
            for k, member, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if target:
                        target.close()
                        out.close()
                    key, n = k, n + 1
                    out = system.open_output_stream(f"{inside}/{k}")
                    target = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                target.writestr(zipfile.ZipInfo(member), value or "")
        if target:
            target.close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["files"])

    dealt = rows.select(archive, name, text).repartition(archive).sortWithinPartitions(archive, name)
    dealt.mapInArrow(write, "files long").agg(F.sum("files")).collect()
