"""Index files of an indexer: protobuf messages, decoded without a compiler or a package.

``read`` takes a file with one project, or a folder with ``project.pb`` and any number of ``contents-*.pb``, to rows of
``ingest.CHUNK``.  Each file is decoded in one task; symbols and objects are cut into chunks of the usual size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources.ingest import CHUNK

SYMBOLS_A_CHUNK, OBJECTS_A_CHUNK, CONTENTS_A_CHUNK = 1000, 100, 100
#: field numbers of each message: (name, kind); a kind is "int", "text", "bytes" or another message
_INSTANCE = {1: ("symbol_local_id", "int"), 2: ("instance_type", "int"), 3: ("start_offset", "int"), 4: ("end_offset", "int")}
_REF = {1: ("to_symbol_local_id", "int"), 2: ("from_offset_start", "int"), 3: ("from_offset_end", "int")}
_OBJECT = {
    1: ("local_id", "int"),
    3: ("module_path", "text"),
    4: ("filesystem_path", "text"),
    5: ("filetype", "text"),
    6: ("content", "bytes"),
    7: ("symbol_instances", _INSTANCE),
    8: ("refs", _REF),
    9: ("content_hash", "text"),
}
_SYMBOL = {1: ("local_id", "int"), 2: ("name", "text"), 3: ("scope", "int"), 4: ("type", "int")}
PROJECT = {1: ("project_name", "text"), 2: ("root_path", "text"), 4: ("objects", _OBJECT), 5: ("symbols", _SYMBOL)}
CONTENTS = {1: ("contents", {1: ("content_hash", "text"), 2: ("content", "bytes")})}
_DEFAULT = {"int": 0, "text": "", "bytes": b""}


def _varint(raw: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("a number is cut off")
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def decode(raw: "bytes | memoryview", message: dict) -> dict:
    """The fields of a message; absent ones have their default, unknown ones are skipped."""
    raw = memoryview(raw)
    out = {name: [] if isinstance(kind, dict) else _DEFAULT[kind] for name, kind in message.values()}
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(raw, at)
        elif wire in (1, 5):
            value, at = None, at + (8 if wire == 1 else 4)
        elif wire == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} is not known")
        if at > len(raw):
            raise ValueError("a field is cut off")
        name, kind = message.get(number, (None, None))
        if name is None:
            continue
        if isinstance(kind, dict):
            out[name].append(decode(value, kind))
        elif kind == "int":
            out[name] = value - (1 << 64) if value >> 63 else value
        else:
            out[name] = bytes(value) if kind == "bytes" else str(value, "utf-8", "replace")
    return out


def _cut(rows: list, size: int) -> Iterator[tuple[int, list]]:
    for seq, lo in enumerate(range(0, len(rows), size)):
        yield seq, rows[lo : lo + size]


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    binary = spark.read.format("binaryFile")
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(at).isDirectory():
        return binary.load(path), None
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/project.pb")):
        raise FileNotFoundError(f"{path}/project.pb")
    return binary.load(f"{path}/project.pb"), binary.option("pathGlobFilter", "contents-*.pb").load(path)


def _numbers(spark: SparkSession, path: str) -> dict[str, int]:
    """A number for each file of contents of a folder, in order of their names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/contents-*.pb")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return {name: k for k, name in enumerate(sorted(f.getPath().getName() for f in found))}


def read(spark: SparkSession, path: str, project_id: int, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks, and the row of the project for ``ingest.ingest``."""
    project, contents = _files(spark, path)
    columns = ["project_id", "kind", "seq", "symbols", "objects", "contents", "batch"]

    def rows(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                found = decode(raw, PROJECT)
                out = [(project_id, "symbols", k, part, None, None, 0) for k, part in _cut(found["symbols"], SYMBOLS_A_CHUNK)]
                out += [(project_id, "objects", k, None, [x | {"content": x["content"] or None} for x in part], None, 0) for k, part in _cut(found["objects"], OBJECTS_A_CHUNK)]
                yield pd.DataFrame(out, columns=columns)

    def texts(batches):
        for pdf in batches:
            for at, raw in zip(pdf["path"], pdf["content"]):
                # a number for each file and part: seq counts the parts of a file in the low 16 bits
                base = number[at.rsplit("/", 1)[-1]] << 16
                yield pd.DataFrame([(project_id, "contents", base + k, None, None, part, 0) for k, part in _cut(decode(raw, CONTENTS)["contents"], CONTENTS_A_CHUNK)], columns=columns)

    def head(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                found = decode(raw, {k: PROJECT[k] for k in (1, 2)} | {4: ("objects", {}), 5: ("symbols", {})})
                yield pd.DataFrame([(project_id, name or found["project_name"], found["root_path"], -(-len(found["symbols"]) // SYMBOLS_A_CHUNK), -(-len(found["objects"]) // OBJECTS_A_CHUNK))], columns=["id", "project_name", "root_path", "symbol_chunks_total", "object_chunks_total"])

    chunks = project.select("content").mapInPandas(rows, CHUNK)
    if contents is not None:
        number = _numbers(spark, path)
        chunks = chunks.unionByName(contents.select("path", "content").mapInPandas(texts, CHUNK))
    return chunks, project.select("content").mapInPandas(head, "id int, project_name string, root_path string, symbol_chunks_total int, object_chunks_total int").withColumn("id", F.col("id").cast("int"))
