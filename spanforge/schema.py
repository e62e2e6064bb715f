"""Schemas and fixed dimensions of the graph tables."""

from __future__ import annotations

from pyspark.sql import types as T

FUNCTION, FILE, MODULE, DIRECTORY, TYPE, DATA, MACRO, FIELD, CONTENT = range(1, 10)
REFS, HAS = 1, 2

#: id: (name, verb, level, whether a dot separates path labels)
SYMBOL_TYPES = {
    FUNCTION: ("function", "func", 2, True),
    FILE: ("file", "file", 3, False),
    MODULE: ("module", "mod", 4, True),
    DIRECTORY: ("directory", "dir", 5, False),
    TYPE: ("type", "type", 2, True),
    DATA: ("data", "data", 2, True),
    MACRO: ("macro", "macro", 2, True),
    FIELD: ("field", "field", 1, True),
    CONTENT: ("content", "content", 1, True),
}
VERB_TYPES = {verb: i for i, (_, verb, _, _) in SYMBOL_TYPES.items() if i != CONTENT} | {"method": FIELD}
INSTANCE_TYPES = dict(enumerate(("definition", "declaration", "expansion", "sentinel", "containment", "source", "header", "build", "file", "documentation"), 1))

#: id of the rows that no request may ever see
CANARY = -999999


def _schema(**fields: str) -> T.StructType:
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "str": T.StringType(), "bytes": T.BinaryType(), "path": T.ArrayType(T.StringType()), "bool": T.BooleanType(), "time": T.TimestampType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields.items()])


TABLES = {
    "projects": _schema(id="int", project_name="str", root_path="str", upload_status="str", symbol_chunks_total="int", object_chunks_total="int", root_layer_id="long"),
    "objects": _schema(id="long", project_id="int", module_path="str", filesystem_path="str", filetype="str", content_hash="str", layer="long"),
    "object_contents": _schema(object_id="long", content="bytes"),
    "content_store": _schema(content_hash="str", content="bytes", content_text="str"),
    "symbols": _schema(id="long", name="str", symbol_path="path", project_id="int", symbol_type="int", symbol_scope="int", leaf_name="str", layer="long"),
    "symbol_instances": _schema(id="long", symbol="long", object_id="long", start="int", end="int", instance_type="int", layer="long"),
    "symbol_refs": _schema(id="long", to_symbol="long", from_object="long", start="int", end="int", layer="long"),
    "chunks": _schema(project_id="int", kind="str", seq="int"),
}

#: tables with a column for the layer that a row belongs to
LAYERED = ("objects", "symbols", "symbol_instances", "symbol_refs")
