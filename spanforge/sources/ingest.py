"""Uploads: messages of an indexer to rows of the graph tables.

An upload comes in chunks of symbols, of objects (with their occurrences and
references) and of file contents.  Chunks are rows (``project_id``, ``kind``,
``seq``, ``batch``, payload columns).  A chunk may come again, also with other
content: the one of the smallest ``batch`` (order of arrival) counts, whole, for
all tables; of several in one batch, one is taken by the hash of its content.  So
an upload may be repeated or resumed at any place.  A project is complete once it
has as many chunks as announced.

Ids follow from the project and the number that the indexer gave: the project in
the high bits, 32 bits for the number.  What can't be stored is left out together
with what hangs on it, and counted by ``rejected``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import names, paths
from spanforge.schema import CONTENT, INSTANCE_TYPES, SYMBOL_TYPES, TABLES

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType()}
#: bits of the number of a symbol or an object in its project
LOCAL_BITS = 32


def _rows(**fields: "str | T.DataType") -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, _KINDS[k] if isinstance(k, str) else k) for n, k in fields.items()]))


SYMBOL = _rows(local_id="long", name="string", scope="int", type="int")
OBJECT = _rows(
    local_id="long",
    module_path="string",
    filesystem_path="string",
    filetype="string",
    content="binary",
    content_hash="string",
    symbol_instances=_rows(symbol_local_id="long", instance_type="int", start_offset="int", end_offset="int"),
    refs=_rows(to_symbol_local_id="long", from_offset_start="int", from_offset_end="int"),
)
CHUNK = _rows(project_id="int", kind="string", seq="int", symbols=SYMBOL, objects=OBJECT, contents=_rows(content_hash="string", content="binary"), batch="long").elementType


def first_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each (project, kind, seq): the chunk that came first."""
    for name in ("symbols", "objects", "contents"):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast(CHUNK[name].dataType))
    if "batch" not in chunks.columns:
        chunks = chunks.withColumn("batch", F.lit(0).cast("long"))
    payload = [c for c in ("symbols", "objects", "contents")]
    order = F.struct(F.coalesce("batch", F.lit(0)), F.xxhash64(*payload))
    return chunks.groupBy("project_id", "kind", "seq").agg(F.min_by(F.struct(*payload), order).alias("p")).select("project_id", "kind", "seq", "p.*")


def root_layer(project: str = "project_id") -> Column:
    return F.col(project).cast("long") + 1000000


def wide_id(project: str, local: str) -> Column:
    """The id of a symbol or an object: collisions are impossible for numbers of ``LOCAL_BITS`` bits."""
    return F.shiftleft(F.col(project).cast("long"), LOCAL_BITS).bitwiseOR(F.col(local))


def _fits(local: str) -> Column:
    return F.coalesce(F.col(local).between(0, (1 << LOCAL_BITS) - 1), F.lit(False))


def _first_of(rows: DataFrame) -> Column:
    """Of several rows with one number, the first by chunk and place."""
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy("project_id", "local_id").orderBy("seq", "pos")) == 1


def _sent_symbols(chunks: DataFrame) -> DataFrame:
    s = first_chunks(chunks.where("kind = 'symbols'")).select("project_id", "seq", F.posexplode("symbols").alias("pos", "s")).select("project_id", "seq", "pos", "s.*")
    typed = F.coalesce(F.col("type").isin([t for t in SYMBOL_TYPES if t != CONTENT]), F.lit(False))
    return s.withColumn("ok", _fits("local_id") & typed & F.col("name").isNotNull() & _first_of(s))


def symbols(chunks: DataFrame) -> DataFrame:
    """Symbol rows; of one number the first."""
    s = _sent_symbols(chunks).where("ok").withColumn("path", names.path_column(F.col("name"), F.col("type")))
    return s.select(
        wide_id("project_id", "local_id").alias("id"),
        "name",
        F.col("path").alias("symbol_path"),
        "project_id",
        F.col("type").alias("symbol_type"),
        F.when(F.col("scope") != 0, F.col("scope")).alias("symbol_scope"),
        names.leaf_column(F.col("path")).alias("leaf_name"),
        root_layer().alias("layer"),
    )


def _sent_objects(chunks: DataFrame) -> DataFrame:
    o = first_chunks(chunks.where("kind = 'objects'")).select("project_id", "seq", F.posexplode("objects").alias("pos", "o")).select("project_id", "seq", "pos", "o.*")
    own = F.when(F.length("content") > 0, F.sha2("content", 256))
    sent = F.when(F.col("content_hash") != "", F.col("content_hash"))
    # an object without content of its own refers to a content by hash, or is empty
    o = o.withColumns({"digest": F.coalesce(own, sent, F.when(F.col("content").isNotNull(), F.sha2("content", 256)), F.lit("")), "raw_path": F.trim(F.coalesce("filesystem_path", F.lit("")))})
    ok = _fits("local_id") & F.startswith("raw_path", F.lit("/")) & F.coalesce(own == sent, F.lit(True)) & _first_of(o)
    return o.withColumns({"ok": ok, "filesystem_path": paths.normal_column(F.col("raw_path")), "id": wide_id("project_id", "local_id")}).drop("raw_path", "content_hash")


def _merged(sent: DataFrame) -> DataFrame:
    """Objects of one path are one object: the first one's id, the last one's attributes; and the ids of the others."""
    order = F.struct("seq", "pos")
    good = sent.where("ok").withColumns({"module_path": F.coalesce("module_path", F.lit("")), "filetype": F.coalesce("filetype", F.lit("file"))})
    return good.groupBy("project_id", "filesystem_path").agg(F.min_by("id", order).alias("id"), F.max_by(F.struct("module_path", "filetype", "digest"), order).alias("a"), F.collect_list("id").alias("ids"))


def objects(chunks: DataFrame) -> DataFrame:
    return _merged(_sent_objects(chunks)).select("id", "project_id", "a.module_path", "filesystem_path", "a.filetype", F.col("a.digest").alias("content_hash"), root_layer().alias("layer"))


def _placed(chunks: DataFrame, field: str) -> DataFrame:
    """Rows of the objects that are stored (``object_id``), also of those that were merged into another."""
    sent = _sent_objects(chunks)
    merged = _merged(sent).where(F.size("ids") > 1).select(F.col("id").alias("object_id"), F.explode("ids").alias("id"))
    rows = sent.where("ok").select("project_id", "id", F.explode(field).alias("r")).select("project_id", "id", "r.*")
    return rows.join(merged, "id", "left").withColumn("object_id", F.coalesce("object_id", "id")).drop("id")


def _span(lo: str, hi: str) -> list:
    empty = F.col(lo) >= F.col(hi)
    return [F.when(empty, 0).otherwise(F.col(lo)).cast("int").alias("start"), F.when(empty, 0).otherwise(F.col(hi)).cast("int").alias("end")]


def _kind_of(instance_type: Column) -> Column:
    """The type of an occurrence: a definition, if none is given."""
    return F.when(F.coalesce(instance_type, F.lit(0)) == 0, 1).otherwise(instance_type)


def _good_site(symbol: str, lo: str, hi: str) -> Column:
    return _fits(symbol) & F.col(lo).isNotNull() & F.col(hi).isNotNull()


def symbol_instances(chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Occurrences of the symbols that are stored (``known``: rows with their ``id``; else those of the upload)."""
    i = _placed(chunks, "symbol_instances").where(_good_site("symbol_local_id", "start_offset", "end_offset")).withColumn("instance_type", _kind_of(F.col("instance_type"))).where(F.col("instance_type").isin(list(INSTANCE_TYPES)))
    rows = i.select(wide_id("project_id", "symbol_local_id").alias("symbol"), "object_id", *_span("start_offset", "end_offset"), "instance_type", root_layer().alias("layer"))
    rows = rows.join((symbols(chunks) if known is None else known).select(F.col("id").alias("symbol")), "symbol", "left_semi")
    rows = rows.groupBy("symbol", "object_id", "start", "end", "layer").agg(F.min("instance_type").alias("instance_type"))
    return rows.select(_row_id(["symbol", "object_id", "start", "end"]).alias("id"), "symbol", "object_id", "start", "end", "instance_type", "layer")


def symbol_refs(chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    r = _placed(chunks, "refs").where(_good_site("to_symbol_local_id", "from_offset_start", "from_offset_end"))
    rows = r.select(wide_id("project_id", "to_symbol_local_id").alias("to_symbol"), F.col("object_id").alias("from_object"), *_span("from_offset_start", "from_offset_end"), root_layer().alias("layer")).distinct()
    rows = rows.join((symbols(chunks) if known is None else known).select(F.col("id").alias("to_symbol")), "to_symbol", "left_semi")
    return rows.select(_row_id(["to_symbol", "from_object", "start", "end"]).alias("id"), "to_symbol", "from_object", "start", "end", "layer")


def _row_id(key: list[str]) -> Column:
    """A positive id that follows from the row's own key, so that a repeated upload gives the same."""
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << 62) - 1)) + 1


def _contents(chunks: DataFrame) -> DataFrame:
    sent = first_chunks(chunks.where("kind = 'contents'")).select("project_id", F.explode("contents").alias("c")).select("project_id", "c.content_hash", "c.content")
    inline = _sent_objects(chunks).where("ok AND content IS NOT NULL AND digest = sha2(content, 256)").select("project_id", F.col("digest").alias("content_hash"), "content")
    return sent.unionByName(inline)


def content_store(chunks: DataFrame) -> DataFrame:
    """Each content once, if its hash is right; ``content_text`` where it is UTF-8."""
    c = _contents(chunks).where("content_hash = sha2(content, 256)").select("content_hash", "content").dropDuplicates(["content_hash"])
    return c.withColumn("content_text", F.expr("try_validate_utf8(CAST(content AS STRING))"))


def rejected(chunks: DataFrame) -> DataFrame:
    """Counts of what an upload holds that can't be stored: ``project_id``, ``symbols``, ``objects``, ``contents``.

    Symbols of an unknown type, without a name, with a number beyond 32 bits or one that another has; objects with such a
    number, a path that isn't absolute or a hash that isn't their content's; contents of another hash.
    """
    none = F.lit(0).cast("long")
    bad = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    parts = [bad(_sent_symbols(chunks).where("NOT ok"), "symbols"), bad(_sent_objects(chunks).where("NOT ok"), "objects"), bad(_contents(chunks).where("NOT coalesce(content_hash = sha2(content, 256), false)"), "contents")]
    out = parts[0].join(parts[1], "project_id", "full").join(parts[2], "project_id", "full")
    return out.select("project_id", *[F.coalesce(n, none).alias(n) for n in ("symbols", "objects", "contents")])


def missing_hashes(hashes: DataFrame, store: DataFrame) -> DataFrame:
    """Hashes (``content_hash``) that the store doesn't have: the contents worth sending."""
    return hashes.select("content_hash").distinct().join(store.select("content_hash"), "content_hash", "left_anti")


def ingest(chunks: DataFrame, projects: DataFrame) -> dict[str, DataFrame]:
    """All tables of an upload.  ``projects``: id, project_name, root_path, symbol_chunks_total, object_chunks_total."""
    sent = chunks.where(F.col("kind").isin("symbols", "objects")).select("project_id", "kind", "seq").distinct()
    have = sent.groupBy(F.col("project_id").alias("id")).agg(F.count_if(F.col("kind") == "symbols").alias("s"), F.count_if(F.col("kind") == "objects").alias("o"))
    # as many as announced, where a number was: more is as wrong as fewer
    full = (F.col("symbol_chunks_total").isNull() | (F.coalesce("s", F.lit(0)) == F.col("symbol_chunks_total"))) & (F.col("object_chunks_total").isNull() | (F.coalesce("o", F.lit(0)) == F.col("object_chunks_total")))
    done = projects.join(have, "id", "left").withColumn("upload_status", F.when(full, "complete").otherwise("uploading")).withColumn("root_layer_id", root_layer("id"))
    known = symbols(chunks)
    return {
        "projects": done.select(*TABLES["projects"].names),
        "objects": objects(chunks),
        "object_contents": chunks.sparkSession.createDataFrame([], TABLES["object_contents"]),
        "content_store": content_store(chunks),
        "symbols": known,
        "symbol_instances": symbol_instances(chunks, known),
        "symbol_refs": symbol_refs(chunks, known),
        "chunks": sent,
    }


def delete_project(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    """The tables without a project, and without what lies in its files or refers to its symbols; contents stay."""
    objects_, symbols_ = ("objects", "object_id"), ("symbols", "symbol")

    def without(name: str, of: tuple[str, str], column: str) -> DataFrame:
        gone = tables[of[0]].where(F.col("project_id") == project_id).select(F.col("id").alias(column))
        return out[name].join(gone, column, "left_anti").select(*tables[name].columns)

    out = dict(tables)
    out["projects"] = tables["projects"].where(F.col("id") != project_id)
    for name in ("objects", "symbols", "chunks"):
        if name in tables:
            out[name] = tables[name].where(F.col("project_id") != project_id)
    for name, columns in {"symbol_instances": ("object_id", "symbol"), "symbol_refs": ("from_object", "to_symbol"), "object_contents": ("object_id", None), "nodes": ("object_id", "symbol_id")}.items():
        if name in tables:
            out[name] = without(name, objects_, columns[0])
            if columns[1]:
                out[name] = without(name, symbols_, columns[1])
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks stored as JSON or Parquet files."""
    reader = spark.read.schema(CHUNK)
    return reader.json(path) if path.endswith(".json") or path.endswith(".jsonl") else reader.parquet(path)
