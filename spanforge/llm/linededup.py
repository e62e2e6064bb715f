"""Operator 2, line dedup: removal of lines that are spread over many sites.

The spread of a line is its number of distinct sites (``source``).  One
aggregation over all lines keeps a HyperLogLog sketch of the sites per line
hash; the sketches of the partitions merge in it.  Lines whose estimate lies
within ``band`` standard errors of ``min_sites`` get an exact distinct count in
a second pass; the rest are decided by the sketch.  A line that reaches
``min_sites`` is boilerplate: it stays in the document of the smallest
``doc_id`` that has it (in each of its places there) and goes everywhere else,
so that no text is lost altogether.

Lines are compared whole but for white space around them, by a hash of 128 bits;
blank lines (under ``min_chars`` characters, one by default) are never
boilerplate.  Up to ``limit`` boilerplate lines go to every task, beyond that the
hashes of lines, not their texts, are joined with them; the result is the same.

Cases: ``doc_id`` is an integer of up to 64 bits.  A null text stays null, an
empty one empty.  A null ``source`` is no
site.  Rows with a null ``doc_id`` lose every boilerplate line that some
document with an id keeps.  Repeated rows of one ``doc_id`` are one document: if
it is the keeper, each of its rows keeps the line.  A document whose lines all
go stays, with an empty text.  An empty table gives an empty result.  Other
columns are ignored, or passed through by ``stage``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import cut, fresh, map_texts

MIN_SITES = 8
MIN_CHARS = 1
LG_K = 8
BAND = 3.0
#: boilerplate lines that are sent to every task; beyond, they are joined
BROADCAST_LINES = 2_000_000


def _line(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r]+|[ \t\r]+$", "")


def _hash(line: Column) -> Column:
    """128 bits: two 64-bit hashes of different seeds."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit("line"), line).alias("g"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each line once for each document and place: ``h`` (hash), ``site``, ``doc``."""
    lines = F.filter(F.transform(F.split("text", "\n"), _line), lambda x: F.length(x) >= max(min_chars, 1))
    rows = docs.select(F.col("source").cast("string").alias("site"), F.col("doc_id").cast("long").alias("doc"), F.explode(lines).alias("line"))
    return rows.select(_hash(F.col("line")).alias("h"), "site", "doc").select("h.h", "h.g", "site", "doc")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """Line hashes (``h``, ``g``) with at least ``min_sites`` sites, and the document that keeps each (``keeper``, null if none has an id)."""
    lines = _lines(docs, min_chars)
    error = 1.04 / 2 ** (lg_k / 2) * band
    spread = (
        lines.groupBy("h", "g")
        .agg(F.count("site").alias("n"), F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("doc").alias("keeper"))
        .where(F.col("n") >= min_sites)
        .select("h", "g", "keeper", F.hll_sketch_estimate("sketch").alias("estimate"))
        .where(F.col("estimate") >= min_sites * (1 - error))
    )
    spread = cut(spread)
    near = spread.where(F.col("estimate") < min_sites * (1 + error)).select("h", "g")
    exact = lines.join(near, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    sure = spread.where(F.col("estimate") >= min_sites * (1 + error)).select("h", "g", "keeper")
    return cut(sure.unionByName(spread.join(exact, ["h", "g"], "left_semi").select("h", "g", "keeper")))


def _strip(docs: DataFrame, lines: DataFrame, min_chars: int, limit: int, text: str, removed: str) -> DataFrame:
    """``docs`` with two more columns, ``text`` and ``removed``."""
    spark = docs.sparkSession
    if lines.count() > limit:
        return _strip_by_join(docs, lines, min_chars, text, removed)
    found = lines.toArrow().to_pandas().sort_values(["h", "g"])
    h, g = found["h"].to_numpy(np.int64), found["g"].to_numpy(np.int64)
    keeper = found["keeper"].astype("Int64").fillna(-(2**63)).to_numpy(np.int64)
    most = int(np.unique(h, return_counts=True)[1].max(initial=1))  # lines that share their first 64 bits
    table = spark.sparkContext.broadcast((h, g, keeper))  # `limit` lines at most
    (hashes,) = fresh([*docs.columns, text, removed], "hashes")
    hashed = docs.select("*", F.transform(F.split("text", "\n"), lambda x: F.when(F.length(_line(x)) >= max(min_chars, 1), _hash(_line(x)))).alias(hashes))

    def fn(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        known, second, owner = table.value
        names = rows.schema.names
        own_hashes = rows.column(len(names) - 1)
        ids = rows.column(names.index("doc_id"))
        own = np.array(ids.cast(pa.int64()).fill_null(-(2**63) + 1).to_numpy(zero_copy_only=False), np.int64)
        none = np.array(ids.is_null())
        flat = own_hashes.flatten()
        ok = np.array(flat.is_valid())
        value, other = (np.array(flat.field(k).fill_null(0).to_numpy(zero_copy_only=False), np.int64) for k in (0, 1))
        count = np.array(own_hashes.value_lengths().fill_null(0))
        doc = np.repeat(np.arange(len(count)), count)
        drop = np.zeros(len(value), bool)
        if len(known) and len(value):
            first = np.searchsorted(known, value)
            for k in range(most):
                at = np.minimum(first + k, len(known) - 1)
                drop |= (known[at] == value) & (second[at] == other) & ok & ((owner[at] != own[doc]) | none[doc])
        gone = np.bincount(doc[drop], minlength=len(count)) if len(doc) else np.zeros(len(count), int)
        first = np.concatenate(([0], np.cumsum(count)))
        for i in np.flatnonzero(gone):
            mark = drop[first[i] : first[i + 1]]
            texts[i] = "\n".join(x for x, m in zip(texts[i].split("\n"), mark) if not m)
        columns = [rows.column(k) for k in range(len(names) - 1)] + [pa.array(texts, pa.string()), pa.array(gone, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [*names[:-1], text, removed])

    schema = docs.select("*", F.col("text").cast("string").alias(text), F.lit(0).alias(removed)).schema
    return map_texts(hashed, fn, schema)


def _strip_by_join(docs: DataFrame, lines: DataFrame, min_chars: int, text: str, removed: str) -> DataFrame:
    """The same by a shuffle of the hashes of the lines (not of the texts), for any number of boilerplate lines."""
    key, gone = fresh([*docs.columns, text, removed], "key", "gone")
    each = docs.select("*", F.struct(F.col("doc_id").cast("long").alias("i"), _hash(F.col("text")).alias("t")).alias(key))
    # each document of one id and text once, each line once in it
    parts = each.where("text IS NOT NULL").select(F.col(key).alias("key"), F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _line))).alias("line"))
    asked = parts.where(F.length("line") >= max(min_chars, 1)).select("key", _hash(F.col("line")).alias("x"))
    hit = asked.join(lines.select(F.struct("h", "g").alias("x"), "keeper"), "x")
    lost = hit.where(~F.col("keeper").eqNullSafe(F.col("key.i")) | F.col("key.i").isNull()).groupBy(F.col("key").alias(key)).agg(F.collect_set("x").alias(gone))
    is_gone = lambda x: F.coalesce(F.array_contains(F.col(gone), _hash(_line(x))), F.lit(False))
    both = each.join(lost, key, "left")
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~is_gone(x)), "\n")).alias(text),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.filter(F.split("text", "\n"), is_gone))).alias(removed),
    )


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, limit: int = BROADCAST_LINES, **how) -> DataFrame:
    """Every document: ``doc_id``, ``text`` without its boilerplate lines, ``removed`` (their number)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    out = _strip(docs, boilerplate(docs, min_sites, min_chars, **how), min_chars, limit, "new_text", "removed")
    return out.select("doc_id", F.col("new_text").alias("text"), "removed")


def stage(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, limit: int = BROADCAST_LINES, **how) -> DataFrame:
    """The documents with all their columns, ``text`` (and ``n_chars``, if there) as line dedup leaves them."""
    text, removed = fresh(docs.columns, "new_text", "removed")
    out = _strip(docs, boilerplate(docs, min_sites, min_chars, **how), min_chars, limit, text, removed)
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


_TRIMMED = "trim(raw, ' ' || chr(9) || chr(13))"
ORACLE = f"""
WITH parts AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), lines AS (
  SELECT doc_id, source, raw, pos, {_TRIMMED} AS line FROM parts
), boiler AS (
  SELECT line, min(doc_id) AS keeper FROM lines WHERE length(line) >= {MIN_CHARS}
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), flagged AS (
  SELECT p.doc_id, p.raw, p.pos, (b.line IS NOT NULL AND b.keeper <> p.doc_id) AS gone
  FROM lines p LEFT JOIN boiler b ON b.line = p.line
)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS removed
FROM flagged GROUP BY doc_id
"""
