"""Readers with explicit schemas: coerced CSV, JSON documents of one or many records, fields and tables of HTML, tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, read as text and coerced: blank is null, an ISO date or nothing, a number or nothing, yes/true/t/1 or no/false/f/0."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.csv(path, schema=text, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", enforceSchema=True)
    return raw.select(*[coerced(F.regexp_replace(F.col(f"`{f.name}`"), "^﻿", ""), f.dataType).alias(f.name) for f in schema.fields])


def coerced(c: Column, kind: T.DataType) -> Column:
    """Text as a value of ``kind``; null for what can't be read so."""
    t = F.nullif(F.trim(c), F.lit(""))
    if isinstance(kind, T.BooleanType):
        low = F.lower(t)
        return F.when(low.isin("yes", "true", "t", "1", "y"), True).when(low.isin("no", "false", "f", "0", "n"), False)
    if isinstance(kind, T.DateType):
        return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    return t if isinstance(kind, T.StringType) else F.regexp_replace(t, ",", "").try_cast(kind)


def read_json_documents(spark: SparkSession, path: str, payload: T.StructType) -> DataFrame:
    """Rows (document_id, record_index, *payload) of one-document files whose ``extraction`` is a record or a list; the file's name stands in for a missing id."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1).alias("stem"))
    return document_records(raw, "value", "stem", payload)


def document_records(df: DataFrame, text: str, stem: str, payload: T.StructType) -> DataFrame:
    """The records of JSON documents in a column; what can't be read has no row."""
    inner = F.get_json_object(text, "$.extraction")
    many = F.from_json(inner, T.ArrayType(payload), {"mode": "PERMISSIVE"})
    records = F.when(F.ltrim(inner).startswith("["), many).otherwise(F.array(F.from_json(inner, payload, {"mode": "PERMISSIVE"})))
    out = df.where(inner.isNotNull()).select(F.coalesce(F.get_json_object(text, "$.document_id"), F.col(stem)).alias("document_id"), F.posexplode(records).alias("record_index", "r"))
    return out.where("r IS NOT NULL").select("document_id", "record_index", "r.*")


def tolerant_json(c: Column) -> Column:
    """JSON text of a model's answer: without code fences and whatever precedes the first brace."""
    bare = F.regexp_replace(c, r"```(?:json)?", "")
    return F.nullif(F.trim(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)), F.lit(""))


def loose_value(c: Column, key: str) -> Column:
    """A key's value in JSON, or in text that only looks like it."""
    return F.coalesce(F.get_json_object(c, f"$.{key}"), F.nullif(F.regexp_extract(c, rf"['\"]?{key}['\"]?\s*[:=]\s*['\"]?([^,'\"}}]+)", 1), F.lit("")))


def _unescaped(c: Column) -> Column:
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def html_escaped(c: Column) -> Column:
    """Text as it stands in a page."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def html_field(c: Column, element: str) -> Column:
    """Text of the element with an id: line breaks to '; ', tags dropped, dashes for nothing to null."""
    inner = F.regexp_extract(c, rf"(?is)id=\"{element}\"[^>]*>(.*?)</(?:td|div|span)>", 1)
    text = F.regexp_replace(F.regexp_replace(inner, r"(?i)<br\s*/?>", "; "), "<[^>]+>", "")
    text = F.trim(F.regexp_replace(_unescaped(text), r"\s+", " "))
    return F.when(~text.rlike("^-*$"), text)


def html_rows(c: Column) -> Column:
    """Rows of cells of the tables in a page; a cell that spans columns is repeated."""
    cells = lambda row: F.flatten(F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>.*?</t[dh]>"), F.lit(0)), _spanned))
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)


def _spanned(cell: Column) -> Column:
    span = F.coalesce(F.regexp_extract(cell, r"(?i)colspan=\"?([0-9]+)", 1).try_cast("int"), F.lit(1))
    return F.array_repeat(F.trim(F.regexp_replace(cell, "<[^>]+>", "")), span)


def spreadsheet_rows(df: DataFrame, names: list[str], number: str = "source_row") -> DataFrame:
    """An exported sheet's positional columns under their names, trimmed, without rows that are blank throughout; ``number``, a column of ``df``, stays."""
    columns = [c for c in df.columns if c != number]
    cells = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in zip(columns, names)]
    return df.select(F.col(f"`{number}`"), *cells).where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())


def wanted_rows(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of a bulk file whose key is wanted; what isn't leaves with the scan's join."""
    return df.join(wanted.select(F.col(wanted.columns[0]).alias(key)).distinct(), key, "left_semi")


def model_outputs(df: DataFrame, text: str, key: str, at: str) -> DataFrame:
    """Rows (key, output) of files that hold one model output or a list of them, as JSON; of a key's several the last, by ``at`` and place, stays."""
    record = F.col(text)
    many = F.from_json(record, "array<string>")
    rows = F.when(F.ltrim(record).startswith("["), many).otherwise(F.array(record))
    out = df.select(F.col(at).alias("_at"), F.posexplode(rows).alias("_pos", "output")).withColumn(key, F.get_json_object("output", f"$.{key}")).where(F.col(key).isNotNull())
    return out.groupBy(key).agg(F.max_by("output", F.struct("_at", "_pos")).alias("output"))


def feature_rows(df: DataFrame, text: str, attributes: T.StructType, millis: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*attributes, lon, lat, geometry) of feature JSON: epoch milliseconds become dates, rings a Polygon and x, y a Point; no geometry is null."""
    xy = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y")])
    shape = T.StructType([*xy.fields, T.StructField("rings", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
    schema = T.StructType([T.StructField("attributes", attributes), T.StructField("centroid", xy), T.StructField("geometry", shape)])
    f = df.select(F.from_json(text, schema).alias("f")).where("f.attributes IS NOT NULL")
    fields = [(F.timestamp_millis(F.col(f"f.attributes.{n}")).cast("date") if n in millis else F.col(f"f.attributes.{n}")).alias(n) for n in attributes.names]
    g = F.col("f.geometry")
    json = lambda kind, coordinates: F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
    geometry = F.when(g["rings"].isNotNull(), json("Polygon", g["rings"])).when(g["x"].isNotNull() & g["y"].isNotNull(), json("Point", F.array(g["x"], g["y"])))
    return f.select(*fields, F.col("f.centroid.x").alias("lon"), F.col("f.centroid.y").alias("lat"), geometry.alias("geometry"))


def load_share(found: int, expected: int, enough: float = 0.95) -> bool:
    """Whether so much of a source is loaded that loading it again can be skipped."""
    return expected > 0 and found >= enough * expected
