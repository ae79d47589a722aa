"""KML files in and out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs

# The names of KML's properties in triples, and of its vocabulary.
KML = "http://www.opengis.net/kml/2.2"
KML_NAME, KML_DESCRIPTION = KML + "#name", KML + "#description"

_MARK = r"(?s)(<(?:\w+:)?Placemark\b.*?</(?:\w+:)?Placemark>)"


def _text(tag: str) -> Column:
    """The text of a placemark's element: CDATA as it stands, else without XML's escapes."""
    raw = F.regexp_extract("mark", rf"(?s)<(?:\w+:)?{tag}>(.*?)</(?:\w+:)?{tag}>", 1)
    plain = F.regexp_extract(raw, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", 1)
    return F.nullif(F.trim(F.when(raw.contains("<![CDATA["), plain).otherwise(codecs.xml_unescaped(raw))), F.lit(""))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """uri, shape, name, description, attributes, content, source of every geometry in the files, in placemarks and outside of them, at any depth.

    The uri is the geometry's own id; without one it is the first http:// address in the description, else a hash of the placemark and of the
    geometry's place in it (so geometries that share an address share a uri, as its shapes).  A file is one row while it is read.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("source"), codecs.without_comments(F.col("value")).alias("value"))
    rest = F.array(F.regexp_replace("value", _MARK, ""))
    marks = files.select("source", F.explode(F.concat(F.regexp_extract_all("value", F.lit(_MARK), F.lit(1)), rest)).alias("mark"))
    in_mark = F.col("mark").rlike(r"^<(?:\w+:)?Placemark\b")
    rows = marks.select("source", "mark", *[F.when(in_mark, _text(t)).alias(t) for t in ("name", "description")], F.posexplode(codecs.kml_geometries(F.col("mark"))).alias("at", "g"))
    address = F.nullif(F.regexp_extract("description", r"(http://[^\s\"'<]+)", 1), F.lit(""))
    own = F.concat(F.lit("_:"), F.sha2(F.concat_ws("#", "source", "mark", F.col("at").cast("string")), 256))
    return rows.select(F.coalesce("g.uri", address, own).alias("uri"), "g.shape", "name", "description", "g.attributes", "g.content", "source")


def placemarks(shapes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """value: one placemark a row.  labels: s, p, o triples of names and descriptions."""
    rows = shapes
    for name, p in (("name", KML_NAME), ("description", KML_DESCRIPTION)):
        if labels is not None:
            one = labels.where(F.col("p") == p).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias(name))
            rows = rows.drop(name).join(one, "uri", "left")
        elif name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    ident = F.concat(F.lit('id="'), F.replace(codecs.xml_escaped(F.col("uri").cast("string")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    mark = codecs.placemark(codecs.shape_kml(F.col("shape"), ident), F.col("name"), F.col("description"))
    return rows.select("uri", mark.alias("value")).where("value is not null")


def write_kml(shapes: DataFrame, path: str, name: str | None = None, labels: DataFrame | None = None) -> None:
    """One KML document a part file: header, placemarks, footer.  No file needs the rows of another."""
    shown = "" if name is None else "<name>" + name.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") + "</name>\n"
    top = f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="{KML}">\n<Document>\n{shown}'
    bottom = "\n</Document>\n</kml>\n"

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda t: pa.RecordBatch.from_arrays([pa.array([t])], ["value"])
        yield line(top)
        yield from batches
        yield line(bottom)

    placemarks(shapes, labels).select("value").mapInArrow(document, "value string").write.mode("overwrite").text(path)


def kml_to_georss(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o triples of the shapes of KML files, and of the names and descriptions they have."""
    rows = read_kml(spark, path)
    label = lambda p, c: rows.where(F.col(c).isNotNull()).select(F.col("uri").alias("s"), F.lit(p).alias("p"), F.col(c).alias("o")).distinct()
    return georss_triples(rows).unionByName(label(KML_NAME, "name")).unionByName(label(KML_DESCRIPTION, "description"))


def georss_triples(shapes: DataFrame) -> DataFrame:
    shape = F.col("shape")
    return shapes.select(F.col("uri").alias("s"), codecs.georss_predicate(shape).alias("p"), codecs.georss_literal(shape).alias("o"))


def georss_to_kml(triples: DataFrame, path: str, graph: str | None = None) -> None:
    """All GeoRSS shapes, or those of a graph, with the names and descriptions that the same graph (all of them) gives."""
    from .triples import georss

    rows = triples if graph is None else triples.where(F.col("graph") == graph)
    write_kml(georss(rows), path, labels=rows)
