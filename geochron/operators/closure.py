"""Transitive closure over links, and loading and crawling of sources by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.triples import LINKS, Source, candidates
from ..storage import discard, new_path, written
from .mutations import ops

_STEP = "closure"


def reachable(links: DataFrame, start: DataFrame) -> DataFrame:
    """node, depth: all nodes reachable from start (node), start included at depth 0.  links: src, dst.

    Breadth first.  One table holds what is seen, in a partition a depth: each round joins the last partition only with the links and appends what
    is new as the next one, so plans don't grow with depth and nothing is written twice.  The number of rounds is the longest shortest path.
    """
    spark, root = start.sparkSession, new_path(start.sparkSession, _STEP)
    kind = start.schema["node"].dataType
    schema = StructType([StructField("node", kind), StructField("depth", IntegerType())])
    start.select("node").where("node is not null").distinct().write.parquet(f"{root}/depth=0")
    edges = written(links.select("src", F.col("dst").cast(kind).alias("dst")).where("dst is not null").distinct(), _STEP)
    depth = 0
    while True:
        depth += 1
        seen, last = spark.read.schema(schema).parquet(root), f"{root}/depth={depth}"
        step = seen.where(F.col("depth") == depth - 1).join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        step.join(seen.select("node"), "node", "left_anti").write.parquet(last)
        if spark.read.schema(StructType(schema.fields[:1])).parquet(last).isEmpty():
            discard(edges)
            return seen


def link_pairs(triples: DataFrame, properties: tuple[str, ...] = LINKS) -> DataFrame:
    return triples.where(F.col("p").isin(*properties)).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def crawled(triples: DataFrame, start: DataFrame, properties: tuple[str, ...] = LINKS) -> DataFrame:
    """Triples of the sources (graphs) that start (node) links to, directly or through others' links: a link leads to the
    graph of its object's name, and the links inside a graph lead on.
    """
    links = triples.where(F.col("p").isin(*properties)).select(F.col("graph").alias("src"), F.col("o").alias("dst"))
    return triples.join(reachable(links, start).select(F.col("node").alias("graph")), "graph", "left_semi")


def load(triples: DataFrame, graph: str, seq: int, index: str | None = None, more: tuple[Source, ...] = ()) -> DataFrame:
    """Log rows that assert every shape of a source."""
    return ops(candidates(triples.where(F.col("graph") == graph), more), "assert", seq, index)


def unload(triples: DataFrame, graph: str, seq: int, index: str | None = None, more: tuple[Source, ...] = ()) -> DataFrame:
    """Log rows that take back every shape of a source."""
    return ops(candidates(triples.where(F.col("graph") == graph), more), "retract", seq, index)


def crawl(triples: DataFrame, start: DataFrame, seq: int, index: str | None = None, properties: tuple[str, ...] = LINKS) -> DataFrame:
    """Log rows that assert the shapes of start's sources and of all that they lead to."""
    return ops(candidates(crawled(triples, start, properties)), "assert", seq, index)


def uncrawl(triples: DataFrame, start: DataFrame, seq: int, index: str | None = None, properties: tuple[str, ...] = LINKS) -> DataFrame:
    """Log rows that take back what crawl() asserts, link by link."""
    return ops(candidates(crawled(triples, start, properties)), "retract", seq, index)
