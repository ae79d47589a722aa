"""Exact dedup against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest.  New data is reduced
to one row per digest, anti-joined to the index by sort-merge (the index side needs
no shuffle) and what is new is appended.  Digests that the index knows are looked up by a second sort-merge join of the same kind.

A batch has a name.  Adding a batch again under its name, after an attempt that failed behind the append, gives what the first attempt would have given.

Defined cases: null text counts as empty; texts are equal when identical after
lower-casing A-Z only; of equal texts the row with the largest doc_id stays, and a
null doc_id is smaller than any other; repeated rows (same doc_id and text) are one
document: all of them carry the same flags, and ``keep_documents`` returns one of
them; an empty table gives no rows; further columns are not read by ``add`` and kept as they are by ``keep_documents``, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_names, new_path, passing_tables, table, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SCHEMA = "digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING"
#: Digests that a bucket is made for, and the most buckets of an index.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 100_000


def digest_of(text: str = "text") -> Column:
    """Lower-case hex SHA-256 of the A-Z lower-cased text in UTF-8."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _UPPER.lower()), 256)


class DigestIndex:
    """Digests with the document kept for each, on disk.

    Opening the path again, in this session or a later one, finds it as it was left, with the number of buckets it was made with: that is in
    the name of its folder.  A new index gets ``buckets``, or as many as ``rows`` digests, of all batches to come, ask for.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, rows: int = 0):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._found() or buckets or min(MOST_BUCKETS, max(16, -(-rows // BUCKET_ROWS)))
        self.place = f"{self.path}/buckets-{self.buckets}"
        self.name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:40]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.place}'")

    def _found(self) -> int | None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        found = [int(n.removeprefix("buckets-")) for n in names if n.startswith("buckets-")]
        return found[0] if found else None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_in(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index doesn't hold."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def known_in(self, groups: DataFrame) -> DataFrame:
        """What the index holds of the groups."""
        return groups.select("digest").join(self.table().hint("merge"), "digest")

    def append(self, groups: DataFrame, batch: str) -> None:
        rows = groups.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def add(index: DigestIndex, docs: DataFrame, batch: str | None = None) -> DataFrame:
    """Deduplicates docs within themselves and against the index, appends what is new, and returns one row per document.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.  A text that an earlier batch brought keeps the keep_id
    and group_size it got then, and none of its rows is kept now.  batch: the batch's name; None: one of its own.
    """
    batch = batch or uuid.uuid4().hex
    with passing_tables():
        rows = written(docs.select("doc_id", digest_of().alias("digest")), "digests", keep=True)
        groups = written(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        index.append(index.new_in(groups), batch)
        # As plain files, so that the join with rows that repeat a digest may split a skewed partition.
        touched = written(index.known_in(groups), "digests-touched", keep=True)
    found = rows.join(touched, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_documents(index: DigestIndex, docs: DataFrame, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    digest, number, absent = keys = free_names(docs, "_digest", "_number", "_absent")
    ident = {number: F.coalesce("doc_id", F.lit(0)), absent: F.col("doc_id").isNull()}
    flags = add(index, docs, batch).where("kept").select(F.col("text_sha256").alias(digest), *[c.alias(n) for n, c in ident.items()]).distinct()
    held = docs.withColumns({digest: digest_of(), **ident}).join(flags, keys, "left_semi")
    # Rows that repeat a doc_id with its text meet here; nothing else has both in common.  The join has dealt the rows by these columns already.
    return held.dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return add(DigestIndex(spark, new_path(spark, "digest-index"), rows=docs.count()), docs)


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
