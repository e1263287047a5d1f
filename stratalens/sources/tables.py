"""The canonical tables between stages: Parquet, partitioned by family and release, rewritten by document.

A write replaces the documents that it brings and no others.  Only partitions with such a document are written anew
(dynamic partition overwrite): the rows of their other documents are read and written back with the new ones, so
a rerun over some documents costs what their partitions hold, and one over the same documents changes nothing.
Spark stages a write beside the table and moves its partitions at the end; a write that fails before that
leaves the table as it was.  One writer at a time.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from stratalens.operators import shared

#: Names of the tables.
DOCUMENTS, CHUNKS, UNITS, RECORDS, SUMMARIES, TRACES = "documents", "chunks", "units", "records", "summaries", "traces"
#: Columns that partition a table, beside the same data in its files.
FAMILY, RELEASE = "_family", "_release"
#: Stands for a null name in the partitions' folders; no document name gives such a part.
NONE = "-"


class Table:
    """One table below ``root``; its rows have document_name, and document_family and release_label if they are partitioned by them."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"

    def exists(self) -> bool:
        """Whether its first write is complete and it has rows; a table without rows has no schema."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []  # as many as families
        return "_SUCCESS" in names and any(n.startswith(f"{FAMILY}=") for n in names)

    def _partitioned(self, rows: DataFrame) -> DataFrame:
        part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in rows.columns else F.lit(NONE)
        return rows.withColumn(FAMILY, part("document_family")).withColumn(RELEASE, part("release_label"))

    def _whole(self) -> DataFrame:
        # family and release stay strings, whatever they look like
        held = self.spark.read.parquet(self.path).schema
        schema = StructType([f for f in held.fields if f.name not in (FAMILY, RELEASE)]).add(FAMILY, StringType()).add(RELEASE, StringType())
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self, document_family: str | None = None, release_label: str | None = None) -> DataFrame:
        """The rows; the partitions of another family or release are not read."""
        if not self.exists():
            raise FileNotFoundError(f"Table does not exist: {self.path}")
        rows = self._whole()
        for column, value in ((FAMILY, document_family), (RELEASE, release_label)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        return rows.drop(FAMILY, RELEASE)

    def write(self, rows: DataFrame, documents: DataFrame | None = None) -> None:
        """Replace the documents of ``rows``, and of ``documents`` (document_name) if some of those have no rows now.

        Rows that were of these documents go wherever they lie, so a document that changes its family or release is moved.
        """
        if not self.exists():
            self._put(self._partitioned(rows), "static")  # in place of what a failed first write has left; it leaves a mark at its end
            return
        new = shared.kept(self._partitioned(rows))  # the stages before it run once
        old = self._whole()
        names = new.select("document_name")
        names = (names if documents is None else names.unionByName(documents.select("document_name"))).distinct()
        # partitions that hold or will hold one of these documents: at most as many rows as the table has partitions
        touched = old.join(names, "document_name", "left_semi").select(FAMILY, RELEASE).unionByName(new.select(FAMILY, RELEASE)).distinct()
        others = old.join(touched, [FAMILY, RELEASE], "left_semi").join(names, "document_name", "left_anti")
        both = others.select(*new.columns).unionByName(new)
        emptied = touched.join(both.select(FAMILY, RELEASE).distinct(), [FAMILY, RELEASE], "left_anti").collect()  # names of partitions
        self._put(both, "dynamic")  # staged beside the files that it reads
        shared.discard(new)
        for r in emptied:
            self._drop(r[FAMILY], r[RELEASE])

    def _put(self, rows: DataFrame, replaced: str) -> None:
        columns = [c for c in rows.columns if c not in (FAMILY, RELEASE)]
        dealt = rows.select(*columns, FAMILY, RELEASE).hint("rebalance", FAMILY, RELEASE)  # a large partition is several tasks'
        dealt.write.mode("overwrite").option("partitionOverwriteMode", replaced).partitionBy(FAMILY, RELEASE).parquet(self.path)
        gc.collect()  # else the shuffle files of this write stay until the driver happens to collect its garbage
        self.spark._jvm.System.gc()

    def _drop(self, family: str, release: str) -> None:
        """Delete a partition that has no rows any more."""
        jvm = self.spark._jvm
        quoted = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{FAMILY}={quoted(family)}/{RELEASE}={quoted(release)}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
