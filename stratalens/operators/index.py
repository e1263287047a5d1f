"""The vector collection: points from records, idempotent upsert, a Parquet store of numbered steps."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.hashing import point_id
from stratalens.operators import shared
from stratalens.operators.cells import CellIndex
from stratalens.operators.embedding import last_wins, unit, usable
from stratalens.schemas import PAYLOAD, POINT

#: Names and kinds of the steps' folders.
DELTA, FULL = "delta", "full"
STEP = re.compile(f"step-(\\d{{12}})-({DELTA}|{FULL})")
#: Deltas that a bucket may have before it is written anew, however small they are.
DELTAS = 16


def points(records: DataFrame, strict: bool = True) -> DataFrame:
    """(point_id, vector, unit_vector, payload): vectors are kept as given and at unit length.

    With ``strict`` a record without a vector fails; else such records are left out.
    """
    fail = F.raise_error(F.concat(F.lit("Embedding record has no vector: "), F.col("unit_id"))).cast("array<double>")
    vector = F.when(F.col("vector").isNull(), fail).otherwise(F.col("vector")) if strict else F.col("vector")
    rows = records if strict else records.where("vector IS NOT NULL")
    return rows.select(point_id(F.col("cache_key")).alias("point_id"), vector.alias("vector"), unit(vector).alias("unit_vector"), F.struct(*PAYLOAD).alias("payload"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old points but those that ``new`` replaces, and the new ones."""
    return old.join(new.select("point_id"), "point_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_summary(records: DataFrame, collection: str) -> DataFrame:
    return records.agg(F.count("*").alias("attempted_records"), F.count("vector").alias("upserted_points")).select(
        F.lit(collection).alias("collection_name"), "attempted_records", "upserted_points", (F.col("attempted_records") - F.col("upserted_points")).alias("skipped_records")
    )


def batch_from_cache(records: DataFrame, order: list[str]) -> DataFrame:
    """Usable records, one for each cache key, as one batch in order of key."""
    return last_wins(usable(records), order).withColumn("document_name", F.lit("embedding_cache")).orderBy("cache_key")


class Collection:
    """Points in a folder of numbered steps, dealt by a hash of their id to ``buckets``.

    A step is either a delta (the points of one upsert) or full (all points of some buckets as they were after the steps before it).
    A bucket is read from its last full step and the deltas after it, of which the last that holds a point wins.
    Steps are never changed: one is current once it is complete (its committer's mark is written last), a failed
    one leaves readers as they are, its number is never used again, and readers of states that ``vacuum`` keeps are not
    disturbed.  So an upsert writes its own points only; ``compact`` then writes anew the buckets whose deltas
    have grown, and no others.  One writer at a time.

    Within a bucket rows are sorted by release and kind, so filters on these pass over most row groups.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "functional_specs", size: int = 3072, buckets: int = 16, compact_at: float | None = 0.5) -> None:
        if buckets < 1:
            raise ValueError("buckets must be at least 1")
        self.spark, self.path, self.name, self.size, self.buckets, self.compact_at = spark, path.rstrip("/"), name, size, buckets, compact_at

    # --- steps ---

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        """Names of the folders in a folder."""
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def steps(self, complete: bool = True) -> dict[int, str]:
        """Kind (DELTA or FULL) of each step by number, lowest first."""
        found = [STEP.fullmatch(n) for n in self._list(f"{self.path}/{self.name}")]
        every = {int(m[1]): m[2] for m in found if m}
        return {n: k for n, k in every.items() if not complete or self._fs(f"{self._folder(n, k)}/_SUCCESS")[0].exists(self._fs(f"{self._folder(n, k)}/_SUCCESS")[1])}

    def version(self) -> int:
        """The number of the last complete step; 0 if there is none."""
        return max(self.steps(), default=0)

    def _folder(self, step: int, kind: str) -> str:
        return f"{self.path}/{self.name}/step-{step:012d}-{kind}"

    def _held(self, step: int, kind: str) -> dict[int, int]:
        """Bytes of each bucket that a step holds: as many entries as buckets, whatever the number of points."""
        fs, _ = self._fs(self.path)
        folder = self._folder(step, kind)
        return {int(b.removeprefix("_bucket=")): fs.getContentSummary(self._fs(f"{folder}/{b}")[1]).getLength() for b in self._list(folder) if b.startswith("_bucket=")}

    def layout(self, upto: int | None = None) -> dict[int, tuple[int, list[int]]]:
        """For each bucket, its last full step and the deltas after it, as of step ``upto``; a bucket's first delta is all it holds."""
        out: dict[int, tuple[int, list[int]]] = {}
        for n, kind in self.steps().items():
            if upto is None or n <= upto:
                for b in self._held(n, kind):
                    out[b] = (n, []) if kind == FULL or b not in out else (out[b][0], [*out[b][1], n])
        return out

    def exists(self) -> bool:
        return bool(self.steps())

    def ensure(self) -> None:
        """Create the collection if it has no complete step; an existing one is left as it is, whatever its size."""
        if not self.exists():
            self._write(self.spark.createDataFrame([], POINT), FULL)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", F.pmod(F.xxhash64("point_id"), F.lit(self.buckets)).cast("int").alias("_bucket"))

    def _write(self, rows: DataFrame, kind: str) -> None:
        """``rows`` as the next step, each bucket's in the files of a few tasks."""
        flat = self._bucketed(rows.select("point_id", "vector", "unit_vector", "payload"))
        flat = flat.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "payload.release_label", "payload.source_kind", "point_id")
        # above all others, failed ones too
        flat.write.partitionBy("_bucket").parquet(self._folder(max(self.steps(complete=False), default=0) + 1, kind))

    # --- reading ---

    def _step(self, step: int, kind: str, buckets: list[int]) -> DataFrame:
        rows = self.spark.read.schema(f"{POINT}, _bucket int").parquet(self._folder(step, kind))
        return rows.where(F.col("_bucket").isin(buckets)).withColumn("_step", F.lit(step).cast("long"))

    def _state(self, layout: dict[int, tuple[int, list[int]]], keep: Column | None = None) -> DataFrame:
        """The points of the given buckets: full steps but for what deltas replace, and of the deltas the last of each point.

        A full step is not shuffled: only the deltas' ids are sent to it, where they are small, else both meet by id.
        """
        kinds, fulls, deltas = self.steps(), {}, {}
        for b, (full, after) in layout.items():
            fulls.setdefault(full, []).append(b)
            for d in after:
                deltas.setdefault(d, []).append(b)
        none = self.spark.createDataFrame([], f"{POINT}, _bucket int, _step long")
        union = lambda held: reduce(DataFrame.unionByName, [self._step(n, kinds[n], b) for n, b in sorted(held.items())], none)
        kept = (lambda rows: rows) if keep is None else (lambda rows: rows.where(keep))
        old = kept(union(fulls))
        if deltas:
            new = union(deltas)
            if len(deltas) > 1:
                rest = [c for c in new.columns if c != "point_id"]
                new = new.groupBy("point_id").agg(F.max_by(F.struct(*rest), "_step").alias("r")).select("point_id", "r.*")
            old = old.join(union(deltas).select("point_id").distinct(), "point_id", "left_anti").unionByName(kept(new))
        return old.select("point_id", "vector", "unit_vector", "payload")

    def read(self, release_label: str | None = None, source_kind: str | None = None, upto: int | None = None) -> DataFrame:
        """The points, as they are now or after step ``upto``; filters reach the files."""
        if not self.exists():
            raise RuntimeError(f"Collection does not exist: {self.name}")
        given = [F.col(f"payload.{k}") == v for k, v in (("release_label", release_label), ("source_kind", source_kind)) if v is not None]
        return self._state(self.layout(upto), reduce(lambda a, b: a & b, given) if given else None)

    # --- writing ---

    def upsert(self, records: DataFrame) -> DataFrame:
        """Write the records' points as a delta and return the summary; records without a vector are skipped."""
        summary = upsert_summary(records, self.name)
        fresh = records.where("vector IS NOT NULL")
        if fresh.limit(1).count():
            self.ensure()
            self._write(points(last_wins(fresh, ["unit_index", "unit_id"], check=False)), DELTA)
            if self.compact_at is not None:
                self.compact(self.compact_at)
        return summary

    def compact(self, share: float = 0.0) -> list[int]:
        """Write anew, as one full step, the buckets whose deltas hold more than ``share`` of the bytes of their full
        step (or more than DELTAS steps); returns their numbers."""
        kinds, layout = self.steps(), self.layout()
        held = {n: self._held(n, kinds[n]) for n in kinds}
        grown = [b for b, (full, after) in layout.items() if after and (len(after) > DELTAS or sum(held[d][b] for d in after) > share * held[full][b])]
        if grown:
            self._write(self._state({b: layout[b] for b in grown}), FULL)
        return sorted(grown)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete all steps that no state after one of the last ``keep`` complete steps needs, and older layouts of cells; returns the steps' numbers."""
        if keep < 1:
            raise ValueError("keep must be at least 1")
        last = list(self.steps())[-keep:]
        used = set(last) | {n for upto in last for full, after in self.layout(upto).values() for n in (full, *after)}
        gone = {n: k for n, k in self.steps(complete=False).items() if last and n not in used and n < last[-1]}
        for n, kind in gone.items():
            fs, p = self._fs(self._folder(n, kind))
            fs.delete(p, True)
        for version in self._list(f"{self.path}/{self.name}-cells"):
            if last and int(version) < last[0]:
                fs, p = self._fs(f"{self.path}/{self.name}-cells/{version}")
                fs.delete(p, True)
        return sorted(gone)

    def info(self) -> DataFrame:
        """One row: name, size, distance and number of points."""
        return self.read().agg(F.count("*").alias("points_count")).select(
            F.lit(self.name).alias("collection_name"), F.lit(self.size).alias("vector_size"), F.lit("cosine").alias("distance"), "points_count"
        )

    def sample(self, n: int = 1) -> DataFrame:
        return self.read().drop("vector", "unit_vector").limit(n)

    # --- the layout for pruned search ---

    def build_cells(self, cells: int | None = None) -> CellIndex:
        """Lay out the points as they are now for ``CellIndex`` searches."""
        return CellIndex.build(self.read(), f"{self.path}/{self.name}-cells/{self.version():012d}", cells)

    def cells(self) -> CellIndex | None:
        """The layout of the points as they are now; None if it was not built or points have been upserted since."""
        path = f"{self.path}/{self.name}-cells/{self.version():012d}"
        fs, mark = self._fs(f"{path}/cells/_SUCCESS")  # the last table of a layout
        return CellIndex(self.spark, path) if fs.exists(mark) else None


class MemoryCollection(Collection):
    """The same for trials and tests, in a fresh folder that driver and executors share."""

    def __init__(self, spark: SparkSession, name: str = "functional_specs", size: int = 3072) -> None:
        super().__init__(spark, shared.folder(spark), name, size, buckets=2)
