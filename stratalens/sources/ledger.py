"""Responses of remote models, kept by key in a shared folder: what has been paid for once is not asked again.

Only requests whose key has no response yet are sent.  They are dealt to buckets by key; a task goes through its buckets
one after the other and writes responses down in small groups as they come, so that an attempt which follows a lost one
reads the keys that its bucket already has and sends the rest.  A lost task thus repeats one group at most.

A run that completes is folded into a Parquet step.  What a failed run has written is read as well, until ``vacuum``
makes one step of all.  All readers take the same response of a key: the least, if tasks that ran twice (speculation)
have brought several.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources.files import full_uri, opened, put

#: Requests of a bucket, about: a task holds the keys of one bucket at a time.
BUCKET = 4096
#: Partitions that requests are dealt to, at most; beyond that many buckets a task has several.
TASKS = 8192
ROWS = "key string, response string"


def written(folder: str) -> set[str]:
    """Keys of the responses in a bucket's folder."""
    store, at = opened(folder)
    keys: set[str] = set()
    for f in store.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True)):
        if not f.base_name.startswith("."):
            with store.open_input_stream(f.path) as held:
                keys.update(json.loads(x)["key"] for x in held.read().decode("utf-8").splitlines())
    return keys


def write(folder: str, answers: list[tuple[str, str]]) -> None:
    """Put the responses into a file of the bucket's folder, which has its name once it is whole."""
    put(f"{folder}/{uuid.uuid4().hex}.json", (json.dumps({"key": k, "response": r}) + "\n" for k, r in answers))


def asker(connect: Callable[[], Callable[[list[str]], list[str]]], run: str, group: int):
    """The function of a task: sends requests (bucket, key, request), sorted by bucket, that the run has no response for."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, bucket, held, waiting = connect(), None, set(), []

        def send() -> int:
            if waiting:
                replies = client([request for _, request in waiting])
                if len(replies) != len(waiting):
                    raise RuntimeError(f"Response count mismatch: expected {len(waiting)}, got {len(replies)}")
                write(f"{run}/{bucket}", [(key, reply) for (key, _), reply in zip(waiting, replies)])
            sent = len(waiting)
            waiting.clear()
            return sent

        for b in batches:
            sent = 0
            for own, key, request in zip(b["bucket"], b["key"], b["request"]):
                if own != bucket:
                    sent += send()
                    bucket, held = own, written(f"{run}/{own}")
                if key not in held:
                    waiting.append((key, request))
                if len(waiting) == group:
                    sent += send()
            yield pd.DataFrame({"sent": [sent]})
        yield pd.DataFrame({"sent": [send()]})

    return ask


class Ledger:
    """The responses below ``path``; ``of`` tells models and services apart that share it.

    Runs may overlap: they ask for some keys twice then, and read the same.  ``vacuum`` needs the ledger for itself.
    """

    def __init__(self, spark: SparkSession, path: str, of: str = "") -> None:
        self.spark, self.path, self.of = spark, path.rstrip("/"), of

    def key(self, *request: Column) -> Column:
        """The key of a request, which may have nulls."""
        return F.sha2(F.to_json(F.array(F.lit(self.of), *[x.cast("string") for x in request])), 256)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folders(self, part: str) -> list[str]:
        """Names of steps or runs, of which there are as many as runs since the last ``vacuum``."""
        fs, p = self._fs(f"{self.path}/{part}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _steps(self) -> list[str]:
        def whole(name: str) -> bool:
            fs, mark = self._fs(f"{self.path}/steps/{name}/_SUCCESS")
            return fs.exists(mark)

        return [n for n in self._folders("steps") if whole(n)]

    def _run(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(ROWS).option("recursiveFileLookup", True).json([f"{self.path}/runs/{n}" for n in names])

    def read(self) -> DataFrame:
        """(key, response), one row for each key."""
        steps = self._steps()
        rows = self.spark.createDataFrame([], ROWS)
        if steps:
            rows = rows.unionByName(self.spark.read.schema(ROWS).parquet(*[f"{self.path}/steps/{n}" for n in steps]))
        if runs := [n for n in self._folders("runs") if n not in steps]:
            rows = rows.unionByName(self._run(runs))
        return rows.groupBy("key").agg(F.min("response").alias("response"))

    def answered(self, asked: DataFrame, connect: Callable[[], Callable[[list[str]], list[str]]], group: int) -> DataFrame:
        """(key, response) of the whole ledger, which then holds all requests ``asked`` (key, request).

        ``connect`` makes a client on the executor, which is given at most ``group`` requests at a time.
        Equal keys are one request.  ``asked`` is evaluated twice.
        """
        missing = asked.select("key", "request").dropDuplicates(["key"])
        if self._folders("steps") or self._folders("runs"):
            missing = missing.join(self.read().select("key"), "key", "left_anti")
        count = missing.count()
        if count:
            buckets = max(-(-count // BUCKET), min(count, self.spark.sparkContext.defaultParallelism))
            name = uuid.uuid4().hex
            run = full_uri(self.spark, f"{self.path}/runs/{name}")
            dealt = missing.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).repartition(min(buckets, TASKS), "bucket").sortWithinPartitions("bucket")
            dealt.select("bucket", "key", "request").mapInPandas(asker(connect, run, group), "sent long").write.format("noop").mode("overwrite").save()
            self._run([name]).groupBy("key").agg(F.min("response").alias("response")).write.parquet(f"{self.path}/steps/{name}")
        return self.read()

    def vacuum(self) -> None:
        """Make one step of all responses and delete the others; no run may be under way."""
        steps, runs = self._folders("steps"), self._folders("runs")
        if len(steps) + len(runs) > 1:
            self.read().write.parquet(f"{self.path}/steps/{uuid.uuid4().hex}")
            for old in [f"{self.path}/steps/{n}" for n in steps] + [f"{self.path}/runs/{n}" for n in runs]:
                fs, p = self._fs(old)
                fs.delete(p, True)
