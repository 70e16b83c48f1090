"""Artifact sinks and sources: feature table, entities, model bundle, results.

Everything is written with Spark writers to a path the caller chooses (on a
cluster: shared storage); nothing is pickled on the driver. ``VersionedTable``
writes a table season by season and publishes whole versions through a manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.profile import entities


def save_feature_table(features: DataFrame, path: str, partition_by: str = "season") -> None:
    """Feature table as Parquet partitioned by season, so later reads prune seasons."""
    features.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def load_feature_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Feature table, or an empty frame when nothing has been written yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return spark.createDataFrame([], schema or "match_id long")
    return spark.read.parquet(path)


def save_entities(features: DataFrame, path: str) -> None:
    """Sorted distinct entities of both sides."""
    entities(features).orderBy("pool", "team").write.mode("overwrite").parquet(path)


def save_bundle(model: PipelineModel, path: str, numeric_cols: list[str], cat_cols: list[str],
                use_odds: bool, labels: list[str]) -> None:
    """Fitted pipeline plus a one-row metadata table (columns, odds flag, label order)."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    meta = {"numeric_cols": numeric_cols, "cat_cols": cat_cols, "use_odds": use_odds, "labels": labels}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """(model, metadata) written by ``save_bundle``."""
    model = PipelineModel.load(f"{path}/model")
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    return model, meta


def save_results(results: DataFrame, path: str) -> None:
    """Per-model summary {model, test_acc, cv_mean}."""
    results.select("model", "test_acc", "cv_mean", *[c for c in ("cv_std", "model_order") if c in results.columns]) \
        .write.mode("overwrite").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """The summary by falling accuracy; an empty one if none is stored."""
    return (load_feature_table(spark, path, "model string, test_acc double, cv_mean double")
            .orderBy(F.col("test_acc").desc()))


class VersionedTable:
    """A table of parts (seasons) whose readers always see one whole version.

    A write puts the parts it brings into a new folder, which no reader looks at, and then publishes a
    manifest of one row: the folder of every part, new ones and those left alone. Manifests are numbered and
    appear by one rename, so a reader sees the old version or the new one; the one with the highest number
    counts. A frame that was read keeps its version's files until ``expire`` removes them. Of two writers at
    the same time one gets its number and the other an error, to be tried again.
    """

    def __init__(self, spark: SparkSession, path: str, part: str = "season"):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Folder of each part, and the table's schema, in a version (the newest one by default)."""
        known = self.versions()
        if not known:
            return {"schema": None, "parts": {}}
        row = self.spark.read.text(f"{self.path}/manifests/{(known[-1] if version is None else version):012d}.json", wholetext=True).first()
        return json.loads(row["value"])

    def write(self, df: DataFrame) -> int | None:
        """Replace the parts that ``df`` has rows of; nothing is written, and None returned, if it has no rows."""
        before = self.versions()
        old = self.manifest(before[-1]) if before else {"schema": None, "parts": {}}
        folder = f"data/{uuid.uuid4().hex}"
        tagged = df.withColumn("_part", F.coalesce(F.col(self.part).cast("string"), F.lit("null")))
        # a part's rows are spread by all columns: a season with a third of all rows isn't one task
        tagged.repartition("_part", F.pmod(F.xxhash64(*df.columns), F.lit(64))).write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        written = [f.getPath().getName() for f in self._fs.listStatus(self._at(folder)) if f.isDirectory()]
        if not written:
            self._fs.delete(self._at(folder), True)
            return None
        parts = old["parts"] | {n: f"{folder}/{n}" for n in written}
        version = (before[-1] if before else 0) + 1
        self._publish(version, json.dumps({"schema": df.schema.json(), "parts": parts}))
        return version

    def _publish(self, version: int, text: str) -> None:
        self._fs.mkdirs(self._at("manifests"))
        draft, final = self._at("manifests", f"draft-{uuid.uuid4().hex}"), self._at("manifests", f"{version:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} was published meanwhile; write again")

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame | None:
        """A whole version, or only some parts of it; None if nothing was ever written."""
        found = self.manifest(version)
        folders = [f"{self.path}/{f}" for n, f in sorted(found["parts"].items())
                   if parts is None or n.partition("=")[2] in parts]
        if found["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(found["schema"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def expire(self, keep: int = 1) -> int:
        """Remove all but the newest ``keep`` versions and the folders that no kept one names; the number removed."""
        known = self.versions()
        gone, kept = known[:-keep], known[-keep:]
        used = {f for v in kept for f in self.manifest(v)["parts"].values()}
        named = {f for v in gone for f in self.manifest(v)["parts"].values()} - used
        for v in gone:
            self._fs.delete(self._at("manifests", f"{v:012d}.json"), False)
        for f in named:
            self._fs.delete(self._at(f), True)
        return len(gone)
