"""Saved state: what is done, what is left, result documents."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ordered import keys_of


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where none is set, a temporary folder is made, but only for a session inside one process (local[n]), whose
    tasks all see it; any other session gets an error.
    """
    sc = spark.sparkContext
    if shared := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def pending(keys: DataFrame, done: DataFrame, *, by="match_id", config_hash: str) -> DataFrame:
    """Keys without a saved result for this configuration."""
    k = keys_of(by)
    valid = done.filter(F.col("config_hash") == config_hash).select(*k).distinct()
    return keys.join(valid, k, "left_anti")


def missing_files(targets: DataFrame, present: DataFrame) -> DataFrame:
    """Targets that do not exist yet or exist with no content."""
    return targets.join(present.filter(F.col("size") > 0).select("path").distinct(), "path", "left_anti")


class Conflict(RuntimeError):
    """Another writer has published this version first."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file in one step, or raises Conflict where one is there: readers see all of it or nothing."""
    scheme, _, rest = path.partition("://")
    if not rest or scheme == "file":
        target = rest or path.removeprefix("file:")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(draft, "x") as file:
            file.write(text)
        try:
            os.link(draft, target)  # fails where the name is taken
        except FileExistsError:
            raise Conflict(path) from None
        finally:
            os.unlink(draft)
        return
    jvm = spark.sparkContext._jvm  # other file systems: a rename that refuses to overwrite
    hadoop = jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    draft = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        hadoop.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
            draft, target, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as exc:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(exc):
            raise Conflict(path) from None
        raise


class Store:
    """A table in versions. A version is a manifest, a small file `_versions/<number>` that names the folders of its rows.

    Data goes to folders that nobody reads yet; publishing the manifest makes them a version, all at once. A number can be
    published once, so of two writers that start from one version the second gets a Conflict and builds on the new one. Versions
    stay as they are, so readers keep what they have begun to read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> tuple[int, list[str], str | None]:
        """Number, folders and schema of the latest version; 0 for an empty store."""
        try:
            files = self.spark.read.option("wholetext", "true").text(f"{self.path}/_versions/*[0-9]").select(
                F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).cast("long").alias("n"), "value")
            row = files.agg(F.max(F.struct("n", "value")).alias("v")).first()["v"]
        except AnalysisException as exc:  # only a missing folder means that nothing has been published
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        if row is None:
            return 0, [], None
        manifest = json.loads(row["value"])
        return row["n"], manifest["folders"], manifest["schema"]

    def write(self, df: DataFrame) -> str:
        """Rows in a folder of their own, not part of any version yet."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def rows(self, folders: list[str], schema: str | StructType) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema)) if isinstance(schema, str) else schema
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame | None:
        """Rows of the latest version, None for an empty store."""
        _, folders, schema = self.latest()
        return None if schema is None else self.rows(folders, schema)

    def publish(self, version: int, folders: list[str], schema: str) -> None:
        put_if_absent(self.spark, f"{self.path}/_versions/{version}", json.dumps({"folders": folders, "schema": schema}))

    def append(self, df: DataFrame, *, by=None) -> int:
        """A new version with the rows of `df` besides those there. With `by`, keys that another writer has saved meanwhile keep its rows."""
        folder, schema = self.write(df), df.schema.json()
        while True:
            version, folders, known = self.latest()
            if by is not None and known is not None:
                mine, theirs = self.rows([folder], df.schema), self.rows(folders, known).select(*keys_of(by)).distinct()
                if not mine.join(theirs, keys_of(by), "left_semi").isEmpty():
                    folder = self.write(mine.join(theirs, keys_of(by), "left_anti"))
            try:
                self.publish(version + 1, [*folders, folder], known or schema)
                return version + 1
            except Conflict:
                continue

    def delete(self, keys: DataFrame, *, by) -> int:
        """A new version without the rows of `keys`. Folders that hold none of them are taken over as they are."""
        k = keys_of(by)
        gone = cut_lineage(keys.select(*k).distinct())
        while True:
            version, folders, schema = self.latest()
            if schema is None:
                return 0
            hit = [f for f in folders if not self.rows([f], schema).join(gone, k, "left_semi").isEmpty()]
            kept = [f for f in folders if f not in hit]
            if hit:
                kept.append(self.write(self.rows(hit, schema).join(gone, k, "left_anti")))
            try:
                self.publish(version + 1, kept, schema)
                return version + 1
            except Conflict:
                continue


def load_or_compute(spark: SparkSession, path: str, keys: DataFrame, compute, *, by="match_id",
                    config_hash: str) -> DataFrame:
    """Results for `keys`: those saved in the store under `path` for this configuration, plus `compute(missing keys)`, saved.

    Two runs at once may work the same keys out, but each key is saved by one of them only. A key that yields no row is
    computed again on the next call.
    """
    k, store = keys_of(by), Store(spark, path)
    saved = store.read()
    left = keys if saved is None else pending(keys, saved, by=by, config_hash=config_hash)
    store.append(compute(left).withColumn("config_hash", F.lit(config_hash)), by=[*k, "config_hash"])
    return store.read().filter(F.col("config_hash") == config_hash).join(keys.select(*k).distinct(), k, "left_semi")


def result_documents(summary: DataFrame, clips: DataFrame, *, by="match_id", fields=("clip_no", "kind", "confidence", "t", "minute", "status")) -> DataFrame:
    """One JSON document per run with its clips inside; clips per run are bounded by the moments top-k."""
    keys = keys_of(by)
    nested = clips.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("clips"))
    rows = summary.join(nested, keys, "left")
    body = F.struct(*[c for c in rows.columns])
    return rows.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def write_results(df: DataFrame, path: str, *, by="match_id", fmt: str = "parquet", buckets: int = 256) -> None:
    """Writes results in `buckets` folders by key hash, so many matches do not become many tiny files."""
    bucket = F.pmod(F.xxhash64(*keys_of(by)), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).write.mode("errorifexists").partitionBy("bucket").format(fmt).save(path)


def write_captions(df: DataFrame, path: str, *, by="match_id", text: str = "caption", buckets: int = 256) -> None:
    """Captions with their keys as JSON lines (line breaks stay, escaped), in folders by key hash."""
    write_results(df.select(*keys_of(by), text), path, by=by, fmt="json", buckets=buckets)
