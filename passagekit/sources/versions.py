"""Which files a table has: a small manifest in its folder, replaced as a whole.

A writer puts its rows into a folder of their own and then replaces the manifest. Readers resolve the
manifest, so they see the table before or after a change and never a part of it. The
replacement is a rename, atomic on file systems that have one, such as HDFS; on an object store
without it, one writer at a time must be arranged for.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

MANIFEST = "_current.json"


def _jvm_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _jvm_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def has_manifest(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_jvm_path(spark, f"{path}/{MANIFEST}"))


def batches(spark: SparkSession, path: str) -> list[dict]:
    """The batches of a table, each with its ``name``, ``paths`` below the table and ``counts``.

    The files of a folder that never had a manifest are one batch; no folder has none.
    """
    files = _file_system(spark, path)
    if has_manifest(spark, path):
        stream = files.open(_jvm_path(spark, f"{path}/{MANIFEST}"))
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)["batches"]
    if not files.exists(_jvm_path(spark, path)):
        return []
    names = [status.getPath().getName() for status in files.listStatus(_jvm_path(spark, path)) if status.isFile()]
    own = sorted(name for name in names if name[0] not in "_.")
    return [{"name": "", "paths": own, "counts": {}}] if own else []


def paths(spark: SparkSession, path: str) -> list[str]:
    """What to read for the table at ``path``: the paths of its manifest, or itself without one."""
    if not has_manifest(spark, path):
        return [path]
    return [f"{path}/{name}" for batch in batches(spark, path) for name in batch["paths"]]


def publish(spark: SparkSession, path: str, batches: list[dict]) -> None:
    """Replace the manifest, so that the table consists of these batches."""
    target = _jvm_path(spark, f"{path}/{MANIFEST}")
    draft = _jvm_path(spark, f"{path}/_draft-{uuid.uuid4().hex}")
    files = _file_system(spark, path)
    out = files.create(draft, False)
    try:
        out.write(bytearray(json.dumps({"batches": batches}), "utf-8"))
    finally:
        out.close()
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark._jsc.hadoopConfiguration()
    )
    context.rename(files.makeQualified(draft), files.makeQualified(target), options)
