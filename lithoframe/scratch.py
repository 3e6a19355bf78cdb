"""Lineage cuts in the shared checkpoint folder, and files that only one writer can create."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local master may go without: elsewhere executors would write to
    disks of their own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lithoframe-')}"
        sc.setCheckpointDir(root)
    return root


def fresh(spark: SparkSession, label: str) -> str:
    """The path of a folder of its own in the shared one."""
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def create_once(spark: SparkSession, path: str, body: bytes) -> bool:
    """Creates the file whole, unless it exists: whether this call did. Of several writers, one succeeds.

    The body is written under another name first, so no reader sees a part of it. On a local file system the name is made by
    a hard link, elsewhere by a rename; both fail where the name is taken."""
    jvm = spark.sparkContext._jvm
    final, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.draft"))
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, False)
    out.write(bytearray(body))
    out.close()
    try:
        if fs.getScheme() != "file":
            return bool(fs.rename(draft, final))
        made, source = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, draft))
        jvm.java.nio.file.Files.createLink(made, source)
        return True
    except Exception:
        if fs.exists(final):
            return False
        raise
    finally:
        fs.delete(draft, False)
