"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local session has a folder beside its warehouse; a cluster must set it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir") + "/_stages"
    return path.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder; a stopped session leaves it to the folder's owner."""
    try:
        fs, target = _path(spark, path)
        fs.delete(target, True)
    except Exception:  # noqa: BLE001  the session or its gateway has gone
        return


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, target = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, source = _path(spark, path)
    fs.rename(source, _path(spark, to)[1])


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    fs, source = _path(spark, path)
    stream = fs.open(source)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text_once(spark: SparkSession, path: str, text: str) -> bool:
    """A small file, there whole or not at all: it is written aside and renamed. False if ``path`` is taken."""
    fs, target = _path(spark, path)
    aside = _path(spark, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")[1]
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        return False
    return True


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(remove, spark, path)
    return path
