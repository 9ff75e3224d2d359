"""Shared folders, and small driver-side file operations on any file system that pyarrow knows."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession


def place(path: str) -> tuple[FileSystem, str]:
    """The file system and the path on it; s3a is Spark's name for s3."""
    if path.startswith("s3a://"):
        path = "s3" + path[3:]
    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file://" + path.removeprefix("file:"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a new local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-eventide-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/eventide-{name}-{uuid.uuid4().hex}"


def size_of(path: str) -> int:
    fs, root = place(path)
    return sum(i.size for i in fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True)) if i.type == FileType.File)


def names_in(path: str) -> list[str]:
    fs, root = place(path)
    return sorted(i.base_name for i in fs.get_file_info(FileSelector(root, allow_not_found=True)))


def parts_in(path: str) -> list[tuple[str, int]]:
    """Path and size of the part files that Spark wrote to a folder, in the order of its partitions."""
    fs, root = place(path)
    found = [i for i in fs.get_file_info(FileSelector(root, allow_not_found=True)) if i.base_name.startswith("part-")]
    return [(f"{path}/{i.base_name}", i.size) for i in sorted(found, key=lambda i: int(i.base_name.split("-")[1]))]


def open_input(path: str):
    fs, at = place(path)
    return fs.open_input_stream(at, compression=None)


def read_text(path: str) -> str:
    fs, at = place(path)
    with fs.open_input_stream(at) as stream:
        return stream.read().decode()


#: Hadoop's file systems with a rename that does not overwrite; others are taken for object stores.
RENAMING = ("hdfs", "viewfs", "webhdfs", "swebhdfs")


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file so that it appears whole or not at all; False if there is one of this name already.

    Locally this is a hard link, on HDFS a rename that does not overwrite, and on object stores a conditional create: these show a
    file when it is closed, and the condition is checked by the store. A store that cannot do so is refused with an error.
    """
    scheme = path.partition("://")[0] if "://" in path else "file"
    if scheme != "file":
        return _create_by_hadoop(spark, path, text, scheme)
    fs, at = place(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    name = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(name) as stream:
        stream.write(text.encode())
    try:
        os.link(name, at)
    except FileExistsError:
        return False
    finally:
        fs.delete_file(name)
    return True


def _create_by_hadoop(spark: SparkSession, path: str, text: str, scheme: str) -> bool:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    fs = target.getFileSystem(conf)
    renaming = scheme in RENAMING
    if fs.exists(target):
        return False
    written = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp") if renaming else target
    try:
        builder = fs.createFile(written).recursive().overwrite(False)
        if scheme in ("s3", "s3a", "s3n"):
            builder.must("fs.option.create.conditional.overwrite", True)
        stream = builder.build()
        stream.write(bytearray(text.encode()))
        stream.close()
        if renaming:
            never = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            hadoop.FileContext.getFileContext(target.toUri(), conf).rename(written, target, never)
    except Py4JJavaError as error:
        if any(name in str(error.java_exception) for name in ("FileAlreadyExistsException", "already exists", "PreconditionFailed", "412")):
            return False
        raise
    finally:
        if renaming and fs.exists(written):
            fs.delete(written, False)
    return True


def newest_change(path: str) -> float | None:
    """When a file, or a folder or what it holds, was last changed, in seconds; None if there is none."""
    fs, at = place(path)
    held = [fs.get_file_info(at)]
    if held[0].type == FileType.Directory:
        held += fs.get_file_info(FileSelector(at, recursive=True, allow_not_found=True))
    return max((i.mtime_ns / 1e9 for i in held if i.type != FileType.NotFound and i.mtime_ns is not None), default=None)


def delete_file(path: str) -> None:
    fs, at = place(path)
    fs.delete_file(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that Spark wrote, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bytes_in(spark: SparkSession, path: str) -> int:
    """Bytes of what a folder that Spark wrote holds, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def delete_dir(path: str) -> None:
    fs, at = place(path)
    if fs.get_file_info(at).type == FileType.Directory:
        fs.delete_dir(at)
