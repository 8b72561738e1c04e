"""Existence and deletion of paths on any file system Spark knows."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _on_file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    system, hadoop_path = _on_file_system(spark, path)
    return system.exists(hadoop_path)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder without the hidden ones; none if there is no folder. Files are not opened."""
    system, hadoop_path = _on_file_system(spark, path)
    if not system.exists(hadoop_path):
        return []
    names = (status.getPath().getName() for status in system.listStatus(hadoop_path))
    return sorted(name for name in names if not name.startswith((".", "_")))


def read_text(spark: SparkSession, path: str) -> str:
    system, hadoop_path = _on_file_system(spark, path)
    stream = system.open(hadoop_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Writes a file that is seen under its name only when complete."""
    publish_bytes(spark, folder, name, text.encode())


def publish_bytes(spark: SparkSession, folder: str, name: str, content: bytes) -> None:
    """Writes a file that is seen under its name only when complete; it must be new."""
    if not publish_first(spark, folder, name, content):
        raise FileExistsError(f"{folder}/{name}")


def publish_first(spark: SparkSession, folder: str, name: str, content: bytes) -> bool:
    """Writes a file that is seen under its name only when complete, unless there is one: of several writers one succeeds.

    HDFS does not rename onto a file that exists; a local file system would, so there the name is given by a link.
    """
    system, hidden = _on_file_system(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    target = _on_file_system(spark, f"{folder}/{name}")[1]
    stream = system.create(hidden)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    if system.getUri().getScheme() != "file":
        done = not system.exists(target) and system.rename(hidden, target)
    else:
        places = [system.makeQualified(path).toUri().getPath() for path in (target, hidden)]
        nio = spark.sparkContext._jvm.java.nio.file
        try:
            nio.Files.createLink(*[spark.sparkContext._jvm.java.io.File(place).toPath() for place in places])
            done = True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
                raise
            done = False
    system.delete(hidden, False)
    return done


def modified(spark: SparkSession, path: str) -> float:
    """When a path was last changed, in seconds since 1970."""
    system, hadoop_path = _on_file_system(spark, path)
    return system.getFileStatus(hadoop_path).getModificationTime() / 1000


def delete_path(spark: SparkSession, path: str) -> None:
    system, hadoop_path = _on_file_system(spark, path)
    system.delete(hadoop_path, True)
