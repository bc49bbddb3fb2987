"""Small text files beside a table, written once: the commits of versioned tables.

They go through the file system of Spark's session, so any store that Spark reaches will do.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str) -> JavaObject:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    files = _files(spark, folder)
    if not files.exists(_path(spark, folder)):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(_path(spark, folder)))


def read_text(spark: SparkSession, path: str) -> str:
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def commit_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under a name that nobody has taken; False if somebody has.

    The text is written beside it first, and the rename does not overwrite, so a reader sees the whole file or none.
    """
    jvm, files = spark._jvm, _files(spark, path)
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    stream = files.create(_path(spark, draft), False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, draft), _path(spark, path), options)
    except Py4JJavaError as problem:
        files.delete(_path(spark, draft), False)
        if "FileAlreadyExistsException" in str(problem.java_exception.getClass().getName()):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)
