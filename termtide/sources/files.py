"""Small files of the driver beside the data: manifests and commit files."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file, over an earlier one."""
    place, fs = _place(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    place, fs = _place(spark, path)
    source = fs.open(place)
    try:
        data = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)
    finally:
        source.close()
    return bytes(data).decode()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of a folder's visible files and folders, sorted; none if there is no such folder."""
    place, fs = _place(spark, path)
    if not fs.exists(place):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(place))
    return sorted(n for n in names if n[:1] not in "._")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its content at once; False if another writer was first.

    The content is written under another name and then given this one, which fails where the name is taken:
    by a hard link on a local disk, elsewhere by a rename that does not replace, which has to be atomic
    there, as it is on HDFS.
    """
    jvm = spark.sparkContext._jvm
    place, fs = _place(spark, path)
    draft = f"{place.getParent()}/.draft-{uuid.uuid4().hex}"
    write_text(spark, draft, text)
    held, _ = _place(spark, draft)
    try:
        if fs.getScheme() == "file":
            paths = jvm.java.nio.file.Paths
            target, source = (paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0)) for p in (place, held))
            jvm.java.nio.file.Files.createLink(target, source)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(held, place, options)
    except (Py4JJavaError, PySparkException) as error:
        if "FileAlreadyExists" not in str(getattr(error, "java_exception", error)):
            raise
        return False
    finally:
        fs.delete(held, False)
    return True


def file_marks(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Name, size and time of files, sorted; their content is not read."""
    marks = []
    for path in sorted(paths):
        place, fs = _place(spark, path)
        status = fs.getFileStatus(place)
        marks.append((path, status.getLen(), status.getModificationTime()))
    return marks
