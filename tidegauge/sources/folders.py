"""The few file system calls Spark's readers and writers do not cover, through the cluster's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _open(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder this run wrote itself, such as an old version of its state."""
    fs, target = _open(spark, path)
    fs.delete(target, True)


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Paths of all files below a folder."""
    fs, target = _open(spark, path)
    found, listed = [], fs.listFiles(target, True)
    while listed.hasNext():
        found.append(listed.next().getPath().toString())
    return sorted(found)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Gives a file its final name in one step; an existing file stays and is an error."""
    fs, target = _open(spark, path)
    if not fs.rename(target, _open(spark, to)[1]):
        raise FileExistsError(f"{path} cannot be renamed to {to}")


def set_modified(spark: SparkSession, path: str, millis: int) -> None:
    """Sets the modification time of a file, or of the files directly in a folder."""
    fs, target = _open(spark, path)
    for status in fs.listStatus(target):
        if status.isFile():
            fs.setTimes(status.getPath(), millis, -1)


def newest_modified(spark: SparkSession, path: str) -> int:
    """Newest modification time of the files directly in a folder, in milliseconds."""
    fs, target = _open(spark, path)
    return max(s.getModificationTime() for s in fs.listStatus(target) if s.isFile())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small new file."""
    fs, target = _open(spark, path)
    out = fs.create(target, False)
    out.write(bytearray(text.encode()))
    out.close()
