"""Small driver-side file operations through the Hadoop file systems Spark itself uses: what exists, files that are published once, and
parts that become one file."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..session import local_path


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """File names of a folder (none if it does not exist)."""
    fs, p = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all that is in it."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def empty_folder(spark: SparkSession, path: str) -> None:
    """An empty folder in the place of whatever is there."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)
    fs.mkdirs(p)


def _place_of_part(name: str) -> tuple[int, str]:
    """Spark numbers its files by task, in five digits or more."""
    return int(name.split("-")[1]), name


def join_parts(spark: SparkSession, folder: str, first: str) -> str:
    """One file of ``folder``: the line ``first``, then its part files in the order of their numbers. Returns the file's path.

    A file system that joins files by moving their blocks (as a cluster's does) moves no bytes; on any other the bytes
    are copied through a buffer, part after part.
    """
    jvm = spark.sparkContext._jvm
    fs, p = _hadoop(spark, folder)
    parts = [jvm.org.apache.hadoop.fs.Path(p, n) for n in sorted((n for n in names_in(spark, folder) if n.startswith("part-")), key=_place_of_part)]
    whole = jvm.org.apache.hadoop.fs.Path(p, "joined")
    out = fs.create(whole, True)
    try:
        out.write(bytearray(first.encode()))
    finally:
        out.close()
    parts = [x for x in parts if fs.getFileStatus(x).getLen()]
    if not parts:
        return whole.toString()
    if fs.hasPathCapability(p, "fs.capability.paths.concat"):
        listed = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
        for i, x in enumerate(parts):
            listed[i] = x
        fs.concat(whole, listed)
        return whole.toString()
    out = fs.create(whole, True)
    try:
        out.write(bytearray(first.encode()))
        for x in parts:
            source = fs.open(x)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
    return whole.toString()


def replace_folder(spark: SparkSession, source: str, folder: str, name: str) -> None:
    """Make the file ``source`` the folder's only one, called ``name``. It takes the place of an older file of that name in one step."""
    jvm = spark.sparkContext._jvm
    fs, p = _hadoop(spark, folder)
    if fs.exists(p) and not fs.getFileStatus(p).isDirectory():
        fs.delete(p, False)
    fs.mkdirs(p)
    _rename(spark, jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(p, name), "OVERWRITE")
    for old in names_in(spark, folder):
        if old != name:
            fs.delete(jvm.org.apache.hadoop.fs.Path(p, old), True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_once(spark: SparkSession, path: str, text: str) -> bool:
    """Put a whole file at ``path`` unless one is there; False if one is. Of several writers at once exactly one succeeds, and no reader sees a part of the file.

    The text is written beside the target first. On a local disk a hard link gives it its name, elsewhere a rename that
    never replaces, as the file systems of a cluster offer it.
    """
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p.getParent())
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        return _link(path, beside) if fs.getScheme() == "file" else _rename(spark, beside, p)
    finally:
        fs.delete(beside, False)


def _link(path: str, beside) -> bool:
    try:
        os.link(local_path(beside.toString()), local_path(path))
        return True
    except FileExistsError:
        return False


def _rename(spark: SparkSession, source, target, how: str = "NONE") -> bool:
    jvm = spark.sparkContext._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = getattr(rename, how)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
