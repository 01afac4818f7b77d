"""Folders that readers see whole or not at all.

Every write goes to a version folder of its own. When all of it is there, a manifest with
the next number names it; readers follow the highest manifest. A writer that fails leaves
a folder that no manifest names, and the version before stays as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

MANIFESTS = "_manifests"
END = "\n"  # a manifest without it is still being written


def _open(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_version(path: str) -> str:
    """The name of a folder to write into before ``publish``."""
    return f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    system, folder = _open(spark, f"{path.rstrip('/')}/{MANIFESTS}")
    if not system.exists(folder):
        return []
    return sorted(int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit())


def _named(spark: SparkSession, path: str, number: int) -> str | None:
    system, file = _open(spark, f"{path.rstrip('/')}/{MANIFESTS}/{number:012d}")
    stream = system.open(file)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return text.removesuffix(END) if text.endswith(END) else None


def publish(spark: SparkSession, path: str, version: str) -> int:
    """Make a fully written version the current one; returns the manifest's number.

    The file system creates a number only once, so of two writers the later one takes the
    next number.
    """
    number = max(_numbers(spark, path), default=0) + 1
    while True:
        system, file = _open(spark, f"{path.rstrip('/')}/{MANIFESTS}/{number:012d}")
        if system.exists(file):
            number += 1
            continue
        stream = system.create(file, False)
        try:
            stream.write(bytearray(f"{version.rsplit('/', 1)[-1]}{END}".encode()))
        finally:
            stream.close()
        return number


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the current version; ``path`` itself if nothing was ever published in it."""
    for number in reversed(_numbers(spark, path)):
        name = _named(spark, path, number)
        if name:
            return f"{path.rstrip('/')}/{name}"
    return path


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete published versions but for the last ``keep``, which slow readers may still read.

    Manifests stay, and so do folders without one: they may be written just now.
    """
    named = [name for n in _numbers(spark, path) if (name := _named(spark, path, n))]
    for name in set(named) - set(named[-max(1, keep) :]):
        system, folder = _open(spark, f"{path.rstrip('/')}/{name}")
        system.delete(folder, True)
