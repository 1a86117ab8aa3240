"""Putting rewritten partitions in the place of old ones, whole or not at all.

New partitions are written to ``_swap-.../new`` below the table, which readers of the table pass over.  Once all are there a
file ``ready`` is set beside them.  Then each partition's old folder is moved to ``_swap-.../old``, the new
one to its place, and at last the rest is deleted.  Whoever finds such a folder later carries on: with ``ready`` the
remaining partitions are moved, without it the folder is deleted, so a table is never left between two states for
longer than until ``repair``.  Files are moved by name, not copied.  A reader that has listed the table before a
swap may not find its files any more, as after any overwrite.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

PREFIX = "_swap-"
#: The folder name of a missing partition value.
DEFAULT = "__HIVE_DEFAULT_PARTITION__"


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def folders(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(name)) if s.isDirectory())

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def move(self, source: str, target: str) -> None:
        self.system.mkdirs(self.path(target).getParent())
        if not self.system.rename(self.path(source), self.path(target)):
            raise OSError(f"could not move {source} to {target}")


def beside(spark: SparkSession, path: str) -> str:
    """A folder for the new partitions of the table at ``path``."""
    return f"{path.rstrip('/')}/{PREFIX}{uuid.uuid4().hex}/new"


def swap_in(spark: SparkSession, path: str, new: str, depth: int) -> None:
    """Move all partitions written to ``new`` (from ``beside``), ``depth`` folders deep, into the table."""
    files = _Files(spark, path)
    folder = new.removesuffix("/new")
    with_depth = files.system.create(files.path(f"{folder}/ready.part"), True)
    with_depth.write(bytearray(str(depth).encode()))
    with_depth.close()
    files.move(f"{folder}/ready.part", f"{folder}/ready")
    _finish(files, path.rstrip("/"), folder, depth)


def _finish(files: _Files, path: str, folder: str, depth: int) -> None:
    for partition in _partitions(files, f"{folder}/new", depth):
        if files.exists(f"{path}/{partition}"):
            files.move(f"{path}/{partition}", f"{folder}/old/{partition}")
        files.move(f"{folder}/new/{partition}", f"{path}/{partition}")
    files.delete(folder)


def _partitions(files: _Files, folder: str, depth: int) -> list[str]:
    names = [n for n in files.folders(folder) if "=" in n]
    if depth == 1:
        return names
    return [f"{n}/{below}" for n in names for below in _partitions(files, f"{folder}/{n}", depth - 1)]


def repair(spark: SparkSession, path: str) -> None:
    """End what an earlier swap of the table at ``path`` has left: carry it on if all was written, else drop it."""
    files, path = _Files(spark, path), path.rstrip("/")
    for name in files.folders(path):
        if name.startswith(PREFIX):
            folder = f"{path}/{name}"
            if files.exists(f"{folder}/ready"):
                stream = files.system.open(files.path(f"{folder}/ready"))
                depth = int(chr(stream.read()))
                stream.close()
                _finish(files, path, folder, depth)
            else:
                files.delete(folder)


def remove(spark: SparkSession, path: str, partition: str) -> None:
    """Delete one partition's folder."""
    _Files(spark, path).delete(f"{path.rstrip('/')}/{partition}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders at ``path``, none where there is nothing."""
    return _Files(spark, path).folders(path)
