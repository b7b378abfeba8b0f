"""Small files of a run, on the driver's file system or, where a path has a scheme (``hdfs://``, ``s3a://``, ``file://``), on any that Hadoop knows."""

from __future__ import annotations

import os
import shutil
import uuid

from countershift.errors import DecompositionError


class _Local:
    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def is_folder(self, path: str) -> bool:
        return os.path.isdir(path)

    def make_folder(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)

    def move(self, source: str, target: str) -> None:
        os.replace(source, target)

    def put(self, local: str, target: str) -> None:
        shutil.copyfile(local, target)

    def delete(self, path: str) -> None:
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.exists(path):
            os.unlink(path)

    def read(self, path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    def write(self, path: str, text: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


class _Hadoop:
    def __init__(self, path: str):
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        if spark is None:
            raise DecompositionError(f"{path} needs a Spark session")
        self.jvm = spark._jvm
        self.fs = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def is_folder(self, path: str) -> bool:
        return self.exists(path) and self.fs.getFileStatus(self._path(path)).isDirectory()

    def make_folder(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def move(self, source: str, target: str) -> None:
        # a rename does not replace everywhere
        self.fs.delete(self._path(target), False)
        if not self.fs.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} can't be moved to {target}")

    def put(self, local: str, target: str) -> None:
        self.fs.copyFromLocalFile(False, True, self._path(f"file://{os.path.abspath(local)}"), self._path(target))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self.fs.open(self._path(path))
            try:
                return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise OSError(path) from e

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def files_of(path: str):
    """The file system of a path: exists, is_folder, make_folder, move, put, delete, read, write."""
    return _Hadoop(path) if "://" in path else _Local()


def joined(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}" if "://" in folder else os.path.join(folder, name)


def write_atomic(path: str, text: str) -> None:
    """Write beside the target, then rename over it."""
    files = files_of(path)
    if files.is_folder(path):
        raise DecompositionError(f"{path} is a folder")
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        files.write(temporary, text)
        files.move(temporary, path)
    finally:
        if files.exists(temporary):
            files.delete(temporary)
