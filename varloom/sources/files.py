"""Small files in a folder of any file system that Hadoop's configuration knows; of the local one where no session runs."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession


class Files:
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        spark = SparkSession.getActiveSession()
        self._sc = spark.sparkContext if spark is not None else None

    def _at(self, name: str):
        path = self._sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self._sc._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        if self._sc is None:
            return os.path.exists(os.path.join(self.folder, name))
        fs, path = self._at(name)
        return fs.exists(path)

    def read(self, name: str) -> bytes | None:
        """The file's bytes; None if there is no such file."""
        if not self.exists(name):
            return None
        if self._sc is None:
            with open(os.path.join(self.folder, name), "rb") as f:
                return f.read()
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(self._sc._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Written aside and renamed, so the file is whole or absent."""
        if self._sc is None:
            os.makedirs(self.folder, exist_ok=True)
            part = os.path.join(self.folder, name + ".part")
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, os.path.join(self.folder, name))
            return
        fs, part = self._at(f"_{name}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        _, path = self._at(name)
        fs.delete(path, False)
        if not fs.rename(part, path):
            raise OSError(f"can't write {path}")

    def read_json(self, name: str):
        data = self.read(name)
        return None if data is None else json.loads(data)

    def write_json(self, name: str, value, **kw) -> None:
        self.write(name, json.dumps(value, **kw).encode())
