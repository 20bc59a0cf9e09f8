"""Small files of a store (logs, references, index descriptions) on any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, new: bool = False) -> None:
        """new: fails (FileExistsError) if the file is there already, which makes the write a put-if-absent."""
        fs, p = self._at(path)
        if new and fs.exists(p):
            raise FileExistsError(path)
        try:
            stream = fs.create(p, not new)
        except Exception as error:
            if new and fs.exists(p):
                raise FileExistsError(path) from error
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(to))

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
