"""Small files in the store's file system, wherever Spark keeps it."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Paths:
    """Existence, removal and short texts of paths, through the file systems Spark itself uses."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._hadoop.Path(path)
        return place, place.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        place, files = self._at(path)
        return files.exists(place)

    def delete(self, path: str) -> None:
        place, files = self._at(path)
        files.delete(place, True)

    def read(self, path: str) -> str | None:
        """The text of a file, None if there is no such file."""
        place, files = self._at(path)
        if not files.exists(place):
            return None
        stream = files.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replace a file at once: readers see the old text or the new one, never a part."""
        draft, files = self._at(f"{path}.new")
        stream = files.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        option = self._hadoop.Options.Rename
        options = self._spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        source, target = (files.makeQualified(p) for p in (draft, self._hadoop.Path(path)))
        self._hadoop.FileContext.getFileContext(source.toUri(), self._conf).rename(source, target, options)
