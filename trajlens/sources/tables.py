"""Named input tables with fallback locations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from trajlens.operators.ordering import local_table

CHECK_SCHEMA = "alias string, filename string, status string, path string"


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True
) -> DataFrame:
    """Scan by file type: Parquet, ORC and JSON by suffix, anything else as CSV.

    Without a schema, CSV types are inferred, which reads the file once more.
    Give a schema for large CSV tables.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("parquet", "orc", "json"):
        return reader.format(kind).load(path)
    return reader.csv(path, header=header, inferSchema=schema is None)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that the path belongs to."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


@dataclass(frozen=True)
class TableSet:
    """Aliases of tables and the folders they may live in, first match wins."""

    spark: SparkSession
    files: Mapping[str, str]
    folders: Sequence[str]
    schemas: Mapping[str, StructType | str] | None = None

    def _candidates(self, filename: str) -> list[str]:
        return [f"{folder.rstrip('/')}/{filename}" for folder in self.folders]

    def locate(self, filename: str) -> str | None:
        return next((p for p in self._candidates(filename) if path_exists(self.spark, p)), None)

    def read(self, alias: str) -> DataFrame:
        """Read by alias; a name that is no alias is taken as a file name."""
        filename = self.files.get(alias, alias)
        path = self.locate(filename)
        if path is None:
            raise FileNotFoundError(f"table {filename} not found, looked at: " + ", ".join(self._candidates(filename)))
        return read_table(self.spark, path, (self.schemas or {}).get(alias))

    def read_available(self) -> dict[str, DataFrame]:
        """All tables that exist, as lazy scans."""
        return {alias: self.read(alias) for alias, name in self.files.items() if self.locate(name) is not None}

    def _status(self) -> list[tuple[str, str, str, str | None]]:
        rows = []
        for alias, name in self.files.items():
            path = self.locate(name)
            if path is None:
                rows.append((alias, name, "MISSING", None))
            else:
                rows.append((alias, name, "OK" if path == self._candidates(name)[0] else "ALT", path))
        return rows

    def check(self) -> DataFrame:
        """``(alias, filename, status, path)`` with status OK, ALT (other folder) or MISSING."""
        return local_table(self.spark, self._status(), CHECK_SCHEMA)

    def missing(self, allow_alternative: bool = True) -> dict[str, str]:
        """Missing tables by alias; without alternatives only the first folder counts."""
        accepted = ("OK", "ALT") if allow_alternative else ("OK",)
        return {alias: name for alias, name, status, _ in self._status() if status not in accepted}

    def validate(self, allow_alternative: bool = True) -> None:
        missing = self.missing(allow_alternative)
        if missing:
            listed = "\n".join(f"- {alias}: {name}" for alias, name in missing.items())
            raise FileNotFoundError(f"required tables are missing in {self.folders[0]}:\n{listed}")
