"""A cache of results that are keyed by the state of the tables they come from.

The state of a table is a fingerprint of its files (paths, sizes, instants, rows), taken without reading a column. An entry is written beside its
final place and renamed to it with a manifest inside, so it is there whole or not at all. Reading fails open: an entry that is missing, torn
or of another version is computed again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.sources.facts import files, relation_facts

VERSION = 1


def _folded(rows: DataFrame, *columns: str) -> str:
    """A fingerprint of a set of rows, whatever their order: their number, and the sum and parity of their hashes."""
    h = F.xxhash64(*columns)
    n, total, parity = rows.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return f"{n}:{total or 0}:{parity or 0}"


def table_fingerprint(spark: SparkSession, path: str) -> str:
    """Changes with any file of a table that comes, goes or is rewritten."""
    return _folded(files(spark, path), "file_path", "file_size", "modified", "n_rows")


def vectors_fingerprint(queries: DataFrame) -> str:
    """Of query vectors (query_id, qvec), whatever their order."""
    return _folded(queries, "query_id", "qvec")


def cache_key(**parts) -> str:
    """A key of named parts: numbers, text, and lists and dictionaries of these."""
    return hashlib.sha256(json.dumps(parts | {"version": VERSION}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class ResultCache:
    """Entries in a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def load(self, key: str) -> DataFrame | None:
        """The entry, or None where there is none that is whole."""
        path, files_ = self._at(key)
        try:
            if not files_.exists(path):
                return None
            manifest = self.spark.read.json(f"{self.folder.rstrip('/')}/{key}/manifest").first()
            where = f"{self.folder.rstrip('/')}/{key}/rows"
            found = relation_facts(self.spark, where).first()
            if (manifest["version"], manifest["key"], manifest["n_rows"], manifest["n_bytes"]) != (VERSION, key, found["n_rows"], found["n_bytes"]):
                return None
            return self.spark.read.parquet(where)
        except Exception:  # noqa: BLE001  a cache never fails a query
            return None

    def store(self, key: str, result: DataFrame) -> DataFrame:
        """Write an entry (in place of a torn one) and return it; if another writer was first, theirs."""
        temporary = f"writing-{uuid.uuid4().hex}"
        root = f"{self.folder.rstrip('/')}/{temporary}"
        result.write.parquet(f"{root}/rows")
        facts = relation_facts(self.spark, f"{root}/rows").first()
        self.spark.createDataFrame([(VERSION, key, facts["n_rows"], facts["n_bytes"])], "version int, key string, n_rows long, n_bytes long").coalesce(1).write.json(f"{root}/manifest")
        (source, files_), (target, _) = self._at(temporary), self._at(key)
        if files_.exists(target) and self.load(key) is None:
            files_.delete(target, True)
        if not files_.exists(target) and files_.rename(source, target):
            return self.spark.read.schema(result.schema).parquet(f"{self.folder.rstrip('/')}/{key}/rows")
        held = self.load(key)
        if held is None:  # the rename failed: what was written is still whole
            return self.spark.read.schema(result.schema).parquet(f"{root}/rows")
        files_.delete(source, True)
        return held

    def get(self, key: str, compute: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """The result of `compute`, from the cache where it is there, and whether it was."""
        held = self.load(key)
        return (held, True) if held is not None else (self.store(key, compute()), False)
