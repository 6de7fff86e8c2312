"""Column statistics as mergeable sketches, kept by file, so that only files not met before are read.

A store holds, for each file and column, counts and three of Spark's sketches: distinct values (HLL), quantiles (KLL) and common values (frequent
items); a group of columns is kept as one column of their joint values. Statistics of the table merge the sketches of the files it has now: files
that went are left out, a rewritten file is read again. Sketches have a fixed size, whatever a file holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farsight.sources.facts import files

#: Values that the sketch of common values tracks; up to so many distinct ones are counted exactly.
TRACKED = 2000
_FILE = ["file_path", "file_size", "modified"]


@dataclass(frozen=True)
class Store:
    """A table of sketches by file at `path`, of the table at `table`: its columns, and groups of columns."""

    spark: SparkSession
    table: str
    path: str
    columns: tuple[str, ...]
    groups: tuple[tuple[str, ...], ...] = ()

    def _known(self) -> DataFrame | None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.parquet(self.path)

    def _sketched(self, rows: DataFrame) -> DataFrame:
        """A row for each file and column or group."""
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        file = [F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time").alias("modified")]
        values = {c: F.col(c) for c in self.columns} | {group_name(g): F.when(reduce(Column.__and__, (F.col(c).isNotNull() for c in g)), F.to_json(F.struct(*g))) for g in self.groups}
        named = rows.select(*file, *(v.alias(f"v{i}") for i, v in enumerate(values.values())))
        aggregates = [F.count("*").alias("n_rows")]
        for i, name in enumerate(values):
            number = isinstance(kinds.get(name), T.NumericType)
            aggregates += [F.count(f"v{i}").alias(f"n{i}"), F.hll_sketch_agg(F.col(f"v{i}").cast("string"), 14).alias(f"d{i}"), F.expr(f"approx_top_k_accumulate(cast(v{i} as string), {TRACKED})").alias(f"c{i}")]
            aggregates.append((F.kll_sketch_agg_double(F.col(f"v{i}").cast("double")) if number else F.lit(None).cast("binary")).alias(f"q{i}"))
        part = lambda i, name: F.struct(F.lit(name).alias("column_name"), F.col(f"n{i}").alias("n_values"), F.col(f"d{i}").alias("distinct"), F.col(f"q{i}").alias("quantiles"), F.col(f"c{i}").alias("common"))
        return named.groupBy(*_FILE).agg(*aggregates).select(*_FILE, "n_rows", F.inline(F.array(*(part(i, name) for i, name in enumerate(values)))))

    def refresh(self) -> list[str]:
        """Sketch the files that the store doesn't know; returns their paths."""
        known, now = self._known(), files(self.spark, self.table)
        new = now if known is None else now.join(known.select(*_FILE).distinct(), _FILE, "left_anti")
        paths = [r["file_path"] for r in new.select("file_path").collect()]  # Spark's driver lists the files of a table anyway
        if paths:
            plain = lambda p: p.split(":", 1)[-1].strip("/")
            reader = self.spark.read if [plain(p) for p in paths] == [plain(self.table)] else self.spark.read.option("basePath", self.table)  # a table may be one file
            rows = reader.parquet(*paths)
            self._sketched(rows).write.mode("append").parquet(self.path)
        return paths

    def current(self) -> DataFrame:
        """The sketches of the files that the table has now."""
        return self._known().join(files(self.spark, self.table).select(*_FILE), _FILE, "left_semi")

    def statistics(self, bounds: int = 100, common: int = 100) -> DataFrame:
        """(column_name, n_rows, null_frac, n_distinct, bounds, common): merged; bounds of bins of equal counts (numbers only), common values with counts."""
        shares = F.array(*(F.lit(i / bounds) for i in range(bounds + 1)))
        merged = self.current().groupBy("column_name").agg(
            F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
            F.kll_merge_agg_double("quantiles").alias("q"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(common, {TRACKED}), {common})").alias("common"),
        )
        has = F.kll_sketch_get_n_double("q") > 0
        return merged.select(
            "column_name", "n_rows", F.when(F.col("n_rows") == 0, 0.0).otherwise(1 - F.col("n_values") / F.col("n_rows")).alias("null_frac"), "n_distinct",
            F.when(has, F.kll_sketch_get_quantile_double("q", shares)).alias("bounds"), F.transform(F.filter("common", lambda x: x["item"].isNotNull()), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n"))).alias("common"),
        )


def group_name(columns: tuple[str, ...]) -> str:
    """How a group of columns is named in the store."""
    return "+".join(columns)


def group_shares(statistics: DataFrame, columns: tuple[str, ...]) -> dict[tuple, float]:
    """Joint shares of the common values of a group (as text), for the statistics of a table."""
    row = statistics.where(F.col("column_name") == group_name(columns)).select("n_rows", F.transform("common", lambda x: F.struct(*(F.get_json_object(x["value"], f"$.{c}").alias(c) for c in columns), x["n"].alias("n_"))).alias("common")).first()
    return {} if row is None else {tuple(x[c] for c in columns): x["n_"] / row["n_rows"] for x in row["common"] or []}
