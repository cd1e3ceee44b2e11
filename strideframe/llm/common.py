"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strideframe.session import scratch_path

#: Bytes of a table that may be sent to every executor; larger ones are joined by shuffle or handled in blocks.
BROADCAST_BYTES = 32 << 20

#: Shared by the byte-level operators: A-Z to a-z, everything else as it is.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs one stage, not the whole plan.

    ``keep(df)`` writes Parquet and reads it back with the schema it was written with; ``drop(df)`` removes a table
    that nothing will read again. What a returned DataFrame still reads stays until the session's owner clears the folder.

    The shuffle files behind a written table are of no more use; Spark is asked to remove them when the table stands
    (by default it waits for the driver's collector), so that finished steps don't fill the executors' disks.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, scratch_path(spark, name), {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        before = self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (path, back)
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it (columns are told without their case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df as they are, also those with dots or spaces in their names."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    """A column's name as it is, not as a path into a struct."""
    return "`" + name.replace("`", "``") + "`"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any name, dots included: they travel by number."""
    names, count = df.columns, len(schema.fields)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(count)])

    out = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(numbered, out).toDF(*schema.names)


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(column: Column, characters: str) -> Column:
    """The text without the given characters: one byte-level pass each, much cheaper than translate or a regex."""
    for c in characters:
        column = F.replace(column, F.lit(c), F.lit(""))
    return column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, however often the body names it and the optimiser moves it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Element i combines all values up to i: spans of 1, 4, 16 ... values, up to beyond the longest array there can be."""
    def step(a: Column, k: int) -> Column:
        def reach(x: Column, i: Column) -> Column:
            out = F.when(i < k, x)
            for back in (1, 2, 3):
                x = combine(x, F.get(a, i - back * k))
                if (back + 1) * k >= 1 << 31:
                    return out.otherwise(x)
                out = out.when(i < (back + 1) * k, x) if back < 3 else out.otherwise(x)
            return out

        return F.when(F.size(a) <= k, a).otherwise(F.transform(a, reach))

    for power in range(16):
        values = let(values, lambda a, k=4**power: step(a, k))
    return values
