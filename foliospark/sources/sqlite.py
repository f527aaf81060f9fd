"""Tables of an SQLite file as DataFrames. Spark reads the file's bytes, and those of its write-ahead log where there is
one; a task opens a copy of both in its own scratch folder and reads all tables that are asked for in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in schema.split(", ")]  # type: ignore[misc]


def read_tables(spark: SparkSession, path: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """The tables (name: columns and types) of the database at path, a snapshot of it as it is when this is called.

    A database is one file, so one task opens it; rows come in batches, so that no table is held whole. What a
    program has written but not yet moved from the log into the file is read as well.
    """
    wide = "_table string, " + ", ".join(f"`{t}.{c}` {kind}" for t, schema in tables.items() for c, kind in _columns(schema))
    kinds = spark.createDataFrame([], wide).schema

    def rows(batches):
        import os
        import shutil
        import sqlite3
        import tempfile

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kinds)
        cast = lambda x, f: None if x is None else (str(x) if pa.types.is_string(f.type) else x)
        top = tempfile.mkdtemp()
        try:
            for batch in batches:
                for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                    with open(os.path.join(top, name), "wb") as f:
                        f.write(content)
            db = sqlite3.connect(os.path.join(top, "db"))
            for table, schema in tables.items():
                names = [c for c, _ in _columns(schema)]
                cursor = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM {chr(34)}{table}{chr(34)}")
                while found := cursor.fetchmany(5000):
                    held = dict(zip((f"{table}.{c}" for c in names), zip(*found)))
                    column = lambda f: [table] * len(found) if f.name == "_table" else [cast(x, f) for x in held[f.name]] if f.name in held else [None] * len(found)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(column(f), f.type) for f in target], schema=target)
            db.close()
        finally:
            shutil.rmtree(top)

    file = spark.read.format("binaryFile").load(path).select(F.lit("db").alias("name"), "content")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}-wal")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        file = file.union(spark.read.format("binaryFile").load(f"{path}-wal").select(F.lit("db-wal"), "content"))
    found = cut(file.coalesce(1).mapInArrow(rows, kinds))
    return {t: found.where(F.col("_table") == t).select(*[F.col(f"`{t}.{c}`").alias(c) for c, _ in _columns(schema)]) for t, schema in tables.items()}
