"""SQLite tables as a Spark Python Data Source.

``path`` is one database file or a folder of database shards (``*.db``).
Partitions are (file, rowid range) pairs, so each task reads its own slice
straight from a database file opened read-only on the executor.  The files must
sit on a file system every executor can read (a shared mount).
"""

from __future__ import annotations

import glob
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# SQLite declared-type affinity -> Spark type.
AFFINITY = [("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"),
            ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double")]


def _spark_type(decl: str) -> str:
    d = (decl or "").upper()
    if not d:
        return "string"
    for key, t in AFFINITY:
        if key in d:
            return t
    return "double"


def _connect(path: str):
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def posix_path(path: str) -> str:
    """SQLite needs a mounted file system: accept plain paths and ``file:`` URIs."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    if "://" in path:
        raise ValueError(f"SQLite databases need a mounted (POSIX) path, not {path}")
    return path


def database_files(path: str) -> list[str]:
    path = posix_path(path)
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "*.db")))
    return [path]


class _RowidRange(InputPartition):
    def __init__(self, path, lo, hi):
        super().__init__((path, lo, hi))
        self.path, self.lo, self.hi = path, lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table = options["path"], options["table"]
        self.n = int(options.get("numPartitions", "4"))
        self.schema = schema

    def partitions(self):
        out = []
        for f in database_files(self.path):
            with _connect(f) as con:
                lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            if lo is None:
                continue
            step = max((hi - lo + 1 + self.n - 1) // self.n, 1)
            out += [_RowidRange(f, s, min(s + step - 1, hi)) for s in range(lo, hi + 1, step)]
        return out or [_RowidRange(database_files(self.path)[0], 0, -1)]

    def read(self, partition):
        cols = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with _connect(partition.path) as con:
            cur = con.execute(f'SELECT {cols} FROM "{self.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid',
                              (partition.lo, partition.hi))
            for row in cur:
                yield tuple(row)


class SqliteDataSource(DataSource):
    """``spark.read.format("sqlite").option("path", db).option("table", t).load()``"""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        files = database_files(self.options["path"])
        if not files:
            raise ValueError(f"no SQLite database at {self.options['path']}")
        with _connect(files[0]) as con:
            info = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not info:
            raise ValueError(f"no such table: {self.options['table']}")
        return ", ".join(f"`{r[1]}` {_spark_type(r[2])}" for r in info)

    def reader(self, schema):
        return _Reader(self.options, schema)


def register(spark: SparkSession) -> None:
    from ..session import ship_package
    ship_package(spark)
    spark.dataSource.register(SqliteDataSource)


def read_sqlite(spark: SparkSession, db_path: str, table: str, partitions: int = 4) -> DataFrame:
    """``SELECT * FROM table`` as a DataFrame (name ``db::table`` in the catalog)."""
    register(spark)
    return (spark.read.format("sqlite").option("path", db_path).option("table", table)
            .option("numPartitions", str(partitions)).load())


def list_tables(spark: SparkSession, db_path: str) -> DataFrame:
    """Table names of a SQLite database (from ``sqlite_master``)."""
    register(spark)
    m = spark.read.format("sqlite").option("path", db_path).option("table", "sqlite_master") \
        .option("numPartitions", "1").load()
    return m.where(F.col("type") == "table").select(F.col("name"))


# Spark type -> SQLite declared type for written shards.
DECLARED = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER",
            "double": "REAL", "float": "REAL", "string": "TEXT", "boolean": "INTEGER", "binary": "BLOB"}


def write_sqlite_shards(df: DataFrame, folder: str, table: str) -> DataFrame:
    """Write every partition of ``df`` as its own SQLite database ``part-<n>.db``
    under ``folder`` (one writer per task, no single-file bottleneck).  Returns a
    frame of (file, rows) per written shard; run it with an action."""
    from ..session import ship_package
    ship_package(df.sparkSession)
    folder = posix_path(folder)
    cols = [(f.name, DECLARED.get(f.dataType.simpleString(), "TEXT")) for f in df.schema.fields]
    ddl = ", ".join(f'"{c}" {t}' for c, t in cols)
    names = [c for c, _t in cols]

    def write(it):
        import uuid
        import pandas as pd
        from pyspark import TaskContext
        os.makedirs(folder, exist_ok=True)
        ctx = TaskContext.get()
        final = os.path.join(folder, f"part-{ctx.partitionId():05d}.db")
        tmp = f"{final}.{uuid.uuid4().hex}.tmp"  # a retried task never sees a half file
        con = sqlite3.connect(tmp)
        con.execute(f'CREATE TABLE "{table}" ({ddl})')
        n = 0
        for pdf in it:
            rows = [tuple(None if pd.isna(v) else (v.item() if hasattr(v, "item") else v) for v in r)
                    for r in pdf[names].itertuples(index=False, name=None)]
            con.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', rows)
            n += len(rows)
        con.commit()
        con.close()
        os.replace(tmp, final)
        yield pd.DataFrame({"file": [final], "rows": [n]})

    return df.mapInPandas(write, "file string, rows bigint")
