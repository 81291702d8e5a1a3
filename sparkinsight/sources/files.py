"""File sources."""

from __future__ import annotations

import os
import re
import uuid
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sha256 import resumable, take_up
from ..functions.text import INTEGER_TEXT, NUMERIC_TEXT, fits, integer_type
from ..schema import normalise
from ..session import materialize, scratch_path, ship_package

# Text read as missing (the pandas CSV defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Boolean text recognised by CSV inference.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

SUPPORTED = {"csv": "csv", "parquet": "parquet", "txt": "text", "db": "sqlite", "sqlite": "sqlite",
             "sqlite3": "sqlite"}


def read_csv(spark: SparkSession, path: str, **opts) -> DataFrame:
    """CSV with a header; NA tokens -> NULL; a column becomes bigint / double /
    boolean only when every non-null value parses (dates stay text, as pandas does).
    Quoted fields may hold doubled quotes and line breaks, so one file is read by one
    task: give large data as a folder of many files.  Whole numbers beyond 64 bits become
    decimal(38, 0), or stay text beyond 38 digits.
    All columns are read as text first, then one aggregation decides the types."""
    options = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', "multiLine": True, **opts}
    raw = spark.read.options(**options).csv(path)
    cols = raw.columns
    na = F.array(*[F.lit(t) for t in NA_TOKENS])
    clean = raw.select(*[F.when(F.array_contains(na, F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c)
                         for c in cols])
    bools = F.array(*[F.lit(t) for t in TRUE_TOKENS + FALSE_TOKENS])
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x.rlike(INTEGER_TEXT)).alias(f"i{i}"),
                 *fits(c, i), F.count_if(x.rlike(NUMERIC_TEXT) | x.isin("inf", "-inf", "Infinity", "-Infinity")).alias(f"d{i}"),
                 F.count_if(F.array_contains(bools, x)).alias(f"b{i}")]
    row = clean.agg(*aggs).first() if cols else None
    out = []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        if n == 0:
            out.append(F.col(c).cast("double").alias(c))
        elif row[f"i{i}"] == n:
            kind = integer_type(row, i)
            out.append(F.col(c) if kind is None else F.expr(f"try_cast(trim(`{c}`) AS {kind})").alias(c))
        elif row[f"d{i}"] == n:
            out.append(F.expr(f"try_cast(trim(`{c}`) AS double)").alias(c))
        elif row[f"b{i}"] == n:
            out.append(F.col(c).isin(*TRUE_TOKENS).alias(c))
        else:
            out.append(F.col(c))
    return normalise(clean.select(*out))


def read_text_documents(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """One row per text file: (source file name, whole text, partition columns...).

    Bytes that are not valid UTF-8 become replacement characters.  Spark's reader holds every file that it lists in
    the driver.  ``key`` names the one partition column (kept as text) of a folder with more files than that, as
    ``write_text_documents`` leaves it: the tasks list and read it themselves, if all of them see it as files.
    """
    reader = spark.read.option("basePath", path)
    if key is not None:
        root = _shared_root(spark, path)
        if root is not None:
            return _listed_by_tasks(spark, root, key)
        reader = reader.schema(f"value string, `{key}` string")
    df = reader.text(path, wholetext=True)
    extra = [c for c in df.columns if c != "value"]
    return df.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"), *extra)


# Characters that a folder name holds escaped, as Spark's partitioned writer does.
PATH_ESCAPES = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
ESCAPED = re.compile("%([0-9A-Fa-f]{2})")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _shared_root(spark: SparkSession, path: str) -> str | None:
    """The local path of a folder that all tasks see as files; None for any other file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    return place.getPath() if place.getScheme() == "file" else None


# Names and bytes of text that a reading task hands on at once.
FOLDERS_AT_ONCE = 10_000
TEXT_AT_ONCE = 4 << 20


def _folder_lister(root: str, key: str):
    """The names of the folders ``key=value`` below ``root``, handed on while the folder is read."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            with os.scandir(root) as entries:
                names = (e.name for e in entries if e.name.startswith(f"{key}=") and e.is_dir())
                while some := list(islice(names, FOLDERS_AT_ONCE)):
                    yield pa.RecordBatch.from_pydict({"folder": pa.array(some, pa.string())})
    return run


def _text_reader(root: str):
    """(file name, bytes, value) of the files in the folders ``key=value``; hidden and empty ones are no data, as for Spark."""
    def run(batches):
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.string()))],
                                              names=["source", "text", "value"])

        for b in batches:
            for folder in b.column(0).to_pylist():
                value = folder.split("=", 1)[1]
                value = None if value == NO_VALUE else ESCAPED.sub(lambda m: chr(int(m[1], 16)), value)
                for at, _, names in os.walk(os.path.join(root, folder)):
                    for name in names:
                        if name[0] in "._":
                            continue
                        with open(os.path.join(at, name), "rb") as f:
                            text = f.read()
                        if text:
                            rows.append((name, text, value))
                            held += len(text)
                        if held > TEXT_AT_ONCE:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()
    return run


def _listed_by_tasks(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The files of ``read_text_documents``; one task reads the names of the folders, all tasks what is in them."""
    ship_package(spark)
    folders = spark.range(1, numPartitions=1).mapInArrow(_folder_lister(root, key), "folder string")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    read = folders.repartition(n, "folder").mapInArrow(_text_reader(root), "source string, text binary, value string")
    return read.select("source", F.col("text").cast("string").alias("text"), F.col("value").alias(key))


def _text_writer(root: str, key: str):
    """Writes the (key, text) rows of a task, sorted by key: a file per key, shown only when it is whole."""
    def run(batches):
        def close():
            if out is not None:
                out.close()
                os.replace(out.name, os.path.join(os.path.dirname(out.name), "part.txt"))

        now, out, n = None, None, 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = NO_VALUE if k is None else PATH_ESCAPES.sub(lambda m: f"%{ord(m[0]):02X}", k)
                if name != now:
                    close()
                    folder = os.path.join(root, f"{key}={name}")
                    os.makedirs(folder, exist_ok=True)
                    # hidden from readers until complete; a repeated task writes the same name
                    now, out = name, open(os.path.join(folder, f"_part-{uuid.uuid4().hex}"), "wb")
                    n += 1
                out.write(t + b"\n" if t is not None else b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})
    return run


def write_text_documents(docs: DataFrame, path: str, key: str, text: str) -> None:
    """One text file per ``key`` below ``path`` (folder ``key=value``), each text with a newline behind.

    A folder that all tasks see as files is written by the tasks themselves: Spark's writer needs
    several file system commands for every file.  Any other path is left to Spark's writer.
    """
    spark = docs.sparkSession
    root = _shared_root(spark, path)
    if root is None:
        docs.select(key, text).repartition(key).write.partitionBy(key).text(path)
        return
    ship_package(spark)
    rows = docs.select(F.nullif(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("binary").alias("t"))
    written = rows.repartition("k").sortWithinPartitions("k").mapInArrow(_text_writer(root, key), "files long")
    written.agg(F.sum("files")).collect()  # one number


# Fixed value: a stream longer than this is hashed block after block, each by a task of its own.
HASH_BLOCK = 128 << 20
# Fixed value: endings of files that Hadoop's line reader would unpack.
PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|lzo|zst)$"
BOM = b"\xef\xbb\xbf"


def _reader(spark: SparkSession, kind: str, glob: str | None = None):
    reader = spark.read.format(kind)
    return reader.option("pathGlobFilter", glob) if glob else reader


def content_hash(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file name, first 12 hex digits of the SHA-256 of the file bytes, whole path).

    A large file is read in pieces by many tasks and hashed a block at a time; one with the ending of a
    packed file, which Spark's splitting reader would unpack, is read whole as the small ones are.
    """
    large = (F.col("_metadata.file_size") > HASH_BLOCK) & ~F.col("_metadata.file_name").rlike(PACKED)
    files = _reader(spark, "binaryFile", glob).load(path)
    out = files.where(~large).select("path", F.sha2("content", 256).alias("hash"))
    listed = files.where(large).select("path", F.col("_metadata.file_path").alias("id"))
    if not listed.isEmpty():
        lines = _reader(spark, "text", glob).option("lineSep", "\n").load(path).where(large)
        found = _stream_hash(lines, listed.select("id", F.col("id").alias("key"), F.lit(0).cast("bigint").alias("before")))
        out = out.unionByName(found.join(listed, found["key"] == listed["id"]).select("path", "hash"))
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.substring("hash", 1, 12).alias("hash"), "path")


def parts_hash(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(``key``, first 12 hex digits of the SHA-256) of the text files of every folder ``key=value`` below
    ``path``, taken one behind the other in the order that Spark's writer numbers them in."""
    files = _reader(spark, "binaryFile").load(path + "/*").select(
        F.regexp_extract("path", f"/{key}=([^/]+)/", 1).alias("key"), "path", "length", F.col("_metadata.file_path").alias("id"))
    # one row per file; numbers beyond five digits make a longer name
    earlier = Window.partitionBy("key").orderBy(F.length("path"), "path").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select("id", "key", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("before"))
    lines = _reader(spark, "text").option("lineSep", "\n").load(path + "/*")
    return _stream_hash(lines, listed).select(F.col("key").alias(key), F.substring("hash", 1, 12).alias("hash"))


def _join_lines(batches):
    """The bytes of each run of lines of one piece of a file, a newline behind every line."""
    n = 0
    for b in batches:
        ends = {e for c in ("id", "start") for e in pc.run_end_encode(b.column(c)).run_ends.to_pylist()}
        at = 0
        for end in sorted(ends):
            text = b"\n".join([*b.column("line").slice(at, end - at).to_pylist(), b""])
            yield pa.RecordBatch.from_pydict({
                "id": [b.column("id")[at].as_py()], "size": [b.column("size")[at].as_py()],
                "start": [b.column("start")[at].as_py()], "n": [n], "bytes": [len(text)], "content": pa.array([text], pa.binary())})
            at, n = end, n + 1


def _stream_hash(lines: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, hash) of streams made of files: ``lines`` is Spark's text reader over the files, split at line feeds,
    ``listed`` has the ``key`` of the stream a file ``id`` belongs to and the bytes ``before`` it there.

    SHA-256 takes the bytes in order, so a round hashes one block of every stream: its task reads that block and
    the state that the round before left.  Many tasks read the files; none reads a stream whole.
    """
    spark = lines.sparkSession
    ship_package(spark)
    read = lines.select(F.col("_metadata.file_path").alias("id"), F.col("_metadata.file_size").alias("size"),
                        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = read.mapInArrow(_join_lines, "id string, size long, start long, n long, bytes long, content binary")
    place = scratch_path(spark, "pieces")
    at = F.col("before") + F.col("start")
    block = F.floor(at / HASH_BLOCK) if resumable() else F.lit(0)
    # the list has a row per file
    pieces.join(F.broadcast(listed), "id").withColumn("at", at).withColumn("block", block.cast("bigint")) \
        .write.partitionBy("block").parquet(place)
    pieces = spark.read.parquet(place)
    # the reader drops a byte order mark and does not tell whether the last line had its line feed: the sizes do
    over = F.sum("bytes") - F.first("size")
    sizes = pieces.groupBy("id").agg(over.alias("over"), F.max(F.struct("start", "n")).alias("last"), F.min(F.struct("start", "n")).alias("first"))
    here = F.struct("start", "n")
    content = F.when((here == F.col("first")) & F.col("over").isin(-3, -2), F.concat(F.lit(BOM), "content")).otherwise(F.col("content"))
    content = F.when((here == F.col("last")) & F.col("over").isin(1, -2), F.substring(content, F.lit(1), F.length(content) - 1)).otherwise(content)
    wrong = F.raise_error(F.concat(F.lit("not read byte for byte: "), "id")).cast("binary")
    content = F.when(F.col("over").isin(0, 1, -2, -3), content).otherwise(wrong)
    sizes = materialize(sizes)
    states = None
    for b in sorted(r["block"] for r in pieces.select("block").distinct().collect()):  # one number a block
        rows = pieces.where(F.col("block") == b).join(F.broadcast(sizes), "id").select(
            "key", F.lit(False).alias("begun"), "at", "n", content.alias("content"))
        if states is not None:
            rows = rows.unionByName(states.select("key", F.lit(True).alias("begun"), F.lit(-1).cast("bigint").alias("at"),
                                                  F.lit(0).cast("bigint").alias("n"), F.col("state").alias("content")))
        states = materialize(rows.repartition("key").sortWithinPartitions("key", "at", "n")
                             .mapInArrow(take_up, "key string, state binary, hash string"))
    return states.select("key", "hash") if states is not None else listed.select("key", F.lit("").alias("hash")).limit(0)


def read_any(spark: SparkSession, path: str, file_type: str = "auto", table: str | None = None) -> DataFrame:
    """Dispatch on the (lower-case) extension or a forced type."""
    kind = file_type.lower()
    if kind == "auto":
        ext = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
        kind = SUPPORTED.get(ext, ext)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "parquet":
        return normalise(spark.read.parquet(path))
    if kind in ("text", "txt"):
        return read_text_documents(spark, path)
    if kind == "sqlite":
        from .sqlite import read_sqlite
        if not table:
            raise ValueError("a table name is needed for a SQLite database")
        return read_sqlite(spark, path, table)
    raise ValueError(f"Unsupported file type: {kind}")


def fragment_frame(spark: SparkSession, rows: list[list]) -> DataFrame | None:
    """A table fragment as extracted (its first row holds the column names); None without data rows.

    Names that are missing or repeated get their place as a suffix, so no column is lost.
    """
    if len(rows) < 2:
        return None
    names, seen = [], set()
    for k, name in enumerate(rows[0]):
        name = "" if name is None else str(name)
        names.append(f"{name}_{k}" if not name or name in seen else name)
        seen.add(name)
    cells = [[None if x is None else str(x) for x in (*r[:len(names)], *[None] * (len(names) - len(r)))] for r in rows[1:]]
    return spark.createDataFrame(cells, ", ".join("`" + n.replace("`", "``") + "` string" for n in names))


def union_fragments(frames: list[DataFrame | None]) -> DataFrame:
    """Concatenate table fragments by column name (missing columns -> NULL);
    fragments without data rows are skipped."""
    keep = [f for f in frames if f is not None and not f.isEmpty()]
    if not keep:
        raise ValueError("no fragment has data rows")
    out = keep[0]
    for f in keep[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
