"""File sources and sinks.

Raw extracts are read with every column as STRING; types are applied later by
the lenient casts of :mod:`crashlens.functions.scalars`, so a bad cell becomes
NULL (and an error row) instead of failing the job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import domains as D

SEPARATORS = [";", ",", "\t", "|"]

# fixed values: CSV cells that stand for a missing value
MISSING_MARKS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
                 "NaN", "None", "n/a", "nan", "null"]


ORDINAL = "_ord"  # file order of a raw row: its split's number above 33 bits, its place in the split below
_ROW_BITS, _SPLIT_LIMIT = 33, 1 << 29


def _choose_separator(header: str) -> str:
    best = max(SEPARATORS, key=header.count)
    return best if best in header else ","


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length): the files of ``path`` as a listing; no content is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "path", "length")


def first_lines(spark: SparkSession, paths: Sequence[str], threads: int = 32) -> list[str | None]:
    """First line of every file (None: an empty one), decompressed by its ending. Only the first buffer of a file
    is read, on the driver, by several threads: work per file, like a listing, whatever the files' size."""
    jvm = spark.sparkContext._jvm
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())

    def head(path: str) -> str | None:
        fs, target = _folder(spark, path)
        stream = fs.open(target)
        codec = codecs.getCodec(target)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            return reader.readLine()
        finally:
            reader.close()

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(head, paths))


def header_groups(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(header line, files) of every different header among the CSV files of ``path``, in file order; empty files
    have no rows and no group."""
    paths = sorted(r.path for r in _files(spark, path).select("path").collect())
    groups: dict[str, list[str]] = {}
    for name, line in zip(paths, first_lines(spark, paths)):
        if line is not None:
            groups.setdefault(line.rstrip("\r"), []).append(name)
    return list(groups.items())


def detect_separator(spark: SparkSession, path: str) -> str:
    """The separator that occurs most often in the header line of the first file."""
    groups = header_groups(spark, path)
    return _choose_separator(groups[0][0]) if groups else ","


def split_numbers(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """(file, first split) per file of ``path`` in the order of the names, and the bytes that a split has at least;
    None in place of a table with one file. A file's splits begin at multiples of Spark's split size, which is
    no less than the smaller of two settings: ``offset div that`` numbers them in order."""
    conf = spark._jsparkSession.sessionState().conf()
    unit = max(1, min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()))
    files = _files(spark, path).select("file", F.expr(f"length div {unit} + 1").alias("splits"))
    n, splits = files.agg(F.count(F.lit(1)), F.sum("splits")).first()
    if (splits or 0) > _SPLIT_LIMIT:
        raise ValueError(f"{splits} splits are too many to number: raise spark.sql.files.openCostInBytes")
    if n <= 1:
        return None, unit
    # a row per file, as the driver's own listing
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    table = files.select("file", F.coalesce(F.sum("splits").over(before), F.lit(0)).alias("first_split"))
    return (F.broadcast(table) if n <= 200_000 else table), unit


def _in_file_order(table: DataFrame, columns: Sequence[Column], splits: tuple[DataFrame | None, int]) -> DataFrame:
    """``columns`` of a table just read, and ``ORDINAL``: W2's file order, as one BIGINT below 2^62. Spark deals files to
    partitions by size, so partition numbers say nothing; file names, offsets and the place in a split do."""
    firsts, unit = splits
    rows = table.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
                        F.monotonically_increasing_id().alias("_id"))
    rows = rows.withColumn("first_split", F.lit(0)) if firsts is None else rows.join(firsts, "file", "left")
    split = F.col("first_split") + F.expr(f"_at div {unit}")
    place = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))  # rows of a split are read one after another in one task
    return rows.withColumn(ORDINAL, F.shiftleft(split.cast("bigint"), _ROW_BITS) + place).drop("file", "_at", "_id", "first_split")


# fixed values: file endings by format
ENDINGS = {"parquet": (".parquet", ".pq"), "csv": (".csv", ".tsv", ".txt", ".csv.gz", ".tsv.gz", ".txt.gz")}


def file_format(spark: SparkSession, path: str) -> str:
    """The format that a path's ending names, or for a folder without one the ending of a file in it;
    what neither tells is refused."""
    def known(name: str) -> str | None:
        return next((fmt for fmt, endings in ENDINGS.items() if name.lower().endswith(endings)), None)

    fmt = known(path.rstrip("/"))
    if fmt is None and "." not in path.rstrip("/").rsplit("/", 1)[-1]:
        first = spark.read.text(path).select("_metadata.file_name").first()
        fmt = known(first[0]) if first else None
    if fmt:
        return fmt
    raise ValueError(f"cannot tell the format of {path}: pass fmt='csv' or fmt='parquet' (Excel files: convert first)")


def read_raw(spark: SparkSession, path: str, sep: str | None = None, fmt: str | None = None, ordered: bool = False,
             repair: Callable[[DataFrame], DataFrame] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Read a raw extract. CSV: header row, all STRING, missing-value marks as NULL; files are grouped by
    their header line, so names may differ in order, separator (sniffed when not given) and spelling. Each
    group is read for itself, repaired by ``repair`` (S8) and held against ``required`` (S7); groups are united by name, and a
    column that a group lacks is NULL there. Parquet: as stored. ``ordered`` adds ``ORDINAL``, the place in the order of
    file names and lines (W2). ``fmt`` ('csv' or 'parquet') goes before the path's ending; a path
    with neither is refused, as is Excel (convert upstream).
    """
    fmt = fmt or file_format(spark, path)
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported input format {fmt!r}")
    splits = split_numbers(spark, path) if ordered else None
    repair = repair or (lambda df: df)
    if fmt == "parquet":
        table = spark.read.parquet(path)
        out = repair(_in_file_order(table, [F.col("*")], splits) if ordered else table)
        require_columns(out, required, path)
        return out
    groups = header_groups(spark, path)
    parts = []
    for header, files in groups or [("", [path])]:
        table = (spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
                 .option("sep", sep or _choose_separator(header)).option("mode", "PERMISSIVE").csv(path if len(groups) < 2 else files))
        cells = [F.when(~F.col(f"`{c}`").isin(MISSING_MARKS), F.col(f"`{c}`")).alias(c) for c in table.columns]
        part = repair(_in_file_order(table, cells, splits) if ordered else table.select(*cells))
        require_columns(part, required, f"{files[0]} (and {len(files) - 1} more with its header)")
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """S3: CSV scan with a pinned schema (e.g. AccidentUID kept as STRING)."""
    return spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)


class SchemaMismatch(ValueError):
    """An input table lacks columns that its contract names."""


def require_columns(df: DataFrame, required: Iterable[str], name: str) -> None:
    """Check a table's contract on its schema, before any job runs."""
    lacking = set(required).difference(df.schema.fieldNames())
    if lacking:
        raise SchemaMismatch(f"{name} lacks {', '.join(sorted(lacking))}")


def select_columns(df: DataFrame, columns: Sequence[str], name: str = "input") -> DataFrame:
    """Keep only the needed columns (pruned at the scan by Catalyst)."""
    require_columns(df, columns, name)
    return df.select(*columns)


def repair_ch_header(df: DataFrame) -> DataFrame:
    """Rename the misspelt Swiss severity header when the right one is absent."""
    good = "AccidentSeverityCategory"
    if good not in df.columns and D.CH_SEVERITY_TYPO in df.columns:
        return df.withColumnRenamed(D.CH_SEVERITY_TYPO, good)
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = ("AccidentYear",)) -> None:
    """Write a whole table as CSV (header) or Parquet; Parquet is partitioned by year when present
    so a later year filter prunes whole directories. To replace single years, see :func:`replace_years`."""
    w = df.write.mode(mode)
    if fmt == "parquet":
        cols = [c for c in (partition_by or []) if c in df.columns]
        if cols:
            w = w.partitionBy(*cols)
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt}")


YEAR, BATCH = "AccidentYear", "batch"
_DONE = "_batches"  # a file per finished batch: its name orders them, its text lists the years


def _folder(spark: SparkSession, path: str):
    """Hadoop's (file system, path)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    fs, target = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def _finished(spark: SparkSession, path: str) -> dict[int, str]:
    """The batch that holds each year: the last finished one that names it."""
    names = [n for n in _listed(spark, f"{path}/{_DONE}") if not n.startswith((".", "_"))]
    lines = first_lines(spark, [f"{path}/{_DONE}/{n}" for n in names])
    return {int(year): name for name, line in zip(names, lines) for year in (line or "").split()}


def replace_years(df: DataFrame, path: str, years: Sequence[int] | None = None) -> list[int]:
    """Write the given years of ``df`` (default: those it holds) in place of what the table at ``path`` has of them;
    other years stay as they are. A year named but not in ``df`` becomes empty. Returns the years.

    One job writes all years into folders of a new batch; the batch counts once its name is put among the finished
    ones, by one rename of a small file. A reader sees all the old years or all the new ones, never a part, and a
    write that fails changes nothing. One writer at a time; see :func:`drop_old_batches`."""
    spark = df.sparkSession
    if years is None:
        df = materialise(df, "years")  # read twice: for its years, and to be written
        years = [r[0] for r in df.select(YEAR).distinct().collect() if r[0] is not None]
    years = sorted({int(y) for y in years})
    last = max((n for n in _listed(spark, f"{path}/{_DONE}") if n[0].isdigit()), default="0-")
    batch = f"{int(last.split('-')[0]) + 1:010d}-{uuid.uuid4().hex[:8]}"
    rows = df.where(F.col(YEAR).isin(years)).withColumn(BATCH, F.lit(batch))
    rows.write.mode("append").partitionBy(YEAR, BATCH).parquet(path)

    fs, hidden = _folder(spark, f"{path}/{_DONE}/.{batch}")
    out = fs.create(hidden)
    out.write(bytearray(" ".join(map(str, years)), "ascii"))
    out.close()
    if not fs.rename(hidden, _folder(spark, f"{path}/{_DONE}/{batch}")[1]):
        raise OSError(f"cannot finish batch {batch} of {path}")
    return years


def read_years(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of years at ``path`` as of now, with a year column that prunes folders."""
    held = _finished(spark, path)
    folders = [f"{path}/{YEAR}={y}/{BATCH}={b}" for y, b in sorted(held.items()) if f"{BATCH}={b}" in _listed(spark, f"{path}/{YEAR}={y}")]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.fieldNames())


def drop_old_batches(spark: SparkSession, path: str) -> int:
    """Remove the folders of batches that a later one replaced or that never finished; to be called when no
    writer is at work and no reader of the old ones is left. Returns how many."""
    held, gone = _finished(spark, path), 0
    for year in [y for y in _listed(spark, path) if y.startswith(f"{YEAR}=")]:
        for name in _listed(spark, f"{path}/{year}"):
            if name.startswith(f"{BATCH}=") and name != f"{BATCH}={held.get(int(year.split('=')[1]))}":
                fs, target = _folder(spark, f"{path}/{year}/{name}")
                gone += fs.delete(target, True)
    return gone


PARTITION_BYTES, MOST_PARTITIONS = 8 << 20, 20_000  # of input files per shuffle partition or bucket; as session.CLUSTER


def partitions_for(*tables: DataFrame) -> int:
    """Shuffle partitions or buckets for the rows of ``tables``: one per ``PARTITION_BYTES`` of the files that they read, so
    that a task's share does not grow with them, and the session's number at least. Files are listed, not read; beyond
    ``MOST_PARTITIONS`` shares grow again, and Spark sorts and aggregates them on disk."""
    spark = tables[0].sparkSession
    files = sorted({unquote(f) for t in tables for f in t.inputFiles()})
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, -(-(size or 0) // PARTITION_BYTES)))


INITIAL_PARTITIONS, ADVISORY_SIZE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def size_shuffles(*tables: DataFrame) -> None:
    """Let the session's shuffles begin with :func:`partitions_for` ``tables``; AQE joins small ones again. With a fixed
    number, the hash maps and sorts of one task grow with the input. The number is raised and never lowered; the size up
    to which AQE joins partitions (64 MB by default, a dozen times that in a task's memory) is set where the
    session has none of its own."""
    conf, n = tables[0].sparkSession.conf, partitions_for(*tables)
    if n > int(conf.get(INITIAL_PARTITIONS, None) or conf.get("spark.sql.shuffle.partitions")):
        conf.set(INITIAL_PARTITIONS, str(n))
        if ADVISORY_SIZE not in conf.getAll:
            conf.set(ADVISORY_SIZE, f"{2 * PARTITION_BYTES}b")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: ``spark.checkpoint.dir`` as the cluster sets it. Where it is unset, a
    session on one machine gets a temporary folder; any other session is refused."""
    from ..session import ensure_checkpoint_dir
    return ensure_checkpoint_dir(spark)


def register_removal(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the session's JVM ends."""
    fs, target = _folder(spark, path)
    fs.deleteOnExit(target)


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage so a lost executor recomputes from this table, not from
    the raw extracts; survives executor loss (unlike local checkpoints). The
    folder is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    # a fresh folder per write: another chain materialising the same name must
    # not overwrite files a lazily read DataFrame still points to
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    register_removal(spark, path)
    w = df.write.mode("errorifexists")
    cols = [c for c in partition_by if c in df.columns]
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)
    # with the schema given, a partition column keeps its type
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
