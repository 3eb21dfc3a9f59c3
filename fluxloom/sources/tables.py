"""CSV scans and table sinks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom import schemas
from fluxloom.operators.reshape import stack

#: A gzip file of at most this many bytes holds no rows.
EMPTY_GZIP_BYTES = 29


#: Bytes of a file that a header probe reads at a time.
PROBE = 1 << 16


def first_line(path: str) -> tuple[str | None, int]:
    """First line of a file that is not blank, and the bytes read for it: blocks until a line ends.

    Compressed files are told by their names. The path is one that the listing gave, in any store that pyarrow
    opens; others raise an error.
    """
    if path.startswith("file:"):
        store, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        store, at = fs.FileSystem.from_uri(path)
    held, read = b"", 0
    with store.open_input_stream(at, compression="detect", buffer_size=PROBE) as stream:
        while True:
            block = stream.read(PROBE)
            read += len(block)
            held += block
            *whole, tail = re.split(rb"\r\n|\n|\r", held)
            for line in whole if block else [*whole, tail]:
                if line.strip():
                    return line.decode(errors="replace"), read
            if not block:
                return None, read
            held = tail


def file_headers(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, header, read, problem) of every matching file below ``path``.

    A listing names the files and tasks open their first block each, so what is read does not grow with the
    files. ``header`` is null for a file without a line, and where ``problem`` says why it could not be opened.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)

    def probe(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    found.append((*first_line(path), None))
                except (OSError, ValueError, NotImplementedError) as error:
                    found.append((None, 0, f"{type(error).__name__}: {error}"))
            header, read, problem = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(header, pa.string()), pa.array(read, pa.int64()), pa.array(problem, pa.string())],
                names=["path", "header", "read", "problem"],
            )

    # Content is not selected, so the listing opens no file.
    return listing.load(path).select("path").mapInArrow(probe, "path string, header string, read long, problem string")


def scan_text_csv(spark: SparkSession, path: str, pattern: str = "*final_CH4_fluxes*") -> DataFrame:
    """Every matching file below ``path``, all columns as text.

    One read maps columns by position, so files of different headers must not share it. Files are
    grouped by their header line, each layout is one parallel scan, and the scans stack by name.
    Only file names and headers reach the driver, as in any file listing. Files in a store that only Spark
    opens are read once for their headers. Without any line in any file the result has no columns.
    """
    layouts: dict[str, list[str]] = {}
    unopened: list[str] = []
    probed = file_headers(spark, path, pattern).where("header is not null or problem is not null")
    for row in probed.groupBy("header").agg(F.collect_list("path").alias("paths")).toLocalIterator():
        if row.header is None:
            unopened = row.paths
        else:
            layouts[row.header] = row.paths
    if unopened:
        # One split per file starts at byte 0, so ``first`` sees its lines in file order.
        lines = spark.read.text(unopened).where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
        headers = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.first("value").alias("header"))
        for row in headers.groupBy("header").agg(F.collect_list("path").alias("paths")).toLocalIterator():
            layouts.setdefault(row.header, []).extend(row.paths)
    scans = [spark.read.csv(paths, header=True, nullValue="NA") for _, paths in sorted(layouts.items())]
    return stack(scans) if scans else spark.createDataFrame([], "")


def scan_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """Typed CSV scan, gzip or plain; ``NA`` is null and the schema is never inferred."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="NA", enforceSchema=False)


def scan_forecasts(spark: SparkSession, path: str, min_bytes: int = EMPTY_GZIP_BYTES) -> DataFrame:
    """All forecast files of the output folder except empty ones, judged by size before reading.

    A file whose header does not name the expected columns in their order is an error, not misread.
    """
    files = spark.read.schema(schemas.FORECASTS).csv(path, header=True, nullValue="NA", enforceSchema=False)
    return files.where(F.col("_metadata.file_size") > min_bytes)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode="overwrite") -> None:
    """Parquet for the engine's own tables; ``csv`` or ``csv.gz`` for interchange."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    elif fmt in ("csv", "csv.gz"):
        codec = "gzip" if fmt == "csv.gz" else "none"
        writer.option("header", True).option("nullValue", "NA").option("compression", codec).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


#: Partition columns of the forecast store: one directory per model, issue date and variant.
CATALOG_KEYS = ("model_id", "reference_datetime", "variant")
CATALOG_SCHEMA = "model_id string, reference_datetime date, variant string, modified_at timestamp"


def write_forecast(df: DataFrame, path: str) -> None:
    """Store forecasts; writing an issue date again replaces only that issue date's directory."""
    # Rebalancing gathers a directory into few files and still splits one too large for a task.
    write_table(df.hint("rebalance", *CATALOG_KEYS), path, partition_by=CATALOG_KEYS)


def forecast_catalog(spark: SparkSession, path: str) -> DataFrame:
    """What the forecast store holds: keys and the last modification of each directory.

    A file listing with its partition columns; no file is opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    if not set(CATALOG_KEYS) <= set(files.columns):  # a folder without any stored forecast has no partitions
        return spark.createDataFrame([], CATALOG_SCHEMA)
    return files.groupBy(*CATALOG_KEYS).agg(F.max("modificationTime").alias("modified_at"))
