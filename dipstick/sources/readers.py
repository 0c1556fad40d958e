"""Ledger files in: CSV, folders of sheets, several candidate sources."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dipstick.config import SERVE, Tank
from dipstick.functions import calendar
from dipstick.operators import clean, features

SHEET_SUFFIXES = (".xlsx", ".xls", ".xlsm")
MIN_SHEET_ROWS = 5
HEAD_BLOCK = 1 << 16  # bytes read at a time in search of a header
FEW_ROWS = 500


def text_schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, every cell text: no inference pass; types come from the coercion rules."""
    reader = spark.read.option("header", True)
    if columns is not None:
        reader = reader.schema(text_schema(columns)).option("enforceSchema", False)
    return reader.csv(path)


def read_csv_dated(spark: SparkSession, path, columns: Sequence[str] | None = None, date: str = "Date") -> DataFrame:
    """CSV whose date column is parsed on the way in."""
    df = read_csv(spark, path, columns)
    return df.withColumn(date, calendar.parse_date(F.col(date)))


def list_sheets(spark: SparkSession, folder: str) -> list[str]:
    """Sheet names in order: the files, or folders of part files, directly under ``folder``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select(_sheet_of(F.col("path"), folder).alias("sheet"))
    )
    return [r.sheet for r in files.distinct().orderBy("sheet").collect()]


def _sheet_of(path: Column, folder: str) -> Column:
    """Path component right below the folder, whatever scheme and host the path is given with."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).rstrip("/")
    return F.regexp_extract(path, f"\\Q{root}\\E/([^/]+)", 1)


def _scanned_path() -> Column:
    """The file a row was read from; the metadata column percent-encodes it."""
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def sheet_heads(spark: SparkSession, folder: str) -> DataFrame:
    """(sheet, path, line, damaged) of every file: its first filled line, from its first block alone.

    A file is opened by the task it is dealt to and read only up to the end of that line. ``damaged``
    is set where the bytes read are no text: they hold a NUL or are not UTF-8.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select(_sheet_of(F.col("path"), folder).alias("sheet"), "path")
    )
    block = HEAD_BLOCK

    def read(batches):
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow import fs

        def head(path: str) -> tuple[str | None, bool]:
            if path.startswith("file:"):
                system, place = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
            else:
                system, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
            seen = b""
            with system.open_input_stream(place) as file:
                while True:
                    more = file.read(block)
                    seen += more
                    lines = seen.splitlines(keepends=True)
                    whole = [x for x in lines if x.endswith((b"\n", b"\r")) or not more]
                    filled = next((x for x in whole if x.strip(b"\xef\xbb\xbf \t\r\n")), None)
                    if filled is not None or not more:
                        break
            try:
                text = None if filled is None else filled.decode("utf-8-sig").rstrip("\r\n")
            except UnicodeDecodeError:
                return None, True
            return (None, True) if b"\0" in seen else (text, False)

        for batch in batches:
            found = [head(p) for p in batch.column(1).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["sheet", "path", "line", "damaged"])

    return files.mapInArrow(read, "sheet string, path string, line string, damaged boolean")


def header_lines(spark: SparkSession, folder: str) -> dict[str, str]:
    """The first filled line of every sheet that can be read; empty and damaged sheets have none."""
    first = sheet_heads(spark, folder).groupBy("sheet").agg(F.min_by("line", F.when(F.col("line").isNotNull(), F.col("path"))).alias("line"), F.bool_or("damaged").alias("damaged"))
    return {r.sheet: r.line for r in first.where("line IS NOT NULL AND NOT damaged").collect()}


def damaged_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """(sheet) of the sheets that a scan skips because a file of theirs is no text."""
    return sheet_heads(spark, folder).where("damaged").select("sheet").distinct()


def header_names(line: str, case_sensitive: bool = False) -> tuple[str, ...]:
    """Column names of a header line without escapes as a CSV scan gives them: unnamed ones by place, repeated ones numbered."""
    names = next(csv.reader([line]))
    folded = names if case_sensitive else [n.lower() for n in names]
    return tuple(f"_c{i}" if not n else f"{n}{i}" if folded.count(folded[i]) > 1 else n for i, n in enumerate(names))


def scan_sheets(spark: SparkSession, folder: str, sheets: Sequence[str] | None = None) -> DataFrame:
    """All sheets by column name, absent columns NULL, with ``_sheet`` telling where a row came from.

    Sheets with the same header share one scan, so jobs and plan grow with the number of different
    headers, not of files. Only headers are read beforehand. An empty sheet is skipped, as is one
    that is no text; ``damaged_sheets`` lists these.
    """
    root = folder.rstrip("/")
    by_line: dict[str, list[str]] = defaultdict(list)
    lines = header_lines(spark, folder)
    for sheet in sheets if sheets is not None else sorted(lines):
        if sheet in lines:
            by_line[lines[sheet]].append(f"{root}/{sheet}")
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    case_sensitive = spark.conf.get("spark.sql.caseSensitive") == "true"
    for line, paths in by_line.items():
        if '""' in line or "\\" in line:  # escapes are left to Spark's own reading
            names = tuple(spark.read.option("header", True).csv(paths[0]).columns)
        else:
            names = header_names(line, case_sensitive)
        by_header[names] += paths
    if not by_header:
        raise ValueError(f"no readable sheet in {folder}")
    scans = [
        clean.rename_date(clean.trim_names(read_csv(spark, paths, header))).withColumn(
            "_sheet", _sheet_of(_scanned_path(), folder)
        )
        for header, paths in by_header.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def sheet_sizes(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("_sheet").agg(F.count("*").alias("n_rows"))


def qualifying_rows(scanned: DataFrame, min_rows: int = MIN_SHEET_ROWS) -> DataFrame:
    """Rows of sheets with more than ``min_rows`` rows."""
    big = sheet_sizes(scanned).where(F.col("n_rows") > min_rows).select("_sheet")
    return scanned.join(big, "_sheet", "left_semi")


def combine_sheets(rows: DataFrame) -> DataFrame:
    """Exact duplicates removed before dates are parsed; rows without a date dropped.

    Duplicate means equal in all columns, NULLs alike; the date alone never decides.
    """
    merged = rows.dropDuplicates()
    date = clean.date_column(merged)
    return merged if date is None else clean.parse_dates(merged, date)


def read_sheets(spark: SparkSession, folder: str, min_rows: int = MIN_SHEET_ROWS) -> DataFrame:
    """A workbook kept as a folder of sheets.

    No sheet large enough: the first one as it is. Exactly one: that one as it is, duplicates
    kept. Several: combined. Only sheet names and sizes reach the driver.
    """
    sheets = list_sheets(spark, folder)
    scanned = scan_sheets(spark, folder, sheets)
    sizes = {r["_sheet"]: r["n_rows"] for r in sheet_sizes(scanned).collect()}
    big = [s for s in sheets if sizes.get(s, 0) > min_rows]
    if len(big) > 1:
        return combine_sheets(scan_sheets(spark, folder, big).drop("_sheet"))
    return scan_sheets(spark, folder, big or sheets[:1]).drop("_sheet")


def read_first_sheet(spark: SparkSession, folder: str) -> DataFrame:
    return scan_sheets(spark, folder, list_sheets(spark, folder)[:1]).drop("_sheet")


def source_kind(name: str) -> str:
    """``sheets`` for workbook names, else ``csv``."""
    return "sheets" if name.lower().endswith(SHEET_SUFFIXES) else "csv"


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """One ledger source by its suffix. A workbook is a folder of sheets under the workbook's name."""
    return read_sheets(spark, path) if source_kind(path.rstrip("/")) == "sheets" else read_csv(spark, path)


def read_ledger(spark: SparkSession, path: str, cfg: Tank = SERVE) -> DataFrame:
    """One source, normalised. An unreadable source raises; nothing made up takes its place."""
    return features.normalise(read_source(spark, path), cfg)


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException:
        return False
    return True


def existing_sources(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    return [p for p in paths if path_exists(spark, p)]


def source_sizes(sources: Sequence[DataFrame]) -> DataFrame:
    """(ord, n_rows) per candidate source, counted in one job."""
    counts = [s.agg(F.lit(i).alias("ord"), F.count("*").alias("n_rows")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionAll, counts)


def largest(sources: Sequence[DataFrame]) -> int:
    """Position of the source with most rows; the first wins ties."""
    order = F.struct(F.col("n_rows"), -F.col("ord"))
    return source_sizes(sources).agg(F.max_by("ord", order)).first()[0]


def largest_source(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Of the sources that exist, the one with most rows, not normalised."""
    found = existing_sources(spark, paths)
    if not found:
        raise ValueError("none of the ledger sources exists")
    sources = [read_source(spark, p) for p in found]
    return sources[largest(sources)]


def row_count_check(df: DataFrame, least: int = FEW_ROWS) -> DataFrame:
    """Rows per station and whether that is suspiciously few."""
    return (
        df.groupBy("station_id")
        .agg(F.count("*").alias("n_rows"))
        .withColumn("low", F.col("n_rows") < least)
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy("Date", "station_id").limit(n)
