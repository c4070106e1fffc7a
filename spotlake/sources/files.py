"""Readers of spot archives, daily reports, cluster lines, reference lists, node ledgers and sample files.

Malformed lines are kept apart, never silently dropped: each reader of text returns the good rows and its bad_* counterpart the others,
by the negation of the same condition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a spot archive line (JSON).
SPOT = "id string, source string, mode string, band string, timestamp bigint, ingestedAt bigint, frequency bigint, dxCall string, deCall string, dxGrid string, deGrid string, dxLat double, dxLon double, deLat double, deLon double, dxDxcc bigint, deDxcc bigint, dxContinent string, deContinent string, dxCqZone int, snr int, snrRefHz int, wpm int, decodeConfidence double, decoderVersion string, channelizerResolutionHz double, baud double, rst string, qrlQuery boolean, seq bigint"
REPORT = "callsign string, de_pfx string, de_cont string, freq double, band string, dx string, dx_pfx string, dx_cont string, mode string, db int, date string, speed double, tx_mode string"
_NEEDED = ("id", "timestamp", "frequency", "dxCall")


def _spot_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(SPOT + ", kind string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def _spot_is_bad():
    missing = F.lit(False)
    for c in _NEEDED:
        missing = missing | F.col(c).isNull()
    return F.col("_bad").isNotNull() | (F.col("kind").isNull() & missing)


def read_spots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Spots of JSON lines; lines with a `kind` are grades and left out."""
    return _spot_lines(spark, path).where(~_spot_is_bad() & F.col("kind").isNull()).drop("kind", "_bad")


def bad_spot_lines(spark: SparkSession, path: str | list[str]) -> int:
    return _spot_lines(spark, path).select("_bad", "kind", *_NEEDED).where(_spot_is_bad()).count()


def read_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reports of daily CSV files, columns found by their header: spotter, call, freq_hz, snr, wpm, time (Unix seconds), mode, archive."""
    rows = _report_lines(spark, path)
    return rows.where(_report_is_good()).drop("value")


def bad_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of daily CSV files that are no report: archive, value (the fields, comma-joined)."""
    return _report_lines(spark, path).where(~_report_is_good()).select("archive", "value")


def _report_is_good():
    return F.coalesce((F.col("call") != "") & F.col("freq_hz").isNotNull() & F.col("time").isNotNull(), F.lit(False))


def _report_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    when = F.unix_timestamp(F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss")))
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    return rows.select(
        F.regexp_replace(F.upper(F.trim("callsign")), "-#$", "").alias("spotter"), F.upper(F.trim("dx")).alias("call"), (number("freq") * 1000).alias("freq_hz"), number("db").alias("snr"), number("speed").alias("wpm"),
        when.alias("time"), "mode", F.input_file_name().alias("archive"), F.concat_ws(",", *[F.col(f"`{c}`") for c in rows.columns]).alias("value"),
    )


#: spotter, kHz, call, mode, dB, WPM, type, HHMM of a cluster line.
DX_LINE = r"^(?:(\S+)\s+)?DX de\s+(\S+?)(?:-#)?:\s+([0-9]+\.[0-9]+)\s+(\S+)\s+(\S+)\s+(-?[0-9]+) dB\s+(?:([0-9]+) (?:WPM|BPS)\s+)?(?:(\S+)\s+)?([0-9]{4})Z"


def parse_dx_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with when (a leading ISO time or ''), spotter, khz, call, mode, snr, wpm, kind, hhmm; rows that are no cluster line are left out."""
    part = lambda i: F.regexp_extract(column, DX_LINE, i)
    found = lines.where(F.col(column).rlike(DX_LINE))
    wpm = F.when(part(7) != "", part(7)).cast("int")
    return found.select("*", part(1).alias("when"), part(2).alias("spotter"), part(3).cast("double").alias("khz"), part(4).alias("call"), part(5).alias("mode"), part(6).cast("int").alias("snr"), wpm.alias("wpm"), part(8).alias("kind"), part(9).alias("hhmm"))


def bad_dx_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The rows that parse_dx_lines() leaves out."""
    return lines.where(~F.coalesce(F.col(column).rlike(DX_LINE), F.lit(False)))


#: Columns of a call, and mode names that may abut it.
CALL_COLUMN, MODES = 15, "CW|RTTY|FT8|FT4|PSK31|PSK63"


def parse_skimmer_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with kind (spot, other_mode, none) and, for spots, spotter, khz, call, snr, wpm, type (CQ, DE, BEACON or unknown).

    Fields are frequency, call, perhaps a mode, dB figure, `dB`, speed, unit, perhaps a type, time. A call that fills its column may abut the field after it.
    """
    split = F.regexp_extract_all(F.regexp_replace(F.col(column), r"^\s*DX de [^:]*:", ""), F.lit(r"\S+"), F.lit(0))
    name = F.regexp_extract(column, r"^\s*DX de ([^:]*):", 1)
    second = F.get("__t", F.lit(1))
    head, tail = F.substring(second, 1, CALL_COLUMN), F.substring(second, F.lit(CALL_COLUMN + 1), F.length(second))
    is_int = lambda c: F.coalesce(F.rlike(c, F.lit(r"^[+-]?[0-9]{1,9}$")), F.lit(False))
    db_at = lambda i: F.coalesce(F.get("__t", F.lit(i)) == "dB", F.lit(False))
    abuts = (F.length(second) > CALL_COLUMN) & ((db_at(3) & F.rlike(tail, F.lit(f"^(?:{MODES})$"))) | (db_at(2) & is_int(tail)))
    fixed = F.when(abuts, F.concat(F.slice("__t", 1, 1), F.array(head, tail), F.slice("__t", 3, F.greatest(F.size("__t") - 2, F.lit(0))))).otherwise(F.col("__t"))
    rows = lines.withColumn("__who", F.regexp_replace(F.upper(F.trim(name)), "-#$", "")).withColumn("__t", split).withColumn("__t", fixed)
    moded = ~(is_int(F.get("__t", F.lit(2))) & db_at(3))
    base = F.when(moded, 3).otherwise(2)
    field = lambda i: F.get("__t", base + i)
    khz = F.expr("try_cast(__t[0] AS DOUBLE)")
    ok = (F.col("__who") != "") & ~F.rlike("__who", F.lit(r"\s")) & (F.size("__t") >= base + 5) & F.coalesce((khz > 0) & (khz < float("inf")), F.lit(False))
    ok = ok & is_int(field(0)) & (field(1) == "dB") & F.rlike(field(2), F.lit("^[0-9]{1,9}$")) & F.rlike(F.element_at("__t", -1), F.lit("^[0-9]{4}Z$"))
    ok = F.coalesce(ok, F.lit(False))
    cw = ok & (~moded | (F.get("__t", F.lit(2)) == "CW")) & (field(3) == "WPM")
    types = F.array_join(F.slice("__t", base + 5, F.greatest(F.size("__t") - base - 5, F.lit(0))), " ")
    kind = F.when(types.isin("CQ", "DE", "BEACON"), types).when(types == "NCDXF B", "BEACON").otherwise("unknown")
    told = lambda c, name: F.when(cw, c).alias(name)
    return rows.select(
        *lines.columns, F.when(cw, "spot").when(ok, "other_mode").otherwise("none").alias("kind"), told(F.col("__who"), "spotter"), told(khz, "khz"), told(F.upper(F.get("__t", F.lit(1))), "call"),
        told(field(0).try_cast("int"), "snr"), told(field(2).try_cast("int"), "wpm"), told(kind, "type"),
    )


LEDGER = "kind string, ts double, reachable boolean, healthz boolean, start_time double, counters map<string,double>, spots map<string,double>, start double, `end` double, planned boolean, manual boolean, text string, cmd string, exit int"


def read_ledger(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of a node ledger (JSON lines): samples, notes and recoveries, by kind; lines of another kind or torn ones are left out."""
    rows = spark.read.schema(LEDGER + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull() & F.col("kind").isin("sample", "note", "recovery")).drop("_bad")


def parse_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """Samples of a metric text: family, labels (map), number. Comments and malformed lines are left out."""
    form = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+-?[0-9]+)?\s*$"
    pairs = F.regexp_extract_all(F.regexp_extract(column, form, 2), F.lit(r'[A-Za-z_][A-Za-z0-9_]*="(?:[^"\\\\]|\\\\.)*"'), F.lit(0))
    entry = lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, r'(?s)^[^=]*="(.*)"$', 1).alias("value"))
    number = F.regexp_extract(column, form, 3).try_cast("double")
    found = lines.where(F.col(column).rlike(form)).select(F.regexp_extract(column, form, 1).alias("family"), F.map_from_entries(F.transform(pairs, entry)).alias("labels"), number.alias("number"))
    return found.where("number IS NOT NULL")


def bad_ledger_lines(spark: SparkSession, path: str | list[str]) -> int:
    """Lines of a ledger that read_ledger() leaves out."""
    rows = spark.read.schema(LEDGER + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = F.col("_bad").isNull() & F.col("kind").isin("sample", "note", "recovery")
    return rows.select("_bad", "kind").where(~F.coalesce(good, F.lit(False))).count()


#: A line of a metric text, and those that say nothing.
METRIC, SILENT = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+-?[0-9]+)?\s*$", r"^\s*(?:#.*)?$"


def bad_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are neither a sample of parse_metrics(), a comment nor blank."""
    good = F.col(column).rlike(METRIC) & F.regexp_extract(column, METRIC, 3).try_cast("double").isNotNull()
    return lines.where(~good & ~F.col(column).rlike(SILENT))


def read_list(spark: SparkSession, path: str, comment: str = r"^\s*(?:#|!!)") -> DataFrame:
    """The entries of a list file, one a line, in upper case, without comments and blanks."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("entry")).where(~F.col("entry").rlike(comment) & (F.col("entry") != "")).distinct()


#: A line of a range file.
RANGE = r"^\s*[0-9.]+-[0-9.]+\s*$"


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Frequency ranges `low-high` in Hz, one a line."""
    parts = F.split(F.trim("value"), "-")
    return spark.read.text(path).where(F.col("value").rlike(RANGE)).select(F.get(parts, F.lit(0)).cast("double").alias("low"), F.get(parts, F.lit(1)).cast("double").alias("high"))


def bad_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a range file that are neither a range, a comment nor blank: value."""
    return spark.read.text(path).where(~F.col("value").rlike(RANGE) & ~F.col("value").rlike(r"^\s*(?:#.*)?$"))


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Prefixes of a country file: prefix, exact, name, zone, continent. Records end in `;`, start with fields ended by `:`."""
    records = spark.read.option("lineSep", ";").text(path).select(F.split(F.regexp_replace("value", r"\s+", " "), ":").alias("f")).where(F.size("f") >= 9)
    field = lambda i: F.trim(F.get("f", F.lit(i)))
    rows = records.select(field(0).alias("name"), field(1).cast("int").alias("zone"), field(3).alias("continent"), F.explode(F.split(field(8), ",")).alias("alias"))
    alias = F.trim("alias")
    prefix = F.regexp_replace(alias, r"^=|\(.*|\[.*|<.*|\{.*", "")
    return rows.select(prefix.alias("prefix"), alias.startswith("=").alias("exact"), "name", "zone", "continent").where("prefix <> ''")


def bad_countries(spark: SparkSession, path: str) -> DataFrame:
    """The records of a country file that have too few fields: value. What follows the last `;` counts if it isn't blank."""
    return spark.read.option("lineSep", ";").text(path).where((F.size(F.split("value", ":")) < 9) & (F.trim(F.regexp_replace("value", r"\s+", " ")) != ""))


def read_samples(spark: SparkSession, path: str, kind: str = "cf32", block: int = 65536) -> DataFrame:
    """Blocks of raw interleaved samples (cf32 or ci16): input, block, start_ts, re, im (arrays of float); the last block may be short.

    A file is read whole by one task, as the binary reader does; recordings are kept in files of a bounded length.
    """
    width = {"cf32": 8, "ci16": 4}[kind] * block
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for name, raw, number in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                flat = np.frombuffer(raw, "<f4") if kind == "cf32" else np.frombuffer(raw, "<i2").astype("f4") / 32768
                flat = flat[: len(flat) // 2 * 2]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([number * block], pa.int64()), pa.array([flat[0::2]], pa.list_(pa.float32())), pa.array([flat[1::2]], pa.list_(pa.float32()))], names=["input", "block", "start_ts", "re", "im"])

    whole = spark.read.format("binaryFile").load(path).where("length > 0")
    pieces = whole.select("path", "content", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / width).cast("int") - 1)).alias("block"))
    slices = pieces.select("path", F.substring("content", F.col("block") * width + 1, F.lit(width)).alias("raw"), F.col("block").cast("long").alias("block"))
    return slices.mapInArrow(run, "input string, block long, start_ts long, re array<float>, im array<float>")
