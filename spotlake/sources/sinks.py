"""Projections onto the wire: cluster lines, spot JSON, spectrum frames and metric text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.functions.numeric import band_of, wire_snr
from spotlake.functions.text import dx_line, escape_xml, locator_centre, spot_id
from spotlake.operators import gates
from spotlake.operators.carried import carried


def cluster_lines(spots: DataFrame, spotter: str) -> DataFrame:
    """(callsign, freq_hz, snr_db, wpm, spot_type, mode, time) -> line."""
    hhmm = F.date_format(F.timestamp_seconds("time"), "HHmm")
    line = dx_line(F.lit(spotter), F.col("freq_hz") / 1000, F.col("callsign"), F.col("mode"), wire_snr(F.col("snr_db")), F.round("wpm").cast("int"), F.upper("spot_type"), hhmm)
    return spots.select(line.alias("line"))


def spot_json(spots: DataFrame, station: str, nonce: str) -> DataFrame:
    """(callsign, freq_hz, snr_db, wpm, track_id, sample_ts, confidence, time) -> one JSON document per spot."""
    hz = F.round("freq_hz").cast("long")
    message = F.struct(
        spot_id(F.lit(station), F.lit(nonce), F.col("track_id"), F.col("sample_ts"), F.col("callsign")).alias("id"), F.lit("skimmer").alias("source"), F.lit("CW").alias("mode"), band_of(hz).alias("band"), F.col("time").alias("timestamp"),
        hz.alias("frequency"), F.col("callsign").alias("dxCall"), F.lit(station).alias("deCall"), F.round("snr_db").cast("int").alias("snr"), F.lit(2500).alias("snrRefHz"), F.round("wpm").cast("int").alias("wpm"), F.col("confidence").alias("decodeConfidence"),
    )
    return spots.select(F.to_json(message).alias("value"))


#: Hz of the bandwidth that wire signal strengths are told in.
SNR_REF_HZ = 2500


def spot_messages(spots: DataFrame, aliases: DataFrame, station: str, nonce: str, version: str, grid: str | None = None, mode: str = "CW") -> DataFrame:
    """Spots -> one JSON document of the 30 keys of SPOT each, in their order, nulls included.

    spots: callsign, freq_hz, snr_db, wpm, baud, rst, qrl, track_id, sample_ts, confidence, time, seq; of a cycle mode (mode FT8 or FT4) without speeds and confidence, and with dx_grid.
    aliases: of country.geography(). The station stands where its grid is, never in the middle of its country; its own suffix -N doesn't count for that.
    """
    from spotlake.operators import country

    hz = F.round("freq_hz").cast("long")
    told = country.geography(spots.withColumn("seq", F.col("seq").cast("long")), aliases, "callsign")
    home = country.geography(spots.sparkSession.createDataFrame([(without_suffix(station),)], "de string"), aliases, "de")
    home = home.select(F.col("dxcc").alias("de_dxcc"), F.col("continent").alias("de_continent"))
    de_lat, de_lon = locator_centre(F.lit(grid).cast("string"))
    keyed = mode in ("CW", "RTTY")
    none = F.lit(None)
    whole = lambda c, kind: F.round(c).cast(kind)
    values = {
        "id": spot_id(F.lit(station), F.lit(nonce), F.col("track_id"), F.col("sample_ts"), F.col("callsign")), "source": F.lit("skimmer"), "mode": F.lit(mode), "band": band_of(hz), "timestamp": F.col("time"), "ingestedAt": F.col("time"),
        "frequency": hz, "dxCall": F.col("callsign"), "deCall": F.lit(station), "dxGrid": none.cast("string") if keyed else F.col("dx_grid"), "deGrid": F.lit(grid).cast("string"), "dxLat": none.cast("double"), "dxLon": none.cast("double"), "deLat": de_lat, "deLon": de_lon,
        "dxDxcc": F.col("dxcc"), "deDxcc": F.col("de_dxcc"), "dxContinent": F.col("continent"), "deContinent": F.col("de_continent"), "dxCqZone": F.col("zone"), "snr": whole("snr_db", "int"), "snrRefHz": F.lit(SNR_REF_HZ),
        "wpm": whole("wpm", "int") if mode == "CW" else none.cast("int"), "decodeConfidence": F.col("confidence").cast("double") if keyed else none.cast("double"), "decoderVersion": F.lit(version), "channelizerResolutionHz": none.cast("double"),
        "baud": F.col("baud").cast("double") if mode == "RTTY" else none.cast("double"), "rst": F.col("rst") if keyed else none.cast("string"), "qrlQuery": F.col("qrl") if keyed else F.lit(False), "seq": F.col("seq"),
    }
    message = F.struct(*[v.alias(k) for k, v in values.items()])
    return told.crossJoin(F.broadcast(home)).select(F.to_json(message, {"ignoreNullFields": "false"}).alias("value"))  # one row beside each


def without_suffix(station: str) -> str:
    head, dash, number = station.rpartition("-")
    return head if dash and number.isdigit() else station


def uplink_lines(spots: DataFrame, spotter: str, types: tuple[str, ...], window: int, most: int) -> DataFrame:
    """Spots of the types that are forwarded, `most` in each window of seconds (by time, then call), as cluster lines: time, line."""
    kept = gates.rate_limit(spots.where(F.lower("spot_type").isin(*types)), [], "time", "callsign", window, most).where("allowed")
    return kept.select("time", _line(F.lit(spotter), wire_snr(F.col("snr_db")), F.round("wpm").cast("int")).alias("line"))


def relay_lines(spots: DataFrame) -> DataFrame:
    """Spots of others (spotter, callsign, freq_hz, snr_db, wpm, spot_type, mode, time) -> line: under their spotter, strengths as told, no speed but for CW."""
    return spots.select(_line(F.col("spotter"), F.col("snr_db").cast("int"), F.when(F.col("mode") == "CW", F.col("wpm")).cast("int")).alias("line"))


def _line(spotter: Column, snr: Column, speed: Column) -> Column:
    return dx_line(spotter, F.col("freq_hz") / 1000, F.col("callsign"), F.col("mode"), snr, speed, F.upper("spot_type"), F.date_format(F.timestamp_seconds("time"), "HHmm"))


def packed(reports: DataFrame, keys: list[str], at: str, tie: str, size: Column, most: int = 1400, header: int = 16, templates: int = 0, untold: int = 3) -> DataFrame:
    """reports with datagram (from 0): in the order of time a report goes into the datagram that is open if it has room left, else opens the next; a report too large for any has one of its own.

    header: bytes that each datagram begins with; the first `untold` of a key carry templates bytes more.
    """

    def step(state: list, row_at, row_tie, bytes_: int) -> list[tuple]:
        n, used = state or (-1, most + 1)
        if used + bytes_ > most:
            n, used = n + 1, header + (templates if n + 1 < untold else 0)
        state[:] = (n, used + bytes_)
        return [(row_at, row_tie, n)]

    sized = reports.withColumn("__size", size.cast("long"))
    types = dict(sized.dtypes)
    return carried(sized, keys, [at, tie], [at, tie, "__size"], f"`{at}` {types[at]}, `{tie}` {types[tie]}, datagram bigint", list, step)


def spectrum_xml(frames: DataFrame, scale: float) -> DataFrame:
    """(name, low_khz, high_khz, floor_db, levels: array of dB) -> XML, levels above the floor by scale, within 0 to 65535."""
    level = F.transform("levels", lambda x: F.least(F.greatest(F.round((x - F.col("floor_db")) / scale), F.lit(0)), F.lit(65535)).cast("int").cast("string"))
    xml = F.format_string("<Spectrum><Name>%s</Name><LowScopeFrequency>%.3f</LowScopeFrequency><HighScopeFrequency>%.3f</HighScopeFrequency><SpectrumData>%s</SpectrumData></Spectrum>", escape_xml(F.col("name")), "low_khz", "high_khz", F.array_join(level, ","))
    return frames.select(xml.alias("value"))


def metric_text(metrics: DataFrame, family: str, value: Column, labels: list[str]) -> DataFrame:
    """One line of text exposition per row: family{label="..."} value."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{label}="'), escaped(F.col(label).cast("string")), F.lit('"')) for label in labels])
    return metrics.select(F.concat(F.lit(family + "{"), pairs, F.lit("} "), value.cast("string")).alias("value"))
