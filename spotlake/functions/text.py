"""Column functions on calls, words, lines and locators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spotlake.functions.edits import edit_distance

#: Words that are conventions, never calls.
CONVENTIONS = ("5NN", "4NN", "3NN", "599", "TEST", "TU", "QRZ", "AGN", "K", "KN")
PORTABLE = r"(?:P|QRP|MM|AM|M|[0-9])"


def is_portable(p: Column) -> Column:
    return F.rlike(p, F.lit(f"^{PORTABLE}$"))


def is_plausible(call: Column) -> Column:
    """3 to 7 letters and digits with one of each at least, ending in a letter, then perhaps a portable suffix; no convention word."""
    form = rf"^(?=[^/]*[0-9])(?=[^/]*[A-Za-z])[A-Za-z0-9]{{2,6}}[A-Za-z](?:/{PORTABLE})?$"
    return F.coalesce(F.rlike(call, F.lit(form)) & ~F.upper(F.substring_index(call, "/", 1)).isin(*CONVENTIONS), F.lit(False))


def pattern_of(call: Column) -> Column:
    """The base call with its first three characters kept (two if letter-digit-letter, four if digit-letter-letter), the others as @ and #."""
    base = F.upper(F.substring_index(call, "/", 1))
    kept = F.when(base.rlike("^[A-Z][0-9][A-Z]"), 2).when(base.rlike("^[0-9][A-Z][A-Z]"), 4).otherwise(3)
    rest = F.regexp_replace(F.regexp_replace(F.substring(base, kept + 1, F.length(base)), "[A-Z]", "@"), "[0-9]", "#")
    return F.concat(F.substring(base, F.lit(1), kept), rest)


def required_reps(tier: Column) -> Column:
    return F.when(tier == "common", 2).when(tier == "listed", 3).otherwise(5)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Leading characters that two strings share."""
    size = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda n: (n <= size) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))
    return F.coalesce(F.array_max(same), F.lit(0))


def variant_relation(a: Column, b: Column) -> Column:
    """contains, if one holds the other; similar, at a shared prefix of 3 and an edit distance of 2; else null, as for equal strings."""
    related = F.contains(a, b) | F.contains(b, a)
    close = (F.substring(a, 1, 3) == F.substring(b, 1, 3)) & (F.length(a) >= 3) & (F.length(b) >= 3) & (F.levenshtein(a, b) <= 2)
    return F.when(a == b, F.lit(None).cast("string")).when(related, "contains").when(close, "similar")


def plain(s: Column) -> Column:
    """In upper case, with single blanks."""
    return F.trim(F.regexp_replace(F.upper(s), r"\s+", " "))


def character_error_rate(expected: Column, decoded: Column) -> Column:
    """Edit distance by length, after upper case and single blanks."""
    return edit_distance(plain(expected), plain(decoded)) / F.greatest(F.length(plain(expected)), F.lit(1))


def last_report(text: Column) -> Column:
    """The last signal report in a text, N standing for 9; null if none."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b([1-5][1-9N][1-9N])\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.translate(F.element_at(found, -1), "Nn", "99"))


def is_query(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?i)\bQRL\?"))


def normal_spotter(s: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(s)), "-#$", "")


def without_ssid(call: Column) -> Column:
    return F.regexp_replace(call, "-[0-9]+$", "")


def cq_caller(message: Column) -> Column:
    """The caller of `CQ [modifier] CALL [GRID]`, null for other messages."""
    words = F.split(F.trim(message), r"\s+")
    second, third = F.get(words, F.lit(1)), F.get(words, F.lit(2))
    modifier = F.rlike(second, F.lit("^(?:[A-Z]{1,4}|[0-9]{3})$"))
    caller = F.when(modifier & third.isNotNull(), third).otherwise(second)
    return F.when((F.get(words, F.lit(0)) == "CQ") & is_plausible(caller), caller)


def spot_id(station: Column, nonce: Column, track: Column, ts: Column, call: Column) -> Column:
    return F.concat_ws(":", station, nonce, track.cast("string"), ts.cast("string"), call)


def dx_line(spotter: Column, freq_khz: Column, call: Column, mode: Column, snr: Column, wpm: Column, kind: Column, hhmm: Column) -> Column:
    """A cluster line in fixed columns: frequency ends at 24, call from 27, mode from 42; overlong fields shift only what they must; a null speed is blank."""
    head = F.concat(F.lit("DX de "), spotter, F.lit("-#:"))
    freq = F.format_string("%.2f", freq_khz)
    room = F.greatest(F.length(freq) + 1, F.lit(24) - F.length(head))
    line = F.concat(head, F.lpad(freq, room, " "), F.lit("  "))
    line = F.concat(F.rpad(F.concat(line, call), F.greatest(F.lit(41), F.length(line) + F.length(call) + 1), " "), F.rpad(mode, 5, " "))
    speed = F.coalesce(F.concat(F.lpad(wpm.cast("string"), 3, " "), F.lit(" WPM ")), F.lit(" " * 8))
    return F.concat(line, F.lpad(snr.cast("string"), 3, " "), F.lit(" dB "), speed, F.rpad(kind, 7, " "), hhmm, F.lit("Z"))


def locator(lat: Column, lon: Column) -> Column:
    """The six-character grid locator of a place."""
    x, y = lon + 180, lat + 90
    letter = lambda n, base: F.char(n.cast("int") + F.lit(ord(base)))
    return F.concat(
        letter(F.floor(x / 20), "A"), letter(F.floor(y / 10), "A"),
        F.floor(F.pmod(x, F.lit(20.0)) / 2).cast("string"), F.floor(F.pmod(y, F.lit(10.0))).cast("string"),
        letter(F.floor(F.pmod(x, F.lit(2.0)) * 12), "a"), letter(F.floor(F.pmod(y, F.lit(1.0)) * 24), "a"),
    )


def locator_centre(grid: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the centre of a four or six character locator; null for other texts."""
    at = lambda i, base: F.ascii(F.substring(F.upper(grid), i, 1)) - ord(base)
    fine = F.length(grid) == 6
    lat = at(2, "A") * 10.0 - 90 + at(4, "0") + F.when(fine, (at(6, "A") + 0.5) / 24).otherwise(0.5)
    lon = at(1, "A") * 20.0 - 180 + at(3, "0") * 2 + F.when(fine, (at(5, "A") + 0.5) / 12).otherwise(1.0)
    valid = F.rlike(grid, F.lit("^(?i:[A-R]{2}[0-9]{2}(?:[A-X]{2})?)$"))
    return F.when(valid, lat), F.when(valid, lon)


def in_locator(grid: Column, lat: Column, lon: Column) -> Column:
    """Whether a place lies in a four or six character square, its south and west sides included; null for other texts."""
    middle_lat, middle_lon = locator_centre(grid)
    fine = F.length(grid) == 6
    half_lat, half_lon = F.when(fine, 0.5 / 24).otherwise(0.5), F.when(fine, 0.5 / 12).otherwise(1.0)
    return (lat >= middle_lat - half_lat) & (lat < middle_lat + half_lat) & (lon >= middle_lon - half_lon) & (lon < middle_lon + half_lon)


def text_score(call: Column, text: Column) -> tuple[Column, Column, Column]:
    """Whether a text holds a call as a word, as a word after CQ, DE or TEST, and anywhere once blanks are left out."""
    words = F.concat(F.lit(" "), F.regexp_replace(text, r"\s+", " "), F.lit(" "))
    after = lambda frame: F.contains(words, F.concat(F.lit(f" {frame} "), call, F.lit(" ")))
    as_word = F.contains(words, F.concat(F.lit(" "), call, F.lit(" ")))
    return as_word, after("CQ") | after("DE") | after("TEST"), F.contains(F.replace(text, F.lit(" "), F.lit("")), call)


def fitting(s: Column, budget: int) -> Column:
    """The longest prefix of a string whose UTF-8 form has at most `budget` bytes."""
    short = F.substring(s, 1, budget)
    sizes = F.transform(F.sequence(F.lit(0), F.length(short)), lambda n: F.struct((F.octet_length(F.substring(short, F.lit(1), n)) <= budget).alias("ok"), n.alias("n")))
    return F.substring(short, F.lit(1), F.array_max(F.filter(sizes, lambda x: x["ok"]))["n"])


def escape_xml(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s
