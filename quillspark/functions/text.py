"""Text functions with the semantics of the notes' front end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as trim() and \s of the front end know it: Unicode white space and the byte order mark.
_SPACE = r"[\s\x{FEFF}]"


def js_trim(text: Column) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def js_rtrim(text: Column) -> Column:
    """Strip all Unicode white space at the end."""
    return F.regexp_replace(text, rf"(?U){_SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(text, rf"(?U){_SPACE}+", " ")


def _units(text: Column) -> Column:
    return F.encode(text, "UTF-16LE")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as all limits are meant: characters beyond the basic plane count twice."""
    return F.shiftright(F.octet_length(_units(text)), 1)


def utf16_prefix(text: Column, units: int | Column) -> Column:
    """The longest prefix of at most ``units`` UTF-16 units that doesn't cut a character in two."""
    n = 2 * (units if isinstance(units, Column) else F.lit(units)).cast("int")

    def cut(encoded: Column) -> Column:
        # the high byte of the last unit tells whether it is the first half of a character
        half = F.hex(F.substring(encoded, n, F.lit(1))).between("D8", "DB")
        return F.decode(F.substring(encoded, F.lit(1), F.when(half, n - 2).otherwise(n)), "UTF-16LE")

    # bound by a lambda, so that a text that is a large expression stands here once
    return F.transform(F.array(_units(text)), cut)[0]


def js_round(x: Column) -> Column:
    """Half goes up, towards positive infinity."""
    return F.floor(x + 0.5)


def or_null(text: Column) -> Column:
    """Empty text becomes null."""
    return F.when(text != "", text)


def join_nonempty(parts: list[Column], separator: str) -> Column:
    """Join what is neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), separator)


def clip(text: Column, limit: int, marker: str = "") -> Column:
    """At most ``limit`` UTF-16 units; a longer text gets ``marker`` appended."""
    return F.when(utf16_length(text) > limit, F.concat(utf16_prefix(text, limit), F.lit(marker))).otherwise(text)


def preview(text: Column, limit: int = 100) -> Column:
    return clip(text, limit, "...")


def word_count(text: Column) -> Column:
    trimmed = js_trim(text)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"(?U)\s+")))


def duration_label(seconds: Column) -> Column:
    """mm:ss, with more digits from 100 minutes on; null and negative values count as 0."""
    whole = F.floor(F.greatest(seconds, F.lit(0)))
    two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return F.concat(two(F.floor(whole / 60)), F.lit(":"), two(whole % 60))


def document_id(state_key: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(state_key.cast("binary")), "+/=", "-_ "))


def batch_number(ordinal: Column, size: int) -> Column:
    """Number of the batch of ``size`` that a row of ordinal 0, 1, ... falls in."""
    return F.floor(ordinal / size)


# --- time

def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def parse_timestamp(text: Column, *formats: str) -> Column:
    """The first format that reads the text, else null."""
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def iso(ts: Column) -> Column:
    """ISO-8601 in UTC with milliseconds; an unreadable time is the epoch."""
    return F.date_format(F.coalesce(ts.cast("timestamp"), F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stamp(ts: Column, style: str, zone: str = "UTC") -> Column:
    """A time as prompts show it: style "date" or "datetime"."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    pattern = {"date": "M/d/yyyy", "datetime": "EEE, MMM d, yyyy, hh:mm a", "day": "yyyy-MM-dd", "short": "M/d/yy, h:mm a"}[style]
    return F.coalesce(F.date_format(local, pattern), F.lit("Unknown date"))
