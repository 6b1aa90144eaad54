"""Text measures, previews and coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space, and phrases of compaction glue.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
COMPACT_GLUE = (
    "this session is being continued",
    "ran out of context",
    "conversation is summarized below",
    "previous conversation that ran out",
    "compaction/segment_",
)


def int_or_zero(v: Column) -> Column:
    return F.coalesce(v.try_cast("bigint"), F.lit(0).cast("long"))


def nonempty(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def strip(s: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(s, f"^[{SPACES}]+|[{SPACES}]+$", "")


def unix_newlines(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, f"[{SPACES}]+", " "))


def preview_counted(s: Column, limit: int) -> Column:
    """First ``limit`` characters and how many follow."""
    t = unix_newlines(s)
    more = F.concat(F.substring(t, 1, limit), F.lit("…[+"), (F.length(t) - limit).cast("string"), F.lit(" chars]"))
    return F.when((F.lit(limit) <= 0) | (F.length(t) <= limit), t).otherwise(more)


def preview_stripped(s: Column, limit: int) -> Column:
    """Stripped text, cut after ``limit`` characters with an ellipsis added."""
    t = strip(unix_newlines(s))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("…")))


def clip(s: Column, limit: int) -> Column:
    """At most ``limit`` characters, the ellipsis included."""
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 1), F.lit("…")))


def preview_collapsed(s: Column, limit: int) -> Column:
    return clip(collapse(F.coalesce(s, F.lit(""))), limit)


def occurrences(s: Column, needle: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def line_count(s: Column) -> Column:
    """Display lines; one trailing newline does not open another line."""
    n = occurrences(s, "\n") + F.when(F.endswith(s, F.lit("\n")), 0).otherwise(1)
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit(0)).otherwise(n).cast("long")


def char_count(s: Column) -> Column:
    return F.coalesce(F.length(s), F.lit(0)).cast("long")


def tokens_of_text(s: Column) -> Column:
    """Token estimate: UTF-8 bytes divided by four."""
    return F.floor(F.coalesce(F.octet_length(s), F.lit(0)) / 4).cast("long")


def tokens_of_chars(n: Column) -> Column:
    return F.floor(F.greatest(F.coalesce(n.cast("long"), F.lit(0)), F.lit(0)) / 4).cast("long")


def is_compact_glue(text: Column, reason: Column | None = None) -> Column:
    """Text written by a compaction, not by a person."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for phrase in COMPACT_GLUE:
        hit = hit | low.contains(phrase)
    if reason is not None:
        hit = hit | F.lower(F.coalesce(reason, F.lit(""))).contains("compact")
    return hit


def first_real_preview(*candidates: Column) -> Column:
    """First non-blank candidate that is not compaction glue, else an empty text."""
    picks = [F.when((F.length(strip(x)) > 0) & ~is_compact_glue(x), x) for x in candidates]
    return F.coalesce(*picks, F.lit(""))


def iso_utc(ms: Column) -> Column:
    """Epoch milliseconds to ISO-8601 with a UTC offset; the fraction only when there is one."""
    t = F.timestamp_millis(ms)
    frac = F.when(ms % 1000 != 0, F.date_format(t, ".SSS000")).otherwise(F.lit(""))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))


def iso_to_epoch(s: Column) -> Column:
    """ISO-8601 text (``Z`` or an offset) to epoch seconds; NULL when it does not parse."""
    return F.unix_micros(F.try_to_timestamp(nonempty(s))) / F.lit(1_000_000.0)


def age_label(seconds: Column) -> Column:
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    m = F.floor(s / 60).cast("long")
    h = F.floor(m / 60).cast("long")
    d = F.floor(h / 24).cast("long")

    def unit(v: Column, u: str) -> Column:
        return F.concat(v.cast("string"), F.lit(u))

    return F.when(s < 60, unit(s, "s")).when(m < 60, unit(m, "m")).when(h < 48, unit(h, "h")).otherwise(unit(d, "d"))


def epoch_of(ts: Column, meta_ms: Column, update_ms: Column) -> Column:
    """Event clock in epoch seconds: own stamp in ms or s, else a millisecond stamp of the meta data."""
    t = ts.cast("double")
    return (
        F.when(t > 1e12, t / 1000).when(t > 1e9, t)
        .when(meta_ms.cast("double") > 1e12, meta_ms.cast("double") / 1000)
        .when(update_ms.cast("double") > 1e12, update_ms.cast("double") / 1000)
    )


def epoch_of_mark(ms: Column) -> Column:
    """Clock of a round or side event: milliseconds above 1e11, seconds otherwise."""
    v = ms.cast("double")
    return F.when(v > 1e11, v / 1000).when(v > 0, v)
