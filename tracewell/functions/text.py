"""Text, number and time helpers, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ws_trim(c: Column) -> Column:
    """Trims all white space, not blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_ci(c: Column, needle: str) -> Column:
    """Literal substring test that ignores the case of A-Z; null is no match."""
    return F.coalesce(ascii_lower(c).contains(needle.translate(str.maketrans(UPPER, LOWER))), F.lit(False))


def startswith_ci(c: Column, prefix: str) -> Column:
    return F.coalesce(ascii_lower(c).startswith(prefix.translate(str.maketrans(UPPER, LOWER))), F.lit(False))


def duration_text(secs: Column) -> Column:
    """``3d 4h``, ``2h 5m``, ``7m 1s``, ``9s``; ``-`` for negative durations."""
    part = lambda big, small, a, b: F.concat(F.floor(secs / big).cast("string"), F.lit(a), F.floor((secs % big) / small).cast("string"), F.lit(b))
    return F.when(secs < 0, "-").when(secs >= 86_400, part(86_400, 3_600, "d ", "h")).when(secs >= 3_600, part(3_600, 60, "h ", "m")).when(secs >= 60, part(60, 1, "m ", "s")).otherwise(F.concat(secs.cast("string"), F.lit("s")))


def token_text(n: Column) -> Column:
    """``1.2M``, ``12K`` (cut, not rounded) or the number itself."""
    return F.when(F.abs(n) >= 1_000_000, F.format_string("%.1fM", n / F.lit(1_000_000.0))).when(F.abs(n) >= 1_000, F.concat(((n - n % 1_000) / 1_000).cast("bigint").cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def last_path_part(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def shorten_path(path: Column, width: int) -> Column:
    """The path if it fits, else its last three, two or one parts, whichever is the longest that fits."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    tail = lambda n: F.concat(F.lit(".../"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "/"))
    return F.when(F.length(path) <= width, path).when(F.length(tail(3)) <= width, tail(3)).when(F.length(tail(2)) <= width, tail(2)).otherwise(F.element_at(parts, -1))


def cut_field(c: Column, width: int) -> Column:
    """At most ``width`` characters, the last three of them dots where something was cut."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, max(width - 3, 0)), F.lit("..."))).otherwise(c)


def grouped_number(n: Column) -> Column:
    return F.format_number(n, 0)


def model_family(model: Column) -> Column:
    """A short name of a model: its family, for the second engine's with the version before it."""
    m = F.lower(F.coalesce(model, F.lit("")))
    before = F.regexp_replace(F.substr(model, F.lit(1), F.locate("codex", m) - 1), "-+$", "")
    codex = F.when(before == "", "Codex").otherwise(F.concat(F.upper(before), F.lit(" Codex")))
    known = F.when(m == "", "unknown").when(m.contains("opus"), "Opus").when(m.contains("sonnet"), "Sonnet").when(m.contains("haiku"), "Haiku")
    return known.when(m.contains("codex"), codex).when(m.rlike("^o[0-9]"), model).otherwise(F.get(F.split(model, "-"), F.lit(0)))


def short_id(uid: Column, engine_is_b: Column) -> Column:
    """First eight characters, or the last eight hex digits for the second engine."""
    return F.when(engine_is_b, F.right(F.replace(uid, F.lit("-"), F.lit("")), F.lit(8))).otherwise(F.substring(uid, 1, 8))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def strip_xml(c: Column) -> Column:
    return F.regexp_replace(c, "</?[^>]+>", "")


# The entities that are decoded, in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "))


def strip_tags(c: Column) -> Column:
    """Without tags (an unclosed one runs to the end), with common entities decoded."""
    out = F.regexp_replace(c, "<[^>]*>?", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def snippet(text: Column, terms: list[str], context: int = 0) -> Column:
    """120 + 80 * context characters around the first match of the earliest term, else the head of the text."""
    size = 120 + 80 * context
    places = [F.locate(t.lower(), F.lower(text)) for t in terms]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    start = F.greatest(first - size // 2, F.lit(1))
    head = F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
    return F.when(first.isNull(), head).otherwise(F.substring(text, start.cast("int"), F.lit(size)))


def time_text(ts: Column, as_of: Column, zone: str = "UTC") -> Column:
    """``today HH:MM``, ``yday HH:MM`` or ``Mon dd HH:MM`` in a time zone."""
    local, now = F.from_utc_timestamp(ts, zone), F.from_utc_timestamp(as_of, zone)
    days = F.datediff(F.to_date(now), F.to_date(local))
    clock = F.date_format(local, "HH:mm")
    return F.when(days == 0, F.concat(F.lit("today "), clock)).when(days == 1, F.concat(F.lit("yday "), clock)).otherwise(F.date_format(local, "MMM dd HH:mm"))


# Dollars per million tokens: input, output, cache read, cache write. The first match counts.
RATES = (
    ("gpt-5.4-mini", (0.15, 0.60, 0.015, 0.0)),
    ("gpt-5.4", (2.50, 10.0, 0.25, 0.0)),
    ("opus", (15.0, 75.0, 1.5, 18.75)),
    ("haiku", (0.25, 1.25, 0.025, 0.3)),
)
DEFAULT_RATE = (3.0, 15.0, 0.3, 3.75)


def estimated_cost(model: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, reasoning: Column) -> Column:
    """Dollars, rounded to cents; reasoning tokens cost as much as output."""

    def rate(i: int) -> Column:
        out = None
        for name, rates in RATES:
            test = F.lower(F.coalesce(model, F.lit(""))).contains(name)
            out = F.when(test, rates[i]) if out is None else out.when(test, rates[i])
        return out.otherwise(DEFAULT_RATE[i])

    m = 1_000_000.0
    cost = (tokens_in / m) * rate(0) + (tokens_out / m) * rate(1) + (cache_read / m) * rate(2) + (cache_write / m) * rate(3) + (reasoning / m) * rate(1)
    return F.round(cost * 100.0) / 100.0


def date_parts(started_at: Column) -> dict[str, Column]:
    """Year, month and day (``y``, ``m``, ``d``) of a start, as dated folders name them."""
    return {k: F.date_format(started_at, p) for k, p in (("y", "yyyy"), ("m", "MM"), ("d", "dd"))}
