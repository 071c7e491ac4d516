"""One parser for the time bounds that users type, resolved once on the driver."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def time_bound(text: str | None, as_of: datetime, *, upper: bool = False) -> datetime | None:
    """UTC time of ``today``, ``yesterday``, ``3d``, a date or a timestamp; an upper bound's date means its end."""
    if text is None:
        return None
    value, now = text.strip(), as_of.replace(tzinfo=as_of.tzinfo or UTC).astimezone(UTC)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    close = timedelta(days=1) - timedelta(microseconds=1) if upper else timedelta()
    if value.lower() in ("today", "yesterday"):
        return midnight - timedelta(days=value.lower() == "yesterday") + close
    if m := re.fullmatch(r"(\d+)([smhdw])", value.lower()):
        return now - timedelta(**{UNITS[m[2]]: int(m[1])})
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        return datetime.fromisoformat(value).replace(tzinfo=UTC) + close
    try:
        found = datetime.fromisoformat(value)
    except ValueError:
        raise ValueError(f"not a time: {text!r}") from None
    return found.replace(tzinfo=found.tzinfo or UTC).astimezone(UTC)


def window_label(text: str) -> str:
    """``last 7 days`` for ``7d`` and so on; other bounds are named as they are."""
    if m := re.fullmatch(r"(\d+)([smhdw])", text.strip().lower()):
        unit = UNITS[m[2]][: -1 if int(m[1]) == 1 else None]
        return f"last {m[1]} {unit}" if int(m[1]) != 1 else f"last {unit}"
    return text.strip()
