"""Durations and time stamps as text."""

from __future__ import annotations

import re
from datetime import datetime, timezone

# The units of a duration, in nanoseconds.
_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_PART = re.compile(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)")
_STAMP = re.compile(r"(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)(\.\d+)?(Z|[+-]\d\d:\d\d)")


def duration_ms(text: str) -> int:
    """Milliseconds of a duration such as ``1h30m``; anything empty, unreadable or below a millisecond is an error."""
    body = text.strip()
    sign, rest = (-1, body[1:]) if body.startswith("-") else (1, body[1:] if body.startswith("+") else body)
    at, total = 0, 0.0
    while at < len(rest):
        m = _PART.match(rest, at)
        if not m:
            break
        total += float(m[1]) * _UNITS[m[2]]
        at = m.end()
    if not rest or at < len(rest):
        raise ValueError(f"not a duration: {text!r}")
    ms = int(sign * total / 1_000_000)
    if ms <= 0:
        raise ValueError(f"a duration must be at least a millisecond: {text!r}")
    return ms


def stamp_ms(text: str) -> int | None:
    """Epoch milliseconds of an RFC 3339 time stamp; None for an empty one (an open side of a window)."""
    if text == "":
        return None
    m = _STAMP.fullmatch(text)
    if not m:
        raise ValueError(f"not an RFC 3339 time stamp: {text!r}")
    offset = "+00:00" if m[4] == "Z" else m[4]
    seconds = int(datetime.fromisoformat(f"{m[1]}T{m[2]}{offset}").timestamp())
    return seconds * 1000 + int(((m[3] or ".0")[1:] + "000")[:3])


def stamp_text(ms: int, fraction: bool = True) -> str:
    """RFC 3339 in UTC; fractions without trailing zeros, or whole seconds."""
    seconds, rest = divmod(ms, 1000)
    base = datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    return base + (f".{rest:03d}".rstrip("0") if rest and fraction else "") + "Z"


def window_ms(start: str = "", end: str = "") -> tuple[int | None, int | None]:
    lo, hi = stamp_ms(start), stamp_ms(end)
    if lo is not None and hi is not None and lo > hi:
        raise ValueError(f"the window starts after it ends: {start} > {end}")
    return lo, hi
