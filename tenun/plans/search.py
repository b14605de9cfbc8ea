"""Search expressions and collection windows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from tenun.functions.moments import LOCAL_ZONE


def _word(text: str) -> str:
    """A search word; a phrase stands in quotation marks, its own ones escaped."""
    safe = text.replace('"', r"\"")
    return f'"{safe}"' if len(text.split()) > 1 else safe


def any_of(words: Sequence[str]) -> str:
    """``(a OR "b c")`` of the words that aren't blank; it is an error if all are."""
    if chosen := [_word(w) for w in map(str.strip, words) if w]:
        return f"({' OR '.join(chosen)})"
    raise ValueError("a search needs a keyword")


def search_query(keywords: Sequence[str], language: str | None = None, context: Sequence[str] = ()) -> str:
    """``(a OR "b c") (context) lang:xx``: one group of words after the other, then the language."""
    parts = [any_of(keywords)]
    if context:
        parts.append(any_of(context))
    if language is not None:
        if len(language) != 2 or not language.isascii() or not language.islower():
            raise ValueError("a language is two lower-case letters")
        parts.append(f"lang:{language}")
    return " ".join(parts)


def parse_window(first: str, last: str) -> tuple[date, date]:
    """Two ``DD-MM-YYYY`` days in order."""
    start, end = (datetime.strptime(x, "%d-%m-%Y").date() for x in (first, last))
    if start > end:
        raise ValueError("the window ends before it starts")
    return start, end


def outer_window(start: date, end: date) -> tuple[date, date]:
    """A UTC search window around the local days: from the day before, until the day after (exclusive)."""
    return start - timedelta(days=1), end + timedelta(days=1)


def output_name(program: str, start: date, end: date) -> str:
    return f"{program}_{start.isoformat()}_{end.isoformat()}"


def scheduled_window(moment: datetime, days: int = 7) -> tuple[date, date]:
    """The ``days`` full local days before a moment's local day."""
    from zoneinfo import ZoneInfo

    if moment.tzinfo is None or moment.utcoffset() is None:
        raise ValueError("the moment must name its offset")
    today = moment.astimezone(ZoneInfo(LOCAL_ZONE)).date()
    return today - timedelta(days=days), today - timedelta(days=1)


def last_due(weekday: int, now: datetime) -> datetime:
    """The last moment, up to ``now``, at which a program's weekly run is due: 23:59 local time on ISO ``weekday``."""
    from zoneinfo import ZoneInfo

    if weekday not in range(1, 8) or now.tzinfo is None or now.utcoffset() is None:
        raise ValueError("a weekday is 1 to 7, and the moment must name its offset")
    local = now.astimezone(ZoneInfo(LOCAL_ZONE))
    due = local.replace(hour=23, minute=59, second=0, microsecond=0) - timedelta(days=(local.isoweekday() - weekday) % 7)
    return due if due <= local else due - timedelta(days=7)


def due_runs(weekdays: dict[str, int], done: dict[str, datetime], now: datetime) -> dict[str, datetime]:
    """Programs whose last due moment has no run yet, with that moment; what was missed before isn't caught up."""
    due = {name: last_due(day, now) for name, day in weekdays.items()}
    return {name: at for name, at in due.items() if name not in done or done[name] < at}


def backfill_window(end: date, collected: date, days: int = 7) -> tuple[date, date]:
    """``days`` days up to an explicit last day before the day of collection."""
    if end >= collected:
        raise ValueError("a backfill must end before the day of collection")
    return end - timedelta(days=days - 1), end
