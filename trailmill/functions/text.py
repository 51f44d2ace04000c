"""Text of distances, durations and times, and the small string rules of the journal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
UNNAMED = "未命名道路"


def distance_text(metres: Column) -> Column:
    """"0 m" up to 0 and for null; kilometres with one decimal, halves up, from 1000 m."""
    tenths = F.floor(metres / 100.0 + 0.5).cast("long")
    km = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" km"))
    return F.when(metres.isNull() | (metres <= 0), "0 m").when(metres >= 1000, km).otherwise(F.concat(metres.cast("string"), F.lit(" m")))


def duration_text(seconds: Column, spaced: bool = True) -> Column:
    """Hours and minutes. Spaced text never says less than one minute, the other form may say 0."""
    gap = " " if spaced else ""
    h, m = F.floor(seconds / 3600).cast("long"), F.floor((seconds % 3600) / 60).cast("long")
    short = F.concat((F.greatest(m, F.lit(1)) if spaced else m).cast("string"), F.lit(f"{gap}分钟"))
    full = F.concat(h.cast("string"), F.lit(f"{gap}小时{gap}"), m.cast("string"), F.lit(f"{gap}分钟"))
    return F.when(seconds.isNull() | (seconds <= 0), "0 分钟").when(h > 0, full).otherwise(short)


def datetime_text(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A UTC timestamp as text in China's time."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), ZONE), pattern)


def parse_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Null where the text is no date."""
    return F.try_to_timestamp(text, F.lit(pattern))


def tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def lines(text: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")


def place_duration(seconds: Column) -> Column:
    """0 for null; values over 30 days that are whole thousands were milliseconds."""
    return F.coalesce(F.when((seconds > 86_400 * 30) & (seconds % 1000 == 0), (seconds / 1000).cast("long")).otherwise(seconds), F.lit(0).cast("long"))


def road_name(name: Column) -> Column:
    bare = F.trim(F.coalesce(name, F.lit("")))
    return F.when(bare == UNNAMED, "").otherwise(bare)


def enum_or_default(text: Column, values: tuple[str, ...], default: str) -> Column:
    bare = F.upper(F.trim(text))
    return F.when(bare.isin(*values), bare).otherwise(default)


def media_kind(block_type: Column) -> Column:
    return F.when(F.contains(block_type, F.lit("VIDEO")), "VIDEO").when(F.contains(block_type, F.lit("PHOTO")), "PHOTO")


def scope_range(scope: str, now_ms: int) -> tuple[int, int]:
    """From and to, in milliseconds, of WEEK, MONTH and YEAR back from ``now_ms``; else all and a day more."""
    day = 86_400_000
    days = {"WEEK": 7, "MONTH": 31, "YEAR": 366}.get(scope.strip().upper())
    return (now_ms - days * day, now_ms) if days else (0, now_ms + day)


#: Classes of roads.
FAST = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link")
LOW = ("secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "service", "living_street")


def fast_corridor(kind: Column, ramp: Column) -> Column:
    return F.coalesce(ramp | kind.isin(*FAST), F.lit(False))


def exit_connector(kind: Column, ramp: Column) -> Column:
    return F.coalesce(ramp | F.endswith(kind, F.lit("_link")), F.lit(False))


def low_class(kind: Column) -> Column:
    return F.coalesce(kind.isin(*LOW), F.lit(False))
