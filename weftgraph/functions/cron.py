"""Schedules as bitmaps: cron fields, shortcuts and intervals read once, then tested, and their next instants found, by expressions.

A schedule's fields are whole numbers, a bit for each value: minutes and hours, days of the month from 1, months from 1, days of
the week from Monday as 0. All five must hold. `30m` and `6h` are intervals since the last run. Instants are UTC.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of common schedules, and the ranges of the five fields.
SHORTCUTS = {
    "@hourly": "0 * * * *", "@daily": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *",
    "hourly": "0 * * * *", "daily": "0 0 * * *", "weekly": "0 0 * * 0", "monthly": "0 0 1 * *",
}
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
#: Days after which a schedule that has had no instant has none: leap days come within eight years.
HORIZON = 366 * 8


def field_bits(text: str, low: int, high: int) -> int:
    """A bit for each value from low to high that the field takes: lists of *, */n, a, a-b and a-b/n; what can't be read takes none."""
    bits = 0
    for token in text.split(","):
        span, _, step = token.strip().partition("/")
        first, _, last = span.partition("-")
        try:
            n = int(step) if step else 1
            if span == "*":
                taken = [v for v in range(low, high + 1) if n > 0 and v % n == 0]
            elif last:
                taken = range(int(first), int(last) + 1, n)
            else:
                taken = [int(first)] if not step else []
        except ValueError:
            continue
        bits |= sum(1 << v for v in {*taken} if low <= v <= high)
    return bits


@dataclass(frozen=True)
class Schedule:
    """Either fields or an interval in seconds."""

    fields: tuple[int, ...] | None
    every: int | None

    @classmethod
    def read(cls, text: str) -> Schedule:
        text = SHORTCUTS.get(text.strip(), text.strip())
        if text[-1:] in ("m", "h") and text[:-1].isdigit():
            return cls(None, int(text[:-1]) * (60 if text[-1] == "m" else 3600))
        parts = text.split()
        if len(parts) != 5:
            raise ValueError(f"{text} isn't a schedule")
        return cls(tuple(field_bits(p, *r) for p, r in zip(parts, RANGES, strict=True)), None)

    def fits(self, at: datetime) -> bool:
        """Whether a minute is one of its minutes, on the driver."""
        values = (at.minute, at.hour, at.day, at.month, at.weekday())
        return all(bits >> v & 1 for bits, v in zip(self.fields, values, strict=True))

    # -- expressions --------------------------------------------------------------------------------------

    @staticmethod
    def _has(bits: int, value: Column) -> Column:
        return F.lit(bits).cast("long").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), value.cast("int"))) != 0

    def on_day(self, day: Column) -> Column:
        """Whether a date is one of its days."""
        _, _, days, months, week = self.fields
        return self._has(days, F.dayofmonth(day)) & self._has(months, F.month(day)) & self._has(week, F.weekday(day))

    def matches(self, at: Column) -> Column:
        """Whether a minute is one of its minutes."""
        return self._has(self.fields[0], F.minute(at)) & self._has(self.fields[1], F.hour(at)) & self.on_day(at)

    def due(self, at: Column, last: Column) -> Column:
        """Whether it is due: not again within the minute of its last run, and intervals by the time since then."""
        since = F.unix_micros(at) - F.unix_micros(last)
        if self.every is not None:
            return last.isNull() | (since >= self.every * 1_000_000)
        return self.matches(at) & (last.isNull() | (since >= 60_000_000))

    def minutes(self) -> list[int]:
        """The minutes of a day at which it is due, 1440 at most."""
        return [60 * h + m for h in range(24) for m in range(60) if self.fields[1] >> h & 1 and self.fields[0] >> m & 1]

    def next_after(self, at: Column) -> Column:
        """The first instant after a time; null if there is none."""
        if self.every is not None:
            return F.timestamp_micros(F.unix_micros(at) + self.every * 1_000_000)
        held = self.minutes()
        if not held or not all(self.fields):
            return F.lit(None).cast("timestamp")
        day, times = F.to_date(at), F.array(*map(F.lit, held))
        later = F.get(F.filter(times, lambda m: m > 60 * F.hour(at) + F.minute(at)), 0)  # null if it's past the last
        # the first day ahead is looked for in the next weeks, then in a year, then in all
        days = ((1, 31), (32, 366), (367, HORIZON))
        ahead = F.coalesce(*[F.get(F.filter(F.sequence(F.lit(a), F.lit(b)), lambda k: self.on_day(F.date_add(day, k))), 0) for a, b in days])
        today = self.on_day(day) & later.isNotNull()
        minute = F.when(today, later).otherwise(F.lit(held[0]))
        start = F.unix_date(F.when(today, day).otherwise(F.date_add(day, ahead)))
        return F.timestamp_seconds(start.cast("long") * 86400 + minute * 60)


def instants(spark, schedules: dict[str, str], start: str, end: str) -> DataFrame:
    """(name, due, following) of all instants in [start, end) of schedules with fields, with the one after each."""
    from functools import reduce

    from pyspark.sql import Window as W

    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    parts = []
    for name, text in schedules.items():
        s = Schedule.read(text)
        some = days.filter(s.on_day(F.col("day"))).select(F.lit(name).alias("name"), "day", F.explode(F.array(*map(F.lit, s.minutes())).cast("array<int>")).alias("m"))
        parts.append(some.select("name", F.timestamp_seconds(F.unix_date("day").cast("long") * 86400 + F.col("m") * 60).alias("due")))
    every = reduce(DataFrame.unionByName, parts).filter((F.col("due") >= F.lit(start).cast("timestamp")) & (F.col("due") < F.lit(end).cast("timestamp")))
    return every.withColumn("following", F.lead("due").over(W.partitionBy("name").orderBy("due")))


def missed(due: DataFrame, runs: DataFrame) -> DataFrame:
    """(name, due) of the instants that no run (name, at) came to before the next instant."""
    r = runs.select(F.col("name").alias("_n"), F.col("at").alias("_at"))
    ran = (F.col("name") == F.col("_n")) & (F.col("_at") >= F.col("due")) & (F.col("following").isNull() | (F.col("_at") < F.col("following")))
    return due.join(r, ran, "left_anti").select("name", "due")
