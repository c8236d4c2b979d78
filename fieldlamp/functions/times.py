"""Times: durations, phases, sun and moon, daily times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The length of a lunation in days, and a new moon (2000-01-06 18:14 UTC) in seconds.
SYNODIC_DAYS, NEW_MOON_S = 29.530588853, 947182440.0
#: Hours after which the dose rate of fallout has fallen to a tenth, a hundredth, a thousandth.
FALLOUT_HOURS = (7, 49, 343)


def duration_seconds(text: Column) -> Column:
    """'30m', '4h', '2d', '1.5h' in seconds; null for anything else."""
    amount = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)[mhd]$", 1)
    unit = F.right(text, F.lit(1))
    factor = F.when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0)
    return F.when(amount != "", amount.try_cast("double") * factor)


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def phase(elapsed_s: Column) -> Column:
    return F.when(elapsed_s < 12 * 3600, "first-hours").when(elapsed_s < 72 * 3600, "first-days").when(elapsed_s < 30 * 86400, "first-weeks").otherwise("long-term")


def is_stale(updated: Column, confirmed: Column, now: Column, hours: float = 24) -> Column:
    return seconds(now) - seconds(F.coalesce(confirmed, updated)) > hours * 3600


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")


def moon_phase(ts: Column) -> Column:
    """0 at the new moon, to 1."""
    days = (seconds(ts) - F.lit(NEW_MOON_S)) / 86400
    return F.pmod(days, F.lit(SYNODIC_DAYS)) / SYNODIC_DAYS


def sun_minutes(day: Column, lat: Column, lon: Column) -> Column:
    """(sunrise, sunset) in minutes after midnight UTC by the NOAA series; null where the sun stays up or down."""
    g = F.lit(2 * 3.141592653589793 / 365) * (F.dayofyear(day) - 1)
    eq = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    d = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    x = F.cos(F.radians(F.lit(90.833))) / (F.cos(F.radians(lat)) * F.cos(d)) - F.tan(F.radians(lat)) * F.tan(d)
    half = F.when(F.abs(x) <= 1, F.degrees(F.acos(x)) * 4)
    noon = 720 - 4 * lon - eq
    return F.struct((noon - half).alias("sunrise"), (noon + half).alias("sunset"))


def next_daily(now: Column, times: list[str], zone: str) -> Column:
    """The first of the daily local times after now, as a timestamp; daylight saving is the zone's."""
    local = F.from_utc_timestamp(now.cast("timestamp"), zone)
    day = F.to_date(local)
    options = [F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.date_add(day, k).cast("string"), F.lit(t))), zone) for k in (0, 1) for t in times]
    return F.array_min(F.filter(F.array(*options), lambda t: t > now.cast("timestamp")))


def fallout(detonation: Column, now: Column) -> Column:
    """Per mark of the seven-ten rule: hours, time, whether it is reached, seconds to go."""
    def mark(hours: int) -> Column:
        left = seconds(detonation) + hours * 3600 - seconds(now)
        return F.struct(F.lit(hours).alias("hours"), F.timestamp_micros((F.unix_micros(detonation.cast("timestamp")) + hours * 3_600_000_000).cast("long")).alias("at"), (left <= 0).alias("reached"), F.greatest(F.lit(0), F.ceil(left)).cast("long").alias("left_s"))

    return F.array(*map(mark, FALLOUT_HOURS))


def countdown(s: Column) -> Column:
    """h:mm:ss, or m:ss within an hour."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s % 60))).otherwise(F.concat_ws(":", m.cast("string"), two(s % 60)))


def beats(elapsed_s: Column, per_minute: int = 110) -> Column:
    return F.greatest(F.lit(0), F.floor(elapsed_s / 60 * per_minute)).cast("long")


def uk_date(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def iso_date(text: Column) -> Column:
    """A UK date as a date; null for what is none."""
    return F.try_to_date(text, "d/M/yyyy")


def relative(seconds_ago: Column) -> Column:
    unit = lambda n, name: F.concat(F.floor(seconds_ago / n).cast("string"), F.lit(f" {name}"), F.when(F.floor(seconds_ago / n) == 1, " ago").otherwise("s ago"))
    return F.when(seconds_ago < 60, "just now").when(seconds_ago < 3600, unit(60, "minute")).when(seconds_ago < 86400, unit(3600, "hour")).otherwise(unit(86400, "day"))
