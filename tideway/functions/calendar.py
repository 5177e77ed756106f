"""Season, sun and moon as column expressions on UTC dates and seconds of the day."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideway.functions.scalar import as_col

DAY = 86400
TWO_PI = 2 * math.pi

# Low-precision solar position (epoch J2000, degrees).
J2000_UNIX_DAY = 10957.5
MEAN_ANOMALY = (357.5291, 0.98560028)
EQUATION_OF_CENTRE = (1.9148, 0.0200, 0.0003)
PERIHELION = 102.9372
OBLIQUITY = 23.4397
HORIZON = -0.833

# Time of new moon, mean lunation and its leading periodic terms (days).
NEW_MOON_UNIX_DAY = 2451550.09766 - 2440587.5
SYNODIC_DAYS = 29.530588861
LUNATIONS_PER_CENTURY = 1236.85
TT_MINUS_UT_DAYS = 69.0 / DAY
SUN_ANOMALY = (2.5534, 29.10535670)
MOON_ANOMALY = (201.5643, 385.81693528)
MOON_LATITUDE_ARGUMENT = (160.7108, 390.67050284)
NEW_MOON_TERMS = (
    # amplitude, multiples of (sun anomaly, moon anomaly, latitude argument)
    (-0.40720, 0, 1, 0),
    (0.17241, 1, 0, 0),
    (0.01608, 0, 2, 0),
    (0.01039, 0, 0, 2),
    (0.00739, -1, 1, 0),
    (-0.00514, 1, 1, 0),
    (0.00208, 2, 0, 0),
    (-0.00111, 0, 1, -2),
    (-0.00057, 0, 1, 2),
)


def month_circle(day: Column | str, period: int = 11) -> Column:
    """Month as an angle. With the default period January and December fall together;
    ``period=12`` gives the even spacing."""
    return (F.month(as_col(day)) - F.lit(1)) / F.lit(float(period)) * F.lit(TWO_PI)


def orbit_phase(day: Column | str) -> Column:
    """Day of the year over the days of that year, as an angle in (0, 2 pi]."""
    d = as_col(day)
    length = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))
    return F.dayofyear(d) / length * F.lit(TWO_PI)


def unix_day(day: Column | str) -> Column:
    return F.datediff(as_col(day), F.lit("1970-01-01").cast("date"))


def sun_phase(second: Column | str, sunrise: Column | str, sunset: Column | str) -> Column:
    """Daylight runs over [0, pi), night over [pi, 2 pi).

    All three inputs are seconds of the UTC day. Working on the 24 h circle covers the
    case where the sun sets after midnight UTC without a branch of its own.
    """
    t, up, down = as_col(second), as_col(sunrise), as_col(sunset)
    day_length = F.pmod(down - up, F.lit(float(DAY)))
    since_rise = F.pmod(t - up, F.lit(float(DAY)))
    since_set = F.pmod(t - down, F.lit(float(DAY)))
    pi = F.lit(math.pi)
    light = since_rise / F.nullif(day_length, F.lit(0.0)) * pi
    dark = pi + since_set / F.nullif(F.lit(float(DAY)) - day_length, F.lit(0.0)) * pi
    return F.when(since_rise < day_length, light).when(since_rise >= day_length, dark)


def day_period(hour: Column | str, sunrise: Column | str, sunset: Column | str):
    """(daytime flag, hours of daylight, progress through the running day or night).

    Inputs are hours of the UTC day.
    """
    h, up, down = as_col(hour), as_col(sunrise), as_col(sunset)
    length = F.pmod((down - up).cast("double"), F.lit(24.0))
    since_rise = F.pmod((h - up).cast("double"), F.lit(24.0))
    since_set = F.pmod((h - down).cast("double"), F.lit(24.0))
    daytime = since_rise < length
    progress = F.when(daytime, since_rise / F.nullif(length, F.lit(0.0))).otherwise(
        since_set / F.nullif(F.lit(24.0) - length, F.lit(0.0))
    )
    return daytime, length, progress


def new_moon(k: Column) -> Column:
    """Unix day (fractional) of the k-th new moon after January 2000."""
    rad = math.pi / 180
    century = k / LUNATIONS_PER_CENTURY
    arguments = (
        (SUN_ANOMALY[0] + SUN_ANOMALY[1] * k) * rad,
        (MOON_ANOMALY[0] + MOON_ANOMALY[1] * k + 0.0107582 * century * century) * rad,
        (MOON_LATITUDE_ARGUMENT[0] + MOON_LATITUDE_ARGUMENT[1] * k
         - 0.0016118 * century * century) * rad,
    )
    out = (
        F.lit(NEW_MOON_UNIX_DAY - TT_MINUS_UT_DAYS)
        + k * SYNODIC_DAYS
        + 0.00015437 * century * century
    )
    eccentricity = 1 - 0.002516 * century
    for amplitude, *multiples in NEW_MOON_TERMS:
        angle = F.lit(0.0)
        for multiple, argument in zip(multiples, arguments):
            if multiple:
                angle = angle + multiple * argument
        term = amplitude * F.sin(angle)
        for _ in range(abs(multiples[0])):
            term = term * eccentricity
        out = out + term
    return out
