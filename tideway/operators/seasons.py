"""Sun and moon columns.

The formulas reuse their intermediate results many times. They are added as columns step by
step: Catalyst keeps a step apart when it is read more than once, so each is computed once per
row and the generated code stays small.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.functions import calendar as cal
from tideway.operators.joins import per_distinct

RAD = math.pi / 180


def sun_times(
    df: DataFrame, lat: str, lon: str, day: str, sunrise: str = "sunrise", sunset: str = "sunset"
) -> DataFrame:
    """Sunrise and sunset in seconds of the UTC day; both null in polar day or night.

    The sunrise equation, good to some minutes.
    """
    c1, c2, c3 = cal.EQUATION_OF_CENTRE
    m, e, d = F.col("__m"), F.col("__e"), F.col("__d")
    out = df.withColumn(
        "__noon", cal.unix_day(day) - F.lit(cal.J2000_UNIX_DAY) + F.lit(0.5) - F.col(lon) / F.lit(360.0)
    )
    mean = F.lit(cal.MEAN_ANOMALY[0]) + F.lit(cal.MEAN_ANOMALY[1]) * F.col("__noon")
    out = out.withColumn("__m", F.pmod(mean, F.lit(360.0)) * RAD)
    centre = c1 * F.sin(m) + c2 * F.sin(2 * m) + c3 * F.sin(3 * m)
    out = out.withColumn("__e", F.pmod(m / RAD + centre + 180 + cal.PERIHELION, F.lit(360.0)) * RAD)
    out = out.withColumns(
        {
            "__transit": F.col("__noon") + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * e),
            "__d": F.sin(e) * math.sin(cal.OBLIQUITY * RAD),
        }
    )
    phi = F.col(lat) * RAD
    cos_hour = (F.lit(math.sin(cal.HORIZON * RAD)) - F.sin(phi) * d) / F.nullif(
        F.cos(phi) * F.sqrt(1 - d * d), F.lit(0.0)
    )
    out = out.withColumn("__h", cos_hour)
    out = out.withColumn("__half", F.when(F.abs("__h") <= 1, F.acos("__h")) / cal.TWO_PI)

    def second_of_day(t):
        return F.pmod((t + 0.5) * cal.DAY, F.lit(float(cal.DAY)))

    out = out.withColumns(
        {
            sunrise: second_of_day(F.col("__transit") - F.col("__half")),
            sunset: second_of_day(F.col("__transit") + F.col("__half")),
        }
    )
    return out.drop("__noon", "__m", "__e", "__transit", "__d", "__h", "__half")


def moon_phase(df: DataFrame, day: str, name: str = "moon_radians") -> DataFrame:
    """Fraction of the way from the previous to the next new moon, times 2 pi, at 00:00 UTC.

    New moons carry their leading periodic terms, good to some minutes. The true new moon
    strays up to 0.6 days from the mean one, so three lunations are tested.
    """
    t = F.col("__t")
    out = df.withColumn("__t", cal.unix_day(day).cast("double"))
    out = out.withColumn("__k", F.floor((t - cal.NEW_MOON_UNIX_DAY) / cal.SYNODIC_DAYS).cast("double"))
    moons = [f"__moon{i}" for i in range(4)]
    out = out.withColumns({n: cal.new_moon(F.col("__k") + (i - 1)) for i, n in enumerate(moons)})
    before, here, after, beyond = (F.col(n) for n in moons)
    out = out.withColumns(
        {
            "__from": F.when(t < here, before).when(t < after, here).otherwise(after),
            "__to": F.when(t < here, here).when(t < after, after).otherwise(beyond),
        }
    )
    phase = (t - F.col("__from")) / (F.col("__to") - F.col("__from")) * cal.TWO_PI
    return out.withColumn(name, phase).drop("__t", "__k", "__from", "__to", *moons)


def date_phases(df: DataFrame, day: str) -> DataFrame:
    """Moon and orbit phase, computed once per distinct date and joined back."""
    return per_distinct(
        df, [day],
        lambda d: moon_phase(d, day).withColumn("orbit_radians", cal.orbit_phase(day)),
    )


def circle_columns(df: DataFrame, *names: str) -> DataFrame:
    """cos_x and sin_x of every x_radians column."""
    made = {}
    for n in names:
        made[f"cos_{n}"] = F.cos(f"{n}_radians")
        made[f"sin_{n}"] = F.sin(f"{n}_radians")
    return df.withColumns(made)
