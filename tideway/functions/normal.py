"""Normal distribution as column expressions, accurate far into both tails.

CDF: the rational approximations of W. J. Cody (Math. Comp. 1969). Quantile: algorithm
AS 241 (Wichura, Applied Statistics 1988). Both keep about 15 digits, which a short
polynomial for erf does not: in the lower tail that one cancels to zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients, highest power last unless noted.
CDF_MID_NUM = (18154.981253343561249, 1067.6894854603709582, 161.02823106855587881,
               2.2352520354606839287, 0.065682337918207449113)
CDF_MID_DEN = (45507.789335026729956, 10260.932208618978205, 976.09855173777669322,
               47.20258190468824187, 1.0)
CDF_OUT_NUM = (9842.7148383839780218, 11602.651437647350124, 6848.1904505362823326,
               2494.5375852903726711, 597.27027639480026226, 93.506656132177855979,
               8.8831497943883759412, 0.39894151208813466764, 1.0765576773720192317e-8)
CDF_OUT_DEN = (19685.429676859990727, 38912.003286093271411, 34900.952721145977266,
               18615.571640885098091, 6485.558298266760755, 1519.377599407554805,
               235.38790178262499861, 22.266688044328115691, 1.0)
CDF_TAIL_NUM = (2.9112874951168792e-5, 0.001421619193227893466, 0.022235277870649807,
                0.1274011611602473639, 0.21589853405795699, 0.02307344176494017303)
CDF_TAIL_DEN = (7.29751555083966205e-5, 0.00378239633202758244, 0.0659881378689285515,
                0.468238212480865118, 1.28426009614491121, 1.0)
INV_SQRT_2PI = 0.398942280401432677939946059934

PPF_MID_NUM = (3.3871328727963666080e0, 1.3314166789178437745e+2, 1.9715909503065514427e+3,
               1.3731693765509461125e+4, 4.5921953931549871457e+4, 6.7265770927008700853e+4,
               3.3430575583588128105e+4, 2.5090809287301226727e+3)
PPF_MID_DEN = (1.0, 4.2313330701600911252e+1, 6.8718700749205790830e+2, 5.3941960214247511077e+3,
               2.1213794301586595867e+4, 3.9307895800092710610e+4, 2.8729085735721942674e+4,
               5.2264952788528545610e+3)
PPF_OUT_NUM = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
               3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
               2.27238449892691845833e-2, 7.74545014278341407640e-4)
PPF_OUT_DEN = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
               1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
               1.05075007164441684324e-9)
PPF_TAIL_NUM = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
                2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
                2.71155556874348757815e-5, 2.01033439929228813265e-7)
PPF_TAIL_DEN = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1,
                1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5,
                1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _poly(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    """P(Z <= z) for a standard normal Z. Give a plain column: the expression repeats it."""
    a = F.abs(z)
    mid = F.lit(0.5) + z * _poly(z * z, CDF_MID_NUM) / _poly(z * z, CDF_MID_DEN)
    out = F.exp(-a * a / 2) * _poly(a, CDF_OUT_NUM) / _poly(a, CDF_OUT_DEN)
    # nullif keeps ANSI division quiet in the branch that is not taken
    inv = F.lit(1.0) / F.nullif(a * a, F.lit(0.0))
    tail = (
        F.exp(-a * a / 2)
        * (F.lit(INV_SQRT_2PI) - inv * _poly(inv, CDF_TAIL_NUM) / _poly(inv, CDF_TAIL_DEN))
        / F.nullif(a, F.lit(0.0))
    )
    upper = F.when(a < 5.656854249492381, out).otherwise(tail)
    return F.when(a <= 0.67448975, mid).when(z < 0, upper).otherwise(F.lit(1.0) - upper)


def normal_ppf(p: Column) -> Column:
    """Inverse of ``normal_cdf`` for 0 < p < 1; null outside."""
    q = p - F.lit(0.5)
    r_mid = F.lit(0.180625) - q * q
    mid = q * _poly(r_mid, PPF_MID_NUM) / _poly(r_mid, PPF_MID_DEN)
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    out = _poly(r - 1.6, PPF_OUT_NUM) / _poly(r - 1.6, PPF_OUT_DEN)
    tail = _poly(r - 5.0, PPF_TAIL_NUM) / _poly(r - 5.0, PPF_TAIL_DEN)
    far = F.when(r <= 5.0, out).otherwise(tail)
    signed = F.when(q < 0, -far).otherwise(far)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, mid).otherwise(signed))
