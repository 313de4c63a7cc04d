"""The normal distribution as column expressions: built-in arithmetic only, so that it stays in generated code."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cody (1969), rational approximations of erf and erfc, coefficients from the highest power down.
ERF_P = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_P = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3,
    1.23033935479799725e3,
)
ERFC_Q = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
TAIL_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
TAIL_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
#: Wichura (1988), algorithm AS 241, coefficients from the highest power down.
CENTRE_P = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2,
    3.3871328727963666080e0,
)
CENTRE_Q = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0,
)
NEAR_P = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0,
    1.42343711074968357734e0,
)
NEAR_Q = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0,
)
FAR_P = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0,
    6.65790464350110377720e0,
)
FAR_Q = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
)


def ratio(x: Column, p: tuple[float, ...], q: tuple[float, ...]) -> Column:
    """p(x) / q(x), by Horner's rule."""

    def value(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    return value(p) / value(q)


def normal_cdf(z: str) -> Column:
    """Φ of a double column, to some 1e-15, in the lower tail relatively; NULL and NaN stay."""
    x = F.abs(F.col(z)) / sqrt(2)
    # exp(-x²) from a part of x without rounding in its square, and the rest
    whole = F.floor(F.least(x, F.lit(64.0)) * 16) / 16
    bell = F.exp(-whole * whole) * F.exp(-(x - whole) * (x + whole))
    inverse = 1 / (x * x)
    far = bell / x * (1 / sqrt(pi) - inverse * ratio(inverse, TAIL_P, TAIL_Q))
    half = F.when(x <= 4, bell * ratio(x, ERFC_P, ERFC_Q)).when(x < 27, far).otherwise(F.lit(0.0)) / 2
    centre = F.col(z) / sqrt(2) * ratio(x * x, ERF_P, ERF_Q) / 2
    out = F.when(x <= 0.46875, 0.5 + centre).when(F.col(z) < 0, half).otherwise(1 - half)
    return F.when(F.isnan(z), F.col(z)).otherwise(F.when(F.col(z).isNotNull(), out))


def normal_ppf(q: str) -> Column:
    """Φ⁻¹ of a double column, to some 1e-15 relatively; NULL outside of 0 to 1, both ends too."""
    p = F.col(q)
    d = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(r - 1.6, NEAR_P, NEAR_Q)).otherwise(ratio(r - 5, FAR_P, FAR_Q))
    centre = d * ratio(0.180625 - d * d, CENTRE_P, CENTRE_Q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(d) <= 0.425, centre).when(d < 0, -tail).otherwise(tail))
