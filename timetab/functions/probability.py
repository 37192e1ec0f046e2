"""Logits, probabilities and labels as column expressions, and the inverse normal distribution for Arrow UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximation AS 241 (Wichura 1988), lowest power first.
CENTRE_TOP = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
]
CENTRE_BOTTOM = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
]
NEAR_TOP = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
NEAR_BOTTOM = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]
FAR_TOP = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
FAR_BOTTOM = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
]


def inverse_normal():
    """A NumPy function for the inverse standard normal distribution on 0 < p < 1, to double precision.

    It carries its constants along, so that it can be shipped inside an Arrow UDF.
    """
    centre, near, far = (CENTRE_TOP, CENTRE_BOTTOM), (NEAR_TOP, NEAR_BOTTOM), (FAR_TOP, FAR_BOTTOM)

    def run(p):
        import numpy as np

        def ratio(r, coefficients):
            top, bottom = coefficients
            return np.polyval(top[::-1], r) / np.polyval(bottom[::-1], r)

        q = p - 0.5
        tail = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
        outer = np.where(tail <= 5.0, ratio(tail - 1.6, near), ratio(tail - 5.0, far))
        return np.where(np.abs(q) <= 0.425, q * ratio(0.180625 - q * q, centre), np.sign(q) * outer)

    return run


def sigmoid(logit: str | Column) -> Column:
    x = F.col(logit) if isinstance(logit, str) else logit
    return 1.0 / (1.0 + F.exp(-x))


def softmax(logits: str | Column) -> Column:
    """Probabilities from an array of logits."""
    a = F.col(logits) if isinstance(logits, str) else logits
    shifted = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x))


def binary_label(probability: str | Column) -> Column:
    """0 or 1, a half rounds to the even number 0."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.bround(p).cast("bigint")


def class_label(probabilities: str | Column) -> Column:
    """0-based index of the largest entry, the first one on ties."""
    a = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    return F.array_position(a, F.array_max(a)) - 1
