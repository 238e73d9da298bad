"""Vessel-type priors, labels and size as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import clamp, col

# Prior per AIS type code range (low, high, prior); anything else 0.40.
TYPE_PRIORS = [
    (80, 89, 1.00), (70, 79, 0.85), (30, 30, 0.35), (31, 32, 0.60),
    (50, 59, 0.45), (60, 69, 0.40), (40, 49, 0.25), (36, 37, 0.12),
]
TYPE_PRIOR_OTHER = 0.40
SIZE_UNKNOWN = 0.35

# Label per AIS type code range; codes 40-49 have a prior but no label.
TYPE_LABELS = [
    (80, 89, "Tanker"), (70, 79, "Cargo vessel"), (30, 30, "Fishing vessel"),
    (31, 32, "Towing vessel"), (50, 59, "Special craft"),
    (60, 69, "Passenger vessel"), (36, 37, "Sailing / pleasure craft"),
]


def _by_range(code: Column, table: list, other: Column) -> Column:
    out = None
    for lo, hi, value in table:
        cond = code.between(lo, hi)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(other)


def vtype_prior(vtype="vtype") -> Column:
    return _by_range(col(vtype).cast("int"), TYPE_PRIORS, F.lit(TYPE_PRIOR_OTHER))


def vtype_label(vtype="vtype") -> Column:
    code = col(vtype).cast("int")
    named = _by_range(code, TYPE_LABELS, F.concat(F.lit("Vessel type "), code.cast("string")))
    return F.when(code.isNull(), F.lit("Vessel type unknown")).otherwise(named)


def size_score(length="length") -> Column:
    m = col(length)
    scaled = clamp(F.log10(m / 10.0) / F.log10(F.lit(40.0)), 0, 1)
    return F.when(m > 0, scaled).otherwise(F.lit(SIZE_UNKNOWN))
