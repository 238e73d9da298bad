"""The transparent score: bounded terms, weighted sum and a sentence per term."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vessels import vtype_label

# Weight per term in log-odds, bias, evidence floor and evidence count.
WEIGHTS = {
    "prox": 3.0, "near": 2.0, "dwell": 1.2, "timing": 0.8, "slow": 0.9, "loiter": 0.7,
    "dark_gap": 1.5, "dark_frac": 0.5, "axis": 1.0, "vtype": 1.0, "size": 0.4,
}
BIAS = -3.2
EVIDENCE_FLOOR = 0.25
EVIDENCE_COUNT = 4
NO_EVIDENCE = "Present in the area, but no distinguishing evidence"

#: The fourteen features in serving order.
FEATURES = [
    "prox_score", "min_dist_km", "mean_dist_km", "dwell_frac", "time_gap_min",
    "slow_steaming", "loiter_score", "ais_gap_max_min", "gap_over_origin", "dark_frac",
    "course_align", "cpa_sog_kn", "vtype_prior", "size_score",
]


def evidence_terms() -> dict[str, Column]:
    """Feature columns mapped to bounded terms; ``axis`` alone may be negative."""
    c = F.col
    return {
        "prox": c("prox_score"),
        "near": F.exp(-c("min_dist_km") / 8.0),
        "dwell": c("dwell_frac"),
        "timing": F.exp(-c("time_gap_min") / 45.0),
        "slow": c("slow_steaming"),
        "loiter": c("loiter_score"),
        "dark_gap": c("gap_over_origin"),
        "dark_frac": c("dark_frac"),
        "axis": 2.0 * (c("course_align") - 0.5),
        "vtype": c("vtype_prior"),
        "size": c("size_score"),
    }


def baseline_score(weights: dict[str, float] | None = None, bias: float = BIAS) -> Column:
    terms, total = evidence_terms(), F.lit(float(bias))
    for name, w in (weights or WEIGHTS).items():
        total = total + F.lit(float(w)) * terms[name]
    return total


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _num(x: Column, digits: int) -> Column:
    # Half-even, so that 12.5 prints as 12.
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def evidence_sentences() -> dict[str, Column]:
    """Sentence per term; null where the signal behind the term is absent."""
    c, s = F.col, F.lit
    pct = lambda x: F.concat(_num(c(x) * 100, 0), s("%"))
    return {
        "prox": s("Position overlaps the estimated discharge point"),
        "near": F.concat(s("Passed within "), _num(c("min_dist_km"), 1), s(" km of the origin")),
        "dwell": F.concat(s("Spent "), pct("dwell_frac"),
                          s(" of the window inside the search radius")),
        "timing": F.concat(s("AIS fix within "), _num(c("time_gap_min"), 0),
                           s(" min of the discharge time")),
        "slow": F.concat(s("Slow-steaming ("), pct("slow_steaming"), s(" of fixes at 2-9 kn)")),
        "loiter": s("Low-speed manoeuvring with unstable heading"),
        "dark_gap": F.when(c("gap_over_origin") > 0, F.concat(
            s("AIS went dark over the origin ("), _num(c("ais_gap_max_min"), 0), s(" min)"))),
        "dark_frac": F.concat(s("Reporting gaps cover "), pct("dark_frac"),
                              s(" of the discharge window")),
        "axis": s("Course aligns with the slick's long axis"),
        "vtype": F.concat(vtype_label(), s(" -- elevated prior for oil discharge")),
        "size": F.when(c("length").isNotNull(), F.concat(
            s("Large vessel ("), _num(c("length"), 0), s(" m)"))),
    }


def evidence_list(weights: dict[str, float] | None = None, count: int = EVIDENCE_COUNT) -> Column:
    """Sentences of the strongest contributions, largest first (ties in term order)."""
    weights = weights or WEIGHTS
    terms, text = evidence_terms(), evidence_sentences()
    items = F.array(*[
        F.struct((-F.lit(float(w)) * terms[name]).alias("neg"), F.lit(i).alias("pos"),
                 text[name].alias("text"))
        for i, (name, w) in enumerate(weights.items())])
    kept = F.filter(F.array_sort(items),
                    lambda x: (x["neg"] <= -EVIDENCE_FLOOR) & x["text"].isNotNull())
    top = F.transform(F.slice(kept, 1, count), lambda x: x["text"])
    return F.when(F.size(top) > 0, top).otherwise(F.array(F.lit(NO_EVIDENCE)))
