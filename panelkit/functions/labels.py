"""Fixed names of classes, phases, metrics and vegetation types.

The literal values in this module are fixed values of the study design.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

CONDITIONS = ("Dry", "Normal", "Wet")
CLASSES = ("D1", "D2", "D3", "N", "W1", "W2", "W3")

# representative year of each class, chosen by hand in the study
CLASS_YEARS = {"D1": 2012, "D2": 2015, "D3": 2001, "N": 2017, "W1": 2006, "W2": 2005, "W3": 2000}

# (condition, station statistic) that each class stands for
CLASS_METRICS = {
    ("Dry", "Min"): "D1",
    ("Dry", "Mean"): "D2",
    ("Dry", "Max"): "D3",
    ("Normal", "Mean"): "N",
    ("Wet", "Min"): "W1",
    ("Wet", "Mean"): "W2",
    ("Wet", "Max"): "W3",
}

PERIODS = ("baseline", "impact", "recovery", "normal")
VARIABLES = ("gpp", "precip")
METRICS = ("stability", "impact", "recovery", "recovery_base", "recovery_impact")
WIDE_METRICS = tuple(f"{v}_{m}" for v in VARIABLES for m in METRICS)

VEGETATION = {7: "Open Shrublands", 8: "Woody Savannas", 9: "Savannas", 10: "Grasslands"}

RECOVERY_ORDER = ("W1", "W2", "W3", "N")
METRIC_ORDER = ("Recovery[b]", "Recovery[i]", "Impact", "Stability")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def relabel(c: Column, names: dict) -> Column:
    """Map codes to labels; codes outside ``names`` become NULL."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.try_element_at(pairs, c)


def ordinal(c: Column, levels) -> Column:
    """Position of a label in ``levels``, to sort by instead of an ordered factor; NULL if unknown."""
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), c).cast("int")
    return F.when(position > 0, position)
