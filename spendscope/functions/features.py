"""Feature vector of one resource-day for the isolation forest."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal of each resource type.
TYPE_CODES = {"cluster": 0, "warehouse": 1, "job": 2, "pipeline": 3, "other": 4}

FEATURES = ("f_rate", "f_cost", "f_hours", "f_hour_sin", "f_hour_cos", "f_dow_sin", "f_dow_cos", "f_type")


def anomaly_features(
    units: Column, cost: Column, hours: Column, start_hour: Column, weekday: Column, kind: Column
) -> list[Column]:
    """log1p of hourly rate, cost and duration, hour and weekday on the circle, type ordinal.

    ``weekday`` counts from Sunday = 1 in training and scoring alike.
    """
    h = F.greatest(hours.cast("double"), F.lit(0.01))
    day_angle = start_hour.cast("double") * (2 * math.pi / 24)
    week_angle = weekday.cast("double") * (2 * math.pi / 7)
    code = F
    for name, value in TYPE_CODES.items():
        code = code.when(kind == name, F.lit(float(value)))
    values = (
        F.log1p(units.cast("double") / h), F.log1p(cost.cast("double")), F.log1p(h),
        F.sin(day_angle), F.cos(day_angle), F.sin(week_angle), F.cos(week_angle),
        code.otherwise(F.lit(4.0)),
    )
    return [v.alias(n) for v, n in zip(values, FEATURES)]
