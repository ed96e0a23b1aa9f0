"""Spread weight, slice-scaled thresholds and the comparative score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.model import value


def spread_weight(days: Column, half_days: Column) -> Column:
    """0..1: half at `half_days` distinct days, small for a one-day burst."""
    return F.when(days > 0, days / (days + half_days)).otherwise(0.0)


def scaled_min_days(setting, window_days: Column) -> Column:
    return F.least(value(setting).cast("long"), F.greatest(window_days, F.lit(1)))


def scaled_half_days(setting, window_days: Column) -> Column:
    quarter = F.greatest(window_days, F.lit(1)) / F.lit(4)
    return F.least(value(setting).cast("double"), F.greatest(F.lit(1.0), quarter))


def comparative_score(count: Column, total: Column, base_count: Column, base_total: Column, base_vocab: Column) -> Column:
    """Rate here over the add-one smoothed rate in the baseline."""
    here = F.when(total > 0, count / total).otherwise(0.0)
    there = (F.coalesce(base_count, F.lit(0)) + 1) / (base_total + F.greatest(base_vocab, F.lit(1)))
    return here / there
