"""Connector control arithmetic on columns: blocks, decay, rest, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_seconds(failures: Column) -> Column:
    """300 s from the fifth failure, doubling, a day at most."""
    return F.least(F.lit(86400.0), 300.0 * F.pow(F.lit(2.0), F.least(F.greatest(failures - 5, F.lit(0)), F.lit(16))))


def decayed(override: Column, baseline: Column) -> Column:
    """0.7 of an override towards its baseline; null once within 5 % of it."""
    relaxed = F.greatest(baseline, override * 0.7)
    return F.when((override > baseline * 1.05) & (relaxed > baseline * 1.05), relaxed)


def tightened(interval: Column) -> Column:
    return F.least(F.lit(10.0), F.greatest(F.lit(0.25), interval) * 2)


def rest_hours(failures: Column) -> Column:
    """Hours a member rests: 6 from the third failure, doubling, a week at most; null before."""
    return F.when(failures >= 3, F.least(6 * F.pow(F.lit(2), F.least(failures - 3, F.lit(8))), F.lit(168)).cast("long"))


def rested_until(last_attempt: Column, failures: Column) -> Column:
    return last_attempt + F.make_dt_interval(F.lit(0), rest_hours(failures).cast("int"))


def request_ceiling(base: Column, boards: Column, per_board: Column, reserve: Column) -> Column:
    return F.least(F.lit(2000), F.greatest(base, boards * per_board + reserve))


def upcoming_season_year(ts: Column) -> Column:
    return F.year(ts) + (F.month(ts) >= 8).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)
