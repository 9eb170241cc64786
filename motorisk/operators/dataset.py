"""Modelling dataset: claim targets aggregated, then left-joined to policies.

A1 / A2 group the claim-type rows by (client, policy-year cost); J1 joins the
result to the policy frame; P7 fills policies without claims with 0. Amounts
that are keys or summed are counted in whole units of 1/``MONEY_UNITS``, so that
noise in the last bits of a double splits no key and the order of the rows
changes no sum. An amount that is NaN or infinite is missing.
The claim side is aggregated before the join (map-side partial aggregation,
one row per key), so the join cannot fan out. AQE decides at run time
whether the aggregated side is small enough to broadcast; a client that
holds a large share of the policies is split by AQE's skew-join handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("ID", "Cost_claims_year")
#: Whole units per unit of money.
MONEY_UNITS = 10_000


def _fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def _units(name: str) -> Column:
    """An amount in whole units; missing when it is NaN, infinite or beyond them."""
    return F.round(F.col(name).cast("double") * MONEY_UNITS).try_cast("bigint")


def _targets(claims: DataFrame, keys: Sequence[Column], value: str, how: str, out: str) -> DataFrame:
    """Columns ``_k0``, ``_k1``, … of the keys and the count or sum of ``value``."""
    if how not in ("count", "sum"):
        raise ValueError(f"how must be 'count' or 'sum', got {how!r}")
    money = _fractional(claims, value)
    keyed = claims.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], (_units(value) if money else F.col(value)).alias("_v"))
    names = keyed.columns[:-1]
    if how == "count":
        agg = F.count("_v")
    else:
        agg = F.coalesce(F.sum("_v").cast("double"), F.lit(0.0))
        agg = agg / MONEY_UNITS if money else agg
    return keyed.dropna(subset=names).groupBy(*names).agg(agg.alias(out))


def claim_target(
    claims: DataFrame,
    keys: Sequence[str] = KEYS,
    value: str = "Cost_claims_by_type",
    how: str = "count",
    out: str = "claims_frequency",
) -> DataFrame:
    """Per key: non-null count (A1) or sum (A2) of ``value``.

    Rows with a missing key are dropped, as a pandas group-by does."""
    money = [_fractional(claims, k) for k in keys]
    got = _targets(claims, [_units(k) if m else F.col(k) for k, m in zip(keys, money)], value, how, out)
    shown = [F.col(f"_k{i}") / MONEY_UNITS if m else F.col(f"_k{i}") for i, m in enumerate(money)]
    return got.select(*[c.alias(k) for c, k in zip(shown, keys)], out)


def modelling_dataset(
    policies: DataFrame,
    claims: DataFrame,
    target: str = "count",
    keys: Sequence[str] = KEYS,
    value: str = "Cost_claims_by_type",
) -> DataFrame:
    """G3. ``target='count'``: ``claims_frequency`` = number of claim types.
    ``target='flag'``: ``Cost_claims_by_type`` = summed cost (0 if none) and
    ``claims_frequency`` = 1 when that cost is positive."""
    if target not in ("count", "flag"):
        raise ValueError(f"target must be 'count' or 'flag', got {target!r}")
    how, out = ("count", "claims_frequency") if target == "count" else ("sum", value)
    money = [_fractional(policies, k) or _fractional(claims, k) for k in keys]
    same = [_units(k) if m else F.col(k) for k, m in zip(keys, money)]
    agg = _targets(claims, same, value, how, out)
    names = agg.columns[:-1]
    keyed = policies.withColumns(dict(zip(names, same)))
    joined = keyed.join(agg, names, "left").select(*policies.columns, out)
    if target == "count":
        return fill_missing(joined, out).withColumn(out, F.col(out).cast("bigint"))
    joined = fill_missing(joined, out, 0.0)
    return joined.withColumn("claims_frequency", (F.col(out) > 0).cast("int"))


def fill_missing(df: DataFrame, column: str, value: object = 0) -> DataFrame:
    """Constant fill of one column."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
