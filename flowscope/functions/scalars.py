"""Column expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_np(c: Column | str, digits: int) -> Column:
    """Round half to even on the scaled value, as NumPy does (Spark rounds half up)."""
    scale = float(10**digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def flow_key(dpid: Column | str, table_id: Column | str, match: Column | str) -> Column:
    """Flow identity: device, table and the match fields in any order.

    A digest keeps the shuffle key narrow. It is a cryptographic one because match fields
    come from traffic an attacker can shape.
    """
    identity = F.struct(
        _col(dpid).alias("dpid"),
        _col(table_id).alias("table_id"),
        F.array_sort(F.map_entries(_col(match))).alias("match"),
    )
    return F.sha2(F.to_json(identity), 256)


def flow_duration(sec: Column | str, nsec: Column | str) -> Column:
    return round_np(_col(sec) + _col(nsec) * F.lit(1e-9), 4)


def relative_bin(rel: Column | str, width: float = 2) -> Column:
    """Start of the tumbling bin that holds ``rel``, counted from the scenario start."""
    return F.floor(_col(rel) / F.lit(float(width))).cast("double") * F.lit(float(width))


def class_name(idx: Column | str, labels: list[str]) -> Column:
    """Name of the class with index ``idx``; null when there is no such class."""
    names = F.array(*[F.lit(x) for x in labels])
    return F.get(names, _col(idx).cast("int"))


def finite(c: Column | str) -> Column:
    """Both infinities become null."""
    return F.when(F.abs(_col(c)) != F.lit(float("inf")), _col(c))


def without_nan(c: Column | str) -> Column:
    """NaN becomes null, so aggregates skip it."""
    return F.when(~F.isnan(_col(c)), _col(c))


def order_key(ts: Column | str, tiebreak: Column | str | None = None) -> Column:
    """One number ordered like (ts, tiebreak).

    ``max_by`` over a struct falls back to a sort aggregate; a number keeps it a hash
    aggregate with map-side combine. For whole-number tiebreaks; a null one comes first, as
    in a window.
    """
    micros = F.unix_micros(_col(ts))
    if tiebreak is None:
        return micros
    room = F.lit("20000000000000000000").cast("decimal(20,0)")
    first = F.lit("-9900000000000000000").cast("decimal(19,0)")
    return micros.cast("decimal(17,0)") * room + F.coalesce(_col(tiebreak).cast("decimal(19,0)"), first)
