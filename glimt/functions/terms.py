"""Structured filter terms: each is a Column, true only where it matches, and composes by AND."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimt.functions.fields import quoted, resolve, signal_time

#: Severity ranges, span status and span kind numbers.
LEVELS = {"debug": (1, 8), "info": (9, 12), "warn": (13, 16), "error": (17, 20), "fatal": (21, 24)}
STATUS = {"unset": 0, "ok": 1, "error": 2}
KIND = {"unspecified": 0, "internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}
UNIT_NANOS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}
_OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
#: What a number looks like; a cast alone would also take padded and suffixed text.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"


def negate(term: Column) -> Column:
    """Two-valued: where the term is false or unknown."""
    return ~F.coalesce(term, F.lit(False))


def conjunction(terms: Sequence[Column]) -> Column:
    """All of the terms; no terms match everything."""
    return reduce(operator.and_, terms, F.lit(True))


def match(df: DataFrame, signal: str, field: str, values: Sequence[str]) -> Column:
    return resolve(df, signal, field).cast("string").isin(list(values))


def exists(df: DataFrame, signal: str, field: str) -> Column:
    return resolve(df, signal, field).isNotNull()


def number_of(text: Column) -> Column:
    """The text as a double if it is a plain number, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def compare(df: DataFrame, signal: str, field: str, op: str, value: float, unit: str | None = None) -> Column:
    """Numeric comparison; text that is no number never matches. A unit turns the value into nanoseconds."""
    column = resolve(df, signal, field)
    bound = value * UNIT_NANOS[unit] if unit else value
    if dict(df.dtypes).get(field) in ("int", "bigint", "double") or (signal == "spans" and field in ("duration", "duration_nanos")):
        return _OPS[op](column, F.lit(int(bound) if float(bound).is_integer() else bound))
    return _OPS[op](number_of(column.cast("string")), F.lit(float(bound)))


def free_text(signal: str, text: str) -> Column:
    """Case-sensitive substring of a log's body or a span's name; metrics have no text."""
    if signal == "metrics":
        raise ValueError("metrics have no free text")
    return F.col("body" if signal == "logs" else "name").contains(text)


def level(keywords: Sequence[str]) -> Column:
    return reduce(operator.or_, (F.col("severity_number").between(*LEVELS[k.lower()]) for k in keywords))


def status(keywords: Sequence[str]) -> Column:
    return F.col("status_code").isin([STATUS[k.lower()] for k in keywords])


def kind(keywords: Sequence[str]) -> Column:
    return F.col("kind").isin([KIND[k.lower()] for k in keywords])


def in_window(signal: str, start: int, end: int) -> Column:
    """Both ends inclusive."""
    return F.col(signal_time(signal)).between(start, end)


def log_filter(df: DataFrame, start: int, end: int, services: Sequence[str] = (), levels: Sequence[str] = (), text: str = "", terms: Sequence[Column] = ()) -> Column:
    parts = [in_window("logs", start, end)]
    if services:
        parts.append(quoted("service.name").isin(list(services)))
    if levels:
        parts.append(level(levels))
    if text:
        parts.append(free_text("logs", text))
    return conjunction([*parts, *terms])


def span_filter(start: int, end: int, terms: Sequence[Column] = ()) -> Column:
    return conjunction([in_window("spans", start, end), *terms])


def metric_filter(name: str, start: int, end: int, terms: Sequence[Column] = ()) -> Column:
    return conjunction([F.col("metric_name") == name, in_window("metrics", start, end), *terms])


def host_pin(host: str, term: Column | None = None) -> Column:
    """One host, and whatever the caller asks of it."""
    pin = quoted("host.name") == host
    return pin if term is None else pin & term
