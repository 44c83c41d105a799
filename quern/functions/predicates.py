"""Equality on text parameters, under strict rules that Spark's casts do not have.

A value that does not parse as the field's type fits no row, which is lit(False); a null column fits no value.
"""

from __future__ import annotations

import math
import re
import uuid
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, Field

#: Inclusive ranges of the integer types.
RANGES = {"u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1), "i32": (-(2**31), 2**31 - 1), "i64": (-(2**63), 2**63 - 1), "timestamp": (-(2**63), 2**63 - 1)}
PAGING = {"sort", "order", "limit", "offset"}


def parse(kind: str, text: str):
    """The value of a text as a scalar of this kind, or None."""
    if kind in RANGES:
        sign = r"\+?" if kind[0] == "u" else r"[+-]?"
        low, high = RANGES[kind]
        return int(text) if re.fullmatch(sign + "[0-9]+", text) and low <= int(text) <= high else None
    if kind == "f64":
        if re.fullmatch(r"[+-]?(?:inf|infinity|nan)", text, re.I):
            return float(text)
        return float(text) if re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text) else None
    if kind == "bool":
        return {"true": True, "false": False}.get(text)
    if kind == "uuid":
        try:
            return str(uuid.UUID(text))
        except ValueError:
            return None
    if kind == "decimal":
        try:
            return Decimal(text) if re.fullmatch(r"[+-]?[0-9]*\.?[0-9]+", text) else None
        except InvalidOperation:
            return None
    return text


def equals(catalog: Catalog, f: Field, text: str, column: Column | None = None) -> Column:
    """field = text."""
    column = F.col(f.name) if column is None else column
    if f.kind == "enum":
        return column == F.lit(text) if text in catalog.enums[f.target] else F.lit(False)
    if f.kind == "char":
        return F.rtrim(column, F.lit("\0")) == F.lit(text) if len(text.encode()) <= f.size else F.lit(False)
    value = parse(f.target, text)
    if value is None or isinstance(value, float) and math.isnan(value):
        return F.lit(False)
    if f.target == "u64":
        return column == F.lit(Decimal(value)).cast("decimal(20,0)")
    return column == F.lit(value)


def matching(catalog: Catalog, model: str, params: dict[str, str]) -> Column:
    """All parameters that name a filterable field, by AND; others are ignored, none at all fits every row."""
    out = F.lit(True)
    for f in catalog.models[model].fields:
        if f.filterable and f.name in params:
            out = out & equals(catalog, f, params[f.name])
    return out


def loose(params: dict[str, str]) -> dict[str, float | bool | str]:
    """Untyped values of a query string's filters: a number if it reads back as the same text, a bool, else the text."""
    out: dict[str, float | bool | str] = {}
    for k, v in params.items():
        if k not in PAGING:
            number = float(v) if re.fullmatch(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]*[1-9])?", v) else None
            out[k] = number if number is not None and (repr(number) == v or repr(int(number)) == v and "." not in v) else {"true": True, "false": False}.get(v, v)
    return out


def loose_equals(column: Column, kind: str, value: float | bool | str) -> Column:
    """column = value of the same kind (number, bool or string); never across kinds, and exactly."""
    of = "bool" if isinstance(value, bool) else "number" if isinstance(value, float) else "string"
    return column == F.lit(value) if of == kind else F.lit(False)


def ordinal(catalog: Catalog, f: Field) -> Column:
    """What a field sorts by: enums by declaration order, all else by value."""
    if f.kind != "enum":
        return F.col(f.name)
    return F.when(F.col(f.name).isNotNull(), F.array_position(F.array(*[F.lit(v) for v in catalog.enums[f.target]]), F.col(f.name)))


#: Stated rule for @email; @url needs a scheme and a host.
EMAIL, URL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+"


def violations(f: Field) -> list[tuple[str, Column]]:
    """(rule, whether a row breaks it) of a field's enforced constraints and type. Nulls of nullable fields pass."""
    c, out = F.col(f.name), []
    for name, args in f.constraints:
        if name == "min":
            out.append((f"{f.name} @min", c < F.lit(args[0])))
        elif name == "max":
            out.append((f"{f.name} @max", c > F.lit(args[0])))
        elif name == "length":
            low, high = args if len(args) == 2 else (0, args[0])
            out.append((f"{f.name} @length", ~F.char_length(c).between(low, high)))
        elif name in ("email", "url"):
            out.append((f"{f.name} @{name}", ~c.rlike(EMAIL if name == "email" else URL)))
        elif name in ("pattern", "regex"):
            out.append((f"{f.name} @{name}", ~c.rlike(args[0])))
    if f.kind == "scalar" and f.target in ("u32", "u64"):
        out.append((f"{f.name} range", ~c.between(*[F.lit(Decimal(x)) for x in RANGES[f.target]])))
    if f.kind == "array":
        out.append((f"{f.name} size", F.size(c) != f.size))
    out = [(rule, F.coalesce(broken, F.lit(False))) for rule, broken in out]
    return out if f.nullable else [*out, (f"{f.name} required", c.isNull())]


def changed(columns: list[str], old: str, new: str) -> Column:
    """Whether any column differs between the structs old and new; equal by <=>, so null equals null and NaN equals NaN."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    return out
