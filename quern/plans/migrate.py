"""Schema changes: what differs between two catalogs, and one hop of data from the old to the new."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, Field, Model


@dataclass(frozen=True)
class Change:
    """kind, and what it is about. breaking: readers or data of the old schema may fail. authored: data needs a transform."""

    kind: str
    model: str
    name: str = ""
    to: str = ""
    breaking: bool = False
    authored: bool = False


def diff(old: Catalog, new: Catalog) -> list[Change]:
    """Changes in name order. One removed and one added field of one type in a model count as a rename, and so do one removed and one added model of the same fields."""
    gone, fresh = sorted(old.models.keys() - new.models.keys()), sorted(new.models.keys() - old.models.keys())
    out = []
    if len(gone) == len(fresh) == 1 and _shape(old.models[gone[0]]) == _shape(new.models[fresh[0]]):
        out.append(Change("rename_model", gone[0], to=fresh[0], breaking=True))
        gone = fresh = []
    out += [Change("add_model", n) for n in fresh]
    out += [Change("drop_model", n, breaking=True) for n in gone]
    for kind, a, b in (("enum", old.enums, new.enums), ("struct", old.structs, new.structs)):
        out += [Change(f"add_{kind}", n) for n in sorted(b.keys() - a.keys())]
        out += [Change(f"drop_{kind}", n, breaking=True) for n in sorted(a.keys() - b.keys())]
        for n in sorted(a.keys() & b.keys()):
            if a[n] != b[n]:
                grown = kind == "enum" and b[n][: len(a[n])] == a[n]
                out.append(Change(f"change_{kind}", n, breaking=not grown, authored=not grown))
    for n in sorted(old.models.keys() & new.models.keys()):
        out += _fields(old.models[n], new.models[n])
    return out


def _shape(m: Model) -> list:
    return [(f.name, *_kind(f)) for f in m.fields]


def default_of(f: Field):
    """The value of a field's @default, or None."""
    return next((args[0] for name, args in f.constraints if name == "default" and args), None)


def _fields(old: Model, new: Model) -> list[Change]:
    a, b = ({f.name: f for f in m.fields if f.stored} for m in (old, new))
    gone, fresh = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())
    out = []
    if len(gone) == len(fresh) == 1 and _kind(a[gone[0]]) == _kind(b[fresh[0]]):
        out.append(Change("rename_field", old.name, gone[0], fresh[0], breaking=True))
        gone, fresh = [], []
    out += [Change("drop_field", old.name, n, breaking=True) for n in gone]
    for n in fresh:
        empty = not b[n].nullable and default_of(b[n]) is None
        out.append(Change("add_field", old.name, n, breaking=empty, authored=empty and not b[n].auto))
    for n in sorted(a.keys() & b.keys()):
        x, y = a[n], b[n]
        if (x.kind, x.target, x.size) != (y.kind, y.target, y.size):
            out.append(Change("change_type", old.name, n, breaking=True, authored=True))
        if x.nullable != y.nullable:
            out.append(Change("make_nullable" if y.nullable else "make_required", old.name, n, breaking=not y.nullable, authored=not y.nullable))
        if x.unique != y.unique:
            out.append(Change("add_unique" if y.unique else "drop_unique", old.name, n, breaking=y.unique))
        if x.indexed != y.indexed:
            out.append(Change("add_index" if y.indexed else "drop_index", old.name, n))
        for kind, some in (("drop", set(x.constraints) - set(y.constraints)), ("add", set(y.constraints) - set(x.constraints))):
            out += [Change(f"{kind}_constraint", old.name, n, _words(c)) for c in sorted(some, key=str)]
    for kind, some in (("drop", set(old.indexes) - set(new.indexes)), ("add", set(new.indexes) - set(old.indexes))):
        out += [Change(f"{kind}_composite_index", old.name, ", ".join(i)) for i in sorted(some)]
    if set(old.projections.items()) != set(new.projections.items()):
        out.append(Change("change_projection", old.name))
    return out


def _words(constraint: tuple[str, tuple]) -> str:
    """A constraint as it is declared."""
    name, args = constraint
    return f"@{name}" + (f"({', '.join(map(str, args))})" if args else "")


def _kind(f: Field) -> tuple:
    return f.kind, f.target, f.size, f.nullable


def hop(log: DataFrame, old: Catalog, new: Catalog, model: str, defaults: dict | None = None, authored: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A model's log under the new catalog: renames, drops, added fields with their default, then the authored transform.

    model is its new name; a model that was renamed as a whole keeps its rows. A change that needs an authored transform, or a default for a required field, is an error without one.
    """
    was = next((c.model for c in diff(old, new) if c.kind == "rename_model" and c.to == model), model)
    defaults = {f.name: v for f in new.models[model].fields if (v := default_of(f)) is not None} | (defaults or {})
    changes = _fields(old.models[was], new.models[model])
    for c in changes:
        if c.authored and not authored and c.name not in defaults:
            raise ValueError(f"{c.kind} {model}.{c.name} needs a default or an authored transform")
    schema = new.schema(model)
    for c in changes:
        if c.kind == "rename_field":
            log = log.withColumnRenamed(c.name, c.to)
    log = log.drop(*[c.name for c in changes if c.kind == "drop_field"])
    for c in changes:
        if c.kind == "add_field":
            log = log.withColumn(c.name, F.lit(defaults.get(c.name)).cast(schema[c.name].dataType))
        elif c.kind == "make_required" and c.name in defaults:
            log = log.withColumn(c.name, F.coalesce(c.name, F.lit(defaults[c.name])).cast(schema[c.name].dataType))
    if authored:
        log = authored(log)
    system = [c for c in log.columns if c.startswith("_")]
    return log.select(*system, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
