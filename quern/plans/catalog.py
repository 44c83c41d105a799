"""Models, their fields, relations and indexes, and the Spark types they stand for."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Scalar type -> Spark type. u32 needs a long and u64 a decimal, as Spark has no unsigned integers; timestamps are seconds.
SCALARS: dict[str, T.DataType] = {
    "u32": T.LongType(), "u64": T.DecimalType(20, 0), "i32": T.IntegerType(), "i64": T.LongType(), "f64": T.DoubleType(),
    "bool": T.BooleanType(), "string": T.StringType(), "uuid": T.StringType(), "timestamp": T.LongType(), "json": T.StringType(),
    "decimal": T.DecimalType(38, 9),
}
VARIABLE = {"string", "json"}
AUTO = {"u32", "u64", "uuid", "timestamp"}
RANGED = {"u32", "u64", "i32", "i64", "timestamp", "decimal"}
ON_DELETE = {"restrict", "cascade", "set_null"}


class SchemaError(ValueError):
    """A schema that breaks a rule; args[1:] are all the messages."""


@dataclass(frozen=True)
class Field:
    """kind: scalar, enum, struct, char, array, one (foreign key) or many (a list of another model, which has no column).

    target is the scalar's, enum's, struct's, element's or model's name; size that of char(N) and [T; N].
    """

    name: str
    kind: str
    target: str
    nullable: bool = False
    size: int | None = None
    auto: bool = False
    unique: bool = False
    indexed: bool = False
    constraints: tuple[tuple[str, tuple], ...] = ()
    on_delete: str = "restrict"

    @property
    def stored(self) -> bool:
        return self.kind != "many"

    @property
    def filterable(self) -> bool:
        return self.kind in ("enum", "char") or (self.kind == "scalar" and self.target != "json")

    @property
    def probed(self) -> bool:
        """Whether find_by takes it: indexed, unique, or a foreign key."""
        return self.indexed or self.unique or self.kind == "one"

    @property
    def ranged(self) -> bool:
        """Whether ordered ranges take it."""
        return self.indexed and self.kind == "scalar" and self.target in RANGED and not self.nullable


@dataclass(frozen=True)
class Model:
    name: str
    fields: tuple[Field, ...]
    indexes: tuple[tuple[str, ...], ...] = ()
    projections: dict[str, tuple[str, ...]] = field(default_factory=dict)
    soft_delete: bool = False

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"{self.name} has no field {name}")

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    @property
    def id(self) -> str:
        return "id" if "id" in self else self.fields[0].name

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields if f.stored]

    def projected(self, name: str) -> list[str]:
        """The columns of a named projection: the id, then the named fields in declaration order."""
        if name not in self.projections:
            raise SchemaError(f"{self.name} has no projection {name}")
        chosen = self.projections[name]
        return [self.id, *[c for c in self.columns if c in chosen and c != self.id]]


@dataclass(frozen=True)
class Relation:
    """kind is required, optional (child holds the key) or many_to_many (left and right in name order, through a junction)."""

    kind: str
    left: str
    field: str
    right: str
    back: str | None = None


@dataclass(frozen=True)
class Catalog:
    models: dict[str, Model]
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    structs: dict[str, tuple[Field, ...]] = field(default_factory=dict)

    def spark_type(self, f: Field) -> T.DataType:
        if f.kind == "scalar":
            return SCALARS[f.target]
        if f.kind == "struct":
            return T.StructType([T.StructField(x.name, self.spark_type(x), x.nullable) for x in self.structs[f.target]])
        if f.kind == "one":
            key = self.models[f.target]
            return self.spark_type(key[key.id]) if key[key.id].kind != "one" else T.StringType()
        if f.kind == "array":
            of = T.StringType() if f.target.startswith("char(") else SCALARS[f.target] if f.target in SCALARS else self.spark_type(Field(f.name, "struct", f.target))
            return T.ArrayType(of, False)
        return T.StringType()

    def schema(self, model: str) -> T.StructType:
        return T.StructType([T.StructField(f.name, self.spark_type(f), f.nullable) for f in self.models[model].fields if f.stored])

    def relations(self) -> list[Relation]:
        """Foreign keys, and lists on both sides of two models without a key between them."""
        out, keyed = [], set()
        for m in self.models.values():
            for f in m.fields:
                if f.kind == "one":
                    out.append(Relation("optional" if f.nullable else "required", m.name, f.name, f.target))
                    keyed.add(frozenset((m.name, f.target)))
        lists = {(m.name, f.target): f.name for m in self.models.values() for f in m.fields if f.kind == "many"}
        for (left, right), name in sorted(lists.items()):
            if left < right and (right, left) in lists and frozenset((left, right)) not in keyed:
                out.append(Relation("many_to_many", left, name, right, lists[right, left]))
        return out

    def children(self, parent: str) -> list[tuple[Model, Field]]:
        """The models and foreign keys that point at parent."""
        return [(m, f) for m in self.models.values() for f in m.fields if f.kind == "one" and f.target == parent]

    def check(self) -> Catalog:
        """The catalog itself, or a SchemaError with every broken rule."""
        errors: list[str] = []
        twice = lambda names, what: errors.extend(f"duplicate {what} {n}" for n, k in Counter(names).items() if k > 1)
        twice([*self.models, *self.enums, *self.structs], "declaration")
        pascal, snake = re.compile(r"[A-Z][A-Za-z0-9]*"), re.compile(r"[a-z][a-z0-9_]*")
        for name in [*self.models, *self.enums, *self.structs]:
            if not pascal.fullmatch(name):
                errors.append(f"{name} is not PascalCase")
        for name, variants in self.enums.items():
            twice(variants, f"variant of {name}")
            errors.extend(f"{name}.{v} is not PascalCase" for v in variants if not pascal.fullmatch(v))
        for name, fields in self.structs.items():
            twice([f.name for f in fields], f"field of {name}")
            errors.extend(f"{name}.{f.name} has no fixed size" for f in fields if f.kind in ("one", "many") or (f.kind == "scalar" and f.target in VARIABLE))
        for m in self.models.values():
            twice([f.name for f in m.fields], f"field of {m.name}")
            for f in m.fields:
                if not snake.fullmatch(f.name):
                    errors.append(f"{m.name}.{f.name} is not snake_case")
                if f.kind in ("one", "many") and f.target not in self.models:
                    errors.append(f"{m.name}.{f.name}: no model {f.target}")
                if f.kind == "struct" and f.target not in self.structs or f.kind == "enum" and f.target not in self.enums:
                    errors.append(f"{m.name}.{f.name}: no struct or enum {f.target}")
                if f.auto and not (f.kind == "scalar" and f.target in AUTO):
                    errors.append(f"{m.name}.{f.name}: + is not for {f.target}")
                if f.on_delete == "set_null" and not (f.kind == "one" and f.nullable):
                    errors.append(f"{m.name}.{f.name}: set_null needs an optional relation")
            for index in m.indexes:
                errors.extend(f"{m.name}: index on unknown field {c}" for c in index if c not in m)
                if len(index) < 2:
                    errors.append(f"{m.name}: a composite index needs two fields")
            for name, columns in m.projections.items():
                errors.extend(f"{m.name}: projection {name} of unknown field {c}" for c in columns if c not in m)
                errors.extend(f"{m.name}: {c} is not projectable" for c in columns if c in m and m[c].kind in ("one", "many"))
        if errors:
            raise SchemaError(errors[0], *errors[1:])
        return self
