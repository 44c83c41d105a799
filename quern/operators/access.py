"""Reads of one model: lookups, probes, ordered ranges, filtered and sorted lists, projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import matching, ordinal
from ..plans.catalog import VARIABLE, Catalog, SchemaError
from . import views

DEFAULT_LIMIT, MAX_LIMIT = 50, 1000


@dataclass(frozen=True)
class Page:
    """limit and offset of a list, and their neighbours."""

    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def has_next(self, total: int) -> bool:
        return self.offset + self.limit < total

    def next_page(self) -> Page:
        return Page(self.limit, self.offset + self.limit)

    def prev_page(self) -> Page:
        return Page(self.limit, max(0, self.offset - self.limit))


def page_of(params: dict[str, str], default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> Page:
    """limit and offset of query parameters; what is no unsigned number counts as absent, the limit is put within 1 and most."""
    number = lambda k, d: int(params[k]) if params.get(k, "").lstrip("+").isascii() and params.get(k, "").removeprefix("+").isdigit() else d
    return Page(max(1, min(most, number("limit", default))), number("offset", 0))


def descending(params: dict[str, str]) -> bool:
    return params.get("order", "").lower() in ("desc", "descending")


class Table:
    """Reads of a model's log. watermark None is the live view; a number is the snapshot of so many physical rows.

    Every method gives a lazy DataFrame of the model's columns, so Catalyst prunes and pushes down what follows.
    default_limit and max_limit are the pages' knobs.
    """

    def __init__(self, catalog: Catalog, model: str, log: DataFrame, watermark: int | None = None, default_limit: int = DEFAULT_LIMIT, max_limit: int = MAX_LIMIT):
        self.catalog, self.name, self.model, self.log, self.watermark = catalog, model, catalog.models[model], log, watermark
        self.default_limit, self.max_limit = default_limit, max_limit

    def at(self, watermark: int | None) -> Table:
        return Table(self.catalog, self.name, self.log, watermark, self.default_limit, self.max_limit)

    def rows(self, columns: list[str] | None = None) -> DataFrame:
        """With _seq. Where columns are ids and _seq alone the wide rows aren't read."""
        keys = [self.model.id]
        return views.live(self.log, keys, columns) if self.watermark is None else views.as_of(self.log, keys, self.watermark, columns)

    def all(self) -> DataFrame:
        return self.rows().select(*self.model.columns)

    def page(self, params: dict[str, str]) -> Page:
        return page_of(params, self.default_limit, self.max_limit)

    def scan(self, columns: list[str], params: dict[str, str] | None = None) -> DataFrame:
        """Narrow scan in physical order, filtered: the columns, those filtered by, id and _seq are what is read."""
        used = [*columns, *(params or {})]
        return self.rows(used).filter(matching(self.catalog, self.name, params or {})).orderBy(views.SEQ).select(*columns)

    def get(self, key) -> DataFrame:
        """An id's versions alone are read: the filter on the id goes below the join and the aggregation."""
        return self.all().filter(F.col(self.model.id) == F.lit(key))

    def find_by(self, **values) -> DataFrame:
        """Equality on one probed field, or on all fields of a composite index; None finds nulls."""
        names = tuple(values)
        if not (len(names) == 1 and self.model[names[0]].probed) and not any(sorted(names) == sorted(i) for i in self.model.indexes):
            raise SchemaError(f"{self.name} has no index on {', '.join(names)}")
        out = self.all()
        for name, value in values.items():
            if self.model[name].kind == "scalar" and isinstance(value, float) and value != value:
                return out.filter(F.lit(False))
            out = out.filter(F.col(name).eqNullSafe(F.lit(value)))
        return out

    def get_by(self, **value) -> DataFrame:
        """The row with this value of a unique field."""
        (name,) = value
        if not self.model[name].unique:
            raise SchemaError(f"{self.name}.{name} is not unique")
        return self.find_by(**value)

    def range(self, field: str, low=None, high=None, descending: bool = False, limit: int | None = None) -> DataFrame:
        """Rows with low <= field <= high in order; rows of one value come by id, ascending in both directions."""
        if not self.model[field].ranged:
            raise SchemaError(f"{self.name}.{field} takes no ranges")
        out, c = self.all(), F.col(field)
        if low is not None:
            out = out.filter(c >= F.lit(low))
        if high is not None:
            out = out.filter(c <= F.lit(high))
        out = out.orderBy(c.desc() if descending else c.asc(), F.col(self.model.id).asc())
        return out if limit is None else out.limit(limit)

    def filtered(self, params: dict[str, str]) -> DataFrame:
        return self.rows().filter(matching(self.catalog, self.name, params))

    def list(self, params: dict[str, str], projection: str | None = None) -> DataFrame:
        """One page: filter, sort, offset and limit, then the projection.

        Ties keep scan order when ascending and reverse it when descending. An unknown sort field leaves scan order.
        """
        page, down = self.page(params), descending(params)
        seq = F.col(views.SEQ)
        name = params.get("sort", "")
        if name in self.model and self.model[name].filterable:
            key = ordinal(self.catalog, self.model[name])
            order = [key.desc_nulls_last(), seq.desc()] if down else [key.asc_nulls_first(), seq.asc()]
        else:
            order = [seq.asc()]
        out = self.filtered(params).orderBy(*order).offset(page.offset).limit(page.limit)
        return out.select(*(self.model.projected(projection) if projection else self.model.columns))

    def total(self, params: dict[str, str]) -> DataFrame:
        """(total): rows that the filter leaves, before paging."""
        used = [f.name for f in self.model.fields if f.name in params]
        return self.rows(used).filter(matching(self.catalog, self.name, params)).agg(F.count("*").alias("total"))

    def envelope(self, params: dict[str, str], projection: str | None = None) -> dict:
        """The page as the list's wire form; at most max_limit rows come to the driver."""
        page = self.page(params)
        return {"data": [r.asDict(True) for r in self.list(params, projection).collect()], "total": self.total(params).first()["total"], "limit": page.limit, "offset": page.offset}

    def project(self, name: str) -> DataFrame:
        columns = self.model.projected(name)
        return self.rows(columns).select(*columns)

    def get_projected(self, name: str, key) -> DataFrame:
        """A projected point read is of the live view, whatever the watermark; projected lists keep to it."""
        return self.at(None).project(name).filter(F.col(self.model.id) == F.lit(key))

    def physical_rows(self) -> DataFrame:
        return self.log.agg(F.count("*").alias("row_count"))

    def live_rows(self) -> DataFrame:
        return self.rows([self.model.id]).agg(F.count("*").alias("count"))

    def export_column(self, name: str) -> DataFrame:
        """A non-null fixed-width column of the live rows, in physical order: to write as Arrow or Parquet, or to collect by toArrow() where it is small."""
        f = self.model[name]
        if f.nullable or f.kind not in ("scalar", "enum") or f.target in VARIABLE:
            raise SchemaError(f"{self.name}.{name} is not of fixed width and non-null")
        return self.rows([name]).orderBy(views.SEQ).select(name)
