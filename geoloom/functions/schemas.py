"""Schemas of typed text fields: parse and format pairs, kept in column metadata, compiled to one plan.

A schema is an ordered dict of name -> ``Field``.  ``parsed`` turns a table of texts into typed columns
and collects, for every row, all errors of its fields; nothing fails on the way, and no field is read
twice.  ``formatted`` is the way back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeunits import UNITS, convert
from .values import _BOOL, literal_map


@dataclass(frozen=True)
class Field:
    """``parse`` gives null where a text is no value of the field, ``format`` gives the text of a value."""

    kind: str
    parse: Callable[[Column], Column] = field(repr=False)
    format: Callable[[Column], Column] = field(repr=False)
    description: str = ""
    units: str | None = None
    legal: tuple[str, ...] = ()
    required: bool = True
    #: Texts that stand for null, and are no error.
    nulls: tuple[str, ...] = ()

    def optional(self) -> Field:
        """The same field, where a missing text is null and no error."""
        return Field(self.kind, self.parse, self.format, self.description, self.units, self.legal, False, self.nulls)

    @property
    def metadata(self) -> dict:
        return {"field": json.dumps({"kind": self.kind, "description": self.about, "units": self.units, "required": self.required})}

    @property
    def about(self) -> str:
        return f"{self.description}.  Legal values are: {list(self.legal)}" if self.legal else self.description


def _text(v: Column) -> Column:
    return v.cast("string")


def quantity(units: str, description: str = "") -> Field:
    """A number in ``units``; a text with another unit of the same dimension behind it is converted."""
    dimension = UNITS[units][0]
    others = [u for u, (d, _, _) in UNITS.items() if d == dimension]

    def parse(s: Column) -> Column:
        parts = F.split(F.trim(s), r"\s+", 2)
        number, unit = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1))
        out = F.when(unit.isNull() | (unit == units), number)
        for u in others:
            if u != units:
                out = out.when(unit == u, convert(number, u, units))
        return out

    return Field("quantity", parse, _text, description, units)


def integer(description: str = "") -> Field:
    return Field("integer", lambda s: F.trim(s).try_cast("long"), _text, description)


def nullable_integer(description: str = "") -> Field:
    """An integer, or ``.`` for none."""
    return Field("nullable integer", lambda s: F.trim(s).try_cast("long"), lambda v: F.coalesce(_text(v), F.lit(".")), description, required=False, nulls=(".",))


def boolean(description: str = "") -> Field:
    return Field("boolean", lambda s: F.try_element_at(literal_map(_BOOL), F.lower(s)), _text, description)


def enum(legal: list[str], description: str = "") -> Field:
    return Field("enum", lambda s: F.when(s.isin(list(legal)), s), _text, description, legal=tuple(sorted(legal)))


def parsed_enum(parse: Callable[[Column], Column], format: Callable[[Column], Column], legal: list, description: str = "") -> Field:
    """A value of a parse of its own that has to be one of those listed."""

    def known(s: Column) -> Column:
        v = parse(s)
        return F.when(v.isin(list(legal)), v)

    return Field("parsed enum", known, format, description, legal=tuple(map(str, sorted(legal))))


def mapped(values: dict, description: str = "") -> Field:
    """Texts that stand for values; back by the reversed map, which has to be one to one."""
    back = {v: k for k, v in values.items()}
    if len(back) != len(values):
        raise ValueError("two texts stand for one value")
    return Field("mapped", lambda s: F.try_element_at(literal_map(values), s), lambda v: F.try_element_at(literal_map(back), v), description, legal=tuple(sorted(values)))


def custom(parse: Callable[[Column], Column], format: Callable[[Column], Column], description: str = "") -> Field:
    """A parse and a format of its own."""
    return Field("custom", parse, format, description)


def parsed(texts: DataFrame, schema: dict[str, Field], errors: str = "errors") -> DataFrame:
    """The table with the schema's columns parsed, and ``errors``: array<struct<field, text, error>>, empty where all is well.

    A column that the table does not have counts as missing everywhere: null if optional, an error of every
    row if not.  Other columns stay as they are.
    """
    out, found = [], []
    for name, f in schema.items():
        raw = F.col(name).cast("string") if name in texts.columns else F.lit(None).cast("string")
        given = F.when(~raw.isin(list(f.nulls)), raw) if f.nulls else raw
        value = f.parse(given)
        what = F.lit(f"no {f.kind}" + (f", legal are {list(f.legal)}" if f.legal else ""))
        problem = F.when(given.isNotNull() & value.isNull(), what)
        if f.required:
            problem = F.when(raw.isNull(), F.lit("missing")).otherwise(problem)
        out.append(value.alias(name, metadata=f.metadata))
        found.append(F.when(problem.isNotNull(), F.struct(F.lit(name).alias("field"), raw.alias("text"), problem.alias("error"))))
    rest = [c for c in texts.columns if c not in schema]
    return texts.select(*rest, *out, F.array_compact(F.array(*found)).alias(errors))


def split_errors(checked: DataFrame, key: str, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """The rows without an error, and a table (key, field, text, error) of all errors of the others."""
    good = checked.where(F.size(errors) == 0).drop(errors)
    return good, checked.select(key, F.explode(errors).alias("_e")).select(key, "_e.*")


def formatted(values: DataFrame, schema: dict[str, Field]) -> DataFrame:
    """The texts of typed columns; columns outside of the schema stay as they are."""
    return values.select(*[schema[c].format(F.col(c)).alias(c) if c in schema else F.col(c) for c in values.columns])


def field_of(schema: dict[str, Field], name: str) -> Field:
    """The field of a name; KeyError if there is none."""
    return schema[name]


def described(values: DataFrame) -> list[tuple[str, dict]]:
    """Name and description of the columns of a table that were parsed by a schema, from their metadata."""
    return [(f.name, json.loads(f.metadata["field"])) for f in values.schema.fields if "field" in f.metadata]


def in_units(values: DataFrame, name: str, to: str) -> DataFrame:
    """A parsed quantity in another unit, in its column and in its metadata."""
    about = dict(described(values))[name]
    column = convert(F.col(name), about["units"], to).alias(name, metadata={"field": json.dumps({**about, "units": to})})
    return values.select(*[column if c == name else F.col(c) for c in values.columns])
