"""Lenient parsing. Three policies for a missing, blank, non-numeric or non-finite number: null, a default, and 0.5
after normalisation (see :mod:`tilewright.functions.score`); one helper each, never mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALSE_TRUE = ("1", "true", "yes", "y")


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number_or_null(cell: Column) -> Column:
    return finite(F.trim(cell.cast("string")).try_cast("double"))


def number_or(cell: Column, default: float = 0.0) -> Column:
    return F.coalesce(number_or_null(cell), F.lit(float(default)))


def integer_or(cell: Column, default: int | None = None) -> Column:
    whole = F.trim(cell.cast("string")).try_cast("int")
    return whole if default is None else F.coalesce(whole, F.lit(default))


def truth(cell: Column) -> Column:
    return F.lower(F.trim(cell.cast("string"))).isin(*FALSE_TRUE)


def blank_to_null(cell: Column) -> Column:
    return F.when(F.trim(cell) != "", cell)


def first_filled(*cells: Column) -> Column:
    """The first cell that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in cells])


def json_counts(cell: Column) -> Column:
    """A JSON object as map<string,bigint>; values that aren't whole numbers are dropped."""
    raw = F.from_json(cell, "map<string,string>")
    whole = F.transform_values(raw, lambda _, v: v.try_cast("bigint"))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def json_list(cell: Column, element: str = "string") -> Column:
    """A JSON list; a literal with single quotes or round brackets is read as one."""
    return F.from_json(F.translate(cell, "'()", '"[]'), f"array<{element}>")


def json_cell(value: Column) -> Column:
    return F.to_json(value)


def delta(new: Column, old: Column) -> Column:
    return new - old


def relative_delta(new: Column, old: Column) -> Column:
    """Null where the base is 0 or missing."""
    return F.try_divide(new - old, F.nullif(old, F.lit(0.0)))


def case_id(file_name: Column) -> Column:
    """The first three tokens between hyphens; an error if there are fewer."""
    enough = F.size(F.split(file_name, "-")) >= 3
    return F.when(enough, F.substring_index(file_name, "-", 3)).otherwise(F.raise_error(F.concat(F.lit("no case id in "), file_name)).cast("string"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def shape_product(shape: Column) -> Column:
    """Height times width; 0 with fewer than two dimensions."""
    return F.when(F.size(shape) >= 2, F.get(shape, F.lit(0)) * F.get(shape, F.lit(1))).otherwise(0)


def class_order(label: Column) -> list[Column]:
    """Sort keys: whole numbers by value, then the rest as text."""
    n = label.try_cast("int")
    return [n.isNull(), n, label]
