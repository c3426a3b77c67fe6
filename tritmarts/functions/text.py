"""Column-side text: number formats, noun agreement, template filling."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def whole(x: Column) -> Column:
    """Nearest integer as text; ties go to the even neighbour."""
    return F.rint(x.cast("double")).cast("bigint").cast("string")


def tenth(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNotNull(), F.format_string("%.1f", F.bround(x, 1)))


def percent(x: Column) -> Column:
    return F.concat(whole(x * 100), F.lit("%"))


def agree(n: Column, forms: tuple[str, str, str]) -> Column:
    """Noun form for a count: one / few / many."""
    one, few, many = forms
    v = F.abs(F.rint(n.cast("double"))).cast("bigint")
    tail, teens = v % 10, (v % 100).between(11, 14)
    return (F.when(v.isNull() | teens, F.lit(many))
            .when(tail == 1, F.lit(one))
            .when(tail.between(2, 4), F.lit(few))
            .otherwise(F.lit(many)))


def counted(n: Column, forms: tuple[str, str, str]) -> Column:
    return F.concat(whole(n), F.lit(" "), agree(n, forms))


def fill(template: str, parts: Mapping[str, Column]) -> Column:
    """``{name}`` tokens of a template replaced by text columns."""
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            pieces.append(parts[piece])
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def present(*items: Column) -> Column:
    """Array of the non-null items, in the given order."""
    return F.array_compact(F.array(*items))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Small literal dictionary as a map expression; NULL when absent."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), key)
