"""JSON paths over text columns through Variant: comparisons hold for the JSON type of their operand alone."""

from __future__ import annotations

import operator
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class JsonPath:
    """One dotted path of a JSON document; text that isn't JSON has no paths."""

    def __init__(self, c: Column, path: str):
        self.doc = F.try_parse_json(c)
        self.at = "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path.split("."))
        self.node = F.try_variant_get(self.doc, self.at, "variant")

    def typed(self, v: Any) -> tuple[Column, Column]:
        """(the node has v's JSON type, the node's value), for booleans and strings."""
        kind, name = F.schema_of_variant(self.node), "BOOLEAN" if isinstance(v, bool) else "STRING"
        return kind == name, F.try_variant_get(self.doc, self.at, name.lower())

    def number(self, v: Any, compare: Callable[[Column, Column], Column]) -> Column:
        """The node is a number that compares so with v. Below 2^53 in size numbers compare as doubles, as which those
        of 15 digits are what they are; from there on as decimals where both have 19 digits before the point and 18
        after it at most, which parses the document more often."""
        kind = F.schema_of_variant(self.node)
        near = compare(F.try_variant_get(self.doc, self.at, "double"), F.lit(float(v)))
        exact = Decimal(repr(v)) if isinstance(v, float) else Decimal(v)
        if exact.is_finite() and (abs(exact) >= 2**53 or len(exact.as_tuple().digits) > 15) and abs(exact) < 10**19 and exact.as_tuple().exponent >= -18:
            own = F.try_variant_get(self.doc, self.at, "decimal(38,18)")
            near = F.when(kind.rlike("^(BIGINT|DECIMAL.*)$") & own.isNotNull(), compare(own, F.lit(format(exact, "f")).cast("decimal(38,18)"))).otherwise(near)
        return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & near

    def equals(self, v: Any) -> Column:
        """A JSON null equals None; a path that is missing equals nothing."""
        if v is None:
            return F.is_variant_null(self.node)
        if is_number(v):
            return self.number(v, operator.eq)
        ok, got = self.typed(v)
        return ok & (got == F.lit(v))


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)
