"""Rule tables as constants of a plan.

A table of a few dozen rows is one array (or map) literal that an expression
looks rows up in, so the plan holds the rule's logic once, however many rows
there are. The literal is handed over as one piece of SQL text: building it
field by field costs a call to the JVM for every cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value) -> str:
    """SQL of a string, whole number, list (array) or dict (named struct)."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {sql_text(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(sql_text, value)) + ")"
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    raise TypeError(type(value))


def constant(value) -> Column:
    return F.expr(sql_text(value))


def constant_map(items: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in items.items()) + ")")
