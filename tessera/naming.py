"""Names: fields in camel case, columns and tables in snake case."""

from __future__ import annotations

import re


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def child_table(parent: str, field: str) -> str:
    """Table of an owned field, or of the links of a list of references."""
    return f"{parent}__{snake(field)}"


def key_column(table: str) -> str:
    """Column of a child table that holds its parent's id."""
    return f"{table.rsplit('__', 1)[-1]}_id"
