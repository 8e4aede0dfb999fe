"""Names and texts inside SQL expressions, for aggregates that are generated from a schema."""

from __future__ import annotations


def name(path: str) -> str:
    """A column path whose parts are separated by NUL, quoted part by part."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in path.split("\x00"))


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(regex: str) -> str:
    """A regular expression as a string literal; backslashes reach the engine as they are."""
    return text(regex)


def struct(**fields: str) -> str:
    """A struct literal with the given SQL expression per field."""
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def rows(structs: list[str]) -> str:
    """One output row per struct."""
    return "inline(array(" + ", ".join(structs) + "))"
