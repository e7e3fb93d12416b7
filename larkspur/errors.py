"""Errors with SQLSTATE, and what Spark's error conditions mean in them."""

from __future__ import annotations

import re

# Spark's error conditions and the SQLSTATE that the dialect promises for them.
CONDITIONS = {
    "DIVIDE_BY_ZERO": "22012",
    "REMAINDER_BY_ZERO": "22012",
    "ARITHMETIC_OVERFLOW": "22003",
    "BINARY_ARITHMETIC_OVERFLOW": "22003",
    "NUMERIC_VALUE_OUT_OF_RANGE": "22003",
    "CAST_OVERFLOW": "22003",
    "CAST_OVERFLOW_IN_TABLE_INSERT": "22003",
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": "21000",
    "EXCEED_LIMIT_LENGTH": "22001",
    "DATETIME_OVERFLOW": "22008",
    "DATETIME_FIELD_OUT_OF_BOUNDS": "22008",
    "CAST_INVALID_INPUT": "22018",
    "CONVERSION_INVALID_INPUT": "22018",
    "TABLE_OR_VIEW_NOT_FOUND": "42P01",
    "UNRESOLVED_COLUMN": "42703",
    "MISSING_AGGREGATION": "42803",
    "MISSING_GROUP_BY": "42803",
    "GROUP_BY_AGGREGATE": "42803",
}
RAISED = re.compile(r"\[\[([0-9A-Z]{5})\]\] ?([^\n]*)")


class SqlError(Exception):
    """A failed statement: SQLSTATE, message and, for syntax errors, (offset, line, column)."""

    def __init__(self, sqlstate: str, message: str, position: tuple[int, int, int] | None = None):
        if position is not None:
            message += f" (line {position[1]}, column {position[2]})."
        super().__init__(message)
        self.sqlstate, self.message, self.position = sqlstate, message, position


def unsupported(what: str, position=None) -> SqlError:
    return SqlError("0A000", f"Not supported: {what}", position)


def from_spark(error: Exception) -> SqlError:
    """Expressions raise `[[SQLSTATE]] text`; everything else goes by Spark's condition."""
    if isinstance(error, SqlError):
        return error
    text = str(error)
    if m := RAISED.search(text):
        return SqlError(m[1], re.sub(r" *SQLSTATE: \w+$", "", m[2]).strip())
    condition = (getattr(error, "getCondition", lambda: None)() or "").split(".")[0]
    if not condition and (m := re.search(r"\[([A-Z_]+)(?:\.[A-Z_]+)?\]", text)):
        condition = m[1]
    if condition == "CAST_INVALID_INPUT" and re.search(r'to "(DATE|TIMESTAMP)', text):
        return SqlError("22007", text.split("\n")[0])
    return SqlError(CONDITIONS.get(condition, "XX000"), text.split("\n")[0])
