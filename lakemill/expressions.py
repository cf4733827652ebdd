"""Expressions by the names of the relational API; all of them are Spark columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakemill.dialect import spark_type


class Expression:
    """A column with the operators and methods of the relational API."""

    def __init__(self, value: Any) -> None:
        self.column: Column = value.column if isinstance(value, Expression) else value if isinstance(value, Column) else F.lit(value)

    def _two(self, other: Any, op: str, swap: bool = False) -> Expression:
        a, b = self.column, Expression(other).column
        a, b = (b, a) if swap else (a, b)
        return Expression(getattr(a, op)(b))

    __add__ = lambda s, o: s._two(o, "__add__")
    __radd__ = lambda s, o: s._two(o, "__add__", True)
    __sub__ = lambda s, o: s._two(o, "__sub__")
    __rsub__ = lambda s, o: s._two(o, "__sub__", True)
    __mul__ = lambda s, o: s._two(o, "__mul__")
    __rmul__ = lambda s, o: s._two(o, "__mul__", True)
    __truediv__ = lambda s, o: Expression(F.try_divide(s.column, Expression(o).column))
    __rtruediv__ = lambda s, o: Expression(F.try_divide(Expression(o).column, s.column))
    __floordiv__ = lambda s, o: Expression(F.floor(F.try_divide(s.column, Expression(o).column)))
    __mod__ = lambda s, o: Expression(F.try_mod(s.column, Expression(o).column))
    __pow__ = lambda s, o: Expression(F.pow(s.column, Expression(o).column))
    __neg__ = lambda s: Expression(-s.column)
    __and__ = lambda s, o: s._two(o, "__and__")
    __or__ = lambda s, o: s._two(o, "__or__")
    __invert__ = lambda s: Expression(~s.column)
    __eq__ = lambda s, o: s._two(o, "__eq__")
    __ne__ = lambda s, o: s._two(o, "__ne__")
    __lt__ = lambda s, o: s._two(o, "__lt__")
    __le__ = lambda s, o: s._two(o, "__le__")
    __gt__ = lambda s, o: s._two(o, "__gt__")
    __ge__ = lambda s, o: s._two(o, "__ge__")
    __hash__ = None

    def asc(self) -> Expression:
        return Expression(self.column.asc_nulls_last())

    def desc(self) -> Expression:
        return Expression(self.column.desc_nulls_last())

    def nulls_first(self) -> Expression:
        return Expression(self.column.asc_nulls_first())

    def nulls_last(self) -> Expression:
        return Expression(self.column.asc_nulls_last())

    def cast(self, kind: str) -> Expression:
        return Expression(self.column.cast(spark_type(kind)))

    def isin(self, *values: Any) -> Expression:
        return Expression(self.column.isin([Expression(v).column for v in values]))

    def isnotin(self, *values: Any) -> Expression:
        return Expression(~self.isin(*values).column)

    def isnull(self) -> Expression:
        return Expression(self.column.isNull())

    def isnotnull(self) -> Expression:
        return Expression(self.column.isNotNull())

    def between(self, lower: Any, upper: Any) -> Expression:
        return Expression(self.column.between(Expression(lower).column, Expression(upper).column))

    def alias(self, name: str) -> Expression:
        return Expression(self.column.alias(name))


class CaseExpression(Expression):
    """CASE WHEN condition THEN value, with ``when`` and ``otherwise`` to go on."""

    def __init__(self, condition: Any, value: Any) -> None:
        super().__init__(F.when(Expression(condition).column, Expression(value).column))

    def when(self, condition: Any, value: Any) -> CaseExpression:
        self.column = self.column.when(Expression(condition).column, Expression(value).column)
        return self

    def otherwise(self, value: Any) -> Expression:
        return Expression(self.column.otherwise(Expression(value).column))


def ColumnExpression(name: str) -> Expression:  # noqa: N802
    return Expression(F.col(name))


def ConstantExpression(value: Any) -> Expression:  # noqa: N802
    return Expression(F.lit(value))


def StarExpression() -> Expression:  # noqa: N802
    return Expression(F.col("*"))


def DefaultExpression() -> str:  # noqa: N802
    """The default of a column in the values of ``insert``."""
    return "DEFAULT"


def SQLExpression(text: str) -> Expression:  # noqa: N802
    return Expression(F.expr(text))


def FunctionExpression(name: str, *args: Any) -> Expression:  # noqa: N802
    return Expression(F.call_function(name, *(Expression(a).column for a in args)))


def CoalesceOperator(*args: Any) -> Expression:  # noqa: N802
    if not args:
        raise ValueError("coalesce needs an argument")
    return Expression(F.coalesce(*(Expression(a).column for a in args)))


def column_of(x: Any) -> Column:
    """A Spark column from an expression, a column or SQL text."""
    return x.column if isinstance(x, Expression) else x if isinstance(x, Column) else F.expr(x)
