"""Topic transforms: route, filter, tag, copy, union, concat and friends.

Each is ``DataFrame -> DataFrame`` and works on bounded and streaming input alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predicate = Column | str
_PROGRAMS: dict[str, Callable[..., DataFrame]] = {}


def _column(value: Predicate) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def route(df: DataFrame, rules: Sequence[tuple[str, Predicate]], default: str = "default",
          column: str = "route") -> DataFrame:
    """Name the target topic of each row; the first true rule wins, an unknown one does not match."""
    target = F.lit(default)
    for name, predicate in reversed(list(rules)):
        target = F.when(_column(predicate), F.lit(name)).otherwise(target)
    return df.withColumn(column, target)


def copy_to(df: DataFrame, topics: Sequence[str], column: str = "topic") -> DataFrame:
    """The same rows once per target topic, from a single scan."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(t) for t in topics])))


def keep(df: DataFrame, predicate: Predicate) -> DataFrame:
    return df.where(_column(predicate))


def compute(df: DataFrame, **exprs: Predicate) -> DataFrame:
    """Add or replace columns by expression."""
    return df.withColumns({name: _column(value) for name, value in exprs.items()})


def tag(df: DataFrame, **tags: object) -> DataFrame:
    """Add constant (plain value) or conditional (Column) tags to the original rows."""
    return df.withColumns({name: value if isinstance(value, Column) else F.lit(value)
                           for name, value in tags.items()})


def union_topics(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs, columns matched by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_fields(df: DataFrame, name: str, columns: Sequence[str], sep: str = "") -> DataFrame:
    """Join columns into one string field, skipping nulls."""
    return df.withColumn(name, F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]))


def record_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def search_records(df: DataFrame, keyword: str | None, **equals: object) -> DataFrame:
    """Rows whose JSON text holds the keyword (case-sensitive) and whose fields equal the values."""
    if keyword:
        df = df.where(F.contains(record_json(df), F.lit(keyword)))
    for name, value in equals.items():
        df = df.where(F.col(name) == value)
    return df


def contains_any(columns: Sequence[Column | str], text: str) -> Column:
    """True when any of the columns contains the text literally."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return reduce(lambda a, b: a | b, [F.coalesce(c.contains(text), F.lit(False)) for c in cols])


def not_equal(column: str, value: object) -> Column:
    """Not equal in the document-store sense: a missing value is different from any value."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def keep_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """Conditional delete: only rows whose field equals the value stay."""
    return df.where(F.col(column) == value)


def name_matches(column: str, pattern: str) -> Column:
    return F.col(column).rlike(f"(?i){pattern}")


def explode_parts(df: DataFrame, array: str, part: str = "part", placeholder: str = "_e",
                  with_placeholder: bool = True) -> DataFrame:
    """One row per sub-task; a task without any keeps one placeholder row.

    Parts are texts or records; a placeholder record has the placeholder as its first field and
    nulls elsewhere. A null part of a list that has parts stays null.
    """
    if not with_placeholder:
        return df.withColumn(part, F.explode(array))
    kind = df.schema[array].dataType.elementType
    filler = F.lit(placeholder)
    if isinstance(kind, T.StructType):
        first, *others = kind.fields
        filler = F.struct(filler.cast(first.dataType).alias(first.name),
                          *(F.lit(None).cast(f.dataType).alias(f.name) for f in others))
    parts = F.when(F.size(F.coalesce(F.col(array), F.array().cast(df.schema[array].dataType))) > 0,
                   F.col(array)).otherwise(F.array(filler))
    return df.withColumn(part, F.explode(parts))


def sort_by(df: DataFrame, field: str, ascending: bool = True,
            tiebreak: Sequence[str] = ()) -> DataFrame:
    """Sort by a caller-chosen field.

    The tie-break columns also let the range shuffle split a value that many rows share.
    """
    def towards(c: str) -> Column:
        return F.col(c).asc() if ascending else F.col(c).desc()

    return df.orderBy(towards(field), *[F.col(c).asc() for c in tiebreak])


def sort_as_text(df: DataFrame, field: str, ascending: bool = True,
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Sort by the text form of a field ("10" < "9"); a missing value sorts as empty text."""
    text = F.coalesce(F.col(field).cast("string"), F.lit(""))
    return df.orderBy(text.asc() if ascending else text.desc(),
                      *[F.col(c).asc() for c in tiebreak])


def preview(df: DataFrame, n: int = 20, order: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def register_transform(name: str, program: Callable[..., DataFrame]) -> None:
    """Make a user program ``program(df, **params) -> DataFrame`` callable by name."""
    _PROGRAMS[name] = program


def run_transform(name: str, df: DataFrame, **params: object) -> DataFrame:
    if name not in _PROGRAMS:
        raise KeyError(f"no transform registered as {name!r}")
    return _PROGRAMS[name](df, **params)
