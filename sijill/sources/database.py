"""Database tables as a Spark data source over any DB-API connection, with filters, patterns and column choices pushed down.

``connect`` is a provider: it makes a connection on whichever machine reads. Spark's filters on plain columns become a WHERE clause
with parameters; those on text are also evaluated again by Spark, as databases compare text by rules of their own. Columns, and
patterns that ignore case, are said as options, since the interface knows neither. A numeric key cuts the table into ranges, one a
task. Filters are pushed where ``spark.sql.python.filterPushdown.enabled`` is set, which ``scan`` does for its session.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from sijill.session import ship

_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass(frozen=True)
class Table:
    """A table: ``schema`` names its columns; ``key`` is a numeric column that ``parts`` ranges are cut by; ``mark`` stands for a parameter."""

    connect: Callable
    name: str
    schema: str
    key: str | None = None
    parts: int = 1
    mark: str = "?"


@dataclass
class Range(InputPartition):
    low: int | None
    high: int | None
    rest: bool = False

    def __post_init__(self):
        super().__init__((self.low, self.high))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _pattern(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def condition(f: Filter, mark: str = "?") -> tuple[str, list] | None:
    """SQL and parameters of a filter on a plain column; None if it can't be said."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = quoted(f.attribute[0])
    if isinstance(f, IsNull):
        return f"{column} IS NULL", []
    if isinstance(f, IsNotNull):
        return f"{column} IS NOT NULL", []
    if isinstance(f, In):
        some = [v for v in f.value if v is not None]
        return (f"{column} IN ({', '.join([mark] * len(some))})", some) if some else None
    if isinstance(f, EqualNullSafe):
        return (f"{column} IS NULL", []) if f.value is None else (f"{column} = {mark}", [f.value])
    if isinstance(f, (StringStartsWith, StringContains, StringEndsWith)):
        head, tail = ("" if isinstance(f, StringStartsWith) else "%"), ("" if isinstance(f, StringEndsWith) else "%")
        return f"{column} LIKE {mark} ESCAPE '\\'", [head + _pattern(f.value) + tail]
    sign = _SIGNS.get(type(f))
    return (f"{column} {sign} {mark}", [f.value]) if sign and isinstance(f.value, (bool, int, float, str)) else None


def _exact(f: Filter) -> bool:
    """Whether a database answers the filter as Spark does: numbers and nulls, not text."""
    values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
    return not any(isinstance(v, str) for v in values)


class Reader(DataSourceReader):
    def __init__(self, table: Table, schema: StructType, like: dict[str, str]):
        self.table, self.columns = table, [f.name for f in schema.fields]
        self.where = [(f"lower({quoted(c)}) LIKE lower({table.mark}) ESCAPE '\\'", [v]) for c, v in sorted(like.items())]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            said = condition(f, self.table.mark)
            if said:
                self.where.append(said)
            if not said or not _exact(f):
                yield f

    def _rows(self, columns: str, more: list[tuple[str, list]]) -> Iterator[tuple]:
        said = [*self.where, *more]
        sql = f"SELECT {columns} FROM {quoted(self.table.name)}" + (" WHERE " + " AND ".join(f"({s})" for s, _ in said) if said else "")
        connection = self.table.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(sql, [v for _, values in said for v in values])
            while rows := cursor.fetchmany(1000):
                yield from map(tuple, rows)
        finally:
            connection.close()

    def partitions(self) -> list[InputPartition]:
        t = self.table
        if not t.key or t.parts < 2:
            return [Range(None, None)]
        ((low, high),) = self._rows(f"min({quoted(t.key)}), max({quoted(t.key)})", [])
        if low is None:
            return [Range(None, None)]
        edges = [low + (high + 1 - low) * i // t.parts for i in range(t.parts + 1)]
        return [Range(a, b, i == 0) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b or i == 0]

    def read(self, partition: Range) -> Iterator[tuple]:
        more, key, mark = [], quoted(self.table.key or ""), self.table.mark
        if partition.low is not None:
            inside = f"{key} >= {mark} AND {key} < {mark}"
            more = [(f"({inside}) OR {key} IS NULL" if partition.rest else inside, [partition.low, partition.high])]
        yield from self._rows(", ".join(map(quoted, self.columns)), more)


def source(name: str, table: Table) -> type[DataSource]:
    """A data source class over ``table``; register it with ``spark.dataSource.register``, or let ``scan`` do it."""
    whole = StructType.fromDDL(table.schema)  # needs the session, which the class hasn't got

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            chosen = json.loads(self.options.get("columns", "null"))
            return whole if chosen is None else StructType([whole[c] for c in chosen])

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(table, schema, json.loads(self.options.get("like", "{}")))

    return Source


def scan(spark: SparkSession, name: str, table: Table, columns: list[str] | None = None, like: dict[str, str] | None = None) -> DataFrame:
    """The table's ``columns`` (all, if none are named), of rows that match ``like`` (column to pattern, ignoring case), and what filters leave."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source(name, table))
    return spark.read.format(name).option("columns", json.dumps(columns)).option("like", json.dumps(like or {})).load()
