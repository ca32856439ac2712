"""Named SQL statements with parameter markers, run by Spark."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSAFE = re.compile(r";|--|/\*|\*/")


def checked(sql: str) -> str:
    """The statement, unless it is blank or holds a second statement or a comment."""
    if not sql.strip() or _UNSAFE.search(sql):
        raise ValueError("a single statement without comments is needed")
    return sql.strip()


def acceptable(sql: Column) -> Column:
    """``checked`` as a condition on a column of statements; null is not acceptable."""
    return F.coalesce(~sql.rlike(r"^\s*\z") & ~sql.rlike(_UNSAFE.pattern), F.lit(False))


@dataclass
class StatementCatalog:
    """Statements by ``namespace.id``. Texts use ``:name`` markers, so values are never spliced in; a statement may
    also be a function from parameters to text, for optional conditions."""

    statements: dict[str, str | Callable[[dict], str]] = field(default_factory=dict)

    def add(self, name: str, sql: str | Callable[[dict], str]) -> StatementCatalog:
        self.statements[name] = sql if callable(sql) else checked(sql)
        return self

    def load_xml(self, text: str) -> StatementCatalog:
        """Statements of a set: the root's ``namespace``, and elements with an ``id`` that hold the text."""
        root = ElementTree.fromstring(text)
        space = root.get("namespace") or root.findtext("name") or ""
        for node in root.iter():
            if node.get("id") and (sql := "".join(node.itertext()).strip()):
                self.add(f"{space}.{node.get('id')}" if space else node.get("id"), sql)
        return self

    def add_table(self, namespace: str, table: str, key: str, columns: tuple[str, ...] = ("*",), order: str | None = None, by: tuple[str, ...] = ()) -> StatementCatalog:
        """The usual statements of a table: ``countAll``, ``findById``, ``findPage``, ``exists``, a ``findBy`` for
        each other key, and ``search``, whose conditions are those of the parameters that are given."""
        shown, ordered = ", ".join(columns), f"{order}, {key}" if order else key
        self.add(f"{namespace}.countAll", f"SELECT count(*) AS total FROM {table}")
        self.add(f"{namespace}.findById", f"SELECT {shown} FROM {table} WHERE {key} = :{key}")
        self.add(f"{namespace}.findPage", f"SELECT {shown} FROM {table} ORDER BY {ordered}")
        self.add(f"{namespace}.exists", f"SELECT count(*) > 0 AS found FROM {table} WHERE {key} = :{key}")
        for k in by:
            self.add(f"{namespace}.findBy{k[:1].upper()}{k[1:]}", f"SELECT {shown} FROM {table} WHERE {k} = :{k} ORDER BY {ordered}")

        def search(params: dict) -> str:
            given = [f"{k} = :{k}" for k in (key, *by) if params.get(k) is not None]
            return f"SELECT {shown} FROM {table}" + (" WHERE " + " AND ".join(given) if given else "") + f" ORDER BY {ordered}"

        return self.add(f"{namespace}.search", search)

    def text(self, name: str, params: dict | None = None) -> str:
        if name not in self.statements:
            raise KeyError(f"no statement {name}")
        sql = self.statements[name]
        return checked(sql(params or {})) if callable(sql) else sql

    def run(self, spark: SparkSession, name: str, **params) -> DataFrame:
        """The statement with its parameters bound; only those it names are passed."""
        sql = self.text(name, params)
        return spark.sql(sql, args={k: v for k, v in params.items() if re.search(rf":{k}\b", sql)})

    def page(self, spark: SparkSession, name: str, limit: int, offset: int = 0, **params) -> DataFrame:
        """A page of an ordered statement."""
        df = self.run(spark, name, **params)
        return (df.offset(offset) if offset else df).limit(limit)
