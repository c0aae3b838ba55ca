"""Registration of queries, and views that Spark and DuckDB read from the same SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None):
    """Register a query under its function's name, which must be new."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


class Views(dict):
    """Named queries in SQL that both engines read; each may use tables and earlier views."""

    def text(self, *names: str, last: str = "") -> str:
        """A WITH clause of views and what they use, and a query over them."""
        need: set[str] = set()
        for name in names:
            self._collect(name, need)
        return "WITH RECURSIVE " + ", ".join(f"{n} AS ({self[n]})" for n in self if n in need) + " " + last

    def _collect(self, name: str, need: set[str]) -> None:
        """What a view needs: earlier views whose names stand in it."""
        need.add(name)
        words, keys = set(re.findall(r"\w+", self[name])), list(self)
        for x in keys[: keys.index(name)]:
            if x in words and x not in need:
                self._collect(x, need)

    def frame(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        sql = self.text(name, last=f"SELECT * FROM {name}").replace("WITH RECURSIVE", "WITH")
        used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
        sql = sql.replace("{", "{{").replace("}", "}}")
        for t in used:
            sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
        return spark.sql(sql, **{t: read(spark, folder, t) for t in used})
