"""A session store in SQLite, read only, as a Spark data source.

``spark.dataSource.register(SessionStoreSource)``, then ``format("session_store")`` with options ``path`` and
``table``. The file is opened read-only, with query_only set and a busy time-out of 25 ms; extra columns are
left aside, a missing table or column is an error that names it.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.sessions import EXPECTED, schema_problems

_LONGS = {"turn_index", "checkpoint_number"}
BUSY_MS = 25


def open_read_only(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=BUSY_MS / 1000)
    con.execute("PRAGMA query_only = ON")
    return con


def tables_of(path: str) -> dict[str, list[str]]:
    with open_read_only(path) as con:
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        return {n: [r[1] for r in con.execute(f'PRAGMA table_info("{n}")')] for n in names}


def problems(path: str) -> list[tuple[str, str]]:
    return schema_problems(tables_of(path))


class SessionStoreReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        with open_read_only(self.path) as con:
            columns = ", ".join(f'"{c}"' for c in EXPECTED[self.table])
            yield from con.execute(f'SELECT {columns} FROM "{self.table}"')


class SessionStoreSource(DataSource):
    @classmethod
    def name(cls):
        return "session_store"

    def schema(self):
        table = self.options.get("table", "sessions")
        if table not in EXPECTED:
            raise ValueError(f"a session store has no table {table!r}")
        return ", ".join(f"{c} {'long' if c in _LONGS else 'string'}" for c in EXPECTED[table])

    def reader(self, schema):
        path, table = self.options["path"], self.options.get("table", "sessions")
        wrong = [x for x in problems(path) if x[0] == table]
        if wrong:
            raise ValueError(f"session store {path}: missing {', '.join(t if not c else f'{t}.{c}' for t, c in wrong)}")
        return SessionStoreReader(path, table)
