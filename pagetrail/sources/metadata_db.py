"""Page and link tables in an SQLite file, for exchange with other tools."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: the version the file states.
VERSION = 1
_TABLES = {"pages": ("page_id", "title"), "links": ("from_page_id", "to_page_id", "title")}
_SCHEMAS = {"pages": "page_id bigint, title string", "links": "from_page_id bigint, to_page_id bigint, title string"}


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int):
        self.path, self.table, self.parts = path, table, parts

    def _connect(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        key = _TABLES[self.table][0]
        with self._connect() as db:
            if db.execute("PRAGMA user_version").fetchone()[0] != VERSION:
                raise ValueError(f"{self.path} has another version")
            low, high = db.execute(f"SELECT min({key}), max({key}) FROM {self.table}").fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((a, a + step)) for a in range(low, high + 1, step)]

    def read(self, part):
        columns = _TABLES[self.table]
        with self._connect() as db:
            yield from db.execute(f"SELECT {', '.join(columns)} FROM {self.table} WHERE {columns[0]} >= ? AND {columns[0]} < ?", part.value)


class MetadataDb(DataSource):
    """``spark.read.format("pagetrail-metadata").option("table", "pages").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "pagetrail-metadata"

    def schema(self) -> str:
        return _SCHEMAS[self.options["table"]]

    def reader(self, schema):
        return _Reader(self.options["path"].removeprefix("file:"), self.options["table"], int(self.options.get("partitions", "8")))


def read_metadata(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(MetadataDb)
    return spark.read.format(MetadataDb.name()).option("table", table).load(path)


def write_metadata(pages: DataFrame, links: DataFrame, path: str) -> None:
    """Write both tables in one transaction; rows pass the driver one partition at a time."""
    if os.path.exists(path):
        raise FileExistsError(path)
    db = sqlite3.connect(path)
    db.execute("PRAGMA journal_mode = OFF")
    with db:
        db.execute("CREATE TABLE pages (page_id INTEGER PRIMARY KEY NOT NULL, title TEXT NOT NULL UNIQUE)")
        db.execute("CREATE TABLE links (from_page_id INTEGER NOT NULL, to_page_id INTEGER NOT NULL, title TEXT, PRIMARY KEY (from_page_id, to_page_id)) WITHOUT ROWID")
        db.execute(f"PRAGMA user_version = {VERSION}")
        db.executemany("INSERT INTO pages VALUES (?, ?)", map(tuple, pages.select(*_TABLES["pages"]).toLocalIterator()))
        db.executemany("INSERT INTO links VALUES (?, ?, ?)", map(tuple, links.select(*_TABLES["links"]).toLocalIterator()))
    db.execute("VACUUM")
    db.close()
