"""A Python data source over any paged listing: pages are asked for by a cursor until one comes back short or empty."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader


def pages(fetch: Callable[[int | None, int], list[dict]], size: int = 1000, most: int | None = None, cursor: int | None = None) -> Iterator[dict]:
    """Records of successive pages; the next cursor is the last record's ``created_utc``."""
    n = 0
    while most is None or n < most:
        page = fetch(cursor, size)
        yield from page
        n += 1
        if len(page) < size:
            return
        cursor = page[-1]["created_utc"]


def paged_source(name_: str, schema_: str, fetch: Callable[[int | None, int], list[dict]], size: int = 1000) -> type[DataSource]:
    """A data source class to be registered with ``spark.dataSource.register``."""
    columns = [c.split()[0] for c in schema_.split(",")]

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.most = int(options["maxPages"]) if "maxPages" in options else None

        def read(self, partition) -> Iterator[tuple]:
            for r in pages(fetch, size, self.most):
                yield tuple(r.get(c) for c in columns)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return schema_

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Source
