"""A data source over a folder of cached pages: spark.read.format("page_cache").option("folder", ...).load()."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class PageReader(DataSourceReader):
    def __init__(self, folder: str, max_bytes: int, batch: int):
        self.folder, self.max_bytes, self.batch = folder, max_bytes, batch

    def partitions(self):
        names = sorted(str(p) for p in Path(self.folder).glob("*.html"))
        return [Files(names[i : i + self.batch]) for i in range(0, len(names), self.batch)] or [Files([])]

    def read(self, partition):
        for name in partition.names:
            p = Path(name)
            size = p.stat().st_size
            ok = size <= self.max_bytes
            yield p.stem, p.read_bytes().decode("utf-8", "replace") if ok else None, size, "ok" if ok else "too_large"


class PageCache(DataSource):
    """name (sha1 of the url), html, n_bytes, status."""

    @classmethod
    def name(cls):
        return "page_cache"

    def schema(self):
        return "name string, html string, n_bytes long, status string"

    def reader(self, schema):
        return PageReader(self.options["folder"], int(self.options.get("max_bytes", 5 * 1024 * 1024)), int(self.options.get("batch", 500)))


def register(spark) -> None:
    spark.dataSource.register(PageCache)
