"""Items of a library over its paged local HTTP API, as a Python data source.

    spark.dataSource.register(LibrarySource)
    spark.read.format("library").option("base", "http://127.0.0.1:23119/api").option("itemType", "attachment").load()

One input partition per page; the number of pages comes from the total that the API states, or from
walking the pages where it states none.  A server that refuses the item type filter (400 or 404) is
asked without it; ``itemType`` then remains a filter of the rows.  Headers such as the API's version and
key are options ``header.NAME``."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.config import DEFAULT, EngineConfig


class LibraryClient:
    def __init__(self, base: str = DEFAULT.api_base, prefix: str = DEFAULT.api_prefix, timeout: float = DEFAULT.http_timeout, headers: dict[str, str] | None = None) -> None:
        self.base, self.prefix, self.timeout, self.headers = base.rstrip("/"), prefix.strip("/"), timeout, dict(headers or {})

    def _open(self, path: str, params: dict | None = None, timeout: float | None = None):
        url = f"{self.base}/{self.prefix}/{path}" + (f"?{urllib.parse.urlencode(params)}" if params else "")
        return urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=timeout or self.timeout)

    def get_json(self, path: str, params: dict | None = None) -> tuple[object, int | None]:
        """The value and the total number of results, if stated; HTTP errors are raised."""
        with self._open(path, params) as r:
            total = r.headers.get("Total-Results")
            return json.loads(r.read()), int(total) if total and total.isdigit() else None

    def item(self, key: str) -> dict:
        return self.get_json(f"items/{urllib.parse.quote(key)}")[0]

    def page(self, start: int, limit: int, item_type: str | None) -> tuple[list, int | None, str | None]:
        params = {"format": "json", "limit": limit, "start": start}
        try:
            value, total = self.get_json("items", params | ({"itemType": item_type} if item_type else {}))
        except urllib.error.HTTPError as e:
            if not item_type or e.code not in (400, 404):
                raise
            value, total = self.get_json("items", params)
            item_type = None
        return (value if isinstance(value, list) else []), total, item_type

    def recent(self, limit: int) -> list:
        value, _ = self.get_json("items", {"format": "json", "limit": limit, "sort": "dateModified", "direction": "desc"})
        return value if isinstance(value, list) else []

    def download(self, key: str, path: str, timeout: float = DEFAULT.download_timeout) -> str:
        """The file of an attachment to a path, complete or not at all."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with self._open(f"items/{urllib.parse.quote(key)}/file", timeout=timeout) as r, open(f"{path}.part", "wb") as f:
            f.write(r.read())
        os.replace(f"{path}.part", path)
        return path


class _Page(InputPartition):
    def __init__(self, start: int, limit: int, item_type: str | None) -> None:
        super().__init__(start)
        self.start, self.limit, self.item_type = start, limit, item_type


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.limit = int(options.get("limit", DEFAULT.api_page_size))
        self.item_type = options.get("itemtype") or options.get("itemType")
        self.client = LibraryClient(options.get("base", DEFAULT.api_base), options.get("prefix", DEFAULT.api_prefix), float(options.get("timeout", DEFAULT.http_timeout)), {k[7:]: v for k, v in options.items() if k.lower().startswith("header.")})

    def partitions(self) -> list[InputPartition]:
        first, total, item_type = self.client.page(0, self.limit, self.item_type)
        if total is not None:
            return [_Page(s, self.limit, item_type) for s in range(0, max(total, 1), self.limit)]
        pages, start, size = [_Page(0, self.limit, item_type)], len(first), len(first)
        while size == self.limit:
            batch, _, _ = self.client.page(start, self.limit, item_type)
            size = len(batch)
            if size:
                pages.append(_Page(start, self.limit, item_type))
            start += size
        return pages

    def read(self, partition: _Page) -> Iterator[tuple]:
        batch, _, _ = self.client.page(partition.start, partition.limit, partition.item_type)
        for i, raw in enumerate(batch):
            if isinstance(raw, dict):
                yield partition.start + i, json.dumps(raw)


class LibrarySource(DataSource):
    """(seq, json): one row per item; ``items.unwrap`` and ``items.dedupe_last`` make records of them."""

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return "seq bigint, json string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def client_of(config: EngineConfig) -> LibraryClient:
    return LibraryClient(config.api_base, config.api_prefix, config.http_timeout, dict(config.api_headers))
