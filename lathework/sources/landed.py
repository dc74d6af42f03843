"""The contract of a source, as a data source of Spark: landed pages to list rows, in a batch or as a stream.

    spark.dataSource.register(LandedPages)
    spark.read.format("landed_pages").option("path", folder).option("sources", "a,b").option("most", 300).load()

A folder holds `<source>/<page>.html`, pages numbered from 1. A partition is some pages of a source, so pages are opened
where there is room; the order of `sources` is their priority. Options bound what is read at the source: `pages`, the pages
of each source, and `most`, the rows of each source in page order (for its sake a source is one partition, read until
it is full; a source of one run is a bounded number of pages). What goes wrong with a page is a row with a `note`, not a
lost job, and a source without a row has one as well: `0 rows`.

As a stream an offset is the number of the last landed page of each source. A batch is the pages behind the last offset, and
a page is read again if a batch is repeated. Pages have to land whole (written elsewhere and renamed) and in order.

The folder is opened by pyarrow's file systems, so a mounted path or any address these know will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed value: what is read of a link that is no list row.
SCHEMA = "source string, priority int, page int, position int, id string, title string, url string, note string"
#: Pages of one source in a partition, if no limit of rows asks for all of them in order.
PAGES = 8


@dataclass
class Pages(InputPartition):
    source: str
    priority: int
    numbers: tuple[int, ...]


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match("[a-z][a-z0-9+.-]*://", path) else (fs.LocalFileSystem(), path)


def _landed(path: str, sources: list[str]) -> dict[str, list[int]]:
    """The numbers of the landed pages of each source, in order."""
    from pyarrow import fs

    system, folder = _opened(path)
    out: dict[str, list[int]] = {}
    for source in sources:
        found = system.get_file_info(fs.FileSelector(f"{folder}/{source}", allow_not_found=True))
        out[source] = sorted(int(m[1]) for f in found if (m := re.fullmatch(r"(\d+)\.html", f.base_name)))
    return out


class _Lists:
    """What a batch and a stream have in common: options, and the rows of a partition."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.sources = [s.strip() for s in options["sources"].split(",") if s.strip()]
        self.pages = int(options.get("pages", 1 << 30))
        self.most = int(options["most"]) if "most" in options else None
        self.pattern = options.get("links", ".")

    def rows(self, part: Pages) -> Iterator[tuple]:
        from lathework.sources.lists import page_lists

        system, folder = _opened(self.path)
        given, noted, seen = 0, False, set()
        for number in part.numbers:
            head = (part.source, part.priority, number)
            try:
                with system.open_input_stream(f"{folder}/{part.source}/{number}.html") as f:
                    links = page_lists(f.read().decode())[1]
            except (OSError, UnicodeDecodeError) as e:
                noted = True
                yield (*head, None, None, None, None, f"{type(e).__name__}: {e}"[:200])
                continue
            for position, link in enumerate(links):
                url = link["href"] or ""
                if not link["text"] or not (m := re.search(self.pattern, url)) or url in seen:
                    continue
                if given == self.most:
                    return
                seen.add(url)
                given += 1
                yield (*head, position, m[1] if m.groups() else url, link["text"], url, None)
        if not given and not noted:
            yield (part.source, part.priority, None, None, None, None, None, "0 rows")

    def parts(self, landed: dict[str, list[int]]) -> list[Pages]:
        out = []
        for priority, source in enumerate(self.sources):
            numbers = landed[source][: self.pages]
            size = len(numbers) if self.most is not None else PAGES
            out += [Pages(source, priority, tuple(numbers[k : k + size])) for k in range(0, len(numbers), size)] if numbers else [Pages(source, priority, ())]
        return out


class _Reader(DataSourceReader):
    def __init__(self, lists: _Lists) -> None:
        self.lists = lists

    def partitions(self) -> list[Pages]:
        return self.lists.parts(_landed(self.lists.path, self.lists.sources))

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.lists.rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, lists: _Lists) -> None:
        self.lists = lists

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.lists.sources, 0)

    def latestOffset(self) -> dict:
        return {s: n[-1] if n else 0 for s, n in _landed(self.lists.path, self.lists.sources).items()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        landed = _landed(self.lists.path, self.lists.sources)
        new = {s: [n for n in numbers if start.get(s, 0) < n <= end.get(s, 0)] for s, numbers in landed.items()}
        return [p for p in self.lists.parts(new) if p.numbers]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.lists.rows(partition)

    def commit(self, end: dict) -> None:
        """Landed pages stay where they are."""


class LandedPages(DataSource):
    """List rows of landed pages. Options: path, sources, pages, most, and `links`, the pattern of a row's address, whose first group is its id."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Lists(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Lists(self.options))
