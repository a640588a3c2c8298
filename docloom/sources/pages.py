"""Files of pages as a Python data source: a partition is a range of a file's pages, for batch and stream.

    spark.dataSource.register(PageSource)
    spark.read.format("docloom_pages").option("path", uri).load()

Options: path (a file or a folder, read recursively; a URI that Arrow's file systems know),
extractor ("module:name" of an ``Extractor``; text with form feeds between pages if not
given), maxPages, rangeBytes. A range has about so many bytes of a large file (which is cut into
SLICES at most), and a partition has one of these or several small files; beyond PARTITIONS of
them it has as many as make PARTITIONS even shares of all bytes, since each is a task whose result
the driver holds. Of a file nothing but its size is known to the planner; the task that has a
range counts the pages and reads its own share of them.

A page past maxPages isn't read; a row without a text says so. A file that can't be read, or a
range that fails, is one row with an error. As a stream, files come in the order of their time
of change and path, each once; they are to be put into the folder whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import FAILED, TOO_MANY, decode

SCHEMA = "doc_id string, page int, text string, source_ext string, error string"
DEFAULT = "docloom.sources.pages:FormFeeds"
RANGE_BYTES = 4 << 20
SLICES = 64
PARTITIONS = 2048
READ = 1 << 20


class Extractor:
    """What reads a kind of file; made in each task. file is open for reading bytes and can seek."""

    def count(self, file) -> int:
        raise NotImplementedError

    def pages(self, file, first: int, last: int) -> Iterable[str]:
        """The texts of pages first up to before last, from 0."""
        raise NotImplementedError


class FormFeeds(Extractor):
    """Text whose pages end with a form feed, the last with the file."""

    def count(self, file) -> int:
        n, end = 0, b"\f"
        while block := file.read(READ):
            n, end = n + block.count(b"\f"), block[-1:]
        return n + (end != b"\f")

    def pages(self, file, first: int, last: int) -> Iterator[str]:
        at, held = 0, []
        while at < last:
            block = file.read(READ)
            *whole, rest = block.split(b"\f")
            for part in whole:
                if first <= at < last:
                    yield decode(b"".join([*held, part]))
                at, held = at + 1, []
            if not block:
                if at >= first and held:
                    yield decode(b"".join(held))
                return
            if first <= at < last:  # of pages before the range nothing is held
                held.append(rest)


class Ranges(InputPartition):
    """(path, number of the slice, slices of the file) of what a task reads."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


class _Files:
    def __init__(self, options):
        self.uri = options["path"]
        self.max_pages, self.range_bytes = int(options.get("maxPages", 120)), int(options.get("rangeBytes", RANGE_BYTES))
        self.module, self.attribute = options.get("extractor", DEFAULT).split(":")

    def listed(self) -> list[tuple[int, str, int]]:
        """time of change, path and size of the files; hidden ones and such that begin with _ are left out."""
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri)
        info = system.get_file_info(path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))

    def ranges(self, files: list[tuple[int, str, int]]) -> list[Ranges]:
        """No more than twice PARTITIONS and one; small ranges that follow one another share a partition."""
        share = max(self.range_bytes, -(-sum(max(size, 1) for _, _, size in files) // PARTITIONS))
        out, held, room = [], [], share
        for _, path, size in files:
            n = max(1, min(SLICES, -(-size // self.range_bytes)))
            for k in range(n):
                if held and size / n > room:
                    out.append(Ranges(held))
                    held, room = [], share
                held.append((path, k, n))
                room -= max(size, 1) / n
        return [*out, Ranges(held)] if held else out

    def rows(self, partition: Ranges) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.uri)
        extractor = getattr(import_module(self.module), self.attribute)()
        for path, at, of in partition.parts:
            yield from self._rows(system, extractor, path, at, of)

    def _rows(self, system, extractor: Extractor, path: str, at: int, of: int) -> Iterator[tuple]:
        name = path.rsplit("/", 1)[-1]
        ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
        page = 0
        try:
            with system.open_input_file(path) as file:
                n = extractor.count(file)
                kept = min(n, self.max_pages)
                first, last = kept * at // of, kept * (at + 1) // of
                page = first
                file.seek(0)
                for text in extractor.pages(file, first, last) if first < last else ():
                    page += 1
                    yield path, page, text, ext, None
            if n > kept and at == of - 1:
                yield path, kept + 1, None, ext, TOO_MANY.format(self.max_pages)
        except Exception as e:  # one file's failure is a row
            if page or at == 0:
                yield path, page, None, ext, FAILED.format(e)


class PageReader(_Files, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return self.ranges(self.listed())

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return self.rows(partition)


class PageStream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = self.listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return self.ranges([f for f in self.listed() if low < f[:2] <= high])

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)
