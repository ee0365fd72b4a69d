"""A growing relay file as a streaming source whose offset is the physical line.

Rows carry their line number, for numbers inside the rows may repeat.  An offset is a line count with the
byte where the next line starts, so a restart reads on from there.  A line counts once its end is written; the last,
unfinished one waits.  Tasks read byte ranges that are cut at line borders.

With the option ``cursor`` the offset is also kept in a file, written when a micro-batch has been committed, that is after its
sink has run (of the last one when the next begins, so a job that ends saves that itself); a new query without a checkpoint starts
behind it.  ``limit`` ends a batch after so many lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "line_no long, value string, problem string"
#: bytes that one task reads
CHUNK = 64 << 20
_STEP = 4 << 20


def _place(url: str):
    """(file system, path) of a local path or a URL that Arrow knows."""
    from pyarrow import fs

    if "://" in url:
        return fs.FileSystem.from_uri(url)
    return fs.LocalFileSystem(), url.removeprefix("file:")


def problem_of(line: str) -> str | None:
    """Why a line is no feed row."""
    try:
        row = json.loads(line)
    except json.JSONDecodeError as exc:
        return f"invalid JSON: {exc.msg}"
    except RecursionError:
        return "invalid JSON: nested too deeply"
    return None if isinstance(row, dict) else "feed row must be a JSON object"


class FeedRange(InputPartition):
    """Whole lines: ``lines`` of them, the first of number ``first``, from byte ``begin`` up to ``end``."""

    def __init__(self, first: int, begin: int, end: int) -> None:
        self.first, self.begin, self.end = first, begin, end


class FeedStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.cursor = options["path"], options.get("cursor")
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.chunk = int(options.get("chunk", CHUNK))
        self.begin = self.known = self._kept()

    def _kept(self) -> dict[str, int]:
        from pyarrow import fs

        if self.cursor:
            files, path = _place(self.cursor)
            if files.get_file_info(path).type != fs.FileType.NotFound:
                with files.open_input_stream(path) as file:
                    return json.loads(file.read())
        return {"line": 0, "byte": 0}

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return dict(self.begin)

    def _marks(self, start: dict[str, int], stop: int | None, limit: int | None) -> Iterator[dict[str, int]]:
        """Offsets behind ``start`` after each step over the file, the last one at the last line end."""
        from pyarrow import fs

        files, path = _place(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            return
        size = info.size if stop is None else stop
        if size < start["byte"]:
            raise ValueError(f"{self.path} is shorter than its cursor: {size} < {start['byte']} bytes")
        line, byte = start["line"], start["byte"]
        done = 0
        with files.open_input_file(path) as file:
            at = byte
            while at < size:
                data = file.read_at(min(_STEP, size - at), at)
                if not data:
                    break
                found = data.count(b"\n")
                if limit is not None and done + found >= limit:
                    place = -1
                    for _ in range(limit - done):
                        place = data.index(b"\n", place + 1)
                    yield {"line": line + limit - done, "byte": at + place + 1}
                    return
                if found:
                    line, byte, done = line + found, at + data.rindex(b"\n") + 1, done + found
                    yield {"line": line, "byte": byte}
                at += len(data)

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        last = self.known
        for last in self._marks(self.known, None, self.limit):
            pass
        if self.limit is None:
            self.known = last
        return dict(last)

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[FeedRange]:
        out, here = [], start
        for mark in self._marks(start, end["byte"], None):
            if mark["byte"] - here["byte"] >= self.chunk or mark["byte"] == end["byte"]:
                out.append(FeedRange(here["line"] + 1, here["byte"], mark["byte"]))
                here = mark
        return out

    def read(self, partition: FeedRange) -> Iterator[tuple[int, str, str | None]]:
        files, path = _place(self.path)
        with files.open_input_file(path) as file:
            number, at, rest = partition.first, partition.begin, b""
            while at < partition.end:
                data = file.read_at(min(_STEP, partition.end - at), at)
                at += len(data)
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    text = line.decode("utf-8", "replace")
                    yield number, text, problem_of(text)
                    number += 1

    def commit(self, end: dict[str, int]) -> None:
        self.known = dict(end)
        if self.cursor:
            save_cursor(self.cursor, end)


def save_cursor(url: str, offset: dict[str, int]) -> None:
    """Put the offset in place of the one in the cursor file, whole or not at all."""
    files, path = _place(url)
    with files.open_output_stream(f"{path}.new") as file:
        file.write(json.dumps(offset).encode())
    files.move(f"{path}.new", path)


class FeedLines(DataSource):
    """``spark.readStream.format("feed_lines").load(path)``; options cursor, limit, chunk."""

    @classmethod
    def name(cls) -> str:
        return "feed_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedStream:  # noqa: N802
        return FeedStream(dict(self.options))


def feed_lines(spark: SparkSession, path: str, cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """(line_no, value, problem) of a feed file as a stream; ``problem`` is null where the line is a JSON object."""
    spark.dataSource.register(FeedLines)
    reader = spark.readStream.format("feed_lines")
    for name, value in (("cursor", cursor), ("limit", limit)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(path)
