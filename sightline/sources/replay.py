"""Recorded frames as a stream: spark.readStream.format("replay") serves the images of a folder by name, one a tick, and holds the last.

spark.dataSource.register(Replay) makes the format known. Options: path; ticks, how many are served in all (200: a task that never settles ends); files
that aren't images are passed over. The tick is the offset, so a stream that is started again goes on with the next tick.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

KINDS = (".png", ".jpg", ".jpeg")
#: Ticks of a task at the most.
SPAN = 64


class Ticks(InputPartition):
    """Ticks from start, and the file that each serves."""

    def __init__(self, start: int, files: list[str]):
        self.start, self.files = start, files


def _listed(path: str) -> list[str]:
    """Images of a folder by name, on any file system that Arrow reads."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    found = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name.lower().endswith(KINDS)]
    if not found:
        raise ValueError(f"no images in {path}")
    return sorted(found, key=lambda p: p.rsplit("/", 1)[-1].encode())


class _Frames:
    def __init__(self, options: dict):
        self.path, self.ticks = options["path"], int(options.get("ticks", 200))

    def cut(self, start: int, end: int) -> list[Ticks]:
        files = _listed(self.path)
        return [Ticks(at, [files[min(t, len(files) - 1)] for t in range(at, min(at + SPAN, end))]) for at in range(start, end, SPAN)]

    def read(self, partition: Ticks) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        held, content = None, b""
        for k, file in enumerate(partition.files):
            if file != held:
                with system.open_input_stream(file) as stream:
                    held, content = file, stream.read()
            yield partition.start + k, file.rsplit("/", 1)[-1], content


class ReplayReader(_Frames, DataSourceReader):
    def partitions(self) -> list[Ticks]:
        return self.cut(0, self.ticks)


class ReplayStream(_Frames, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": self.ticks}

    def partitions(self, start: dict, end: dict) -> list[Ticks]:
        return self.cut(start["tick"], end["tick"])

    def commit(self, end: dict) -> None:
        """Recorded frames stay."""


class Replay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "tick bigint, name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ReplayReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ReplayStream(self.options)
