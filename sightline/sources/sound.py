"""WAV files as chunks of sound, read once or as a stream.

``spark.dataSource.register(Sound)``, then ``spark.read.format("sound")`` or
``spark.readStream.format("sound")`` with options ``path`` (a folder, local or a URI that
pyarrow's file systems know, seen by driver and executors) and ``seconds`` (of a chunk).
A file's device is its folder. A stream takes files in the order of their paths below the
root and keeps the last one as its offset, so names must grow as files arrive; a batch
takes all that are there. ``seq`` is the number at the end of a file's name
times 1,000,000 plus the chunk's number in the file. A file is cut into partitions of
``RUN`` chunks; no task holds more than one chunk's sound at a time. The last chunk may be
shorter. Files that are no plain WAV raise; empty ones give no rows.
"""

from __future__ import annotations

import re
import wave
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import audio

SCHEMA = "device string, file string, seq long, seconds double, level double, rate int, pcm binary"
RUN = 256
PER_FILE = 1_000_000


@dataclass
class Part(InputPartition):
    file: str
    first: int
    chunks: int


def _fs(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    system, at = fs.FileSystem.from_uri(uri)
    return system, at.rstrip("/")


class _Files:
    """What both readers do."""

    def __init__(self, options: dict):
        self.root, self.seconds = options["path"], float(options.get("seconds", 0.4))
        if self.seconds <= 0:
            raise ValueError("seconds must be above 0")

    def names(self) -> list[str]:
        from pyarrow import fs

        system, root = _fs(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted(f.path[len(root) + 1 :] for f in found if f.is_file and f.path.lower().endswith(".wav"))

    def _open(self, name: str):
        system, root = _fs(self.root)
        return wave.open(system.open_input_file(f"{root}/{name}"), "rb")

    def parts(self, names: list[str]) -> list[Part]:
        out = []
        for name in names:
            with self._open(name) as w:
                step = max(1, round(w.getframerate() * self.seconds))
                chunks = -(-w.getnframes() // step)
            out += [Part(name, k, min(RUN, chunks - k)) for k in range(0, chunks, RUN)]
        return out

    def rows(self, part: Part) -> Iterator[tuple]:
        folder, _, stem = part.file.rpartition("/")
        number = re.search(r"(\d+)\.[^.]*$", stem)
        base = int(number[1]) * PER_FILE if number else 0
        with self._open(part.file) as w:
            rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
            step = max(1, round(rate * self.seconds))
            w.setpos(part.first * step)
            for k in range(part.first, part.first + part.chunks):
                samples = audio.mono(w.readframes(step), width, channels)
                pcm = (samples.clip(-1, 1) * 32767).round().astype("<i2").tobytes()
                yield folder, part.file, base + k, len(samples) / rate, audio.level(samples), rate, pcm


class _Reader(_Files, DataSourceReader):
    def partitions(self):
        return self.parts(self.names())

    def read(self, partition):
        return self.rows(partition)


class _StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self.names(), default="")}

    def partitions(self, start: dict, end: dict):
        return self.parts([n for n in self.names() if start["after"] < n <= end["after"]])

    def read(self, partition):
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Sound(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sound"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)
