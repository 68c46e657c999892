"""Frames of videos as a data source of its own, for batches and streams, and the sink that writes what it reads.

A video is a folder, a part of it a file of Netpbm images (P5 or P6) one after another, all of one size. The size stands in the file's name, so a listing tells how many frames each part
has, no part is opened to plan a scan, and any frame is found by its offset. Frames are numbered over the parts of their video. Scans are cut by frames, not by files: a task reads a piece of
a large part, or many small parts.
Conditions on video_id, part_no and frame_index reach the source (spark.sql.python.filterPushdown.enabled must be true): what they exclude is neither listed nor read.

The path may be of any file system that Arrow knows (local or mounted folders, hdfs://, s3://, gs://).

    frames.register(spark)
    spark.read.format("lanewise_frames").option("head", 25).load(path).filter("video_id = 'a' and frame_index < 1000")
    spark.readStream.format("lanewise_frames").load(path)
    frames.write_frames(rows, path)
"""
from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

NAME = "lanewise_frames"
SCHEMA = "video_id string, part_no int, frame_index long, frame int, width int, height int, channels int, pixels binary"
ARROW = pa.schema([("video_id", pa.string()), ("part_no", pa.int32()), ("frame_index", pa.int64()), ("frame", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary())])
#: Bytes of one task's frames, and of one batch's; what opening a file counts among a task's.
TASK_BYTES, BATCH_BYTES, OPEN_BYTES = 64_000_000, 8_000_000, 256_000
PART = re.compile(r"^(\d+)_(\d+)x(\d+)x([13])\.pnm$")
FOLDER = "video_id="
END = 2**62


@dataclass(frozen=True)
class Part:
    """A file of frames: how many come before it in its video, and how many it has."""

    video: str
    number: int
    path: str
    width: int
    height: int
    channels: int
    before: int
    frames: int

    @property
    def header(self) -> bytes:
        return header(self.width, self.height, self.channels)

    @property
    def record(self) -> int:
        return len(self.header) + self.width * self.height * self.channels


def header(width: int, height: int, channels: int) -> bytes:
    return f"P{5 if channels == 1 else 6}\n{width} {height}\n255\n".encode()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def listed(path: str, videos: set[str] | None = None) -> list[Part]:
    """The parts of the videos (of all, without a choice) in their order. A gap in the numbers ends a video: what is behind it has no place yet."""
    fs, root = opened(path)
    if videos is None:
        videos = {f.base_name[len(FOLDER) :] for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.Directory and f.base_name.startswith(FOLDER)}
    out = []
    for video in sorted(videos):
        files = fs.get_file_info(pafs.FileSelector(f"{root}/{FOLDER}{video}", allow_not_found=True))
        found = {int(m[1]): (f, *(int(m[i]) for i in (2, 3, 4))) for f in files if (m := PART.match(f.base_name))}
        before, number = 0, 1
        while number in found:
            f, width, height, channels = found[number]
            part = Part(video, number, f.path, width, height, channels, before, 0)
            frames = f.size // part.record
            out.append(Part(video, number, f.path, width, height, channels, before, frames))
            before, number = before + frames, number + 1
    return out


@dataclass(frozen=True)
class Range:
    """Frames first to last - 1 of a part, every gap-th of the video's."""

    part: Part
    first: int
    last: int
    gap: int

    @property
    def bytes(self) -> int:
        return -(-(self.last - self.first) // self.gap) * self.part.record


class Pieces(D.InputPartition):
    """What one task reads."""

    def __init__(self, ranges: list[Range]) -> None:
        self.ranges = ranges


def cut(part: Part, first: int, last: int, gap: int, task_bytes: int) -> list[Range]:
    """The part's share of the video's frames from first to last - 1, in pieces."""
    lo, hi = max(0, first - part.before), min(part.frames, last - part.before)
    step = max(1, task_bytes // part.record) * gap
    return [Range(part, at, min(hi, at + step), gap) for at in range(lo, hi, step)]


def dealt(ranges: Iterable[Range], task_bytes: int) -> list[Pieces]:
    """The ranges in their order, as many to a task as come to task_bytes, and one at least."""
    out, held = [], 0
    for r in ranges:
        cost = r.bytes + OPEN_BYTES
        if not out or held + cost > task_bytes:
            out.append(Pieces([]))
            held = 0
        out[-1].ranges.append(r)
        held += cost
    return out


def frames_in(path: str, ranges: list[Range]) -> Iterator[pa.RecordBatch]:
    """The frames of all ranges, BATCH_BYTES at a time."""
    fs, _ = opened(path)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
    rows, held = [], 0
    for piece in ranges:
        part, head = piece.part, piece.part.header
        with fs.open_input_file(part.path) as f:
            for n in range(piece.first + -(part.before + piece.first) % piece.gap, piece.last, piece.gap):
                record = f.read_at(part.record, n * part.record)
                if record[: len(head)] != head:
                    raise ValueError(f"no frame at {n} of {part.path}")
                if rows and held + len(record) > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
                rows.append((part.video, part.number, part.before + n, n, part.width, part.height, part.channels, record[len(head) :]))
                held += len(record)
    if rows:
        yield batch(rows)


class Frames:
    """What batches and streams share: options, and pieces as a task reads them."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.head, self.tail, self.gap = (int(options.get(name, default)) for name, default in (("head", 0), ("tail", 0), ("gap", 1)))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def read(self, partition: Pieces | None) -> Iterator[pa.RecordBatch]:
        """Without partitions Spark asks for one that is None."""
        return iter([]) if partition is None else frames_in(self.path, partition.ranges)


class FrameReader(Frames, D.DataSourceReader):
    """All frames but each video's first `head` and last `tail`, every gap-th."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.videos: set[str] | None = None
        self.parts: set[int] | None = None
        self.first, self.last = 0, END

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            if not self._takes(f):
                yield f

    def _takes(self, f: D.Filter) -> bool:
        column = getattr(f, "attribute", (None,))[0]
        values = {f.value} if isinstance(f, D.EqualTo) else set(f.value) if isinstance(f, D.In) else None
        if column in ("video_id", "part_no") and values is not None:
            name = "videos" if column == "video_id" else "parts"
            held = getattr(self, name)
            setattr(self, name, values if held is None else held & values)
            return True
        if column == "frame_index" and isinstance(f, (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)):
            if not isinstance(f, (D.LessThan, D.LessThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, D.GreaterThan))
            if not isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)):
                self.last = min(self.last, f.value + (not isinstance(f, D.LessThan)))
            return True
        return isinstance(f, D.IsNotNull) and column in ("video_id", "part_no", "frame_index")

    def partitions(self) -> list[Pieces]:
        parts = listed(self.path, self.videos)
        total: dict[str, int] = {}
        for p in parts:
            total[p.video] = p.before + p.frames
        chosen = [p for p in parts if self.parts is None or p.number in self.parts]
        return dealt((r for p in chosen for r in cut(p, max(self.first, self.head), min(self.last, total[p.video] - self.tail), self.gap, self.task_bytes)), self.task_bytes)


class FrameStream(Frames, D.DataSourceStreamReader):
    """Frames of parts as they become complete. An offset is the number of frames of each video that are there. A video has no end in a stream, so `tail` doesn't hold."""

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for p in listed(self.path):
            out[p.video] = p.before + p.frames
        return out

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Pieces]:
        grown = {v for v in end if end[v] > start.get(v, 0)}
        return dealt((r for p in listed(self.path, grown) for r in cut(p, max(self.head, start.get(p.video, 0)), end[p.video], self.gap, self.task_bytes)), self.task_bytes)

    def commit(self, end: dict[str, int]) -> None:
        """Offsets are numbers of frames in files that stay: nothing is kept for a batch."""


class Written(D.WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str, str]]) -> None:
        self.files = files


class FrameWriter(D.DataSourceArrowWriter):
    """Parts from rows in the order of video, part and frame. A part lies under a name of the task's attempt until the job commits; then it replaces what had its number."""

    def __init__(self, path: str) -> None:
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        files: list[tuple[str, str, str]] = []
        now, out, shape = None, None, None
        try:
            for batch in iterator:
                columns = {name: batch.column(name).to_pylist() for name in ("video_id", "part_no", "width", "height", "channels", "pixels")}
                for video, number, width, height, channels, pixels in zip(*columns.values(), strict=True):
                    if (video, number) != now:
                        if out:
                            out.close()
                        now, shape = (video, number), (width, height, channels)
                        held = f"{root}/_temporary-{self.run}"
                        fs.create_dir(held, recursive=True)
                        files.append((f"{held}/{uuid.uuid4().hex}", f"{root}/{FOLDER}{video}", f"{number:06d}_{width}x{height}x{channels}.pnm"))
                        out = fs.open_output_stream(files[-1][0])
                    if (width, height, channels) != shape or len(pixels) != width * height * channels:
                        raise ValueError(f"frames of part {number} of video {video} differ in size")
                    out.write(header(width, height, channels) + pixels)
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        there: dict[str, dict[str, list[str]]] = {}  # of each folder its files by number, listed once
        for held, folder, name in (f for m in messages if m for f in m.files):
            if folder not in there:
                fs.create_dir(folder, recursive=True)
                there[folder] = {}
                for old in fs.get_file_info(pafs.FileSelector(folder)):
                    there[folder].setdefault(old.base_name.split("_")[0], []).append(old.base_name)
            for old in there[folder].get(name.split("_")[0], []):
                if old != name:
                    fs.delete_file(f"{folder}/{old}")
            fs.move(held, f"{folder}/{name}")
            there[folder][name.split("_")[0]] = [name]
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_temporary-{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary-{self.run}")


class FrameSource(D.DataSource):
    """Options: path; head, tail and gap, as the reader says; taskBytes, the bytes of frames that one task reads."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> FrameReader:
        return FrameReader(self._plain())

    def streamReader(self, schema: T.StructType) -> FrameStream:
        return FrameStream(self._plain())

    def writer(self, schema: T.StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self._plain()["path"])

    def _plain(self) -> dict[str, Any]:
        out = {k.lower(): v for k, v in dict(self.options).items()}
        if "path" not in out and "paths" in out:
            (out["path"],) = json.loads(out["paths"])
        return out


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def write_frames(rows: DataFrame, path: str) -> None:
    """rows: video_id, part_no, frame_index, width, height, channels, pixels. Each part is written by one task, in the order of frames."""
    register(rows.sparkSession)
    ordered = rows.repartition("video_id", "part_no").sortWithinPartitions("video_id", "part_no", "frame_index")
    ordered.select("video_id", "part_no", "width", "height", "channels", "pixels").write.format(NAME).mode("append").save(path)
