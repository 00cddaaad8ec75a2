"""A media container as a Spark data source: packets written as clusters of blocks, and read by ranges of clusters.

    register(spark)
    packets.write.format("container").mode("append").option("timecode_scale", 1_000_000).save(path)
    spark.read.format("container").load(path)                               # packets
    spark.read.format("container").option("table", "cues").load(path)       # or tracks, tags

Each task writes one file: header, segment information, clusters, tracks, cues, tags; files.py tells how a job commits them.
Its index has, of each file, where about every SPLIT bytes a cluster begins, and the times up to the next such place. A read
makes a partition for each of these places, and leaves out those that a filter on pts rules out.

Rows are (track int, pts bigint, keyframe boolean, invisible boolean, discardable boolean, data binary). A cluster ends where a
packet's time is more than 32767 from its start, or its data have passed CLUSTER bytes; times within it are 16 bits. Sort within
partitions before writing.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from .files import File, FilesReader, FilesWriter, Range, Written, base_name, file_system

PACKETS = "track int, pts bigint, keyframe boolean, invisible boolean, discardable boolean, data binary"
TABLES = {"packets": PACKETS, "cues": "file string, track int, time bigint, position bigint", "tracks": "file string, track int, kind int, codec string, uid bigint", "tags": "file string, name string, value string"}
#: Bytes of a cluster's data, and of a batch of rows that are read.
CLUSTER, BATCH = 5 << 20, 1 << 20

# The marks of the container's elements.
HEADER, VERSION, READ_VERSION, ID_LENGTH, SIZE_LENGTH, DOC, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION, VOID = 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC, 0xEC
INFO, SCALE, DURATION, MUXER, WRITER = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
CLUSTER_MARK, TIMECODE, BLOCK = 0x1F43B675, 0xE7, 0xA3
CUES, CUE, CUE_TIME, CUE_TRACK_POSITION, CUE_TRACK, CUE_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TAGS, TAG, TARGETS, SIMPLE_TAG, TAG_NAME, TAG_STRING = 0x1254C367, 0x7373, 0x63C0, 0x67C8, 0x45A3, 0x4487
VIDEO = 1


def size_bytes(n: int, width: int | None = None) -> bytes:
    """A size as 7 bits a byte below a bit that tells the width; the value of all ones is not used."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (1 << 7 * width | n).to_bytes(width, "big")


def mark_bytes(mark: int) -> bytes:
    return mark.to_bytes((mark.bit_length() + 7) // 8, "big")


def element(mark: int, *content: bytes | int | str) -> bytes:
    """One element; a whole number takes the bytes that it needs."""
    held = b"".join(c if isinstance(c, bytes) else c.encode() if isinstance(c, str) else c.to_bytes(max(1, (c.bit_length() + 7) // 8), "big") for c in content)
    return mark_bytes(mark) + size_bytes(len(held)) + held


def block(track: int, time: int, data: bytes, keyframe=True, invisible=False, discardable=False) -> bytes:
    flags = 0x80 * bool(keyframe) | 0x08 * bool(invisible) | 0x01 * bool(discardable)
    return element(BLOCK, size_bytes(track), time.to_bytes(2, "big", signed=True), bytes([flags]), data)


def read_size(b: bytes | memoryview, at: int) -> tuple[int | None, int]:
    """The size at a place and where it ends; None where it is left open."""
    width = 9 - b[at].bit_length()
    n = int.from_bytes(b[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def read_mark(b: bytes | memoryview, at: int) -> tuple[int, int]:
    width = 9 - b[at].bit_length()
    return int.from_bytes(b[at : at + width], "big"), at + width


def children(b: bytes | memoryview):
    """(mark, content) of the elements that stand one after the other."""
    at = 0
    while at < len(b):
        mark, at = read_mark(b, at)
        n, at = read_size(b, at)
        end = len(b) if n is None else at + n
        yield mark, b[at:end]
        at = end


def number(b) -> int:
    return int.from_bytes(b, "big")


def cluster_rows(content: memoryview):
    """(track, pts, keyframe, invisible, discardable, data) of a cluster's blocks."""
    start = 0
    for mark, c in children(content):
        if mark == TIMECODE:
            start = number(c)
        elif mark == BLOCK:
            track, at = read_size(c, 0)
            flags = c[at + 2]
            yield track, start + int.from_bytes(c[at : at + 2], "big", signed=True), bool(flags & 0x80), bool(flags & 0x08), bool(flags & 0x01), bytes(c[at + 3 :])


class ContainerWriter(FilesWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.scale = int(options.get("timecode_scale", 1_000_000))
        self.limit, self.title = int(options.get("cluster", CLUSTER)), options.get("writing_app", "cuespan")
        self.video = {int(x) for x in options.get("video_tracks", "1").split(",") if x}
        self.codecs = json.loads(options.get("codecs", "{}"))
        self.tags = json.loads(options.get("tags", "{}"))

    def write(self, iterator) -> Written:
        out, at = None, 0
        clusters: list[tuple[int, int, int]] = []  # place, least time, greatest time
        cues, seen = [], set()
        held, size, start, lo, hi, keys = [], 0, 0, 0, 0, []

        def put(b: bytes) -> None:
            nonlocal at
            out.write(b)
            at += len(b)

        def finish() -> None:
            nonlocal held, size, keys
            if held:
                clusters.append((at, lo, hi))
                cues.extend((t, track, at - segment) for t, track in keys)
                put(element(CLUSTER_MARK, element(TIMECODE, start), *held))
            held, size, keys = [], 0, []

        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:  # a task without rows has no file
                name, out = self.create("mkv")
                put(element(HEADER, element(VERSION, 1), element(READ_VERSION, 1), element(ID_LENGTH, 4), element(SIZE_LENGTH, 8), element(DOC, "matroska"), element(DOC_VERSION, 2), element(DOC_READ, 2)))
                put(mark_bytes(SEGMENT) + b"\x01" + b"\xff" * 7)  # of open size: it is written in one go
                segment = at
                put(element(INFO, element(SCALE, self.scale), element(MUXER, "cuespan"), element(WRITER, self.title)))
            cols = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            n = batch.num_rows
            flags = [cols.get(c) or [d] * n for c, d in (("keyframe", True), ("invisible", False), ("discardable", False))]
            for track, pts, key, hidden, loose, data in zip(cols["track"], cols["pts"], *flags, cols["data"], strict=True):
                if track is None or pts is None or pts < 0:
                    raise ValueError("a packet has a track and a time that is not negative")
                if held and (abs(pts - start) > 32767 or size > self.limit):
                    finish()
                if not held:
                    start, lo, hi = pts, pts, pts
                data = data or b""
                held.append(block(track, pts - start, data, key, hidden, loose))
                size += len(data)
                lo, hi = min(lo, pts), max(hi, pts)
                seen.add(track)
                if key and track in self.video:
                    keys.append((pts, track))
        if out is None:
            return Written()
        finish()
        end = at
        # tracks are known at the end, so a reader finds them behind the clusters
        put(element(TRACKS, *[element(TRACK, element(TRACK_NUMBER, t), element(TRACK_UID, t), element(TRACK_TYPE, VIDEO if t in self.video else 2), element(LACING, 0), element(CODEC, self.codecs.get(str(t), "V_UNCOMPRESSED" if t in self.video else "A_PCM/FLOAT/IEEE"))) for t in sorted(seen)]))
        if cues:
            put(element(CUES, *[element(CUE, element(CUE_TIME, t), element(CUE_TRACK_POSITION, element(CUE_TRACK, k), element(CUE_POSITION, p))) for t, k, p in cues]))
        if self.tags:
            put(element(TAGS, element(TAG, element(TARGETS), *[element(SIMPLE_TAG, element(TAG_NAME, k), element(TAG_STRING, v)) for k, v in self.tags.items()])))
        out.close()
        return Written([File(name, end, self.ranges(clusters, lambda x, y: (min(x[0], y[0]), max(x[1], y[1]))))])


class ContainerReader(FilesReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.table = options.get("table", "packets")
        self.least, self.most = None, None

    def pushFilters(self, filters):
        """Times that a filter asks for leave out partitions; Spark tests rows itself all the same."""
        for f in filters:
            if self.table == "packets" and getattr(f, "attribute", None) == ("pts",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.least = f.value if self.least is None else max(self.least, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.most = f.value if self.most is None else min(self.most, f.value)
            yield f

    def wanted(self, lo: int, hi: int) -> bool:
        return (self.least is None or hi >= self.least) and (self.most is None or lo <= self.most)

    def partitions(self):
        return super().partitions(indexed=self.table == "packets")

    def read(self, partition: Range):
        import pyarrow as pa

        if not partition.file:
            return
        fs, _ = file_system(self.path)
        name = base_name(partition.file)
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in TABLES[self.table].split(", ")])
        rows, size = [], 0

        def batch():
            cols = [*zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

        with fs.open_input_file(partition.file) as f:
            for mark, content in _elements(f, partition.at, partition.to):
                if self.table == "packets" and mark == CLUSTER_MARK:
                    found = cluster_rows(content)
                elif self.table == "cues" and mark == CUES:
                    found = _cues(name, content)
                elif self.table == "tracks" and mark == TRACKS:
                    found = _tracks(name, content)
                elif self.table == "tags" and mark == TAGS:
                    found = _tags(name, content)
                else:
                    continue
                for r in found:
                    rows.append(r)
                    size += len(r[-1]) if self.table == "packets" else 64
                    if size >= BATCH or len(rows) >= 4096:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


def _elements(f, at: int, to: int | None):
    """(mark, content) of a segment's elements in a range of a file; what isn't asked for is not read twice."""
    end = f.size() if to is None else to
    while at < end:
        f.seek(at)
        head = f.read(12)
        mark, n = read_mark(head, 0)
        size, n = read_size(head, n)
        if mark == SEGMENT:  # its elements follow
            at += n
            continue
        if size is None:
            raise ValueError("an element of open size that is not a segment")
        if mark in (CLUSTER_MARK, CUES, TRACKS, TAGS):
            f.seek(at + n)
            yield mark, memoryview(f.read(size))
        at += n + size


def _held(b, *way) -> list:
    """The contents of the elements that a way of marks leads to."""
    found = [b]
    for mark in way:
        found = [c for x in found for m, c in children(x) if m == mark]
    return found


def _cues(name, b):
    for cue in _held(b, CUE):
        for place in _held(cue, CUE_TRACK_POSITION):
            yield name, number(_held(place, CUE_TRACK)[0]), number(_held(cue, CUE_TIME)[0]), number(_held(place, CUE_POSITION)[0])


def _tracks(name, b):
    for t in _held(b, TRACK):
        yield name, number(_held(t, TRACK_NUMBER)[0]), number(_held(t, TRACK_TYPE)[0]), bytes(_held(t, CODEC)[0]).decode(), number(_held(t, TRACK_UID)[0])


def _tags(name, b):
    for t in _held(b, TAG, SIMPLE_TAG):
        yield name, bytes(_held(t, TAG_NAME)[0]).decode(), "".join(bytes(x).decode() for x in _held(t, TAG_STRING))


class ContainerSource(DataSource):
    """Format "container"; see the module."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "packets")]

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(dict(self.options), overwrite)


def register(spark) -> None:
    """The format's name for a session; Spark passes filters on to a source of this kind only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContainerSource)
