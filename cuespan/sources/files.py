"""Files that tasks write and a job commits, for data sources that write bytes of their own.

A job has a folder under its path, which the driver makes; each task writes its files there under a name with its attempt.
When all tasks are done the driver moves the files of the attempts that counted into place, writes an index of them,
and deletes the folder with whatever else is in it; a job that fails deletes it as well. The index names, for each file, where
it can be cut: a read makes a partition of each range, and of a file without an index one of the whole.

Paths are URIs that pyarrow's file systems know, or plain ones that all machines share.
"""

from __future__ import annotations

import contextlib
import json
import posixpath
import uuid
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a reader's partition.
SPLIT = 32 << 20
INDEX = "_index"


def file_system(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def listed(fs, root: str) -> list:
    """The data files and indexes of a folder, or the file itself."""
    from pyarrow.fs import FileSelector, FileType

    own = fs.get_file_info(root)
    if own.type == FileType.File:
        return [own]
    return [f for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File and (f.base_name.startswith(INDEX) or not f.base_name.startswith(("_", ".")))]


@dataclass
class File:
    """A task's file: its name, where its last range ends, and ranges (place, ...) with what is known of each."""

    name: str
    end: int
    ranges: list[tuple]


@dataclass
class Written(WriterCommitMessage):
    files: list[File] = field(default_factory=list)


class FilesWriter(DataSourceArrowWriter):
    """Writers implement write(), which opens its files with create() and returns Written."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.job, self.overwrite = options["path"], uuid.uuid4().hex, overwrite
        self.split = int(options.get("split", SPLIT))
        fs, root = file_system(self.path)
        # made here alone: a task that lives on after its job has failed finds no folder to write to
        fs.create_dir(self._folder(root))

    def _folder(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def create(self, ending: str, number: int = 0):
        """(name, stream) of a new file of this attempt."""
        from pyspark import TaskContext

        fs, root = file_system(self.path)
        task = TaskContext.get()
        name = f"{task.taskAttemptId()}-part-{task.partitionId():05d}-{number:03d}-{self.job}.{ending}"
        return name, fs.open_output_stream(f"{self._folder(root)}/{name}", compression=None)

    def ranges(self, places: list[tuple], join) -> list[tuple]:
        """places (place, ...) put together to ranges of about `split` bytes; join(a, b) of what is known of two."""
        out: list[tuple] = []
        for place, *known in places:
            if out and place - out[-1][0] < self.split:
                out[-1] = (out[-1][0], *join(out[-1][1:], known))
            else:
                out.append((place, *known))
        return out

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        old = [f.path for f in listed(fs, root)] if self.overwrite else []
        index = []
        for f in [f for m in messages if m is not None for f in m.files]:
            name = f.name.partition("-")[2]
            fs.move(f"{self._folder(root)}/{f.name}", f"{root}/{name}")
            index.append({"name": name, "end": f.end, "ranges": f.ranges})
        with fs.open_output_stream(f"{root}/{INDEX}-{self.job}.json") as out:
            out.write("".join(json.dumps(x) + "\n" for x in index).encode())
        for path in old:
            fs.delete_file(path)
        self.abort([])

    def abort(self, messages) -> None:
        from pyarrow.fs import FileType

        fs, root = file_system(self.path)
        for _ in range(5):  # a task that still runs may add a file meanwhile
            if fs.get_file_info(self._folder(root)).type == FileType.Directory:
                with contextlib.suppress(OSError):
                    fs.delete_dir(self._folder(root))


@dataclass
class Range(InputPartition):
    """A file from one place to another; to None: the whole file, whatever stands in it."""

    file: str
    at: int
    to: int | None
    value: int = 0


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def wanted(self, *known) -> bool:
        """Whether a range is read, by what the index knows of it."""
        return True

    def partitions(self, indexed: bool = True):
        fs, root = file_system(self.path)
        files = {f.base_name: f for f in listed(fs, root)}
        out, known = [], set()
        for name, f in files.items():
            if not indexed or not name.startswith(INDEX):
                continue
            with fs.open_input_stream(f.path) as s:
                rows = [json.loads(x) for x in s.read().decode().splitlines()]
            for x in rows:
                if x["name"] in files:
                    known.add(x["name"])
                    ends = [*[r[0] for r in x["ranges"][1:]], x["end"]]
                    out += [Range(files[x["name"]].path, r[0], to) for r, to in zip(x["ranges"], ends, strict=True) if self.wanted(*r[1:])]
        out += [Range(f.path, 0, None) for name, f in files.items() if name not in known and not name.startswith(INDEX)]
        return out or [Range("", 0, 0)]


def base_name(path: str) -> str:
    return posixpath.basename(path)
