"""Files of formats of our own, which tasks write and read in the shared folder through Arrow's file systems."""

from __future__ import annotations

import os


def opened(path: str):
    """(file system, path) of a URI or a plain path; file, hdfs, s3 and gs are known to Arrow."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_whole(path: str, data: bytes) -> None:
    system, place = opened(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    with system.open_output_stream(place) as out:
        out.write(data)


def read_whole(path: str) -> bytes:
    system, place = opened(path)
    with system.open_input_stream(place) as data:
        return data.read()


def attempt_name() -> str:
    """Names a task's attempt, so that a repeated task never writes to the file of another attempt."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "000000-0"
