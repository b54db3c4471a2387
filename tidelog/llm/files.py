"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@contextmanager
def new_file(folder: str, name: str) -> Iterator[tuple]:
    """A stream and the path it will have.

    The name has the attempt's number, and only a manifest row of a successful task names the
    file, so a task that is lost or runs twice never mixes with another's bytes.
    """
    context = TaskContext.get()
    path = f"{folder}/{name}-{context.partitionId():06d}-{context.taskAttemptId()}"
    store, local = open_fs(path)
    store.create_dir(local.rpartition("/")[0], recursive=True)
    with store.open_output_stream(local) as stream:
        yield stream, path
