"""Plain files written and read by tasks, on whatever store the shared folder lives in.

Paths are Hadoop-style URIs; pyarrow's file systems reach file:, hdfs: and the object stores. Tasks
write under names of their own attempt and report them in rows, so the file of a lost or doubled
attempt is never read."""
from __future__ import annotations

import posixpath
import re

import numpy as np


def open_fs(uri: str):
    """(file system, path) of a URI; ``file:/x`` as Hadoop writes it is accepted."""
    from pyarrow import fs
    m = re.match(r"file:/+", uri)
    if m:
        return fs.LocalFileSystem(), "/" + uri[m.end():]
    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str) -> str:
    from pyspark import TaskContext
    ctx = TaskContext.get()
    return f"{prefix}-{ctx.partitionId():05d}-{ctx.taskAttemptId()}"


def join(folder: str, name: str) -> str:
    return posixpath.join(folder, name)


def read_array(uri: str, dtype: str, start: int, count: int) -> np.ndarray:
    """``count`` items from item ``start``: memory-mapped on a local or mounted store, else a range read."""
    from pyarrow import fs
    store, path = open_fs(uri)
    size = np.dtype(dtype).itemsize
    if count == 0:
        return np.empty(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r", offset=start * size, shape=(count,))
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_at(count * size, start * size), dtype)
