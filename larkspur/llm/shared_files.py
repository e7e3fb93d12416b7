"""Flat files in the shared scratch folder, written and read by executors through pyarrow's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def make(folder: str) -> None:
    store, path = opened(folder)
    store.create_dir(path, recursive=True)


@contextmanager
def publish(folder: str, name: str):
    """A stream whose bytes appear as `name` only when all are written; a task that runs again replaces its file."""
    store, path = opened(folder)
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(draft, compression=None) as out:
            yield out
        if store.type_name != "local" and store.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
            store.delete_file(f"{path}/{name}")
        store.move(draft, f"{path}/{name}")
    except BaseException:
        if store.get_file_info(draft).type != fs.FileType.NotFound:
            store.delete_file(draft)
        raise


def read_range(store: fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)
