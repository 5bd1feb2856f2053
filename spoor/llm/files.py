"""Files that tasks write to the shared folder, on any file system that Arrow can open."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyarrow import fs

# Schemes that Hadoop and Arrow spell differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "": "file"}


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = uri.partition(":") if re.match(r"[a-z][a-z0-9+.-]*:/", uri) else ("", "", uri)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{re.sub('^//', '', rest)}")


@contextmanager
def committed(folder: str, name: str, attempt: int):
    """A file that appears under its name only when it is complete.

    A second attempt of a task writes under another hidden name and then replaces the first one's file.
    """
    where, path = open_fs(folder)
    where.create_dir(path, recursive=True)
    hidden = f"{path}/.{name}.{attempt}"
    with where.open_output_stream(hidden, compression=None) as out:
        yield out
    where.move(hidden, f"{path}/{name}")
