"""Task-side output files: written under a temporary name, then renamed.

A retried or speculative task writes its own temporary file and the rename
replaces the whole target, so a lost executor leaves nothing half written.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from samplewright.sources.ranges import known_scheme


def output_system(path: str):
    """File system and bare path of a plain path or a URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(known_scheme(path))
    return fs.LocalFileSystem(), path


@contextmanager
def replacing(path: str):
    """A binary stream whose content appears at ``path`` only when the block ends well."""
    system, target = output_system(path)
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    temporary = f"{target}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(temporary) as stream:
            yield stream
    except BaseException:
        system.delete_file(temporary)
        raise
    try:
        system.move(temporary, target)
    except OSError:  # a file system whose rename does not replace, after an earlier attempt
        system.delete_file(target)
        system.move(temporary, target)
