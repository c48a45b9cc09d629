"""Files by URI or local path, on any store that pyarrow opens (local, S3, GCS, HDFS, ABFS)."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path within it; s3a is s3."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file:///"):
            path = "file:///" + path[len("file:/") :].lstrip("/")
        return fs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a://") else path)
    return fs.LocalFileSystem(), path
