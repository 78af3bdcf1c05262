"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI that Spark knows, and the path in it. Local paths, file, hdfs, s3, gs and abfs work."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
