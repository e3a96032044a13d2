"""Files read in blocks: size cap, header and hash without ever holding a file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BLOCK, HEADER, MOST_BYTES = 1 << 20, 16, 20 * 1024 * 1024


class UploadFile(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


def read_in_blocks(stream, most: int, block: int = BLOCK) -> tuple[int, bytes, str | None]:
    """(bytes read, first bytes, sha256): the hash is null once the cap is passed, and nothing more is read."""
    digest, total, header = hashlib.sha256(), 0, b""
    while True:
        part = stream.read(min(block, most + 1 - total))
        if not part:
            return total, header, digest.hexdigest()
        header += part[: HEADER - len(header)]
        total += len(part)
        if total > most:
            return total, header, None
        digest.update(part)


class UploadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("mostbytes", MOST_BYTES))

    def partitions(self) -> list[UploadFile]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [UploadFile(scheme + f.path) for f in files if f.type == fs.FileType.File]

    def read(self, partition: UploadFile) -> Iterator[tuple]:
        from pyarrow import fs

        uri = partition.uri
        system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        with system.open_input_stream(path) as stream:
            length, header, digest = read_in_blocks(stream, self.most)
        yield uri, length, digest, header, digest is None


class UploadSource(DataSource):
    """``spark.read.format("uploads").option("mostBytes", n).load(path)``: one row and one task a file.

    Of a file above the cap ``length`` is what was read, one byte more than the cap.
    """

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return "path string, length long, sha256 string, header binary, too_large boolean"

    def reader(self, schema: StructType) -> UploadReader:
        return UploadReader({k.lower(): v for k, v in self.options.items()})
