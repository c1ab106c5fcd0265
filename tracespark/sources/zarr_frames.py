"""Image chunks of sharded Zarr v3 stores, as a Spark data source ``zarr_frames``.

One task reads one shard of one episode; frames that the step or range leaves out are never
decompressed. Rows: episode, t, image (encoded). Options: ``path`` (folder of episodes, on a mount all
machines share), ``array``, ``step``, ``start``, ``end``. Missing chunks (an index entry of all ones)
have no row.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MISSING = (1 << 64) - 1


def shard_index(data: bytes, chunks: int) -> list[tuple[int, int]]:
    """(offset, size) of each inner chunk, from the table at the shard's end, before its checksum."""
    table = data[-(16 * chunks + 4) : -4]
    return [struct.unpack_from("<QQ", table, 16 * i) for i in range(chunks)]


def byte_strings(chunk: bytes) -> list[bytes]:
    """Variable-length items: a count, then length and bytes of each."""
    n = struct.unpack_from("<I", chunk)[0]
    out, at = [], 4
    for _ in range(n):
        size = struct.unpack_from("<I", chunk, at)[0]
        out.append(chunk[at + 4 : at + 4 + size])
        at += 4 + size
    return out


class _Shard(InputPartition):
    def __init__(self, episode: str, path: str, first: int, inner: int, chunks: int, frames: int):
        super().__init__(path)
        self.episode, self.path, self.first, self.inner, self.chunks, self.frames = episode, path, first, inner, chunks, frames


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.array = options["path"], options.get("array", "images.front_1")
        self.step, self.start, self.end = int(options.get("step", 1)), int(options.get("start", 0)), int(options.get("end", 1 << 40))

    def partitions(self) -> list[_Shard]:
        out: list[_Shard] = []
        for name in sorted(os.listdir(self.root)):
            meta = os.path.join(self.root, name, self.array, "zarr.json")
            if not os.path.isfile(meta):
                continue
            with open(meta) as f:
                m = json.load(f)
            frames, outer = int(m["shape"][0]), int(m["chunk_grid"]["configuration"]["chunk_shape"][0])
            inner = int(next(c for c in m["codecs"] if c["name"] == "sharding_indexed")["configuration"]["chunk_shape"][0])
            for k in range(-(-frames // outer)):
                path = os.path.join(self.root, name, self.array, "c", str(k), *["0"] * (len(m["shape"]) - 1))
                if os.path.isfile(path):
                    out.append(_Shard(name, path, k * outer, inner, outer // inner, frames))
        return out

    def read(self, partition: _Shard) -> Iterator[tuple]:
        import zstandard

        with open(partition.path, "rb") as f:
            data = f.read()
        unpack = zstandard.ZstdDecompressor()
        for i, (offset, size) in enumerate(shard_index(data, partition.chunks)):
            first = partition.first + i * partition.inner
            wanted = [t for t in range(first, min(first + partition.inner, partition.frames)) if self.start <= t < self.end and (t - self.start) % self.step == 0]
            if not wanted or (offset, size) == (MISSING, MISSING):
                continue
            items = byte_strings(unpack.decompressobj().decompress(data[offset : offset + size]))
            for t in wanted:
                if t - first < len(items):
                    yield partition.episode, t, items[t - first]


class ZarrFrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr_frames"

    def schema(self) -> str:
        return "episode string, t bigint, image binary"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
