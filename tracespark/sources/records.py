"""Record files of TFRecord framing with tf.train.Example payloads, as a Spark data source ``tfrecord``.

One task reads one shard front to back. Options: ``path`` (a folder or file on a mount all machines
share), ``keys`` (comma separated features to read; others are skipped on the wire).
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Wire types of protocol buffers, as fixed values.
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 0x7F) << shift
        at += 1
        if not b[at - 1] & 0x80:
            return n, at
        shift += 7


def fields(b: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(number, wire type, start, end) of each field of a message."""
    end = len(b) if end is None else end
    while at < end:
        tag, at = varint(b, at)
        kind = tag & 7
        if kind == BYTES:
            n, at = varint(b, at)
            yield tag >> 3, kind, at, at + n
            at += n
        elif kind == VARINT:
            start = at
            _, at = varint(b, at)
            yield tag >> 3, kind, start, at
        elif kind in (FIXED64, FIXED32):
            n = 8 if kind == FIXED64 else 4
            yield tag >> 3, kind, at, at + n
            at += n
        else:
            raise ValueError(f"wire type {kind}")


def bytes_features(example: bytes, keys: set[str]) -> dict[str, list[bytes]]:
    """The bytes lists of the wanted features: Example.features(1) -> map entries(1) -> key(1), Feature(2) -> BytesList(1) -> value(1)."""
    out: dict[str, list[bytes]] = {}
    for num, kind, a, b in fields(example):
        if (num, kind) != (1, BYTES):
            continue
        for num2, kind2, c, d in fields(example, a, b):
            if (num2, kind2) != (1, BYTES):
                continue
            key, value = None, None
            for num3, kind3, e, f in fields(example, c, d):
                if num3 == 1 and kind3 == BYTES:
                    key = example[e:f].decode("utf-8", "replace")
                elif num3 == 2 and kind3 == BYTES:
                    value = (e, f)
            if key in keys and value:
                for num4, kind4, g, h in fields(example, *value):
                    if (num4, kind4) == (1, BYTES):
                        out[key] = [example[i:j] for n, k, i, j in fields(example, g, h) if (n, k) == (1, BYTES)]
    return out


def records(path: str) -> Iterator[bytes]:
    """Payloads of a file; a record cut off at the end raises an error."""
    with open(path, "rb") as f:
        while head := f.read(12):
            if len(head) < 12:
                raise ValueError(f"{path}: a record's head is cut off")
            n = struct.unpack("<Q", head[:8])[0]
            body = f.read(n + 4)
            if len(body) < n + 4:
                raise ValueError(f"{path}: a record is cut off")
            yield body[:n]


class Shard(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path, keys

    def partitions(self) -> list[Shard]:
        found = [self.path] if os.path.isfile(self.path) else sorted(p for p in glob.glob(os.path.join(self.path, "**", "*"), recursive=True) if ".tfrecord" in os.path.basename(p))
        return [Shard(p) for p in found]

    def read(self, partition: Shard) -> Iterator[tuple]:
        for i, r in enumerate(records(partition.path)):
            got = bytes_features(r, set(self.keys))
            yield (partition.path, i, *(got.get(k) for k in self.keys))


class TFRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def _keys(self) -> list[str]:
        return [k.strip() for k in self.options.get("keys", "").split(",") if k.strip()]

    def schema(self) -> str:
        return ", ".join(["shard string", "record int", *(f"`{k}` array<binary>" for k in self._keys())])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._keys())
