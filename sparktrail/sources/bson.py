"""Dumps of a document store: BSON documents one after another in a file, read as JSON text.

The format is public (bsonspec.org): a document is its length, elements of a type byte,
a name and a value, and a zero byte. What JSON has no form for becomes an object with
one name, as in extended JSON: {"$oid"}, {"$date"}, {"$binary"}, {"$regex"},
{"$timestamp"}, {"$numberDecimal"}, {"$numberDouble"} (not a number or infinite).
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_LIMIT = {1: "Infinity", -1: "-Infinity"}


class Malformed(ValueError):
    """Bytes that are no whole document."""


class _Reader:
    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Malformed(f"{n} bytes asked for at {self.at}, {self.end - self.at} there")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(f"<{form}", self.take(struct.calcsize(f"<{form}")))[0]

    def name(self) -> str:
        stop = self.data.find(b"\0", self.at, self.end)
        if stop < 0:
            raise Malformed(f"no end of the name at {self.at}")
        return self.take(stop + 1 - self.at)[:-1].decode()

    def text(self) -> str:
        return self.take(self.number("i"))[:-1].decode()

    def elements(self) -> Iterator[tuple[str, object]]:
        size = self.number("i")
        end = self.at - 4 + size
        if size < 5 or end > self.end or self.data[end - 1] != 0:
            raise Malformed(f"a document of {size} bytes at {self.at - 4}")
        inner = _Reader(self.data, self.at, end - 1)
        while inner.at < inner.end:
            kind = inner.take(1)[0]
            yield inner.name(), inner.value(kind)
        self.at = end

    def value(self, kind: int):
        match kind:
            case 0x01:
                x = self.number("d")
                return x if abs(x) < float("inf") else {"$numberDouble": "NaN" if x != x else _LIMIT[1 if x > 0 else -1]}
            case 0x02 | 0x0D | 0x0E:  # text, program, symbol
                return self.text()
            case 0x03:
                return dict(self.elements())
            case 0x04:
                return [v for _, v in self.elements()]
            case 0x05:
                n, sub = self.number("i"), self.take(1)[0]
                return {"$binary": {"base64": base64.b64encode(self.take(n)).decode(), "subType": f"{sub:02x}"}}
            case 0x06 | 0x0A:  # undefined, null
                return None
            case 0x07:
                return {"$oid": self.take(12).hex()}
            case 0x08:
                return self.take(1) != b"\0"
            case 0x09:
                at = self.number("q")
                try:
                    return {"$date": (_EPOCH + timedelta(milliseconds=at)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at % 1000:03d}Z"}
                except OverflowError:
                    return {"$date": {"$numberLong": str(at)}}
            case 0x0B:
                return {"$regex": self.name(), "$options": self.name()}
            case 0x10:
                return self.number("i")
            case 0x11:
                low, high = self.number("I"), self.number("I")
                return {"$timestamp": {"t": high, "i": low}}
            case 0x12:
                return self.number("q")
            case 0x13:
                return {"$numberDecimal": self.take(16).hex()}
            case 0x7F | 0xFF:
                return {"$maxKey" if kind == 0x7F else "$minKey": 1}
        raise Malformed(f"type {kind:#x} at {self.at}")


def documents_in(data: bytes) -> Iterator[tuple[int, str | None, str | None]]:
    """(byte place, JSON text, error) of each document; after an error nothing more, as lengths tell where the next begins."""
    reader = _Reader(data, 0, len(data))
    while reader.at < reader.end:
        start = reader.at
        try:
            yield start, json.dumps(dict(reader.elements()), ensure_ascii=False, allow_nan=False), None
        except (Malformed, UnicodeDecodeError) as e:
            yield start, None, str(e)
            return


def bson_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, document, error) of each document of each dump below a path.

    A file that is cut gives its whole documents and one row with the error. Files are
    read whole, each by one task, so a dump is best kept as files of at most some hundred MB; beyond 2 GB Spark's reader gives an error.
    """

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for row in documents_in(content.as_py() or b""):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield _batch(name, rows)
                        rows = []
                if rows:
                    yield _batch(name, rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bson").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), "content").mapInArrow(decode, "file string, at long, document string, error string")


def _batch(name: str, rows: list[tuple]):
    at, texts, errors = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(at, pa.int64()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["file", "at", "document", "error"])
