"""Compiler indexes in their wire format: only the fields the import needs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 256 << 20


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("cut or overlong number")
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a message; unknown fields come too, a cut message is an error."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        if at > len(data):
            raise ValueError("cut message")
        yield number, kind, value


def packed(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        v, at = varint(value, at)
        out.append(v)
    return out


def decode(data: bytes) -> Iterator[tuple[str, list[int], str, int]]:
    """(relative_path, range, symbol, roles) of every occurrence of an index."""
    for number, kind, doc in fields(data):
        if number != 2 or kind != 2:
            continue
        parts = list(fields(doc))
        path = next((v.decode() for n, k, v in parts if n == 1 and k == 2), "")
        for n, k, occ in parts:
            if n == 2 and k == 2:
                place, symbol, roles = [], "", 0
                for m, _, v in fields(occ):
                    if m == 1:
                        place.extend(packed(v))
                    elif m == 2:
                        symbol = v.decode()
                    elif m == 3:
                        roles = v
                yield path, place, symbol, roles


def encode(docs: dict[str, list[tuple[list[int], str, int]]]) -> bytes:
    """An index of documents; for tests and export."""

    def number(v: int) -> bytes:
        out = bytearray()
        while v > 0x7F:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        return bytes([*out, v])

    def part(n: int, body: bytes) -> bytes:
        return number(n << 3 | 2) + number(len(body)) + body

    out = b""
    for path, occs in docs.items():
        body = part(1, path.encode())
        for place, symbol, roles in occs:
            body += part(2, part(1, b"".join(map(number, place))) + part(2, symbol.encode()) + (number(3 << 3) + number(roles)))
        out += part(2, body)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(relative_path, occ_range, symbol, symbol_roles) of index files; larger ones than 256 MiB are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if size > MOST_BYTES:
                    raise ValueError("index too large")
                rows = list(decode(content))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32())], names=["relative_path", "occ_range", "symbol", "symbol_roles"])

    return spark.read.format("binaryFile").load(path).select("content", "length").mapInArrow(run, "relative_path string, occ_range array<int>, symbol string, symbol_roles int")
