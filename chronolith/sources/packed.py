"""Files packed by `compress` (.Z), which Spark's readers don't know: unpacked in tasks, a file at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: the first two bytes, the code that empties the table, and the first free code behind it.
MAGIC, CLEAR, FIRST = b"\x1f\x9d", 256, 257


def unpack(data: bytes) -> bytes:
    """The bytes of a .Z file. ValueError if it isn't one or breaks off within the table's rules.

    Codes are as wide as the table needs, low bits first, and come in groups of eight: whenever the width changes, what is
    left of a group is padding. The table grows by one entry a code up to the width that the third byte allows; in block
    mode CLEAR empties it.
    """
    if len(data) < 3 or data[:2] != MAGIC:
        raise ValueError("not a .Z file")
    widest, block = data[2] & 0x1F, bool(data[2] & 0x80)
    if not 9 <= widest <= 16:
        raise ValueError(f"codes of {widest} bits")
    first = FIRST if block else CLEAR
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b""] * block
    out: list[bytes] = []
    width, start, at, total = 9, 24, 24, 8 * len(data)
    before = b""

    def next_group() -> int:
        """Where the group of eight codes that is begun ends."""
        group = 8 * width
        return start + -(-(at - start) // group) * group

    while at + width <= total:
        code = int.from_bytes(data[at >> 3 : (at + width + 7) >> 3], "little") >> (at & 7) & ((1 << width) - 1)
        at += width
        if block and code == CLEAR:
            at = start = next_group()
            del table[first:]
            width, before = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise ValueError(f"code {code} before its entry")
        out.append(entry)
        if before and len(table) < 1 << widest:
            table.append(before + entry[:1])
        before = entry
        if len(table) >= 1 << width and width < widest:
            at = start = next_group()
            width += 1
    return b"".join(out)


def _texts(encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    text, problem = unpack(content).decode(encoding), None
                except ValueError as e:
                    text, problem = None, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string()), pa.array([problem], pa.string())], ["path", "text", "problem"])

    return run


def read_packed(spark: SparkSession, folder: str, pattern: str = "*.Z", encoding: str = "utf-8") -> DataFrame:
    """path, text and problem of the packed files below the folder, a row each: a file that can't be unpacked has no text, and its problem says why, so that one bad file doesn't stop the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("content")).mapInArrow(_texts(encoding), "path string, text string, problem string")
