"""Large CSV files, read by many tasks as ranges of bytes that end with a line.

Line ends, commas and quotes are never part of a longer character in the encodings that are read, so bytes can be cut at line
ends. One task a file streams its bytes for the digest, the encoding and the header, and parses nothing else. Then each range says
whether it leaves a quoted cell open, for both ways in which it may begin, and a file's ranges are folded into how each begins.
At last each range's own records are parsed: those that begin in it, to their end, which may lie in a later one.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.session import written

BLOCK = 1 << 20
#: Tasks that files or ranges are dealt to at most.
MOST_TASKS = 2000
#: Parsed rows that a task gives on at once.
ROWS = 5000
#: A cell's opening quote, and a quoted cell's rest up to its closing quote or the end of the bytes.
OPENING = re.compile(rb'(?:^|(?<=[,\n\r]))"')
REST = re.compile(rb'(?:[^"]|"")*+("?)')
#: How many lines may stand before the header.
HEAD_LINES = 80


def opened(path: str):
    """The file for reading at any place, on the file system that its path names."""
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_file(re.sub("^//(?=/)", "", rest))
    root, name = re.fullmatch(r"(//[^/]*)?(/.*)", rest, re.S).groups()
    system, _ = fs.FileSystem.from_uri(f"{scheme}:{root or '//'}/")
    return system.open_input_file(name)


def line_end(file, start: int, size: int) -> int:
    """The place after the first line end at `start` or later; the file's end if there is none."""
    while start < size:
        block = file.read_at(min(BLOCK, size - start), start)
        found = block.find(b"\n")
        if found >= 0:
            return start + found + 1
        start += len(block)
    return size


def open_after(raw: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open behind these bytes, which begin in one or at a record's start."""
    at = 0
    if inside:
        rest = REST.match(raw)
        if not rest.group(1):
            return True
        at = rest.end()
    while (quote := OPENING.search(raw, at)) is not None:
        rest = REST.match(raw, quote.end())
        if not rest.group(1):
            return True
        at = rest.end()
    return False


def own_records(file, start: int, stop: int, size: int, inside: bool) -> bytes:
    """The records that begin in [start, stop), whole. inside: the range begins in a quoted cell of an earlier record."""
    while inside and start < stop:
        after = line_end(file, start, size)
        inside = open_after(file.read_at(after - start, start), inside)
        start = after
    if start >= stop:
        return b""
    raw = file.read_at(stop - start, start)
    # A line more until the last record is closed; its state is that of all of the bytes so far.
    inside = open_after(raw, False)
    more = []
    while inside and stop < size:
        after = line_end(file, stop, size)
        more.append(file.read_at(after - stop, stop))
        inside, stop = open_after(more[-1], True), after
    return raw + b"".join(more)


def cells_of(rows: Iterator[list[str]], width: int) -> Iterator[list[str | None]]:
    """Rows as wide as the header, empty cells as None; empty rows are left out."""
    cells = ([c or None for c in (row + [""] * width)[:width]] for row in rows)
    return (c for c in cells if any(x is not None for x in c))


def ranges(files: DataFrame, split: int) -> DataFrame:
    """files (path, length, data_start, ...) with start and stop, a range a row."""
    starts = F.explode(F.sequence(F.col("data_start"), F.col("length") - 1, F.lit(split).cast("long")))
    rows = files.where("data_start < length").withColumn("start", starts)
    return rows.withColumn("stop", F.least(F.col("start") + split, "length"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows with a task for each, up to MOST_TASKS. They are few and small, but stand for much work: without their number, adaptive execution would put them all into one task."""
    return rows.repartition(max(1, min(rows.count(), MOST_TASKS)))


def begun(files: DataFrame, split: int) -> DataFrame:
    """A range a row, moved to line ends: path, length, encoding, header, start, stop, and inside: whether it begins in a quoted cell."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                with opened(r.path) as file:
                    # The first line after the header begins a range as it is.
                    first = r.start if r.start == r.data_start else line_end(file, r.start - 1, r.length)
                    last = first if r.stop <= first else line_end(file, r.stop - 1, r.length)
                    raw = file.read_at(last - first, first)
                out.append((r.path, r.start, first, last, open_after(raw, False), open_after(raw, True)))
            yield pd.DataFrame(out, columns=["path", "nominal", "start", "stop", "after_out", "after_in"])

    cut = ranges(files.select("path", "length", "data_start"), split)
    seen = written(dealt(cut).mapInPandas(look, "path string, nominal long, start long, stop long, after_out boolean, after_in boolean"), "ranges")
    # A file has as many ranges as its bytes over `split`: few, and folded in their order.
    per_file = seen.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("nominal", "start", "stop", "after_out", "after_in"))).alias("all"))
    begins = F.aggregate("all", F.array(F.lit(False)), lambda acc, r: F.concat(acc, F.array(F.when(F.element_at(acc, -1), r["after_in"]).otherwise(r["after_out"]))))
    known = per_file.withColumn("begins", begins).select("path", F.posexplode("all").alias("__n", "r"), "begins")
    known = known.select("path", "r.start", "r.stop", F.get("begins", F.col("__n")).alias("inside")).where("start < stop")
    return dealt(known.join(files.select("path", "length", "encoding", "header"), "path"))


def heads(files: DataFrame, encodings: list[str], describe: Callable[[str], dict], schema: str) -> DataFrame:
    """A file a row: path, length, sha256, encoding, data_start (behind the header), and what `describe` says of its first lines, by schema."""

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                with opened(path) as file:
                    digest = hashlib.sha256()
                    for at in range(0, length, BLOCK):
                        digest.update(file.read_at(BLOCK, at))
                    # The next encoding is tried from the start where one has failed.
                    row = {"path": path, "length": length, "sha256": digest.hexdigest(), "encoding": next((e for e in encodings if _decodes(file, length, e)), None), "data_start": length}
                    if row["encoding"] is None:
                        row["problem"] = "unknown encoding"
                    else:
                        end = 0
                        for _ in range(HEAD_LINES):
                            end = line_end(file, end, length)
                        found = describe(file.read_at(end, 0).decode(row["encoding"]))
                        row |= found
                        if "problem" not in found:
                            row["data_start"] = _behind_header(file, found["header_row"], length)
                yield pd.DataFrame([{c: row.get(c) for c in names}], dtype=object)

    whole = f"path string, length long, sha256 string, encoding string, data_start long, {schema}"
    names = [f.split(" ")[0] for f in whole.split(", ")]
    return dealt(files.select("path", "length")).mapInPandas(head, whole)


def _decodes(file, size: int, encoding: str) -> bool:
    reader = codecs.getincrementaldecoder(encoding)()
    try:
        for at in range(0, size, BLOCK):
            reader.decode(file.read_at(BLOCK, at), at + BLOCK >= size)
        return True
    except UnicodeDecodeError:
        return False


def _behind_header(file, lines: int, size: int) -> int:
    start = 0
    for _ in range(lines):
        start = line_end(file, start, size)
    inside, first = True, start
    while inside and start < size:
        start = line_end(file, start, size)
        raw = file.read_at(start - first, first)
        inside = open_after(raw.removeprefix(codecs.BOM_UTF8), False)
    return start


def parsed_ranges(files: DataFrame, split: int) -> DataFrame:
    """(path, pos, cells) of files as `heads` gives them: each data row as wide as the header, in the order of pos; empty rows are left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                with opened(r.path) as file:
                    raw = own_records(file, r.start, r.stop, r.length, r.inside)
                # The mark of a file's encoding is before its header.
                text = re.sub(r"\r\n", "\n", raw.decode("utf-8" if r.encoding == "utf-8-sig" else r.encoding))
                del raw
                cells, pos = cells_of(csv.reader(io.StringIO(text)), len(r.header)), r.start
                # A row takes a byte at least, so places rise from range to range.
                while kept := list(islice(cells, ROWS)):
                    yield pd.DataFrame({"path": r.path, "pos": range(pos, pos + len(kept)), "cells": kept})
                    pos += len(kept)

    return begun(files, split).mapInPandas(parse, "path string, pos long, cells array<string>")
