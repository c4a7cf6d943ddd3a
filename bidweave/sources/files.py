"""CSV files of several encodings and layouts, read by Spark as whole files and parsed in tasks."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.operators.ingest import dedupe_snapshots, normalise_report
from bidweave.session import written
from bidweave.sources import ranges

#: Encodings in the order in which they are tried, and what marks a header and a file's metadata.
ENCODINGS = ["utf-8-sig", "cp932", "shift_jis"]
HEADER = ("商品管理番号", ("コントロールカラム", "クリック数"))
PERIOD = re.compile(r"(20\d{2})[-年/](\d{1,2})[-月/](\d{1,2})日?\s*[～~-]\s*(20\d{2})[-年/](\d{1,2})[-月/](\d{1,2})日?")
EXECUTED = re.compile(r"実行日時\s*:\s*(20\d{2}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})")
#: Kinds of files by columns that they have and lack, the first that fits.
KINDS = [
    ("product_master", {"common_product_id", "product_id", "gross_margin_rate"}, set()),
    ("normalized_performance", {"platform", "entity_type", "product_id", "clicks", "cost"}, set()),
    ("manual_overrides", {"override_mode", "product_id", "active"}, set()),
    ("rakuten_rpp_setting", {"商品名", "価格", "商品URL", "商品CPC"}, {"クリック数(合計)"}),
    ("rakuten_rpp_keyword_report", {"キーワード", "クリック数(合計)"}, set()),
    ("rakuten_rpp_item_report", {"商品管理番号", "クリック数(合計)"}, set()),
]
#: A file of more bytes is read in ranges of so many: a task holds some ten times as much while it parses.
SPLIT = 16 << 20
#: What is known of a file before its rows.
ABOUT = "problem string, kind string, header_row int, header array<string>, file_start string, file_end string, executed_at string"
#: The settings file's columns by the names that the operators use.
SETTING_COLUMNS = {"コントロールカラム": "control", "商品管理番号": "product_id", "商品名": "product_name", "価格": "price", "商品URL": "url", "商品CPC": "item_cpc", "キーワード": "keyword", "キーワードCPC": "keyword_cpc", "目安CPC": "guide_cpc"}


def kind_of(columns: list[str]) -> str:
    have = set(columns)
    return next((kind for kind, needs, lacks in KINDS if needs <= have and not lacks & have), "generic_csv")


def decoded(raw: bytes) -> tuple[str, str] | None:
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return None


def described(text: str) -> dict:
    """Of a file's text or its first lines: metadata, header and the line that it begins at; `problem` without a header."""
    lines = re.split(r"\r?\n", text)
    head = "\n".join(lines[:30])
    period, executed = PERIOD.search(head), EXECUTED.search(head)
    start = next((i for i, line in enumerate(lines[:80]) if HEADER[0] in line and any(x in line for x in HEADER[1])), 0)
    first = next(csv.reader(io.StringIO("\n".join(lines[start:]))), None)
    if not first or not any(map(str.strip, first)):
        return {"problem": "no rows after the header"}
    header = [c.strip().replace("\ufeff", "") for c in first]
    dates = [None, None] if period is None else ["-".join(f"{int(x):02d}" for x in period.groups()[k : k + 3]) for k in (0, 3)]
    return {"header_row": start, "header": header, "kind": kind_of(header), "file_start": dates[0], "file_end": dates[1], "executed_at": executed and " ".join(executed.groups())}


def parsed(raw: bytes) -> dict:
    """A file's encoding, metadata, header and rows, which are parsed as they are taken; `problem` if it can't be read."""
    found = decoded(raw)
    if found is None:
        return {"problem": "unknown encoding"}
    text, encoding = found
    about = {"encoding": encoding, **described(text)}
    if "problem" in about:
        return about
    rows = csv.reader(io.StringIO(re.sub(r"\r\n", "\n", text).split("\n", about["header_row"])[-1]))
    next(rows)
    return {**about, "cells": ranges.cells_of(rows, len(about["header"]))}


def read_files(spark: SparkSession, path: str | list[str], *, split: int = SPLIT) -> DataFrame:
    """One row a data row: path, sha256 of the file, encoding, kind, header, metadata, pos and cells. A file that can't be read has one row with its problem.

    Files of more than `split` bytes are parsed by many tasks as ranges of so many bytes; pos rises with a file's rows either way.
    """
    files = spark.read.format("binaryFile").load(path)
    whole = _whole_files(files.where(F.col("length") <= split))
    # Only lengths are read.
    if not files.where(F.col("length") > split).select("path").limit(1).count():
        return whole
    large = written(ranges.heads(files.where(F.col("length") > split), ENCODINGS, described, ABOUT), "heads")
    cells = written(ranges.parsed_ranges(large.where("problem IS NULL"), split), "cells")
    about = large.drop("length", "data_start").withColumn("header_row", F.coalesce("header_row", F.lit(0)))
    # The rows stay in the tasks that read them: the files, which are few, come to them. Files without rows have one row all the same.
    bare = about.join(cells.select("path").distinct(), "path", "left_anti").withColumns({"pos": F.lit(0).cast("long"), "cells": F.lit(None).cast("array<string>")})
    return whole.unionByName(cells.join(about, "path")).unionByName(bare)


def _whole_files(files: DataFrame) -> DataFrame:
    files = files.select("path", F.sha2("content", 256).alias("sha256"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch.itertuples(index=False):
                found = parsed(file.content)
                cells = found.pop("cells", iter(()))
                # A file without rows has one row all the same.
                cells, pos = chain([next(cells, None)], cells), 0
                while kept := list(islice(cells, ranges.ROWS)):
                    yield pd.DataFrame([{"path": file.path, "sha256": file.sha256, "problem": found.get("problem"), "encoding": found.get("encoding"), "kind": found.get("kind"), "header_row": found.get("header_row", 0), "header": found.get("header"), "file_start": found.get("file_start"), "file_end": found.get("file_end"), "executed_at": found.get("executed_at"), "pos": k, "cells": c} for k, c in enumerate(kept, pos)])
                    pos += len(kept)

    return files.mapInPandas(parse, f"path string, sha256 string, encoding string, {ABOUT}, pos long, cells array<string>")


def profile(rows: DataFrame) -> DataFrame:
    """One row a file: its metadata, columns and number of data rows."""
    return rows.groupBy("path", "sha256", "problem", "encoding", "kind", "header_row", "header", "file_start", "file_end", "executed_at").agg(F.count("cells").alias("rows"))


def layouts(rows: DataFrame) -> list[tuple[str, list[str], DataFrame]]:
    """(kind, columns, table) for each header among the files; what reaches the driver is a header a layout."""
    headers = [(r["kind"], r["header"]) for r in rows.where("problem IS NULL").select("kind", "header").distinct().collect()]
    out = []
    for kind, header in sorted(headers):
        mine = rows.where((F.col("kind") == kind) & (F.col("header") == F.array(*map(F.lit, header))) & F.col("cells").isNotNull())
        meta = [F.col("path").alias("source_name"), F.col("sha256").alias("source_hash"), F.col("file_start").try_cast("date").alias("file_start"), F.col("file_end").try_cast("date").alias("file_end"), F.col("executed_at").try_cast("timestamp").alias("executed_at"), F.xxhash64("path").bitwiseAND(F.lit((1 << 31) - 1)).alias("__f"), "pos"]
        first = {c: i for i, c in reversed(list(enumerate(header)))}
        table = mine.select(*[F.get("cells", F.lit(i)).alias(c) for c, i in first.items()], *meta)
        out.append((kind, header, table.withColumn("ord", F.shiftleft("__f", 32) + F.col("pos")).drop("__f", "pos")))
    return out


def read_performance(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All performance reports under the path as one table, each entity once in a snapshot."""
    tables = [normalise_report(t, kind) for kind, _, t in layouts(written(read_files(spark, path), "parsed")) if kind.endswith("_report") or kind == "normalized_performance"]
    if not tables:
        raise ValueError(f"no performance report under {path}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return dedupe_snapshots(out)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """The settings files under the path, with the operators' column names; absent ones are empty."""
    tables = [t for kind, _, t in layouts(written(read_files(spark, path), "parsed")) if kind == "rakuten_rpp_setting"]
    if not tables:
        raise ValueError(f"no settings file under {path}")
    named = [t.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) if c in t.columns else F.lit("").alias(n) for c, n in SETTING_COLUMNS.items()], "ord") for t in tables]
    out = named[0]
    for t in named[1:]:
        out = out.unionByName(t)
    return out


def read_master(spark: SparkSession, path: str) -> DataFrame:
    tables = [t for kind, _, t in layouts(written(read_files(spark, path), "parsed")) if kind == "product_master"]
    if not tables:
        raise ValueError(f"no product master under {path}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
