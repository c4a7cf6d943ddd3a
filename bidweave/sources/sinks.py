"""Outputs: folders of CSV that Spark writes, and small files for people."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.sources.files import SETTING_COLUMNS

#: A file for people has this many rows at most; larger tables are written as folders.
MOST_ROWS = 1_000_000


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers and CRLF."""
    df.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)


@contextmanager
def _any_charset(spark: SparkSession) -> Iterator[None]:
    """Lets the CSV writer use a charset of the JVM's that isn't a form of Unicode."""
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: The JVM's name of the marketplace's encoding, and the mark at the head of UTF-8 files for spreadsheets.
CHARSETS = {"cp932": "windows-31j", "utf-8-sig": "utf-8"}
MARK = b"\xef\xbb\xbf"


def write_file(df: DataFrame, path: str, encoding: str = "utf-8-sig", *, order: list[str] | None = None) -> None:
    """One CSV file of any number of rows with a header and CRLF; what the encoding lacks becomes a question mark.

    Tasks encode and write parts in the order of rows, by ranges if an order is given. The parts' bytes are then streamed behind each
    other into a file beside the target, which takes its name last: the target is whole or not there. Nulls are empty.
    """
    spark = df.sparkSession
    parts, charset = f"{path}.{uuid.uuid4().hex}.parts", CHARSETS.get(encoding, encoding)
    rows = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]) if order is None else df.orderBy(*order).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    options = {"encoding": charset, "lineSep": "\r\n", "emptyValue": "", "nullValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    with _any_charset(spark):
        rows.write.options(**options).csv(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(conf)
    head = io.StringIO()
    pd.DataFrame(columns=df.columns).to_csv(head, index=False, lineterminator="\r\n")
    whole = jvm.org.apache.hadoop.fs.Path(f"{parts}/_whole")
    out = system.create(whole, True)
    try:
        out.write(bytearray((MARK if encoding == "utf-8-sig" else b"") + head.getvalue().encode(encoding.removesuffix("-sig"), "replace")))
        for name in sorted(f.getPath().getName() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")):
            part = system.open(jvm.org.apache.hadoop.fs.Path(f"{parts}/{name}"))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    system.delete(target, False)
    system.rename(whole, target)
    system.delete(folder, True)


def write_settings(outputs: dict[str, DataFrame], folder: str, run_id: str) -> list[str]:
    """The four setting files in the layout and encoding that the marketplace takes, by product and keyword; their names."""
    names = {n: c for c, n in SETTING_COLUMNS.items()}
    for kind, rows in outputs.items():
        write_file(rows.select(*[F.col(n).alias(c) for n, c in names.items()]), f"{folder}/{kind}_{run_id}.csv", "cp932", order=[names["product_id"], names["keyword"]])
    return [f"{kind}_{run_id}.csv" for kind in outputs]


def csv_bytes(df: DataFrame, encoding: str = "utf-8-sig") -> bytes:
    """One CSV file with CRLF; what the encoding lacks becomes a question mark."""
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write a folder instead")
    return df.toPandas().to_csv(index=False, lineterminator="\r\n").encode(encoding, "replace")


def download_files(final: DataFrame, validation: DataFrame, review: DataFrame, outputs: dict[str, DataFrame]) -> dict[str, bytes]:
    """The files that a person takes from a run: three tables as UTF-8 with a mark, and the four setting files."""
    flat = final.select(*[c for c, t in final.dtypes if not t.startswith(("array", "struct", "map"))])
    tables = {"decision_detail": flat, "upload_validation": validation, "review": review}
    return {f"{n}.csv": csv_bytes(t) for n, t in tables.items()} | {f"{n}.csv": setting_csv(t) for n, t in outputs.items()}


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, terms: DataFrame | None = None) -> None:
    """A graph's nodes and edges, and the terms beside it, as folders of CSV under the path."""
    for name, table in (("nodes", nodes), ("edges", edges), ("terms", terms)):
        if table is not None:
            write_csv(table.select(*[F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in table.dtypes]), f"{path.rstrip('/')}/{name}")


def setting_csv(rows: DataFrame) -> bytes:
    """Setting rows in the layout and encoding that the marketplace takes."""
    names = {n: c for c, n in SETTING_COLUMNS.items()}
    return csv_bytes(rows.select(*[F.col(n).alias(c) for n, c in names.items()]), "cp932")


def profile_json(profile: DataFrame, statuses: DataFrame, **more: str) -> str:
    """A run's figures (one row) and its rows by status as JSON."""
    return json.dumps({**more, **profile.first().asDict(), "statuses": {r["decision_status"]: r["n"] for r in statuses.orderBy("decision_status").collect()}}, ensure_ascii=False)


#: An example row of each input, by column.
TEMPLATES = {
    "performance": {
        "platform": "rakuten", "entity_type": "ITEM", "product_id": "item-001", "keyword": "", "period_start": "2026-07-01", "period_end": "2026-07-07", "registered_bid": "30", "impressions": "1000",
        "clicks": "100", "cost": "3000", "actual_cpc": "30", "sales_short": "10000", "orders_short": "3", "sales_attr": "20000", "orders_attr": "5", "ctr_pct": "10",
    },
    "settings": {"コントロールカラム": "", "商品管理番号": "item-001", "商品名": "sample", "価格": "1000", "商品URL": "https://example.com/item-001", "商品CPC": "30", "キーワード": "", "キーワードCPC": "", "目安CPC": ""},
    "product_master": {
        "platform": "rakuten", "common_product_id": "item-001", "product_id": "item-001", "product_name": "sample", "category": "C", "product_group": "G", "gross_margin_rate": "0.4", "other_promo_cost_rate": "0", "item_min_cpc": "24",
        "item_max_cpc": "100", "stock_qty": "100", "product_status": "ACTIVE", "launch_date": "2020-01-01", "role": "PROFIT",
    },
}
#: The columns that an input must have, those that are numbers, and those that are dates.
REQUIRED = {"performance": {"platform", "entity_type", "product_id", "clicks", "cost", "sales_attr", "orders_attr", "period_start", "period_end"}, "settings": {"商品管理番号", "商品CPC"}, "product_master": {"product_id", "gross_margin_rate"}}
NUMBERS = {"registered_bid", "impressions", "clicks", "cost", "actual_cpc", "sales_short", "orders_short", "sales_attr", "orders_attr", "ctr_pct", "価格", "商品CPC", "キーワードCPC", "目安CPC", "gross_margin_rate", "other_promo_cost_rate", "item_min_cpc", "item_max_cpc", "stock_qty"}
DATES = {"period_start", "period_end", "launch_date"}


def column_dictionary(spark) -> DataFrame:
    """(input, column, requirement, type, example, definition) of every input column."""
    rows = [
        (k, c, "REQUIRED" if c in REQUIRED[k] else "OPTIONAL", t := "number" if c in NUMBERS else "date" if c in DATES else "text", example, f"{c} of the {k.replace('_', ' ')}, as {t}")
        for k, row in TEMPLATES.items() for c, example in row.items()
    ]
    return spark.createDataFrame(rows, "input string, column string, requirement string, type string, example string, definition string")


def template_pack(spark) -> bytes:
    """A ZIP of the templates and the dictionary; settings are in cp932, as the marketplace has them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, (k, row) in enumerate(TEMPLATES.items(), 1):
            encoding = "cp932" if k == "settings" else "utf-8-sig"
            z.writestr(f"{n:02d}_{k}_template_{encoding.replace('-sig', '').replace('-', '')}.csv", pd.DataFrame([row]).to_csv(index=False, lineterminator="\r\n").encode(encoding))
        z.writestr("input_column_dictionary_utf8.csv", csv_bytes(column_dictionary(spark)))
    return out.getvalue()
