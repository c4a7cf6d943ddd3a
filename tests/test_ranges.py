"""Files in ranges of bytes give the rows of whole files, wherever they are cut."""

import csv
import io
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidweave.session import written
from bidweave.sources import ranges
from bidweave.sources.files import ABOUT, described, parsed, read_files
from bidweave.sources.ranges import open_after

META = "商品レポート\r\n期間,2026年06月01日～2026年06月30日\r\n実行日時: 2026-07-01 09:30:00\r\n"
HEADER = "商品管理番号,クリック数(合計),\"備\n考\",名\r\n"


def body(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows(rows)
    return out.getvalue()


ROWS = [(f"P{k}", str(k), ("二行\nの,備考" if k % 5 == 0 else 'a "q" b' if k % 7 == 0 else ""), "名" * (k % 9)) for k in range(60)]
TEXTS = {
    "cp932.csv": (META + HEADER + body(ROWS)).encode("cp932"),
    "utf8.csv": (META + HEADER + body(ROWS)).encode("utf-8-sig"),
    "late.csv": ("a,b\n" + "x,y\n" * 80).encode() + "全角,名\n".encode("cp932"),
    "stray.csv": b'a,b\nx"y,1\n"o""p"q,2\nlong "r,3\n"never,4\nclosed,5\n' + b"z,9\n" * 30,
    "open.csv": b"a,b\n" + b'1,"x\n' * 41,
    "rows_only_in_front.csv": b"a,b\n1,2\n" + b",\n" * 50,
    "header_alone.csv": ("a," + "b" * 80 + "\n").encode(),
    "unreadable.csv": b"a,b\n" + b"\xff\xff\xfd,\n" * 30,
    "blank.csv": b"\n" * 90,
    "no_last_line_end.csv": b"a,b\n" + b"1,2\n" * 30 + b"3,4",
}


@pytest.mark.parametrize("split", [7, 64])
def test_ranges_give_the_rows_of_whole_files(spark, tmp_path, split):
    for name, raw in TEXTS.items():
        (tmp_path / name).write_bytes(raw)

    def rows(**more):
        found = sorted(read_files(spark, str(tmp_path), **more).collect(), key=lambda r: (r["path"], r["pos"]))
        return [tuple(v for c, v in sorted(r.asDict().items()) if c != "pos") for r in found]

    whole = rows()
    assert len(whole) > 250
    assert rows(split=split) == whole


@given(st.text('a",\n', max_size=12), st.booleans())
@settings(max_examples=2000, deadline=None)
def test_a_cell_is_open_where_the_parser_says_so(text, inside):
    text += "\n" if text else ""
    rows = list(csv.reader(io.StringIO(('"x' if inside else "") + text + "S")))
    assert open_after(text.encode(), inside) == (rows[-1] != ["S"])


def test_ranges_are_parsed_by_tasks_of_their_own(spark, tmp_path):
    """Ranges are small rows, which adaptive execution would put together."""
    (tmp_path / "a.csv").write_bytes(b"a,b\n" + b"1,2\n" * 1000)
    heads = written(ranges.heads(spark.read.format("binaryFile").load(str(tmp_path)), ["utf-8-sig"], described, ABOUT), "heads")
    per_task = [r["count"] for r in ranges.parsed_ranges(heads, 500).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 1000 and len(per_task) >= 4 and max(per_task) <= 500


def test_rows_are_parsed_as_they_are_taken():
    """What a task holds of a file are its bytes and texts, not all of its rows' cells."""
    raw = b"product_id,clicks,cost,a,b,c\n" + b"S123456,10,20,30,40,50\n" * 100_000
    tracemalloc.start()
    assert sum(1 for _ in parsed(raw)["cells"]) == 100_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(raw)
