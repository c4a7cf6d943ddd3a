"""Files in, decisions and state out: parsing, the store, and runs that follow each other."""

import json
import zipfile
from datetime import datetime
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from bidweave.operators import ingest, state
from bidweave.plans import runner
from bidweave.schema import KEYS, STATE_TABLES, Policy
from bidweave.sources import files, sinks
from bidweave.sources.state_store import StateStore, from_zip, to_zip
from bidweave.streaming.incremental import decide_stream

PERFORMANCE = "platform,entity_type,product_id,keyword,period_start,period_end,registered_bid,impressions,clicks,cost,actual_cpc,sales_short,orders_short,sales_attr,orders_attr,ctr_pct\nrakuten,ITEM,P1,,2026-07-01,2026-07-07,30,1000,100,3000,30,10000,3,20000,5,10\n"
REPORT = "実行日時 : 2026-07-09 10:11:12\n集計期間,2026年07月01日～2026年07月07日\n\n日付,商品管理番号,キーワード,キーワードCPC,表示回数,クリック数(合計),実績額(合計),CPC実績(合計),売上金額(合計12時間),売上件数(合計12時間),売上金額(合計720時間),売上件数(合計720時間),CTR(%)\n2026年07月01日～2026年07月07日,P1,布団　収納,30,\"1,234\",100,\"3,000円\",30,－,0,\"20,000\",5,12.5%\n,,,,,,,,,,,,\n"
SETTING = "コントロールカラム,商品管理番号,商品名,価格,商品URL,商品CPC,キーワード,キーワードCPC,目安CPC\n,P1,x,1000,https://example.com,{},,,\n"
MASTER = "platform,common_product_id,product_id,category,product_group,gross_margin_rate,other_promo_cost_rate,item_min_cpc,item_max_cpc,stock_qty,product_status,launch_date,role\nrakuten,P1,P1,C,G,40,0,24,100,100,,2020-01-01,\n"


@pytest.fixture
def inputs(tmp_path):
    def write(name, text, encoding="utf-8-sig"):
        (tmp_path / name.split("/")[0]).mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode(encoding))

    write("reports/a.csv", PERFORMANCE)
    write("master/m.csv", MASTER)
    write("settings/s.csv", SETTING.format(30), "cp932")
    return tmp_path, write


def test_report_layouts(spark, inputs):
    root, write = inputs
    write("reports/k.csv", REPORT, "cp932")
    (root / "reports/bad.csv").write_bytes(b"\x81\xff\xfe\x00")
    (root / "reports/empty.csv").write_bytes(b"\r\n")
    rows = {r["entity_type"]: r for r in files.read_performance(spark, f"{root}/reports").collect()}
    k = rows["KEYWORD"]
    assert (k["keyword"], k["impressions"], k["cost"], k["sales_short"], k["sales_attr"], k["ctr_pct"]) == ("布団 収納", 1234.0, 3000.0, None, 20000.0, 12.5)
    assert (str(k["period_start"]), k["window_days"], str(k["executed_at"]), k["entity_key"]) == ("2026-07-01", 7, "2026-07-09 10:11:12", "rakuten|KEYWORD|P1|布団 収納")
    assert (rows["ITEM"]["clicks"], rows["ITEM"]["snapshot_id"]) == (100.0, rows["ITEM"]["source_hash"][:16])
    profile = {r["path"].rsplit("/", 1)[1]: r for r in files.profile(files.read_files(spark, f"{root}/reports")).collect()}
    assert profile["k.csv"]["encoding"] == "cp932" and profile["k.csv"]["header_row"] == 3 and profile["k.csv"]["rows"] == 1
    assert profile["bad.csv"]["problem"] and profile["empty.csv"]["problem"]


def test_kinds():
    assert files.kind_of(["商品名", "価格", "商品URL", "商品CPC"]) == "rakuten_rpp_setting"
    assert files.kind_of(["override_mode", "product_id", "active"]) == "manual_overrides" and files.kind_of(["x"]) == "generic_csv"


def test_reconciliation(spark):
    rows = [("confirmed", 40.0, 30.0, 40.0, datetime(2026, 7, 5)), ("initial", 30.0, None, None, None), ("edited", 35.0, 30.0, None, None), ("late", 30.0, 30.0, 40.0, datetime(2026, 7, 1)), ("early", 30.0, 30.0, 40.0, datetime(2026, 7, 7, 12)), ("gone", None, 30.0, 40.0, None)]
    table = spark.createDataFrame([("rakuten", "ITEM", *r, "run_0", datetime(2026, 6, 1), "x") for r in rows], "platform string, entity_type string, product_id string, registered_cpc double, state_applied_cpc double, planned_cpc double, planned_at timestamp, planned_run_id string, state_effective_at timestamp, state_source string").withColumn("keyword", F.lit(""))
    found = state.reconcile(table, F.lit("2026-07-08").cast("timestamp"))
    got = {r["product_id"]: (r["event_type"], r["state_applied_cpc"]) for r in found.collect()}
    assert got == {"confirmed": ("PLAN_CONFIRMED", 40.0), "initial": ("INITIAL_BASELINE", 30.0), "edited": ("EXTERNAL_MANUAL_CHANGE", 35.0), "late": ("PLAN_NOT_APPLIED", 30.0), "early": (None, 30.0), "gone": (None, 30.0)}
    plans = table.select(*KEYS, "planned_cpc", F.lit("PENDING").alias("planned_status"), "planned_at", F.lit("x").alias("source"), F.lit("run_0").alias("run_id"))
    after = {r["product_id"]: r["planned_status"] for r in state.update_plans(plans, state.setting_events(found)).collect()}
    assert after == {"confirmed": "CONFIRMED", "initial": "PENDING", "edited": "SUPERSEDED", "late": "NOT_APPLIED", "early": "PENDING", "gone": "PENDING"}


def test_the_store_keeps_versions_and_goes_through_a_zip(spark, tmp_path):
    store, schema = StateStore(spark, f"{tmp_path}/state"), STATE_TABLES["applied_settings"]
    rows = spark.createDataFrame([("rakuten", "ITEM", "P1", "", 35.0, "ACTIVE", datetime(2026, 7, 1), "BASE", "run_1")], schema)
    assert store.read("applied_settings").count() == 0
    store.append("applied_settings", rows)
    store.append("applied_settings", rows)
    assert sorted(r["ord"] for r in store.read("applied_settings").collect()) == [1, 2]
    store.replace("applied_settings", rows)
    assert store.version("applied_settings") == 2 and store.read("applied_settings").first()["applied_cpc"] == 35.0
    other = StateStore(spark, f"{tmp_path}/other")
    policy, manifest = from_zip(other, to_zip(store, Policy(target_roas_pct=300.0), {"last_run_id": "run_1"}))
    assert policy.target_roas_pct == 300.0 and manifest == {"last_run_id": "run_1"}
    assert other.read("applied_settings").drop("ord").collect() == store.read("applied_settings").drop("ord").collect()


def test_latest_rows_and_null_dates(spark):
    key = ("rakuten", "ITEM", "P", "")
    rows = spark.createDataFrame([(*key, 1.0, None, "a", 3), (*key, 2.0, datetime(2026, 1, 1), "b", 1), (*key, 3.0, datetime(2026, 1, 1), "c", 2)], f"{', '.join(f'{k} string' for k in KEYS)}, applied_cpc double, effective_at timestamp, source string, ord int")
    assert state.latest_applied(rows).first()["state_applied_cpc"] == 3.0
    overrides = spark.createDataFrame([(*key, "lock_cpc", 1.0, datetime(2026, 1, 2), None, "on", 1), (*key, "exclude", 2.0, None, None, "TRUE", 2), (*key, "x", 3.0, datetime(2027, 1, 1), None, "1", 3), (*key, "y", 4.0, None, None, "no", 4)], f"{', '.join(f'{k} string' for k in KEYS)}, override_mode string, override_cpc double, effective_from timestamp, effective_until timestamp, active string, ord int")
    assert state.active_overrides(overrides, F.lit("2026-06-01").cast("timestamp")).first()["override_mode"] == "EXCLUDE"


def test_run_ids_are_a_function_of_their_input():
    a = state.run_id("ab" * 32, Policy(), datetime(2026, 1, 1))
    assert a == state.run_id("ab" * 32, Policy(), datetime(2026, 1, 1)) != state.run_id("ab" * 32, Policy(target_roas_pct=1.0), datetime(2026, 1, 1))
    assert Policy.from_dict({"target_roas_pct": 1.0, "other": 2}).target_roas_pct == 1.0 and Policy.from_dict(None) == Policy()


def test_same_file_twice_counts_once(spark, inputs):
    root, write = inputs
    write("reports/b.csv", PERFORMANCE)
    assert files.read_performance(spark, f"{root}/reports").count() == 1


def test_templates(spark):
    with zipfile.ZipFile(BytesIO(sinks.template_pack(spark))) as z:
        names = z.namelist()
        assert [n[:3] for n in names[:3]] == ["01_", "02_", "03_"] and names[3] == "input_column_dictionary_utf8.csv"
        assert files.parsed(z.read(names[0]))["kind"] == "normalized_performance" and files.parsed(z.read(names[1]))["kind"] == "rakuten_rpp_setting" and files.parsed(z.read(names[2]))["kind"] == "product_master"
    assert sinks.column_dictionary(spark).columns == ["input", "column", "requirement", "type", "example", "definition"]
    assert sinks.csv_bytes(spark.createDataFrame([("あ", "😀")], "a string, b string"), "cp932") == "a,b\r\nあ,?\r\n".encode("cp932")


def test_stream_decides_and_carries_state(spark, inputs):
    root, _ = inputs
    rows = files.read_performance(spark, f"{root}/reports")
    rows.write.parquet(f"{root}/stream")
    store = StateStore(spark, f"{root}/state")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/stream")
    writer = decide_stream(stream, lambda: files.read_settings(spark, f"{root}/settings"), lambda: files.read_master(spark, f"{root}/master"), store, Policy(), lambda: datetime(2026, 7, 10), f"{root}/out")
    writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 1 and store.read("run_history").count() == 1


def test_command_line(spark, inputs, capsys):
    root, _ = inputs
    runner.main(["--reports", f"{root}/reports", "--settings", f"{root}/settings", "--product-master", f"{root}/master", "--state", f"{root}/state", "--out-dir", f"{root}/out", "--as-of", "2026-07-10T00:00:00"])
    profile = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert profile["rows"] == 1 and sum(profile["statuses"].values()) == 1
    assert (root / "out/item_full").is_dir() and (root / "out/upload_validation").is_dir() and (root / "out/network/edges").is_dir()


def test_master_defaults_and_rates(spark):
    raw = spark.createDataFrame([("P1", "35", "", 1), ("P1", "0.5", "", 2), ("P2", "", "", 3)], "product_id string, gross_margin_rate string, category string, ord int")
    rows = {r["product_id"]: r for r in ingest.normalise_master(raw).collect()}
    assert rows["P1"]["gross_margin_rate"] == 0.5 and rows["P2"]["gross_margin_rate"] is None and rows["P2"]["category"] == "UNKNOWN" and rows["P2"]["other_promo_cost_rate"] == 0.0


def test_rows_of_one_run_are_ordered_within_their_key(spark, tmp_path):
    store, schema = StateStore(spark, f"{tmp_path}/state"), STATE_TABLES["applied_settings"]
    rows = spark.createDataFrame([("rakuten", "ITEM", p, "", cpc, "ACTIVE", datetime(2026, 7, 1), "BASE", "run_1") for p, cpc in (("P1", 35.0), ("P1", 36.0), ("P2", 1.0))], schema)
    store.append("applied_settings", rows)
    store.append("applied_settings", rows.where("applied_cpc = 35"))
    found = store.read("applied_settings")
    assert [(r["ord"], r["applied_cpc"]) for r in found.where("product_id = 'P1'").orderBy("ord").collect()] == [(1, 35.0), (2, 36.0), (3, 35.0)]
    assert {r["product_id"]: r["state_applied_cpc"] for r in state.latest_applied(found).collect()} == {"P1": 35.0, "P2": 1.0}


def test_download_files(spark):
    row = spark.createDataFrame([("S1", "x")], "product_id string, note string")
    setting = spark.createDataFrame([("u", "S1", "名", "1", "u", "30", "", "", "")], "control string, product_id string, product_name string, price string, url string, item_cpc string, keyword string, keyword_cpc string, guide_cpc string")
    found = sinks.download_files(row, row, row, {"item_full": setting})
    assert set(found) == {"decision_detail.csv", "upload_validation.csv", "review.csv", "item_full.csv"}
    assert found["review.csv"].startswith(b"\xef\xbb\xbf") and "名" in found["item_full.csv"].decode("cp932")


def test_command_line_without_settings_master_and_state(spark, inputs, capsys):
    """Then from its own ZIP with settings: setting files as the marketplace takes them, byte by byte."""
    root, write = inputs
    write("more/k.csv", REPORT, "cp932")
    arguments = ["--reports", f"{root}/reports/a.csv", f"{root}/more/k.csv", "--out-dir"]
    runner.main([*arguments, f"{root}/first", "--as-of", "2026-07-10T00:00:00"])
    profile = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert profile["rows"] == 2 and json.loads((root / f"first/run_profile_{profile['run_id']}.json").read_text()) == profile
    names = {p.name for p in (root / "first").iterdir()}
    state_zip = f"state_bundle_{profile['run_id']}.zip"
    assert {state_zip, f"review_{profile['run_id']}.csv"} <= names and not any(n.startswith("item_full") for n in names)
    assert (root / f"first/decision_detail_{profile['run_id']}.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    write("settings/s.csv", SETTING.format(30).replace(",x,", ',"枕, ""大"" 😀",') + ",P9,,1,u,40,布団 収納,50,\r\n", "utf-8-sig")
    runner.main([*arguments, f"{root}/second", "--settings", f"{root}/settings", "--product-master", f"{root}/master", "--state", f"{root}/first/{state_zip}", "--as-of", "2026-07-11T00:00:00"])
    second = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert second["input_hash"] == profile["input_hash"] and second["run_id"] != profile["run_id"]
    found = (root / f"second/item_full_{second['run_id']}.csv").read_bytes()
    lines = found.split(b"\r\n")
    assert lines[0].decode("cp932") == "コントロールカラム,商品管理番号,商品名,価格,商品URL,商品CPC,キーワード,キーワードCPC,目安CPC"
    assert lines[1].decode("cp932").split(",P1,")[1].startswith('"枕, ""大"" ?",1000,https://example.com,') and lines[2].decode("cp932").startswith(",P9,,1,u,40,,,") and lines[3] == b""
    words = (root / f"second/keyword_full_{second['run_id']}.csv").read_bytes().decode("cp932").split("\r\n")
    assert words[1] == ",P9,,1,u,40,布団 収納,50,"
    with zipfile.ZipFile(root / f"second/state_bundle_{second['run_id']}.zip") as z:
        assert z.read("run_history.csv").decode().count("run_2026") == 2
    assert not [n for n in (root / "second").iterdir() if n.name.endswith(".parts")]


def test_files_of_many_parts_equal_small_ones(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'n{i} "q", 名😀 ', None if i % 3 else "") for i in range(200)], "a long, b string, `c d` string").repartition(5)
    for encoding in ("cp932", "utf-8-sig"):
        sinks.write_file(rows, f"{tmp_path}/{encoding}.csv", encoding, order=["a"])
        assert (tmp_path / f"{encoding}.csv").read_bytes() == sinks.csv_bytes(rows.orderBy("a"), encoding)
    sinks.write_file(rows.limit(0), f"{tmp_path}/none.csv", "cp932")
    assert (tmp_path / "none.csv").read_bytes() == b"a,b,c d\r\n"
