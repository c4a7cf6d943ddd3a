import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidweave.functions import columns as c
from bidweave.operators import decide, graph, reports, text
from bidweave.sources import sinks

#: A lamp with two phrases, of which a chair shares one.
ROWS = [
    ("ITEM", "L-1", "卓上ランプ 調光", "", 9000.0, 60.0, 1500.0, 9.0, 600.0, 700.0, "照明", "家具", 41.0, 45, "SCALE_UP", "SCALE_UP_REVIEW_REQUIRED"),
    ("ITEM", "C-2", "木製チェア", "", 4000.0, 50.0, 2000.0, 2.0, 200.0, -300.0, "椅子", "家具", 52.0, 40, "SCALE_DOWN", "SCALE_DOWN_AUTO_READY"),
    ("KEYWORD", "L-1", "卓上ランプ 調光", "ランプ 調光", 5000.0, 30.0, 800.0, 5.0, 625.0, 400.0, "照明", "家具", 41.0, 46, "SCALE_UP", "SCALE_UP_REVIEW_REQUIRED"),
    ("KEYWORD", "L-1", "卓上ランプ 調光", "北欧 家具", 3000.0, 20.0, 500.0, 3.0, 600.0, 90.0, "照明", "家具", 41.0, 41, "KEEP", "KEEP"),
    ("KEYWORD", "C-2", "木製チェア", "北欧 家具", 1000.0, 25.0, 900.0, 1.0, 111.0, -200.0, "椅子", "家具", 52.0, 36, "SCALE_DOWN", "SCALE_DOWN_AUTO_READY"),
]
SCHEMA = "entity_type string, product_id string, product_name string, keyword string, sales_attr double, clicks double, cost double, orders_attr double, roas_attr_pct double, expected_incremental_profit double, category string, product_group string, current_bid double, recommended_cpc int, action string, decision_status string"


@pytest.fixture(scope="module")
def decided(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_phrases_and_terms(spark):
    df = spark.createDataFrame([(" 布団　収納袋 ",), ("立てて収納できる布団収納袋",), ("ＡＢＣ-abc　(new)",), (None,), ("a bc cm def bc",)], "t string")
    rows = df.select(text.phrase(F.col("t")).alias("p")).select("p", text.terms(F.col("p")).alias("terms")).collect()
    assert rows[0]["p"] == "布団 収納袋" and rows[0]["terms"] == ["布団", "収納袋"]
    assert rows[1]["terms"][0] == "立てて収納できる布団収納袋" and "布団収" in rows[1]["terms"] and len(rows[1]["terms"]) == 11 and "できる" not in rows[1]["terms"]
    assert rows[2]["p"] == "abc abc new" and rows[2]["terms"] == ["abc"]
    assert rows[3]["p"] == "" and rows[3]["terms"] == []
    assert rows[4]["terms"] == ["bc", "def"]


def test_tfidf_against_its_formula(spark):
    docs = {1: "abab", 2: "abc", 3: "x", 4: ""}
    got = {(r["id"], r["gram"]): r["weight"] for r in text.tfidf(spark.createDataFrame(list(docs.items()), "id int, text string")).collect()}
    counts = {i: {} for i in docs}
    for i, t in docs.items():
        for n in (2, 3, 4):
            for k in range(len(t) - n + 1):
                counts[i][t[k : k + n]] = counts[i].get(t[k : k + n], 0) + 1
    for i, grams in counts.items():
        raw = {g: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + sum(g in c for c in counts.values()))) + 1) for g, n in grams.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        for g, w in raw.items():
            assert got[i, g] == pytest.approx(w / norm)
    assert len(got) == sum(map(len, counts.values()))


def test_similarity_is_symmetric_and_paired(spark):
    pairs = spark.createDataFrame([(1, "abc def", "abc def"), (2, "abc", "xyz"), (3, "", "a")], "id int, left string, right string")
    assert {r["id"]: round(r["similarity"], 9) for r in text.paired_similarity(pairs).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_bipartite_graph(decided):
    edges = graph.bipartite_edges(decided)
    rows = {(r["source"], r["target"]): r for r in edges.collect()}
    assert {k: r["edge_value"] for k, r in rows.items()} == {("P|L-1", "K|ランプ 調光"): 5000.0, ("P|L-1", "K|北欧 家具"): 3000.0, ("P|C-2", "K|北欧 家具"): 1000.0}
    assert rows["P|C-2", "K|北欧 家具"]["layout_weight"] == pytest.approx(0.25 + 2.75 * math.log(1001) / math.log(5001))
    assert rows["P|L-1", "K|ランプ 調光"]["semantic_relevance"] > 0.3 and rows["P|C-2", "K|北欧 家具"]["semantic_relevance"] == 0
    products = {r["node_id"]: r for r in graph.product_nodes(edges, decided).collect()}
    assert products["P|L-1"]["value"] == 9000.0 and products["P|L-1"]["action"] == "SCALE_UP" and products["P|C-2"]["label"] == "木製チェア"
    keywords = {r["node_id"]: r for r in graph.keyword_nodes(edges).collect()}
    assert keywords["K|北欧 家具"]["product_count"] == 2 and keywords["K|北欧 家具"]["value"] == 4000.0 and keywords["K|北欧 家具"]["action"] == "KEEP"
    assert graph.bipartite_edges(decided, selected=["C-2"]).count() == 1 and graph.bipartite_edges(decided, min_value=2000).count() == 2 and graph.bipartite_edges(decided.limit(0)).count() == 0
    assert {r["node_id"]: r["degree"] for r in graph.weighted_degree(edges).collect()} == {"P|L-1": 2, "P|C-2": 1, "K|ランプ 調光": 1, "K|北欧 家具": 2}


def test_full_width_phrases_are_one_keyword(decided):
    wide = decided.where("product_id = 'L-1' AND keyword = 'ランプ 調光'").withColumn("keyword", F.lit("ﾗﾝﾌﾟ／調光"))
    edges = graph.bipartite_edges(decided.unionByName(wide))
    assert {r["target"]: r["edge_value"] for r in edges.where("source = 'P|L-1'").collect()} == {"K|ランプ 調光": 10000.0, "K|北欧 家具": 3000.0}


def test_similarity_graphs(decided):
    nodes, edges = graph.keyword_similarity_graph(decided, threshold=0.1)
    assert {r["keyword"] for r in nodes.collect()} == {"ランプ 調光", "北欧 家具"} and edges.count() == 0
    [e] = graph.product_similarity_edges(decided).collect()
    assert (e["source"], e["target"], e["shared_keyword_jaccard"], e["name_similarity"]) == ("P|C-2", "P|L-1", 0.5, 0.0)


def test_similar_pairs_are_those_of_all_pairs(spark):
    """Candidates by rare n-grams alone miss no pair, whatever the threshold."""
    rng = random.Random(3)
    names = sorted({" ".join(rng.choices(["steel", "bolt", "brass", "nut", "blue", "box", "bolts", "aa"], k=rng.randint(1, 4))) for _ in range(60)})
    vectors = text.tfidf(spark.createDataFrame([(n, n) for n in names], "id string, text string")).persist()
    of: dict[str, dict[str, float]] = {n: {} for n in names}
    for r in vectors.collect():
        of[r["id"]][r["gram"]] = r["weight"]
    for least in (0.2, 0.5, 0.9):
        expected = {(a, b) for a in names for b in names if a < b and sum(w * of[b].get(g, 0.0) for g, w in of[a].items()) >= least}
        assert {(r["left"], r["right"]) for r in text.cosine_pairs(vectors, least).collect()} == expected and expected


def test_terms_of_a_tokenizer(spark):
    """Only words, verbs and adjectives that are no numbers, stop terms or single letters; else the phrase's own terms."""
    spoken = {"木 の 椅子 7 人気": [("木", "名詞"), ("の", "助詞"), ("椅子", "名詞"), ("77", "名詞"), ("人気", "名詞"), ("座る", "動詞"), ("椅子", "名詞"), ("a*b", "名詞")], "ok yes": [("の", "助詞")]}
    rows = spark.createDataFrame([(k,) for k in spoken], "keyword string")
    got = {r["keyword"]: (r["terms"], r["term_count"]) for r in text.with_terms(rows, tokenizer=spoken.__getitem__).collect()}
    assert got == {"木 の 椅子 7 人気": (["椅子", "座る"], 2), "ok yes": (["ok", "yes"], 2)}


def test_decision_view_and_order(decided):
    keys = decided.withColumn("entity_key", F.concat_ws("|", "product_id", "keyword"))
    assert [r["entity_key"] for r in decide.decision_view(keys, entity_types=["KEYWORD"], least_profit=0.0).collect()] == ["L-1|ランプ 調光", "L-1|北欧 家具"]
    assert [r["product_id"] for r in decide.decision_view(keys, text=" c-2 ").collect()] == ["C-2", "C-2"] and decide.decision_view(keys, text="%").count() == 0
    assert decide.decision_view(keys, statuses=[]).count() == 0 and decide.decision_view(keys).count() == 5
    assert [r["entity_key"] for r in keys.orderBy(*decide.decision_order()).collect()] == ["L-1|北欧 家具", "C-2|北欧 家具", "C-2|", "L-1|", "L-1|ランプ 調光"]


def test_exports(decided, tmp_path):
    edges = graph.bipartite_edges(decided)
    sinks.write_graph(str(tmp_path), graph.keyword_nodes(edges), edges, text.with_terms(decided).select("keyword", "terms"))
    assert decided.sparkSession.read.option("header", True).csv(f"{tmp_path}/edges").count() == 3 and (tmp_path / "nodes").is_dir() and (tmp_path / "terms").is_dir()


def bridges(nodes, links):
    """Betweenness from all shortest paths between every two nodes, listed one by one."""
    near = {n: {} for n in nodes}
    for a, b, w in links:
        near[a][b] = near[b][a] = 1 / w
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        paths = []
        stack = [([s], 0.0)]
        while stack:
            path, length = stack.pop()
            if path[-1] == t:
                paths.append((length, path))
                continue
            stack += [([*path, n], length + d) for n, d in near[path[-1]].items() if n not in path]
        shortest = [p for d, p in paths if d <= min(x for x, _ in paths) + 1e-9]
        for p in shortest:
            for n in p[1:-1]:
                score[n] += 1 / len(shortest)
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2) / 2) for k, v in score.items()}


def test_bridges_against_all_paths(spark):
    rng = random.Random(5)
    nodes = list("abcdefgh")
    links = [(a, b, rng.choice([0.5, 1.0, 2.0])) for a, b in itertools.combinations(nodes[:7], 2) if rng.random() < 0.4]
    edges = spark.createDataFrame(links, "source string, target string, layout_weight double")
    found = graph.graph_metrics(spark.createDataFrame([(n,) for n in nodes], "node_id string"), edges, layout=False)
    assert {r["node_id"]: r["bridge_score"] for r in found.collect()} == pytest.approx(bridges(nodes, links)) and found.columns == ["node_id", "bridge_score", "community"]
    ranked = graph.top_bridges(found.join(graph.weighted_degree(edges), "node_id", "left"), 3)
    assert [r["bridge_score"] for r in ranked.collect()] == pytest.approx(sorted(bridges(nodes, links).values(), reverse=True)[:3])


def test_metrics_of_a_small_graph(spark):
    """Two triangles joined by one edge: the ends of that edge are the bridges, and each triangle is a community."""
    links = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    edges = spark.createDataFrame([(x, y, 1.0) for x, y in links], "source string, target string, layout_weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node_id string")
    got = {r["node_id"]: r for r in graph.graph_metrics(nodes, edges).collect()}
    assert got["c"]["bridge_score"] == got["d"]["bridge_score"] == pytest.approx(6 / 15) and got["a"]["bridge_score"] == got["g"]["bridge_score"] == 0
    assert [got[x]["community"] for x in "abcdefg"] == [0, 0, 0, 1, 1, 1, 2]
    parts = {r["node_id"]: r["component"] for r in graph.connected_components(nodes, edges).collect()}
    assert parts == {**dict.fromkeys("abcdef", "a"), "g": "g"}
    assert all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in got.values())


def test_payload_summary_and_neighbourhood(decided):
    edges = graph.bipartite_edges(decided, relevance=False).persist()
    nodes = graph.product_nodes(edges, decided).unionByName(graph.keyword_nodes(edges), allowMissingColumns=True)
    nodes = nodes.join(graph.graph_metrics(nodes, edges), "node_id").join(graph.weighted_degree(edges), "node_id").persist()
    total = graph.summary(nodes, edges)
    s = total.first()
    assert (s["products"], s["keywords"], s["edges"], s["density"], s["top10_share_pct"]) == (2, 2, 3, 0.5, 100.0)
    of = {r["node_id"]: r for r in nodes.collect()}
    largest = max(sum(r["value"] for r in of.values() if r["community"] == c) for c in {r["community"] for r in of.values()})
    assert s["clusters"] == len({r["community"] for r in of.values()}) and s["largest_cluster_share_pct"] == pytest.approx(largest / 22000 * 100)
    found = json.loads(graph.payload(nodes.select("node_id", "label", "value"), edges.select("source", "target", "edge_value"), total).first()["payload"])
    assert {n["id"]: n["value"] for n in found["nodes"]} == {k: r["value"] for k, r in of.items()} and len(found["edges"]) == 3 and found["summary"]["edges"] == 3
    whole = json.loads(graph.payload(nodes, edges, total, graph_kind="bipartite", target_roas_pct=300.0).first()["payload"])
    by_id = {n["id"]: n for n in whole["nodes"]}
    for node_id, r in of.items():
        n, product = by_id[node_id], r["node_type"] == "PRODUCT"
        assert (n["type"], n["label"], n["sales"]) == (r["node_type"], r["product_id"] if product else r["keyword"], r["sales_attr"])
        assert (n["action"], n["degree"], n["x"], n["y"]) == (decided.select(c.action_class(F.lit(r["action"]), F.lit(r["decision_status"]))).first()[0], r["weighted_degree"], r["x"], r["y"])
        assert isinstance(n["x"], float) and n["productCount"] == (0 if product else r["product_count"]) and n["recommendedCpc"] == (r["recommended_cpc"] or 0)
    assert by_id["P|L-1"]["label"] == "L-1" and (whole["graphKind"], whole["targetRoasPct"], whole["metric"]) == ("bipartite", 300.0, "sales_attr")
    # Edges of which an end is no node are left out; odd numbers are zeros; markup can't end a script.
    few = nodes.where("node_id <> 'K|北欧 家具'").withColumns({"value": F.lit(float("nan")), "full_label": F.lit("</script>"), "keyword": F.lit(""), "product_id": F.lit(None).cast("string")})
    text = graph.payload(few, edges, total).first()["payload"]
    part = json.loads(text)
    assert "</" not in text and all(e["target"] != "K|北欧 家具" for e in part["edges"]) and 0 < len(part["edges"]) < 3
    assert all(n["value"] == 0.0 and n["label"] == "</script>" for n in part["nodes"])
    assert {r["node_id"]: r["hit"] for r in graph.neighbourhood(nodes, edges, "ランプ").collect()} == {"P|L-1": True, "K|ランプ 調光": True, "K|北欧 家具": False}
    assert graph.ego(edges, "K|北欧 家具", most=1).first()["source"] == "P|L-1" and graph.ego(edges, graph.leading(edges)).count() == 2
    assert graph.top_entities(nodes, "KEYWORD", 1).count() == 1


def ranks(values):
    return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]


def test_reports(spark, decided):
    k = reports.kpis(decided).first()
    assert (k["clicks"], k["cost"], round(k["roas_attr_pct"], 4)) == (110.0, 3500.0, round(13000 / 3500 * 100, 4))
    assert reports.kpis(decided.where("entity_type = 'KEYWORD'")).first()["clicks"] == 75.0 and reports.kpis(decided.limit(0)).first()["cvr_attr"] == 0.0
    top = reports.category_rollup(decided).where("level = 3").first()
    assert top["value"] == 13000.0
    assert {r["product_id"]: round(r["sales_share_pct"], 4) for r in reports.top_products(decided).collect()} == {"L-1": 69.2308, "C-2": 30.7692}
    assert sum(r["share_pct"] for r in reports.status_counts(decided).collect()) == pytest.approx(100)
    constant = decided.withColumn("flat", F.lit(1.0))
    rho = {(r["left"], r["right"]): r["rho"] for r in reports.spearman(constant, ["clicks", "cost", "flat"]).collect()}
    assert rho["clicks", "clicks"] == pytest.approx(1) and rho["flat", "flat"] == 0 and rho["clicks", "cost"] == rho["cost", "clicks"]


def test_rank_correlation_with_ties_and_nulls(spark):
    """Over many ranges, with a value that half of the rows share, against ranks by definition."""
    rng = random.Random(9)
    rows = [(float(rng.choice([0, 0, 0, rng.randint(-50, 50)])), None if rng.random() < 0.1 else rng.gauss(0, 1) * 10 ** rng.randint(-3, 3)) for _ in range(400)]
    found = {(r["left"], r["right"]): r["rho"] for r in reports.spearman(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    both = [(a, b) for a, b in rows if b is not None]
    x, y = ranks([a for a, _ in both]), ranks([b for _, b in both])
    assert found["a", "b"] == pytest.approx(float(np.corrcoef(x, y)[0, 1])) and found["b", "b"] == pytest.approx(1) and len(found) == 4


def test_numbers_and_texts(spark):
    raw = ["1,234円", "12.5%", "－", "-", "", None, "nan", "1d", "inf", " 7　", "-3", "1e2", ".5"]
    rows = spark.createDataFrame([(x,) for x in raw], "t string").select(c.clean_number(F.col("t")), c.clean_text(F.col("t"))).collect()
    assert [r[0] for r in rows] == [1234.0, 12.5, None, None, None, None, None, None, None, 7.0, -3.0, 100.0, 0.5]
    assert rows[5][1] == "" and rows[9][1] == "7"
    classes = spark.createDataFrame([("SCALE_UP", ""), ("", "PARENT_STOP_REVIEW"), (None, "HOLD_X"), ("OBSERVE", None), (None, None), ("keep", "")], "a string, s string").select(c.action_class(F.col("a"), F.col("s")))
    assert [r[0] for r in classes.collect()] == ["SCALE_UP", "STOP", "KEEP", "OBSERVE", "NEUTRAL", "KEEP"]
