"""A whole run: reports, settings, master and carried state to decisions, outputs and the next state."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.operators import decide, graph, ingest, quality, reports, state, text, windows
from bidweave.plans import absorbed, current
from bidweave.schema import KEYS, Policy
from bidweave.session import written
from bidweave.sources.state_store import StateStore


@dataclass(frozen=True)
class Run:
    """Tables of a run, of which entities and decisions are written, and the scalars that its identity and gate are made of. base: the
    store's manifest that it was made from."""

    entities: DataFrame
    events: DataFrame
    decisions: DataFrame
    gate: DataFrame
    input_hash: str
    run_id: str
    duplicate: bool
    blocked: bool
    as_of: datetime
    base: int


def build(performance: DataFrame, settings: DataFrame, master: DataFrame, store: StateStore, policy: Policy, as_of: datetime) -> Run:
    """performance: deduplicated rows. settings and master: raw tables with ord. What later steps read more than once is written."""
    performance = written(performance, "performance")
    bad = quality.row_errors(performance).select("entity_key").distinct().withColumn("__bad", F.lit(True))
    rows = windows.analysis_windows(performance, policy).join(bad, "entity_key", "left")
    by_type = performance.groupBy("entity_type").agg(F.count("*").alias("rows"), F.count_if(quality.error_codes() != "").alias("row_errors"))
    return _decided(rows, by_type, performance.select("source_hash"), None, settings, master, store, store.number(), policy, as_of)


def build_from_state(store: StateStore, settings: DataFrame, master: DataFrame, policy: Policy, as_of: datetime) -> Run:
    """The run over all that the store has absorbed, from each entity's windows and the sums of products: no report is read again."""
    base = store.number()
    rows = absorbed.current_windows(store, base).withColumn("__bad", F.col("row_errors") > 0).drop("rows", "row_errors")
    sums = written(absorbed.product_sums(store, base), "product_sums")
    by_type = sums.groupBy("entity_type").agg(F.sum("rows").alias("rows"), F.sum("row_errors").alias("row_errors"))
    return _decided(rows, by_type, store.read("source_files", at=base).select("source_hash"), sums.drop("rows", "row_errors"), settings, master, store, base, policy, as_of)


def _decided(rows: DataFrame, by_type: DataFrame, files: DataFrame, products: DataFrame | None, settings: DataFrame, master: DataFrame, store: StateStore, base: int, policy: Policy, as_of: datetime) -> Run:
    """rows: windows with __bad. by_type: rows and errors by entity type. files: source_hash. products: sums by product, for the priors."""
    now = F.lit(as_of).cast("timestamp")
    runs = store.read("run_history", at=base)
    last = runs.orderBy(F.desc("ord"), F.desc("created_at")).limit(1).select(F.explode(F.array(F.struct(F.lit("ITEM").alias("entity_type"), F.col("item_rows").alias("rows")), F.struct(F.lit("KEYWORD").alias("entity_type"), F.col("keyword_rows").alias("rows")))).alias("r")).select("r.*")
    gate = quality.gate_of(by_type, policy, last)
    # One row each.
    verdict = gate.crossJoin(state.input_hash(files)).first()
    duplicate = bool(runs.where(F.col("input_hash") == verdict["input_hash"]).limit(1).count())
    run = state.run_id(verdict["input_hash"], policy, as_of)
    blocked = verdict["status"] == "BLOCK"

    # The state's sides lie in buckets of the keys; rows come to them once.
    for t in (*current.joined(store, base, as_of), ingest.setting_table(settings)):
        rows = rows.join(t, KEYS, "left")
    master = ingest.normalise_master(master)
    rows = ingest.with_master(rows, master).withColumn("row_quality_block", F.coalesce("__bad", F.lit(False)) | F.lit(blocked)).drop("__bad")
    rows = written(state.reconcile(rows, now), "entities")
    products = None if products is None else ingest.with_master(products, master)
    decided = decide.hold_duplicates(decide.with_hierarchy(decide.decisions(rows, policy, now, products)), duplicate)
    decided = written(decided.withColumns({"run_id": F.lit(run), "decision_id": F.concat_ws("|", F.lit(run), "entity_key"), "duplicate_input": F.lit(duplicate)}), "decided")
    return Run(rows, state.setting_events(rows), decided, gate, verdict["input_hash"], run, duplicate, blocked, as_of, base)


def answered(run: Run, answers: DataFrame | None = None) -> DataFrame:
    """Final decisions, with the operator's answers (decision_id, operator_action, operator_cpc, operator_reason) where there are any."""
    rows = run.decisions
    if answers is not None:
        new = answers.select("decision_id", *[F.col(c).alias(f"__{c}") for c in ("operator_action", "operator_cpc", "operator_reason")])
        rows = rows.join(new, "decision_id", "left")
        rows = rows.withColumns({c: F.coalesce(F.col(f"__{c}").cast(rows.schema[c].dataType), F.col(c)) for c in ("operator_action", "operator_cpc", "operator_reason")}).drop("__operator_action", "__operator_cpc", "__operator_reason")
    return decide.finalise(rows, blocked=run.blocked)


def carried(store: StateStore, run_id: str) -> bool:
    """Whether a run's state is in the store."""
    return store.manifest()["marks"].get("run") == run_id or bool(store.read("run_history").where(F.col("run_id") == run_id).limit(1).count())


def carry(run: Run, final: DataFrame, store: StateStore, policy: Policy) -> bool:
    """Makes the next state visible at once: new rows of each table, and open plans and actions with what has become of them.

    A run whose state is there already changes nothing, and the answer is False. Should another run have committed since this one
    was built, ConcurrentCommit is raised: its decisions were made from a state that is no more.
    """
    if carried(store, run.run_id):
        return False
    tables = store.transaction(base=run.base)
    tables.update("planned_settings", lambda rows: state.update_plans(rows, run.events))
    tables.update("action_history", lambda rows: state.update_actions(rows, run.events))
    new = state.new_state(final, run.events, run.gate, policy, run=run.run_id, hash_of_input=run.input_hash, as_of=run.as_of, duplicate=run.duplicate)
    for name, rows in new.items():
        tables.append(name, rows)
    current.merge(tables, run.events, run.as_of)
    tables.mark("run", run.run_id).commit()
    return True


def graphs(decided: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Nodes and edges of the three graphs of a run: products with keywords, keywords by likeness, products by likeness."""
    links = written(graph.bipartite_edges(decided), "edges")
    nodes = graph.product_nodes(links, decided).unionByName(graph.keyword_nodes(links), allowMissingColumns=True)
    nodes = nodes.join(graph.graph_metrics(nodes, links), "node_id").join(graph.weighted_degree(links), "node_id", "left")
    alike = written(graph.product_similarity_edges(decided), "edges")
    products = graph.both_ways(alike).select("node_id").distinct()
    return {"network": (nodes, links), "keywords": graph.keyword_similarity_graph(decided), "products": (products.join(graph.graph_metrics(products, alike), "node_id"), alike)}


def main(argv: list[str] | None = None) -> None:
    """Reports, and settings, master and state where there are any; decisions, validation, setting files, graphs, profile and state out."""
    from bidweave.schema import MASTER_COLUMNS, SETTING_ROW
    from bidweave.session import scratch, ship
    from bidweave.sources.files import read_master, read_performance, read_settings
    from bidweave.sources.sinks import profile_json, write_csv, write_file, write_graph, write_settings
    from bidweave.sources.state_store import from_zip, to_zip

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--reports", required=True, nargs="+", help="report files or folders")
    p.add_argument("--settings", "--setting", help="a settings file or folder; without it no setting files are written")
    p.add_argument("--product-master", help="a product master; without it all products have its defaults")
    p.add_argument("--state", help="a state store, or a ZIP of one; without it a run begins with nothing")
    p.add_argument("--out-dir", required=True)
    p.add_argument("--policy", help="a JSON file of policy values; else that of the ZIP, or the default")
    p.add_argument("--as-of", help="an ISO timestamp; now by default")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("bidweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    policy, zipped = Policy(), bool(a.state) and a.state.endswith(".zip")
    store = StateStore(spark, f"{a.out_dir}/state" if zipped or not a.state else a.state)
    if zipped:
        policy, _ = from_zip(store, Path(a.state).read_bytes())
    if a.policy:
        policy = Policy.from_dict(json.loads(Path(a.policy).read_text()))
    as_of = datetime.fromisoformat(a.as_of) if a.as_of else datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
    with scratch(spark):
        performance = read_performance(spark, a.reports)
        settings = read_settings(spark, a.settings) if a.settings else spark.createDataFrame([], SETTING_ROW)
        master = read_master(spark, a.product_master) if a.product_master else spark.createDataFrame([], MASTER_COLUMNS)
        run = build(performance, settings, master, store, policy, as_of)
        final = written(answered(run), "final")
        flat = [c for c, t in final.dtypes if not t.startswith(("array", "struct", "map"))]
        checked = decide.upload_validation(final).select(*KEYS, "current_bid", "final_cpc", "final_approved", "final_changed", "upload_match", "upload_eligible", "operator_action", "decision_status", "reason_code", "upload_validation_status")
        tables = {"decision_detail": final.select(*flat), "upload_validation": checked, "review": decide.review_table(final)}
        for name, rows in tables.items():
            write_csv(rows, f"{a.out_dir}/{name}")
            write_file(rows, f"{a.out_dir}/{name}_{run.run_id}.csv", order=KEYS)
        if a.settings:
            outputs = decide.full_outputs(settings, final)
            for name, rows in outputs.items():
                write_csv(rows, f"{a.out_dir}/{name}")
            write_settings(outputs, a.out_dir, run.run_id)
        terms = text.term_frequency(text.with_terms(run.decisions.where("entity_type = 'KEYWORD'")))
        for name, (nodes, edges) in graphs(run.decisions).items():
            write_graph(f"{a.out_dir}/{name}", nodes, edges, terms if name == "network" else None)
        profile = profile_json(reports.run_profile(final), reports.status_counts(final), run_id=run.run_id, input_hash=run.input_hash)
        carry(run, final, store, policy)
    out = Path(a.out_dir)
    (out / f"run_profile_{run.run_id}.json").write_text(profile)
    if zipped or not a.state:
        (out / f"state_bundle_{run.run_id}.zip").write_bytes(to_zip(store, policy, {"last_run_id": run.run_id}))
    print(profile)


if __name__ == "__main__":
    main()
