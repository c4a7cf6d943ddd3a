"""State that reports are absorbed into as they come, so that decisions need no report twice and don't depend on how they came.

Kept in the store: every entity's snapshots, its windows as they are now, partial sums of each product's windows, and the files
that were seen. New rows touch their own entities alone: these get their windows anew from their snapshots, and what has changed
of their figures is added to their products' sums. Priors of groups are sums of those, with the master as it is when it is asked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.functions.columns import spread
from bidweave.operators import ingest, quality, windows
from bidweave.operators.windows import METRICS, SNAPSHOT
from bidweave.schema import KEYS, PERFORMANCE, Policy
from bidweave.sources.state_store import StateStore, Transaction

_TYPES = dict(f.split(" ") for f in PERFORMANCE.split(", "))
PRODUCT = ["platform", "entity_type", "product_id"]
#: What is added up for a product: its windows' figures for the priors, and its rows for the gate.
SUMS = ["clicks", "orders_attr", "sales_attr", "rows", "row_errors"]


def _fields(names: list[str], suffix: str = "") -> list[str]:
    return [f"{n}{suffix} {_TYPES[n]}" for n in names]


_RATIOS = ["cvr_attr", "roas_attr_pct", "aov_attr"]
STORE_TABLES = {
    "snapshots": PERFORMANCE.replace("ord long", "source_ord long"),
    "entity_windows": ", ".join(
        [*_fields([*KEYS, "entity_key"]), *_fields(SNAPSHOT, "_shortwin"), *_fields(SNAPSHOT, "_longwin"), "trend_available boolean", *_fields(METRICS), *_fields(METRICS, "_long"),
         *[f"{r}{s} double" for s in ("", "_long") for r in _RATIOS], "rows long", "row_errors long"]
    ),
    "product_sums": ", ".join([*_fields(PRODUCT), "clicks double", "orders_attr double", "sales_attr double", "rows long", "row_errors long"]),
    "source_files": "source_hash string",
}


def open_store(spark: SparkSession, path: str) -> StateStore:
    """A store of the runs' state that also holds what is absorbed."""
    return StateStore(spark, path, STORE_TABLES)


def with_tables(store: StateStore) -> StateStore:
    """The store with the tables of what is absorbed."""
    return store if STORE_TABLES.keys() <= store.schemas.keys() else open_store(store.spark, store.path)


def snapshots(store: StateStore, at: int | None = None) -> DataFrame:
    """All rows absorbed so far, an entity once in a snapshot."""
    return ingest.dedupe_snapshots(store.read("snapshots", at=at).drop("ord").withColumnRenamed("source_ord", "ord"))


def entity_state(performance: DataFrame, policy: Policy) -> DataFrame:
    """Windows of entities with the numbers of their rows and of those with errors. performance: deduplicated rows."""
    return windows.analysis_windows(performance, policy, F.count("*").alias("rows"), F.count_if(quality.error_codes() != "").alias("row_errors"))


def absorb(rows: DataFrame, store: StateStore, policy: Policy, *, mark: tuple[str, int] | None = None) -> int:
    """Takes performance rows into the state in one transaction; the number of the manifest that has them.

    rows: of any reports, in any order; a row that was given before, however long ago, is left out, and of a snapshot's rows
    for an entity the last by ord counts. mark: a
    name and a rising number, such as a stream's micro-batch: what was absorbed under it or a later one isn't absorbed again.
    """
    base = store.number()
    if mark is not None and store.manifest(base)["marks"].get(mark[0], -1) >= mark[1]:
        return base
    columns = [f.split(" ")[0] for f in PERFORMANCE.split(", ")]
    given, known = rows.select(*columns).withColumnRenamed("ord", "source_ord"), store.read("snapshots", at=base)
    place = ("entity_key", "snapshot_id", "source_ord")
    # Of any age: what is there already is not kept twice.
    there = known.select(spread(*place).alias("__there"), *[F.col(c).alias(f"__{c}") for c in place])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place], spread(*place) == F.col("__there"))
    tables = store.transaction(base=base).append("snapshots", given.join(there, same, "left_anti"), ranked=False)
    if tables.appended["snapshots"]:
        _follow(tables, known, store.read("source_files", at=base), policy)
    if mark is not None:
        tables.mark(*mark)
    return tables.commit()


def _follow(tables: Transaction, known: DataFrame, files: DataFrame, policy: Policy) -> None:
    """Windows, sums and files after the snapshots that the transaction has added; entities without new rows stay as they are.

    What it has written is read from there, so it is made once. known and files: the tables before.
    """
    new, was = tables.added("snapshots"), tables.rows("entity_windows")
    keys = new.select(spread("entity_key").alias("__touched"), F.col("entity_key").alias("__entity"))

    def touched(rows: DataFrame) -> DataFrame:
        return rows.join(keys, (spread("entity_key") == F.col("__touched")) & F.col("entity_key").eqNullSafe(F.col("__entity")), "left_semi")

    together = touched(known).unionByName(new).drop("ord").withColumnRenamed("source_ord", "ord")
    tables.append("entity_windows", entity_state(ingest.dedupe_snapshots(together.repartition("entity_key")), policy), ranked=False)
    # The figures are picked one by one, as numbers: sums need no more of the windows.
    last = touched(was.select(*KEYS, "entity_key", *SUMS, "ord")).groupBy(*KEYS, "entity_key").agg(*[F.max_by(c, "ord").alias(c) for c in SUMS])

    def signed(part: DataFrame, sign: int) -> DataFrame:
        return part.select(*PRODUCT, *[(F.coalesce(c, F.lit(0)) * sign).alias(c) for c in SUMS])

    change = signed(tables.added("entity_windows"), 1).unionByName(signed(last, -1)).groupBy(*PRODUCT).agg(*[F.sum(c).alias(c) for c in SUMS])
    tables.append("product_sums", change.where(" OR ".join(f"{c} <> 0" for c in SUMS)), ranked=False)
    tables.append("source_files", new.select("source_hash").where("source_hash IS NOT NULL").distinct().join(files, "source_hash", "left_anti"))


def current_windows(store: StateStore, at: int | None = None) -> DataFrame:
    """An entity's windows as they are now: the last of what was written of it. Rows are moved once, without columns that nobody asks for."""
    rows = store.read("entity_windows", at=at)
    order = Window.partitionBy("__spread", "entity_key", *KEYS).orderBy(F.desc("ord"))
    last = rows.repartition("entity_key").withColumn("__spread", spread("entity_key")).withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return last.select(*KEYS, "entity_key", *[c for c in rows.columns if c not in (*KEYS, "entity_key", "ord")])


def product_sums(store: StateStore, at: int | None = None) -> DataFrame:
    """Sums over the windows of each product's entities, of one kind, with their rows and errors: all changes so far added up."""
    return store.read("product_sums", at=at).groupBy(*PRODUCT).agg(*[F.sum(c).alias(c) for c in SUMS])


def compact(store: StateStore) -> None:
    """Tables of many folders as one, without what later rows have replaced. What is read stays the same."""
    columns = [f.split(" ")[0] for f in PERFORMANCE.split(", ")]
    store.compact("snapshots", lambda rows: ingest.dedupe_snapshots(rows.withColumnsRenamed({"ord": "__o", "source_ord": "ord"})).select(*columns, "__o").withColumnsRenamed({"ord": "source_ord", "__o": "ord"}))
    store.compact("entity_windows", lambda rows: rows.groupBy(*KEYS, "entity_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*KEYS, "entity_key")]), "ord").alias("last")).select(*KEYS, "entity_key", "last.*"))
    store.compact("product_sums", lambda rows: rows.groupBy(*PRODUCT).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("ord").alias("ord")))
    store.compact("source_files", lambda rows: rows.groupBy("source_hash").agg(F.max("ord").alias("ord")))
