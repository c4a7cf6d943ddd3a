"""The state tables of runs, changed by atomic transactions; and as a ZIP of CSV files for exchange.

A store is a folder of immutable Parquet folders and of numbered manifests. A manifest names the folders of each table, is
written last, and is never changed: a reader sees the tables of one manifest, and a writer that dies leaves folders that none
names. Two writers that start from the same manifest both want the next number, which only one of them gets.
"""

from __future__ import annotations

import io
import json
import time
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.schema import CURRENT_TABLES, KEYS, STATE_TABLES, Policy

#: A ZIP is for exchange with people: larger tables stay in the store.
MOST_ROWS = 200_000
#: Of tables whose rows change: the rows that still can. They lie in folders of their own, so an update leaves all others alone.
OPEN = {"planned_settings": "upper(planned_status) = 'PENDING'", "action_history": "outcome_status = 'PLANNED'"}
#: A table of more folders than this is written anew as one by `compact`.
MOST_FOLDERS = 64


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since this transaction's start; what it was made from is no longer the state."""


class _Files:
    """The few file operations of a store, by Hadoop's file system of its path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = self.path(root)
        self.system = self.root.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        there = self.path(folder)
        return sorted(f.getPath().getName() for f in self.system.listStatus(there)) if self.system.exists(there) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes a file that nobody can see in part; False if there is one of that name."""
        hidden = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.system.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        try:
            # Without the option to overwrite, a file system refuses a name that is taken.
            context.rename(self.system.makeQualified(hidden), self.system.makeQualified(self.path(name)), self.gateway.new_array(getattr(fs, "Options$Rename"), 0))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            self.system.delete(hidden, False)
            return False

    def qualified(self, name: str) -> str:
        """The path with its file system, as catalogs take it."""
        return self.system.makeQualified(self.path(name)).toString()

    def age(self, name: str) -> float:
        """Seconds since the last change."""
        return time.time() - self.system.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def table_name(name: str, folder: str) -> str:
    """Of a bucketed folder in the session's catalog."""
    return f"bidweave_{name}_{folder}"


class StateStore:
    """Tables under a path: those of the state, and more by name and schema. Rows have ord, the order of their arrival."""

    def __init__(self, spark: SparkSession, path: str, more: dict[str, str] | None = None):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), {**STATE_TABLES, **CURRENT_TABLES, **(more or {})}
        self.files = _Files(spark, self.path)

    def number(self) -> int:
        """Of the last manifest; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.number() if number is None else number
        return json.loads(self.files.read(f"{self.path}/manifests/{number:012d}.json")) if number else {"number": 0, "tables": {}, "marks": {}}

    def version(self, name: str) -> int:
        """How often the table has been replaced, its first rows included; 0 if it has none."""
        return self.manifest()["tables"].get(name, {}).get("version", 0)

    def columns(self, name: str) -> list[str]:
        return [f.split(" ")[0] for f in self.schemas[name].split(", ")]

    def read(self, name: str, *, at: int | None = None, part: str | None = None) -> DataFrame:
        """The table's rows as of a manifest, the last by default; part: `open` or `closed` rows alone. Empty if there are none yet."""
        return self._rows(name, self.manifest(at)["tables"].get(name, {}).get("folders", []), part)

    def _rows(self, name: str, folders: list[dict], part: str | None) -> DataFrame:
        schema = f"{self.schemas[name]}, ord long"
        if folders and folders[0].get("buckets"):
            return self._bucketed(folders[0], schema)
        paths = [f"{self.path}/{f['path']}" for f in folders if part is None or f["open"] == (part == "open")]
        if paths:
            return self.spark.read.schema(schema).parquet(*paths)
        # Empty by its plan, so that no task runs for it.
        return self.spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in (f.rsplit(" ", 1) for f in schema.split(", "))]).where(F.lit(False))

    def _bucketed(self, folder: dict, schema: str) -> DataFrame:
        """A folder of buckets as a table of the session's catalog, which is where Spark looks for how files are divided."""
        location, keys = self.files.qualified(f"{self.path}/{folder['path']}"), ", ".join(KEYS)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {folder['table']} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {folder['buckets']} BUCKETS LOCATION '{location}'")
        return self.spark.table(folder["table"])

    def transaction(self, *, base: int | None = None) -> Transaction:
        """Changes that become visible together. base: the manifest that they were made from; the last by default."""
        return Transaction(self, self.number() if base is None else base)

    def replace(self, name: str, rows: DataFrame) -> None:
        """The table's new rows; readers of the old ones are not disturbed."""
        self.transaction().replace(name, rows).commit()

    def append(self, name: str, rows: DataFrame) -> None:
        """More rows, in order after all that the table has."""
        self.transaction().append(name, rows).commit()

    def compact(self, name: str, rows: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> bool:
        """Writes a table of many folders as one, of the rows that the function keeps. Whether it had as many."""
        base = self.manifest()
        if len(base["tables"].get(name, {}).get("folders", [])) <= MOST_FOLDERS:
            return False
        self.transaction(base=base["number"]).replace(name, rows(self.read(name, at=base["number"])), again=True).commit()
        return True

    def vacuum(self, *, keep: int = 10, seconds: float = 86_400) -> int:
        """Deletes manifests before the last `keep`, and folders that no other names, unless changed within so many seconds; how many."""
        numbers = [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")]
        used = {f["path"].split("/open=")[0] for n in numbers[-keep:] for t in self.manifest(n)["tables"].values() for f in t["folders"]}
        old = [f"manifests/{n:012d}.json" for n in numbers[:-keep]] + [f"manifests/{n}" for n in self.files.names(f"{self.path}/manifests") if n.endswith(".tmp")]
        old += [f"{name}/{n}" for name in self.schemas for n in self.files.names(f"{self.path}/{name}") if f"{name}/{n}" not in used]
        old = [n for n in old if self.files.age(f"{self.path}/{n}") >= seconds]
        for n in old:
            if n.split("/")[0] in CURRENT_TABLES:
                self.spark.sql(f"DROP TABLE IF EXISTS {table_name(*n.split('/'))}")
            self.files.delete(f"{self.path}/{n}")
        return len(old)


class Transaction:
    """Changes of tables, each written to new folders at once, and named together by commit()."""

    def __init__(self, store: StateStore, base: int):
        self.store, self.base = store, base
        start = store.manifest(base)
        self.tables, self.marks = json.loads(json.dumps(start["tables"])), dict(start["marks"])
        self.appended: dict[str, list[dict]] = {}

    def rows(self, name: str, part: str | None = None) -> DataFrame:
        """The table with this transaction's changes so far."""
        return self.store._rows(name, self.tables.get(name, {}).get("folders", []), part)

    def replace(self, name: str, rows: DataFrame, *, again: bool = False) -> Transaction:
        """again: the same rows, so it is no new version."""
        version = self.tables.get(name, {}).get("version", 0)
        folders, top = self._write(name, rows if "ord" in rows.columns else rows.withColumn("ord", F.lit(0).cast("long")))
        self.tables[name] = {"version": version + (not again), "top": top or 0, "folders": folders}
        return self

    def append(self, name: str, rows: DataFrame, *, ranked: bool = True) -> Transaction:
        """More rows, after all that the table has; those of one key among themselves by their values.

        ranked: False where rows that come together need no order among themselves; they share a place, and aren't moved or sorted.
        """
        table = self.tables.setdefault(name, {"version": 1, "top": 0, "folders": []})
        keys = [k for k in KEYS if k in rows.columns]
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*sorted(c for c in rows.columns if c not in keys))) if keys and ranked else F.lit(1)
        folders, top = self._write(name, rows.withColumn("ord", F.lit(table["top"]) + place))
        table["folders"] += folders
        self.appended.setdefault(name, []).extend(folders)
        table["top"] = max(table["top"], top or 0)
        return self

    def added(self, name: str) -> DataFrame:
        """The rows that this transaction has appended to the table, as they were written."""
        return self.store._rows(name, self.appended.get(name, []), None)

    def put_bucketed(self, name: str, rows: DataFrame, buckets: int, of: str) -> Transaction:
        """The table's new rows, divided by KEYS into so many buckets. of: what they were made from."""
        folder, seen = uuid.uuid4().hex, Observation()
        rows = rows.select(*self.store.columns(name), F.col("ord").cast("long").alias("ord")).observe(seen, F.count(F.lit(1)).alias("rows"))
        path, table = f"{name}/{folder}", table_name(name, folder)
        rows.write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", self.store.files.qualified(f"{self.store.path}/{path}")).saveAsTable(table)
        version = self.tables.get(name, {}).get("version", 0)
        self.tables[name] = {"version": version + 1, "top": 0, "of": of, "folders": [{"path": path, "open": False, "rows": seen.get["rows"], "buckets": buckets, "table": table}]}
        return self

    def update(self, name: str, change: Callable[[DataFrame], DataFrame]) -> Transaction:
        """Rows that may still change, changed; those that this closes join the closed ones, which are not written anew."""
        table = self.tables.get(name)
        if table and any(f["open"] for f in table["folders"]):
            folders, _ = self._write(name, change(self.rows(name, "open")))
            table["folders"] = [f for f in table["folders"] if not f["open"]] + folders
        return self

    def mark(self, name: str, value: str | int) -> Transaction:
        """Something that the manifest remembers by name, such as the last run or micro-batch."""
        self.marks[name] = value
        return self

    def _write(self, name: str, rows: DataFrame) -> tuple[list[dict], int | None]:
        """The folders of these rows, and their last place. Counts come with the write itself."""
        columns = self.store.columns(name)
        folder, seen = f"{name}/{uuid.uuid4().hex}", Observation()
        is_open = F.coalesce(F.expr(OPEN[name]), F.lit(False)) if name in OPEN else F.lit(False)
        rows = rows.select(*columns, F.col("ord").cast("long").alias("ord"), is_open.alias("open"))
        rows = rows.observe(seen, F.max("ord").alias("top"), F.count_if("open").alias("open"), F.count_if(~F.col("open")).alias("closed"))
        rows.write.partitionBy("open").parquet(f"{self.store.path}/{folder}")
        counts = seen.get
        return [{"path": f"{folder}/open={str(o).lower()}", "open": o, "rows": n} for o, n in ((True, counts["open"]), (False, counts["closed"])) if n], counts["top"]

    def commit(self) -> int:
        """Makes the changes visible, or raises ConcurrentCommit and changes nothing. The new manifest's number."""
        number = self.base + 1
        text = json.dumps({"number": number, "tables": self.tables, "marks": self.marks})
        if not self.store.files.publish(f"{self.store.path}/manifests/{number:012d}.json", text):
            raise ConcurrentCommit(f"manifest {number} of {self.store.path} is another writer's")
        return number


def to_zip(store: StateStore, policy: Policy, manifest: dict) -> bytes:
    """The store as a ZIP of CSV files with policy and manifest."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2))
        z.writestr("policy.json", json.dumps(policy.to_dict(), ensure_ascii=False, indent=2))
        for name in STATE_TABLES:
            rows = store.read(name).drop("ord")
            if rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
                raise ValueError(f"{name} has more than {MOST_ROWS} rows; exchange its Parquet files instead")
            z.writestr(f"{name}.csv", rows.toPandas().to_csv(index=False, lineterminator="\r\n"))
    return out.getvalue()


def from_zip(store: StateStore, raw: bytes) -> tuple[Policy, dict]:
    """Fills the store from a ZIP at once; tables that it lacks are empty. Values have the tables' types; what doesn't parse is null."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        read = lambda n: json.loads(z.read(n)) if n in names else {}
        policy, manifest = Policy.from_dict(read("policy.json")), read("manifest.json")
        tables = store.transaction()
        for name, schema in STATE_TABLES.items():
            if f"{name}.csv" not in names:
                continue
            text = pd.read_csv(io.BytesIO(z.read(f"{name}.csv")), dtype=str, keep_default_na=False)
            fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
            rows = store.spark.createDataFrame([(*[r.get(c, "") for c, _ in fields], k) for k, r in enumerate(text.to_dict("records"))], ", ".join(f"{c} string" for c, _ in fields) + ", ord long")
            typed = [F.col(c) if t == "string" else F.nullif(F.col(c), F.lit("")).try_cast(t).alias(c) for c, t in fields]
            tables.replace(name, rows.select(*typed, "ord"))
        tables.commit()
    return policy, manifest
