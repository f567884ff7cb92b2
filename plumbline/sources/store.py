"""Tables that are carried from one batch to the next: versions of Parquet folders.

A store is a folder with data folders and, for each version, a manifest that names the folders
each table consists of. A version is made by writing data folders first and then renaming its
manifest into place, which fails if another writer has made that version meanwhile. So a
writer that dies leaves the last version as it was, readers keep the version they began with,
and the tables of one commit change together. Rows of a keyed table lie in parts by a hash of
the key; a batch reads and rewrites the parts that it has keys of, the others are carried over.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators import changes

PARTS = 64


class Conflict(RuntimeError):
    """Another writer has made the version."""


@dataclass(frozen=True)
class Staged:
    """A written folder that no version names yet. parts: those with rows, [None] for rows without a key."""

    spark: SparkSession
    folder: str
    schema: StructType
    parts: list[int | None]

    def rows(self) -> DataFrame:
        paths = [self.folder if p is None else f"{self.folder}/__part={p}" for p in self.parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def part_of(keys: list[str], parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(parts)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS) -> None:
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """The last version; 0 before the first."""
        return max((int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._at(f"versions/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
        """A table at a version (the last one), or only some of its parts; None if there is no such table yet."""
        held = self.manifest(version)["tables"].get(name)
        if held is None:
            return None
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.path}/data/{f}" if p is None else f"{self.path}/data/{f}/__part={p}" for f, p in held["files"] if parts is None or p is None or p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, rows: DataFrame, keys: list[str] | None = None) -> Staged:
        """Write rows to a folder of their own, by parts if keys are given."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/{name}"
        if keys is None:
            rows.write.parquet(folder)
            return Staged(self.spark, folder, rows.schema, [None])
        # A part is written by one task at least, and by more if it is large.
        dealt = rows.withColumn("__part", part_of(keys, self.parts)).hint("rebalance", "__part")
        dealt.write.partitionBy("__part").parquet(folder)
        return Staged(self.spark, folder, rows.schema, [int(n[7:]) for n in self._names(f"data/{name}") if n.startswith("__part=")])

    def commit(self, base: int, replaced: dict[str, tuple[Staged, list[int] | None, list[str]]] | None = None, appended: dict[str, Staged] | None = None) -> int:
        """The version after base. replaced: name to (folder, the parts that it stands for, None for all, columns that
        belong to the table); appended: name to folder. Conflict if there is such a version."""
        tables = self.manifest(base)["tables"]
        short = lambda s: s.folder.rsplit("/", 1)[1]
        for name, (staged, parts, columns) in (replaced or {}).items():
            kept = [] if parts is None else [f for f in tables.get(name, {"files": []})["files"] if f[1] not in parts]
            schema = StructType([f for f in staged.schema.fields if f.name in columns])
            tables[name] = {"schema": json.loads(schema.json()), "files": kept + [[short(staged), p] for p in staged.parts]}
        for name, staged in (appended or {}).items():
            held = tables.get(name, {"files": []})["files"]
            tables[name] = {"schema": json.loads(staged.schema.json()), "files": held + [[short(staged), p] for p in staged.parts]}
        temporary, final = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{base + 1:012d}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": base + 1, "tables": tables}).encode()))
        out.close()
        rename = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # never over a file that is there
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(temporary, final, rename)
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                raise Conflict(f"version {base + 1} of {self.path} is another writer's") from e
            raise
        return base + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests before the last `keep` versions and data folders that none of the rest names; to be run while
        nobody writes. The number of deleted folders."""
        last = self.version()
        live = {f for v in range(max(1, last - keep + 1), last + 1) for t in self.manifest(v)["tables"].values() for f, _ in t["files"]}
        for n in self._names("versions"):
            if n.endswith(".json") and int(n[:-5]) <= last - keep:
                self._fs.delete(self._at(f"versions/{n}"), False)
        gone = [n for n in self._names("data") if n not in live]
        for n in gone:
            self._fs.delete(self._at(f"data/{n}"), True)
        return len(gone)

    def touched(self, batch: DataFrame, keys: list[str]) -> list[int]:
        """The parts that a batch has keys of; as many as there are parts at most."""
        return sorted(r[0] for r in batch.select(part_of(keys, self.parts)).distinct().collect())


def own_folder(spark: SparkSession) -> str:
    """The path of a new folder for a run's tables, in spark.checkpoint.dir or the folder set with setCheckpointDir; where
    neither is set, and in local mode only, a temporary one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="plumbline-")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


def _counted(rows: DataFrame, names: list[str], more: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    seen = Observation()
    counts = [F.count_if(F.col("action") == n).alias(n) for n in names] + [c.alias(n) for n, c in (more or {}).items()]
    return rows.observe(seen, *counts), seen


def upsert_day(store: Store, batch: DataFrame, keys: list[str], data: list[str], now: str, order: list[Column], name: str = "listings") -> dict[str, int]:
    """Merge a batch into the listings and append the snapshots of new prices, as one version; counts by action.

    The rows of changes.merged() are stored as they are, so a later batch meets what this one
    left. The same batch again touches its rows and adds no snapshot.
    """
    base = store.version()
    parts = store.touched(batch, keys)
    current = store.read(name, base, parts)
    rows, seen = _counted(changes.merged(current, batch, keys, data, now, order), ["insert", "touch", "update", "keep"], {"snapshots": F.count_if("snapshot")})
    staged = store.stage(rows, keys)
    fresh = store.stage(staged.rows().where("snapshot").select(*keys, "price", "currency", F.col("last_seen").alias("observed_at")))
    own = [c for c in rows.columns if c not in ("action", "snapshot")]
    store.commit(base, {name: (staged, parts, own)}, {"snapshots": fresh})
    return seen.get


def refresh_inventory(store: Store, batch: DataFrame, keys: list[str], data: list[str], now: str, order: list[Column], full: bool, scope: Column | None = None, name: str = "inventory") -> dict[str, int]:
    """Merge an inventory's batch; a full one unpublishes what it lacks among the stored rows within scope (one owner and
    source, say). Counts created, updated, unchanged, unpublished and kept."""
    base = store.version()
    parts = None if full else store.touched(batch, keys)
    current = store.read(name, base, parts)
    rows, seen = _counted(changes.merged_inventory(current, batch, keys, data, now, order, full, scope), ["created", "updated", "unchanged", "unpublished", "kept"])
    staged = store.stage(rows, keys)
    store.commit(base, {name: (staged, parts, [c for c in rows.columns if c != "action"])})
    return seen.get


def load_pair(store: Store, listings: DataFrame, features: DataFrame, keys: list[str]) -> int:
    """Append listings and their features under one id each, made from the key, as one version; rows whose key is stored,
    or came earlier in the load, are left out, so that a load can be repeated. The number of new listings."""
    base = store.version()
    seen = Observation()
    staged = {}
    for name, rows in (("historical", listings), ("historical_features", features)):
        rows = changes.chunk_ids(rows, keys, "listing_id").dropDuplicates(["listing_id"])
        have = store.read(name, base)
        rows = rows if have is None else rows.join(have.select("listing_id"), "listing_id", "left_anti")
        staged[name] = store.stage(rows.observe(seen, F.count("*").alias("n")) if name == "historical" else rows)
    if seen.get["n"]:
        store.commit(base, appended=staged)
    return seen.get["n"]
