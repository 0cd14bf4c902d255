"""Tables with versions on plain files: upserts, tombstones, compaction, changes of schema, replays that change nothing.

Data files are only ever added.  A version is one small file in the folder `log`, named by its number, which lists the data
folders that make up the table, the changes of schema so far, and the last batch of each writer.  It is created under
its number only if no other writer has taken it, so readers see a version whole or not at all.  Of the rows of a key the one of
the highest version counts; a tombstone removes the key until a later version brings it back.  Compaction writes what
counts into one folder and lists only that; older versions can be read until vacuum() removes what they alone need."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, GONE = "_version", "_deleted"


class Versions:
    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, n: int):
        return self._path(f"{self.path}/log/{n:012d}.json")

    def numbers(self) -> list[int]:
        """Versions there are, in order."""
        folder = self._path(f"{self.path}/log")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, n: int | None = None) -> dict:
        have = self.numbers()
        if not have:
            return {"version": 0, "folders": [], "changes": [], "batches": {}}
        return json.loads(self.spark.read.text(self._name(have[-1] if n is None else n).toString(), wholetext=True).head()[0])

    def _put(self, manifest: dict) -> bool:
        """Whether the version is ours; another writer may have taken its number."""
        try:
            out = self._fs.create(self._name(manifest["version"]), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return True

    def _next(self, change: Callable[[dict], dict | None]) -> int:
        """Puts the version that change() makes of the latest one; of what others have put meanwhile if need be."""
        while True:
            old = self.manifest()
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return old["version"]
            new["version"] = old["version"] + 1
            if self._put(new):
                return new["version"]

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, rows: DataFrame, deleted: bool = False, writer: str | None = None, batch: int | None = None) -> int:
        """Upserts rows, or with deleted=True removes their keys.  Of rows with equal keys one counts.  A batch that its
        writer has committed before changes nothing."""
        done = lambda m: writer is not None and m["batches"].get(writer, -1) >= batch
        if done(self.manifest()):
            return self.manifest()["version"]
        name = self._write(rows.withColumn(GONE, F.lit(deleted)))

        def change(m: dict) -> dict | None:
            if done(m):
                return None
            m["folders"].append({"name": name, "since": m["version"] + 1})
            if writer is not None:
                m["batches"][writer] = batch
            return m

        return self._next(change)

    def migrate(self, add: dict[str, str] | None = None, rename: dict[str, str] | None = None, drop: list[str] | None = None) -> int:
        """Changes of schema, logged: files stay, and are read as if they had been written so.  add: name -> SQL
        expression of its value in older rows."""

        def change(m: dict) -> dict:
            m["changes"].append({"since": m["version"] + 1, "add": add or {}, "rename": rename or {}, "drop": drop or []})
            return m

        return self._next(change)

    def _folder(self, folder: dict, changes: list[dict]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/data/{folder['name']}")
        if VERSION not in rows.columns:
            rows = rows.withColumn(VERSION, F.lit(folder["since"]))
        for c in changes:
            if c["since"] > folder["since"]:
                rows = rows.withColumnsRenamed(c["rename"]).drop(*c["drop"])
                rows = rows.withColumns({k: F.expr(v) for k, v in c["add"].items() if k not in rows.columns})
        return rows

    def history(self, n: int | None = None) -> DataFrame | None:
        """All rows of a version's folders, tombstones too, in its schema."""
        m = self.manifest(n)
        frames = [self._folder(f, m["changes"]) for f in m["folders"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(VERSION, GONE)).alias("_row"))  # partial, before the shuffle
        return best.select(*self.keys, "_row.*").where(~F.col(GONE))

    def read(self, n: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        rows = self.history(n)
        if rows is None:
            raise ValueError(f"nothing has been committed to {self.path}")
        return self._latest(rows).drop(VERSION, GONE)

    def compact(self, files: int | None = None) -> int:
        """One folder in place of all that the latest version lists.  What others commit meanwhile stays beside it."""
        m = self.manifest()
        if not m["folders"]:
            return m["version"]
        rows = self._latest(self.history(m["version"]))
        name = self._write(rows.repartition(files, *self.keys) if files else rows)
        merged = {f["name"] for f in m["folders"]}

        def change(now: dict) -> dict:
            now["folders"] = [{"name": name, "since": m["version"]}] + [f for f in now["folders"] if f["name"] not in merged]
            return now

        return self._next(change)

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last `keep` versions, and data that none of those lists.  Returns how many folders went."""
        numbers = self.numbers()
        listed = {f["name"] for n in numbers[-keep:] for f in self.manifest(n)["folders"]}
        old = {f["name"] for n in numbers[:-keep] for f in self.manifest(n)["folders"]} - listed
        for n in numbers[:-keep]:
            self._fs.delete(self._name(n), False)
        for name in old:
            self._fs.delete(self._path(f"{self.path}/data/{name}"), True)
        return len(old)


def resync(table: Versions, payload: DataFrame, text: str = "text") -> tuple[int, int]:
    """Brings a table in line with what it should hold: new rows and rows of other text are upserted, rows that the payload
    lacks are removed.  Returns how many of either."""
    key = table.keys[0]
    want = payload.withColumn("_h", F.xxhash64(text))
    if table.history() is None:
        table.commit(payload)
        return payload.count(), 0
    held = table.read().select(F.col(key).alias("_k"), F.xxhash64(text).alias("_g"))
    both = want.join(held, want[key].eqNullSafe(held["_k"]), "left")
    put = both.where("_g is null or _g <> _h").drop("_k", "_g", "_h")
    gone = held.join(want, want[key].eqNullSafe(held["_k"]), "left_anti").select(F.col("_k").alias(key))
    n_put, n_gone = put.count(), gone.count()
    if n_put:
        table.commit(put)
    if n_gone:
        table.commit(gone, deleted=True)
    return n_put, n_gone
