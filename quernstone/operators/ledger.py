"""The ledger of documents, plans of change, and a versioned store that commits data first and its pointer last.

A ledger row is (document_id, source_uri, content_hash, unit_ids, stage_keys, build_id). Stage keys are compared as sets, so a stage
that was removed makes a document stale just as one that changed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.ids import config_hash


def stage_keys(config: dict[str, Any]) -> dict[str, str]:
    """A key per stage, of implementation, version and all parameters: parse, segment, enrich:NAME, index:NAME."""
    out = {s: config_hash(config[s]) for s in ("parse", "segment") if s in config}
    for group in ("enrich", "index"):
        out |= {f"{group}:{name}": config_hash(spec) for name, spec in config.get(group, {}).items()}
    return out


def plan(corpus: DataFrame, ledger: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(document_id, change, stale): ADDED, CHANGED, RESTAGED with the stages whose keys differ, UNCHANGED or REMOVED, by one full join."""
    now = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.lit(v))]) if keys else F.create_map().cast("map<string,string>")
    c = corpus.select("document_id", F.col("content_hash").alias("_new"))
    old = ledger.select("document_id", F.col("content_hash").alias("_old"), F.coalesce("stage_keys", F.create_map().cast("map<string,string>")).alias("_keys"))
    j = c.join(old, "document_id", "full").withColumn("_now", now)
    names = F.array_union(F.map_keys("_now"), F.map_keys("_keys"))
    stale = F.sort_array(F.filter(names, lambda k: ~F.coalesce(F.try_element_at("_now", k), F.lit("")).eqNullSafe(F.coalesce(F.try_element_at("_keys", k), F.lit("")))))
    change = F.when(F.col("_new").isNull(), "REMOVED").when(F.col("_old").isNull(), "ADDED").when(F.col("_new") != F.col("_old"), "CHANGED").when(F.size(stale) > 0, "RESTAGED").otherwise("UNCHANGED")
    p = j.withColumn("change", change)
    return p.select("document_id", "change", F.when(F.col("change") == "RESTAGED", stale).otherwise(F.array().cast("array<string>")).alias("stale"))


def unit_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(document_id, unit_id, diff): units new in the current build and gone since the previous one."""
    c, p = (x.select("document_id", "unit_id") for x in (current, previous))
    return c.join(p, ["document_id", "unit_id"], "left_anti").withColumn("diff", F.lit("added")).unionByName(p.join(c, ["document_id", "unit_id"], "left_anti").withColumn("diff", F.lit("removed")))


def latest(journal: DataFrame, order: str = "seq") -> DataFrame:
    """The last row of each document in an append-only journal."""
    rest = [c for c in journal.columns if c != "document_id"]
    return journal.groupBy("document_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("document_id", "r.*")


class Store:
    """Tables kept in a shared folder, as lists of written parts. A commit writes its parts and then one manifest, numbered one above the
    last, by a rename onto a name that must be free; the highest manifest is in force. So a build that dies leaves the last one in force,
    nothing is ever deleted to make room for it, and of two builds that commit at once one is refused. A commit replaces tables or appends
    parts to them; all others are carried over by reference, without a rewrite."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_manifests")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _manifest(self, number: int) -> dict[str, Any]:
        fs, p = self._fs(f"{self.path}/_manifests/{number:012}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict[str, Any] | None:
        """The manifest in force, or None."""
        numbers = self._manifests()
        return self._manifest(numbers[-1]) if numbers else None

    def parts(self, name: str) -> list[str]:
        held = self.current()
        return held["tables"].get(name, []) if held else []

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame | None:
        """The committed rows of a table; None if there is no such table."""
        at = self.parts(name) if parts is None else parts
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in at]) if at else None

    def write(self, name: str, df: DataFrame) -> str:
        """A part that no manifest names yet."""
        part = f"{name}/{int(time.time() * 1000)}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def commit(self, tables: dict[str, DataFrame | list[str]] | None = None, append: dict[str, DataFrame | list[str]] | None = None, manifest: dict[str, Any] | None = None) -> int:
        """Replace TABLES and add to those of APPEND, each given as rows or as parts written before; returns the manifest's number."""
        held = self.current() or {"number": 0, "tables": {}}
        named = dict(held["tables"])
        parts = lambda name, x: x if isinstance(x, list) else [self.write(name, x)]
        for name, x in (tables or {}).items():
            named[name] = parts(name, x)
        for name, x in (append or {}).items():
            named[name] = [*named.get(name, []), *parts(name, x)]
        number = held["number"] + 1
        self._publish(number, json.dumps({**(manifest or {}), "number": number, "tables": named}))
        return number

    def _publish(self, number: int, record: str) -> None:
        fs, staged = self._fs(f"{self.path}/_manifests/.staged-{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(bytearray(record.encode()))
        out.close()
        _, target = self._fs(f"{self.path}/_manifests/{number:012}.json")
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, False)
            raise RuntimeError(f"another build has committed version {number}")

    def compacted(self, name: str, merge: Callable[[DataFrame], DataFrame], after: int = 16) -> None:
        """Replace a table of more than AFTER parts by one part, merged."""
        if len(self.parts(name)) > after:
            self.commit({name: merge(self.read(name))})

    def vacuum(self, keep: int = 2) -> int:
        """Delete the parts that none of the last KEEP manifests name, and older manifests; returns how many parts. Not to run beside a build."""
        numbers = self._manifests()
        live = {p for n in numbers[-keep:] for parts in self._manifest(n)["tables"].values() for p in parts}
        fs, root = self._fs(self.path)
        gone = 0
        for table in fs.listStatus(root) if fs.exists(root) else []:
            name = table.getPath().getName()
            if name.startswith("_"):
                continue
            for part in fs.listStatus(table.getPath()):
                if f"{name}/{part.getPath().getName()}" not in live:
                    gone += bool(fs.delete(part.getPath(), True))
        for n in numbers[:-keep]:
            fs.delete(self._fs(f"{self.path}/_manifests/{n:012}.json")[1], False)
        return gone


class Accountant:
    """Measures of stages, failures included: rows of (stage, wall_ms, cost, hits, tokens, error)."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float, float, int, int, str | None]] = []

    @contextmanager
    def measure(self, stage: str, cost: float = 0.0, hit: bool = False, tokens: int = 0):
        began, error = time.time(), None
        try:
            yield
        except Exception as e:
            error = type(e).__name__
            raise
        finally:
            self.rows.append((stage, (time.time() - began) * 1000, cost, int(hit), tokens, error))

    def runs(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, wall_ms double, cost double, hits int, tokens bigint, error string")


def by_stage(runs: DataFrame) -> DataFrame:
    return runs.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("wall_ms"), 6).alias("wall_ms"), F.round(F.sum("cost"), 9).alias("cost"), F.sum("hits").cast("bigint").alias("hits"), F.sum("tokens").alias("tokens"), F.count("error").alias("errors"))


def unaccounted(runs: DataFrame, elapsed_ms: float) -> DataFrame:
    """(accounted_ms, unaccounted_ms, accounted_fraction) of a build."""
    s = F.coalesce(F.sum("wall_ms"), F.lit(0.0))
    return runs.agg(s.alias("accounted_ms"), F.greatest(F.lit(0.0), elapsed_ms - s).alias("unaccounted_ms"), (F.least(s, F.lit(elapsed_ms)) / elapsed_ms if elapsed_ms else F.lit(0.0)).alias("accounted_fraction"))


def cache_misses(inputs: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Inputs whose result a content-addressed cache table doesn't hold yet."""
    return inputs.join(cache.select(key), key, "left_anti")
