"""Stored tables in versions: new parts beside the old ones, and one small file that says which count.

A store holds named tables, each partitioned by one column.  A commit writes the new parts
to a place of their own and then one manifest: which part of which table lies in which
place.  The manifest is a single file, so it is there or not; the newest one counts.
Nothing that counts is ever overwritten: a job that stops between the two writes leaves the
old tables, and repeating it is safe.  One writer at a time is assumed, any number of readers.

Manifests have one row for each part (a date, a bucket), so they are read to the driver:
which dates exist, and which changed since some version, is known without a scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the folder level of places; no table may have a column of this name
PLACE = "v__"
MANIFEST = "name string, part string, place long, written int, key string, fields string"


@dataclass(frozen=True)
class Part:
    """Where a part lies; ``written`` is how many parts its place got in all."""

    place: int
    written: int
    key: str
    fields: str


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self, back: int = 0) -> tuple[int, dict[str, dict[str, Part]]]:
        """The newest version, or the one ``back`` before it, and its parts by table; -1 where there is none."""
        try:
            rows = self.spark.read.schema(MANIFEST + ", version long").parquet(f"{self.path}/manifests")
            versions = sorted(r.version for r in rows.select("version").distinct().collect())
        except AnalysisException:
            versions = []
        if len(versions) <= back:
            return -1, {}
        tables: dict[str, dict[str, Part]] = {}
        for r in rows.filter(F.col("version") == versions[-1 - back]).collect():
            own = tables.setdefault(r.name, {}) if r.name is not None else {}
            if r.part is not None:
                own[r.part] = Part(r.place, r.written, r.key, r.fields)
        return versions[-1 - back], tables

    def parts(self, name: str) -> dict[str, int]:
        """The parts of a table and their places; a part's place changes when it is written anew."""
        return {p: x.place for p, x in self.manifest()[1].get(name, {}).items()}

    def read(self, name: str, parts: Iterable[str] | None = None, schema: str | None = None) -> DataFrame:
        """A table, or only some of its parts.  ``schema`` is that of a table without any part yet."""
        own = self.manifest()[1].get(name, {})
        if parts is not None:
            own = {p: own[p] for p in parts if p in own}
        if not own:
            if schema is None:
                raise ValueError(f"{name} has no such part in {self.path}")
            return self.spark.createDataFrame([], schema)
        places: dict[int, list[str]] = {}
        for p, x in own.items():
            places.setdefault(x.place, []).append(p)
        whole = {x.place: x.written for x in own.values()}
        newest = own[max(own, key=lambda p: own[p].place)]
        base, paths = f"{self.path}/data/{name}", []
        for place, held in places.items():
            root = f"{base}/{PLACE}={place}"
            paths += [root] if len(held) == whole[place] else [f"{root}/{newest.key}={p}" for p in sorted(held)]
        # the newest part has the widest schema; columns that older ones lack are null
        fields = T._parse_datatype_json_string(newest.fields)
        return self.spark.read.schema(fields.add(PLACE, "long")).option("basePath", base).parquet(*paths).select(*[f.name for f in fields if f.name != PLACE])

    def commit(self, tables: Mapping[str, tuple], drop: Mapping[str, Iterable[str]] | None = None) -> int:
        """Write each table's rows as new parts, in place of those of the same name, and forget the parts in ``drop``.

        ``tables`` maps names to rows, the column that parts them and, where known, the names
        of these parts; else they are read back.  Rows may be read from this store.
        """
        version, old = self.manifest()
        version += 1
        now = {name: dict(own) for name, own in old.items()}
        for name, gone in (drop or {}).items():
            for p in gone:
                now.get(name, {}).pop(p, None)
        for name, (rows, key, *held) in tables.items():
            place = f"{self.path}/data/{name}/{PLACE}={version}"
            # large parts are split and small ones joined at the advisory size
            rows.hint("rebalance", key).write.mode("overwrite").partitionBy(key).parquet(place)
            held = held[0] if held else [r[0] for r in self.spark.read.schema(rows.schema).parquet(place).select(F.col(key).cast("string")).distinct().collect()]
            now.setdefault(name, {}).update({p: Part(version, len(held), key, rows.schema.json()) for p in held})
        self.publish(version, now)
        return version

    def publish(self, version: int, tables: Mapping[str, Mapping[str, Part]]) -> None:
        rows = [(name, p, x.place, x.written, x.key, x.fields) for name, own in tables.items() for p, x in own.items()]
        rows += [(name, None, None, None, None, None) for name, own in tables.items() if not own] or ([] if rows else [(None,) * 6])
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/version={version}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Empty the places that none of the ``keep`` newest versions points at; returns them."""
        live, seen = set(), set()
        newest = self.manifest()[0]
        for back in range(newest + 1):
            version, tables = self.manifest(back)
            if version < 0:
                break
            used = {(name, x.place) for name, own in tables.items() for x in own.values()}
            seen |= used
            live |= used if back < keep else set()
        dead = sorted(f"{self.path}/data/{name}/{PLACE}={place}" for name, place in seen - live)
        for place in dead:
            self.spark.range(0).write.mode("overwrite").parquet(place)
        return dead
