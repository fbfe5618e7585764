"""Keyed tables in hash buckets: a change copies the buckets it touches, no others.

A table folder holds ``data/version=N/bucket=B/`` and ``manifest/N.json``.  The manifest
of a version says which version each bucket was last written in, so a reader that has it
sees one whole version, whatever is being written.  A writer that stops before its
manifest leaves files nobody refers to; doing its version again replaces them.

One writer at a time; readers are free.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.model import KEY


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    system, where = _hadoop(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


class KeyedTable:
    """A table of rows by key, in ``buckets`` hash buckets of ``keys[0]`` and the rest.

    The number of buckets is fixed by the first write; a bucket can be many files, which
    Spark sizes while it writes.
    """

    def __init__(self, spark: SparkSession, base: str, *, keys: Sequence[str] = (KEY,), buckets: int = 256):
        self.spark, self.base, self.keys, self.buckets = spark, base, list(keys), buckets

    # ------------------------------------------------------------- versions

    def versions(self) -> list[int]:
        """Whole versions, oldest first."""
        found = _names(self.spark, f"{self.base}/manifest")
        return sorted(int(n[:-5]) for n in found if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict[str, Any] | None:
        """What the given or the latest version consists of."""
        if version is None:
            found = self.versions()
            if not found:
                return None
            version = found[-1]
        rows = self.spark.read.text(f"{self.base}/manifest/{version:09d}.json", wholetext=True)
        return json.loads(rows.first()[0])

    def _write_manifest(self, body: dict[str, Any]) -> None:
        system, folder = _hadoop(self.spark, f"{self.base}/manifest")
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        draft, place = (jvm_path(folder, n) for n in (f".{body['version']:09d}.draft", f"{body['version']:09d}.json"))
        stream = system.create(draft, True)
        stream.write(bytearray(json.dumps(body).encode()))
        stream.close()
        if system.exists(place):
            system.delete(place, False)
        if not system.rename(draft, place):
            raise OSError(f"could not finish version {body['version']} of {self.base}")

    # --------------------------------------------------------------- reading

    def read(self, version: int | None = None, *, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """All rows of a version, or those of some buckets; null before the first write."""
        held = self.manifest(version)
        return None if held is None else self._rows(held, buckets)

    def as_of(self, version: int) -> DataFrame | None:
        """The rows as they were in ``version``, which may not have touched this table."""
        found = [v for v in self.versions() if v <= version]
        return self.read(found[-1]) if found else None

    def _rows(self, held: dict[str, Any], buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        wanted = {int(b): v for b, v in held["held"].items() if buckets is None or int(b) in set(buckets)}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        # as many paths as there are buckets
        paths = [f"{self.base}/data/version={v:09d}/bucket={b}" for b, v in sorted(wanted.items())]
        return self.spark.read.schema(schema).parquet(*paths)

    def bucket(self, count: int | None = None):
        return F.pmod(F.xxhash64(*self.keys), F.lit(count or self.buckets)).cast("int")

    def of_keys(self, keys: DataFrame) -> DataFrame | None:
        """The rows of some keys; only the buckets they fall into are read."""
        held = self.manifest()
        if held is None:
            return None
        found = self._rows(held, self._touched(keys, held["buckets"]))
        return found.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    # --------------------------------------------------------------- writing

    def _touched(self, keys: DataFrame, buckets: int) -> list[int]:
        # at most as many numbers as there are buckets
        return sorted(r[0] for r in keys.select(self.bucket(buckets)).distinct().collect())

    def change(
        self, keys: DataFrame, merged: Callable[[DataFrame | None], DataFrame], *, version: int | None = None
    ) -> int:
        """A new version in which the buckets of ``keys`` hold what ``merged`` makes of them.

        With ``version`` the write can be done again: it always starts from the version
        before.  Nothing is written for no keys, unless the table is new.
        """
        known = self.versions()
        version = (known[-1] + 1 if known else 1) if version is None else version
        before = [v for v in known if v < version]
        old = self.manifest(before[-1]) if before else None
        buckets = old["buckets"] if old else self.buckets
        touched = self._touched(keys, buckets)
        if not touched and old is not None and version not in known:
            return before[-1]
        rows = merged(self._rows(old, touched) if old else None)
        schema = rows.schema
        if old is not None:
            have = set(rows.columns)
            for field in StructType.fromJson(old["schema"]):
                if field.name not in have:
                    schema = schema.add(field)
        place = f"{self.base}/data/version={version:09d}"
        # files of about the advised size within a bucket, however full it is
        dealt = rows.withColumn("bucket", self.bucket(buckets)).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(place)
        written = [int(n.split("=")[1]) for n in _names(self.spark, place) if n.startswith("bucket=")]
        held = {b: v for b, v in (old["held"].items() if old else ()) if int(b) not in set(touched)}
        held |= {str(b): version for b in written}
        self._write_manifest(
            {"version": version, "buckets": buckets, "written": touched, "held": held, "schema": json.loads(schema.json())}
        )
        return version

    def upsert(self, new: DataFrame, *, order: str = "updated_at", version: int | None = None) -> int:
        """Rows of the same key are replaced by the one with the latest ``order``."""
        from turnwise.sources.stores import upsert

        return self.change(
            new,
            lambda old: upsert(new.limit(0) if old is None else old, new, keys=self.keys, order=order),
            version=version,
        )

    def replace(self, new: DataFrame, keys: DataFrame, *, version: int | None = None) -> int:
        """All rows of ``keys`` are replaced by the rows of ``new``, which has no other keys."""
        gone = keys.select(*self.keys).distinct()

        def merged(old: DataFrame | None) -> DataFrame:
            if old is None:
                return new
            return old.join(gone, self.keys, "left_anti").unionByName(new, allowMissingColumns=True)

        return self.change(gone, merged, version=version)

    def delete(self, keys: DataFrame, *, version: int | None = None) -> int:
        gone = keys.select(*self.keys).distinct()
        if not self.versions():
            raise LookupError(f"nothing was written to {self.base}")
        return self.change(gone, lambda old: old.join(gone, self.keys, "left_anti"), version=version)

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` versions; how many folders went."""
        known = self.versions()
        kept = known[-keep:]
        used = {(v, int(b)) for k in kept for b, v in self.manifest(k)["held"].items()}
        gone = [f"{self.base}/manifest/{k:09d}.json" for k in known if k not in kept]
        for name in _names(self.spark, f"{self.base}/data"):
            number = int(name.split("=")[1])
            if kept and number > kept[-1]:
                continue  # being written
            place = f"{self.base}/data/{name}"
            unused = [n for n in _names(self.spark, place) if n.startswith("bucket=") and (number, int(n[7:])) not in used]
            if all(v != number for v, _ in used):
                gone.append(place)
            else:
                gone += [f"{place}/{n}" for n in unused]
        for path in gone:
            system, where = _hadoop(self.spark, path)
            system.delete(where, True)
        return len(gone)
