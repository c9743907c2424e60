"""Tables with a key that change by small steps: merged when they are read.

A change writes a part with the rows it sets and marks of the keys it drops, nothing else. A part is a Parquet folder, dealt to buckets by the
key's hash. A version is a small manifest that names its parts; it is renamed into place once the part is complete, so a writer that dies
leaves the last version as it was, and the files nobody names go with the next :meth:`KeyedTable.vacuum`. One writer at a time: a
second one that commits the same version fails.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.sources.folders import Folder


class KeyedTable:
    """One row for each ``key``; the last one written counts.

    ``buckets`` is fixed when the table is made; a bucket's files are what a compaction rewrites at a time. A bucket with more than ``most`` parts is
    compacted after a commit: the newest parts are merged, and older ones with them as long as they aren't over twice as large together, so a row
    is rewritten a logarithmic number of times, and marks of dropped keys go once a bucket is merged whole. Rows without a key are left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 16, most: int = 4):
        self.spark, self.key, self.most, self.folder = spark, key, most, Folder(spark, path)
        self.path, self.columns = self.folder.path, T._parse_datatype_string(schema)
        self.buckets = self._manifest().get("buckets", buckets)

    # ---------------------------------------------------------------------------------------------------------------- versions
    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.children("log") if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        return json.loads(self.folder.read("log", f"{version:010d}.json")) if version else {"version": 0, "parts": [], "numbers": {}}

    def _commit(self, before: dict, parts: list[dict], numbers: dict[str, int]) -> None:
        after = {"version": before["version"] + 1, "buckets": self.buckets, "parts": [p for p in parts if p["rows"]], "numbers": numbers}
        self.folder.write(json.dumps(after), "log", f"{after['version']:010d}.json")

    def number(self, name: str) -> int:
        """A number kept with the version, such as the last id given out; 0 before it is set."""
        return self._manifest()["numbers"].get(name, 0)

    # ----------------------------------------------------------------------------------------------------------------- reading
    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _scan(self, parts: list[tuple[str, int]]) -> DataFrame:
        """Rows of buckets of parts as they were written, with ``_gone``, ``_part`` and ``_bucket``. Columns that old files lack are NULL."""
        kind = T.StructType([*self.columns.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_part", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        if not parts:
            return self.spark.createDataFrame([], kind)
        paths = [f"{self.path}/data/_part={name}/_bucket={b}" for name, b in parts]
        return self.spark.read.schema(kind).option("basePath", f"{self.path}/data").parquet(*paths)

    def _newest(self, rows: DataFrame, *keys: str) -> DataFrame:
        own = [f.name for f in self.columns.fields if f.name != self.key]
        last = rows.groupBy(self.key, *keys).agg(F.max_by(F.struct(*own, "_gone"), "_part").alias("_row"))
        return last.select(*keys, *(f"_row.{f.name}" if f.name != self.key else f.name for f in self.columns.fields), "_row._gone")

    def read(self, version: int | None = None, only: Column | None = None) -> DataFrame:
        """The table at a version that :meth:`vacuum` has left, the last one by default. ``only`` is a key value: just its bucket is read.

        The oldest part of each bucket, most of the rows, is scanned without a shuffle unless newer parts are too large to broadcast; what they set or
        drop leaves it by an anti-join.
        """
        of: dict[int, list[str]] = defaultdict(list)
        for p in sorted(self._manifest(version)["parts"], key=lambda p: p["name"]):
            for b in p["rows"]:
                of[int(b)].append(p["name"])
        names = [f.name for f in self.columns.fields]
        base = self._scan([(ps[0], b) for b, ps in of.items()])
        newer = self._scan([(p, b) for b, ps in of.items() for p in ps[1:]])
        if only is not None:
            base, newer = (x.filter((F.col("_bucket") == self._bucket(only)) & (F.col(self.key) == only)) for x in (base, newer))
        base = base.filter(~F.col("_gone")).select(*names)
        if all(len(ps) == 1 for ps in of.values()):
            return base
        newer = self._newest(newer)
        return base.join(newer.select(self.key), self.key, "left_anti").select(*names).unionByName(newer.filter(~F.col("_gone")).select(*names))

    # ----------------------------------------------------------------------------------------------------------------- writing
    def _write(self, rows: DataFrame, name: str) -> dict:
        rows.repartition("_bucket", self.key).sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/data/_part={name}")
        files = self.spark.read.schema(f"`{self.key}` {self.columns[self.key].dataType.simpleString()}, _bucket int").parquet(f"{self.path}/data/_part={name}")
        return {"name": name, "rows": {str(r["_bucket"]): r["count"] for r in files.groupBy("_bucket").count().collect()}}  # a row per bucket

    def _name(self, version: int) -> str:
        return f"{version:010d}-{uuid.uuid4().hex}"

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None, order: str | None = None, numbers: dict[str, int] | None = None) -> int:
        """One commit: sets ``rows`` and drops the keys of ``gone``; the number of rows written, marks included.

        Of rows with one key in ``rows``, the last by ``order`` counts, else any one. A key that is set and dropped at once is dropped. Nothing to write
        is no version.
        """
        parts = []
        if rows is not None:
            rows = rows.withColumn("_at", F.col(order) if order else F.lit(0)).select(*(f.name for f in self.columns.fields if f.name in rows.columns), "_at")
            parts.append(rows.withColumn("_gone", F.lit(False)))
        if gone is not None:
            parts.append(gone.select(self.key).withColumns({"_gone": F.lit(True), "_at": F.lit(None)}))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        both = both.filter(F.col(self.key).isNotNull()).withColumn("_bucket", self._bucket(F.col(self.key)))
        for f in self.columns.fields:
            both = both.withColumn(f.name, F.col(f.name).cast(f.dataType) if f.name in both.columns else F.lit(None).cast(f.dataType))
        both = self._newest(both.withColumn("_part", F.struct("_gone", "_at")).drop("_at"), "_bucket")
        before = self._manifest()
        part = self._write(both, self._name(before["version"] + 1))
        n = sum(part["rows"].values())
        if n:
            self._commit(before, [*before["parts"], part], before["numbers"] | (numbers or {}))
            self.compact()
        else:
            self.folder.remove("data", f"_part={part['name']}")
        return n

    def sync(self, rows: DataFrame, order: str | None = None) -> int:
        """Makes ``rows`` the whole table by writing what differs: rows that are new or changed, and marks of keys that are no more."""
        own = [f.name for f in self.columns.fields]
        at = F.struct(F.lit(False).alias("_gone"), (F.col(order) if order else F.lit(0)).alias("_at"))
        wanted = rows.withColumn("_part", at).select(*(F.col(f.name).cast(f.dataType) for f in self.columns.fields), F.lit(False).alias("_gone"), "_part")
        wanted = self._newest(wanted.filter(F.col(self.key).isNotNull())).select(*own)
        said = lambda df: df.withColumn("_said", F.to_json(F.struct(*own), {"ignoreNullFields": "false"}))
        now = self.read()
        changed = said(wanted).join(said(now).select(self.key, "_said"), [self.key, "_said"], "left_anti").drop("_said")
        return self.change(changed, now.join(wanted, self.key, "left_anti"))

    # -------------------------------------------------------------------------------------------------------------- compaction
    def compact(self) -> int:
        """Merges parts of buckets that have too many; the number of rows written."""
        before = self._manifest()
        of: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for p in sorted(before["parts"], key=lambda p: p["name"], reverse=True):
            for b, n in p["rows"].items():
                of[b].append((p["name"], n))
        chosen: dict[str, list[str]] = {}
        whole = []
        for b, parts in of.items():
            if len(parts) > self.most:
                m, size = 2, parts[0][1] + parts[1][1]
                while m < len(parts) and parts[m][1] <= 2 * size:
                    size, m = size + parts[m][1], m + 1
                chosen[b] = [name for name, _ in parts[:m]]
                if m == len(parts):
                    whole.append(int(b))
        if not chosen:
            return 0
        rows = self._newest(self._scan([(name, int(b)) for b, names in chosen.items() for name in names]), "_bucket")
        rows = rows.filter(~(F.col("_gone") & F.col("_bucket").isin(whole)))
        part = self._write(rows, self._name(before["version"] + 1))
        kept = [p | {"rows": {b: n for b, n in p["rows"].items() if p["name"] not in chosen.get(b, ())}} for p in before["parts"]]
        self._commit(before, [*kept, part], before["numbers"])
        return sum(part["rows"].values())

    def vacuum(self, versions: int = 2) -> None:
        """Drops all but the last ``versions`` and the files that none of them names."""
        found = self.versions()
        named = {p["name"] for v in found[-versions:] for p in self._manifest(v)["parts"]}
        for v in found[:-versions]:
            self.folder.remove("log", f"{v:010d}.json")
        for name in self.folder.children("data"):
            if name.removeprefix("_part=") not in named:
                self.folder.remove("data", name)
