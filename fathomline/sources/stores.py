"""Stores on shared folders: profiles, documents, the seed loop's state and the model registry. What changes is a :class:`KeyedTable`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import entity_key, escaped_html, strip, text
from fathomline.operators.dedupe import first_wins
from fathomline.operators.retrieval import numbered
from fathomline.params import DEFAULT, Params
from fathomline.schema import CANDIDATE, PARTY, PROFILE, RISKS
from fathomline.sources.deltas import KeyedTable
from fathomline.sources.folders import Folder, JsonFile


class ProfileStore:
    """The profiles table (SRC01-03, SNK01-04). JSON columns hold NULL, blank or JSON text; readers get typed values."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = KeyedTable(spark, path, PROFILE, "profile_id")

    def insert(self, rows: DataFrame) -> int:
        """SNK01: adds ``rows`` that name a company, ids going on in their order of ``created_at``; the last id, 0 for none.

        Parties and lists come as structs and arrays, and are kept as JSON. The last id given out is kept with the table, so ids of deleted
        profiles never come back, and no stored row is read.
        """
        last = self.table.number("last_id")
        rows = numbered(rows.filter(strip(F.col("company")) != ""), ["created_at", "company"], "_id").persist()
        try:
            n = rows.count()
            if not n:
                return 0
            js = lambda c, empty: F.coalesce(F.to_json(c), F.lit(empty)).alias(f"{c}_json")
            new = rows.select(
                (F.col("_id") + last).cast("long").alias("profile_id"), "company", "snapshot",
                js("customer", "{}"), js("corporate_guarantor", "{}"), js("high_risk_entities", "[]"), js("documents", "[]"), "confidence", "created_at",
            )
            self.table.change(new, numbers={"last_id": last + n})
        finally:
            rows.unpersist()
        return last + n

    def delete(self, profile_id: int) -> int:
        """SNK02: the number of rows that went; a mark of the id is all that is written."""
        found = self.table.read(only=F.lit(profile_id).cast("long")).select("profile_id")
        n = found.count()
        if n:
            self.table.change(gone=self.table.spark.createDataFrame([(profile_id,)], "profile_id long"))
        return n

    def all(self) -> DataFrame:
        """SRC01."""
        return newest_first(typed_profiles(self.table.read()))

    def recent(self, limit: int = 30) -> DataFrame:
        """SRC02: without documents, which aren't even read."""
        return newest_first(typed_profiles(self.table.read().drop("documents_json"))).limit(limit)

    def by_id(self, profile_id: int) -> DataFrame:
        """SRC03: no row if there is no such id."""
        return typed_profiles(self.table.read(only=F.lit(profile_id).cast("long")))


def migrated(profiles: DataFrame) -> DataFrame:
    """SNK03: missing JSON columns are added, NULL and blank ones become empty objects and lists."""
    for c, empty in (("customer_json", "{}"), ("corporate_guarantor_json", "{}"), ("high_risk_entities_json", "[]"), ("documents_json", "[]")):
        have = F.col(c) if c in profiles.columns else F.lit(None).cast("string")
        profiles = profiles.withColumn(c, F.when(F.trim(text(have)) == "", empty).otherwise(have))
    return profiles


def typed_profiles(profiles: DataFrame) -> DataFrame:
    """JSN01: parties and lists from JSON; an unknown confidence is 0."""
    parsed = {"customer": (PARTY, "{}"), "corporate_guarantor": (PARTY, "{}"), "high_risk_entities": (RISKS, "[]"), "documents": ("array<map<string,string>>", "[]")}
    columns = [F.col(c) for c in ("profile_id", "company", "snapshot")]
    for name, (schema, empty) in parsed.items():
        if f"{name}_json" in profiles.columns:
            value = F.coalesce(F.nullif(F.trim(F.col(f"{name}_json")), F.lit("")), F.lit(empty))
            columns.append(F.coalesce(F.from_json(value, schema), F.from_json(F.lit(empty), schema)).alias(name))
    return profiles.select(*columns, F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "created_at")


def newest_first(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.desc("created_at"), F.desc("profile_id"))


class SeenUrls(KeyedTable):
    """SRC24, SNK10: URLs that were met; a batch writes those that are new."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "url string", "url")

    def add(self, urls: DataFrame) -> int:
        """The number of URLs that weren't there; blanks around them go, and so do blank ones."""
        new = urls.select(strip(F.col("url")).alias("url")).filter("url != ''").distinct()
        return self.change(new.join(self.read(), "url", "left_anti"))

    def listed(self) -> DataFrame:
        return self.read().orderBy("url")


class SeedStore:
    """SNK11: candidates by entity key and the list of seeds by lower-cased name; saving writes what differs."""

    def __init__(self, spark: SparkSession, path: str):
        self._candidates = KeyedTable(spark, f"{path}/candidates", f"key string, {CANDIDATE}", "key")
        self._seeds = KeyedTable(spark, f"{path}/seeds", "key string, name string, pos long", "key")

    def candidates(self) -> DataFrame:
        return self._candidates.read().drop("key")

    def save_candidates(self, rows: DataFrame) -> int:
        """Of candidates with one key the last by ``pos`` stays; those without a key go."""
        return self._candidates.sync(rows.withColumn("key", entity_key(F.col("name"))).filter("key != ''"), "pos")

    def seeds(self) -> DataFrame:
        return self._seeds.read().drop("key")

    def save_seeds(self, rows: DataFrame) -> int:
        """Of names that differ in case the first by ``pos`` stays, in its case."""
        named = rows.withColumn("key", F.lower(strip(F.col("name")))).filter("key != ''")
        return self._seeds.sync(first_wins(named, [F.col("key")], ["pos"]))


class ModelRegistry:
    """SNK14: custom models by id in a small JSON file, beside the default ones."""

    def __init__(self, spark: SparkSession, path: str, default: dict[str, dict]):
        self.file, self.default = JsonFile(spark, path), default

    def custom(self) -> dict[str, dict]:
        found = self.file.load({})
        return found if isinstance(found, dict) else {}

    def all(self) -> dict[str, dict]:
        """A custom model takes the default one's place unless it is disabled."""
        return self.default | {k: m for k, m in self.custom().items() if m.get("enabled", True)}

    def get(self, model_id: str) -> dict | None:
        return self.all().get(model_id)

    def save(self, model_id: str, config: dict) -> None:
        self.file.save(self.custom() | {model_id: config})

    def delete(self, model_id: str) -> bool:
        """Whether there was such a custom model."""
        found = self.custom()
        if model_id not in found:
            return False
        self.file.save({k: m for k, m in found.items() if k != model_id})
        return True


class DocumentStore:
    """Documents with embeddings (A3, A4): one primary folder to append to, others read along.

    An external store is a sub-folder of ``external`` that holds the marker (SRC06).
    """

    def __init__(self, spark: SparkSession, path: str, external: str | None = None, marker: str = "_store"):
        self.spark, self.path, self.external, self.marker = spark, path, external, marker

    def stores(self) -> list[str]:
        found = [self.path]
        if self.external:
            folder = Folder(self.spark, self.external)
            found += [p for n in folder.children() if folder.has(n, self.marker) and (p := f"{self.external}/{n}") != self.path]
        return found

    def read(self) -> list[DataFrame]:
        return [self.spark.read.option("mergeSchema", "true").parquet(p) for p in self.stores() if Folder(self.spark, p).children()]

    def append(self, docs: DataFrame) -> None:
        """SNK05: documents with content; the extra map keeps what isn't NULL."""
        rows = docs.filter(text(F.col("content")) != "")
        if "extra" in rows.columns:
            rows = rows.withColumn("extra", F.map_filter("extra", lambda k, v: v.isNotNull()))
        rows.write.mode("append").parquet(self.path)

    def union(self) -> DataFrame:
        parts = [d.withColumn("store_id", F.lit(i)) for i, d in enumerate(self.read())]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def to_index(docs: DataFrame, p: Params = DEFAULT, order: str = "order") -> DataFrame:
    """SNK08: documents that don't come from the store already, long enough, the first forty."""
    rows = docs.filter(~F.coalesce("is_from_db", F.lit(False)) & (F.length(strip(F.col("content"))) >= p.min_content))
    return rows.orderBy(order).limit(p.max_index_docs)


def text_report(company: str = "company") -> Column:
    """SNK13: a profile as lines of text."""
    row = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(F.trim(text(F.col(c))), F.lit("")), F.lit("-")))
    fields = [("Name", "name"), ("Rating", "rating"), ("ESG scorecard", "esg_scorecard"), ("New director", "new_director"), ("Appointment date", "appointment_date")]
    party = lambda title, c: [F.lit(f"\n{title}"), *(row(label, f"{c}.{f}") for label, f in fields)]
    risks = F.transform("high_risk_entities", lambda x: F.concat_ws(" | ", x["name"], x["position"], x["relationship"]))
    return F.concat_ws(
        "\n", F.concat(F.lit("Company: "), F.col(company)), F.lit("\nSnapshot"), text(F.col("snapshot")), *party("Customer", "customer"),
        *party("Corporate guarantor", "corporate_guarantor"), F.lit("\nHigh-risk entities"), F.array_join(risks, "\n"),
    )


def html_report(company: str = "company") -> Column:
    """SNK13: a profile as an HTML document, every value escaped; word processors open it."""
    value = lambda c, none="-": F.coalesce(F.nullif(F.trim(escaped_html(text(c))), F.lit("")), F.lit(none))
    line = lambda *cells: F.concat(F.lit("<tr>"), *(x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))), F.lit("</tr>"))
    table = lambda names, rows: F.concat(F.lit("<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"), rows, F.lit("</table>"))
    fields = [("Name", "name", "Not identified"), ("Rating", "rating", "-"), ("ESG Scorecard", "esg_scorecard", "-"), ("New Director", "new_director", "-"), ("Appointment Date", "appointment_date", "-")]
    party = lambda c: table(("Field", "Value"), F.concat(*(line(F.lit(label), value(F.col(f"{c}.{f}"), none)) for label, f, none in fields)))
    risks = F.transform(F.filter("high_risk_entities", lambda x: x.isNotNull()), lambda x: line(value(x["name"]), value(x["position"]), value(x["relationship"])))
    risks = F.coalesce(F.nullif(F.array_join(risks, ""), F.lit("")), F.lit('<tr><td colspan="3">None identified.</td></tr>'))
    parts = [
        ("Snapshot", F.concat(F.lit("<div>"), value(F.col("snapshot"), "No snapshot available."), F.lit("</div>"))), ("Customer", party("customer")),
        ("Corporate Guarantor", party("corporate_guarantor")), ("High Risk Entities / Individuals", table(("Name", "Position", "Status / Relationship"), risks)),
    ]
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>Profile</title></head><body><h1>'), value(F.col(company)), F.lit("</h1>"))
    return F.concat(head, *(x for title, body in parts for x in (F.lit(f"<h2>{title}</h2>"), body)), F.lit("</body></html>"))
