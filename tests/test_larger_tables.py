"""Faults that showed on larger tables or rarer rows than those of the smallest data folder."""

import gzip

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.functions import text as tx
from fathomline import queries as core
from fathomline.functions import batches
from fathomline.operators import dedupe, joins, mentions
from fathomline.sources import web
from fathomline.streaming import ingest


def against_sql(spark, folder, name, *tables):
    """Rows of the query and of its SQL over ``tables`` of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df, sql = core.queries()[name](spark, str(folder)), con.sql(core.oracle_sql()[name])
    return sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[sql.columns.index(c)] for c in df.columns) for r in sql.fetchall()), key=repr)


def test_planned_items_broadcast_nothing(spark):
    """queries expanded from a small file are larger than their estimate; they are neither sent to the driver nor numbered whole."""
    names = spark.range(200).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("seed"), F.col("id").alias("pos"))
    asked = names.select("seed", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("suffix_pos")).withColumns({"is_base": F.col("suffix_pos") == 4, "expanded": F.concat("seed", F.lit(" "), F.col("suffix_pos").cast("string"))})
    first = names.filter("pos % 50 = 0").select(F.col("seed").alias("name"), (F.col("pos") % 3).cast("string").alias("promoted_at"), "pos")
    df = ingest.planned_items(first, asked, names.select("seed"), 50, 7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("TakeOrderedAndProject") == 3
    rows = [tuple(r) for r in df.collect()]
    assert [(s, o) for s, _, o in rows[:32]] == [(f"n{n}", 8 * i + j + 1) for i, n in enumerate((50, 100, 0, 150)) for j in range(8)]
    drawn = names.filter("pos % 50 <> 0").join(asked, "seed").select("seed", "expanded", F.xxhash64(F.lit(7), "expanded").alias("order")).orderBy("order").limit(18)
    assert rows[32:] == [tuple(r) for r in drawn.collect()]


def test_near_duplicates_by_ascii_words(spark, tmp_path):
    """SQL's words may stand inside words with other letters; the operator's own words don't."""
    plain, inside = " ".join(f"word{i:02d}" for i in range(10)), " ".join(f"ä{i:02d}abc" for i in range(20))
    rows = [(0, f"{plain} {inside} one1 two2"), (1, f"{plain} {inside} three3 four4"), (2, f"{plain} snake_case"), (3, f"{plain} snake"), (4, None), (5, "no")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    have, want = against_sql(spark, tmp_path, "agg03_near_duplicates", "documents")
    assert have == want == [(0, 0), (2, 0), (4, 0), (5, 0)]
    d = spark.createDataFrame(rows[:2], "order long, content string").withColumn("query_id", F.lit(0))
    assert dedupe.greedy_near_duplicates(d).count() == 2


def test_models_of_large_keys(spark, tmp_path):
    """a part may have the number that SQL gives a new model; both are models."""
    keys = [1, 3, 5, 6, 15, 999_999, 1_000_003, 1_000_005, 1_000_015, 2_000_005, 2_000_006]
    spark.createDataFrame([(k, f"p{k}") for k in keys], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    have, want = against_sql(spark, tmp_path, "jsn07_models", "part")
    assert have == want
    assert have.count((1_000_005, "custom")) == 2
    assert {(2_000_005, "custom"), (2_000_005, "p2000005")} <= set(have)


def test_claims_keep_digits(spark, tmp_path):
    """sentences lose spaces at their ends, not the digits of their places."""
    rows = [(0, "One sentence of some length. 1 is how this sentence ends 1.  2 is here, and the last sign is 2"), (1, "0 begins a long enough sentence 0"), (2, " \n "), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    have, want = against_sql(spark, tmp_path, "txt11_claims", "documents")
    assert [(i, t or "") for i, t in have] == [(i, t or "") for i, t in want]
    assert dict(have)[1] == rows[1][1]


def batch_bytes(df):
    """The most bytes of ``t`` that come to Python at once."""
    return df.mapInPandas(lambda bs: (pd.DataFrame({"n": [b["t"].str.len().sum()]}) for b in bs), "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("maker", ["pages", "vectors", "records"])
def test_batches_are_bounded(spark, maker):
    """What comes to Python at once is bounded by bytes, not only by a count of rows."""
    spark.conf.unset(batches.SETTING)
    rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    assert batch_bytes(rows) > 2 * batches.BATCH_BYTES
    if maker == "pages":
        assert rows.limit(1).select(web.parsed_page(F.concat(F.lit("<h1>"), "t")).alias("p")).first()["p"]["h1"] == "x" * 10_000
    elif maker == "vectors":
        claims = spark.createDataFrame([(q, i, [1.0, float(i)]) for q in range(50) for i in range(3)], "query_id int, claim_id int, claim_vec array<double>")
        found = joins.ranked_evidence(claims, claims.toDF("query_id", "doc_index", "evidence_vec"))
        assert found.filter("evidence_rank = 1 AND claim_id = doc_index").count() == 150
    else:
        record = gzip.compress(b"a\r\n\r\nb\r\n\r\n" + b"y" * 3_000_000)
        records = spark.createDataFrame([(f"u{i}", "20240101", record) for i in range(5)], "url string, timestamp string, body binary")
        assert web.archive_documents(records, lambda h: h, most=10).select("url", "content").orderBy("url").collect() == [(f"u{i}", "y" * 10) for i in range(5)]
    assert batch_bytes(rows) < 2 * batches.BATCH_BYTES


def test_names_make_each_key_once(spark):
    """a key is made once a name, not once a comparison."""
    party = "struct<name:string>"
    p = spark.createDataFrame([(1, "Alpha", ("Alpha Bhd",), ("Beta Ltd",), [("beta plc",), ("Gamma",)])], f"query_id int, query string, customer {party}, corporate_guarantor {party}, high_risk_entities array<{party}>")
    df = mentions.candidate_names(p)
    assert df.select("role", "name").collect() == [("corporate_guarantor", "Beta Ltd"), ("high_risk", "Gamma")]
    assert df._jdf.queryExecution().analyzed().toString().count("berhad") == 4  # one for each kind of name, and the query's


def test_plain_pages_need_no_parser(monkeypatch):
    """a page of plain tags is cut by a pattern, with the parser's tree; any other page goes to the parser."""
    plain = "<h3>N\r\n 1</H3>x<Div CLASS='a b' class=\"c\"><br><p\n id=''>é  \t y</div></b> <td x='1'>z</td>"
    others = ["a &amp; b", "<!-- <p> -->x", "<script>if (a < b) '<p>'</script><p>y", "<p a>x", "<br/>x", "<title><b>x</title>", "1 < 2", "<p a='&lt;'>x", "</p a='b'>x", "<p"]

    def parsed(html):
        page = web._Tree()
        page.feed(html)
        return page.root

    wanted = [parsed(x) for x in (plain, "", *others)]
    assert [web._tree(x) for x in (plain, "", *others)] == wanted
    fed = []
    monkeypatch.setattr(web._Tree, "feed", lambda self, html: fed.append(html))
    for x in (plain, "", *others):
        web._tree(x)
    assert fed == others
    words = ("", {}, [" a \t b\r\n\r\n \r\n c", ("b", {}, ["  d  "]), "\n", "e\rf"])
    assert web._words(words) == "a b\n\n c\nd\ne\nf"


def test_strip_looks_at_ends_alone(spark):
    """as the pattern does for any character, without it."""
    df = spark.range(0x3100).select(F.concat(F.lit(" \n"), F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), F.lit("a \t b"), F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), F.lit("\r\n")).alias("t"))
    odd = df.filter(tx.strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))
    assert odd.count() == 0 and df.count() == 0x3100
    assert "regexp_replace" not in df.select("t").withColumn("s", tx.strip(F.col("t")))._jdf.queryExecution().analyzed().toString()


def test_relations_split_texts_once(spark):
    """tokens, their text and places are made once for all names, not once for each use."""
    df = spark.createDataFrame([("The Acme Bank of Beta Bank owns Acme", ["Beta", "", "bank of", "none", "wns A"])], "t string, names array<string>").repartition(2)
    found = df.select(joins.located_entities(F.split("t", " "), F.col("names")).alias("x"))
    assert [tuple(x) for x in found.first()["x"]] == [("Beta", 4, 4), ("bank of", 2, 3), ("wns A", 6, 7)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(t") == 1 and plan.count("array_join") == 1
