"""Order-dependent operators against plain Python, and state."""

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from fathomline.operators import dedupe, joins, mentions, rank
from fathomline.params import Params
from fathomline.sources import listing, registry, web
from fathomline.sources.stores import DocumentStore, ProfileStore, SeenUrls, text_report
from fathomline.streaming import ingest


def test_greedy_near_duplicates(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(120).collect()
    kept, sets = [], []
    for r in rows:
        words = set(re.findall(r"\b[a-z0-9]{3,}\b", r["text"][:2000].lower()))
        if not words or all(len(words & s) / len(words | s) < 0.85 for s in sets if s):
            kept.append(r["doc_id"])
            sets.append(words)
    df = spark.createDataFrame([(0, r["doc_id"], r["text"]) for r in rows], "query_id int, order long, content string")
    assert [r["order"] for r in dedupe.greedy_near_duplicates(df).orderBy("order").collect()] == kept
    again = dedupe.greedy_near_duplicates(dedupe.greedy_near_duplicates(df))
    assert again.count() == len(kept)


def test_distinct_entities(spark):
    rows = [(0, "Maybank Berhad", "ORG", 0.9, 0), (0, "Maybank Bhd", "ORG", 0.8, 1), (0, "Petronas", "ORG", 0.7, 2), (0, "Maybank Bhd", "PERSON", 0.5, 3), (0, " ", "ORG", 1.0, 4)]
    df = spark.createDataFrame(rows, "query_id int, name string, type string, score double, pos int")
    assert SequenceMatcher(None, "maybank berhad", "maybank bhd").ratio() > 0.75
    assert sorted(r["pos"] for r in dedupe.distinct_entities(df).collect()) == [0, 2, 3]


def test_context_hits(spark):
    text = "Acme Corp issued a loan. " + "x" * 300 + " ACME, corp" + " y" * 200
    df = spark.createDataFrame([(1, text, "Acme Corp", "r")], "id int, content string, name string, role string").withColumn("keywords", F.array(F.lit("Loan ")))
    hits = mentions.context_hits(df, ["id", "name", "role"]).first()["hits"]
    assert (df.select(mentions.mention_count(F.col("content"), F.col("name"))).first()[0], hits) == (2, 1)


def test_candidate_names(spark):
    schema = "query_id int, query string, customer struct<name:string>, corporate_guarantor struct<name:string>, high_risk_entities array<struct<name:string>>"
    rows = [(0, "Acme Bhd", ("Beta Sdn Bhd",), ("acme",), [("Beta",), ("Gamma",), (None,), ("Gamma Ltd",), ("Delta",)])]
    got = mentions.candidate_names(spark.createDataFrame(rows, schema), p=Params(max_candidates=3)).orderBy("pos").collect()
    assert [(r["role"], r["name"]) for r in got] == [("customer", "Beta Sdn Bhd"), ("high_risk", "Gamma"), ("high_risk", "Delta")]


def test_upsert_counts_and_promotion(spark):
    fields = "name string, role string, roles array<string>, score double, mentions long, context_hits long, evidence array<struct<url:string>>, source_query string, first_seen_at string, last_seen_at string, promoted_at string, pos long"
    old = spark.createDataFrame([("A Bhd", "customer", None, 0.4, 1, 1, [("u",)], "q", "t0", "t0", None, 1)], fields)
    new = spark.createDataFrame([("a", "high_risk", None, 0.9, 2, 0, [("v",)], "q", None, None, None, 1), ("B", "customer", None, 0.2, 1, 1, [], "q", None, None, None, 2), ("b", "x", None, 0.3, 1, 1, [], "q", None, None, None, 3)], fields)
    merged, counts = mentions.upsert_candidates(old, new, "t1")
    assert tuple(counts.first()) == (1, 2, 2)
    a = merged.filter("name = 'A Bhd'").first()
    assert (a["score"], a["mentions"], a["roles"], [e["url"] for e in a["evidence"]], a["first_seen_at"], a["last_seen_at"]) == (0.9, 2, ["customer", "high_risk"], ["u", "v"], "t0", "t1")
    after, seeds = mentions.promote(merged, spark.createDataFrame([("Z", 0)], "name string, pos long"), "now")
    assert [r["name"] for r in after.filter("promoted_at = 'now'").collect()] == ["A Bhd"]
    assert sorted(r["name"] for r in seeds.collect()) == ["A Bhd", "Z"]


def test_rerank_matches_loop(spark):
    rows = [(0, i, f"http://{'abc'[i % 3]}.com/{i}", "c" * 60, 3.0 - i / 10) for i in range(14)] + [(0, 20, "", "c" * 60, 2.95), (0, 21, "", "c" * 60, 2.94), (0, 22, "u", "short", 9.0)]
    df = spark.createDataFrame(rows, "query_id int, order int, url string, content string, logit double").withColumn("id", F.col("order"))
    import math

    docs = sorted(((1 / (1 + math.exp(-r[4])), -r[1], r[2], r[1]) for r in rows if len(r[3]) >= 50), reverse=True)
    met, out = set(), []
    for k, (s, _, url, i) in enumerate(docs):
        d = re.sub(r"^http://|/.*", "", url)
        out.append((s * 0.9 if k < 5 and url and d in met else s, -k, i))
        met.add(d)
    want = [i for _, _, i in sorted(out, reverse=True)[:10]]
    assert [r["id"] for r in rank.rerank(df).orderBy("order").collect()] == want


def test_located_entities(spark):
    got = spark.range(1).select(joins.located_entities(F.split(F.lit("the Acme Corp and Beta"), " "), F.array(F.lit("acme corp"), F.lit("Beta"), F.lit("none"))).alias("x")).first()["x"]
    assert [tuple(r) for r in got] == [("acme corp", 1, 2), ("Beta", 4, 4)]


def test_profile_store(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "p"))
    party = "struct<name:string,rating:string,esg_scorecard:string,new_director:string,appointment_date:string>"
    row = lambda n: spark.range(1).select(F.lit(n).alias("company"), F.lit("s").alias("snapshot"), F.from_json(F.lit('{"name":"é"}'), party).alias("customer"), F.lit(None).cast(party).alias("corporate_guarantor"), F.array().cast("array<struct<name:string,position:string,relationship:string>>").alias("high_risk_entities"), F.array().cast("array<map<string,string>>").alias("documents"), F.lit(None).cast("double").alias("confidence"), F.lit("2024-01-01").alias("created_at"))  # noqa: E731, E501
    assert store.insert(row(" ")) == 0
    assert store.insert(row("A")) == 1
    assert store.insert(row("B")) == 2
    assert [r["profile_id"] for r in store.all().collect()] == [2, 1]
    got = store.by_id(1).first()
    assert (got["customer"]["name"], got["confidence"], got["documents"]) == ("é", 0.0, [])
    assert "documents" not in store.recent().columns
    assert (store.delete(1), store.delete(1), store.by_id(1).count(), store.all().count()) == (1, 0, 0, 1)
    assert "Customer" in store.all().select(text_report().alias("t")).first()["t"]


def test_ingest_once(spark, tmp_path):
    store, seen = DocumentStore(spark, str(tmp_path / "d")), SeenUrls(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([(1, "u1", "a" * 60), (2, "u1", "b" * 60), (3, "", "c" * 60)], "order int, url string, content string")
    embed = lambda texts: [[float(len(t))] for t in texts]
    assert ingest.ingest(docs, store, seen, embed, {"indexed_at": "2024-01-01"}) == 3  # repeats inside a batch stay
    assert ingest.ingest(docs, store, seen, embed, {}) == 1  # blank URLs pass
    assert store.union().count() == 4
    assert [r["url"] for r in seen.read().collect()] == ["u1"]


def test_stream_distinct_over_runs(spark, tmp_path, data):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    for part in (pages.filter("page_id < 30"), pages.filter("page_id >= 20")):
        part.coalesce(1).write.mode("append").parquet(str(src))
        ingest.stream_distinct(spark.readStream.schema("page_id long, url string").parquet(str(src)), "url", out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == pages.select("url").distinct().count()


def test_stream_batches(spark, tmp_path, data):
    src, got = tmp_path / "in", []
    spark.read.parquet(f"{data}/pages.parquet").select("page_id").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("page_id long").parquet(str(src))
    ingest.stream_documents(stream, str(tmp_path / "ck"), lambda df, i: got.append(df.count())).awaitTermination()
    assert sum(got) == spark.read.parquet(f"{data}/pages.parquet").count()


def test_listing_source(spark):
    assert [listing.backfill_window(*x) for x in [(-3, False), (25, False), (25, True)]] == [(1, 0, 2), (2, 5, 2), (1, 0, 1)]
    pages = {1: 20, 2: 20, 3: 7}
    fetch = lambda code, page: [{"ann_id": f"{code}-{page}-{i}", "title": "t", "date": "d"} for i in range(pages.get(page, 0))]
    spark.dataSource.register(listing.listing_source("announcements", fetch, {"1155": (25, False), "7000": (5, True)}))
    got = spark.read.format("announcements").load().groupBy("company_code").agg(F.min("position").alias("a"), F.count("*").alias("n")).collect()
    assert {r["company_code"]: (r["a"], r["n"]) for r in got} == {"1155": (25, 22), "7000": (0, 20)}


def test_web_parsers(spark):
    html = """<html><head><title>T</title><meta property="og:title" content="Og"></head><body><h1>H</h1><em>1 Jan 2024</em><div class="entry-content"><p>One.</p><p>one.</p></div><p class="wrapper_social">Share this</p>
    <table><tr><th>Name</th><td>X</td><td>Y</td></tr></table><a href="/news/acme-report">Acme annual report</a><iframe src="/FileAccess/1"></iframe><img src="http://a/i.svg"><img src="http://a/i.png"></body></html>"""
    df = spark.createDataFrame([(html,)], "html string").select(web.parsed_page(F.col("html")).alias("p"))
    r = df.select(web.article(F.col("p")).alias("a"), web.rating_detail(F.col("p")).alias("d"), web.table_lines(F.col("p.rows")).alias("t"), web.marked_iframe(F.col("p"), "fileaccess").alias("i"), web.image_urls(F.col("p")).alias("m")).first()
    assert (r["a"]["title"], str(r["d"]["date"]), r["a"]["content"], r["t"], r["i"], r["m"]) == ("Og", "2024-01-01", "One.", "Name: X | Y", "/FileAccess/1", ["http://a/i.png"])
    assert (r["d"]["title"], r["d"]["content"]) == ("H", "One.\n\none.")
    pages = spark.createDataFrame([(0, "acme", "s", 0, "https://s.my", html)], "query_id int, query string, site string, site_pos int, base_url string, html string")
    assert [x["url"] for x in web.search_links(pages).collect()] == ["https://s.my/news/acme-report"]
    items = "<ul><li><a href='/x'>A &amp; b</a><em>2024-01-02</em><span>-</span><span>snip</span></li></ul>"
    got = spark.range(1).select(web.list_items(F.lit(items)).alias("x")).first()["x"][0]
    assert (got["title"], got["url"], str(got["date"]), got["snippet"]) == ("A & b", "/x", "2024-01-02", "snip")


def test_feeds_and_archive(spark):
    import gzip

    xml = "<rss><channel><item><title>Acme wins</title><link>u1</link><pubDate>Mon, 05 Feb 2024 10:00</pubDate></item><item><title>Other</title><link>u2</link></item></channel></rss>"
    feeds = spark.createDataFrame([(0, "acme", 0, xml), (0, "acme", 1, "broken")], "query_id int, query string, feed_pos int, xml string")
    got = web.feed_entries(feeds).collect()
    assert [(r["url"], str(r["source_date"])) for r in got] == [("u1", "2024-02-05")]
    body = gzip.compress(b"WARC\r\n\r\nHTTP\r\n\r\n<title>T</title>" + b"x" * 200)
    rec = spark.createDataFrame([("u", "20240105120000", bytearray(body)), ("v", "2024", bytearray(b"no"))], "url string, timestamp string, body binary")
    got = web.archive_documents(rec, lambda h: h[-200:]).collect()
    assert [(r["url"], r["title"], str(r["source_date"])) for r in got] == [("u", "T", "2024-01-05")]


def test_enriched(spark):
    docs = spark.createDataFrame([("http://a/x", "short", "", ""), ("#", "short", "", ""), ("http://x.com/1", "short", "", ""), ("http://fail/x", "short", "", "")], "url string, content string, snippet string, source_date string")

    def fetch(url):
        if "fail" in url:
            raise OSError
        return 200, "text/html", b"on 2024-03-04 " + b"y" * 150

    got = {r["url"]: r for r in web.enriched(docs, fetch, lambda h: h, lambda b: "").collect()}
    assert got["http://a/x"]["source_date"] == "2024-03-04" and len(got["http://a/x"]["content"]) == 164
    assert all(got[u]["content"] == "short" for u in ("#", "http://x.com/1", "http://fail/x"))


def test_registry_and_routing(spark):
    r = registry.Registry()
    r.add("a", lambda q: q.withColumn("content", F.lit("A")))
    r.add("b", lambda q: q.withColumn("content", F.lit("B")))
    q = spark.createDataFrame([("s", True), ("s credit rating", False)], "query string, is_base boolean")
    assert r.fetch(q, base_only=["b"]).groupBy("retriever").count().orderBy("retriever").collect() == [("a", 2), ("b", 1)]
    docs = spark.createDataFrame([("s", i, ["gov", "RAM Ratings", "news", "news"][i % 4], "c" * 60) for i in range(8)], "seed string, pos int, source string, content string")
    got = ingest.routed(docs, F.col("source") == "gov", lambda d: d.filter("pos = 6")).orderBy("order").collect()
    assert [x["pos"] for x in got] == [0, 4, 1, 5, 6]
    none = ingest.routed(docs, F.col("source") == "gov", lambda d: d.filter("false")).orderBy("order").collect()
    assert [x["pos"] for x in none] == [0, 4, 1, 5, 2, 3, 6, 7]


def test_ranked_evidence_by_blocks(spark, monkeypatch):
    """All pairs in NumPy's place by plain sums: queries of one to many blocks, copies, zeros, NULLs and vectors of other lengths."""
    import random

    rng = random.Random(3)
    vec = lambda: rng.choice([None, [], [0.0, 0.0, 0.0], [1.0, 2.0], [1.0, 0.0, 0.0], [round(rng.gauss(0, 1), 2) for _ in range(3)]])
    claims = [(q, f"c{i}", vec(), i) for q in (0, 1) for i in range(20)] + [(7, "alone", [1.0, 1.0, 1.0], 0)]
    evidence = [(q, i, vec()) for q in (0, 1, 2) for i in range(25)]
    monkeypatch.setattr(joins, "BLOCK", 4)
    got = joins.ranked_evidence(spark.createDataFrame(claims, "query_id int, claim_id string, claim_vec array<float>, n int"), spark.createDataFrame(evidence, "query_id int, doc_index int, evidence_vec array<double>"))
    assert set(got.columns) == {"query_id", "claim_id", "doc_index", "similarity", "evidence_rank", "n"}

    def cosine(a, b):
        a, b = a or [], b or []
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if len(a) == len(b) and norm else 0.0

    want = {(q, c): sorted((-round(cosine(v, w), 6), i) for h, i, w in evidence if h == q)[:3] for q, c, v, _ in claims if q < 3}
    have = {}
    for r in got.orderBy("evidence_rank").collect():
        have.setdefault((r["query_id"], r["claim_id"]), []).append((-round(r["similarity"], 6) + 0.0, r["doc_index"]))
    assert have == want


def test_feeds_of_all_kinds(spark):
    rss = "<rss xmlns:dc='x'><channel><title>C</title><item><title>A &amp; <![CDATA[b <i>c</i>]]></title><link>u1</link><dc:title>no</dc:title></item><item/></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title type='html'>T</title><link rel='self' href='s'/><link href='h'/><content>c</content><updated>2024-01-02</updated></entry></feed>"
    rdf = "<r:RDF xmlns:r='r'><channel/><item><title>R</title><link>l</link></item></r:RDF>"
    rows = [rss, atom, rdf, "broken", "<rss><channel><item><title>a</title></item></channel>", "", None, "<rss/>"]
    got = [[tuple(e) for e in r["e"]] for r in spark.createDataFrame(list(enumerate(rows)), "id int, x string").select("id", web.parsed_feed(F.col("x")).alias("e")).orderBy("id").collect()]
    assert got[0][0] == ("A & b <i>c</i>", "u1", None, None) and got[1] == [("T", "h", "c", "2024-01-02")] and got[2] == [("R", "l", None, None)]
    assert got[3:] == [[]] * 5
