"""The profile plan, the seed loop and the parsers that SQL can't follow, against plain Python and by hand."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomline import models
from fathomline.params import Params
from fathomline.plans import profile
from fathomline.sources import web
from fathomline.sources.stores import ProfileStore, html_report
from fathomline.streaming import seeding

CHUNK = "query_id int, query string, order int, content string, title string, url string, source string, source_date string, snippet string"


def chunk(query, order, content, title=None):
    return (query, f"Q{query}", order, content, title, f"http://a/{order}", "s", None, content[:20])


def test_profile_plan(spark, tmp_path):
    long = "Acme Holdings guarantees the loan of Beta Trust and its Risk One unit. " * 4
    rows = [chunk(0, 1, "short"), chunk(0, 2, long), chunk(0, 3, "Risk One was fined by the court in a very long case of fraud."), chunk(1, 1, "x" * 60)]
    docs = spark.createDataFrame(rows, CHUNK)
    asked = spark.createDataFrame([(0, "Q0"), (1, "Q1"), (2, "Q2")], "query_id int, query string")
    done = profile.profiles(asked, docs, docs, models.STAND_INS)
    got = {r["query_id"]: r for r in done.profiles.collect()}
    assert set(got) == {0, 1, 2}
    assert (got[2]["snapshot"], got[2]["confidence"], got[2]["documents"], got[2]["customer"]["name"], got[2]["fact_check_score"]) == ("", 0.0, [], None, None)
    # The document that names a high-risk entity comes first; both long ones do.
    assert [d["url"] for d in got[0]["documents"]] == ["http://a/2", "http://a/3", "http://a/1"]
    assert [r["name"] for r in got[0]["high_risk_entities"]] == ["Risk One"]
    assert got[0]["snapshot"].startswith("The documents and the request hold ") and got[0]["snapshot"].endswith(" characters.")
    # A chunk of sixty characters contradicts, so the only claim of query 1 is rejected.
    claims = {r["query_id"]: r for r in done.claims.collect()}
    assert (claims[1]["rejected"], claims[1]["confidence"], got[1]["fact_check_score"]) == (True, None, 0.25)
    lengths = [len(r[3].strip()) for r in rows[1:3]]
    assert claims[0]["confidence"] == pytest.approx(sum(lengths) / 2000) and not any(n % 10 == 0 for n in lengths)
    cites = {(r["query_id"], r["value_id"]): r["doc_index"] for r in done.citations.filter("cite_rank = 1").collect()}
    assert cites[0, "high_risk.0"] == 0
    assert [(r["name"], r["role"], r["mentions"]) for r in done.candidates.collect()] == [("Risk One", "high_risk", 5)]
    store = ProfileStore(spark, str(tmp_path / "p"))
    assert store.insert(done.profiles.withColumn("created_at", F.lit("2024-01-01"))) == 3
    report = store.all().filter("company = 'Q0'").select(html_report().alias("t")).first()["t"]
    assert "<td>Risk One</td><td>chair</td><td>owner</td>" in report and "Not identified" in report


def test_profiles_meet_by_shuffle(spark):
    """No step of the plan broadcasts what has a row or more for each query: in the driver, that would grow with the queries."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    names = [("Alpha Holdings", "ORG", 0.9), ("Zenith Trust", "ORG", 0.8), ("alpha holding", "ORG", 0.7), ("Nowhere", "PLACE", 0.99)]
    docs = spark.createDataFrame([chunk(q, i, f"Alpha Holdings and Zenith Trust lend to the company of number {q}, as told in {i}.") for q in range(3) for i in (1, 2)], CHUNK)
    made = profile.profiles(docs.select("query_id", "query").distinct(), docs, docs, replace(models.STAND_INS, entities=lambda texts: [names] * len(texts))).profiles
    assert sorted(r["query_id"] for r in made.collect()) == [0, 1, 2]
    bus.waitUntilEmpty()
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]
    assert any("SortMergeJoin" in p for p in plans)
    assert [n for n, p in enumerate(plans) if "BroadcastExchange" in p] == []


def test_relations(spark):
    texts = spark.createDataFrame([(0, "Acme's Beta Trust (x) owns Gamma Bank's. Nobody"), (1, "Acme alone")], "query_id int, text string")
    found = spark.createDataFrame([(0, "Beta Trust", "ORG", 0.9, 0), (0, "gamma bank", "ORG", 0.5, 1), (0, "Absent Name", "ORG", 0.8, 2), (1, "Acme", "ORG", 0.9, 0)], "query_id int, name string, type string, score double, pos int")

    def related(tokens, spans):
        assert all(len(s) > 1 for s in spans)
        return [[(1, 2, 5, 6, "", "", "owns", 0.876), (1, 2, 1, 2, "", "", "is", 0.99), (1, 2, 5, 6, "", "", "owns", 0.9), (0, 0, 5, 6, "Acme's", "", "has", 0.95), (0, 0, 1, 2, "Acme", "", "low", 0.5)] for _ in tokens]

    got = profile.relations(texts, found, replace(models.STAND_INS, relations=related), Params()).orderBy("pos").collect()
    assert [(r["source"], r["target"], r["relationship_type"], r["confidence"]) for r in got] == [("Beta Trust", "gamma bank", "owns", 0.88), ("Acme", "gamma bank", "has", 0.95)]


@pytest.mark.parametrize("reply", ["", "no object", "{broken", "[1]", '{"customer": 3, "corporate_guarantor": [], "high_risk_entities": "x"}'])
def test_odd_replies(spark, reply):
    got = spark.createDataFrame([(reply,)], "r string").select(profile.parsed_profile(F.col("r")).alias("p")).first()["p"]
    assert not any(got["customer"]) and not any(got["corporate_guarantor"]) and got["high_risk_entities"] == []


def test_generators():
    made = []
    g = models.Generators({"a": {"provider": "x", "n": 1}, "b": {"provider": "y"}, "c": {}}, {"x": lambda c: made.append(c) or models.scripted_reply}, "a")
    assert g.get() is g.get("a") and made == [{"model_id": "a", "provider": "x", "n": 1}]
    assert g.get("c") is models.scripted_reply
    for name in ("b", "none"):
        with pytest.raises(ValueError):
            g.get(name)


def test_merged_names(spark):
    old = spark.createDataFrame([(" Acme ", 0), ("acme", 1), ("", 2)], "name string, pos long")
    new = spark.createDataFrame([(n, i) for i, n in enumerate(["Here is a list", '"Beta"', "Delta,,", "\\Gamma\\", "ACME", "[x]", "json names", "beta", None, '"'])], "name string, pos long")
    got = seeding.merged_names(old, new).orderBy("is_new", "pos").collect()
    assert [r["name"] for r in got] == ["Acme", "Beta", "Delta", "Gamma"]


def test_stored_candidates(spark):
    raw = spark.createDataFrame([('[{"name":"A","score":0.5,"evidence":[{"url":"u"}]}, 3, "x", null, {"name":"B"}]',), ("{}",), ("nothing",), (None,)], "value string")
    got = seeding.stored_candidates(raw).orderBy("pos").collect()
    assert [(r["name"], r["score"], r["pos"]) for r in got] == [("A", 0.5, 0), ("B", None, 4)] and got[0]["evidence"][0]["url"] == "u"


def test_due():
    t = datetime(2024, 1, 1)
    at = lambda m: t + timedelta(minutes=m)
    assert seeding.due(seeding.JOBS, {}, t, t) == ["seed", "promote"]
    assert seeding.due(seeding.JOBS, {}, t, at(9), at_once=False) == []
    assert seeding.due(seeding.JOBS, {"seed": t, "promote": t}, t, at(10)) == ["promote"]
    assert seeding.due(seeding.JOBS, {"seed": t, "promote": t}, t, at(45)) == ["seed", "promote"]


def test_seed_rounds():
    ran, promoted = [], iter([0, 1, 0, 0, 0, 0])
    names = [["Old"], ["Old", "New"], ["new"], [], [], []]
    loop = seeding.Loop(lambda: next(promoted), lambda: names.pop(0) if names else [], lambda: True, lambda n: [n, f"{n} a"], lambda i: f"draw {i}", lambda b: ran.append(b) or len(b))
    report = seeding.seed_rounds(loop, rounds=8)
    assert [i for b in ran for i in b] == ["Old", "Old a", "draw 0", "New", "New a", "draw 1", "draw 2", "draw 3"]
    assert [(r["round"], r["promoted"], r["reloaded"]) for r in report] == [(1, 0, False), (4, 1, True), (7, 0, False)]
    empty = replace(loop, promote=lambda: 0, more=list, plan=lambda: False)
    assert seeding.seed_rounds(empty) == []


def test_rating_links(spark):
    card = '<h4 class="x elementor-heading-title"><a href="{}">t</a></h4>'
    inside = "".join(card.format(h) for h in ("/rating-announcements/A", "/RATING-announcements/a", "/news/b", "http://other.com/rating-announcement/c", "", "rating-announcement/d"))
    rows = [(0, f"<article>{inside}</article>{card.format('/rating-announcement/outside')}"), (1, card.format("/rating-announcement/e")), (2, None), (3, '<h4><a href="/rating-announcement/f">x</a></h4>')]
    got = web.rating_links(spark.createDataFrame(rows, "query_id int, html string"), "https://www.marc.com.my").orderBy("query_id", "pos").collect()
    base = "https://www.marc.com.my/rating-announcement"
    assert [(r["query_id"], r["url"]) for r in got] == [(0, f"{base}s/A"), (0, f"{base}/d"), (1, f"{base}/e")]


DETAIL = """<h3>Change of <b>director</b></h3><script>x</script><table><tr><td class="company_name">Acme Bhd</td></tr></table>
<div id="main"><div><h4>First</h4><p>skipped</p><table><tr><th>Name</th><td>Ann  Lee</td><td>Chair</td></tr><tr><td></td><td>only</td></tr></table></div>
<h4>Changes</h4><table class="big ven_table"><tr><td>No</td><td>Date</td><td>Units</td></tr><tr><td>Key</td><td>Value</td></tr></table><h3>x</h3><table><tr><td>not this</td></tr></table>
<div class="ven_announcement_info"><table><tr><td>Company Name</td><td>Other</td></tr><tr><td>Date Announced</td><td>05 Feb 2024</td></tr></table></div></div>"""


def test_disclosures(spark):
    rows = [(0, 1, "u1", DETAIL, ["f1", "f2"]), (0, 2, "u2", None, ["f3"]), (0, 3, "u3", "<h3>T</h3>", None)]
    df = spark.createDataFrame(rows, "query_id int, pos int, url string, html string, attachments array<string>")
    d = df.filter("pos = 1").select(web.disclosure_detail(F.col("html")).alias("d")).first()["d"]
    assert (d["title"], d["company"], str(d["source_date"])) == ("Change of\ndirector", "Acme Bhd", "2024-02-05")
    assert d["text"] == "Change of\ndirector\nAcme Bhd\n\nFirst\nName: Ann Lee\nChair\nonly\n\nChanges\nNo | Date | Units\nKey: Value"
    got = web.disclosure_documents(df, most=3).orderBy("pos").collect()
    assert [(r["url"], r["is_attachment"]) for r in got] == [("u1", False), ("f1", True), ("f2", True)]
    assert web.disclosure_documents(df).count() == 4
