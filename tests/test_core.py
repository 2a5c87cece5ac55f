"""Operators of the core against plain restatements and small fixtures."""

import glob
import json
import math
import os
import random
import re
from datetime import datetime, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from quayside.functions import text as X
from quayside.functions.rules import Hits, needed
from quayside.functions import rules
from quayside.operators import labels as L
from quayside.operators import measures as M
from quayside.operators import retrieval as R
from quayside.operators import timestamps as T
from quayside.operators import vectors as V
from quayside.operators.timestamps import normalise_timestamps, read_timestamp
from quayside.plans import catalogue
from quayside.plans.pipeline import EVIDENCE, dashboard, evidence, get_item, insights, run_all, search
from quayside.plans.runs import Frozen, create_run, export, freeze, rebuild, upsert
from quayside.session import table
from quayside.sources import readers
from quayside.streaming.ingest import collect_stream, read_items

SMALL = "/root/testdata/sf0.001"
micros = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    "value, zone, order, want",
    [
        ("2025-03-09 01:30:00", "America/New_York", None, micros(2025, 3, 9, 6, 30)),
        ("2025-03-09 02:30:00", "America/New_York", None, micros(2025, 3, 9, 7, 30)),  # skipped: the offset before the change
        ("2025-11-02 01:30:00", "America/New_York", None, micros(2025, 11, 2, 5, 30)),  # twice: the first
        ("05/06/2025 10:00", "Europe/London", "dmy", micros(2025, 6, 5, 9, 0)),
        ("05/06/2025 10:00", "America/New_York", "mdy", micros(2025, 5, 6, 14, 0)),
        ("1716824875.5", None, None, 1716824875_500000),
        ("1784685686559", None, None, 1784685686559_000),
        ("[1787875064, 288000999]", None, None, 1787875064_288000),
        ("20250325T190134Z", None, None, micros(2025, 3, 25, 19, 1, 34)),
        ("Fri, 04 Jul 2025 22:32:56 +0100", "Asia/Tokyo", None, micros(2025, 7, 4, 21, 32, 56)),
        ("2025-08-13 12:00:00 Pacific/Auckland", "Europe/Paris", None, micros(2025, 8, 13, 0, 0)),
        ("21 de marzo de 2024, 21:56", "Europe/Madrid", None, micros(2024, 3, 21, 20, 56)),
        ("August 22, 2024 at 12:17 AM", None, None, micros(2024, 8, 22, 0, 17)),
        ("2026年7月26日 18:08", "Asia/Tokyo", None, micros(2026, 7, 26, 9, 8)),
        ("2025-12-05T12:18:45.123456789Z", None, None, micros(2025, 12, 5, 12, 18, 45) + 123456),
        ("27 Aug 2025 18:19:38 CEST", None, None, micros(2025, 8, 27, 16, 19, 38)),
        ("31/02/2025 10:00", None, "dmy", None), ("0000-00-00", None, None, None), ("yesterday", None, None, None), ("", None, None, None), (None, None, None, None), ("2025-13-41", None, None, None),
    ],
)
def test_timestamp_notations(value, zone, order, want):
    got = [x for f, x in read_timestamp(value, zone, order) if not f.endswith("!")]
    assert (got or [None])[0] == want


def test_timestamps_mixture_and_edges(spark):
    zones = spark.createDataFrame([("en-US", "America/New_York", "mdy")], "locale string, zone_id string, date_order string")
    rows = [("s", f"{d}/03/2025 10:00", None, 1) for d in range(13, 29)] + [("s", "05/06/2025 10:00", None, 2), ("s", "05/06/2025 10:00", "EN_us", 3), ("s", None, None, 4), ("s", "edited", "", 5), ("s", "07/07/2025", None, 6)]
    df = spark.createDataFrame(rows, "source string, authored_at string, locale string, utc_extra int")
    got = {r["utc_extra"]: r for r in normalise_timestamps(df, zones).collect()}
    assert got[2]["utc_micros"] == micros(2025, 6, 5, 10, 0) and got[2]["ts_format"] == "dmy" and not got[2]["ts_ambiguous"]  # the source writes days first
    assert got[3]["utc_micros"] == micros(2025, 5, 6, 14, 0)
    against = [("t", "05/06/2025 10:00", "en-US", i) for i in range(40)] + [("t", "13/06/2025 10:00", None, 99)]
    turned = {r["utc_extra"]: r for r in normalise_timestamps(spark.createDataFrame(against, df.schema), zones).collect()}
    assert turned[0]["utc_micros"] == micros(2025, 5, 6, 14, 0) and turned[0]["ts_confidence"] > 0.9  # the locale's order is evidence
    assert T.mixture([(("dmy",), 30), (("dmy", "mdy"), 5), (("mdy",), 1)])["dmy", "mdy"][0] == "dmy" and 0.4 < T.mixture([(("dmy", "mdy"), 5)])["dmy", "mdy"][1] < 0.6
    assert normalise_timestamps(spark.createDataFrame([("u", "05/06/2025", None, 1)], df.schema), zones).first()["ts_ambiguous"]
    assert got[4]["utc_micros"] is None and got[5]["utc_micros"] is None and got[6]["ts_confidence"] == 1.0
    assert normalise_timestamps(df.limit(0), zones).count() == 0


def test_queries_agree_with_sql(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    sql, own = catalogue.oracle_sql(), catalogue.queries()
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else v
    for name, query in sql.items():
        a = own[name](spark, SMALL)
        cols = sorted(a.columns)
        mine = sorted((tuple(plain(r[x]) for x in cols) for r in a.collect()), key=repr)
        rel = c.sql(query)
        assert sorted(rel.columns) == cols, name
        at = [rel.columns.index(x) for x in cols]
        assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr), name


@pytest.mark.parametrize(
    "text, want",
    [
        ("The search bar can't find my photos", "retrieval_related"), ("Magic eraser ruined it", "unrelated"), ("Backup is stuck since the update", "unrelated"), ("", "unrelated"), ("Please let me share with my aunt", "ambiguous"),
        ("I deleted photos and cannot find them in the trash", "unrelated"), ("Looking for a picture of a dog", "retrieval_related"), ("Nice", "unrelated"),
    ],
)
def test_relevance(spark, text, want):
    df = spark.createDataFrame([(text, "keep")], "text string, relevance_note string")
    row = L.relevance(df).first()
    assert row["relevance"] == want and row["relevance_note"] == "keep"


def test_tone_signal_parents(spark):
    df = spark.createDataFrame([("Search is broken and I can't find anything",), ("search is easy and I love it",), ("café search bar is gone, date grouping too",), (None,)], "text string")
    h = Hits()
    got = h.add(df, {"t": L.tone(h), "s": L.signal(h, F.lit(False)), "l": L.with_parents(L.T.PAIN_POINTS.labels(h))}).collect()
    assert [r["t"] for r in got] == ["negative", "positive", "neutral", "neutral"]
    assert got[3]["s"] == "no_signal" and got[3]["l"] == []
    assert got[2]["l"] == ["design_missing_search_control", "design_date_grouping", "design_issues"]


def test_text_functions(spark):
    long_ = "word " * 60
    t = ["One sentence here. And more follows after it", "x" * 900, "", long_, "a\n" + "b" * 300]
    df = spark.createDataFrame([(x,) for x in t], "t string")
    snippets = [r[0] for r in df.select(X.fallback_snippet(F.col("t"))).collect()]
    for x, s in zip(t, snippets):
        cut = x.strip()
        assert s == (cut if len(cut) <= 180 else cut[:180].rsplit(" ", 1)[0])
    for x, s in zip(t, [r[0] for r in df.select(X.expand_prefix(F.col("t"), 10)).collect()]):
        assert s == X.expand_quote(x, x[:10]) or len(x) <= 10 or not x
    assert spark.createDataFrame([("<p>a&amp;b &lt;ok&gt;</p>\n c",)], "t string").select(X.strip_markup(F.col("t"))).first()[0] in ("a&b <ok> c", "a&b c")
    red = spark.createDataFrame([('{"a":{"Author":"x","l":[{"user":1}]}}',), ("no json",), (None,)], "t string").select(X.redact_keys(F.col("t"), ("author", "user"))).collect()
    assert json.loads(red[0][0]) == {"a": {"Author": "[redacted]", "l": [{"user": "[redacted]"}]}} and red[1][0] == "no json" and red[2][0] is None


def test_embedding_matches_restatement(spark):
    texts = ["find my photos of the beach 2024", "", "Ünïcode words and search search search"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["vector"] for r in V.hashed_embedding(df, "id", "t").collect()}
    assert set(got) == {0, 2}
    for i, v in got.items():
        assert v == pytest.approx(R.embed_query(texts[i]), abs=1e-12)


def test_edges_and_clusters(spark):
    rnd = random.Random(3)
    base = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.15) for x in base[i % 6]], i % 6) for i in range(60)] + [(60, [0.0] * 8, 9)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, l int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if any(a) and any(b) else 0.0
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and cos(a[1], b[1]) >= 0.9}
    e = V.similarity_edges(df, "id", "v", 0.9, block=16)
    assert {(r["a"], r["b"]) for r in e.collect()} == want
    parent = {i: i for i in range(61)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(r["root"] == find(r["node"]) for r in V.clusters(e).collect())
    report = {r["root"]: r for r in V.cluster_report(df, "id", "v", "l", 0.9).collect()}
    members = [i for i in range(61) if find(i) == find(0)]
    pairs = [cos(rows[i][1], rows[j][1]) for i in members for j in members if i < j]
    assert report[find(0)]["size"] == len(members) and report[find(0)]["cohesion"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-4)


def test_topk_plan_is_a_bounded_sort(spark):
    plan = catalogue.queries()["cosine_topk"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_readers(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    feed = {"feed": {"entry": [{"id": {"label": "0"}, "im:name": {"label": "App"}}, {"id": {"label": "1"}, "im:rating": {"label": "5"}, "title": {"label": "Hi"}, "content": {"label": "Body"}, "updated": {"label": "2025-01-01"}}, {"id": {"label": "1"}, "im:rating": "4", "title": {"label": "Hi"}, "content": {"label": "Again"}}]}}
    got = readers.app_store_feed(spark, put("a.json", json.dumps(feed))).collect()
    assert [r["native_id"] for r in got] == ["1"] and got[0]["text"].startswith("Hi\n")
    lone = {"feed": {"entry": {"id": {"label": "7"}, "im:rating": "3", "content": {"label": "x"}}}}
    assert readers.app_store_feed(spark, put("b.json", json.dumps(lone))).count() == 1
    inner = json.dumps([[["r1", ["u"], 5, None, "good", [1700000000, 525000000], None, ["x", "thanks"]], ["r2", ["u"], 1, None, "bad", None]], [None, "tok"]])
    rpc = ")]}'\n" + json.dumps([["wrb.fr", "UsvDTd", inner, None]])
    rows = {r["native_id"]: r for r in readers.play_rpc(spark, put("p.txt", rpc)).collect()}
    assert rows["r1"]["text"] == "good" and rows["r1"]["authored_at"] == "2023-11-14T22:13:20.525Z" and rows["r1"]["developer_reply"] == "thanks" and rows["r2"]["authored_at"] is None
    objects = ")]}'\n" + json.dumps([["wrb.fr", "UsvDTd", json.dumps([{"reviewId": "q", "text": "t", "score": 4, "date": "2025-02-03"}]), None]])
    assert readers.play_rpc(spark, put("o.txt", objects)).first()["authored_at"] == "2025-02-03"
    assert readers.play_rpc(spark, put("h.txt", "<html>no</html>")).count() == 0
    dump = {"data": {"children": [{"data": {"id": "x", "title": "T", "selftext": "[deleted]", "created_utc": 1700000000, "permalink": "/r/a"}}]}}
    r = readers.reddit_dump(spark, put("r.json", json.dumps(dump))).first()
    assert r["native_id"] == "post:x" and r["text"] == "T" and r["source_url"] == "https://www.reddit.com/r/a" and r["authored_at"] == "1700000000"
    page = "<html><title>Find &amp; seek - Help</title><div data-message-type='q'>Where <b>is</b> it?</div><div class='x cc-reply'>Here</div><article>There</article></html>"
    h = readers.help_pages(spark, put("t9.html", page)).first()
    assert (h["title"], h["text"], h["thread_context"], h["native_id"]) == ("Find & seek - Help", "Where is it?", "Here\n---\nThere", "t9")
    assert readers.parse_thread("<title>Sign in</title>") is None
    out = {"receipts": {"reddit": {"status": "odd", "notes": "n"}}, "raw": {"app_store": [{"native_id": "a", "text": "one", "source_url": "u2"}, {"native_id": "a", "text": "two", "source_url": "u1"}], "reddit": []}}
    path = put("e.json", json.dumps(out))
    assert [r["text"] for r in readers.export_json(spark, path).collect()] == ["one"]
    assert readers.export_receipts(spark, path).first()["status"] == "partial"
    lines = put("l.jsonl", '{"key":"k","in_scope":true}\n{"key":"k","in_scope":false,"pain_points":["a"]}\nbroken\n')
    assert readers.curated_labels(spark, lines).first()["in_scope"] is False
    gold = put("g.json", json.dumps({"items": [{"id": "1", "text": "t", "labels": ["a"]}]}))
    assert readers.gold_items(spark, gold).count() == 1
    urls = spark.createDataFrame([("<a href='/x/thread/12'> https://h.example/thread/12 https://o.example/thread/9",)], "p string").select(readers.thread_urls(F.col("p"), "h.example")).first()[0]
    assert urls == ["https://h.example/thread/12"]
    nodes = spark.createDataFrame([("a", None), ("a", None), ("b", "zz")], "id string, parent_id string")
    assert {(r[0], r[1]) for r in readers.taxonomy_problems(nodes).collect()} == {("duplicate id", "a"), ("unknown parent", "b")}


def test_run_lifecycle(spark, tmp_path):
    root = str(tmp_path / "runs")
    run = create_run(spark, root, "r1", {"x": 1})
    raw = table(spark, SMALL, "collected_item")
    out = run_all(run, raw, table(spark, SMALL, "locale_zone"), table(spark, SMALL, "taxonomy_node"))
    assert out["collect"]["records"] == raw.count() and out["normalize"]["items"] <= raw.count()
    tagged = run.read("tagged_item")
    shown = insights(tagged)
    for kind, counts in shown.items():
        for value, n in counts.items() if kind != "kpi" else ():
            assert evidence(tagged, kind, value).count() == n
    assert evidence(tagged, "suggestion").count() == shown["kpi"]["suggestion_items"]
    by_tone = [evidence(tagged, "search_type", next(iter(shown["search_type"])), t).count() for t in ("positive", "negative", "neutral")]
    assert sum(by_tone) == next(iter(shown["search_type"].values()))
    assert {"raw_record_id", "captured_at"} <= set(tagged.columns) and run.read("label").filter("snippets_json = '[]'").isEmpty()
    assert evidence(tagged, "relevant").count() == sum(shown["source"].values()) and "relevant" in EVIDENCE
    found = search(run, R.Search("search bar shows random pictures"))
    assert found["status"] == "ok" and all(h["quote"] for h in found["hits"])
    assert search(run, R.Search("capital of France"))["status"] == "out_of_scope" and search(run, R.Search(" "))["status"] == "empty"
    assert len(found["answer"]["evidence"]) <= 2 and found["answer"]["summary"]
    assert search(run, R.Search("search bar shows random pictures", sources=("nowhere",)))["status"] == "filtered_out"
    pain = search(run, R.Search("What are the main pain points around photo search?"))
    assert pain["answer"]["format"] == "pain_points" and pain["answer"]["evidence"]
    reply = json.dumps({"summary": "They miss pictures.", "citations": [{"id": found["hits"][0]["id"], "quote": found["hits"][0]["quote"][:20]}, {"id": "x", "quote": "not there"}]})
    told = search(run, R.Search("search bar shows random pictures"), complete=lambda prompt: reply)
    assert told["answer"]["summary"] == "They miss pictures." and told["answer"]["evidence"][0]["context"] == "cited"
    turned = search(run, R.Search("search bar shows random pictures", top=3), rerank=lambda q, texts: [float(len(t)) for t in texts])
    assert len(turned["hits"]) == 3 and turned["hits"][0]["relevance"] >= 1
    board = dashboard(run, table(spark, SMALL, "taxonomy_node"), 10**6)
    assert not board["meets_target"] and board["index"] and any(g["kind"] == "corpus_target" for g in board["known_gaps"])
    one = get_item(run, found["hits"][0]["id"])
    assert one["citable"] and get_item(run, "nobody") is None
    severities = [r[0] for r in run.read("category").select("severity").collect()]
    assert all(0 <= s <= 1 for s in severities)
    assert freeze(run, dry_run=True) == "would_freeze" and freeze(run) == "frozen" and freeze(run) == "already_frozen"
    with pytest.raises(Frozen):
        run.write("more", raw)
    export(run, str(tmp_path / "bundle"), ["collected_item"], {"collected_item": ["raw_api_payload"]})
    again = rebuild(run, "r2")
    assert run_all(again, raw, table(spark, SMALL, "locale_zone"), table(spark, SMALL, "taxonomy_node"), collected=True)["normalize"] == out["normalize"]
    again.append("note", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    again.upsert("note", spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert {tuple(r) for r in again.delete("note", spark.createDataFrame([(1,)], "k int"), ["k"]).collect()} == {(2, "c"), (3, "d")}
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert {(r[0], r[1]) for r in upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c")}


def test_stream(spark, tmp_path):
    raw = table(spark, SMALL, "collected_item").select("raw_record_id", "source", "native_id", "captured_at", "text")
    raw.unionByName(raw.limit(20)).repartition(2).write.parquet(str(tmp_path / "in"))
    q = collect_stream(read_items(spark, str(tmp_path / "in"), raw.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("source", "native_id").distinct().count() == got.count()


def test_stream_keeps_late_rows(spark, tmp_path):
    rows = [("a", "1", "2026-12-01T00:00:00Z"), ("a", "2", "2023-03-01T00:00:00Z"), ("a", "1", "2026-12-02T00:00:00Z"), ("a", "3", "2024-05-01T00:00:00Z")]
    for r in rows:
        df = spark.createDataFrame([r], "source string, native_id string, captured_at string").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
    q = collect_stream(read_items(spark, str(tmp_path / "in"), df.schema, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r["native_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def _fake():
    seen = {}

    def client(prompts):
        out = []
        for p in prompts:
            seen[p] = seen.get(p, 0) + 1
            if "never" in p:
                out.append("no json")
            elif "second" in p and seen[p] == 1:
                out.append("{broken")
            else:
                out.append('```json\n{"labels": ["a", "zz", "a"], "confidence": 1.5, "rationale": "", "snippets": ["text", "absent"]}\n```')
        return out

    return client


def test_model_labels(spark):
    from quayside.operators import models

    items = spark.createDataFrame([("1", "text one"), ("2", "second text"), ("3", "never text"), ("4", "done text"), ("5", None)], "id string, text string")
    done = spark.createDataFrame([("4", "ok"), ("1", "failed")], "id string, status string")
    got = {r["id"]: r for r in models.classify(items, _fake, "Label: {{text}}", ["a", "b"], done=done).collect()}
    assert set(got) == {"1", "2", "3", "5"} and got["3"]["status"] == "unclassified" and got["3"]["labels"] == []
    assert got["1"]["labels"] == ["a"] and got["1"]["confidence"] == 0.4 and got["1"]["snippets"] == ["text"] and got["2"]["status"] == "ok"
    tagged = items.withColumn("labels", F.array(F.lit("b")))
    merged = {r["id"]: (r["labels"], r["label_source"]) for r in models.merge_second_pass(tagged, models.classify(items, _fake, "{{text}}", ["a"])).collect()}
    assert merged["3"] == (["b"], "rules") and merged["1"] == (["a"], "model")
    assert models.cited({"citations": [{"id": 1, "quote": "x y"}, {"id": 1, "quote": "z"}]}, {"1": "w x y"}) == [{"id": 1, "quote": "x y"}]


@pytest.mark.parametrize(
    "question, want",
    [
        ("how do I train the model?", False), ("write a Python scraper for Play Store", False), ("what is RAG?", False), ("Google Photos billing and subscription", False), ("openai chatgpt photos search", False), ("gemini api search", False),
        ("scrape the play store and find photos", False), ("", False), ("old pictures", True), ("can't remember when the photo was taken", True), ("Google Photos search not finding people", True), ("google photos", True), ("incomplete memory", True),
        ("What are the main user pain points around Google Photos search?", True), ("What is sentiment like for search in this feedback?", True),
    ],
)
def test_scope(question, want):
    assert R.in_scope(question) is want


OUTSIDE = [
    ("app_store", "the edit button is at the bottom for pictures in unshared albums but it is not available on photos in albums I have shared"), ("app_store", "The export frame for video is now hard to find and it doesn't even work correctly"),
    ("help_community", "There is a bug in the Creations Module, I've edited a highlight which is getting processed from yesterday (it's stuck). My wifi and internet connection is stable."), ("help_community", "Accidently shared photos. How can I undo this?"),
    ("help_community", "I want to get back my permanently deleted data from recycle bin"), ("help_community", "Can't Find the Photos Google Deleted"), ("help_community", "Is there a way to rename my downloaded files? I can't find it in the three dot menu."),
    ("play_store", "why did you have to screw up the magic eraser?"), ("app_store", "recently, there is an animated shimmer over the subject of a photo when you open it. i cannot find a way to turn this off."),
]
INSIDE = [
    "Great app! I can find photos of specific people, specific years, or documents! its great!", "it's horrible. I can't find half the photos I want to send to people.", "How to search for group photos? Searching for group photos did not filter out the results I wanted.",
    "The more like this search function on individual photos is nowhere to be found. Where did it go?", "Date grouping disappeared! an update removed the photos being grouped by date.", "Face search categories are inconsistent, app will separate people into two different profiles",
    "did you guys nerf the search function. now it says we can't find the search your looking for", "Can you search for photos just by their locations", "TIL. You can search your images for what they contain",
]
CHROME = "Stop back up videos - Google Photos Community Skip to main content Google Photos Help Sign in Privacy Policy Search Help Center Clear search Can't find your photos? Close search Search 105394"


def test_relevance_of_examples(spark):
    title = "Stop back up videos - Google Photos Community"
    rows = [(s, t, None, False) for s, t in OUTSIDE] + [("reddit", t, None, True) for t in INSIDE] + [("help_community", CHROME, title, False)]
    df = spark.createDataFrame(rows, "source string, text string, title string, inside boolean")
    assert [r["text"] for r in L.relevance(df, "text", "source", "title").collect() if (r["relevance"] == "retrieval_related") != r["inside"]] == []
    clean = df.filter("title is not null").select(X.strip_chrome(F.col("text"), F.col("title"))).first()[0]
    assert clean == "Stop back up videos"


def test_signals_of_examples(spark):
    rows = [
        ("a", "reddit", "comment", "Doesn't sound particularly serious after reading your subsequent posts. Find them and put them in an album called pictures of myself. Good luck."),
        ("b", "reddit", "", "Face search categories are inconsistent, app will separate people into two different profiles"), ("c", "play_store", "", "I can't ever find my pictures!"),
        ("d", "reddit", "comment", "Try to search by 'lenovo' or model number. That should give you all photos taken using the phone."), ("e", "app_store", "", "I can no longer search my photos for people, colors, objects or words. The option to search using name or event is no longer available."),
        ("f", "app_store", "", "Lost the search bar; Gemini pop-up blocks the screen and search results never load."), ("g", "reddit", "", "Helpful hack: How I manually tag unrecognized people in my photos Google Photos does not currently allow manually tagging faces"),
    ]
    df = spark.createDataFrame(rows, "id string, source string, kind string, text string")
    got = {r["id"]: r for r in L.annotate(df, kind=F.col("kind")).collect()}
    assert got["a"]["signal"] == "no_signal" and got["a"]["search_types"] == [] and got["a"]["is_forum_reply"]
    assert {"system_face_grouping", "system_issues"} <= set(got["b"]["labels"]) and got["c"]["labels"] == [] and got["d"]["labels"] == []
    assert {"people_pets", "objects", "events"} <= set(got["e"]["search_types"]) and "search_ai_search" in got["f"]["search_types"] and got["g"]["tone"] == "neutral"
    assert got["b"]["snippets"] == [rows[1][3]] and got["b"]["label_confidence"] == 0.64


def test_curated_labels_override(spark):
    rows = [("a", "reddit", "1", "Search is broken and the search bar is gone"), ("b", "reddit", "2", "nothing here"), ("c", "reddit", None, "search bar is gone"), ("d", "reddit", "4", "can't find anything, search bar")]
    tagged = L.annotate(L.relevance(spark.createDataFrame(rows, "id string, source string, native_id string, text string")))
    curated = spark.createDataFrame(
        [("reddit:1", False, False, "actionable", "positive", ["system_search_bugs"], ["places"], True), ("reddit:2", True, False, "actionable", None, ["knowledge_hidden_features", "zz"], None, False), ("reddit:4", True, True, "actionable", "negative", ["system_search_bugs"], ["places"], True)],
        "key string, in_scope boolean, is_forum_reply boolean, signal string, sentiment string, pain_points array<string>, search_types array<string>, is_suggestion boolean",
    )
    got = {r["id"]: r for r in L.apply_curated(tagged, curated).collect()}
    assert got["a"]["relevance"] == "unrelated" and got["a"]["labels"] == [] and got["a"]["tone"] == "positive" and got["a"]["search_types"] == ["places", "search_ai_search"]
    assert got["b"]["labels"] == ["knowledge_unknown_capability", "knowledge_awareness_gaps"] and got["b"]["relevance"] == "retrieval_related" and got["b"]["tone"] == "neutral" and got["b"]["label_confidence"] == 1.0
    assert got["c"]["label_source"] == "rules" and got["d"]["search_types"] == [] and got["d"]["signal"] == "no_signal" and not got["d"]["is_suggestion"]


def test_needed_strings_never_hide_a_match(spark):
    rnd = random.Random(4)
    patterns = [p for _, p in (*L.T.PAIN_POINTS.rules, *L.T.SEARCH_TYPES.rules, *L.T.THEMES_OUTSIDE.rules)] + [L.T.PAIN, L.T.SUGGESTION, L.T.FORUM_SOLUTION, L.T.SEARCH_SIGNAL]
    words = sorted({w for p in patterns for s in needed(p) for w in s.split()}) + ["the", "my", "was", "\u017fearch", "F\u0130ND", "photo\u017f"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(4000)]
    for p in patterns:
        for t in texts:
            if re.search(p, t, re.I):
                low = t.lower() if t.isascii() else t.translate(rules._ALSO).lower()
                assert not needed(p) or any(w in low for w in needed(p)), (p, t)


def test_near_edges_find_what_is_near(spark):
    rnd = random.Random(9)
    base = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(f"k{i:04d}", [x + rnd.gauss(0, 0.25) for x in base[i % 40]]) for i in range(1200)] + [("zero", [0.0] * 16)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    exact = {(r["a"], r["b"]): r["cos"] for r in V.similarity_edges(df, "id", "v", 0.8).collect()}
    near = {(r["a"], r["b"]): r["cos"] for r in V.near_edges(df, "id", "v", 0.8, members=50, block=16).collect()}
    assert set(near) <= set(exact) and len(near) >= 0.99 * len(exact) > 10_000


def test_gaps(spark):
    rows = [("reddit", "failed", None), ("help_community", "success", "CSE quota reached"), ("reddit", "success", "arctic outage"), ("app_store", "success", None), ("reddit", "failed", None)]
    got = {(r["kind"], r["source"]) for r in M.gaps(spark.createDataFrame(rows, "source string, status string, notes string"), 3, 500, indexed=False).collect()}
    assert got == {("adapter", "reddit"), ("cse_quota", "help_community"), ("arctic_shift", "reddit"), ("corpus_target", "all"), ("vector_index", "rag")}
