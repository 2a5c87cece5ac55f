"""The stages of a run from raw records to aggregates, and what a dashboard asks of them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import text as X
from quayside.functions import rule_tables as T
from quayside.functions.rule_tables import SOURCES
from quayside.operators.labels import alias, annotate, apply_curated, overlay, post_kind, relevance
from quayside.operators.measures import gaps, scored_categories
from quayside.operators.models import cited_summary
from quayside.operators.retrieval import Search, build_index, candidates, chunks, in_scope, load_index, retrieve
from quayside.operators.timestamps import normalise_timestamps
from quayside.plans.runs import Run
from quayside.sources.readers import first_wins


def normalize(raw: DataFrame, zones: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, curated: DataFrame | None = None) -> DataFrame:
    """Raw records to items: the first of each key, cleaned, titled, dated, addressed, with relevance; the raw record's id stays.

    ``keep`` is a further filter of the raw records, such as one that leaves out residue; ``curated`` (key, in_scope)
    overrides the rules.
    """
    have = [c for c in ("raw_record_id", "captured_at", "source", "native_id", "text", "title", "authored_at", "source_url", "locale", "thread_context", "has_user_text", "raw_api_payload") if c in raw.columns]
    order = tuple(c for c in ("captured_at", "raw_record_id") if c in have) or ("source_url",)
    c = first_wins(raw.select(*have), order).filter(F.coalesce("has_user_text", F.lit(True)))
    c = keep(c) if keep else c
    x = c.withColumn("text", X.canonical_text(F.col("text"), F.col("title"), F.col("source"))).filter(F.length("text") > 0)
    x = x.withColumn("source_url", X.thread_url(F.col("source"), F.col("native_id"), F.col("source_url")))
    x = x.withColumn("id", F.concat(F.lit("fi-"), F.substring(F.sha2(F.concat_ws("|", "source", "native_id"), 256), 1, 16)))
    out = relevance(normalise_timestamps(x, zones), "text", "source", "title")
    if curated is None:
        return out
    k = curated.select(F.col("key").alias("_key"), F.when(F.coalesce("in_scope", F.lit(False)), "retrieval_related").otherwise("unrelated").alias("_label"))
    out = out.join(k, F.concat_ws(":", "source", "native_id") == F.col("_key"), "left")
    known = F.col("_key").isNotNull()
    return out.withColumns({"relevance_score": F.when(known, 1.0).otherwise(F.col("relevance_score")), "relevance": F.when(known, F.col("_label")).otherwise(F.col("relevance"))}).drop("_key", "_label")


def analyze(items: DataFrame, curated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items with their tags, (id, node, confidence, quotes as JSON) of their labels)."""
    kind = post_kind(F.col("raw_api_payload")) if "raw_api_payload" in items.columns else None
    tagged = annotate(items, kind=kind)
    tagged = apply_curated(tagged, curated) if curated is not None else tagged
    tagged = tagged.withColumn("overlay", overlay(F.col("labels")))
    labels = tagged.filter("relevance = 'retrieval_related'").select("id", F.explode("labels").alias("node"), F.col("label_confidence").alias("confidence"), F.to_json("snippets").alias("snippets_json"))
    return tagged, labels


def run_all(run: Run, raw: DataFrame, zones: DataFrame, nodes: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, curated: DataFrame | None = None, collected: bool = False) -> dict[str, dict]:
    """All stages in order; each reads what the one before it has written.

    ``collected``: the raw records are in the run already, as after :func:`quayside.plans.runs.rebuild`.
    """
    out = {}

    def collect() -> dict:
        return {"records": (run.read("collected_item") if collected else run.write("collected_item", raw)).count()}

    def normal() -> dict:
        items = run.write("feedback_item", normalize(run.read("collected_item"), zones, keep, curated))
        by = {r["relevance"]: r["count"] for r in items.groupBy("relevance").count().collect()}  # three labels
        return {"items": sum(by.values())} | by

    def analysis() -> dict:
        tagged, labels = analyze(run.read("feedback_item"), curated)
        run.write("tagged_item", tagged)
        return {"labels": run.write("label", labels).count()}

    def index() -> dict:
        items = run.read("tagged_item").withColumn("relevance_label", F.col("relevance"))
        c = run.read("label").select(F.col("id").alias("feedback_item_id"), F.col("node").alias("taxonomy_node_id"), "confidence", "snippets_json")
        s = scored_categories(run.read("tagged_item"), run.read("label"))
        return {"chunks": build_index(chunks(items, c, s, nodes), f"{run.path}/index").count()}

    def aggregate() -> dict:
        return {"categories": run.write("category", scored_categories(run.read("tagged_item"), run.read("label"))).count()}

    for name, work in zip(("collect", "normalize", "analyze", "index", "aggregate"), (collect, normal, analysis, index, aggregate)):
        out[name] = run.stage(name, work)
    return out


EVIDENCE = {
    "relevant": lambda v, tone: F.lit(True),
    "source": lambda v, tone: F.col("source") == v,
    "sentiment": lambda v, tone: F.col("tone") == v.lower(),
    "signal": lambda v, tone: F.col("signal") == v.lower(),
    "search_type": lambda v, tone: F.array_contains("search_types", v) & ((F.col("tone") == tone.lower()) if tone else F.lit(True)),
    "suggestion": lambda v, tone: F.col("is_suggestion"),
    "category_frequency": lambda v, tone: F.exists("labels", lambda x: alias(x) == T.ALIASES.get(v, v)),
    "hypothesis": lambda v, tone: F.col("overlay") == v,
    "segment": lambda v, tone: F.col(v.partition("=")[0]) == (v.partition("=")[2] or "unknown"),
    "workaround": lambda v, tone: F.array_contains("labels", "workarounds_succeeded"),
}


def evidence(tagged: DataFrame, kind: str, value: str = "", tone: str = "") -> DataFrame:
    """The items behind a shown number; as many as it says. An unknown kind raises KeyError."""
    quote = X.expand_in(F.col("text"), F.substring("text", 1, 160))
    return tagged.filter("relevance = 'retrieval_related'").filter(EVIDENCE[kind](value, tone)).select("id", "source", "source_url", "authored_at", quote.alias("quote"))


def insights(tagged: DataFrame) -> dict[str, dict[str, int]]:
    """Counts by source, tone, signal, search type, overlay and label of the relevant items, and the key figures: one row per value, all bounded."""
    x = tagged.filter("relevance = 'retrieval_related'")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    named = [entry("source", F.col("source")), entry("sentiment", F.col("tone")), entry("signal", F.col("signal")), entry("hypothesis", F.col("overlay"))]
    flags = [F.when(F.col("is_suggestion"), entry("kpi", F.lit("suggestion_items"))), F.when(F.size("search_types") > 0, entry("kpi", F.lit("search_typed_count")))]
    lists = [F.transform("search_types", lambda v: entry("search_type", v)), F.transform("labels", lambda v: entry("category_frequency", v))]
    every = x.select(F.explode(F.concat(F.array_compact(F.array(*named, *flags)), *lists)).alias("e")).select("e.*")
    out: dict[str, dict[str, int]] = {"source": dict.fromkeys(SOURCES, 0), "sentiment": {}, "signal": {}, "hypothesis": {}, "search_type": {}, "category_frequency": {}, "kpi": {"suggestion_items": 0, "search_typed_count": 0}}
    for r in every.groupBy("k", "v").count().collect():
        out[r["k"]][r["v"]] = r["count"]
    labels, parents = out["category_frequency"], set(T.PARENTS.values())
    return out | {"kpi": out["kpi"] | {"sub_theme_count": sum(n in T.PARENTS for n in labels), "overarching_theme_count": sum(n in parents for n in labels), "actionable_count": out["signal"].get("actionable", 0)}}


def dashboard(run: Run, nodes: DataFrame, target: int = 500) -> dict:
    """What a dashboard shows of a run: counts, categories in order, trend, gaps, status of the index."""
    tagged, shown = run.read("tagged_item"), {}
    shown = insights(tagged)
    relevant = sum(shown["source"].values())
    n = nodes.select(F.col("id").alias("node"), "name", "parent_id").dropDuplicates(["node"])
    rows = [r.asDict() for r in run.read("category").join(F.broadcast(n.limit(10_000)), "node", "left").orderBy("place").collect()]  # one row a node of the taxonomy
    month = F.when(F.col("authored_at").rlike("^[0-9]{4}-[0-9]{2}"), F.substring("authored_at", 1, 7)).otherwise("Unknown")
    trend = {r["m"]: r["count"] for r in tagged.filter("relevance = 'retrieval_related'").groupBy(month.alias("m")).count().collect()}  # months
    receipts = run.log().filter("kind = 'stage'").select(F.col("stage").alias("source"), "status", F.col("note").alias("notes"))
    support = lambda r: r["frequency"] >= 5 and r["diversity"] >= 2
    return {
        "relevant_count": relevant, "meets_target": relevant >= target, "counts": shown, "categories": rows, "high_impact": [r for r in rows if support(r)][:5],
        "low_support": [r for r in rows if not support(r)], "trend": dict(sorted(trend.items())), "known_gaps": [r.asDict() for r in gaps(receipts, relevant, target, run.has("index")).collect()], "index": run.has("index"),
    }


def get_item(run: Run, item_id: str) -> dict | None:
    """One item with its labels and their quotes, each quote grown to its sentence."""
    r = run.read("tagged_item").filter(F.col("id") == item_id).limit(1).collect()
    if not r:
        return None
    labels = run.read("label").filter(F.col("id") == item_id).limit(100).collect()
    text = r[0]["text"] or ""
    quotes = lambda x: [q for q in json.loads(x["snippets_json"] or "[]") if isinstance(q, str)]
    return r[0].asDict() | {"citable": bool(r[0]["source_url"]), "classifications": [{"node": x["node"], "confidence": x["confidence"], "snippets": quotes(x), "expanded_snippets": [X.expand_quote(text, q) for q in quotes(x)]} for x in labels]}


def pick_evidence(tagged: DataFrame, query: str, hits: list[dict], least: float = 0.22) -> list[dict]:
    """At most two items that support an answer.

    A question about sentiment gets one negative and one neutral (else positive) item, one about pain points two items
    of the most frequent theme, one about the search assistant an item of that type; any other the hits whose quotes
    share most words with it, or the first hits where none shares ``least``.
    """
    low = query.lower()
    x = tagged.filter("relevance = 'retrieval_related'").filter(F.trim("source_url") != "")
    shown = lambda df, why: [{"item_id": r["id"], "snippet": r["quote"], "source": r["source"], "source_url": r["source_url"], "context": why} for r in df.select("id", "source", "source_url", X.expand_in(F.col("text"), F.substring("text", 1, 240)).alias("quote")).collect()]
    if re.search(r"\bsentiment\b", low):
        terms = sum((F.lower("text").contains(t).cast("int") for t in ("search", "find", "photo", "face", "ai", "ask photos")), F.lit(0))
        of = lambda tone: shown(x.filter((F.col("tone") == tone) & (F.length("text") > 40)).orderBy(terms.desc(), "id").limit(1), f"{tone} sentiment")
        if found := of("negative") + (of("neutral") or of("positive")):
            return found[:2]
    if re.search(r"\bpain\s+points?\b", low):
        top = x.select(F.explode("labels").alias("n")).filter(F.col("n").isin(*set(T.PARENTS.values()))).groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
        if top:
            return shown(x.filter(F.array_contains("labels", top[0]["n"])).orderBy(F.desc("label_confidence"), "id").limit(2), top[0]["n"])
    if re.search(r"\bai\s+search\b|ask\s+photos", low):
        if found := shown(x.filter(F.array_contains("search_types", "search_ai_search")).orderBy("id").limit(1), "search assistant"):
            return found
    words = set(re.findall("[a-z0-9]+", low))
    share = lambda h: len(words & set(re.findall("[a-z0-9]+", (h["quote"] or "").lower()))) / len(words) if words else 0.0
    good = sorted((h for h in hits if share(h) >= least), key=lambda h: -share(h)) or hits
    return [{"item_id": h["id"], "snippet": h["quote"], "source": h["source"], "source_url": h["source_url"], "context": "closest match"} for h in good[:2]]


def compose_answer(tagged: DataFrame, query: str, hits: list[dict], cited: dict | None = None) -> dict:
    """A summary with figures where the question asks for them, and at most two quotes; a cited summary of a model goes first."""
    low, shown = query.lower(), {}
    percent = lambda part, whole: round(100 * part / whole) if whole > 0 else 0
    out = {"format": "narrative", "stats": []}
    if cited and cited.get("summary"):
        out |= {"summary": cited["summary"]}
    elif re.search(r"\bpain\s+points?\b|\bfrustrations?\b|\bcomplaints?\b", low):
        shown = insights(tagged)["category_frequency"]
        top = sorted(((n, k) for k, n in shown.items() if k in set(T.PARENTS.values())), key=lambda x: (-x[0], x[1]))[:4]
        out |= {"format": "pain_points", "stats": [{"label": k, "value": n} for n, k in top], "summary": f"Lead theme: {top[0][1]} ({top[0][0]} items)." if top else "Limited pain-point labels in this snapshot."}
    elif re.search(r"\bsentiment\b|\bnegative\b|\bpositive\b|\bfeel\b", low):
        shown = insights(tagged)["sentiment"]
        total = sum(shown.values())
        part = {k: percent(shown.get(k, 0), total) for k in ("negative", "neutral", "positive")}
        out |= {"format": "sentiment", "stats": [{"label": k, "value": f"{v}%", "detail": shown.get(k, 0)} for k, v in part.items()], "summary": ", ".join(f"{v}% {k}" for k, v in part.items())}
    else:
        themes = list(dict.fromkeys(c for h in hits[:6] for c in h.get("categories") or []))[:3]
        out |= {"summary": (f"Closest feedback to \u201c{query.strip()}\u201d." + (f" Themes: {', '.join(themes)}." if themes else "")) if hits else "No closely matching feedback was retrieved for that wording."}
    by = {str(h["id"]): h for h in hits}
    quoted = [{"item_id": c["id"], "snippet": c["quote"], "source": by.get(str(c["id"]), {}).get("source"), "source_url": by.get(str(c["id"]), {}).get("source_url"), "context": "cited"} for c in (cited or {}).get("citations", [])[:2]]
    more = [e for e in (pick_evidence(tagged, query, hits) if len(quoted) < 2 else []) if e["item_id"] not in {q["item_id"] for q in quoted}]
    return out | {"evidence": (quoted + more)[:2]}


def search(run: Run, request: Search, complete: Callable[[str], str] | None = None, rerank: Callable[[str, list[str]], list[float]] | None = None) -> dict:
    """Hits of a request and an answer, or why there are none: empty, out_of_scope, no_index, no_match, filtered_out.

    ``complete`` is a model's completion; a summary of it counts only with quotes that stand in the hits.
    """
    if not request.query.strip():
        return {"status": "empty", "hits": []}
    if not in_scope(request.query):
        return {"status": "out_of_scope", "hits": []}
    try:
        index = load_index(run.spark, f"{run.path}/index")
    except FileNotFoundError:
        return {"status": "no_index", "hits": []}
    hits = [r.asDict() for r in retrieve(index, request, rerank=rerank).collect()]  # at most ``top`` rows
    tagged = run.read("tagged_item")
    if not hits:
        if not candidates(index, request).isEmpty():
            return {"status": "filtered_out", "hits": []}
        if re.search(r"pain\s+points?|sentiment|key\s+findings?|overall|themes?|how\s+(?:is|are)\s+users?", request.query.lower()):
            return {"status": "ok", "hits": [], "answer": compose_answer(tagged, request.query, [])}
        return {"status": "no_match", "hits": []}
    texts = {str(r["id"]): r["text"] or "" for r in tagged.filter(F.col("id").isin(*[h["id"] for h in hits])).select("id", "text").collect()} if complete else {}
    summary = cited_summary(complete, request.query, texts) if complete else None
    return {"status": "ok", "hits": hits, "answer": compose_answer(tagged, request.query, hits, summary)}
