"""Labels by a model: prompts, tolerant parsing, validation, retries, resume.

The client is injected: a function from a list of prompts to a list of replies, made on the worker by a factory, so
that connections aren't pickled.  An invalid reply is tried once more and then leaves the item unclassified; it never
falls through to rules.  Keys that an audit table holds as done are skipped by an anti join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[str]], list[str]]
SCHEMA = "labels array<string>, confidence double, rationale string, snippets array<string>, status string"


def fill(template: str, **values: str) -> str:
    for k, v in values.items():
        template = template.replace("{{" + k + "}}", v or "")
    return template


def parse_object(reply: str | None) -> dict | None:
    """The JSON object of a reply: fenced, or from the first brace to the last."""
    if not reply:
        return None
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", reply, re.S)
    bare = re.search(r"\{.*\}", reply, re.S)
    for m in (fenced and fenced.group(1), bare and bare.group(0)):
        if m:
            try:
                out = json.loads(m)
            except ValueError:
                continue
            if isinstance(out, dict):
                return out
    return None


def validate(reply: dict, text: str, known: frozenset[str]) -> tuple[list[str], float, str, list[str]]:
    """Known labels, a confidence in 0..1 (demoted where no reason is given), quotes that stand in the text."""
    labels = [x for x in dict.fromkeys(reply.get("labels") or []) if x in known]
    try:
        confidence = min(1.0, max(0.0, float(reply.get("confidence"))))
    except (TypeError, ValueError):
        confidence = 0.0
    reason = str(reply.get("rationale") or "").strip()
    if not reason and confidence >= 0.8:
        confidence = 0.4
    quotes = [q for q in dict.fromkeys(reply.get("snippets") or []) if isinstance(q, str) and q and q in text]
    return labels, confidence if labels else 0.0, reason, quotes


def classify(items: DataFrame, make_client: Callable[[], Client], template: str, known: list[str], key: str = "id", text: str = "text", done: DataFrame | None = None, attempts: int = 2, batch: int = 32) -> DataFrame:
    """(key, labels, confidence, rationale, snippets, status) of the items that ``done`` (key, status) doesn't hold as ok."""
    todo = items.select(F.col(key), F.col(text).alias("t"))
    if done is not None:
        todo = todo.join(done.filter("status = 'ok'").select(key), key, "left_anti")
    names = frozenset(known)
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for whole in batches:
            for i in range(0, len(whole), batch):
                b = whole.iloc[i : i + batch]
                texts, got = [t or "" for t in b["t"]], [None] * len(b)
                for _ in range(attempts):
                    open_ = [k for k, g in enumerate(got) if g is None]
                    if not open_:
                        break
                    for k, reply in zip(open_, client([fill(template, text=texts[k]) for k in open_])):
                        got[k] = parse_object(reply)
                rows = [validate(g, t, names) + ("ok",) if g is not None else ([], 0.0, "", [], "unclassified") for g, t in zip(got, texts)]
                yield pd.DataFrame([(k, *r) for k, r in zip(b[key], rows)], columns=[key, "labels", "confidence", "rationale", "snippets", "status"])

    return todo.mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def merge_second_pass(tagged: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Labels of a second pass in place of the first where it succeeded; every other tag of the item stays."""
    s = second.filter("status = 'ok'").select(key, F.col("labels").alias("__labels"), F.col("confidence").alias("__confidence"))
    out = tagged.join(s, key, "left").withColumn("labels", F.coalesce("__labels", "labels"))
    return out.withColumn("label_source", F.when(F.col("__labels").isNotNull(), "model").otherwise("rules")).drop("__labels", "__confidence")


def cited(answer: dict, hits: dict[str, str]) -> list[dict]:
    """Citations of an answer that quote a hit word for word; none of the rest."""
    return [c for c in answer.get("citations") or [] if isinstance(c, dict) and c.get("quote") and c["quote"] in hits.get(str(c.get("id")), "")]


SUMMARY = """Summarise what users say about the question, from the evidence alone, in two to four sentences.
Cite at most two items; every quote must stand word for word in its item.
Answer with JSON only: {"summary": "...", "citations": [{"id": "...", "quote": "..."}]}
Question: {{query}}
Evidence:
{{evidence}}"""


def cited_summary(complete: Callable[[str], str], query: str, hits: dict[str, str]) -> dict | None:
    """A model's summary with at most two quotes that stand in the hits; None where it has no such quote or no summary."""
    evidence = "\n".join(f"- id={i}: {t[:800]}" for i, t in list(hits.items())[:8])
    reply = parse_object(complete(fill(SUMMARY, query=query, evidence=evidence)))
    if not reply or not str(reply.get("summary") or "").strip():
        return None
    quotes = cited(reply, hits)[:2]
    return {"summary": str(reply["summary"]).strip(), "citations": quotes} if quotes else None


def zero_shot(scores: dict[str, float], least: float = 0.5, most: int = 3) -> list[str]:
    """The labels of a zero-shot classifier's scores: at least ``least``, best first, at most ``most``."""
    return [k for k, v in sorted(scores.items(), key=lambda x: (-x[1], x[0])) if v >= least][:most]


def audit(batch: DataFrame, path: str, run_id: str, provider: str) -> None:
    """Append what a model pass has answered, (run, key, status, provider, labels), so that a later pass resumes after it."""
    key = batch.columns[0]
    rows = batch.select(F.lit(run_id).alias("run_id"), F.col(key).cast("string").alias("key"), "status", F.lit(provider).alias("provider"), "labels", "confidence")
    rows.write.mode("append").parquet(path)
