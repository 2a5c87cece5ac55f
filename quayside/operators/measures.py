"""Aggregates, joins, sorts and dedupes behind dashboards: all equi-joins and hash aggregates, stated declaratively.

Small dimensions (taxonomy, runs, sources) are left to the planner, which broadcasts them by their measured size.
Every sort that ends in a limit has a total order.  Rounding to four places uses ``round`` on doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.functions import rule_tables as T
from quayside.functions import text as X
from quayside.functions.rules import Hits, spread, sql_hit
from quayside.operators.labels import CURATED_SQL, KPI_SQL, PLAIN_ITEMS, annotate, apply_curated, relevance
from quayside.session import table
from quayside.sources.readers import first_wins

_SOURCES = ", ".join(f"('{s}')" for s in T.SOURCES)


def scored_categories(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Category scores: frequency, frustration, diversity and emotion, weighted and scaled to 0..1, with the mix of sources.

    ``items`` (id, source, text), ``labels`` (id, node, confidence).  Labels are rolled up by item first, so features are
    computed once for each labelled item and for no other; counts of distinct items and sources are plain counts of
    groups then.  ``place`` orders the nodes (as many rows as the taxonomy has) by severity, then frequency.
    """
    by = labels.groupBy("id", "node").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("k"))
    by = by.groupBy("id").agg(F.collect_list(F.struct("node", "n", "c", "k")).alias("l"))  # at most one entry per node
    h = Hits()
    x = h.add(items.select("id", "source", "text").join(by, "id"), {"fr": h(T.FRUSTRATION).cast("double"), "em": h(T.EMOTION).cast("double")})
    x = x.select("source", "fr", "em", F.explode("l").alias("l")).select("source", "fr", "em", "l.*")
    s = x.groupBy("node", "source").agg(F.count("*").alias("items"), F.sum("c").alias("c"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("fr")).alias("fr"), F.sum(F.col("n") * F.col("em")).alias("em"))
    g = s.groupBy("node").agg(
        F.sum("items").alias("frequency"), F.round(F.sum("c") / F.sum("k"), 4).alias("avg_confidence"), F.sum("fr").alias("frustration"), F.sum("em").alias("emotion"), F.count("source").alias("diversity"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.concat_ws(":", "source", "items")))), ",").alias("source_mix"),
    )
    g = g.withColumn("raw", 1.0 * F.col("frequency") + 1.5 * F.col("frustration") + 2.0 * F.col("diversity") + 1.0 * F.col("emotion"))
    span = g.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))  # one row
    severity = F.round((F.col("raw") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0), 4)
    out = g.join(F.broadcast(span)).withColumn("severity", severity).withColumn("consistent", F.col("diversity") >= 2).drop("raw", "low", "high")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("severity"), F.desc("frequency"), "node")))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "classification").select(F.col("feedback_item_id").alias("id"), F.col("taxonomy_node_id").alias("node"), "confidence")


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_categories(spread(table(spark, sf_dir, "feedback_item").select("id", "source", "text")), _labels(spark, sf_dir))


def category_rows_support(spark, sf_dir):
    s = category_scores(spark, sf_dir)
    low = (F.col("frequency") < 5) | (F.col("diversity") < 2)
    n = table(spark, sf_dir, "taxonomy_node").select(F.col("id").alias("node"), "name", "parent_id").dropDuplicates(["node"])
    parent = n.select(F.col("node").alias("parent_id"), F.col("name").alias("parent_name"))
    out = s.join(n, "node", "left").join(parent, "parent_id", "left")
    return out.select("node", "name", "parent_name", "frequency", "severity", low.alias("low_support"))


def high_impact(spark, sf_dir):
    """Top five by severity, then frequency, among those with support."""
    return category_rows_support(spark, sf_dir).filter(~F.col("low_support")).orderBy(F.desc("severity"), F.desc("frequency"), "node").limit(5).select("node", "severity", "frequency")


def count_by_source_label_pivot(spark, sf_dir):
    labels = ["retrieval_related", "unrelated", "ambiguous"]
    f = table(spark, sf_dir, "feedback_item")
    g = f.groupBy("source").pivot("relevance_label", labels).count()
    own = g.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in labels])
    totals = own.agg(*[F.sum(c).alias(c) for c in labels]).select(F.lit("total").alias("source"), *labels)
    return own.unionByName(totals)


def receipt_completion(spark, sf_dir):
    """One row per source: the latest run's receipt, or a gap where there is none."""
    r = table(spark, sf_dir, "source_run").groupBy("source").agg(F.max_by(F.struct("status", "item_count", "id"), F.struct("started_at", "id")).alias("r"))
    dim = spark.createDataFrame([(s,) for s in (*T.SOURCES, "forum_export")], "source string")
    return dim.join(r, "source", "left").select("source", F.coalesce("r.status", F.lit("gap")).alias("status"), F.coalesce("r.item_count", F.lit(0)).cast("bigint").alias("item_count"))


def left_join_counts(spark, sf_dir):
    """Runs with the number of raw records behind each; the records are counted before the join."""
    n = table(spark, sf_dir, "collected_item").groupBy("source_run_id").agg(F.count("*").alias("records"))
    r = table(spark, sf_dir, "source_run").select("id", "source", "item_count")
    return r.join(n, r.id == n.source_run_id, "left").select("id", "source", "item_count", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) == F.col("item_count")).alias("complete"))


def semi_join_evidence(spark, sf_dir):
    """Items with any label of a parent's nodes: a semi join, not a distinct after an inner one."""
    nodes = table(spark, sf_dir, "taxonomy_node").filter(F.col("parent_id").isNotNull()).select(F.col("id").alias("taxonomy_node_id"))
    c = table(spark, sf_dir, "classification").join(nodes, "taxonomy_node_id", "left_semi").select(F.col("feedback_item_id").alias("id"))
    return table(spark, sf_dir, "feedback_item").join(c, "id", "left_semi").select("id", "source")


def anti_join_resume(spark, sf_dir):
    """Relevant items that no classification exists for yet."""
    f = table(spark, sf_dir, "feedback_item").filter("relevance_label = 'retrieval_related'")
    c = table(spark, sf_dir, "classification").select(F.col("feedback_item_id").alias("id"))
    return f.join(c, "id", "left_anti").groupBy("source").agg(F.count("*").alias("open"))


def orphan_checks(spark, sf_dir):
    """Violations of keys: rows that refer to nothing, and ids that stand twice."""
    f, c, r = (table(spark, sf_dir, t) for t in ("feedback_item", "classification", "collected_item"))
    n = table(spark, sf_dir, "taxonomy_node").select(F.col("id").alias("taxonomy_node_id"))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
    return (
        one(c.join(f.select(F.col("id").alias("feedback_item_id")), "feedback_item_id", "left_anti"), "classification without item")
        .union(one(c.join(n, "taxonomy_node_id", "left_anti"), "classification without node"))
        .union(one(f.join(r.select("raw_record_id"), "raw_record_id", "left_anti"), "item without record"))
        .union(one(f.groupBy("id").count().filter("count > 1"), "item id twice"))
    )


def featured_max_severity(spark, sf_dir):
    """Top 48 items by the severity of their worst category, nulls last, and only then those with a long text."""
    s = category_scores(spark, sf_dir).select("node", "severity")
    top = _labels(spark, sf_dir).join(s, "node", "left").groupBy("id").agg(F.max("severity").alias("severity"))
    f = table(spark, sf_dir, "feedback_item").select("id", "source", F.length("text").alias("n"))
    return f.join(top, "id").orderBy(F.desc_nulls_last("severity"), "id").limit(48).filter("n > 200").select("id", "source", "severity")


def taxonomy_evidence(spark, sf_dir):
    """The three most confident quotes' items of each node, ties by id; the window is limited before its shuffle."""
    c = table(spark, sf_dir, "classification")
    w = Window.partitionBy("taxonomy_node_id").orderBy(F.desc_nulls_last("confidence"), "id")
    return c.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("taxonomy_node_id", "place", "id")


def gold_precision_recall(spark, sf_dir):
    """Labels of rules against stored classifications, per label: true and false positives, misses, precision, recall."""
    f = table(spark, sf_dir, "feedback_item").select("id", "text")
    h = Hits()
    got = h.add(spread(f), {"l": T.FIRST_LABELS.labels(h)}).select("id", F.explode("l").alias("label")).distinct().withColumn("g", F.lit(1))
    gold = _labels(spark, sf_dir).select("id", F.col("node").alias("label")).distinct().withColumn("w", F.lit(1))
    j = got.join(gold, ["id", "label"], "full")
    g = j.groupBy("label").agg(F.count_if(F.col("g").isNotNull() & F.col("w").isNotNull()).alias("tp"), F.count_if(F.col("w").isNull()).alias("fp"), F.count_if(F.col("g").isNull()).alias("fn"))
    rate = lambda a, b: F.round(F.try_divide(F.col("tp"), F.col(a) + F.col(b)), 4)
    return g.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn"))


def gold_exact_match(spark, sf_dir):
    """Share of classified items whose labels by rules are exactly those stored."""
    gold = _labels(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("w"))
    h = Hits()
    f = h.add(spread(table(spark, sf_dir, "feedback_item").select("id", "text")).join(gold, "id"), {"g": T.SEARCH_TYPES.labels(h)})
    named = F.transform("g", lambda x: F.when(x == "people_pets", "engine_faces").when(x == "date_time", "layout_dates").when(x == "objects", "engine_text").otherwise(x))
    x = f.agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap(named, F.col("w"))).alias("any"), F.count_if(F.array_sort(F.array_distinct(named)) == F.col("w")).alias("exact"))
    return x.withColumn("accuracy", F.round(F.col("exact") / F.greatest("n", F.lit(1)), 4))


def curated_override(spark, sf_dir):
    """Reviewed labels, here made of the stored ones, in place of those of the rules."""
    c = table(spark, sf_dir, "collected_item").select("raw_record_id", "native_id")
    f = spread(table(spark, sf_dir, "feedback_item").select("id", "raw_record_id", "source", "text", "relevance_label")).join(c, "raw_record_id")
    reviewed = f.filter("relevance_label is not null").select(
        F.concat_ws(":", "source", "native_id").alias("key"), (F.col("relevance_label") == "retrieval_related").alias("in_scope"), F.lit(False).alias("is_forum_reply"), F.lit("actionable").alias("signal"), F.lit("negative").alias("sentiment"),
        F.array(F.lit("knowledge_hidden_features"), F.lit("system_search_bugs"), F.lit("no_such_node")).alias("pain_points"), F.array(F.lit("places")).alias("search_types"), F.lit(True).alias("is_suggestion"),
    )
    reviewed = reviewed.groupBy("key").agg(*[F.max(x).alias(x) for x in reviewed.columns if x != "key"])
    tagged = annotate(relevance(f, "text", "source"))
    out = apply_curated(tagged, reviewed)
    return out.select("id", "relevance", F.col("relevance_score").alias("score"), "tone", F.array_join("labels", ",").alias("labels"), F.array_join("search_types", ",").alias("search_types"), "label_source")


def monthly_trend(spark, sf_dir):
    """Relevant items a month by the text of the time of writing as it stands, with the first and last of each; others are Unknown."""
    f = table(spark, sf_dir, "feedback_item").filter("relevance_label = 'retrieval_related'")
    month = F.when(F.col("authored_at").rlike("^[0-9]{4}-[0-9]{2}"), F.substring("authored_at", 1, 7)).otherwise("Unknown")
    return f.groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.min("authored_at").alias("first"), F.max("authored_at").alias("last"))


def year_buckets(spark, sf_dir):
    y = F.when(F.col("authored_at").rlike(r"^[0-9]{4}-"), F.substring("authored_at", 1, 4))
    bucket = F.when(y.isin("2026", "2025", "2024"), y).otherwise("Unknown")
    return table(spark, sf_dir, "feedback_item").groupBy(bucket.alias("year")).agg(F.count("*").alias("n"))


def date_window_filter(spark, sf_dir):
    """Events of a window; rows without a time pass.  The bounds reach the scan."""
    e = table(spark, sf_dir, "events")
    t = F.col("ts")
    kept = e.filter(t.isNull() | t.between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def json_payload_extract(spark, sf_dir):
    v = F.try_parse_json("props")
    e = table(spark, sf_dir, "events").withColumn("k", F.try_variant_get(v, "$.k", "bigint"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("k").alias("n"))


def status_conditional_counts(spark, sf_dir):
    f = table(spark, sf_dir, "feedback_item")
    return f.agg(F.count("*").alias("items"), *[F.count_if(F.col("relevance_label") == x).alias(x) for x in ("retrieval_related", "unrelated", "ambiguous")], F.count_if(F.col("relevance_label").isNull()).alias("unlabelled"))


def first_wins_dedupe(spark, sf_dir):
    """The first record of each (source, native_id) by time of capture, as the readers and stages choose it."""
    c = table(spark, sf_dir, "collected_item").select("source", "native_id", "raw_record_id", "captured_at")
    return first_wins(c, ("captured_at", "raw_record_id")).select("source", "native_id", "raw_record_id")


def source_breakdown(spark, sf_dir):
    dim = spark.createDataFrame([(s,) for s in T.SOURCES], "source string")
    n = table(spark, sf_dir, "feedback_item").groupBy("source").agg(F.count("*").alias("n"))
    return dim.join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def gaps(receipts: DataFrame, relevant: int | None = None, target: int = 500, indexed: bool = True) -> DataFrame:
    """(kind, source, status, detail) of what a run did not deliver, each once.

    ``receipts`` (source, status, notes): sources that failed, were skipped or came in part; notes that tell of a quota
    or an outage; then, for the run, too few relevant items and a missing index.
    """
    status, notes = F.coalesce("status", F.lit("")), F.trim(F.coalesce("notes", F.lit("")))
    named = lambda other: F.coalesce(F.nullif("source", F.lit("")), F.lit(other))
    entry = lambda kind, source, detail: F.struct(F.lit(kind).alias("kind"), source.alias("source"), status.alias("status"), detail.alias("detail"))
    source, low = F.coalesce("source", F.lit("")), F.lower(notes)
    silent = F.concat(F.lit("Source "), source, F.lit(" is "), status, F.lit(" \u2014 not a silent skip."))
    found = F.array_compact(F.array(
        F.when(status.isin("failed", "gap", "skipped", "pending", "partial"), entry("adapter", source, F.coalesce(F.nullif(notes, F.lit("")), silent))),
        F.when(low.contains("quota") | low.contains("cse"), entry("cse_quota", named("help_community"), notes)),
        F.when(low.contains("arctic") | low.contains("outage"), entry("arctic_shift", named("reddit"), notes)),
    ))
    out = receipts.select(F.explode(found).alias("g")).select("g.*").groupBy("kind", "source", "detail").agg(F.min("status").alias("status")).select("kind", "source", "status", "detail")
    more = []
    if relevant is not None and relevant < target:
        more.append(("corpus_target", "all", "miss", f"Relevant items {relevant} vs success bar {target}. Widening keywords or storefronts requires a new run_id."))
    if not indexed:
        more.append(("vector_index", "rag", "missing", "Vector index file is missing; dashboard aggregates can still load."))
    return out.unionByName(receipts.sparkSession.createDataFrame(more, "kind string, source string, status string, detail string")) if more else out


def known_gaps(spark, sf_dir):
    relevant = table(spark, sf_dir, "feedback_item").filter("relevance_label = 'retrieval_related'").count()
    return gaps(table(spark, sf_dir, "source_run"), relevant, 1_000_000)


def incomplete_source_mix(spark, sf_dir):
    """One row: whether any source's latest receipt isn't a success, and which."""
    r = receipt_completion(spark, sf_dir).filter("status <> 'success'")
    return r.agg((F.count("*") > 0).alias("incomplete"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def workaround_ids(spark, sf_dir):
    f = table(spark, sf_dir, "feedback_item").select("id", "source", "text")
    h = Hits()
    x = h.add(spread(f), {"found": h(r"\bworkaround\b")}).filter("found")
    return x.groupBy("source").agg(F.countDistinct("id").alias("items"))


def json_list_tolerant(spark, sf_dir):
    """Quotes per classification; broken or other JSON counts as an empty list."""
    c = table(spark, sf_dir, "classification")
    return c.select("id", F.coalesce(F.when(F.col("snippets_json").rlike(r"^\s*\["), F.size(F.from_json("snippets_json", "array<string>"))), F.lit(0)).alias("quotes"))


def extraction_stats(spark, sf_dir):
    """Raw records, what the receipts report, and items by label, for each source and in all."""
    raw = table(spark, sf_dir, "collected_item").groupBy("source").agg(F.count("*").alias("extracted_raw"))
    told = table(spark, sf_dir, "source_run").groupBy("source").agg(F.sum("item_count").alias("receipt_reported"))
    count = lambda x: F.count_if(F.col("relevance_label") == x).alias(x)
    own = table(spark, sf_dir, "feedback_item").groupBy("source").agg(F.count("*").alias("normalized_total"), *map(count, ("retrieval_related", "unrelated", "ambiguous")))
    dim = spark.createDataFrame([(s,) for s in T.SOURCES], "source string")
    x = dim.join(raw, "source", "left").join(told, "source", "left").join(own, "source", "left").fillna(0)
    names = [c for c in x.columns if c != "source"]
    return x.select("source", *names).unionByName(x.agg(*[F.sum(c).alias(c) for c in names]).select(F.lit("total").alias("source"), *names))


def sub_theme_order(spark, sf_dir):
    """Nodes below a parent by the number of relevant items, most first, with the parent's name."""
    f = table(spark, sf_dir, "feedback_item").filter("relevance_label = 'retrieval_related'").select("id")
    n = table(spark, sf_dir, "taxonomy_node").select(F.col("id").alias("node"), "name", "parent_id").dropDuplicates(["node"])
    parent = n.select(F.col("node").alias("parent_id"), F.col("name").alias("parent_name"))
    c = _labels(spark, sf_dir).select("id", "node").distinct().join(f, "id", "left_semi").groupBy("node").agg(F.count("*").alias("frequency"))
    x = c.join(n.filter("parent_id is not null"), "node").join(parent, "parent_id", "left")
    return x.select("node", "name", "parent_name", "frequency").withColumn("place", F.row_number().over(Window.orderBy(F.desc("frequency"), "node")))


def parent_theme_items(spark, sf_dir):
    """Relevant items under each parent, an item counting once however many of its nodes an item has."""
    f = table(spark, sf_dir, "feedback_item").filter("relevance_label = 'retrieval_related'").select("id")
    n = table(spark, sf_dir, "taxonomy_node").select(F.col("id").alias("node"), F.coalesce("parent_id", "id").alias("parent")).dropDuplicates(["node"])
    c = _labels(spark, sf_dir).select("id", "node").join(n, "node").select("id", "parent").distinct().join(f, "id", "left_semi")
    return c.groupBy("parent").agg(F.count("*").alias("items"))


def kpi_block(spark, sf_dir):
    """The key figures of a dashboard, one row."""
    f = spread(table(spark, sf_dir, "feedback_item").filter("relevance_label = 'retrieval_related'").select("id", "source", "text"))
    tags = annotate(f).agg(F.count("*").alias("relevant"), F.count_if(F.col("is_suggestion")).alias("suggestion_items"), F.count_if(F.col("signal") == "actionable").alias("actionable_count"), F.count_if(F.size("search_types") > 0).alias("search_typed_count"))
    subs = sub_theme_order(spark, sf_dir).agg(F.count("*").alias("sub_theme_count"))
    parents = parent_theme_items(spark, sf_dir).agg(F.count("*").alias("overarching_theme_count"))
    return tags.join(F.broadcast(subs)).join(F.broadcast(parents))  # one row each


def raw_with_run(spark, sf_dir):
    """Raw records of each run by label of their items: inner to the run, left to the item."""
    r = table(spark, sf_dir, "source_run").select(F.col("id").alias("source_run_id"), "analysis_run_id")
    f = table(spark, sf_dir, "feedback_item").select("raw_record_id", F.coalesce("relevance_label", F.lit("unknown")).alias("label"))
    c = table(spark, sf_dir, "collected_item").select("raw_record_id", "source_run_id").join(r, "source_run_id").join(f, "raw_record_id", "left")
    return c.groupBy("analysis_run_id", F.coalesce("label", F.lit("no item")).alias("label")).agg(F.count("*").alias("n"))


def item_details(spark, sf_dir):
    """Items with labels, their nodes' names, and the sentence that each first quote stands in."""
    n = table(spark, sf_dir, "taxonomy_node").select(F.col("id").alias("taxonomy_node_id"), "name").dropDuplicates(["taxonomy_node_id"])
    c = table(spark, sf_dir, "classification").select("id", F.col("feedback_item_id").alias("item"), "taxonomy_node_id", F.get(F.from_json("snippets_json", "array<string>"), F.lit(0)).alias("quote"))
    f = table(spark, sf_dir, "feedback_item").select(F.col("id").alias("item"), "text", "source_url")
    x = c.filter("quote is not null").join(f, "item").join(n, "taxonomy_node_id", "left")
    return x.select("id", F.coalesce("name", "taxonomy_node_id").alias("name"), X.expand_in(F.col("text"), F.col("quote")).alias("sentence"), (F.length("source_url") > 0).alias("citable"))


def shipping_priority(spark, sf_dir):
    """Revenue of open orders by customer segment: selective filters first, then the joins."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("n"))


def lineitem_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    category_scores, category_rows_support, high_impact, count_by_source_label_pivot, receipt_completion, left_join_counts, semi_join_evidence, anti_join_resume, orphan_checks, featured_max_severity, taxonomy_evidence, gold_precision_recall,
    gold_exact_match, curated_override, monthly_trend, year_buckets, date_window_filter, json_payload_extract, status_conditional_counts, first_wins_dedupe, source_breakdown, known_gaps, incomplete_source_mix, workaround_ids, json_list_tolerant, extraction_stats, sub_theme_order, parent_theme_items, kpi_block, raw_with_run, item_details, shipping_priority, lineitem_summary,
)}

_SCORES = (
    f"x as (select id, source, cast({sql_hit('text', T.FRUSTRATION)} as double) as fr, cast({sql_hit('text', T.EMOTION)} as double) as em from {PLAIN_ITEMS} f),"
    " l as (select feedback_item_id as id, taxonomy_node_id as node, confidence from classification),"
    " g as (select node, count(distinct id) as frequency, round(avg(confidence), 4) as avg_confidence, sum(fr) as frustration, sum(em) as emotion, count(distinct source) as diversity from l join x using (id) group by node),"
    " mix as (select node, string_agg(source || ':' || n, ',' order by source || ':' || n) as source_mix from (select node, source, count(distinct id) as n from l join x using (id) where source is not null group by all) group by node),"
    " r as (select *, 1.0::double * frequency + 1.5::double * frustration + 2.0::double * diversity + emotion as raw from g),"
    " m as (select min(raw) as low, max(raw) as high from r),"
    " scores as (select node, frequency, avg_confidence, frustration, emotion, diversity, round((raw - low) / (case when high > low then high - low else 1.0::double end), 4) as severity, diversity >= 2 as consistent, coalesce(source_mix, '') as source_mix from r left join mix using (node), m)"
)
_ROWS = ", n as (select distinct on (id) id, name, parent_id from taxonomy_node), rows_ as (select node, n.name, p.name as parent_name, frequency, severity, frequency < 5 or diversity < 2 as low_support from scores left join n on n.id = node left join n p on p.id = n.parent_id)"
_SUBS = "s as (select c.taxonomy_node_id as node, n.name, p.name as parent_name, count(distinct c.feedback_item_id) as frequency from classification c join taxonomy_node n on n.id = c.taxonomy_node_id and n.parent_id is not null left join taxonomy_node p on p.id = n.parent_id join feedback_item f on f.id = c.feedback_item_id where f.relevance_label = 'retrieval_related' group by all)"
_pivot = "count(*) filter (relevance_label = 'retrieval_related') as retrieval_related, count(*) filter (relevance_label = 'unrelated') as unrelated, count(*) filter (relevance_label = 'ambiguous') as ambiguous"
ORACLES = {
    "category_scores": f"with {_SCORES} select *, cast(row_number() over (order by severity desc, frequency desc, node) as int) as place from scores",
    "category_rows_support": f"with {_SCORES} {_ROWS} select * from rows_",
    "high_impact": f"with {_SCORES} {_ROWS} select node, severity, frequency from rows_ where not low_support order by severity desc, frequency desc, node limit 5",
    "count_by_source_label_pivot": f"select source, {_pivot} from feedback_item group by source union all select 'total', {_pivot} from feedback_item",
    "receipt_completion": f"with d(source) as (values {_SOURCES}, ('forum_export')), r as (select source, arg_max(status, (started_at, id)) as status, arg_max(item_count, (started_at, id)) as item_count from source_run group by source) select d.source, coalesce(r.status, 'gap') as status, cast(coalesce(r.item_count, 0) as bigint) as item_count from d left join r on r.source = d.source",
    "left_join_counts": "select r.id, r.source, r.item_count, count(c.raw_record_id) as records, count(c.raw_record_id) = r.item_count as complete from source_run r left join collected_item c on c.source_run_id = r.id group by r.id, r.source, r.item_count",
    "semi_join_evidence": "select id, source from feedback_item where id in (select feedback_item_id from classification where taxonomy_node_id in (select id from taxonomy_node where parent_id is not null))",
    "anti_join_resume": "select source, count(*) as open from feedback_item f where relevance_label = 'retrieval_related' and not exists (select 1 from classification c where c.feedback_item_id = f.id) group by source",
    "orphan_checks": "select 'classification without item' as violation, count(*) as n from classification where feedback_item_id not in (select id from feedback_item) or feedback_item_id is null union all select 'classification without node', count(*) from classification where taxonomy_node_id not in (select id from taxonomy_node) or taxonomy_node_id is null union all select 'item without record', count(*) from feedback_item where raw_record_id not in (select raw_record_id from collected_item) or raw_record_id is null union all select 'item id twice', count(*) from (select id from feedback_item group by id having count(*) > 1)",
    "featured_max_severity": f"with {_SCORES}, t as (select l.id, max(severity) as severity from l left join scores using (node) group by l.id), f as (select f.id, f.source, length(f.text) as n, t.severity from feedback_item f join t on t.id = f.id order by t.severity desc nulls last, f.id limit 48) select id, source, severity from f where n > 200",
    "taxonomy_evidence": "select taxonomy_node_id, place, id from (select taxonomy_node_id, id, row_number() over (partition by taxonomy_node_id order by confidence desc nulls last, id) as place from classification) where place <= 3",
    "gold_precision_recall": f"with got as (select distinct id, unnest({T.FIRST_LABELS.sql_labels('text')}) as label from {PLAIN_ITEMS} f), gold as (select distinct feedback_item_id as id, taxonomy_node_id as label from classification), j as (select coalesce(a.label, b.label) as label, a.id as g, b.id as w from got a full join gold b on a.id = b.id and a.label = b.label), c as (select label, count(*) filter (g is not null and w is not null) as tp, count(*) filter (w is null) as fp, count(*) filter (g is null) as fn from j group by label) select *, round(tp::double / nullif(tp + fp, 0), 4) as precision, round(tp::double / nullif(tp + fn, 0), 4) as recall from c",
    "gold_exact_match": f"with w as (select feedback_item_id as id, list_sort(list_distinct(list(taxonomy_node_id))) as w from classification group by 1), f as (select w, list_sort(list_distinct(list_transform({T.SEARCH_TYPES.sql_labels('text')}, lambda x: case x when 'people_pets' then 'engine_faces' when 'date_time' then 'layout_dates' when 'objects' then 'engine_text' else x end))) as g from {PLAIN_ITEMS} f join w using (id)), a as (select count(*) as n, count(*) filter (list_has_any(g, w)) as any, count(*) filter (g = w) as exact from f) select *, round(exact / greatest(n, 1)::double, 4) as accuracy from a",
    "curated_override": CURATED_SQL,
    "monthly_trend": "select case when regexp_matches(authored_at, '^[0-9]{4}-[0-9]{2}') then substring(authored_at, 1, 7) else 'Unknown' end as month, count(*) as n, min(authored_at) as first, max(authored_at) as last from feedback_item where relevance_label = 'retrieval_related' group by 1",
    "year_buckets": "select case when regexp_matches(authored_at, '^[0-9]{4}-') and substring(authored_at, 1, 4) in ('2026', '2025', '2024') then substring(authored_at, 1, 4) else 'Unknown' end as year, count(*) as n from feedback_item group by 1",
    "date_window_filter": "select event_type, count(*) as n, round(sum(value), 4) as value from events where ts is null or ts between timestamp '2024-01-10' and timestamp '2024-01-20' group by event_type",
    "json_payload_extract": "with x as (select event_type, try_cast(case when json_valid(props) then props::json->>'$.k' end as bigint) as k from events) select event_type, cast(sum(k) as bigint) as k, count(k) as n from x group by event_type",
    "status_conditional_counts": f"select count(*) as items, {_pivot}, count(*) filter (relevance_label is null) as unlabelled from feedback_item",
    "first_wins_dedupe": "select source, native_id, raw_record_id from (select *, row_number() over (partition by source, native_id order by captured_at nulls last, raw_record_id nulls last) as k from collected_item) where k = 1",
    "source_breakdown": f"with d(source) as (values {_SOURCES}) select d.source, count(f.id) as n from d left join feedback_item f on f.source = d.source group by d.source",
    "known_gaps": "with r as (select coalesce(source, '') as source, coalesce(status, '') as status, trim(coalesce(notes, ''), ' ') as notes from source_run), a as (select 'adapter' as kind, source, status, case when notes <> '' then notes else 'Source ' || source || ' is ' || status || ' — not a silent skip.' end as detail from r where status in ('failed', 'gap', 'skipped', 'pending', 'partial') union all select 'cse_quota', case when source = '' then 'help_community' else source end, status, notes from r where contains(lower(notes), 'quota') or contains(lower(notes), 'cse') union all select 'arctic_shift', case when source = '' then 'reddit' else source end, status, notes from r where contains(lower(notes), 'arctic') or contains(lower(notes), 'outage')), n as (select count(*) as n from feedback_item where relevance_label = 'retrieval_related') select kind, source, min(status) as status, detail from a group by kind, source, detail union all select 'corpus_target', 'all', 'miss', 'Relevant items ' || n || ' vs success bar 1000000. Widening keywords or storefronts requires a new run_id.' from n where n < 1000000",
    "incomplete_source_mix": f"with d(source) as (values {_SOURCES}, ('forum_export')), r as (select source, arg_max(status, (started_at, id)) as status from source_run group by source), x as (select d.source from d left join r using (source) where coalesce(r.status, 'gap') <> 'success') select count(*) > 0 as incomplete, string_agg(source, ',' order by source) as sources from x",
    "workaround_ids": f"select source, count(distinct id) as items from {PLAIN_ITEMS} f where {sql_hit('text', chr(92) + 'bworkaround' + chr(92) + 'b')} group by source",
    "json_list_tolerant": "select id, cast(coalesce(case when json_valid(snippets_json) and json_type(snippets_json::json) = 'ARRAY' then json_array_length(snippets_json::json) end, 0) as int) as quotes from classification",
    "extraction_stats": f"with d(source) as (values {_SOURCES}), x as (select d.source, (select count(*) from collected_item c where c.source = d.source) as extracted_raw, (select cast(coalesce(sum(item_count), 0) as bigint) from source_run r where r.source = d.source) as receipt_reported, (select count(*) from feedback_item f where f.source = d.source) as normalized_total, (select count(*) from feedback_item f where f.source = d.source and relevance_label = 'retrieval_related') as retrieval_related, (select count(*) from feedback_item f where f.source = d.source and relevance_label = 'unrelated') as unrelated, (select count(*) from feedback_item f where f.source = d.source and relevance_label = 'ambiguous') as ambiguous from d) select * from x union all select 'total', cast(sum(extracted_raw) as bigint), cast(sum(receipt_reported) as bigint), cast(sum(normalized_total) as bigint), cast(sum(retrieval_related) as bigint), cast(sum(unrelated) as bigint), cast(sum(ambiguous) as bigint) from x",
    "sub_theme_order": f"with {_SUBS} select node, name, parent_name, frequency, cast(row_number() over (order by frequency desc, node) as int) as place from s",
    "parent_theme_items": "select coalesce(n.parent_id, n.id) as parent, count(distinct c.feedback_item_id) as items from classification c join taxonomy_node n on n.id = c.taxonomy_node_id join feedback_item f on f.id = c.feedback_item_id where f.relevance_label = 'retrieval_related' group by 1",
    "kpi_block": KPI_SQL.replace("__SUBS__", _SUBS),
    "raw_with_run": "select r.analysis_run_id, case when f.id is null then 'no item' else coalesce(f.relevance_label, 'unknown') end as label, count(*) as n from collected_item c join source_run r on r.id = c.source_run_id left join feedback_item f on f.raw_record_id = c.raw_record_id group by 1, 2",
    "item_details": r"""with c as (select id, feedback_item_id as item, taxonomy_node_id, case when json_valid(snippets_json) and json_type(snippets_json::json) = 'ARRAY' then snippets_json::json->>0 end as quote from classification), n as (select distinct on (id) id, name from taxonomy_node),
        x as (select c.id, coalesce(n.name, c.taxonomy_node_id) as name, f.text as t, quote as q, position(quote in f.text) as pos, coalesce(length(f.source_url) > 0, null) as citable from c join feedback_item f on f.id = c.item left join n on n.id = c.taxonomy_node_id where quote is not null),
        y as (select *, length(regexp_extract(substring(t, 1, pos - 1), '([^.!?\n]*)$', 1)) as run, pos + length(q) as e0 from x), z as (select *, length(regexp_extract(substring(t, e0), '^([^.!?\n]*)', 1)) as behind from y),
        w as (select *, case when run > 200 then greatest(pos - 120, 1) else pos - run end as s, case when behind > 200 then least(length(t) + 1, e0 + 120) else e0 + behind end as e1 from z), v as (select *, case when regexp_matches(substring(t, e1, 1), '^[.!?\n]') then e1 + 1 else e1 end as e from w),
        g as (select *, regexp_replace(substring(t, s, e - s), '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') as grown from v)
        select id, name, case when coalesce(t, '') = '' or q = '' then q when pos = 0 then substring(q, 1, 600) when length(grown) > 600 then rtrim(substring(grown, 1, 597)) || '...' else grown end as sentence, citable from g""",
    "shipping_priority": "select c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where o_orderstatus = 'O' group by c_mktsegment",
    "lineitem_summary": "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem group by 1, 2",
}
