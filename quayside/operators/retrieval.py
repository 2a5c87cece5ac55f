"""Chunks, index and hybrid retrieval with cited evidence.

The cascade is one plan: cosine over the index, the first ``fetch`` rows above a floor, filters after that limit (so
that they can't change which rows were among the first), lexical boost, pool, impact, final order.  Only the final
rows reach the driver.  The embedding of a query is made as that of the index is.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions import rule_tables as T
from quayside.functions.rules import Hits, spread, sql_hit
from quayside.functions.text import expand_in, overlap
from quayside.operators.labels import PLAIN_ITEMS
from quayside.operators.measures import _SCORES, category_scores
from quayside.operators.vectors import dot, embedding
from quayside.session import local_path, table

DIM = 128
#: A maker of vectors: a column of texts and the number of components to a column of arrays.
Embed = Callable[[Column, int], Column]
CHUNK = 4000


@dataclass(frozen=True)
class Search:
    """A request: what is asked, filters, and the sizes of the cascade."""

    query: str
    sources: tuple[str, ...] = ()
    category: str | None = None
    since: str | None = None
    until: str | None = None
    least_confidence: float | None = None
    fetch: int = 60
    pool: int = 30
    top: int = 8
    floor: float = 0.05
    lexical_weight: float = 0.3


def embed_query(text: str, dim: int = DIM) -> list[float]:
    """The hashed embedding of one string, as :func:`hashed_embedding` makes it of a column."""
    v = [0.0] * dim
    for t in re.findall("[a-z0-9]+", text.lower()):
        h = hashlib.sha256(t.encode()).digest()
        v[(h[0] * 256 + h[1]) % dim] += 1.0 if h[2] % 2 == 0 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def chunks(items: DataFrame, classification: DataFrame, severities: DataFrame, nodes: DataFrame) -> DataFrame:
    """One chunk per relevant item with an address: text, thread, up to six themes, confidence, quotes, worst severity.

    Labels are rolled up by item before they meet the texts.
    """
    c = classification.select(F.col("feedback_item_id").alias("id"), F.col("taxonomy_node_id").alias("node"), "confidence", "snippets_json")
    c = c.join(nodes.select(F.col("id").alias("node"), "name").dropDuplicates(["node"]), "node", "left").join(severities.select("node", "severity"), "node", "left")
    quotes = F.coalesce(F.from_json("snippets_json", "array<string>"), F.array().cast("array<string>"))
    rolled = c.groupBy("id").agg(
        F.array_sort(F.collect_set(F.coalesce("name", "node"))).alias("themes"), F.array_sort(F.collect_set("node")).alias("categories"), F.round(F.avg("confidence"), 4).alias("confidence"),
        F.slice(F.array_distinct(F.flatten(F.collect_list(quotes))), 1, 5).alias("quotes"), F.coalesce(F.max("severity"), F.lit(0.0)).alias("severity"),
    )
    f = items.filter("relevance_label = 'retrieval_related'").filter((F.trim("source_url") != "") & F.col("source_url").isNotNull())
    x = f.select("id", "source", "source_url", "authored_at", "text", "thread_context").join(rolled, "id", "left")
    thread = F.when(F.trim("thread_context") != "", F.concat(F.lit("\n\n--- thread context ---\n"), "thread_context")).otherwise("")
    body = F.concat(F.coalesce("text", F.lit("")), F.coalesce(thread, F.lit("")))
    head = F.concat(F.lit("Feedback on photo search. Themes: "), F.coalesce(F.array_join(F.slice("themes", 1, 6), ", "), F.lit("none")), F.lit("\n"))
    h = Hits()
    impact = h(T.FRUSTRATION).cast("double") + h(T.EMOTION).cast("double")
    x = h.attach(x)
    return x.withColumn("body", body).withColumn("embedding_text", F.substring(F.concat(head, F.col("body")), 1, CHUNK)).withColumn("impact", F.greatest(F.coalesce("severity", F.lit(0.0)), impact)).drop(h.out)


def build_index(chunked: DataFrame, path: str, dim: int = DIM, embed: Embed | None = None, provider: str = "hashing") -> DataFrame:
    """Embed the chunks and write them; the index carries how it was made.

    ``embed`` makes a column of vectors from one of texts; by default the hashed embedding, in one pass over the rows.
    """
    out = chunked.withColumn("vector", (embed or embedding)(F.col("embedding_text"), dim)).withColumns({"provider": F.lit(provider), "dim": F.lit(dim)})
    out.write.mode("errorifexists").parquet(path)
    return chunked.sparkSession.read.parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    if "://" not in path and not os.path.exists(local_path(path)):
        raise FileNotFoundError(f"no index at {path}; build it first")
    return spark.read.parquet(path)


def candidates(index: DataFrame, s: Search, vector: list[float] | None = None) -> DataFrame:
    """The first ``fetch`` chunks above the floor, before any filter."""
    q: Column = F.array(*[F.lit(x) for x in (vector or embed_query(s.query))])
    return index.withColumn("cos", F.round(dot(F.col("vector"), q), 9)).filter(F.col("cos") >= s.floor).orderBy(F.desc("cos"), "id").limit(s.fetch)


def filtered(x: DataFrame, s: Search) -> DataFrame:
    if s.sources:
        x = x.filter(F.col("source").isin(*s.sources))
    if s.category:
        x = x.filter(F.array_contains("categories", s.category))
    if s.least_confidence is not None:
        x = x.filter(F.coalesce("confidence", F.lit(0.0)) >= s.least_confidence)
    for bound, test in ((s.since, F.col("authored_at") >= (s.since or "")), (s.until, F.col("authored_at") <= (s.until or ""))):
        if bound:
            x = x.filter(F.coalesce(F.col("authored_at") == "", F.lit(True)) | test)
    return x


def pick_quote() -> Column:
    """The first stored quote that stands in the text, grown to its sentence; else the text's own beginning."""
    own = F.get(F.filter("quotes", lambda c: (c != "") & F.contains(F.col("text"), c)), F.lit(0))
    body = F.when(F.length("text") > 0, F.col("text")).otherwise(F.col("body"))
    start = F.regexp_replace(F.substring(body, 1, 280), r"(?U)^\s+|\s+$", "")
    return F.when(own.isNotNull(), expand_in(F.col("text"), own)).when(F.length(body) > 280, expand_in(body, F.substring(start, 1, 80))).otherwise(start)


def retrieve(index: DataFrame, s: Search, vector: list[float] | None = None, rerank: Callable[[str, list[str]], list[float]] | None = None) -> DataFrame:
    """The hits of a request, best first: (id, source, score, relevance, impact, quote, source_url, categories).

    ``rerank`` scores the pool (at most ``pool`` rows) against the query, as a cross-encoder does; it runs on the driver.
    """
    x = filtered(candidates(index, s, vector), s)
    x = x.withColumn("relevance", F.col("cos") + s.lexical_weight * overlap(s.query, F.col("embedding_text"))).orderBy(F.desc("relevance"), "id").limit(s.pool)
    if rerank is not None:
        pool = [(r["id"], r["t"]) for r in x.select("id", F.substring("embedding_text", 1, 1500).alias("t")).collect()]  # at most ``pool`` rows
        scores = list(zip([i for i, _ in pool], map(float, rerank(s.query, [t for _, t in pool]))))
        x = x.drop("relevance").join(index.sparkSession.createDataFrame(scores, f"id {dict(x.dtypes)['id']}, relevance double"), "id")
    x = x.orderBy(F.desc("relevance"), "id").limit(s.top).withColumn("score", F.round(F.col("relevance") * (1 + 0.15 * F.col("impact")), 4))
    out = x.select("id", "source", "score", F.round("relevance", 4).alias("relevance"), F.round("impact", 4).alias("impact"), pick_quote().alias("quote"), "source_url", "categories")
    return out.orderBy(F.desc("score"), "id")


def related_themes(clusters: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """(label, cohesion, overlap) of clusters that hold hits, by overlap, then cohesion; those to be reviewed are left out.

    ``clusters`` (root, label, cohesion, review, member), one row a member; ``hits`` (id).
    """
    g = clusters.filter(~F.col("review")).join(hits.select(F.col("id").alias("member")).distinct(), "member")
    return g.groupBy("root").agg(F.first("label").alias("label"), F.first("cohesion").alias("cohesion"), F.countDistinct("member").alias("overlap")).orderBy(F.desc("overlap"), F.desc_nulls_last("cohesion"), "root").limit(most).select("label", "cohesion", "overlap")


def in_scope(query: str) -> bool:
    """Whether a question is about finding things at all; asked before an index is opened."""
    has = lambda p: re.search(p, query, re.I) is not None
    if not query.strip() or has(T.QUERY_OUTSIDE):
        return False
    about = has(T.QUERY_RETRIEVAL) or has(T.QUERY_PRODUCT) or (has(T.QUERY_REVIEW) and has(T.QUERY_SUBJECT))
    return about and not (has(T.QUERY_STORAGE) and not has(T.QUERY_FINDING))


def scope_column(h: Hits) -> Column:
    """The same test over a column of questions."""
    about = h(T.QUERY_RETRIEVAL) | h(T.QUERY_PRODUCT) | (h(T.QUERY_REVIEW) & h(T.QUERY_SUBJECT))
    return F.coalesce((F.trim(h.text) != "") & ~h(T.QUERY_OUTSIDE) & about & ~(h(T.QUERY_STORAGE) & ~h(T.QUERY_FINDING)), F.lit(False))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return chunks(spread(t("feedback_item")), t("classification"), category_scores(spark, sf_dir), t("taxonomy_node"))


def chunk_rollup(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", F.array_join("categories", ",").alias("categories"), F.coalesce(F.col("confidence") > 0.55, F.lit(False)).alias("confident"), F.length("body").cast("bigint").alias("chars"), "impact")


def query_scope(spark, sf_dir):
    h = Hits()
    f = spread(table(spark, sf_dir, "feedback_item").select("text"))
    return h.add(f, {"in_scope": scope_column(h)}).groupBy("in_scope").agg(F.count("*").alias("n"))


def hybrid_search(spark, sf_dir):
    """A whole request over an index made in memory, in one pass over the chunks."""
    c = _chunks(spark, sf_dir).withColumn("vector", embedding(F.col("embedding_text"), DIM))
    return retrieve(c, Search("the search bar shows random pictures", fetch=200, top=20)).drop("categories")


def evidence_by_kind(spark, sf_dir):
    """Items behind each shown number: as many rows as the number says."""
    f = table(spark, sf_dir, "feedback_item").select("id", "source", "relevance_label", "text")
    h = Hits()
    kinds = [("relevant", F.col("relevance_label") == "retrieval_related"), ("reddit", F.col("source") == "reddit"), ("workaround", h(r"\bworkaround\b")), ("suggestion", h(T.SUGGESTION) & h(T.SEARCHISH))]
    kinds += [(f"search_type={n}", h(p)) for n, p in T.SEARCH_TYPES.rules]
    x = h.add(spread(f), {"kinds": F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]))})
    return x.select("id", F.explode("kinds").alias("kind"))


QUERIES = {f.__name__: f for f in (chunk_rollup, query_scope, hybrid_search, evidence_by_kind)}
_CHUNK_CTE = f"{_SCORES}, t as (select c.feedback_item_id as id, string_agg(distinct c.taxonomy_node_id, ',' order by c.taxonomy_node_id) as categories, round(avg(c.confidence), 4) as confidence, coalesce(max(s.severity), 0.0) as severity from classification c left join scores s on s.node = c.taxonomy_node_id group by 1)"
# The patterns of this oracle are written out, apart from the tables that the operator uses.
ORACLES = {
    "query_scope": r"""select coalesce(trim(text, ' ') <> ''
        and not regexp_matches(text, '(?i)\b(train(?:ing)?\s+(?:the\s+)?model|fine[- ]?tune|write\s+(?:a\s+)?python|python\s+scraper|scrape\s+(?:the\s+)?play\s+store|what\s+is\s+rag\b|how\s+does\s+(?:this|the)\s+(?:discovery|research)\s+engine\s+work|discovery\s+engine\s+work|capital\s+of\s+france|who\s+won\s+the\s+world\s+cup|openai|chatgpt|gemini\s+api)\b')
        and (regexp_matches(text, '(?i)\b(find|search|locate|look(?:ing)?\s+for|can''t\s+find|cannot\s+find|couldn''t\s+find|old\s+pictures?|old\s+photos?|screenshot|metadata|people|face|album|remember\s+when|incomplete\s+memory|workaround|date|location|place|years?\s+ago|abandon|gave\s+up|scroll)\b')
            or regexp_matches(text, '(?i)\b(google\s+photos|gphotos|photos\s+app)\b')
            or (regexp_matches(text, '(?i)\b(pain\s+points?|sentiment|themes?|frustrations?|complaints?|key\s+findings?|what\s+are|how\s+(?:is|are|do)\s+users?|overall|search\s+experience|user\s+feedback|evidence)\b')
                and regexp_matches(text, '(?i)\b(search|photos?|retrieval|feedback|google\s+photos|users?|ask\s+photos|ai\s+search)\b')))
        and not (regexp_matches(text, '(?i)\b(backup|sync|storage|quota|billing|subscription|payment|upload)\b') and not regexp_matches(text, '(?i)\b(find|search|locate|missing\s+photo|can''t\s+find|cannot\s+find)\b')), false) as in_scope, count(*) as n from """ + PLAIN_ITEMS + " f group by 1",
    "chunk_rollup": f"with {_CHUNK_CTE} select f.id, t.categories, coalesce(t.confidence > 0.55, false) as confident, length(coalesce(f.text, '') || case when coalesce(trim(f.thread_context, ' '), '') <> '' then chr(10) || chr(10) || '--- thread context ---' || chr(10) || f.thread_context else '' end) as chars, greatest(coalesce(t.severity, 0.0), x.fr + x.em) as impact from feedback_item f join x using (id) left join t on t.id = f.id where f.relevance_label = 'retrieval_related' and coalesce(trim(f.source_url, ' '), '') <> ''",
    "evidence_by_kind": f"with f as (select * from {PLAIN_ITEMS} x) select 'relevant' as kind, id from f where relevance_label = 'retrieval_related' union all select 'reddit', id from f where source = 'reddit' union all select 'workaround', id from f where {sql_hit('text', chr(92) + 'bworkaround' + chr(92) + 'b')} union all select 'suggestion', id from f where {sql_hit('text', T.SUGGESTION)} and {sql_hit('text', T.SEARCHISH)}" + "".join(f" union all select 'search_type={n}', id from f where {sql_hit('text', p)}" for n, p in T.SEARCH_TYPES.rules),
}
