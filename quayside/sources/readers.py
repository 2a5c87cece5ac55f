"""Readers of the exports: store feeds, RPC text, forum posts, help pages, whole exports, labels.

Each reads files into the columns of a collected item: native_id, source, text, title, authored_at, source_url,
locale, thread_context, developer_reply, has_user_text.  A file or row that can't be read gives no row, never an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.rule_tables import SOURCES

FIELDS = ["native_id", "source", "text", "title", "authored_at", "source_url", "locale", "thread_context", "developer_reply", "has_user_text"]
#: Column of the place (file, position) a row was read from.
PLACE = "__place"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _item(df: DataFrame, **columns: Column) -> DataFrame:
    """The fields of an item, and the place it was read from where the rows have one."""
    place = [F.struct("file", "pos").alias(PLACE)] if "pos" in df.columns else []
    out = df.select(*[columns.get(f, F.lit(None).cast("boolean" if f == "has_user_text" else "string")).alias(f) for f in FIELDS], *place)
    return out.withColumn("has_user_text", F.coalesce("has_user_text", F.length(F.trim("text")) > 0, F.lit(False)))


def _each(df: DataFrame, *paths: str) -> DataFrame:
    """One row per element of the first of the paths that is an array (or the object itself, where a lone one stands)."""
    arrays = F.coalesce(*[F.coalesce(_get(F.col("v"), p, "array<variant>"), F.when(_get(F.col("v"), p, "map<string,variant>").isNotNull(), F.array(_get(F.col("v"), p, "variant")))) for p in paths])
    return df.select("file", F.posexplode(arrays).alias("pos", "e"))


def first_wins(items: DataFrame, order: tuple[str, ...] = (PLACE,)) -> DataFrame:
    """One row per (source, native_id): the first by ``order``, nulls last; partial in each partition, so no key is hot.

    The place of reading, the order by default, is dropped.
    """
    rest = [c for c in items.columns if c not in ("source", "native_id", PLACE)]
    place = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    g = items.groupBy("source", "native_id").agg(F.min_by(F.struct(*rest), place).alias("r"))
    return g.select("source", "native_id", "r.*").select(*[c for c in items.columns if c != PLACE])


def app_store_feed(spark: SparkSession, path: str, locale: str | None = None) -> DataFrame:
    """Feed pages; entries without a rating (the app's own) are left out, a rating may be text or an object."""
    d = _whole(spark, path).withColumn("v", F.try_parse_json("value"))
    e = _each(d, "$.feed.entry")
    col = F.col("e")
    rating = F.coalesce(_get(col, "$['im:rating'].label"), _get(col, "$['im:rating']"))
    e = e.withColumn("id", _get(col, "$.id.label")).filter(rating.isNotNull() & F.col("id").isNotNull())
    title, body = _get(col, "$.title.label"), _get(col, "$.content.label")
    text = F.concat_ws("\n", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(body), F.lit("")))
    return first_wins(_item(e, native_id=F.col("id"), source=F.lit("app_store"), text=text, title=title, authored_at=_get(col, "$.updated.label"), source_url=_get(col, "$.link.attributes.href"), locale=F.lit(locale)))


def play_rpc(spark: SparkSession, path: str, locale: str | None = None) -> DataFrame:
    """RPC text: the guard before the JSON is cut off, the payload is JSON inside JSON, rows are objects or positional."""
    d = _whole(spark, path).filter(~F.lower(F.ltrim("value")).startswith("<"))
    outer = F.try_parse_json(F.regexp_replace("value", r"^\s*\)\]\}'\s*", ""))
    d = d.withColumn("o", F.explode(_get(outer, "$", "array<variant>"))).filter(_get(F.col("o"), "$[1]") == "UsvDTd")
    d = d.withColumn("v", F.try_parse_json(_get(F.col("o"), "$[2]")))
    nested = _get(F.col("v"), "$[0]", "array<variant>")
    flat = _get(F.col("v"), "$", "array<variant>")
    rows = F.when(_get(F.col("v"), "$[0].reviewId").isNotNull(), flat).otherwise(F.coalesce(nested, flat))
    e = d.select("file", F.posexplode(rows).alias("pos", "e"))
    col = F.col("e")
    secs, nanos = _get(col, "$[5][0]", "bigint"), F.coalesce(_get(col, "$[5][1]"), F.lit("0"))
    millis = F.concat(secs.cast("string"), F.rpad(F.substring(nanos, 1, 3), 3, "0")).try_cast("bigint")
    authored = F.coalesce(_get(col, "$.date"), F.date_format(F.to_utc_timestamp(F.timestamp_millis(millis), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    e = e.withColumn("id", F.coalesce(_get(col, "$.reviewId"), _get(col, "$[0]"))).filter(F.col("id").isNotNull())
    text = F.coalesce(_get(col, "$.text"), _get(col, "$[4]"))
    return first_wins(_item(e, native_id=F.col("id"), source=F.lit("play_store"), text=text, authored_at=authored, locale=F.lit(locale), developer_reply=F.coalesce(_get(col, "$.replyText"), _get(col, "$[7][1]"))))


def reddit_dump(spark: SparkSession, path: str, kind: str = "post") -> DataFrame:
    """Posts or comments, bare or in an envelope; deleted bodies are empty, relative links are completed."""
    d = _whole(spark, path).withColumn("v", F.try_parse_json("value"))
    e = _each(d, "$.data.children", "$.data.items", "$.data", "$").withColumn("e", F.coalesce(_get(F.col("e"), "$.data", "variant"), F.col("e")))
    col = F.col("e")
    body = F.coalesce(_get(col, "$.selftext"), _get(col, "$.body"), F.lit(""))
    body = F.when(body.isin("[deleted]", "[removed]"), "").otherwise(body)
    link = _get(col, "$.permalink")
    e = e.withColumn("id", _get(col, "$.id")).filter(F.col("id").isNotNull())
    text = F.concat_ws("\n", F.nullif(F.coalesce(_get(col, "$.title"), F.lit("")), F.lit("")), F.nullif(body, F.lit("")))
    return first_wins(_item(
        e, native_id=F.concat(F.lit(f"{kind}:"), F.col("id")), source=F.lit("reddit"), text=text, title=_get(col, "$.title"), authored_at=_get(col, "$.created_utc"),
        source_url=F.when(link.startswith("/"), F.concat(F.lit("https://www.reddit.com"), link)).otherwise(link),
    ))


class _Thread(HTMLParser):
    """Title and messages of a help page; a message is a div with a message type, a reply by class, or an article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.messages, self.page, self.depth, self.tag, self.in_title = "", [], [], 0, "", False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.depth:
            self.depth += tag == self.tag
        elif tag == "article" or "data-message-type" in a or "cc-reply" in (a.get("class") or "").split():
            self.depth, self.tag = 1, tag
            self.messages.append([])
        self.in_title |= tag == "title"

    def handle_endtag(self, tag):
        if self.depth and tag == self.tag:
            self.depth -= 1
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
            return
        self.page.append(data)
        if self.depth:
            self.messages[-1].append(data)


def parse_thread(page: str) -> tuple[str, str, str] | None:
    """(title, question, replies) of a page; None for a wall to sign in at."""
    p = _Thread()
    p.feed(page or "")
    clean = lambda parts: " ".join("".join(parts).split())
    title, messages = clean(p.title), [m for m in map(clean, p.messages) if m]
    if title.lower().startswith("sign in") and not messages:
        return None
    if not messages:
        return title, clean(p.page)[:8000], ""
    return title, messages[0], "\n---\n".join(messages[1:31])


def help_pages(spark: SparkSession, path: str) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *t) for f, v in zip(b["file"], b["value"]) if (t := parse_thread(v))]
            yield pd.DataFrame(rows, columns=["file", "title", "text", "context"])

    d = _whole(spark, path).mapInPandas(parse, "file string, title string, text string, context string")
    name = F.regexp_extract("file", r"([^/]+?)(?:\.html?)?$", 1)
    return _item(d, native_id=name, source=F.lit("help_community"), text=F.col("text"), title=F.col("title"), thread_context=F.nullif(F.col("context"), F.lit("")))


def thread_urls(pages: Column, host: str) -> Column:
    """Addresses of threads in a page: absolute or relative, on the host only, each id once."""
    found = F.regexp_extract_all(pages, F.lit(r"(?:https?://[\w.-]+)?/[\w/-]*thread/\d+"), F.lit(0))
    own = F.filter(found, lambda u: u.startswith("/") | F.contains(u, F.lit(f"://{host}/")))
    return F.array_distinct(F.transform(own, lambda u: F.concat(F.lit(f"https://{host}/thread/"), F.regexp_extract(u, r"thread/(\d+)", 1))))


def export_json(spark: SparkSession, path: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """A whole export: rows of each source under ``raw``; sources without rows are no error, a key that stands twice is its first row."""
    d = _whole(spark, path).withColumn("v", F.try_parse_json("value"))
    parts = []
    for s in only or SOURCES:
        e = _each(d, f"$.raw.{s}")
        g = lambda n: _get(F.col("e"), f"$.{n}")
        locale = {"app_store": g("storefront"), "reddit": g("subreddit")}.get(s, F.lit(None).cast("string"))
        context = g("thread_context") if s in ("reddit", "help_community") else F.lit(None).cast("string")
        title = F.lit(None).cast("string") if s == "play_store" else g("title")
        reply = g("developer_reply") if s == "play_store" else F.lit(None).cast("string")
        has = F.length(F.trim(g("text"))) > 0
        e = e.filter(F.length(g("native_id")) > 0)
        parts.append(_item(e, native_id=g("native_id"), source=F.lit(s), text=F.coalesce(g("text"), F.lit("")), title=title, authored_at=g("authored_at"), source_url=g("source_url"), locale=locale, thread_context=context, developer_reply=reply, has_user_text=F.coalesce(has, F.lit(False))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_wins(out)


def import_export(old: DataFrame | None, spark: SparkSession, path: str, only: tuple[str, ...] | None = None, replace: bool = True) -> DataFrame:
    """Items after an import: those of the named sources (all, where none is named) give way, or stay beside new keys."""
    new = export_json(spark, path, only)
    if old is None:
        return new
    if replace:
        return old.filter(~F.col("source").isin(*(only or SOURCES))).unionByName(new, allowMissingColumns=True)
    return old.unionByName(new.join(old.select("source", "native_id"), ["source", "native_id"], "left_anti"), allowMissingColumns=True)


def export_receipts(spark: SparkSession, path: str) -> DataFrame:
    """(source, status, notes) of an export; an unknown status counts as partial."""
    d = _whole(spark, path).withColumn("v", F.try_parse_json("value"))
    m = F.try_variant_get(F.col("v"), "$.receipts", "map<string,struct<status:string,notes:string>>")
    x = d.select(F.explode(m).alias("source", "r"))
    return x.select("source", F.when(F.col("r.status").isin("success", "partial", "failed", "gap", "skipped"), F.col("r.status")).otherwise("partial").alias("status"), "r.notes")


def curated_labels(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each key of JSON lines, by file and line; broken lines and those without a key are left out."""
    d = _whole(spark, path).select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    d = d.withColumn("v", F.try_parse_json("line")).withColumn("key", _get(F.col("v"), "$.key")).filter("key is not null")
    g = d.groupBy("key").agg(F.max_by("line", F.struct("file", "pos")).alias("row"))
    fields = "in_scope boolean, oos_reason string, is_forum_reply boolean, signal string, sentiment string, pain_points array<string>, search_types array<string>, is_suggestion boolean, label_source string"
    return g.select("key", F.from_json("row", fields).alias("l")).select("key", "l.*")


def gold_items(spark: SparkSession, path: str) -> DataFrame:
    d = _whole(spark, path).select(F.from_json("value", "items array<struct<id:string,case:string,text:string,labels:array<string>,hypothesis:string>>").alias("g"))
    return d.select(F.inline("g.items"))


def taxonomy_problems(nodes: DataFrame) -> DataFrame:
    """(problem, id): ids that stand twice and parents that don't exist."""
    twice = nodes.groupBy("id").count().filter("count > 1").select(F.lit("duplicate id").alias("problem"), "id")
    lost = nodes.filter("parent_id is not null").join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(F.lit("unknown parent").alias("problem"), "id")
    return twice.union(lost)
