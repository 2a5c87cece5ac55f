"""Queries over the string functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import rule_tables as T
from quayside.functions import text as X
from quayside.functions.rules import Hits, spread
from quayside.operators.labels import ENGAGEMENT_SQL, PLAIN_ITEMS, SUGGESTION_SQL, engagement, rank_of, suggestion
from quayside.session import table


def html_strip(spark, sf_dir):
    """Entities decoded, tags and blanks removed from raw texts."""
    c = table(spark, sf_dir, "collected_item").select("raw_record_id", "text")
    return c.select("raw_record_id", X.strip_markup(F.col("text")).alias("clean"))


def help_titles(spark, sf_dir):
    c = table(spark, sf_dir, "collected_item").filter("source = 'help_community'")
    return c.select("raw_record_id", X.help_title(F.col("title")).alias("question"))


def canonical_projection(spark, sf_dir):
    """Raw records to items, as the stage does it: the cleaned text, and the address an item is known by."""
    c = table(spark, sf_dir, "collected_item").filter(F.coalesce("has_user_text", F.lit(True)))
    body = X.canonical_text(F.col("text"), F.col("title"), F.col("source"))
    x = c.select("raw_record_id", body.alias("body"), X.thread_url(F.col("source"), F.col("native_id"), F.col("source_url")).alias("url"))
    return x.filter(F.length("body") > 0)


def fallback_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.fallback_snippet(F.col("text")).alias("snippet"))


def sentence_expand_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", X.expand_prefix(F.col("text"), 160).alias("quote"))


def verbatim_quotes(spark, sf_dir):
    """The quotes of a classification that stand in their item's text, and as what they stand there."""
    c = table(spark, sf_dir, "classification").select("id", "feedback_item_id", F.from_json("snippets_json", "array<string>").alias("quotes")).filter(F.size("quotes") > 0)
    f = table(spark, sf_dir, "feedback_item").select(F.col("id").alias("feedback_item_id"), "text")
    x = c.join(f, "feedback_item_id").select("id", X.quotes_in_text(F.col("quotes"), F.col("text")).alias("kept"))
    return x.select("id", F.posexplode("kept").alias("pos", "quote")).select("id", F.col("pos").cast("bigint").alias("pos"), "quote")


def token_overlap_topk(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.overlap("search bar shows random pictures", F.col("text")).alias("score"))
    return d.orderBy(F.desc("score"), "doc_id").limit(50)


def token_overlap_stopwords(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.overlap("what about the pictures that users took", F.col("text"), T.STOP_WORDS, 2).alias("score"))
    return d.filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


def suggestion_order(spark, sf_dir):
    """Suggestions by the engagement of their raw records, then by their words."""
    h = Hits()
    f = h.add(spread(table(spark, sf_dir, "feedback_item").select("id", "raw_record_id", "text")), {"wish": suggestion(h)}).filter("wish")
    c = table(spark, sf_dir, "collected_item").select("raw_record_id", *[x.alias(n) for n, x in engagement("source", "raw_api_payload").items()])
    j = f.join(c.select("raw_record_id", rank_of().alias("rank")), "raw_record_id", "left")
    out = j.select("id", F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"), X.suggestion_priority(F.col("text")).alias("priority"))
    return out.orderBy(F.desc("rank"), F.desc("priority"), "id").limit(20)


def reply_json(spark, sf_dir):
    """The object of a reply, fenced, bare, with words around it, or not an object at all."""
    e = table(spark, sf_dir, "events").select("event_id", "props", (F.col("event_id") % 4).alias("form"))
    reply = F.when(F.col("form") == 0, F.concat(F.lit("Result:\n```json\n"), "props", F.lit("\n```"))).when(F.col("form") == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" I hope it helps."))).when(F.col("form") == 2, F.concat(F.lit("["), F.lit("1"), F.lit("]"))).otherwise(F.col("props"))
    return e.select("event_id", F.try_variant_get(X.find_json_object(reply), "$.k", "bigint").alias("k"))


def payload_redaction(spark, sf_dir):
    """Payloads with the values of author keys replaced at any depth."""
    c = table(spark, sf_dir, "collected_item")
    return c.select("raw_record_id", X.redact_keys(F.col("raw_api_payload"), T.REDACTED_KEYS).alias("payload"))


def entity_decoding(spark, sf_dir):
    """Entities put into texts, decoded again: the text comes back as it was."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), "e", "&#101;")
    return d.select("doc_id", X.unescape(coded).alias("plain"))


QUERIES = {f.__name__: f for f in (html_strip, help_titles, canonical_projection, fallback_snippet, sentence_expand_prefix, verbatim_quotes, token_overlap_topk, token_overlap_stopwords, suggestion_order, reply_json, payload_redaction, entity_decoding)}

#: Blanks as this engine's patterns know them; the other engine's \\s is ASCII only.
_BLANKS = r"[\s\x{1c}-\x{1f}\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_squeeze = lambda x: f"regexp_replace(regexp_replace({x}, '{_BLANKS}', ' ', 'g'), '^ | $', '', 'g')"
_strip = lambda x: _squeeze(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'g')")
_tokens = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
_words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_over = lambda ws: f"coalesce(len(list_intersect({_words(ws)}, {_tokens('text')})) / {len(ws)}.0::double, 0.0)"
_PHRASES = ("search", "filter", "date", "face", "album", "find", "please", "bring back", "sort")
ORACLES = {
    "html_strip": f"select raw_record_id, {_strip('text')} as clean from collected_item",
    "help_titles": f"select raw_record_id, trim(coalesce(regexp_replace({_strip('title')}, '\\s*-\\s*Google Photos Community\\s*$', '', 'i'), ''), ' ') as question from collected_item where source = 'help_community'",
    "canonical_projection": rf"""with h as (select *, {_strip('text')} as t, {_strip('title')} as n from collected_item where coalesce(has_user_text, true)),
        p as (select *, trim(coalesce(regexp_replace(n, '\s*-\s*Google Photos Community\s*$', '', 'i'), ''), ' ') as q, coalesce(t, '') as page from h),
        c1 as (select *, case when length(q) > 0 and position(lower(q) in lower(page)) > 0 then substring(page, position(lower(q) in lower(page))) else page end as b from p),
        c2 as (select *, case when length(q) > 0 and lower(substring(b, 1, length(q))) = lower(q) then q || regexp_replace(substring(b, length(q) + 1), '^\s*-?\s*Google Photos Community', '', 'i') else b end as b2 from c1),
        c3 as (select *, regexp_replace(regexp_replace(regexp_replace(b2, '(Skip to main content|Google Photos Help|Sign in|Google Help|Help Center(?: experience)?|Community Policy|Community Overview|Privacy Policy|Terms of Service|Submit feedback|Send feedback(?: about our Help Center)?|This help content & information|General Help Center experience|Enable Dark Mode|Google apps|Main menu|Clear search|Close search|Search Help Center|Can''t find your photos\?|Notification|Community Google Photos on(?:\.{{2,}}|…)|Passkeys are the simplest and most secure way to sign in to your account\.[^.]*\.|To sign in with just your fingerprint[^.]+\.|©\s*20\d{{2}}\s*Google|false|true|Close Next|Next Help Center Community)', ' ', 'gi'), '\bSearch\b(?:\s+\d+)?', ' ', 'gi'), '\b(\d{{6,}}|(?:true|false))\b', ' ', 'gi') as b3 from c2),
        c4 as (select *, {_squeeze('b3')} as b4 from c3),
        f as (select raw_record_id, source, native_id, source_url, case when source = 'help_community' then case when length(q) > 0 and length(b4) < length(q) then q when length(q) > 0 and position(lower(q) in lower(b4)) = 0 then q || ' ' || b4 else b4 end
            when coalesce(length(title) > 0, false) and not contains(page, title) then regexp_replace(coalesce(n, '') || chr(10) || page, '^\n|\n$', '', 'g') else page end as body from c4)
        select raw_record_id, body, coalesce(nullif(source_url, ''), case when length(native_id) > 0 then case source when 'reddit' then 'https://www.reddit.com/comments/' || native_id when 'help_community' then 'https://support.google.com/photos/thread/' || native_id end end) as url from f where length(body) > 0""",
    "fallback_snippet": "select doc_id, case when length(trim(text, ' ')) <= 180 then trim(text, ' ') else regexp_replace(substring(trim(text, ' '), 1, 180), '(?s) [^ ]*$', '') end as snippet from documents",
    "sentence_expand_prefix": r"with a as (select doc_id, text, length(text) as n, length(regexp_extract(substring(text, 161), '^[^.!?\n]*[.!?\n]')) as o from documents where text is not null), b as (select doc_id, regexp_replace(substring(text, 1, case when n <= 160 then n when o between 1 and 201 then 160 + o when n - 160 > 200 then 280 else n end), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') as t from a) select doc_id, case when length(t) > 600 then rtrim(substring(t, 1, 597), ' ') || '...' else t end as quote from b",
    "verbatim_quotes": rf"""with c as (select id, feedback_item_id, case when json_valid(snippets_json) and json_type(snippets_json::json) = 'ARRAY' then from_json(snippets_json::json, '["VARCHAR"]') end as l from classification),
        p as (select id, feedback_item_id, unnest(range(len(l))) as i, unnest(l) as raw from c), x as (select p.id, i, regexp_replace(coalesce(raw, ''), '^{_BLANKS}|{_BLANKS}$', '', 'g') as q, coalesce(f.text, '') as t from p join feedback_item f on f.id = p.feedback_item_id),
        k as (select id, i, case when q = '' then null when contains(t, q) then q when contains({_squeeze('t')}, {_squeeze('q')}) then case when length(q) >= 12 and position(lower(substring(q, 1, 12)) in lower(t)) > 0 then substring(t, position(lower(substring(q, 1, 12)) in lower(t)), length(q)) else q end end as quote from x),
        u as (select id, quote, min(i) as i from k where quote is not null group by id, quote) select id, row_number() over (partition by id order by i) - 1 as pos, quote from u""",
    "token_overlap_topk": f"select doc_id, {_over(['bar', 'pictures', 'random', 'search', 'shows'])} as score from documents order by score desc, doc_id limit 50",
    "token_overlap_stopwords": f"with x as (select doc_id, {_over(['pictures', 'took'])} as score from documents) select * from x where score > 0 order by score desc, doc_id limit 50",
    "suggestion_order": "with e as (" + ENGAGEMENT_SQL + "), f as (select id, raw_record_id, text from " + PLAIN_ITEMS + " p where " + SUGGESTION_SQL + ") select f.id, cast(coalesce(e.rank, 0) as bigint) as rank, cast(" + " + ".join(f"coalesce(contains(lower(text), '{p}')::int, 0)" for p in _PHRASES) + " - coalesce((length(text) > 900)::int, 0) as int) as priority from f left join e using (raw_record_id) order by rank desc, priority desc, id limit 20",
    "reply_json": "select event_id, try_cast(case when event_id % 4 <> 2 and json_valid(props) then props::json->>'$.k' end as bigint) as k from events",
    "entity_decoding": "select doc_id, text as plain from documents",
}
