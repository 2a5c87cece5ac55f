"""Training-data operators against brute force, round trips and small fixtures; nulls, blanks, ties, long texts, empty tables."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.llm import canon, encode, language, mixing, neardup, personal, reading, residue, split
from quayside.session import table

SMALL = "/root/testdata/sf0.001"


# -- 1 residue ---------------------------------------------------------------------------------------------------------

PROSE = ["The search bar shows random pictures of my dog since the update.", "I was looking for the concert videos and found nothing at all.", "Opening the album gives a 502 bad gateway, then it works again after a minute.", "Die Zeitleiste zeigt nach dem Update keine Fotos mehr an.", "great app"] * 40
RESIDUE = ["Please enable JavaScript to view this content.", "Hi {{first_name}}, thank you for rating ${product}.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "<html><body><h1>404 Not Found</h1></body></html>", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS CONTENT.", "asdf asdf qwerty asdf"]


def test_residue(spark):
    rows = [(i, t) for i, t in enumerate(PROSE + RESIDUE + [None, "", "  ", "👍👍", "ok", "😀" * 3, PROSE[0] * 400])]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("is_residue_note", F.lit(1))
    got = {r["id"]: r["is_residue"] for r in residue.flag_residue(df).collect()}
    flagged = {i for i, f in got.items() if f}
    assert flagged == set(range(len(PROSE), len(PROSE) + len(RESIDUE)))
    assert residue.flag_residue(df.limit(0)).count() == 0


def test_residue_of_families_that_are_no_seeds():
    """Seeds by half: what stands only in the other half is still found, by what residue of its kind has in common."""
    prose = residue.fit_residue(np.ones(residue.BUCKETS))
    assert prose.shape == (4, residue.BUCKETS)
    texts = [r for r in pd.read_parquet("/root/testdata/sf0.01/collected_item.parquet", columns=["text"])["text"].dropna()]
    counts = np.zeros(residue.BUCKETS)
    c = residue._signs(residue._simplify(residue._join(texts)))
    counts += np.bincount(residue._trigrams(c)[c != 0], minlength=residue.BUCKETS)
    full = residue.is_residue(pd.Series(texts), residue.fit_residue(counts))
    rnd, kept = random.Random(2), []
    for _ in range(3):
        half = {k: "\n".join(x for line in s.split("\n") for x in [" ".join(p for p in line.split(". ") if rnd.random() < 0.5)] if x) for k, s in zip(residue.KINDS, (residue.FILLER, residue.NOTICES, residue.TEMPLATES))}
        kept.append((residue.is_residue(pd.Series(texts), residue.fit_residue(counts, half)) & full).sum() / full.sum())
    assert full.sum() > 50 and min(kept) > 0.4
    kinds = residue.kinds_of(["Lorem ipsum dolor sit amet, consectetur.", "Please enable JavaScript to view this page.", "Hi {{name}}, thank you for rating {{app}}."], residue.fit_residue(counts))
    assert kinds == ["filler", "notice", "template"]


@pytest.mark.parametrize("page", ["Error 404: page not found.", "Please enable JavaScript to view this content.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."])
def test_residue_copied_to_a_third_of_rows(spark, page):
    texts = [r["text"] for r in table(spark, SMALL, "collected_item").filter("text is not null").select("text").collect()]
    copies = [page.replace("404", str(400 + i % 9)) for i in range(len(texts) // 2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + copies)], "id int, text string")
    assert residue.flag_residue(df).filter(F.col("id") >= len(texts)).filter("is_residue").count() == len(copies)


# -- 2 personal --------------------------------------------------------------------------------------------------------

HARMLESS = "Version 7.44.1427 of Album Studio, ticket 4471-3088, file IMG_2024664_1180.jpg, 22,355 pictures in Stederk-98 Nialat and @lumen_help on the Vrashux T739."


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail me: a.b+c@mail.example.net now", [("email", "a.b+c@mail.example.net")]),
        ("write to felix_k [at] kontor [dot] example.", [("email", "felix_k [at] kontor [dot] example")]),
        ("or yara at mail dot example dot net, please", [("email", "yara at mail dot example dot net")]),
        ("My number is +44 1632 960795, call after six", [("phone", "+44 1632 960795")]),
        ("Text (606) 555-0129 or 0049-30-23125-278", [("phone", "(606) 555-0129"), ("phone", "0049-30-23125-278")]),
        ("The scan shows passport QQ 45 90 61 B, delete it", [("id_number", "QQ 45 90 61 B")]),
        ("Support asked for my ID, it is 848.117.607-95.", [("id_number", "848.117.607-95")]),
        ("I live at Flat 10, 401 Tessel Close, Dellbrook, and", [("address", "Flat 10, 401 Tessel Close, Dellbrook")]),
        ("letter to Calle Holmgate 241, 50947 Brannock.", [("address", "Calle Holmgate 241, 50947 Brannock")]),
        ("My name is Anna Yolinger and I have used this", [("person_name", "Anna Yolinger")]),
        ("belongs to Mrs Chiara B. Dremström, not to me", [("person_name", "Chiara B. Dremström")]),
        (HARMLESS, []), ("", []), ("already [EMAIL] and [PHONE]", []),
    ],
)
def test_pieces(text, want):
    got = personal.find_personal(text, lambda kind, term: False)
    assert [(k, text[a:b]) for a, b, k in got] == want
    clean = personal.redact(text, got)
    assert all(piece not in clean for _, piece in want) and personal.find_personal(clean, lambda *_: False) == []


def test_disclosure_learns_names(spark):
    said = [f"My name is {g} Tolinger and I like it." for g in ("Rohan", "Mirela") for _ in range(6)]
    things = [f"It is in {a} {b} 12 and {b} {a} 99." for a, b in (("Pregoal", "Boskut"), ("Vruna", "Stelm")) for _ in range(30)]
    rows = [(str(i), t, None) for i, t in enumerate([*said, *things, "Somebody told Rohan Wexley about it.", None, ""])]
    df = spark.createDataFrame(rows, "raw_record_id string, text string, thread_context string")
    got = personal.pieces_of(df, "raw_record_id", ["text", "thread_context"]).collect()
    last = [r for r in got if r["raw_record_id"] == str(len(said) + len(things))]
    assert [(r["kind"], r["start_pos"]) for r in last] == [("person_name", 14)] and len(got) == len(said) + 1
    red = personal.redact_items(df.withColumn("redaction_flag", F.lit(0)), ["text", "thread_context"])
    assert red.filter("redaction_flag = 1").count() == len(said) + 1 and red.columns == [*df.columns, "redaction_flag"]
    assert personal.pieces_of(df.limit(0), "raw_record_id", ["text"]).count() == 0


def test_copies_without_a_cue_hide_no_name(spark):
    said = [f"My name is Rohan {n}olinger and I like it." for n in "TBDF"] + [f"The scan shows passport QX 45 90 6{i} B, delete it" for i in range(4)]
    copied = "Somebody told Rohan Wexley about it, see QX 11 22 33 B there."
    rows = [(str(i), t, None) for i, t in enumerate(said + ["But Rohan Uxbold wrote QX 77 12 34 B there."] + ["Nothing of note in here."] * 200)] + [(f"c{i}", f"Quote {i}", copied) for i in range(100)]
    df = spark.createDataFrame(rows, "raw_record_id string, text string, thread_context string")
    got = Counter(r["raw_record_id"][0] == "c" for r in personal.pieces_of(df, "raw_record_id", ["text", "thread_context"]).collect())
    assert got == {True: 200, False: len(said) + 2}


# -- 3 split -----------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n,é日。😀", min_size=0, max_size=400), st.integers(12, 60))
def test_split_round_trip(text, limit):
    overlap = limit // 5
    pieces = split.split_text(text, limit, overlap)
    if len(text) <= limit:
        assert pieces == []
        return
    assert all(len(p) <= limit for _, p in pieces) and pieces[0][1] + "".join(p[overlap:] for _, p in pieces[1:]) == text
    assert all(b[1].startswith(a[1][-overlap:]) for a, b in zip(pieces, pieces[1:]))
    power = split.strengths(text)
    for (s, p), _ in zip(pieces, pieces[1:]):  # brute force: the strongest cut, the rightmost of equals
        best = max(range(s + limit // 2 + 1, s + limit + 1), key=lambda i: (power[i], i))
        early = max(range(s + overlap + 1, s + limit // 2 + 1), key=lambda i: (power[i], i))
        assert s + len(p) == (early if power[best] < split.NATURAL <= power[early] else best)


def test_split_items(spark):
    body = "A sentence of some words. " * 400
    rows = [("a", body, None), ("b", "short", "x" * 9000), ("c", None, ""), ("d", "😀" * 4000, "e" * 4001)]
    df = spark.createDataFrame(rows, "raw_record_id string, text string, thread_context string").withColumn("piece", F.lit(1))
    got = split.split_items(df, "raw_record_id", ["text", "thread_context"]).collect()
    assert {(r["raw_record_id"], r["field_name"]) for r in got} == {("a", "text"), ("b", "thread_context"), ("d", "thread_context")}
    first = sorted((r for r in got if r["raw_record_id"] == "a"), key=lambda r: r["piece_no"])
    assert first[0]["piece"].endswith(". ") and first[0]["piece"] + "".join(r["piece"][200:] for r in first[1:]) == body
    assert split.split_items(df.limit(0), "raw_record_id", ["text"]).count() == 0


# -- 4 canon -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("a, b", [("ﬁlter", "filter"), ("Ｖｅｒｓｉｏｎ　４", "Version 4"), ("café", "café"), ("sea​rch­", "search"), ("Тhе сat", "The cat"), ("a b c", "a b c"), ("ﾊﾞ", "バ"), ("A‑1", "A-1")])
def test_same_look(a, b):
    assert canon.visual_form(a) == canon.visual_form(b) and canon.canonical_form(a) == canon.canonical_form(b)


@pytest.mark.parametrize("a, b", [("Search", "search"), ("resume", "résumé"), ("a-b", "a b"), ("x²", "x2"), ("end.", "end")])
def test_other_look(a, b):
    assert canon.visual_form(a) != canon.visual_form(b)


@pytest.mark.parametrize("code", [0x2065, 0xFFF0, 0x1BCA0, 0x1D173, 0xE0041, 0x034F, 0x3164])
def test_ignorable_characters_go(code):
    assert canon.visual_form(f"a{chr(code)}b") == "ab" and canon.canonical_form(f"a{chr(code)}b") == "ab"


def test_canonical_words():
    assert canon.canonical_form("ПОСЛЕ В") == canon.canonical_form("после в") and canon.canonical_form("пoслe") == "после" and canon.canonical_form("STRASSE") == canon.canonical_form("Straße")
    for s in ("", "Ａé́ß Тhе ПОСЛЕ", "​"):
        assert canon.canonical_form(canon.canonical_form(s)) == canon.canonical_form(s) and canon.visual_form(canon.visual_form(s)) == canon.visual_form(s)


def test_quotes(spark):
    items = spark.createDataFrame([("i", "The cat sat on ﬁne mats"), ("n", None)], "id string, text string")
    rows = [("1", "i", '["The cat", "Тhе cat", "fine mats", "THE CAT", "dog"]'), ("2", "i", "not json"), ("3", "i", '{"a":1}'), ("4", "i", "[]"), ("5", "n", '["x"]'), ("6", "i", None), ("7", "i", '[null, "cаt"]')]
    c = spark.createDataFrame(rows, "id string, feedback_item_id string, snippets_json string")
    got = canon.quotes(c, items).mapInPandas(canon._looks_like_part, "classification_id string, snippet_no bigint").collect()
    assert {(r[0], r[1]) for r in got} == {("1", 1), ("1", 2), ("7", 1)}


# -- 6 near duplicates -------------------------------------------------------------------------------------------------


def _pairs(rows):
    bags_ = [(i, Counter(neardup.words_of(t))) for i, t in rows if t]
    bags_ = [(i, c, sum(c.values())) for i, c in bags_ if 25 <= sum(c.values()) <= 300]
    return {(min(i, j), max(i, j)) for x, (i, c, n) in enumerate(bags_) for j, d, m in bags_[:x] if 5 * (k := sum((c & d).values())) >= 4 * (n + m - k)}


def test_near_duplicates(spark):
    rnd = random.Random(11)
    vocabulary = ["the", "and", "my", "photos", "search"] + [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        base = [rnd.choice(vocabulary[:5]) if rnd.random() < 0.5 else rnd.choice(vocabulary) for _ in range(rnd.randint(20, 60))]
        for j in range(rnd.randint(1, 4)):
            edited = [w if rnd.random() > 0.05 * j else rnd.choice(vocabulary) for w in base]
            if j == 2:
                rnd.shuffle(edited)
            rows.append((f"{i:03d}-{j}", " ".join(edited).capitalize() + "."))
    rows += [("n", None), ("e", ""), ("s", "too short"), *[(f"copy{k}", rows[0][1]) for k in range(8)]]
    df = spark.createDataFrame(rows, "id string, text string")
    want, got = _pairs(rows), {(r[0], r[1]) for r in neardup.similar_items(df).collect()}
    assert got <= want and len(got) >= 0.995 * len(want) > 50
    assert neardup.similar_items(df.limit(0)).count() == 0


def test_recall_of_contained_pairs_at_scale():
    """Planted pairs, one bag within the other, at exactly the threshold; frequencies as of 10 million bags."""
    rng, n = np.random.default_rng(5), 10_000_000
    vocabulary = rng.integers(0, 1 << 63, 40_000).astype(np.uint64)
    p = 1 / np.arange(5, 40_005)
    count = np.bincount((vocabulary >> np.uint64(46)).astype(np.int64), weights=n * np.minimum(0.9, 50 * p / p.sum()), minlength=neardup.TABLE).astype(np.int64)
    bits, enough = np.log2(np.maximum(1.0, n / np.maximum(1, count))), float(np.log2(n / neardup.EXPECTED))
    pairs = 4000
    sets = [rng.choice(vocabulary, 50, replace=False, p=p / p.sum()) for _ in range(pairs + 500)]
    trees = neardup.trees_for(np.concatenate(sets[pairs:]), np.arange(0, 501 * 50, 50), bits, enough)
    sets = sets[:pairs]
    both = [x for s in sets for x in (s, s[:40])]
    owner, path = neardup.paths(np.concatenate(both), np.r_[0, np.cumsum([len(x) for x in both])], bits, enough, trees)
    of = pd.DataFrame({"pair": owner // 2, "side": owner % 2, "path": path}).drop_duplicates()
    met = of.groupby(["pair", "path"]).size().loc[lambda x: x == 2].reset_index()["pair"].nunique()
    assert 1 - met / pairs <= 2 * neardup.MISS, (met, trees)


def test_crowded_ends_are_compared_whole(spark, monkeypatch):
    for name, value in (("CROWDED", 5), ("ROUNDS", 1), ("BLOCK", 7), ("AT_ONCE", 9), ("MEMBERS", 2), ("SENT", 3)):
        monkeypatch.setattr(neardup, name, value)
    base = [f"w{i}" for i in range(40)]
    rows = [(f"{i:02d}", " ".join([*base, f"own{i % 20}"])) for i in range(24)]
    df = spark.createDataFrame(rows, "id string, text string")
    assert sorted((r[0], r[1]) for r in neardup.similar_items(df).collect()) == sorted(_pairs(rows)) and len(_pairs(rows)) == 24 * 23 // 2


def test_branching_on_keeps_the_pairs(spark, monkeypatch):
    for name, value in (("CROWDED", 4), ("BLOCK", 6)):
        monkeypatch.setattr(neardup, name, value)
    rnd = random.Random(3)
    rows = []
    for i in range(150):
        base = [f"v{rnd.randint(0, 300)}" for _ in range(40)]
        rows += [(f"{i:03d}-{j}", " ".join([*base[j * 3 :], *(f"e{i}x{k}" for k in range(j * 3))])) for j in range(2)]
    df = spark.createDataFrame(rows, "id string, text string")
    want, got = _pairs(rows), {(r[0], r[1]) for r in neardup.similar_items(df).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) >= 140


def test_groups_of_the_small_table(spark):
    rows = [(r["id"], r["text"]) for r in table(spark, SMALL, "feedback_item").select("id", "text").collect()]
    pairs = _pairs(rows)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    want = {}
    for x in list(root):
        want.setdefault(find(x), set()).add(x)
    got = {}
    for r in neardup.p6_groups(spark, SMALL).collect():
        got.setdefault(r["group_id"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(pairs) > 5


def test_many_copies_are_no_hot_key(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.range(1300).select(F.col("id").cast("string").alias("id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([("x", text + " more")], "id string, text string"))
    assert neardup.similar_items(df).distinct().count() == 1301 * 1300 // 2


# -- 7 language --------------------------------------------------------------------------------------------------------


def test_languages(spark):
    w = language.fit([], [])
    texts = ["Ich finde meine Bilder nicht mehr. I do not know why the search is so slow today.", "このアプリで写真が見つかりません。とても残念です。", "Я не могу найти фотографии после обновления.", None, "", "👍 123", "No encuentro las fotos de mi perro en el teléfono."]
    got = [[x[2] for x in s] for s in language.segments(texts, w)]
    assert got == [["de", "en"], ["ja", "ja"], ["ru"], [], [], [], ["es"]]
    assert all(0 < x[3] <= 1 and texts[0][x[1] :].startswith(x[0]) for x in language.segments(texts[:1], w)[0])
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, text string")
    rows = language.tag_languages(df, "k", "text", w).collect()
    assert {(r["k"], r["lang"]) for r in rows} == {("0", "de"), ("0", "en"), ("1", "ja"), ("2", "ru"), ("6", "es")}
    named = spark.createDataFrame([("en-US",), (" DE_at",), ("und",), ("",), (None,), ("english",)], "l string").select(language.named_language(F.col("l"))).collect()
    assert [r[0] for r in named] == ["en", "de", None, None, None, None]


def test_segments_have_places(spark):
    parts = ["The search does not work at all since the last update.", "Nach dem Update sind alle Fotos verschwunden und niemand hilft.", "br"]
    text = f"{parts[0]}\n{parts[1]}<br>{parts[2]}"
    df = spark.createDataFrame([("a", text), ("b", None), ("c", " ")], "id string, t string")
    got = language.tag_segments(df, "id", "t", language.fit([], [])).orderBy("start_pos").collect()
    assert [text[r["start_pos"] : r["end_pos"]] for r in got] == parts and {r["id"] for r in got} == {"a"}
    assert [r["lang"] for r in got[:2]] == ["en", "de"] and all(0 < r["confidence"] <= 1 for r in got)
    assert "p7_segments" in language.QUERIES and language.tag_segments(df.limit(0), "id", "t", language.fit([], [])).count() == 0


def test_language_accuracy_held_out():
    p = pd.read_parquet("/root/testdata/sf0.01/collected_item.parquet", columns=["text", "locale"]).dropna()
    p["named"] = p.locale.str.strip().str.lower().str.extract(r"^([a-z]+)(?:[-_].*)?$")[0]
    p = p[p.named.isin(language.LANGUAGES) & p.text.str.len().between(80, 2000)]
    c, y = [], []
    for t, n in zip(p.text[:900], p.named[:900]):
        for s in [x for x in map(language.clean, language.sentences(t)) if len(x) >= 16][:2]:
            c.append(s)
            y.append(n)
    got = language.segments(p.text[900:].tolist(), language.fit(c, y))
    agree = [Counter(x[2] for x in s).most_common(1)[0][0] == n for s, n in zip(got, p.named[900:]) if s]
    assert np.mean(agree) > 0.8  # a good tenth of the labels is untrue by construction


# -- 8 encoding --------------------------------------------------------------------------------------------------------


def _reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "a", "Hello  world!\n\n\tcode(x) != 1;", "naïve café 日本語 😀👩‍👩‍👧", "<|endoftext|> it's DON'T", "x" * 5000, "ab" * 3000 + " " * 700, "​﻿"]


def test_encoding(spark):
    t = _reference()
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*ODD, None, *ODD])], "doc_id long, text string").withColumn("n", F.lit(1))
    got = {r["doc_id"]: list(r["ids"]) for r in encode.encode_texts(df).collect()}
    want = {i: (t.encode(x, add_special_tokens=False).ids if x else []) for i, x in enumerate([*ODD, None, *ODD])}
    assert got == want and encode.encode_texts(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6), max_size=60))
def test_lexicon(words):
    outputs = {w: [i, i + 1] for i, w in enumerate(words)}
    x = encode.Lexicon.build(outputs)
    for w, n in zip(words, x.find(words)):
        assert n >= 0 and x.output(n) == outputs[w]
    others = [w + b"\x00!" for w in words if w + b"\x00!" not in outputs]
    assert (x.find(others) == -1).all()


def test_lexicon_shares_suffixes():
    words = [f"{p}{s}".encode() for p in "abcdefgh" for s in ("ing", "ed", "er", "s")]
    assert len(encode.Lexicon.build({w: [1] for w in words}).finals) < 12


# -- 9 mixing ----------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rnd = random.Random(5)
    rows = [(i, s, rnd.randint(5, 400)) for i, s in enumerate(["big"] * 6000 + ["Mid-size"] * 900 + ["small"] * 60)]
    rows += [(10_000, None, 50), (10_001, "big", 0), (10_002, "other", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid_size", 0.35, 3), ("small", 0.1, 9), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(df, targets)
    got = {r["source"]: r for r in shares.collect()}
    used = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert used <= 9 and mixed.filter("source = 'big'").groupBy("doc_id").count().filter("count > 1").count() == 0
    total = sum(r["tokens"] for r in got.values())
    for s, share in (("big", 0.5), ("mid_size", 0.35), ("small", 0.1)):
        assert got[s]["tokens"] / total == pytest.approx(share / 0.95, abs=0.002)
    assert got["none"]["tokens"] == 0 and {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in mixing.mix(df, targets)[0].collect()}
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


# -- 10 reading --------------------------------------------------------------------------------------------------------


def test_reading(spark):
    easy = ["I see the dog. It is fun. I want it back. We ran to the lake and had a nice day by the sea."] * 12
    hard = ["Notwithstanding administrative considerations, the methodological apparatus substantially undermines interpretations attributable to computational limitations of the infrastructure."] * 12
    middle = ["On my phone the search bar shows random pictures, so I have to scroll through everything by hand most evenings."] * 12
    rows = [(i, t, "en") for i, t in enumerate(easy + middle + hard)]
    rows += [(100, None, None), (101, "", "en"), (102, "ok", "en"), (103, "we had the dog and it is fun and i want it back and we ran to the lake and it is fun", "de"), (104, "Https Vroakust-Breikloastuvarin Skoufomorelianik " * 6, "en"), (105, hard[0] * 50, "und")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("band", F.lit("x"))
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(["easy"] * 12 + ["middle"] * 12 + ["demanding"] * 12)], "doc_id long, band string")
    got = {r["doc_id"]: r for r in reading.grade(df, labels).collect()}
    assert all(got[i]["level"] == b for i, b in enumerate(["easy"] * 12 + ["middle"] * 12 + ["demanding"] * 12))
    assert got[100]["level"] is None and got[102]["level"] is None and got[103]["level"] == "easy" and got[104]["level"] != "demanding" and got[105]["level"] == "demanding"
    assert got[105]["english_share"] > 0.9


def test_all_queries_run_on_the_small_tables(spark):
    from quayside.llm.queries import oracle_sql, queries

    for name, q in queries().items():
        assert q(spark, SMALL).count() >= 0, name
    assert set(oracle_sql()) <= set(queries()) and table(spark, SMALL, "documents").count() > 0
