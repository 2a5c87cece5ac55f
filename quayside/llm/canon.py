"""Visually identical text brought to one form (problem 4).

``visual_form`` keeps what can be seen (case, accents, punctuation, wording) and removes what cannot: kinds of blank,
default-ignorable characters, full- and half-width forms, joined letters, ways of composing an accent, letters of
another script with the same look.  ``canonical_form`` goes on to compatibility composition, full case folding and
word-wise choice of script, for comparisons that ignore case.  Both are computed once per distinct value of a batch.

Cases: null stays null; an empty or all-invisible text gives an empty string; every character of a text of any length
counts; both forms are idempotent; repeated rows are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import table

#: Letters of other scripts with the look of a Latin letter; fixed values (look-alike, Latin).
LOOKALIKES = (
    ("а", "a"), ("е", "e"), ("о", "o"), ("р", "p"), ("с", "c"), ("у", "y"), ("х", "x"), ("і", "i"), ("ѕ", "s"), ("ј", "j"),
    ("һ", "h"), ("ԁ", "d"), ("ԛ", "q"), ("ԝ", "w"), ("ӏ", "l"), ("ү", "y"), ("ԍ", "g"),
    ("А", "A"), ("В", "B"), ("Е", "E"), ("К", "K"), ("М", "M"), ("Н", "H"), ("О", "O"), ("Р", "P"), ("С", "C"), ("Т", "T"),
    ("У", "Y"), ("Х", "X"), ("І", "I"), ("Ѕ", "S"), ("Ј", "J"), ("Ԛ", "Q"), ("Ԝ", "W"), ("Ү", "Y"), ("Ӏ", "I"), ("Ԍ", "G"),
    ("α", "a"), ("ο", "o"), ("ν", "v"), ("υ", "u"), ("ι", "i"), ("κ", "k"), ("ρ", "p"), ("γ", "y"), ("ϲ", "c"), ("ϳ", "j"),
    ("Α", "A"), ("Β", "B"), ("Ε", "E"), ("Ζ", "Z"), ("Η", "H"), ("Ι", "I"), ("Κ", "K"), ("Μ", "M"), ("Ν", "N"), ("Ο", "O"),
    ("Ρ", "P"), ("Τ", "T"), ("Υ", "Y"), ("Χ", "X"), ("Ϲ", "C"),
    ("օ", "o"), ("ո", "n"), ("ս", "u"), ("ց", "g"), ("հ", "h"), ("յ", "j"), ("Օ", "O"), ("Ս", "U"), ("Տ", "S"),
    ("ɑ", "a"), ("ɡ", "g"), ("ı", "i"), ("ⅼ", "l"),
)
_HYPHENS = "‐‑"
_DIGRAPHS = range(0x01C4, 0x01CD), range(0x01F1, 0x01F4), range(0x0132, 0x0134), range(0xFB00, 0xFB18)


def ignorable(ch: str) -> bool:
    """Default-ignorable: format characters, fillers, variation selectors and tags."""
    o = ord(ch)
    return (
        (unicodedata.category(ch) == "Cf" and not (0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD)))
        or o in (0x034F, 0x2065, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
        or 0xFE00 <= o <= 0xFE0F
        or 0xFFF0 <= o <= 0xFFF8
        or 0xE0000 <= o <= 0xE0FFF
    )


@lru_cache(1)
def _visual_map() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for o in (*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x110BD, 0x110CE), *range(0x13430, 0x13440), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE1000)):
        ch = chr(o)
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        if ignorable(ch):
            out[o] = None
        elif ch.isspace():
            out[o] = " "
        elif tag in ("<wide>", "<narrow>") or (tag == "<compat>" and any(o in r for r in _DIGRAPHS)):
            out[o] = unicodedata.normalize("NFKC", ch)
        elif ch in _HYPHENS:
            out[o] = "-"
    for o in (*range(0x09, 0x0E), *range(0x1C, 0x20)):
        out[o] = " "
    for like, latin in LOOKALIKES:
        out[ord(like)] = latin
    return out


_CONTROL_BLANK = re.compile(r"[\t-\r\x1c-\x1f]")
_LOOKS = {ord(a): b for a, b in LOOKALIKES}


def visual_form(s: str) -> str:
    """What a reader sees: two strings that look the same have the same form."""
    if s.isascii():
        return _CONTROL_BLANK.sub(" ", s)
    # Compose first, so that a letter with a combining accent is one letter, then once more after the letters are mapped.
    s = unicodedata.normalize("NFC", s).translate(_visual_map())
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(_LOOKS)) if not s.isascii() else s


_CYRILLIC = {ord(a): b for a, b in LOOKALIKES if "Ѐ" <= a <= "ԯ"} | {ord(a): b for a, b in zip("вкмнт", "bkmht")}
_BACK = {ord(b): a for a, b in zip("аеорсухівкмнт", "aeopcyxibkmht")}
_GREEK = {ord(a): b for a, b in LOOKALIKES if not "Ѐ" <= a <= "ԯ"}
_WORD = re.compile(r"\w*[Ѐ-ԯ]\w*")


@lru_cache(200_000)
def _one_script(word: str) -> str:
    strict = any("Ѐ" <= ch <= "ԯ" and ord(ch) not in _CYRILLIC for ch in word)
    return word.translate(_BACK if strict else _CYRILLIC)


def canonical_form(s: str) -> str:
    """Compatibility composition, full case folding, mapped blanks, no ignorables, one script per word."""
    if s.isascii():
        return _CONTROL_BLANK.sub(" ", s).lower()
    s = unicodedata.normalize("NFKC", s)
    s = unicodedata.normalize("NFKC", s.translate(_canonical_map()).casefold())
    return _WORD.sub(lambda m: _one_script(m.group()), s)


@lru_cache(1)
def _canonical_map() -> dict[int, str | None]:
    cyrillic = {ord(a) for a, _ in LOOKALIKES if "Ѐ" <= a <= "ԯ"}
    return {o: v for o, v in _visual_map().items() if o not in cyrillic} | _GREEK


def per_distinct(values: pd.Series, fn: Callable[[str], str]) -> pd.Series:
    """``fn`` of each value, computed once per distinct value."""
    codes, uniques = pd.factorize(values)
    done = [fn(u) for u in uniques]
    return pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)


def canonical(column: Column | str) -> Column:
    def form(values: pd.Series) -> pd.Series:
        return per_distinct(values, canonical_form)

    return F.pandas_udf(form, "string")(column)


def visual(column: Column | str) -> Column:
    def form(values: pd.Series) -> pd.Series:
        return per_distinct(values, visual_form)

    return F.pandas_udf(form, "string")(column)


def normalise(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Put the canonical form of a text column beside it (or in its place)."""
    return df.withColumn(out or column, canonical(F.col(column)))


def quotes(classification: DataFrame, items: DataFrame) -> DataFrame:
    """Entries of the lists of quotes with the text they should come from, where they aren't in it as they stand."""
    listed = F.from_json(F.col("snippets_json"), "array<string>")
    c = classification.select(F.col("id").alias("classification_id"), "feedback_item_id", listed.alias("snippets")).filter(F.size("snippets") > 0)
    f = items.select(F.col("id").alias("feedback_item_id"), F.col("text").alias("item_text")).filter(F.col("item_text").isNotNull())
    both = c.join(f, "feedback_item_id").select("classification_id", "item_text", F.posexplode("snippets").alias("pos", "snippet"))
    return both.filter(F.col("snippet").isNotNull() & ~F.contains("item_text", "snippet"))


def _looks_like_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Quotes whose form stands in the form of their text: composed and case-folded first, then as it is seen; per distinct value."""
    shown = lru_cache(2000)(visual_form)
    folded = lambda s: unicodedata.normalize("NFKC", shown(s)).casefold()
    for b in batches:
        text, quote = b["item_text"], b["snippet"]
        near = [bool(q) and q in t for q, t in zip(per_distinct(quote, folded), per_distinct(text, folded))]
        b, text, quote = b[near], text[near].reset_index(drop=True), quote[near].reset_index(drop=True)
        keep = [bool(q) and q in t for q, t in zip(per_distinct(quote, shown), per_distinct(text, shown))]
        yield b.loc[keep, ["classification_id", "pos"]].rename(columns={"pos": "snippet_no"}).astype({"snippet_no": "int64"})


#: What can look otherwise than it is written: anything but printable ASCII.
_ODD = r"[^\x20-\x7e]"


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that look like a stretch of their item's text but differ in characters."""
    q = quotes(table(spark, sf_dir, "classification"), table(spark, sf_dir, "feedback_item"))
    q = q.filter(F.col("snippet").rlike(_ODD) | F.col("item_text").rlike(_ODD))
    return q.mapInPandas(_looks_like_part, "classification_id string, snippet_no bigint").distinct()


def p4_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quote in canonical form; lists that aren't JSON lists have none."""
    c = table(spark, sf_dir, "classification").select(F.col("id").alias("classification_id"), F.posexplode(F.from_json("snippets_json", "array<string>")).alias("snippet_no", "snippet"))
    return c.filter("snippet is not null").select("classification_id", F.col("snippet_no").cast("bigint").alias("snippet_no"), canonical(F.col("snippet")).alias("form"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feedback item's text in canonical form, and whether that changed it."""
    f = table(spark, sf_dir, "feedback_item").select("id", "text")
    form: Column = canonical(F.col("text"))
    return f.withColumn("form", form).select("id", "form", (F.col("form") != F.lower("text")).alias("changed"))


QUERIES = {"p4_found": p4_found, "p4_snippets": p4_snippets, "p4_forms": p4_forms}
