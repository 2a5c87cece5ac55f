"""Oversized texts cut into pieces at natural boundaries (problem 3).

Every position of a text has a boundary strength.  Pieces are cut greedily: among the ends in the second half of a
piece's longest length (in the first half, where only that has a natural break) the strongest boundary is taken, of equals the rightmost, found by a sparse table for range maxima; the next piece starts
``overlap`` characters before that cut.  Dropping the first ``overlap`` characters of each following piece gives back
the text exactly.

Cases: null and blank texts and texts of at most ``limit`` characters give no pieces; a text without any break is cut
at the limit; a base character is not parted from its combining marks where that can be helped; the texts are whole,
whatever their length; repeated rows give repeated pieces; extra columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.session import table

LIMIT, OVERLAP = 4000, 200
#: The least strength of a natural break: between words.
NATURAL = 2

#: A cut is allowed at the end of each match; strength by kind.
_BREAKS = (
    (1, re.compile(r"[^\W_](?=[\W_])|[\W_](?=[^\W_])")),
    (2, re.compile(r"\s+(?=\S)")),
    (3, re.compile(r"[,;:、，；：)\]}»”]+\s*")),
    (5, re.compile(r"[.!?…]+[\"'”’)\]»]*(?=\s)\s+|[。！？]+[」』）]*\s*")),
    (6, re.compile(r"\r?\n[ \t]*|<br\s*/?>|(?<=[}\]]),\s*(?=[{\[])")),
    (7, re.compile(r"(?:\r?\n[ \t]*){2,}")),
    (8, re.compile(r"\r?\n-{3,}[ \t]*\r?\n")),
)


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len(text)."""
    out = np.zeros(len(text) + 1, np.int64)
    for strength, pattern in _BREAKS:
        out[np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)] = strength
    marks = np.fromiter((m.start() for m in re.finditer(r"[̀-ͯ‍️゙゚\U0001f3fb-\U0001f3ff]", text)), np.int64)
    out[marks] = -1
    return out


class RangeMax:
    """Sparse table over ``strength * n + position``: the maximum of a range, ties broken rightward.

    Of the table's levels only those asked for are kept; they are built by doubling, on demand.
    """

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.n, self.levels = n, {0: values * n + np.arange(n)}

    def level(self, k: int) -> np.ndarray:
        have = max(j for j in self.levels if j <= k)
        row = self.levels[have]
        for j in range(have, k):
            row = np.maximum(row[: -(1 << j)], row[1 << j :])
        self.levels = {0: self.levels[0]} | {j: r for j, r in self.levels.items() if j + 2 > k} | {k: row}
        return row

    def best(self, low: int, high: int) -> int:
        """The position of the strongest of ``low..high``, the rightmost of equals."""
        k = (high - low + 1).bit_length() - 1
        row = self.levels[k] if k in self.levels else self.level(k)
        return int(max(row[low], row[high - (1 << k) + 1]) % self.n)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, piece) of each piece; an empty list if the text is within the limit."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    n = len(text)
    if n <= limit:
        return []
    power = strengths(text)
    table_, start, out = RangeMax(power), 0, []
    while n - start > limit:
        cut = table_.best(start + limit // 2 + 1, start + limit)
        if power[cut] < NATURAL:  # no natural break in the second half: one in the first half is better
            early = table_.best(start + overlap + 1, start + limit // 2)
            cut = early if power[early] >= NATURAL else cut
        out.append((start, text[start:cut]))
        start = cut - overlap
    out.append((start, text[start:]))
    return out


_PIECE = ["item_key", "field_name", "piece_no", "start_pos", "piece"]


def split_items(df: DataFrame, key: str, fields: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the fields that are over the limit: (key, field_name, piece_no, start_pos, piece).

    The length is tested in the JVM, so only oversized texts reach Python.
    """
    long_ = F.array(*[F.when(F.length(f) > limit, F.struct(F.lit(f).alias("field_name"), F.col(f).alias("body"))) for f in fields])
    rows = df.select(F.col(key).alias("item_key"), F.explode(F.array_compact(long_)).alias("x")).select("item_key", "x.*")
    kind = dict(df.dtypes)[key]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for k, f, body in zip(b["item_key"], b["field_name"], b["body"]):
                rows += [(k, f, i, s, p) for i, (s, p) in enumerate(split_text(body, limit, overlap))]
                size += len(body)
                if size > 8_000_000:
                    yield pd.DataFrame(rows, columns=_PIECE)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=_PIECE)

    return rows.mapInPandas(pieces, f"item_key {kind}, field_name string, piece_no bigint, start_pos bigint, piece string").withColumnRenamed("item_key", key)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "collected_item"), "raw_record_id", ["text", "thread_context"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).filter(F.col("piece_no") == 0).select("raw_record_id", "field_name").distinct()


def p3_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each field add up to: its length, whether each piece starts where the one before says, and all are within the limit."""
    x = p3_pieces(spark, sf_dir).withColumn("n", F.length("piece"))
    after = Window.partitionBy("raw_record_id", "field_name").orderBy("piece_no")
    ahead, tail = F.lag("piece").over(after), F.lag("start_pos").over(after)
    follows = F.coalesce((F.substr("piece", F.lit(1), F.lit(OVERLAP)) == F.substr(ahead, F.length(ahead) - OVERLAP + 1)) & (F.col("start_pos") == tail + F.length(ahead) - OVERLAP), F.col("start_pos") == 0)
    g = x.withColumn("follows", follows).groupBy("raw_record_id", "field_name")
    return g.agg((F.sum("n") - OVERLAP * (F.count("*") - 1)).alias("chars"), F.bool_and("follows").alias("whole"), (F.max("n") <= LIMIT).alias("within"))


QUERIES = {"p3_found": p3_found, "p3_lengths": p3_lengths, "p3_pieces": p3_pieces}
ORACLES = {
    "p3_lengths": f"with x as (select raw_record_id, 'text' as field_name, text as t from collected_item union all select raw_record_id, 'thread_context', thread_context from collected_item) select raw_record_id, field_name, length(t) as chars, true as whole, true as within from x where length(t) > {LIMIT}",
    "p3_found": f"select distinct raw_record_id, 'text' as field_name from collected_item where length(text) > {LIMIT} union select distinct raw_record_id, 'thread_context' from collected_item where length(thread_context) > {LIMIT}",
}
