"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 8).

Words (pre-tokens) of the corpus are counted; the frequent ones are compiled, with their ids, into a minimal acyclic
transducer: an automaton with shared suffixes whose numbering of words points into one array of ids.  Its arrays lie
in the shared folder and are mapped into memory by the workers, which follow all distinct words of a batch through it
at once.  Words that aren't in it are merged exactly by rank.

Cases: null and empty texts give an empty list; strings of special tokens are ordinary text; texts are whole, words
may have any length (long ones are merged with a heap); lone surrogates are encoded as U+FFFD; repeated rows are kept; extra columns
are passed on.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import local_path, scratch_path, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words of the lexicon at most; the rest is merged, so the bound is one of memory and doesn't change the result.
LEXICON_WORDS = 60_000
#: The published pre-tokenisation pattern of the vocabulary; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of least rank is merged until none is left."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) <= 200:
        # Ranks of adjacent pairs; after a merge only the two beside it change.
        get, none = ranks.get, 1 << 60
        pair = [get(word[i : i + 2], none) for i in range(len(parts) - 1)]
        while pair and (least := min(pair)) != none:
            i = pair.index(least)  # of equals the first
            parts[i] += parts[i + 1]
            del parts[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    alive: list[bytes | None] = list(parts)
    n = len(parts)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if alive[i] is None or j >= n or alive[j] is None or alive[i] + alive[j] != pair:
            continue
        alive[i], alive[j] = pair, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := ranks.get(alive[a] + alive[after[a]])) is not None:
                heapq.heappush(heap, (r, a, alive[a] + alive[after[a]]))
    return [ranks[p] for p in alive if p is not None]


class Lexicon:
    """A minimal acyclic transducer from words to lists of ids, in flat arrays."""

    FILES = ("keys", "targets", "skips", "finals", "starts", "ids")

    def __init__(self, keys, targets, skips, finals, starts, ids) -> None:
        #: keys: state * 256 + byte of each edge, sorted; skips: words before those behind the edge, among its state's.
        self.keys, self.targets, self.skips, self.finals, self.starts, self.ids = keys, targets, skips, finals, starts, ids

    @classmethod
    def build(cls, outputs: dict[bytes, list[int]]) -> Lexicon:
        """Incremental construction from the sorted words; equal states are shared."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []  # final, edges, words behind

        def close(node: list) -> int:
            edges = tuple((b, t) for b, t in node[1])
            key = (node[0], edges)
            if key not in register:
                register[key] = len(states)
                states.append((node[0], edges, node[0] + sum(states[t][2] for _, t in edges)))
            return register[key]

        path: list[list] = [[False, []]]  # the open states along the last word
        last = b""
        words = sorted(w for w in outputs if w)
        for w in words:
            same = os.path.commonprefix([w, last])
            while len(path) - 1 > len(same):
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], close(node)))
            path += [[False, []] for _ in w[len(same) :]]
            path[-1][0] = True
            last = w
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        root = close(path[0])
        order = [root, *(s for s in range(len(states)) if s != root)]
        at = {s: k for k, s in enumerate(order)}
        keys, targets, skips = [], [], []
        for k, s in enumerate(order):
            final, edges, _ = states[s]
            seen = int(final)
            for b, t in edges:
                keys.append(k * 256 + b)
                targets.append(at[t])
                skips.append(seen)
                seen += states[t][2]
        lists = [outputs[w] for w in words]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]) if lists else np.zeros(1)
        ids = np.array([i for x in lists for i in x], np.int32)
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array([states[s][0] for s in order]), starts.astype(np.int64), ids)

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        for name in self.FILES:
            np.save(f"{folder}/{name}.npy", getattr(self, name))

    @classmethod
    def load(cls, folder: str) -> Lexicon:
        return cls(*[np.load(f"{folder}/{name}.npy", mmap_mode="r") for name in cls.FILES])

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the lexicon, -1 for those that aren't in it; all words take each step together."""
        if not words or not len(self.keys):
            return np.full(len(words), -1, np.int64)
        lengths = np.array([len(w) for w in words])
        joined, begin = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state, number, alive = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), lengths > 0
        step, live = 0, np.flatnonzero(alive)
        while len(live):
            wanted = state[live] * 256 + joined[begin[live] + step]
            edge = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[edge] == wanted
            alive[live[~hit]] = False
            live, edge = live[hit], edge[hit]
            state[live], number[live] = self.targets[edge], number[live] + self.skips[edge]
            step += 1
            live = live[lengths[live] > step]
        return np.where(alive & self.finals[state], number, -1)

    def output(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


_SPLIT = regex.compile(PATTERN)


def count_words(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n) over all texts; counted in each partition before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for t in b["text"]:
                if t:
                    c.update(_SPLIT.findall(t))
            c = Counter({w: n for w, n in c.items() if len(w) <= 40})
            yield pd.DataFrame({"word": list(c), "n": list(c.values())}).astype({"n": "int64"}) if c else pd.DataFrame({"word": pd.Series([], dtype=str), "n": pd.Series([], dtype="int64")})

    return texts.select(F.col(column).alias("text")).mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(texts: DataFrame, column: str = "text", vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of the corpus; the folder of the lexicon, reachable from all executors."""
    spark = texts.sparkSession
    rows = count_words(texts, column).filter("n > 1").orderBy(F.desc("n"), "word").limit(words).collect()  # at most `words` rows
    ranks = load_ranks(vocabulary)
    utf8 = [r["word"].encode("utf-8", "replace") for r in rows]
    lexicon = Lexicon.build({w: merge_word(w, ranks) for w in utf8})
    target = scratch_path(spark, "lexicon")
    if "://" not in target or target.startswith("file:"):
        lexicon.save(local_path(target))
        return local_path(target)
    import tempfile

    folder = tempfile.mkdtemp(prefix="lexicon-")  # on the driver only; Spark ships the files to each executor
    lexicon.save(folder)
    spark.sparkContext.addFile(folder, recursive=True)
    return f"sparkfiles:{os.path.basename(folder)}"


@lru_cache(2)
def _lexicon(folder: str) -> Lexicon:
    return Lexicon.load(SparkFiles.get(folder.partition(":")[2]) if folder.startswith("sparkfiles:") else folder)


def encode_batch(texts, lexicon: Lexicon, ranks: dict[bytes, int], known: dict[str, list[int]]) -> list[list[int]]:
    """Ids of each text; ``known`` keeps the ids of words between batches and is emptied when it gets large."""
    split = [_SPLIT.findall(t) if t else [] for t in texts]
    new = list({w for ws in split for w in ws if w not in known})
    utf8 = [w.encode("utf-8", "replace") for w in new]
    for w, u, number in zip(new, utf8, lexicon.find(utf8)):
        known[w] = lexicon.output(number) if number >= 0 else merge_word(u, ranks)
    out = [[i for w in ws for i in known[w]] for ws in split]
    if len(known) > 300_000:
        known.clear()
    return out


def encode_texts(df: DataFrame, column: str = "text", out: str = "ids", vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS) -> DataFrame:
    folder = compile_lexicon(df, column, vocabulary, words)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, ranks, known = _lexicon(folder), load_ranks(vocabulary), {}
        for b in batches:
            yield pd.Series(encode_batch(b, lexicon, ranks, known), dtype=object)

    def udf_of(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(series)

    udf_of.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(udf_of, "array<int>").asNondeterministic()(F.col(column)))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


QUERIES = {"p8_ids": p8_ids}
