"""Reading level of documents by unigram language models of each level (problem 10).

A smoothed unigram model per level is fitted to labelled documents.  Words that are only names, addresses, codes or
noise are left out: what is quoted, holds a digit, stands in a row of capitals, belongs to an address of the web, or
is longer than any dictionary word.  A document gets the level of highest posterior; how much of it the models know
tells prose in their language from the rest, and the language is judged by the kernel classifier of this package.

Cases: null, blank and very short texts get no level; case and missing full stops don't matter, as words alone count;
whole texts are scored; a word counts as often as it stands there; repeated rows are treated alike; without labelled
rows no level is given; extra columns are passed on.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.language import LANGUAGES, clean, language_model, named_language, score, sentences
from quayside.session import table

BANDS = ("easy", "middle", "demanding")
#: Bound of the labelled sample, by hash of the id; words of the vocabulary at most; smoothing; least known share.
#: Then the labelled sample that languages are fitted to, in all and of each language: whole documents are told apart by
#: fewer texts than single sentences.
LANGUAGE_SAMPLE = 1500, 200
SAMPLE, VOCABULARY, ALPHA, KNOWN, LEAST_WORDS = 6000, 60_000, 0.5, 0.4, 12

_NOISE = re.compile(
    r"https?://\S+|www\.\S+|\S+@\S+|\"[^\"\n]{1,120}\"|“[^”\n]{1,120}”|`[^`\n]{1,200}`"
    r"|\b[A-ZÀ-Þ][\w’'-]*(?:[ -]+(?:[A-ZÀ-Þ][\w’'-]*|\d[\w.,]*))+|\S*\d\S*|\S*[_/\\{}<>=#|~^]\S*"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def words(text: str) -> list[str]:
    """The words that have a level."""
    kept = text if text.isupper() else _NOISE.sub(" ", text)
    return [w for w in _WORD.findall(kept.lower()) if len(w) <= 24]


def fit_levels(rows: list[tuple[str, str]], vocabulary: int = VOCABULARY, alpha: float = ALPHA) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(word -> row, log-likelihoods by row and level, log priors) of labelled texts; the last row is of unknown words."""
    counts = [Counter() for _ in BANDS]
    documents = np.zeros(len(BANDS))
    for text, band in rows:
        if text and band in BANDS:
            counts[BANDS.index(band)].update(words(text))
            documents[BANDS.index(band)] += 1
    every = Counter()
    for c in counts:
        every.update(c)
    index = {w: i for i, (w, _) in enumerate(sorted(every.items(), key=lambda x: (-x[1], x[0]))[:vocabulary])}
    like = np.zeros((len(index) + 1, len(BANDS)))
    for k, c in enumerate(counts):
        total = sum(c.values()) + alpha * (len(index) + 1)
        like[:, k] = math.log(alpha / total)
        for w, n in c.items():
            if w in index:
                like[index[w], k] = math.log((n + alpha) / total)
    like[-1] = like[-1].max()  # a word that no level knows says nothing about the level
    return index, like, np.log((documents + 1) / (documents + 1).sum())


def levels(texts, index: dict[str, int], like: np.ndarray, prior: np.ndarray) -> tuple[list[str | None], list[float | None], list[float]]:
    """Level, its posterior, and the share of known words of each text."""
    out, sure, known = [], [], []
    for t in texts:
        w = words(t) if t else []
        ids = [index[x] for x in w if x in index]
        share = len(ids) / len(w) if w else 0.0
        known.append(share)
        if len(w) < LEAST_WORDS or not ids:
            out.append(None)
            sure.append(None)
            continue
        # Words of a document depend on one another: the likelihood is tempered to that of some 40 independent ones.
        total = like[ids].sum(0) * min(1.0, 40 / len(ids)) + prior
        p = np.exp(total - total.max())
        p /= p.sum()
        out.append(BANDS[int(p.argmax())])
        sure.append(float(p.max()))
    return out, sure, known


def english_share(texts, weights: np.ndarray) -> list[float]:
    """The share of each text's letters that stands in sentences judged English."""
    cut = [[clean(s) for s in sentences(t)] if t else [] for t in texts]
    index: dict[str, int] = {}
    for cs in cut:
        for c in cs:
            index.setdefault(c, len(index))
    best = score(list(index), weights).argmax(1) if index else np.zeros(0, int)
    en, out = LANGUAGES.index("en"), []
    for cs in cut:
        total = sum(map(len, cs))
        out.append(sum(len(c) for c in cs if best[index[c]] == en) / total if total else 0.0)
    return out


def grade(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Add ``level``, ``level_confidence``, ``known_share`` and ``english_share``."""
    order = F.xxhash64(F.lit(7), F.col(key))
    rows = labels.select(key, "band").join(df.select(key, F.col(text).alias("t")), key).orderBy(order, key).limit(sample).select("t", "band").collect()
    fitted = fit_levels([(r["t"], r["band"]) for r in rows])
    # At most VOCABULARY words, and a table of fixed size.
    model = df.sparkSession.sparkContext.broadcast((*fitted, language_model(df, text, named_language(F.col(lang)), *LANGUAGE_SAMPLE)))

    def run(texts: pd.Series) -> pd.DataFrame:
        index, like, prior, weights = model.value
        level, sure, known = levels(texts, index, like, prior)
        return pd.DataFrame({"level": level, "level_confidence": sure, "known_share": known, "english_share": english_share(texts, weights)})

    udf = F.pandas_udf(run, "level string, level_confidence double, known_share double, english_share double").asNondeterministic()
    made = df.withColumn("__level", udf(F.col(text)))
    return made.withColumns({c: F.col("__level")[c] for c in ("level", "level_confidence", "known_share", "english_share")}).drop("__level")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "reading_label"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("doc_id", F.when((F.col("english_share") >= 0.5) & (F.col("known_share") >= KNOWN), F.col("level")).alias("level"), "level_confidence")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).filter((F.col("level") == "demanding") & (F.col("english_share") >= 0.5) & (F.col("known_share") >= KNOWN)).select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels}
