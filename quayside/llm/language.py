"""Languages of documents and of their segments, with a confidence (problem 7).

Strings are compared by a blended-spectrum kernel: the cosine of their sets of character n-grams of lengths 1 to 4.
Landmark sentences span a Nyström approximation of it, in which one-versus-rest kernel ridge regression is fitted to
sentences labelled, noisily, by the records themselves; labels that a first fit contradicts are dropped, unless most
copies of the sentence carry them, and the fit is repeated.  As the kernel is a scalar product of n-gram vectors, landmarks, whitening and regression
collapse into one matrix (n-gram buckets x languages), so a batch is scored by one sparse product of its distinct
sentences.

Cases: null, blank and symbol-only texts give no segments; invented names, quoted labels, addresses of the web, file
names and numbers are left out before scoring; a short or undecided segment takes the language of its document; text
in a language the model doesn't know gets the nearest one with a low confidence; whole texts are scored, whatever
their length; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.residue import is_residue, residue_model
from quayside.session import table

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pt", "ru")
BUCKETS = 1 << 15
#: The labelled sample, by hash among texts of so many characters: texts in all, so that untrue labels stand in it as often as
#: in the corpus, and texts of each language at least; sentences of each text; landmarks per language.  Only the fit is
#: bounded by these; every record is scored whole.
SAMPLE, SAMPLE_EACH, SAMPLE_CHARS, SAMPLE_SENTENCES, LANDMARKS = 8000, 400, (60, 4000), 6, 40
RIDGE, GRAMS = 0.1, (1, 2, 3, 4)
#: A sentence that the first fit contradicts keeps its label if so many copies carry one and this share of them agree.
COPIES, AGREE = 3, 0.6

#: Everyday sentences for the first fit; a parameter of :func:`fit`.
SEEDS = {
    "de": "Ich habe das nicht gesehen und weiß auch nicht, warum es so ist. Wir wollen, dass die App wieder besser wird. Danke im Voraus für eine Antwort. Das war früher einfacher, aber jetzt geht es leider gar nicht mehr. Bitte helft mir. Hat jemand eine Idee? Sehr schade, sonst bin ich zufrieden mit den Bildern. Nach dem Update sind alle Fotos verschwunden. Auf meinem Handy kann man nichts finden.",
    "en": "I have not seen this and do not know why it is so. We want the app to be good again. Thanks in advance for your answer. It used to be easier, but now it does not work at all. Please help me. Does anyone have an idea? Too bad, otherwise I am happy with the pictures. After the update all the photos were gone. On my phone you cannot find anything. Please fix this. Hope it helps. Still waiting. Love it anyway.",
    "es": "No lo he visto y tampoco sé por qué es así. Queremos que la aplicación vuelva a ser buena. Gracias de antemano por su respuesta. Antes era más fácil, pero ahora ya no funciona nada. Ayúdenme, por favor. ¿Alguien tiene una idea? Una lástima, por lo demás estoy contento con las imágenes. Después de la actualización desaparecieron todas las fotos. En mi teléfono no se puede encontrar nada.",
    "fr": "Je ne l'ai pas vu et je ne sais pas non plus pourquoi c'est ainsi. Nous voulons que l'application redevienne bonne. Merci d'avance pour votre réponse. C'était plus facile avant, mais maintenant cela ne marche plus du tout. Aidez-moi, s'il vous plaît. Quelqu'un a une idée ? Dommage, sinon je suis content des images. Après la mise à jour, toutes les photos ont disparu. Sur mon téléphone on ne trouve rien.",
    "it": "Non l'ho visto e non so nemmeno perché sia così. Vogliamo che l'applicazione torni a essere buona. Grazie in anticipo per la risposta. Prima era più facile, ma adesso non funziona più niente. Aiutatemi, per favore. Qualcuno ha un'idea? Peccato, per il resto sono contento delle immagini. Dopo l'aggiornamento sono sparite tutte le foto. Sul mio telefono non si trova nulla.",
    "ja": "見たことがなく、どうしてそうなのかも分かりません。アプリがまた良くなってほしいです。お返事をお待ちしています。前はもっと簡単でしたが、今はまったく動きません。助けてください。何か方法はありますか。残念ですが、それ以外の写真には満足しています。更新したら写真がすべて消えました。私の携帯では何も見つかりません。",
    "nl": "Ik heb het niet gezien en weet ook niet waarom het zo is. Wij willen dat de app weer goed wordt. Alvast bedankt voor het antwoord. Vroeger was het makkelijker, maar nu werkt het helemaal niet meer. Help me alsjeblieft. Heeft iemand een idee? Jammer, verder ben ik tevreden met de beelden. Na de update waren alle foto's verdwenen. Op mijn telefoon kan men niets vinden.",
    "pt": "Eu não vi isso e também não sei por que é assim. Queremos que o aplicativo volte a ser bom. Obrigado desde já pela resposta. Antes era mais fácil, mas agora não funciona mais nada. Ajudem-me, por favor. Alguém tem uma ideia? Que pena, fora isso estou contente com as imagens. Depois da atualização sumiram todas as fotos. No meu telefone não se encontra nada.",
    "ru": "Я этого не видел и тоже не знаю, почему это так. Мы хотим, чтобы приложение снова стало хорошим. Заранее спасибо за ответ. Раньше было проще, но теперь совсем ничего не работает. Помогите мне, пожалуйста. Есть идеи? Очень жаль, в остальном я доволен снимками. После обновления пропали все фотографии. На моём телефоне ничего не найти.",
}

_NOISE = re.compile(
    r"https?://\S+|\S+@\S+|\b\w+\.(?:jpe?g|png|pdf|txt|mp4|zip|gif|heic|mov)\b|\"[^\"\n]{1,120}\"|“[^”\n]{1,120}”|«[^»\n]{1,120}»"
    # names: capitalised words in a row, or one before a number or a code
    r"|(?:(?<![A-Za-zÀ-ɏ])[A-ZÀ-Þ][A-Za-zÀ-ɏ\d_’'-]*[ -]+)(?:(?:[A-ZÀ-Þ][A-Za-zÀ-ɏ\d_’'-]*|\d[A-Za-z\d_.,]*)(?:[ -]+|(?![A-Za-zÀ-ɏ\d_])))+"
    r"|(?<![A-Za-z])[A-Z][a-z]+(?:-\d+)?(?: [A-Z][a-z]+| [A-Z]?\d+)+|(?<![A-Za-z\d])[A-Za-z]*\d[A-Za-z\d.,]*|<[^<>\n]{1,60}>"
)
_OTHER = re.compile(r"[\W\d_]+")
_CAPITALS = re.compile(r"[^\W\d_]")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=[\"“¿¡«(\[]?[A-ZÀ-ÞЀ-Я\d぀-ヿ一-鿿])|(?<=[。！？])\s*|\s*\n\s*|<br\s*/?>|(?<=\w)\s*[\U0001F300-\U0001FAFF☀-➿]+\s+(?=[A-ZÀ-ÞЀ-Я¿¡])")
_KANA = re.compile(r"[぀-ヿ]")


def sentences(text: str) -> list[str]:
    return [s for s in _SPLIT.split(text) if s and _CAPITALS.search(s)]


def placed_sentences(text: str) -> list[tuple[int, str]]:
    """(start, sentence), as of :func:`sentences`."""
    out, at = [], 0
    for m in [*_SPLIT.finditer(text), None]:
        s = text[at : m.start() if m else None]
        if s and _CAPITALS.search(s):
            out.append((at, s))
        at = m.end() if m else at
    return out


def clean(sentence: str) -> str:
    """The words of a sentence that have a language, in lower case, parted and framed by blanks."""
    if sentence.isupper():
        return " " + " ".join(_OTHER.sub(" ", re.sub(r"\"[^\"]{1,120}\"|\S*\d\S*", " ", sentence)).lower().split()) + " "
    kept = _NOISE.sub(" ", sentence)
    return " " + " ".join(_OTHER.sub(" ", kept).lower().split()) + " "


def ngrams(cleaned: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(string, bucket) of the distinct n-grams of each string, sorted by string."""
    c = np.frombuffer(("\x00".join(cleaned) + "\x00").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sep = c == 0
    owner = np.cumsum(sep) - sep
    parts = []
    for n in GRAMS:
        if len(c) < n:
            continue
        h, crosses = np.full(len(c) - n + 1, n, np.uint64), np.zeros(len(c) - n + 1, bool)
        for i in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ c[i : len(c) - n + 1 + i]
            crosses |= sep[i : len(c) - n + 1 + i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        parts.append((owner[: len(h)][~crosses].astype(np.int64) << 15) | (h[~crosses] >> np.uint64(49)).astype(np.int64))
    both = np.concatenate(parts)
    both.sort()
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return both >> 15, both & (BUCKETS - 1)


def kernel_vectors(cleaned: list[str]) -> np.ndarray:
    """Dense, unit-length n-gram vectors; for the bounded sample only."""
    rows, cols = ngrams(cleaned)
    out = np.zeros((len(cleaned), BUCKETS), np.float32)
    out[rows, cols] = 1
    return out / np.sqrt(np.maximum(1, out.sum(1, keepdims=True)))


def _fit(cleaned: list[str], y: np.ndarray, landmarks: int, ridge: float, weight: np.ndarray | None = None) -> np.ndarray:
    rows, cols = ngrams(cleaned)
    starts = np.searchsorted(rows, np.arange(len(cleaned) + 1))
    size = np.sqrt(np.maximum(1, np.diff(starts)))
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(LANGUAGES))])
    marks = kernel_vectors([cleaned[i] for i in chosen])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-4 * value.max()
    white = vector[:, good] / np.sqrt(value[good])
    across = np.ascontiguousarray(marks.T)
    # k(x, landmarks) of the sample, as a sparse product in blocks.
    k = np.zeros((len(cleaned), len(chosen)), np.float32)
    for i in range(0, len(cleaned), 200):
        part = slice(starts[i], starts[min(i + 200, len(cleaned))])
        have = np.flatnonzero(np.diff(starts[i : i + 201]))
        if len(have):
            k[i + have] = np.add.reduceat(across[cols[part]], starts[i + have] - starts[i])
    z = (k / size[:, None]) @ white
    target = np.where(y[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
    weight = np.ones(len(y)) if weight is None else weight
    n = np.maximum(1, np.bincount(y, weights=weight, minlength=len(LANGUAGES)))
    w = weight / np.sqrt(n[y])  # between languages that weigh alike and examples that do
    w *= len(y) / w.sum()
    a = np.linalg.solve(z.T @ (z * w[:, None]) + ridge * np.eye(z.shape[1]), z.T @ (target * w[:, None]))
    return (across @ (white @ a)).astype(np.float32)


def fit(cleaned: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seeds: dict[str, str] = SEEDS) -> np.ndarray:
    """Weights (buckets x languages) of Nyström kernel ridge regression, one language against the rest."""
    first = [(clean(s), LANGUAGES.index(lang)) for lang, text in seeds.items() for s in re.split(r"(?<=[.?])\s+|(?<=。)", text) if s]
    seed, seed_y = [c for c, _ in first], np.array([k for _, k in first])
    weights = _fit(seed, seed_y, landmarks, ridge)
    if not cleaned:
        return weights
    # Copies of a sentence vote on its label and weigh little more than one; a clear vote stands against the first fit.
    votes: dict[str, Counter] = {}
    for c, x in zip(cleaned, labels):
        votes.setdefault(c, Counter())[LANGUAGES.index(x)] += 1
    distinct, top = list(votes), [v.most_common(1)[0] for v in votes.values()]
    y, most, n = np.array([k for k, _ in top]), np.array([m for _, m in top]), np.array([v.total() for v in votes.values()])
    keep = np.flatnonzero((score(distinct, weights).argmax(1) == y) | ((n >= COPIES) & (most >= AGREE * n)))
    return _fit([distinct[i] for i in keep] + seed, np.r_[y[keep], seed_y], landmarks, ridge, np.r_[1 + np.log2(n[keep]), np.ones(len(seed))])


def score(cleaned: list[str], weights: np.ndarray) -> np.ndarray:
    """Scores of each string for each language, about -1 to 1; strings without words get zeros."""
    out = np.zeros((len(cleaned), len(LANGUAGES)), np.float32)
    for begin in range(0, len(cleaned), 4000):
        part = cleaned[begin : begin + 4000]
        rows, cols = ngrams(part)
        if len(rows):
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sums = np.add.reduceat(weights[cols], starts)
            out[begin + rows[starts]] = sums / np.sqrt(np.diff(np.r_[starts, len(rows)]))[:, None]
    return out


def named_language(locale: Column) -> Column:
    """The language a locale names, null if it names none of the known ones."""
    part = F.lower(F.trim(F.regexp_extract(F.trim(locale), r"^([A-Za-z]+)(?:[-_].*)?$", 1)))
    return F.when(part.isin(*LANGUAGES), part)


def labelled_sentences(df: DataFrame, text: str, label: Column, sample: int = SAMPLE, each: int = SAMPLE_EACH) -> tuple[list[str], list[str]]:
    """Sentences of ``sample`` texts, and of ``each`` of each language at least, by hash; the only part that is bounded by parameters.

    Hashes are ranked first, so that texts needn't move; of copies with different labels the least label counts.
    """
    rows = df.select(F.col(text).alias("t"), label.alias("l"), F.xxhash64(F.col(text)).alias("o")).filter(F.col("l").isNotNull() & F.length("t").between(*SAMPLE_CHARS))
    distinct = rows.groupBy("o").agg(F.min("l").alias("l"))
    # A filter on the row number is pushed into the partial stage: no language is gathered in one task before the cut.
    least = distinct.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("o"))).filter(F.col("n") <= each).select("o", "l")
    chosen = least.union(distinct.select("o", "l").orderBy("o").limit(sample)).dropDuplicates(["o"])
    texts = rows.select("o", "t").join(F.broadcast(chosen), "o").groupBy("o").agg(F.min("t").alias("t"), F.min("l").alias("l"))
    cleaned, labels = [], []
    for r in texts.orderBy("l", "o").collect():  # bounded by the parameters
        for s in [c for c in map(clean, sentences(r["t"])) if len(c) >= 16][:SAMPLE_SENTENCES]:
            cleaned.append(s)
            labels.append(r["l"])
    return cleaned, labels


def language_model(df: DataFrame, text: str, label: Column, sample: int = SAMPLE, each: int = SAMPLE_EACH) -> np.ndarray:
    cleaned, labels = labelled_sentences(df, text, label, sample, each)
    return fit(cleaned, labels)


#: Margin between the best and the second score for a segment to count as decided, by its letters.
MARGIN, SHORT_MARGIN, SHORT, LEAST = 0.16, 0.30, 20, 10


def segments(texts: list[str | None], weights: np.ndarray) -> list[list[tuple[str, int, str, float]]]:
    """(sentence, start, language, confidence) of the segments of each text.

    Distinct cleaned sentences of the batch are scored once.
    """
    cut = [[(m, clean(m), at) for at, m in placed_sentences(t)] if t and t.strip() else [] for t in texts]
    index: dict[str, int] = {}
    for ss in cut:
        for _, c, _ in ss:
            index.setdefault(c, len(index))
    if not index:
        return [[] for _ in texts]
    scores = score(list(index), weights)
    # A plain softmax of the scores, sharpened so that a margin of 0.5 is near certainty.
    e = np.exp(8 * (scores - scores.max(1, keepdims=True)))
    chance = e / e.sum(1, keepdims=True)
    top2 = np.sort(scores, axis=1)[:, -2:]
    margin, best = top2[:, 1] - top2[:, 0], scores.argmax(1)
    out = []
    for ss in cut:
        if not ss:
            out.append([])
            continue
        ids = np.array([index[c] for _, c, _ in ss])
        letters = np.array([len(c) - c.count(" ") for _, c, _ in ss])
        decided = (margin[ids] >= np.where(letters < SHORT, SHORT_MARGIN, MARGIN)) & (letters >= LEAST)
        decided |= (margin[ids] >= 2 * SHORT_MARGIN) & (letters >= 4)
        total = (scores[ids] * np.minimum(letters, 60)[:, None])[decided if decided.any() else slice(None)].sum(0)
        whole = int(total.argmax())
        found = []
        for (s, _, at), i, ok in zip(ss, ids, decided):
            k = int(best[i]) if ok else whole
            found.append((s, at, LANGUAGES[k], float(chance[i, k])))
        out.append(found)
    return out


def tag_languages(df: DataFrame, key: str, text: str, weights: np.ndarray) -> DataFrame:
    """One row per record and language: (key, lang, confidence, segments, letters share); weights are of fixed size."""
    model = df.sparkSession.sparkContext.broadcast(weights)
    kind = dict(df.dtypes)[key]

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, found in zip(b["k"], segments(b["t"].tolist(), model.value)):
                total = sum(len(s) for s, *_ in found) or 1
                by: dict[str, list[tuple[int, float]]] = {}
                for s, _, lang, p in found:
                    by.setdefault(lang, []).append((len(s), p))
                for lang, parts in by.items():
                    n = sum(x for x, _ in parts)
                    rows.append((k, lang, sum(x * p for x, p in parts) / n, len(parts), n / total))
            yield pd.DataFrame(rows, columns=["k", "lang", "confidence", "segments", "share"])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(tag, f"k {kind}, lang string, confidence double, segments bigint, share double")
    return out.withColumnRenamed("k", key)


def tag_segments(df: DataFrame, key: str, text: str, weights: np.ndarray) -> DataFrame:
    """One row per segment: (key, start_pos, end_pos, lang, confidence); positions count characters from 0, the end is beyond."""
    model = df.sparkSession.sparkContext.broadcast(weights)
    kind = dict(df.dtypes)[key]

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, at, at + len(s), lang, p) for k, found in zip(b["k"], segments(b["t"].tolist(), model.value)) for s, at, lang, p in found]
            yield pd.DataFrame(rows, columns=["k", "start_pos", "end_pos", "lang", "confidence"])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(tag, f"k {kind}, start_pos bigint, end_pos bigint, lang string, confidence double")
    return out.withColumnRenamed("k", key)


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of all segments of all records, with their positions."""
    items = table(spark, sf_dir, "collected_item").select("raw_record_id", "text", "locale")
    return tag_segments(items, "raw_record_id", "text", language_model(items, "text", named_language(F.col("locale"))))


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all records, with confidence and share."""
    items = table(spark, sf_dir, "collected_item").select("raw_record_id", "text", "locale")
    return tag_languages(items, "raw_record_id", "text", language_model(items, "text", named_language(F.col("locale"))))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "collected_item").select("raw_record_id", "text", "locale")
    weights = language_model(items, "text", named_language(F.col("locale")))
    model = spark.sparkContext.broadcast((residue_model(items), weights))
    rows = items.filter(F.length("text") > 0).select("raw_record_id", "text", named_language(F.col("locale")).alias("named"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratio, w = model.value
        for b in batches:
            rows = []
            for k, t, named, found in zip(b["raw_record_id"], b["text"], b["named"], segments(b["text"].tolist(), w)):
                langs = {x[2] for x in found}
                if langs and langs != {named} and (len(t.split()) >= 8 or (_KANA.search(t) and len(t) >= 20)):
                    rows.append((k, t, sorted(langs)))
            out = pd.DataFrame(rows, columns=["raw_record_id", "text", "lang"])
            # Only what is to be listed need be told from residue.
            yield (out[~is_residue(out["text"], ratio)] if len(out) else out)[["raw_record_id", "lang"]].explode("lang")

    return rows.mapInPandas(find, "raw_record_id string, lang string").distinct()


QUERIES = {"p7_found": p7_found, "p7_documents": p7_documents, "p7_segments": p7_segments}
