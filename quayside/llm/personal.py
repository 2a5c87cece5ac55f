"""Personal information in free text found, and replaced by typed placeholders (problem 2).

Candidates (mail addresses, numbers, postal addresses, pairs of capitalised words) are judged by what they disclose.
Over the whole corpus the co-occurrence of terms with seeds is counted: a seed is a candidate in an unmistakable
context ("my name is ...", "passport ...", "call ...").  A term is the given name of a pair of words, or the shape of a
number (digits and letters masked).  Its disclosure is the pointwise mutual information of the term and the protected
kind; terms above a threshold reveal their kind wherever they stand, and are replaced.  Mail and postal addresses
disclose by their form alone.

The revealing terms travel to the workers as a bit table of fixed size, so nothing that is sent grows with the corpus.

Cases: null and blank fields give nothing; fields are read whole; placeholders of earlier masking, handles, tickets,
versions, file names and names of things aren't pieces; of overlapping pieces the one that begins first stays, of
equals the longer; repeated rows are treated alike; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import table, written

KINDS = ("email", "phone", "id_number", "address", "person_name")
#: A term reveals a kind if this share of its occurrences, or of its distinct contexts, are seeds and it is a seed so
#: often; with PMI as below.
SHARE, SEEDS, BITS = 0.12, 2, 3.0
#: Letters before and after a term that make its context.
AROUND = 44
TABLE_BITS = 22

_AT = r"(?:@|\s?[\[({<]\s?(?:at|ät|arroba|arobase|chiocciola|a)\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punkt|punto|point|ponto)\s?[\])}>]\s?)"
_SAID = r"\s(?:at|ät|arroba|arobase|chiocciola)\s"
_SAID_DOT = r"(?:\s(?:dot|punkt|punto|point|ponto)\s)"
_LOCAL = r"(?<![\w.+@-])\w[\w.+'-]*"
EMAIL = re.compile(rf"{_LOCAL}{_AT}\w[\w-]*(?:{_DOT}\w[\w-]*)+|{_LOCAL}{_SAID}\w[\w-]*(?:(?:{_SAID_DOT}|{_DOT})\w[\w-]*)*{_SAID_DOT}\w+", re.I)
_MAYBE_MAIL = re.compile(r"@|[\[({<] ?(?:at|ät|a|arroba|arobase|chiocciola) ?[\])}>]| (?:dot|punkt|punto|point|ponto) ", re.I)

#: Numbers of at least six digits in groups; a letter or two may stand before or after.
NUMBER = re.compile(r"(?<![\w.,/#@+:-])(?:\+|\()?(?:[A-Z]{1,2} ?)?\d+(?:(?:[ ./-]|\) ?)\d+)*(?:(?<=\d) ?[A-Z](?=[^\w]|$))?(?![\w@]|[.,:]\d)")
_PHONE_CUE = re.compile(r"(?:\b(?:my|mobile|phone|cell|telephone) number is|\bcall(?: me)?(?: (?:at|on))?|\btext(?: me)?(?: at)?|\btel(?:efon|efono|éfono|ephone)?(?: es| ist| is)?|\bphone(?: is)?|\bwhatsapp|nummer ist|número es|número é|numéro est le|numero è|mobil(?:e|nummer)?|teléfono es|telefone é|nummer is|номер|телефон|電話(?:番号)?(?:は)?)[\s:.]{0,3}$", re.I)
_ID_CUE = re.compile(r"(?:passport(?: (?:no\.?|number))?|licen[cs]e \(?(?:no\.?|number)?|tax (?:number|id|no\.?)|\bmy ID, it is|\bID(?: number| no\.?)?(?: is)?|national (?:insurance )?(?:number|id)|social security(?: number)?|\bSSN|ausweis(?:nummer)?|steuer(?:nummer|-id)|identidad|identité|identità|identidade|\bDNI|\bNIF|\bCPF|\bBSN|pasaporte|passeport|passaporto|paspoort|rijbewijs|führerschein(?:nummer)?|permis|паспорт\w*|ИНН|パスポート(?:番号)?|免許(?:証)?)(?:[\s:.(]|is|ist|es|est|é|è|no\.|nr\.){0,12}$", re.I)
#: Forms of telephone numbers known beforehand; fixed values, in masked digits.
PHONE_FORMS = (r"\+9{1,3}(?:[ .-]\(?9{1,5}\)?){2,5}", r"\(9{3}\) ?9{3}[ .-]9{4}", r"9{3}[.-]9{3}[.-]9{4}", r"0{2}9{2}[ .-](?:\(?9{1,5}\)?[ .-]?){2,4}", r"09(?: 99){4}", r"0(?:99|999|9999)[ /-]9{4,8}", r"0(?:99|999) 9{3,4} 9{4}")
_PHONE_FORM = re.compile("|".join(PHONE_FORMS))
#: Shapes that are too common for things to be let in by few seeds: versions, dates, counts.
_THING = re.compile(r"9{1,2}\.9{1,3}\.9{1,6}(?: A)?|9{4}[-/.]9{2}[-/.]9{2}(?:[ A].*)?|9{2}[-/.]9{2}[-/.]9{4}(?: .*)?|9{1,3}(?:[ .]9{3})+|9+")

_NAME_WORD = r"[A-ZÀ-ÞĀ-Ž][a-zß-öø-ÿā-ž'’]+(?:[A-ZÀ-Þ][a-zß-öø-ÿ]+)?"
_PAIR = rf"({_NAME_WORD})(?:-{_NAME_WORD})? (?:[A-ZÀ-Þ]\. ?)?{_NAME_WORD}(?:-{_NAME_WORD})?"
NAME = re.compile(rf"(?<![\w\"“«@/.'’-])(?={_PAIR}(?![\w@]))")
NAME_AT = re.compile(_PAIR)
_CODE = re.compile(r"[ -][A-Z]?\d+(?![\w-])")
_TITLE = r"(?:Mrs?|Ms|Miss|Dr|Prof|Herrn?|Frau|Sra?|Srta|Señora?|Mme|M|Mlle|Sig(?:ra)?|Dhr|Mevr|Don|Doña)\.? "
_CUE = re.compile(
    rf"(?:\b(?:[Mm]y name is|I am called|[Mm]ein Name ist|[Ii]ch hei(?:ß|ss)e|[Mm]e llamo|[Mm]i nombre es|[Jj]e m['’]appelle|[Mm]on nom est|[Mm]i chiamo|[Ii]l mio nome è|[Mm]ijn naam is|[Ii]k heet|[Mm]e chamo|[Mm]eu nome é|[Mm]eu nome completo é|[Aa]ccount holder|[Kk]ontoinhaber(?:in)?|[Tt]itular(?: de la cuenta)?|[Tt]itulaire)(?: (?={_TITLE}))?:?"
    rf"|(?:[Kk]ind regards|[Bb]est regards|[Rr]egards|[Ss]incerely|[Cc]heers|[Vv]iele Grüße|[Mm]it freundlichen Grüßen|[Ss]aludos|[Aa]tentamente|[Cc]ordialement|[Bb]ien à vous|[Cc]ordiali saluti|[Ss]aluti|[Mm]et vriendelijke groet|[Gg]roeten|[Aa]tenciosamente|[Aa]braços|[Сс] уважением),|меня зовут|\b{_TITLE[:-1]}|\bare visible to|(?<!\S)--) ?$"
)
#: The last words of the contexts above, for a first look.
_LAST = frozenset(
    "is called ist heiße heisse llamo es appelle est chiamo è heet chamo é holder kontoinhaber kontoinhaberin titular cuenta titulaire regards sincerely cheers grüße grüßen saludos atentamente"
    " cordialement vous saluti groet groeten atenciosamente abraços уважением зовут mr mrs ms miss dr prof herr herrn frau sr sra srta señor señora mme m mlle sig sigra dhr mevr don doña to --".split()
)


def _cued(text: str, at: int) -> bool:
    before = text[max(0, at - 18) : at].split()
    return bool(before) and before[-1].strip(".,:>").lower() in _LAST and bool(_CUE.search(text[max(0, at - 44) : at]))

_STREET = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Close|Avenue|Ave\.?|Drive|Dr\.?|Court|Ct\.?|Place|Pl\.?|Way|Terrace|Crescent|Square|Gardens|Grove|Hill|Row|Mews|Walk|Boulevard|Blvd\.?|Parade)"
_W = r"[A-ZÀ-ÞĀ-Ž][\w'’-]*"
_TOWN = rf",? (?:[A-Z]{{1,2}}-)?(?:\d{{4,6}}(?:-\d{{3,4}})? )?{_W}(?: {_W})?(?: \d{{4,6}})?"
ADDRESS = re.compile(
    rf"(?<![\w.,/#-])(?:"
    rf"(?:Flat|Apt\.?|Apartment|Unit|Suite|Wohnung|Appt\.?|Piso) \d+\w?,? \d+\w?,? (?:{_W} ){{1,3}}{_STREET}{_TOWN.replace(',? ', ', ', 1)}"
    rf"|\d+\w?,? (?:{_W} ){{1,3}}{_STREET}{_TOWN.replace(',? ', ', ', 1)}"
    rf"|\d+\w?,? (?:bis,? )?(?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|route)(?: (?:de|du|des|de la|de l['’]))? {_W}(?: {_W})?{_TOWN}"
    rf"|(?:Calle|Avenida|Av\.|Plaza|Paseo|Camino|Carrera|Via|Viale|Piazza|Corso|Rua|Travessa|Largo|Praça|Rue|Avenue)(?: (?:de|del|de la|di|da|do|dos|das))? {_W}(?: {_W})?,? (?:n\.?º? ?)?\d+\w?{_TOWN}"
    rf"|{_W}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|laan|straat|plein|gracht|kade) \d+\w?{_TOWN}"
    rf"|(?:P\.? ?O\.? ?Box|PO Box|Box|Postfach|Apartado(?: de correos)?|Casella postale|Postbus|Caixa postal|BP|Boîte postale) \d+{_TOWN}"
    rf")"
)
_MAYBE_ADDRESS = re.compile(r"(?:Flat|Apt|Apartment|Unit|Suite|Wohnung|Appt|Piso|Box|Postfach|Apartado|Casella|Postbus|Caixa|BP|Boîte|Calle|Avenida|Av\.|Plaza|Paseo|Camino|Carrera|Via|Viale|Piazza|Corso|Rua|Travessa|Largo|Praça|Rue)\b|straße|strasse|str\.|weg |gasse |platz |allee |laan |straat |\d (?:rue|avenue|boulevard|place|allée|chemin|quai|route) |(?:Street|St|Road|Rd|Lane|Ln|Close|Avenue|Ave|Drive|Court|Place|Way|Terrace|Crescent|Square|Gardens|Grove|Hill|Row|Mews|Walk|Boulevard|Parade)\b\.?, ")
_MASK = str.maketrans("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 10 + "A" * 26)


def shape(number: str) -> str:
    return number.translate(_MASK)


def _phone_form(number: str) -> bool:
    s = re.sub(r"[1-9]", "9", number)
    zeros = re.sub(r"(?<!^)0", "9", s) if not s.startswith("00") else "00" + s[2:].replace("0", "9")
    return bool(_PHONE_FORM.fullmatch(zeros if number[0] == "0" else s.replace("0", "9")))


def numbers(text: str) -> Iterator[tuple[int, str]]:
    """(start, number) of grouped numbers of seven digits and more (six, with letters) that don't have the shape of a thing."""
    for m in NUMBER.finditer(text):
        g = m.group()
        if len(g) >= 7 and sum(map(str.isdigit, g)) >= 7 - any(map(str.isalpha, g)) and not _THING.fullmatch(shape(g)):
            yield m.start(), g


def _observe(text: str, seen: Counter) -> None:
    """Count the terms of a text by (family, term, context, kind); the kind is that of a seed, or none.

    The context is a hash of the term and what stands around it, alike in copies of a text.
    """
    for m in NAME.finditer(text):
        at = m.start()
        cued = _cued(text, at) and not _CODE.match(text, NAME_AT.match(text, at).end())
        seen["person_name", m.group(1), _context(text, at, m.end(1)), "person_name" if cued else ""] += 1
    for at, g in numbers(text):
        before = text[max(0, at - AROUND) : at]
        kind = "id_number" if _ID_CUE.search(before) else "phone" if _phone_form(g) or _PHONE_CUE.search(before) else ""
        seen["number", shape(g), _context(text, at, at + len(g)), kind] += 1


def _context(text: str, start: int, end: int) -> int:
    return xxhash.xxh3_64_intdigest(text[max(0, start - AROUND) : end + AROUND]) - (1 << 63)


def _bucket(kind: str, term: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\x00{term}") >> (64 - TABLE_BITS)


def disclosure(df: DataFrame, fields: list[str]) -> np.ndarray:
    """Bits of the terms that reveal a kind, from the co-occurrence of all terms with seeds over all rows."""

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for f in fields:
                for t in b[f]:
                    if t:
                        _observe(t, seen)
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["family", "term", "context", "kind", "n"])

    kinds_ = ("person_name", "id_number", "phone")
    rows = df.select(*fields).mapInPandas(observe, "family string, term string, context bigint, kind string, n bigint")
    contexts = rows.groupBy("family", "term", "context").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds_])
    by = contexts.groupBy("family", "term").agg(
        F.sum("n").alias("seen"), F.count("*").alias("contexts"),
        *[F.sum(k).alias(k) for k in kinds_], *[F.count_if(F.col(k) > 0).alias(f"{k}_contexts") for k in kinds_],
    )
    by = written(by, "terms")  # read twice below: once for the base rates, once for the terms
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("seeds"), F.col(f"{k}_contexts").alias("seed_contexts")) for k in kinds_]))
    terms = by.filter((F.col("person_name") + F.col("id_number") + F.col("phone")) > 0).select("family", "term", "seen", "contexts", kinds.alias("x")).select("family", "term", "seen", "contexts", "x.*")
    totals = {r["family"]: r for r in by.groupBy("family").agg(F.sum("seen").alias("seen"), *[F.sum(k).alias(k) for k in ("person_name", "id_number", "phone")]).collect()}
    table_ = np.zeros(1 << TABLE_BITS, bool)
    if not totals:
        return table_
    # A term of a small corpus may itself hold most seeds; the rate of a kind is bounded so that bits stay comparable.
    rate = F.lit(None).cast("double")
    for fam, r in totals.items():
        for k in ("person_name", "id_number", "phone"):
            rate = F.when((F.col("family") == fam) & (F.col("kind") == k), min(0.01, max(1e-6, (r[k] or 0) / (r["seen"] or 1)))).otherwise(rate)
    # Of all occurrences or of the distinct contexts: copies of a text without a cue take nothing away.
    share = F.greatest(F.col("seeds") / F.col("seen"), F.col("seed_contexts") / F.col("contexts"))
    pmi = F.log2(share / rate)
    revealing = terms.filter((F.col("seeds") >= SEEDS) & (share >= SHARE) & (pmi >= BITS))

    def buckets(kinds: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([_bucket(k, t) for k, t in zip(kinds, terms)], dtype="int32")

    digest = F.pandas_udf(buckets, "int")
    # A harmless term is taken for a revealing one with the chance that its bucket is one of theirs.
    if (many := revealing.limit((1 << TABLE_BITS) // 64 + 1).count()) > (1 << TABLE_BITS) // 64:
        raise ValueError(f"more than {many - 1} revealing terms; raise TABLE_BITS")
    for r in revealing.select(digest("kind", "term").alias("k")).distinct().toLocalIterator():  # at most 2**TABLE_BITS numbers
        table_[r["k"]] = True
    return table_


def find_personal(text: str, reveals) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pieces of a text; ``reveals(kind, term)`` tells whether a term discloses its kind."""
    out: list[tuple[int, int, str]] = []
    if _MAYBE_MAIL.search(text):
        out += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if _MAYBE_ADDRESS.search(text):
        out += [(m.start(), m.end(), "address") for m in ADDRESS.finditer(text)]
    for at, g in numbers(text):
        s, before = shape(g), text[max(0, at - 44) : at]
        if _ID_CUE.search(before) or reveals("id_number", s):
            out.append((at, at + len(g), "id_number"))
        elif _phone_form(g) or _PHONE_CUE.search(before) or reveals("phone", s):
            out.append((at, at + len(g), "phone"))
    for m in NAME.finditer(text):
        at = m.start()
        if _cued(text, at) or reveals("person_name", m.group(1)):
            end = NAME_AT.match(text, at).end()
            # Where a number or a code follows at once, it is the name of a thing.
            if not _CODE.match(text, end):
                out.append((at, end, "person_name"))
    out.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for x in out:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def redact(text: str, pieces: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in pieces:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _revealer(table_: np.ndarray):
    known: dict[tuple[str, str], bool] = {}

    def reveals(kind: str, term: str) -> bool:
        if (hit := known.get((kind, term))) is None:
            if len(known) > 500_000:
                known.clear()
            hit = known[kind, term] = bool(table_[_bucket(kind, term)])
        return hit

    return reveals


def pieces_of(df: DataFrame, key: str, fields: list[str], bits: np.ndarray | None = None) -> DataFrame:
    """(key, field_name, kind, start_pos, end_pos) of every piece of personal information."""
    model = df.sparkSession.sparkContext.broadcast(np.packbits(disclosure(df, fields) if bits is None else bits))
    kind_of_key = dict(df.dtypes)[key]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reveals = _revealer(np.unpackbits(model.value))
        for b in batches:
            rows = [(k, f, kind, s, e) for f in fields for k, t in zip(b["k"], b[f]) if t for s, e, kind in find_personal(t, reveals)]
            yield pd.DataFrame(rows, columns=["k", "field_name", "kind", "start_pos", "end_pos"])

    out = df.select(F.col(key).alias("k"), *fields).mapInPandas(find, f"k {kind_of_key}, field_name string, kind string, start_pos bigint, end_pos bigint")
    return out.withColumnRenamed("k", key)


def redact_items(df: DataFrame, fields: list[str], flag: str = "redaction_flag", bits: np.ndarray | None = None) -> DataFrame:
    """The fields with typed placeholders in place, and a flag that tells whether any was needed."""
    model = df.sparkSession.sparkContext.broadcast(np.packbits(disclosure(df, fields) if bits is None else bits))

    def one(values: pd.Series) -> pd.Series:
        reveals = _revealer(np.unpackbits(model.value))
        return pd.Series([redact(t, p) if t and (p := find_personal(t, reveals)) else t for t in values], dtype=object)

    udf = F.pandas_udf(one, "string").asNondeterministic()
    done = df.withColumns({f"__clean_{f}": udf(F.col(f)) for f in fields})
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f"__clean_{f}").eqNullSafe(F.col(f))
    done = done.withColumn(flag, changed.cast("int"))
    return done.withColumns({f: F.col(f"__clean_{f}") for f in fields}).drop(*[f"__clean_{f}" for f in fields])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "collected_item").select("raw_record_id", "text", "thread_context")
    return pieces_of(items, "raw_record_id", ["text", "thread_context"]).select("raw_record_id", "field_name", "kind", "start_pos").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback items with placeholders in place, and a true redaction flag."""
    items = table(spark, sf_dir, "feedback_item").select("id", "text", "thread_context", "redaction_flag")
    return redact_items(items, ["text", "thread_context"])


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw records with placeholders in place, and whether any was needed; the flag of their items follows from it."""
    records = table(spark, sf_dir, "collected_item").select("raw_record_id", "text", "thread_context")
    return redact_items(records, ["text", "thread_context"])


QUERIES = {"p2_found": p2_found, "p2_records": p2_records, "p2_redacted": p2_redacted}
