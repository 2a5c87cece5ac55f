"""Mixed timestamp notations brought to one UTC instant.

Every value is matched against the known notations, in Arrow batches, and gives one candidate instant per valid
reading: both orders of a date in numbers (one against its locale is a format of its own), every unit a bare number may
count.  A mixture of formats per source, fitted by expectation-maximisation over the counts of candidate sets, decides by
posterior.  Only those counts (bounded by sources x combinations of readings) are shuffled, no rows.

Cases: null, blank, relative ("yesterday") and impossible values (31 February) give null micros; a clock that occurs
twice is the first, one that is skipped is read with the offset before the change; repeated rows are kept; an empty
table gives an empty result; extra columns are passed on, and the working columns carry a prefix of their own.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import table, written

_P = "__ts_"

#: Month names by number; fixed values. A name is also known by its first three letters where that is unique below.
MONTHS = {
    1: "january januar janvier enero janeiro gennaio januari января январь jan ene janv gen янв",
    2: "february februar février fevrier febrero fevereiro febbraio februari февраля февраль feb fév févr fev фев",
    3: "march märz maerz mars marzo março marco maart марта март mar mär mrt мар",
    4: "april avril abril aprile апреля апрель apr avr abr апр",
    5: "may mai mayo maio maggio mei мая май mag",
    6: "june juni juin junio junho giugno июня июнь jun giu июн",
    7: "july juli juillet julio julho luglio июля июль jul juil lug июл",
    8: "august août aout agosto augustus августа август aug ago авг",
    9: "september septembre septiembre setembro settembre сентября сентябрь sep sept set сен сент",
    10: "october oktober octobre octubre outubro ottobre октября октябрь oct okt out ott окт",
    11: "november novembre noviembre novembro ноября ноябрь nov ноя нояб",
    12: "december dezember décembre decembre diciembre dezembro dicembre декабря декабрь dec dez déc dic дек",
}
#: Offsets of zone abbreviations in minutes; fixed values.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "msk": 180, "ist": 330, "jst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720,
    "nzdt": 780, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420,
    "mdt": -360, "pst": -480, "pdt": -420, "brt": -180, "nst": -210, "ndt": -150, "akst": -540, "akdt": -480,
    "hst": -600, "mez": 60, "mesz": 120, "hkt": 480, "sgt": 480, "kst": 540,
}

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<frac>\d{1,9}))?)?"
_OFF = r"(?P<off>z|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5})"
_HALF = r"(?: ?(?P<half>[ap])\.?m\.?)?"
_JOIN = r"(?:,? (?:at|um|à|a las|alle|às|om|в)|,)? "
_DAY = r"(?P<d>\d{1,2})"
#: The notations: family and pattern, of which the first that matches counts.
_FAMILIES = [(name, re.compile(pattern, re.ASCII if name in ("ymd", "compact", "numeric", "pair", "count") else 0)) for name, pattern in (
    ("ymd", rf"(?P<y>\d{{4}})[-/.](?P<mo>\d{{1,2}})[-/.]{_DAY}(?:(?:t|,? ){_CLOCK}{_HALF}(?: ?{_OFF})?(?:\[(?P<zone>[a-z0-9_+/-]+)\]| (?P<zone2>[a-z]+/[a-z0-9_+/-]+))?)?"),
    ("compact", rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})t(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<frac>\d{{1,9}}))?)?{_OFF}?"),
    ("count", r"(?P<y>-?\d{1,19})(?:\.(?P<frac>\d{1,9}))?"),
    ("pair", r"\[ ?(?P<y>\d{1,11}) ?, ?(?P<mo>\d{1,9}) ?\]"),
    ("numeric", rf"(?P<mo>\d{{1,2}})[-/.]{_DAY}[-/.](?P<y>\d{{4}})(?:,? {_CLOCK}{_HALF}(?: ?{_OFF})?)?"),
    ("worded", rf"(?:[^\W\d_]+\.?,? )?{_DAY}(?:\.|st|nd|rd|th)? (?:de )?(?P<mo>[^\W\d_]+)\.?,? (?:de )?(?P<y>\d{{4}})(?: г\.?)?(?:{_JOIN}{_CLOCK}{_HALF}(?: uhr)?(?: {_OFF})?)?"),
    ("worded_us", rf"(?:[^\W\d_]+\.?,? )?(?P<mo>[^\W\d_]+)\.? {_DAY}(?:st|nd|rd|th)?,? (?P<y>\d{{4}})(?:{_JOIN}{_CLOCK}{_HALF}(?: {_OFF})?)?"),
    ("cjk", rf"(?P<y>\d{{4}})年(?P<mo>\d{{1,2}})月{_DAY}日(?: ?{_CLOCK})?"),
)]
_NAMES = {name: n for n, all_ in MONTHS.items() for name in all_.split()}
_ZONES = {z.lower(): z for z in available_timezones() if "/" in z or z == "UTC"}
#: Instants a plain count may stand for: 1990 to 2100.
_EARLIEST, _LATEST = 631_152_000_000_000, 4_102_444_800_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@lru_cache(1000)
def _zone(name: str) -> ZoneInfo:
    return ZoneInfo(name)


def _instant(p: dict, month: int, day: int, own: str | None) -> int | None:
    """Micros since 1970 in UTC; None where the fields name no calendar date, clock or zone."""
    hour, half = int(p.get("h") or 0), p.get("half")
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half == "p")
    off, named = (p.get("off") or "").removeprefix("utc").removeprefix("gmt") or ("z" if p.get("off") else ""), p.get("zone") or p.get("zone2")
    try:
        local = datetime(int(p["y"]), month, day, hour, int(p.get("mi") or 0), int(p.get("s") or 0), int(((p.get("frac") or "") + "000000")[:6]))
    except ValueError:
        return None
    if off:
        if off[0] in "+-":
            digits = off[1:].replace(":", "")
            hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
            shift = (hours * 60 + minutes) * (-1 if off[0] == "-" else 1)
        elif (shift := ABBREVIATIONS.get(off)) is None:
            return None
        return (local.replace(tzinfo=timezone.utc) - _EPOCH) // _MICRO - shift * 60_000_000
    if named:
        if (own := _ZONES.get(named)) is None:
            return None
    # fold=0: the first of a repeated clock, and the offset before the change for one that is skipped.
    return (local.replace(tzinfo=_zone(own)) - _EPOCH) // _MICRO if own else (local.replace(tzinfo=timezone.utc) - _EPOCH) // _MICRO


_MICRO = timedelta(microseconds=1)


def read_timestamp(value: str | None, own: str | None = None, order: str | None = None) -> list[tuple[str, int]]:
    """All valid readings of a value, as (format, micros); ``own`` and ``order`` are the zone and date order of its locale."""
    if not value or not (v := " ".join(value.split()).lower().replace("\u2212", "-")):
        return []
    for family, pattern in _FAMILIES:
        if m := pattern.fullmatch(v):
            break
    else:
        return []
    p = m.groupdict()
    out: list[tuple[str, int | None]]
    if family == "count":
        n, part = int(p["y"]), int(((p["frac"] or "") + "000000")[:6])
        units = (("seconds", n * 1_000_000 + part), ("millis", n * 1000), ("micros", n), ("nanos", n // 1000))
        out = [(f, x) for f, x in units if _EARLIEST <= x <= _LATEST]
    elif family == "pair":
        out = [("pair", int(p["y"]) * 1_000_000 + int(p["mo"]) // 1000)]
    elif family == "numeric":
        a, b = int(p["mo"]), int(p["d"])
        # Both readings are candidates; what a locale says of the order is evidence, and a reading against it another format.
        said = "dmy" if order == "ymd" else order
        against = lambda name: name if said in (None, name) else f"{name}!"
        out = [(against("mdy"), _instant(p, a, b, own)), (against("dmy"), _instant(p, b, a, own))]
        if said and not any(x is not None for f, x in out if not f.endswith("!")):
            out = []  # a value that its locale's order can't read names no date
    else:
        month = _NAMES.get(p["mo"]) if family.startswith("worded") else int(p["mo"])
        out = [("calendar", _instant(p, month, int(p["d"]), own))] if month else []
    return [(f, x) for f, x in out if x is not None]


def candidates(df: DataFrame, zones: DataFrame, value: str, locale: str) -> DataFrame:
    """Add ``__ts_cands``: the valid readings of a value, an array of (format, micros).

    ``zones`` (locale, zone_id, date_order) is a dimension of one row per locale: some hundred rows however large the
    corpus, so it goes along with the function after a check of its size.

    Written as native expressions, the same rules ran some 250 microseconds a row (about a hundred nested conditions
    are beyond code generation); one Arrow-batched function takes about ten.
    """
    known = zones.limit(2001).collect()
    if len(known) > 2000:
        raise ValueError("the table of locales is expected to have at most 2,000 rows")
    key = lambda x: x.replace("_", "-").strip().lower()
    own = {key(r["locale"]): (_ZONES.get((r["zone_id"] or "").lower()), r["date_order"]) for r in known if r["locale"]}

    def read(values: pd.Series, locales: pd.Series) -> pd.Series:
        return pd.Series([[{"format": f, "micros": x} for f, x in read_timestamp(v, *(own.get(key(at), (None, None)) if at else (None, None)))] for v, at in zip(values, locales)], dtype=object)

    # Not to be moved or repeated by the optimiser: a filter pushed through it would run it twice.
    udf = F.pandas_udf(read, "array<struct<format:string,micros:bigint>>").asNondeterministic()
    return df.withColumn(_P + "cands", udf(F.col(value), F.col(locale)))


#: Prior counts of a format, and of one that a value's locale speaks against.
PRIOR, AGAINST = 0.5, 0.005


def mixture(rows: list[tuple[tuple[str, ...], int]], rounds: int = 50) -> dict[tuple[str, ...], tuple[str, float]]:
    """Weights of formats by EM over (candidate set, count); the format of each set of highest posterior, and that posterior.

    A set adds likelihood to each format that reads it; sets with one reading anchor the weights.
    """
    formats = sorted({f for fs, _ in rows for f in fs})
    prior = {f: AGAINST if f.endswith("!") else PRIOR for f in formats}
    weight = {f: prior[f] / sum(prior.values()) for f in formats}
    for _ in range(rounds):
        expected = dict(prior)
        for fs, n in rows:
            z = sum(weight[f] for f in fs)
            for f in fs:
                expected[f] += n * weight[f] / z
        total = sum(expected.values())
        weight = {f: x / total for f, x in expected.items()}
    out = {}
    for fs, _ in rows:
        best = max(fs, key=lambda f: (weight[f], f))
        out[fs] = (best, weight[best] / sum(weight[f] for f in fs))
    return out


def fit_formats(df: DataFrame, source: str) -> DataFrame:
    """(s, f, best, sure): the chosen format and its posterior of each candidate set of several readings, by source.

    All rows count, whatever their number: they are counted by set in each partition first.  The mixture of a source is
    fitted where its counts are, at most one row for each combination of readings; a source missing is one of its own.
    """
    sets = F.transform(F.col(_P + "cands"), lambda c: c["format"])
    counts = df.filter(F.size(_P + "cands") > 0).groupBy(F.coalesce(source, F.lit("\x00")).alias("s"), F.array_join(sets, ",").alias("f")).agg(F.count("*").alias("n"))

    def fit(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        chosen = mixture([(tuple(f.split(",")), int(n)) for f, n in zip(x["f"], x["n"])])
        rows = [(key[0], ",".join(fs), best, sure) for fs, (best, sure) in chosen.items() if len(fs) > 1]
        return pd.DataFrame(rows, columns=["s", "f", "best", "sure"])

    return counts.groupBy("s").applyInPandas(fit, "s string, f string, best string, sure double")


#: Fitted sets up to which they go along with the rows; beyond, rows and sets are joined in salted parts.
SENT, SALTS = 20_000, 32


def normalise_timestamps(df: DataFrame, zones: DataFrame, value: str = "authored_at", locale: str = "locale", source: str = "source", certain: float = 0.8) -> DataFrame:
    """Add ``utc_micros``, ``ts_format``, ``ts_confidence`` and ``ts_ambiguous`` (the posterior is under ``certain``)."""
    base = candidates(df, zones, value, locale)
    fitted = written(fit_formats(base, source), "formats")
    cands, several = F.col(_P + "cands"), F.size(_P + "cands") > 1
    out = base.withColumns({_P + "s": F.coalesce(source, F.lit("\x00")), _P + "f": F.array_join(F.transform(cands, lambda c: c["format"]), ",")})
    chosen = fitted.select(F.col("s").alias(_P + "s"), F.col("f").alias(_P + "f"), F.col("best").alias(_P + "best"), F.col("sure").alias(_P + "sure"))
    keys = [_P + "s", _P + "f"]
    if fitted.limit(SENT + 1).count() <= SENT:
        out = out.join(F.broadcast(chosen), keys, "left")
    else:  # a set may hold a third of all rows
        salt = F.pmod(F.xxhash64(value, locale), F.lit(SALTS)).cast("int")
        chosen = chosen.withColumn(_P + "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn(_P + "salt", salt).join(chosen, [*keys, _P + "salt"], "left")
    first = F.get(cands, F.lit(0))
    picked = F.when(several, F.coalesce(F.get(F.filter(cands, lambda c: c["format"] == F.col(_P + "best")), F.lit(0)), first)).otherwise(first)
    same = F.size(F.array_distinct(F.transform(cands, lambda c: c["micros"]))) <= 1
    out = out.withColumn(_P + "chosen", picked)
    micros = F.col(_P + "chosen")["micros"]
    confidence = F.when(~several | same, F.lit(1.0)).otherwise(F.coalesce(_P + "sure", F.lit(1.0)))
    out = out.withColumns({"ts_confidence": F.when(micros.isNotNull(), confidence), "utc_micros": micros, "ts_format": F.regexp_replace(F.col(_P + "chosen")["format"], "!$", "")})
    out = out.withColumn("ts_ambiguous", F.coalesce(F.col("ts_confidence") < certain, F.lit(False)))
    return out.drop(*[c for c in out.columns if c.startswith(_P)])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    take = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("record_id"), "source", "authored_at", "locale")
    both = take("collected_item", "raw_record_id").unionByName(take("feedback_item", "id"))
    out = normalise_timestamps(both, table(spark, sf_dir, "locale_zone"))
    return out.filter(F.col("utc_micros").isNotNull()).select("record_id", "utc_micros")


QUERIES = {"p5_found": p5_found}
