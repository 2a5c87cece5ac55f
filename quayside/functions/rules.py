"""Rule sets: named patterns that become columns for Spark and expressions for SQL from one definition."""

from __future__ import annotations

import re
import re._parser as _parser
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _strings(items, most: int = 40) -> tuple[set[str] | None, set[str] | None]:
    """(all strings a parsed pattern stands for, strings of which any match holds one); None where there is no such set."""
    whole: set[str] | None = {""}
    run: set[str] = {""}
    needs: list[set[str]] = []
    for op, arg in items:
        name, exact, need = str(op), None, None
        if name == "LITERAL":
            exact = {chr(arg).lower()}
        elif name == "AT":
            continue
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            exact = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            exact, need = _strings(arg[3], most)
        elif name == "BRANCH":
            parts = [_strings(x, most) for x in arg[1]]
            exact = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
            wanted = [e if e is not None and "" not in e else n for e, n in parts]
            need = set().union(*wanted) if all(wanted) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most_, inner = arg
            e, n = _strings(inner, most)
            if (least, most_) == (0, 1):
                exact = e | {""} if e is not None else None
            elif least:
                need = e if e is not None and "" not in e else n
        if exact is not None and len(run) * len(exact) <= most:
            run = {x + y for x in run for y in exact}
            whole = run if whole is not None else None
            continue
        whole = None
        needs += [x for x in (run, exact, need) if x and "" not in x]
        run = {""}
    if "" not in run:
        needs.append(run)
    best = max(needs, key=lambda x: (min(map(len, x)) >= 3, min(map(len, x)), -len(x)), default=None)
    return whole, best


@lru_cache(None)
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which every match of a pattern holds at least one; empty where nothing is known.

    A string that holds another one of them is left out.
    """
    whole, need = _strings(_parser.parse(pattern, re.I))
    best = whole if whole is not None and "" not in whole else need
    if not best or min(map(len, best)) < 3:
        return ()
    return tuple(sorted(x for x in best if not any(y != x and y in x for y in best)))


#: The letters that equal an ASCII letter only where case is ignored.
_ALSO = str.maketrans("\u017f\u0131\u0130\u212a", "siik")


@lru_cache(64)
def _matchers(patterns: tuple[str, ...]) -> list:
    return [(needed(p), re.compile(p, re.I).search) for p in patterns]


class Hits:
    """Patterns sought in a text column, ignoring case, all in one Arrow pass over its distinct values.

    A pattern is registered when it is asked for, as a column; :meth:`attach` then adds what all of them have found.
    The strings that a match must hold are sought first, so a pattern is tried on few texts.  As nested native
    expressions the same rules took some 1.5 milliseconds a row; this takes about a tenth.  Null text has no hits.
    """

    def __init__(self, text: str = "text", out: str = "__hits") -> None:
        self.text, self.out = text, out
        self.patterns: list[str] = []
        self.groups: list[str] = []

    def __call__(self, pattern: str) -> Column:
        """Whether a pattern occurs."""
        if pattern not in self.patterns:
            self.patterns.append(pattern)
        return F.get(F.col(self.out)["hits"], F.lit(self.patterns.index(pattern)))

    def group(self, pattern: str) -> Column:
        """The first group of a pattern's first match; an empty text where there is none."""
        if pattern not in self.groups:
            self.groups.append(pattern)
        return F.get(F.col(self.out)["groups"], F.lit(self.groups.index(pattern)))

    def attach(self, df: DataFrame) -> DataFrame:
        wanted, grouped = tuple(self.patterns), tuple(self.groups)

        def one(t: str | None) -> tuple[list[bool], list[str]]:
            if not t:
                return [False] * len(wanted), [""] * len(grouped)
            low = t.lower() if t.isascii() else t.translate(_ALSO).lower()
            hits = [(not words or any(w in low for w in words)) and search(t) is not None for words, search in _matchers(wanted)]
            groups = [m.group(1) if (not words or any(w in low for w in words)) and (m := search(t)) else "" for words, search in _matchers(grouped)]
            return hits, groups

        def find(texts: pd.Series) -> pd.DataFrame:
            codes, distinct = pd.factorize(texts)
            done = [one(t) for t in distinct]
            none = one(None)
            rows = [done[c] if c >= 0 else none for c in codes]
            return pd.DataFrame({"hits": [h for h, _ in rows], "groups": [g for _, g in rows]})

        return df.withColumn(self.out, F.pandas_udf(find, "hits array<boolean>, groups array<string>").asNondeterministic()(F.col(self.text)))

    def add(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """The columns, made of hits, beside those of a frame."""
        return self.attach(df).withColumns(columns).drop(self.out)


def hit(text: Hits, pattern: str) -> Column:
    return text(pattern)


#: Bytes of files under which an input is told evenly to all cores first, as it may be one row group of one file.
SMALL_INPUT = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small input on all cores, for work that costs more than a shuffle of the rows; larger ones as they are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_INPUT else df


def sql_hit(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"coalesce(regexp_matches({text}, '(?i){quoted}'), false)"


@dataclass(frozen=True)
class RuleSet:
    """Ordered (name, pattern) pairs; a parameter of every operator that labels text."""

    rules: tuple[tuple[str, str], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.rules]

    def labels(self, text: Hits) -> Column:
        """Names of all rules that hit, in rule order."""
        return F.array_compact(F.array(*[F.when(text(p), F.lit(n)) for n, p in self.rules]))

    def sql_labels(self, text: str) -> str:
        parts = ", ".join(f"case when {sql_hit(text, p)} then '{n}' end" for n, p in self.rules)
        return f"list_filter([{parts}], lambda x: x is not null)"

    def sql_first(self, text: str, default: str | None = None) -> str:
        whens = " ".join(f"when {sql_hit(text, p)} then '{n}'" for n, p in self.rules)
        return f"case {whens} else {'null' if default is None else repr(default)} end"
