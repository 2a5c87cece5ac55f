"""Sources mixed to target shares of tokens (problem 9).

The total is the largest at which every source can give its share without using a document more than its cap allows.
Each source first gives whole copies of all its documents; what is missing then comes from a Pareto order sample:
documents, included with probability in proportion to their size, are ranked by random odds over inclusion odds, and
the ranking is cut where the missing tokens are reached.  The cut is found by refining histograms of the rank (1,024
bins a source and level), so neither a source nor its ranking is ever gathered in one task.

Cases: documents without source, of no listed source, or without tokens aren't used; sources are compared without
letter case, `-` and `_` being one; a source without documents gives nothing and doesn't bind the total; random
numbers depend on the id and a seed alone, so a recomputed task gives the same rows; repeated rows count as documents
of their own; tables without rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.encode import encode_texts
from quayside.session import cut, table

BINS, LEVELS, SEED = 1024, 4, 17


def _source(c: str):
    return F.lower(F.regexp_replace(F.trim(F.col(c)), "[-_ ]+", "_"))


def _rate(bins: list[tuple[float, int, float]], rest: float) -> float:
    """The factor t for which documents included with probability min(1, t * size) give ``rest`` tokens expected."""
    low, high = 0.0, 1 / min(size for size, _, _ in bins) if bins else 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(tokens * min(1.0, mid * size) for size, _, tokens in bins) < rest else (low, mid)
    return high


def mix(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, shares) of documents (doc_id, source, n_tokens) mixed to targets (source, target_share, max_repeats).

    ``targets`` is a specification with one row a source; at most 1,000 are accepted.
    """
    spark = sized.sparkSession
    plan = {r["source"]: r for r in targets.select(_source("source").alias("source"), "target_share", "max_repeats").limit(1001).collect()}
    if len(plan) > 1000:
        raise ValueError("a mixture is expected to name at most 1,000 sources")
    base = sized.select("doc_id", _source("source").alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).filter((F.col("n_tokens") > 0) & F.col("source").isin(list(plan)))
    base = cut(base)
    # Sizes by geometric bins: at most some 300 rows a source, however many documents there are.
    bins: dict[str, list[tuple[float, int, float]]] = {}
    step = F.floor(F.log2("n_tokens") * 8)
    for r in base.groupBy("source", step.alias("b")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect():
        bins.setdefault(r["source"], []).append((r["t"] / r["n"], r["n"], float(r["t"])))
    have = {s: sum(t for _, _, t in b) for s, b in bins.items()}
    asked = {s: r for s, r in plan.items() if have.get(s) and r["target_share"] and r["target_share"] > 0 and (r["max_repeats"] or 0) > 0}
    total = min((have[s] * r["max_repeats"] / r["target_share"] for s, r in asked.items()), default=0.0)
    need = {s: total * r["target_share"] for s, r in asked.items()}
    whole = {s: min(int(need[s] / have[s] + 1e-9), asked[s]["max_repeats"]) for s in asked}
    rest = {s: max(0.0, need[s] - whole[s] * have[s]) if whole[s] < asked[s]["max_repeats"] else 0.0 for s in asked}
    rate = {s: _rate(bins[s], rest[s]) if rest[s] > 0.5 else 0.0 for s in asked}

    lookup = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])[F.col("source")] if d else F.lit(None)
    random = (F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    chance = F.least(F.lit(1 - 1e-9), lookup(rate).cast("double") * F.col("n_tokens"))
    odds = (random / (1 - random)) / (chance / (1 - chance))
    ranked = base.withColumn("chance", chance).withColumn("rank", F.when(F.col("chance") > 0, odds / (1 + odds)))
    ranked = cut(ranked.select("doc_id", "source", "n_tokens", "rank"))

    open_ = {s: (0.0, 1.0, rest[s]) for s in asked if rest[s] > 0.5}  # bounds of the cut, and the tokens still wanted
    for _ in range(LEVELS):
        if not open_:
            break
        low, width = lookup({s: v[0] for s, v in open_.items()}), lookup({s: v[1] for s, v in open_.items()})
        place = F.floor((F.col("rank") - low) / width * BINS)
        inside = ranked.filter(F.col("rank").isNotNull() & low.isNotNull()).withColumn("bin", place).filter(F.col("bin").between(0, BINS - 1))
        sums: dict[str, list[tuple[int, int]]] = {}
        for r in inside.groupBy("source", "bin").agg(F.sum("n_tokens").alias("t")).collect():  # at most sources x BINS rows
            sums.setdefault(r["source"], []).append((r["bin"], r["t"]))
        for s, (a, w, want) in list(open_.items()):
            for b, t in sorted(sums.get(s, [])):
                if want < t:
                    open_[s] = (a + b * w / BINS, w / BINS, want)
                    break
                want -= t
            else:
                open_[s] = (a + w, w / BINS, want)
    edge = {s: v[0] for s, v in open_.items()}
    extra = F.when(F.col("rank") < lookup(edge).cast("double"), 1).otherwise(0)
    copies = F.coalesce(lookup(whole).cast("int"), F.lit(0)) + F.coalesce(extra, F.lit(0))
    used = ranked.withColumn("copies", copies).filter(F.col("copies") > 0)
    rows = used.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies").cast("bigint"))).alias("copy_no"))
    got = {r["source"]: (r["d"], r["t"], r["m"]) for r in used.groupBy("source").agg(F.count("*").alias("d"), F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.max("copies").alias("m")).collect()}
    sum_ = sum(t for _, t, _ in got.values()) or 1
    shares = spark.createDataFrame(
        [(s, float(r["target_share"] or 0), int(got.get(s, (0, 0, 0))[0]), int(got.get(s, (0, 0, 0))[1]), int(got.get(s, (0, 0, 0))[2]), got.get(s, (0, 0, 0))[1] / sum_) for s, r in sorted(plan.items())],
        "source string, target_share double, documents bigint, tokens bigint, most_copies bigint, actual_share double",
    )
    return rows, shares


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return d.select("doc_id", "source", F.size("ids").alias("n_tokens"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_target"))[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
