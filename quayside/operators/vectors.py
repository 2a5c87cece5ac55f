"""Vectors: hashed embeddings, cosine, top-k, similarity edges in blocks, single-linkage clusters."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import tokens
from quayside.session import cut, table, written


def hashed_components(df: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """(key, i, w): the non-zero components of each text's hashed embedding, before it is scaled to length 1.

    Tokens are counted before they are hashed, so a frequent token is hashed once a text.
    """
    t = df.select(key, F.explode(tokens(F.col(text))).alias("t")).groupBy(key, "t").count()
    h = F.sha2("t", 256)
    i = F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % dim
    sign = F.when(F.conv(F.substring(h, 5, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return t.select(key, i.alias("i"), (sign * F.col("count")).alias("w")).groupBy(key, "i").agg(F.sum("w").alias("w")).filter("w <> 0")


def hashed_embedding(df: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """(key, vector) of length 1; texts without tokens get no row."""
    w = F.col("w").cast("double")
    # The norm is an aggregate of its own, so that it isn't evaluated again for every element.
    g = hashed_components(df, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"), F.sqrt(F.sum(w * w)).alias("norm"))  # at most ``dim`` entries
    return g.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double") / F.col("norm")).alias("vector"))


def embedding(text: Column, dim: int = 128) -> Column:
    """The hashed embedding of each text as a column: one Arrow pass, no shuffle of tokens; zeros for a text without tokens.

    The digest of a token is made once per worker while its table of tokens lasts.
    """

    def embed(values: pd.Series) -> pd.Series:
        lists = [_TOKEN.findall(t.lower()) if t else [] for t in values]
        places = [p for ts in lists for p in map(_place, ts)]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.fromiter((abs(p) - 1 for p in places), np.int64, len(places)) % dim
        sign = np.sign(np.fromiter(places, np.int64, len(places)))
        m = np.bincount(owner * dim + at, weights=sign, minlength=len(lists) * dim).reshape(-1, dim) if len(lists) else np.zeros((0, dim))
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return pd.Series(list(np.divide(m, n, out=np.zeros_like(m), where=n > 0)), dtype=object)

    return F.pandas_udf(embed, "array<double>").asNondeterministic()(text)


_TOKEN = re.compile("[a-z0-9]+")


@lru_cache(300_000)
def _place(token: str) -> int:
    """1 + the first 16 bits of a token's digest, with its sign."""
    h = hashlib.sha256(token.encode()).digest()
    return (h[0] * 256 + h[1] + 1) * (1 if h[2] % 2 == 0 else -1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for missing, empty, zero or unequal vectors."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / F.when(n > 0, n)), F.lit(0.0))


def similarity_edges(df: DataFrame, key: str, vector: str, threshold: float, block: int = 2000) -> DataFrame:
    """(a, b, cos) of all pairs at or above a threshold, exactly, for up to some 100,000 vectors.

    Vectors are put into blocks by hash; each pair of blocks meets in one task and is multiplied as matrices, and only
    edges leave it.  A row is sent once per block, so what a task holds is two blocks, whatever the number of rows, but
    the work grows as the square; :func:`near_edges` is for larger sets.
    """
    n = df.count()
    blocks = max(1, -(-n // block))
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v"), F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int").alias("own"))
    pair = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = rows.withColumn("other", pair).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def multiply(group: tuple, x: pd.DataFrame) -> pd.DataFrame:
        i, j = group
        m = _units(x["v"])
        left, right = np.flatnonzero(x["own"] == i), np.flatnonzero(x["own"] == j)
        c = m[left] @ m[right].T
        p, q = np.nonzero(c >= threshold)
        k = x["k"].to_numpy()
        a, b, s = k[left[p]], k[right[q]], c[p, q]
        keep = a < b if i == j else np.ones(len(a), bool)
        a, b, s = a[keep], b[keep], s[keep]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cos": s})

    return sent.groupBy("i", "j").applyInPandas(multiply, f"a {kind}, b {kind}, cos double")


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), np.float64)
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def tables_for(threshold: float, planes: int, recall: float) -> int:
    """Tables of ``planes`` random hyperplanes, looked up with one bit of each signature flipped too, for a pair at the threshold."""
    p = 1 - math.acos(min(1.0, threshold)) / math.pi
    met = p**planes + planes * p ** (planes - 1) * (1 - p)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 1


def near_edges(df: DataFrame, key: str, vector: str, threshold: float, recall: float = 0.99, members: int = 256, block: int = 1024, seed: int = 7) -> DataFrame:
    """(a, b, cos) of pairs at or above a threshold by random hyperplanes: what meets in a bucket is compared exactly.

    Signatures are as long as ``members`` rows a bucket ask for; the number of tables follows from the recall wanted of
    a pair exactly at the threshold, so it is the same at every size but for that length.  A row is sent to its bucket
    and, as a guest, to those one bit away.  A crowded bucket is met in pairs of blocks, so nothing is capped and no
    task holds more than two blocks.  Every edge given is exact; only pairs can be missed.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    n = df.count()
    planes = max(1, min(24, round(math.log2(max(2, n / members)))))
    tables = tables_for(threshold, planes, recall)

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normal: np.ndarray | None = None
        for b in batches:
            if not len(b):
                continue
            m = _units(b["v"])
            if normal is None:
                normal = np.random.default_rng(seed).standard_normal((m.shape[1], tables * planes))
            bit = ((m @ normal) >= 0).reshape(len(m), tables, planes)
            yield pd.DataFrame({"k": b["k"], "v": b["v"], "s": list((bit * (1 << np.arange(planes))).sum(2))})

    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v")).mapInPandas(signatures, f"k {kind}, v array<float>, s array<bigint>")
    rows = written(rows, "signatures")
    placed = rows.select("k", F.posexplode("s").alias("t", "own"))
    near = F.concat(F.array(F.col("own")), F.array(*[F.col("own").bitwiseXOR(F.lit(1 << i).cast("bigint")) for i in range(planes)]))
    sent = placed.select("k", "t", "own", F.explode(near).alias("at")).withColumn("guest", F.col("own") != F.col("at"))
    part = F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / block)).cast("int")
    sized = sent.join(sent.groupBy("t", "at").agg(F.count("*").alias("n")), ["t", "at"]).withColumn("part", part)
    # Pairs of parts: a row goes to those of the bucket that its part stands in.
    last = F.ceil(F.col("n") / block).cast("int") - 1
    to = F.explode(F.sequence(F.lit(0), last))
    met = sized.withColumn("to", to).withColumns({"i": F.least("part", "to"), "j": F.greatest("part", "to")}).join(rows.select("k", "v"), "k")

    def multiply(group: tuple, x: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = group
        m, k, guest = _units(x["v"]), x["k"].to_numpy(), x["guest"].to_numpy(bool)
        left, right = np.flatnonzero(x["part"] == i), np.flatnonzero(x["part"] == j)
        c = m[left] @ m[right].T
        p, q = np.nonzero(c >= threshold)
        p_, q_ = left[p], right[q]
        keep = ~(guest[p_] & guest[q_]) & (k[p_] != k[q_])  # two guests meet at home elsewhere
        p_, q_, s = p_[keep], q_[keep], c[p, q][keep]
        return pd.DataFrame({"a": np.minimum(k[p_], k[q_]), "b": np.maximum(k[p_], k[q_]), "cos": s})

    found = met.groupBy("t", "at", "i", "j").applyInPandas(multiply, f"a {kind}, b {kind}, cos double")
    return found.groupBy("a", "b").agg(F.max("cos").alias("cos"))


def clusters(edges: DataFrame) -> DataFrame:
    """(node, root) by least labels with pointer jumping until nothing changes, lineage cut each round."""
    e = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    label = cut(e.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")))
    while True:  # labels only fall, so this ends
        near = e.join(label.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        hooked = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        far = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(hooked.join(far, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        label = new.select("node", "root")
        if new.filter("old <> root").isEmpty():
            return label


def cluster_report(df: DataFrame, key: str, vector: str, label: str, threshold: float) -> DataFrame:
    """Clusters with size, cohesion, plurality label and flags.

    Cohesion is the mean cosine over all inner pairs, from the sum of unit vectors: (|sum|^2 - n) / (n (n - 1)).
    """
    roots = clusters(similarity_edges(df, key, vector, threshold))
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(dot(v, v))
    x = df.join(roots, df[key] == roots["node"], "left").select(F.col(key), F.coalesce("root", key).alias("root"), F.col(label).alias("l"), F.when(norm > 0, F.transform(v, lambda y: y / norm)).otherwise(v).alias("u"), (norm > 0).cast("int").alias("nz"))
    # Sums by component: partial in each partition, nothing is gathered by cluster.
    part = x.select("root", F.posexplode("u").alias("i", "y")).groupBy("root", "i").agg(F.sum("y").alias("s")).groupBy("root").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    total = df.count()
    size = x.groupBy("root").agg(F.count("*").alias("size"), F.sum("nz").alias("nz"))
    named = x.groupBy("root", "l").agg(F.count("*").alias("n"), F.min(key).alias("at")).groupBy("root").agg(F.min_by(F.struct("l", "n"), F.struct(-F.col("n"), "at")).alias("top"))
    g = size.join(part, "root").join(named, "root")
    cohesion = F.when(F.col("size") > 1, (F.col("square") - F.col("nz")) / (F.col("size") * (F.col("size") - 1))).otherwise(1.0)
    g = g.withColumn("cohesion", cohesion).withColumn("name", F.when(F.col("top.n") < F.greatest(F.lit(1), F.floor(F.col("size") / 2)), "other").otherwise(F.col("top.l").cast("string")))
    giant = (F.col("name") == "other") | ((F.col("size") >= max(8, int(0.4 * total))) & (F.col("cohesion") < 0.25))
    return g.select("root", "size", F.round("cohesion", 4).alias("cohesion"), F.when(giant, "other").otherwise(F.col("name")).alias("name"), (F.col("size") <= 2).alias("tiny"), (~giant & (F.col("size") > 2)).alias("ranked"))


def _query(spark, sf_dir) -> list[float]:
    """The vector asked for: that of the least id; one row."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).collect()[0]["embedding"]]


def _cos(q: list[float]) -> Column:
    return cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q]))


def hashing_embedding_long(spark, sf_dir):
    return hashed_components(table(spark, sf_dir, "documents"), "doc_id", "text")


def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.round(_cos(_query(spark, sf_dir)), 6).alias("score"))
    return e.filter("score >= 0.1").orderBy(F.desc("score"), "vec_id").limit(20)


def cosine_filter_after_topk(spark, sf_dir):
    """The filter comes after the limit on purpose: it must not change which rows were among the first."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(_cos(_query(spark, sf_dir)), 6).alias("score"))
    return e.orderBy(F.desc("score"), "vec_id").limit(40).filter("label % 2 = 0").select("vec_id", "score")


def similarity_edges_exact(spark, sf_dir):
    e = similarity_edges(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.42)
    return e.select("a", "b", F.round("cos", 5).alias("cos"))


def similarity_edges_near(spark, sf_dir):
    """The same edges by random hyperplanes: how many are found, and whether all of them are true ones."""
    e = table(spark, sf_dir, "embeddings")
    near, exact = near_edges(e, "vec_id", "embedding", 0.42), similarity_edges(e, "vec_id", "embedding", 0.42)
    both = exact.select("a", "b", F.lit(1).alias("x")).join(near.select("a", "b", F.lit(1).alias("y")), ["a", "b"], "full")
    return both.agg((F.count("y") >= 0.95 * F.count("x")).alias("enough"), F.count_if(F.col("x").isNull()).alias("untrue"), F.count("x").alias("edges"))


def cluster_components(spark, sf_dir):
    return clusters(similarity_edges(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.42))


def cluster_flags(spark, sf_dir):
    return cluster_report(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.42)


QUERIES = {f.__name__: f for f in (hashing_embedding_long, cosine_topk, cosine_filter_after_topk, similarity_edges_exact, similarity_edges_near, cluster_components, cluster_flags)}
_Q = "q as (select embedding::double[] as qv from embeddings order by vec_id limit 1), s as (select vec_id, label, round(list_cosine_similarity(embedding::double[], qv), 6) as score from embeddings, q)"
_E = "e as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cos from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.42)"
ORACLES = {
    "hashing_embedding_long": "with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents), h as (select doc_id, sha256(t) as h from t), x as (select doc_id, cast(('0x' || substring(h, 1, 4)) as int) % 128 as i, case when cast(('0x' || substring(h, 5, 2)) as int) % 2 = 0 then 1 else -1 end as w from h) select doc_id, i, cast(sum(w) as bigint) as w from x group by doc_id, i having sum(w) <> 0",
    "cosine_topk": f"with {_Q} select vec_id, score from s where score >= 0.1 order by score desc, vec_id limit 20",
    "cosine_filter_after_topk": f"with {_Q}, k as (select * from s order by score desc, vec_id limit 40) select vec_id, score from k where label % 2 = 0",
    "similarity_edges_exact": f"with {_E} select a, b, round(cos, 5) as cos from e",
    "similarity_edges_near": f"with {_E} select true as enough, 0 as untrue, count(*) as edges from e",
    "cluster_flags": f"with recursive {_E}, u as (select a as x, b as y from e union select b, a from e), r as (select x as node, x as reach from u union select r.node, u.y from r join u on u.x = r.reach), g as (select node, min(reach) as root from r group by node), m as (select v.vec_id, v.label, v.embedding::double[] as v, coalesce(g.root, v.vec_id) as root from embeddings v left join g on g.node = v.vec_id), z as (select root, count(*) as size from m group by root), c as (select p.root, sum(list_cosine_similarity(p.v, q.v)) as s from m p join m q on p.root = q.root and p.vec_id < q.vec_id group by p.root), l as (select root, label, count(*) as n, min(vec_id) as low from m group by root, label), t as (select root, label, n from (select *, row_number() over (partition by root order by n desc, low) as k from l) where k = 1), x as (select z.root, size, case when size > 1 then s / (size * (size - 1) / 2.0) else 1.0 end as cohesion, case when t.n < greatest(1, size // 2) then 'other' else cast(t.label as varchar) end as name from z join t using (root) left join c using (root)), f as (select *, name = 'other' or (size >= greatest(8, cast(floor(0.4 * (select count(*) from embeddings)) as bigint)) and cohesion < 0.25) as giant from x) select root, size, round(cohesion, 4) as cohesion, case when giant then 'other' else name end as name, size <= 2 as tiny, not giant and size > 2 as ranked from f",
    "cluster_components": f"with recursive {_E}, u as (select a as x, b as y from e union select b, a from e), r as (select x as node, x as reach from u union select r.node, u.y from r join u on u.x = r.reach) select node, min(reach) as root from r group by node",
}
