"""Near-duplicate texts by a chosen-path set similarity join (problem 6).

A text is the set of its words in canonical form, the n-th occurrence of a word being an element of its own, so that
Jaccard similarity of sets is the wanted similarity of word bags.  Exact copies of a bag form one class.  In each of
several independent trees a class follows every path on which a hash, minwise by tree and path, selects one of its
elements; a path ends when the frequencies of its elements let it expect few members.  What meets at the end of a path
is compared exhaustively, whatever its number up to ``CROWDED``: first by 1-bit minwise sketches (128 bits, passed from
102 on; a pair at the threshold agrees in 115, with a deviation of 3.4), then by word bags, of 32-bit hashes.  Ends with
more members branch on; what is crowded still is compared exhaustively in blocks, so no bucket is capped.  The number of
trees follows from the depth of the paths, hence from the number of bags, so that recall doesn't fall as the input grows.

Cases: null, blank and too short or long texts take part in nothing; exact copies are linked through their class; ties
and repeated rows are kept; a table without rows gives no rows; texts are whole; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.canon import canonical_form
from quayside.session import cut, table, written

SIMILARITY, LEAST_WORDS, MOST_WORDS = 0.8, 25, 300
#: The share that sets how many elements are selected at a branching, 1 / (LAMBDA * size) of each; the same where a
#: crowded end branches on, which parts a pair at the threshold in about 4 of 100 ends; the share of the pairs of the
#: worst kind (at the threshold, one bag holding the other) that the trees may miss, which sets their number.
LAMBDA, LAMBDA_ON, MISS = 0.8, 0.25, 0.005
#: Bags by whose words the number of trees is set.
SAMPLE = 1000
#: Members to expect at the end of a path; actual members above which it branches on; levels; rounds of branching on;
#: members of a block where an end is crowded after these rounds; rows of ends compared at a time.
EXPECTED, CROWDED, LEVELS, ROUNDS, BLOCK, AT_ONCE = 64, 8192, 10, 4, 2048, 200_000
SKETCH_BITS, SKETCH_LEAST = 128, 102
TABLE = 1 << 18

_EDGES = re.compile(r"^\W+|\W+$")
_U = np.uint64


def words_of(text: str) -> list[str]:
    return [w for w in (_EDGES.sub("", x) for x in canonical_form(text).split()) if w]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def elements(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of (word, occurrence) of each list of word hashes: (flat, starts)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.r_[0, np.cumsum(sizes)]
    flat = np.fromiter((h for x in lists for h in x), np.uint64, int(starts[-1]))
    owner = np.repeat(np.arange(len(lists)), sizes)
    flat = flat[np.lexsort((flat, owner))]
    first = np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])] if len(flat) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    nth = np.arange(len(flat)) - np.repeat(begin, np.diff(np.r_[begin, len(flat)]))
    flat = np.where(nth > 0, _mix(flat + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), flat)
    return flat[np.lexsort((flat, owner))], starts


def word_hashes(text: str, known: dict[str, int]) -> list[int]:
    """The hash of each word; ``known`` maps what stands between blanks to the hash of its word, 0 if nothing is left."""
    out = []
    for x in canonical_form(text).split():
        h = known.get(x)
        if h is None:
            w = _EDGES.sub("", x)
            h = known[x] = xxhash.xxh3_64_intdigest(w) if w else 0
        if h:
            out.append(h)
    return out


def bags(df: DataFrame, key: str, text: str, least: int = LEAST_WORDS, most: int = MOST_WORDS) -> DataFrame:
    """(item, cls, c, elements): texts of ``least`` to ``most`` words; ``cls`` is a digest of the bag, ``c`` its first half."""
    kind = dict(df.dtypes)[key]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            hashed = [(k, w) for k, t in zip(b["item"], b["t"]) if least <= len(w := word_hashes(t, known)) <= most]
            flat, starts = elements([w for _, w in hashed])
            sets = [flat[starts[i] : starts[i + 1]] for i in range(len(hashed))]
            digests = [xxhash.xxh3_128_digest(e) for e in sets]
            if len(known) > 400_000:
                known.clear()
            yield pd.DataFrame({
                "item": [k for k, _ in hashed], "cls": digests, "c": [int.from_bytes(d[:8], "little", signed=True) for d in digests], "elements": [(e >> _U(32)).astype(np.uint32).view(np.int32) for e in sets],
            })

    # A text of so many words has at least so many letters and blanks; shorter ones needn't reach Python.
    rows = df.select(F.col(key).alias("item"), F.col(text).alias("t")).filter(F.length("t") >= 2 * least - 1)
    return rows.mapInPandas(make, f"item {kind}, cls binary, c bigint, elements array<int>")


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    return _mix(np.concatenate(lists).view(np.uint32).astype(np.uint64)), np.r_[0, np.cumsum([len(e) for e in lists])].astype(np.int64)


def frequencies(b: DataFrame) -> np.ndarray:
    """How many items have an element of each of ``TABLE`` buckets; over all items, of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(TABLE, np.int64)
        for x in batches:
            if len(x):
                total += np.bincount((_flat(x["elements"].to_list())[0] >> _U(46)).astype(np.int64), minlength=TABLE)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": k.astype(np.int32), "n": total[k]})

    rows = b.select("elements").mapInPandas(count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TABLE, np.int64)
    out[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def extinction(own: np.ndarray, enough: float, similarity: float = SIMILARITY) -> float:
    """The chance that one tree parts a pair at the threshold, of which one bag holds the other (the worst case).

    Such a pair shares ``similarity / LAMBDA`` branches at each level, a Poisson number at most as scattered; ``own`` is
    the information of the elements of the larger bag, counted in quarters of a bit.  The smaller bag is taken to lack
    the rarest of them, which makes its paths longest.
    """
    own = np.sort(own)[: int(np.ceil(similarity * len(own)))]
    chance = np.bincount(np.floor(own * 4).astype(np.int64)) / len(own)  # rounded down: real paths are no longer
    lost = np.zeros(int(np.ceil(enough * 4)) + 1)  # by the information that is still wanted
    for _ in range(LEVELS):
        after = np.convolve(np.r_[np.zeros(len(chance)), lost], chance)[len(chance) : len(chance) + len(lost)]
        lost = np.r_[0, np.exp(similarity / LAMBDA * (after - 1))[1:]]
    return float(lost[-1])


def trees_for(flat: np.ndarray, starts: np.ndarray, bits: np.ndarray, enough: float, similarity: float = SIMILARITY) -> int:
    """The number of trees that misses at most ``MISS`` of the pairs at the threshold, over a sample of bags."""
    own = bits[(flat >> _U(46)).astype(np.int64)]
    q = np.array([extinction(own[i:j], enough, similarity) for i, j in zip(starts[:-1], starts[1:])])
    trees = 1
    while len(q) and (q**trees).mean() > MISS:
        trees += 1
    return trees


def _branch(owner: np.ndarray, path: np.ndarray, flat: np.ndarray, starts: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level: (index of the path, its continuation, the element chosen) for every selected element."""
    size = np.diff(starts)[owner]
    ends = np.cumsum(size)
    at = np.repeat(starts[owner] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    which = np.repeat(np.arange(len(owner)), size)
    element = flat[at]
    h = _mix(element ^ path[which])
    limit = (2.0**64 / (share * size)).clip(max=2.0**64 - 2**12).astype(np.uint64)
    hit = np.flatnonzero(h < limit[which])
    which, element = which[hit], element[hit]
    return which, _mix(path[which] * _U(0x9E3779B97F4A7C15) + element), element


def paths(flat: np.ndarray, starts: np.ndarray, bits: np.ndarray, enough: float, trees: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(set, path) of the ends of all paths; ``bits`` is the information of an element by bucket."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), trees)
    path = _mix(np.tile(np.arange(1, trees + 1).astype(np.uint64) * _U(0xD1B54A32D192ED03), n))
    have = np.zeros(len(owner))
    out_owner, out_path = [], []
    for level in range(levels):
        if not len(owner):
            break
        which, new, element = _branch(owner, path, flat, starts, LAMBDA)
        have = have[which] + bits[(element >> _U(46)).astype(np.int64)]
        owner, path = owner[which], new
        done = have >= enough if level + 1 < levels else np.ones(len(owner), bool)
        out_owner.append(owner[done])
        out_path.append(path[done])
        owner, path, have = owner[~done], path[~done], have[~done]
    return np.concatenate(out_owner), np.concatenate(out_path)


def sketches(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 one-bit minwise hashes of each set, as two numbers."""
    out = np.zeros((2, len(starts) - 1), np.uint64)
    for i in range(SKETCH_BITS):
        low = np.minimum.reduceat(_mix(flat + _U((i + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)), starts[:-1])
        out[i // 64] |= ((low >> _U(17)) & _U(1)) << _U(i % 64)
    return out.view(np.int64)


_END = "path bigint, c bigint, s1 bigint, s2 bigint"


def _ends(b: DataFrame, bits: np.ndarray, enough: float, trees: int) -> DataFrame:
    """(path, c, s1, s2), the ends of each class; ``c`` is the first half of a class's digest, s1 and s2 its sketch."""
    table_ = b.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 1500):
                x = whole.iloc[i : i + 1500]
                flat, starts = _flat(x["elements"].to_list())
                owner, path = paths(flat, starts, table_.value, enough, trees)
                s1, s2 = sketches(flat, starts)
                yield pd.DataFrame({"path": path.view(np.int64), "c": x["c"].to_numpy()[owner], "s1": s1[owner], "s2": s2[owner]})

    return b.select("c", "elements").mapInPandas(run, _END)


#: Keys up to which a set of classes (8 bytes each) is sent to all executors; larger sets are joined by a shuffle.
SENT = 200_000


def _only(b: DataFrame, keys: DataFrame) -> DataFrame:
    """The classes among ``keys``; a broadcast behind a check of its size."""
    few = keys.limit(SENT + 1).count() <= SENT
    return b.join(F.broadcast(keys) if few else keys, "c", "left_semi")


def _branch_on(crowded: DataFrame, b: DataFrame) -> DataFrame:
    """One more level of the paths of crowded ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 5000):
                x = whole.iloc[i : i + 5000]
                flat, starts = _flat(x["elements"].to_list())
                which, path, _ = _branch(np.arange(len(x)), x["path"].to_numpy(np.int64).view(np.uint64), flat, starts, LAMBDA_ON)
                out = x.iloc[which][["c", "s1", "s2"]].copy()
                out.insert(0, "path", path.view(np.int64))
                yield out

    have = crowded.join(_only(b.select("c", "elements"), written(crowded.select("c").distinct(), "keys")), "c")
    return have.select("path", "c", "s1", "s2", "elements").mapInPandas(run, _END)


def agreeing(end: np.ndarray, c: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(c_a, c_b), the lesser first, of all pairs within an end whose sketches agree; ``end`` is sorted."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    live, s1, s2 = np.arange(len(end)), s1.view(np.uint64), s2.view(np.uint64)
    for apart in range(1, len(end)):
        live = live[live + apart < len(end)]
        live = live[end[live] == end[live + apart]]
        if not len(live):
            break
        differ = np.bitwise_count(s1[live] ^ s1[live + apart]) + np.bitwise_count(s2[live] ^ s2[live + apart])
        hit = live[differ <= SKETCH_BITS - SKETCH_LEAST]
        if len(hit):
            out.append((np.minimum(c[hit], c[hit + apart]), np.maximum(c[hit], c[hit + apart])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*out)]), axis=1)
    return tuple(pairs[:, pairs[0] != pairs[1]])


_MET = "c_a bigint, c_b bigint, path bigint, s1 bigint, s2 bigint"


def _meet(ends: DataFrame, keys: list[str], crowded: int | None) -> DataFrame:
    """The candidate pairs of all ends, from one exchange; members of ends above ``crowded`` come out as they went in.

    Sorted rows stream through: a task holds ``AT_ONCE`` rows and one end of at most ``crowded`` members, never a whole
    crowded end.  Rows (c_a, c_b) are pairs; rows whose c_b is null are members of crowded ends.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # columns: keys, c, s1, s2
        over: np.ndarray | None = None  # the crowded end that is passing

        def pairs(x: np.ndarray) -> pd.DataFrame:
            a, b = agreeing(*x[-4:]) if len(keys) == 1 else agreeing(np.cumsum(np.r_[False, (x[:-3, 1:] != x[:-3, :-1]).any(0)]), *x[-3:])
            return pd.DataFrame({"c_a": a, "c_b": pd.array(b, "Int64"), "path": 0, "s1": 0, "s2": 0})

        def members(x: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"c_a": x[-3], "c_b": pd.array([None] * x.shape[1], "Int64"), "path": x[0], "s1": x[-2], "s2": x[-1]})

        def flush(x: np.ndarray, last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, over
            if over is not None:
                same = (x[: len(keys)] == over[:, None]).all(0)
                n = x.shape[1] if same.all() else int(same.argmin())
                if n:
                    yield members(x[:, :n])
                    x = x[:, n:]
                if not x.shape[1]:
                    held = []
                    return
                over = None
            start = np.flatnonzero(np.r_[True, (x[: len(keys), 1:] != x[: len(keys), :-1]).any(0)])
            size = np.diff(np.r_[start, x.shape[1]])
            if crowded is not None and (size > crowded).any():
                big = np.repeat(size > crowded, size)
                if size[-1] > crowded:
                    over = x[: len(keys), -1].copy()
                yield members(x[:, big])
                x, last = x[:, ~big], last or over is not None
                if not x.shape[1]:
                    held = []
                    return
                start = np.flatnonzero(np.r_[True, (x[: len(keys), 1:] != x[: len(keys), :-1]).any(0)])
            stop = x.shape[1] if last else int(start[-1])
            held = [x[:, stop:]] if stop < x.shape[1] else []
            if stop:
                yield pairs(x[:, :stop])

        for b in batches:
            held.append(np.ascontiguousarray(b[[*keys, "c", "s1", "s2"]].to_numpy(np.int64).T))
            if sum(x.shape[1] for x in held) >= AT_ONCE:
                yield from flush(np.concatenate(held, axis=1), False)
        if held:
            yield from flush(np.concatenate(held, axis=1), True)

    rows = ends.select(*keys, "c", "s1", "s2").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(run, _MET)


def candidate_pairs(ends: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of classes (a before b) that meet at the end of a path and agree in their sketches."""
    done, rest = [], ends
    for _ in range(ROUNDS):
        met = written(_meet(rest, ["path"], CROWDED), "met")
        done.append(met.filter("c_b is not null").select("c_a", "c_b"))
        crowded = met.filter("c_b is null").select("path", F.col("c_a").alias("c"), "s1", "s2")
        if crowded.isEmpty():
            rest = None
            break
        rest = written(_branch_on(crowded, b), "ends")
    if rest is not None:
        # What is still crowded is compared whole, in blocks: every pair of blocks of an end is one group.
        blocks = F.ceil(F.col("count") / BLOCK).cast("int")
        sized = rest.join(rest.groupBy("path").count(), "path").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("c"), blocks).cast("int"))
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("own")).cast("bigint") * F.col("blocks") + F.greatest(o, F.col("own")))
        done.append(_meet(sized.withColumn("block", F.explode(F.array_distinct(pair))), ["path", "block"], None).select("c_a", "c_b"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.distinct()


def representatives(b: DataFrame) -> DataFrame:
    """(c, cls, elements) of one item of each class, the least; of a class without copies there is nothing to choose."""
    copied = written(b.groupBy("cls").agg(F.min("item").alias("keep"), F.count("*").alias("n")).filter("n > 1").select("cls", "keep"), "copied")
    if copied.limit(SENT + 1).count() <= SENT:
        one = b.join(F.broadcast(copied), "cls", "left").filter(F.col("keep").isNull() | (F.col("item") == F.col("keep")))
    else:  # joined by item, so that many copies of a bag are no hot key
        one = b.join(b.groupBy("cls").agg(F.min("item").alias("item")).select("item"), "item", "left_semi")
    return one.select("c", "cls", "elements")


def similar_classes(b: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(cls_a, cls_b, similarity) of all pairs of different bags at or above the threshold; ``b`` as made by bags()."""
    r = written(representatives(b), "classes")
    n = max(2, r.count())
    count = frequencies(r)
    bits = np.log2(np.maximum(1.0, n / np.maximum(1, count))).astype(np.float32)
    enough = max(1.0, float(np.log2(n / EXPECTED)))
    sample = [x["elements"] for x in r.orderBy("c", "cls").select("elements").limit(SAMPLE).collect()]  # the order of a digest
    trees = trees_for(*_flat([np.array(x, np.int32) for x in sample]), bits, enough, similarity) if sample else 1
    ends = written(_ends(r, bits, enough, trees), "ends")
    pairs = written(candidate_pairs(ends, r), "pairs")
    wanted = written(pairs.select(F.col("c_a").alias("c")).union(pairs.select("c_b")).distinct(), "keys")
    sets = written(_only(r, wanted), "sets").dropDuplicates(["cls"])
    side = lambda s: sets.select(F.col("c").alias(f"c_{s}"), F.col("cls").alias(f"cls_{s}"), F.col("elements").alias(f"elements_{s}"))
    both = pairs.join(side("a"), "c_a").join(side("b"), "c_b")
    common = F.size(F.array_intersect("elements_a", "elements_b"))
    scored = both.select("cls_a", "cls_b", common.alias("c"), (F.size("elements_a") + F.size("elements_b")).alias("s"))
    # c / (s - c) >= similarity, without a division whose rounding could decide.
    return scored.filter(F.col("c") >= similarity * (F.col("s") - F.col("c")) - 1e-9).select("cls_a", "cls_b", (F.col("c") / (F.col("s") - F.col("c"))).alias("similarity"))


#: Parts into which the members of a class are told, and members of a block of a part.
PARTS, MEMBERS = 32, 512


def similar_items(df: DataFrame, key: str = "id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(item_a, item_b) of all pairs of items at or above the threshold, exact copies included.

    Members of a class go in blocks of some ``MEMBERS`` ids, told into ``PARTS`` parts by hash, so the copies of one text
    are never one key: pairs of parts are joined, and a row of the join is a pair of blocks.
    """
    b = written(bags(df, key, text), "bags")
    links = similar_classes(b, similarity).select("cls_a", "cls_b")
    part = F.pmod(F.xxhash64("item", F.lit(1)), F.lit(PARTS)).cast("int")
    sized = b.select("item", "cls", part.alias("part"))
    sized = sized.withColumn("n", F.count("*").over(Window.partitionBy("cls", "part")))
    block = F.pmod(F.xxhash64("item", F.lit(2)), F.ceil(F.col("n") / MEMBERS))
    blocks = written(sized.groupBy("cls", "part", block.alias("block")).agg(F.collect_list("item").alias("items")), "members")
    parts = blocks.groupBy("cls").agg(F.collect_set("part").alias("parts"), F.sum(F.size("items")).alias("n"))  # at most PARTS numbers
    every = links.unionByName(parts.filter("n > 1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")))
    for s in "ab":
        told = parts.select(F.col("cls").alias(f"cls_{s}"), F.col("parts").alias("p"))
        every = every.join(told, f"cls_{s}").withColumn(f"part_{s}", F.explode("p")).drop("p")
    for s in "ab":
        of = blocks.select(F.col("cls").alias(f"cls_{s}"), F.col("part").alias(f"part_{s}"), F.col("items").alias(f"items_{s}"))
        every = every.join(of, [f"cls_{s}", f"part_{s}"])
    same = F.col("cls_a") == F.col("cls_b")
    pairs = every.select(same.alias("same"), F.explode("items_a").alias("x"), "items_b").select("same", "x", F.explode("items_b").alias("y"))
    return pairs.filter(~F.col("same") | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))


def components(links: DataFrame, a: str = "cls_a", b: str = "cls_b") -> DataFrame:
    """(node, root): connected components by least-neighbour hooking and pointer jumping until nothing changes; nothing is collected."""
    edges = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct())
    label = cut(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")))
    while True:  # labels only fall, so this ends
        heard = edges.join(label.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        hooked = label.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(hooked.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        label = new.select("node", "root")
        if new.filter("old != root").isEmpty():
            return label


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item with a version or copy: its class, the group of all its versions, and links of its class."""
    b = written(bags(table(spark, sf_dir, "feedback_item"), "id", "text"), "bags")
    links = cut(similar_classes(b))
    degree = links.select(F.col("cls_a").alias("cls")).union(links.select("cls_b")).groupBy("cls").agg(F.count("*").alias("links"))
    root = components(links).withColumnRenamed("node", "cls")
    copies = b.groupBy("cls").agg(F.count("*").alias("copies"))
    classes = copies.join(root, "cls", "left").join(degree, "cls", "left").filter((F.col("copies") > 1) | F.col("links").isNotNull())
    out = b.select("item", "cls").join(classes, "cls")
    return out.select(F.col("item").alias("id"), F.hex("cls").alias("class_id"), F.hex(F.coalesce("root", "cls")).alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_items(table(spark, sf_dir, "feedback_item"))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
