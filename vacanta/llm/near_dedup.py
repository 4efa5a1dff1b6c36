"""Near-duplicate documents by SetSketch registers (operator 2).

Each text becomes the set of its k-word shingles and a SetSketch of it: registers that
hold minima of exponential variables, truncated on the scale of powers of ``BASE``. Two
sketches merge by their maxima, and equal registers are about as likely as the sets are
alike. Bands of registers propose pairs, the joint likelihood of both sketches drops
pairs that lie far below the threshold, and full sets confirm the rest.

No group is expanded into all of its pairs:

* texts with equal sets are one class, represented by its least doc_id;
* in each band's bucket, members are first compared with the bucket's least member only;
* after that, only buckets of three or more that still hold several components are
  compared on full sets, block by block, and a block gives fewer links than members.

The number of bands is such that a pair at the threshold is missed with a probability
below ``MISS``; the likelihood drops a pair at ``SIGMAS`` standard errors below it.

Defined results: documents without words have an empty set and are linked with nothing;
rows without doc_id are linked with nothing, belong to no component and are kept; rows
that repeat a doc_id are one document that any of its texts links, and each is returned;
texts of any length count with all their shingles; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, map_values, mix, shingles, small_batches, table, utf8, word_hashes

WORDS, PERCENT = 5, 80
ROWS_IN_BAND = 5
MISS = 1e-6
SIGMAS = 5.0
#: SetSketch parameters: base, rate, largest register.
BASE, RATE, LAST = 1.001, 20.0, 65_534
#: Members that a block compares with one another, and shingles counted at once.
BLOCK, COLUMNS = 512, 4_096
#: Shingles of a block's part, about; a larger text is a part's only one as a rule.
BLOCK_SIZE = 1 << 18
#: Shingles hashed into all registers at once.
CHUNK = 2_048
#: Links that one task joins into components; 16 bytes each.
AT_ONCE = 1 << 21


def bands(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS_IN_BAND))


def _permutations(m: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seed = (seed >> np.uint64(32)).astype(np.uint32)
    return (seed[:m] | np.uint32(1))[:, None], seed[m:][:, None]


def registers(found: np.ndarray, m: int) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes: m registers of 16 bits; empty sets give zeros."""
    if not len(found):
        return np.zeros(m, dtype=np.uint16)
    a, b = _permutations(m)
    low, least = (found >> np.uint64(32)).astype(np.uint32), np.full(m, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), CHUNK):
        np.minimum(least, (a * low[None, i : i + CHUNK] + b).min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LAST + 1).astype(np.uint16)


def likelihood_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sketches (rows of a and b) of known sizes."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.linspace(0, 1, 101)[:-1][None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    more, less = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    equal = np.clip(1 - more - less, 1e-12, 1)
    fit = up[:, None] * np.log(more) + down[:, None] * np.log(less) + same[:, None] * np.log(equal)
    return np.take_along_axis(grid, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


def _least_estimate(percent: int, m: int) -> float:
    t = percent / 100
    return t - SIGMAS * math.sqrt(t * (1 - t) / m) - 0.01


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum()) if len(b) else 0
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def text_set(data: bytes, k: int) -> np.ndarray:
    return shingles(word_hashes(data.lower()), k)  # bytes.lower() changes A-Z only


def sketches(docs: DataFrame, k: int, m: int) -> DataFrame:
    """doc_id, n (set size), two 64-bit sums that stand for the set, and its registers."""

    def sketch(text: str | None) -> tuple:
        found = text_set(next(utf8([text])), k)
        one, two = mix(found ^ np.uint64(0x5851F42D4C957F2D)), mix(found + np.uint64(0x14057B7EF767814F))
        total = lambda x: int(x.sum(dtype=np.uint64).view(np.int64))
        return len(found), total(one), total(two), registers(found, m).astype(">u2").tobytes()

    return map_values(docs.select("doc_id", "text"), "text", lambda: sketch, "n long, one long, two long, reg binary")


def _sixteen(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=">u2").reshape(len(column), -1).astype(np.int32)


def likely(pairs: DataFrame, reps: DataFrame, percent: int, m: int) -> DataFrame:
    """Pairs (a, b) whose estimate isn't far below the threshold, with the estimate."""
    least = _least_estimate(percent, m)

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            j = likelihood_jaccard(_sixteen(pdf["reg_a"]), _sixteen(pdf["reg_b"]), pdf["n_a"].to_numpy(float), pdf["n_b"].to_numpy(float))
            yield pdf[["a", "b"]].assign(estimate=j)[j >= least]

    side = lambda s: reps.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("reg").alias(f"reg_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(estimate, "a long, b long, estimate double")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            last, keep = None, []
            for x, y in zip(utf8(pdf["text_a"]), utf8(pdf["text_b"]), strict=True):
                if x != last:
                    last, of_a = x, text_set(x, k)  # pairs of one document mostly follow each other
                keep.append(linked(of_a, text_set(y, k), percent))
            yield pdf.loc[keep, ["a", "b"]]

    side = lambda s: texts.select(F.col("rep").alias(s), F.col("text").alias(f"text_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(verify, "a long, b long")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, comp of all edges (u, v) of one partition: roots hook on lesser ones until none can."""
    edges = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *batches])
    ids, at = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    u, v = np.split(at, 2)
    root = np.arange(len(ids))
    while (apart := root[u] != root[v]).any():
        u, v = root[u[apart]], root[v[apart]]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while ((above := root[root]) != root).any():
            root = above
    yield pd.DataFrame({"id": ids, "comp": ids[root]})


def components(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """id, comp (the least id reachable) for every id in links (a, b).

    Up to ``at_once`` links are joined in one task without a shuffle. More of them go through
    alternating large-star and small-star until nothing changes: each pass is two
    aggregations and two joins, is written out, and needs no vertex's neighbours in one
    place. Passes grow with the logarithm of the longest chain. Both give the same rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    if edges.count() <= at_once:
        comps = cut(edges.coalesce(1).mapInPandas(_joined, "id long, comp long"), "comps")
        drop_cut(edges)
        return comps
    edges = edges.distinct()
    state, now = None, ()
    while now != state:
        state = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_cut(edges)
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(held > 1) - 1  # what one set alone holds is shared by no pair
    use = held[column] > 1
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _sides(open_members: DataFrame) -> DataFrame:
    """For each bucket its largest component (``most``), and members and shingles of that and
    of the rest (c_most, w_most, c_rest, w_rest)."""
    sizes = open_members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    most = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"))
    inside = F.col("comp") == F.col("most")
    total = lambda x, own: F.coalesce(F.sum(F.when(own, F.col(x))), F.lit(0))
    sums = [total(x, own).alias(f"{x}_{side}") for x in "cw" for side, own in (("most", inside), ("rest", ~inside))]
    return sizes.join(most, "key").groupBy("key", "most").agg(*sums)


def _parts(members: Column, size: Column) -> Column:
    return F.greatest(F.ceil(members / BLOCK), F.ceil(size / BLOCK_SIZE)).cast("int")


def refined(open_members: DataFrame, texts: DataFrame) -> DataFrame:
    """Open buckets dealt into groups, as key, rep, comp and text.

    The members of a bucket's largest component need no comparing with one another. They
    and the rest are dealt by hash into parts of about ``BLOCK`` members or ``BLOCK_SIZE``
    shingles, whatever comes first; each part of the rest makes a group with itself, each
    later part of the rest and each part of the component. So every pair that may link two
    components lies in a group, however large the bucket is.
    """
    in_most = F.col("comp") == F.col("most")
    dealt = _sides(open_members).select("key", "most", *[_parts(F.col(f"c_{x}"), F.col(f"w_{x}")).alias(f"of_{x}") for x in ("most", "rest")])
    whole = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.pmod(F.xxhash64("rep"), F.when(in_most, F.col("of_most")).otherwise(F.col("of_rest"))).cast("int")
    # a group is a part i of the rest and a part j of the rest (j >= i) or of the component (j < 0)
    groups = F.when(in_most, F.transform(whole("of_rest"), lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j")))).otherwise(
        F.concat(
            F.transform(whole("of_rest"), lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j"))),
            F.transform(whole("of_most"), lambda x: F.struct(F.col("own").alias("i"), (-1 - x).alias("j"))),
        )
    )
    dealt = open_members.join(dealt, "key").withColumn("own", own).select("key", "rep", "comp", F.explode(groups).alias("of"))
    return dealt.select(F.struct("key", "of.i", "of.j").alias("key"), "rep", "comp").join(texts, "rep")


def _blocks(open_members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components that share an open bucket, compared group by group.

    All pairs of a group are checked on full sets, and of the links between components it
    gives a spanning forest. So a bucket of one component and few others takes time in
    proportion to its members.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["rep", "text"]).sort_values(["rep", "text"])  # any text of a rep links
        rep, comp, root = pdf["rep"].tolist(), pdf["comp"].tolist(), {}
        sets = [text_set(t, k) for t in utf8(pdf["text"])]
        n, shared = np.array([len(s) for s in sets]), shared_counts(sets)
        near = np.triu((shared > 0) & (100 * shared >= percent * (n[:, None] + n[None, :] - shared)), 1)

        def top(c):
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for x, y in zip(*np.nonzero(near), strict=True):
            a, b = top(comp[x]), top(comp[y])
            if a != b:
                root[a] = b
                out.append((rep[x], rep[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return refined(open_members, texts).groupBy("key").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    m, n_bands = bands(percent) * ROWS_IN_BAND, bands(percent)
    sketched = cut(sketches(docs, k, m), "sketches")
    sets = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    reps = sets.groupBy("n", "one", "two").agg(F.min(F.struct("doc_id", "reg")).alias("first"))
    reps = cut(reps.select(F.col("first.doc_id").alias("rep"), "n", "one", "two", F.col("first.reg").alias("reg")), "reps")
    marks = reps.select("rep", "n", "reg")

    width = 2 * ROWS_IN_BAND
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("reg", 1 + i * width, width)) for i in range(n_bands)])
    banded = marks.select("rep", F.explode(keys).alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("pivot")).filter("c > 1")
    members = cut(banded.join(crowded, "key"), "members")
    star = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    star = cut(likely(star, marks, percent, m), "likely")
    crowd = members.select("rep").distinct()
    texts = cut(docs.select(F.col("doc_id").alias("rep"), "text").join(crowd, "rep", "left_semi"), "texts")

    # Each member's most likely partner first: this joins nearly all that belongs together.
    first = star.groupBy("b").agg(F.max_by("a", F.struct(F.col("estimate"), -F.col("a"))).alias("a")).select("a", "b")
    links = cut(verified(first, texts, k, percent), "links")
    comps = components(links)
    rest = _apart(star.join(first, ["a", "b"], "left_anti"), comps)
    more = cut(verified(rest, texts, k, percent), "links")
    if not more.isEmpty():
        comps = components(links.union(more))
    links = links.union(more)

    open_members = members.filter("c > 2").join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    several = open_members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_members = cut(open_members.join(several, "key", "left_semi"), "open")
    if not open_members.isEmpty():
        open_members = open_members.join(marks.select("rep", "n"), "rep").select("key", "rep", "comp", "n")
        late = cut(_blocks(open_members, texts, k, percent), "links")
        if not late.isEmpty():
            comps = components(links.union(late))
    drop_cut(members, star, texts, links)  # components are written: nothing reads these any more

    classes = reps.select("n", "one", "two", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("n", "one", "two", F.coalesce("comp", "rep").alias("comp"))
    # A set that a third of the rows share makes one large partition of thin rows here, which
    # AQE splits where it is beyond spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes.
    out = sketched.select("doc_id", "n", "one", "two").join(classes, ["n", "one", "two"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    of = lambda s: comps.select(F.col("id").alias(s), F.col("comp").alias(f"comp_{s}"))
    both = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")


def op2_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
