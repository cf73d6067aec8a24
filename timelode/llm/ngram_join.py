"""Set similarity join on word shingles: Jaccard of at least 0.8, by a size-aware heavy-light join.

Light sets, up to a size where that is cheaper, enumerate subsets of fixed size: two sets of n and m shingles
link exactly when they share a subset of ceil(0.8 (n + m) / 1.8), so equal subsets link without comparison,
and all that share one link in a star. Heavy sets go through inverted lists. A set enters the lists of its
first n - ceil(0.8 n) + 1 shingles in one fixed order, by which sets that link must meet in a list; the order
puts shingles that repeat most over the corpus last, so that lists of common passages stay out of the way.

Lists are scanned in rounds. In the first, each set is compared with the nearest of its lists' centres, one
to a list, and what links is merged into components. Then, in lists that hold several components, sets
outside the list's largest one look for their nearest among new centres from within it; a component, not a
set, has a few tries a round, and what links is an edge between two components. What rounds leave is settled
exactly: the pairs of a list whose sets are still in different components, the largest one's members among
themselves left out, in blocks of BLOCK_ROWS so that a list of any length is spread over tasks. Pairs are
dropped early by size, by position, and by parity sketches, whose Hamming distance bounds the symmetric
difference, in the condition of the join; the rest is compared exactly, on sets made anew from the texts in
question. None of this loses a link between different components, so components are exact.

Sets are identified by two 64-bit sums of mixed shingle hashes, and equal sets are one node, so copies cost
nothing beyond their own shingles.

Cases: null, empty and wordless texts have no shingles and link with nothing; fewer than five words make one
shingle; a null doc_id has a null component and links nothing; rows of one doc_id count as one document: each
row's n_shingles is its own, but of several texts the greatest set (by size, then identity) speaks for the
document, and all its rows get that one's component.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.llm._common import discard, lean, small_batches, table, text_slices, written
from timelode.llm._words import mix, scan, shingles
from timelode.llm.components import merged

WORDS, PERCENT = 5, 80
#: Repeated shingles that the order knows, at most: the most frequent ones. It bounds what is broadcast, not what is found.
HOT_ROWS = 500_000
#: Sets up to this size may be light; where the boundary lies is a matter of cost.
LIGHT_MOST = 9
#: What a candidate comparison costs, in rows moved.
COMPARISON = 40
#: Rounds of centres; after the first: pairs that a component tries, centres of a list, and the length from which lists take part.
ROUNDS, TRIES, CENTRES, LONG = 4, 4, 8, 24
#: Rows of a list that one task compares with the others.
BLOCK_ROWS = 2048
FLAG_BITS = 23
#: 64-bit words of a sketch, and of the wider one that sets above WIDE_FROM have beside it.
SKETCH, WIDE, WIDE_FROM = 8, 128, 512


def need(n: int, m: int, percent: int = PERCENT) -> int:
    """The least overlap of linked sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def least_partner(n: int, percent: int = PERCENT) -> int:
    """The least size of a set that can link with one of n."""
    return -(-percent * n // 100)


def prefix(n):
    """How many shingles of a set of n go to inverted lists."""
    return n - -(-PERCENT * n // 100) + 1


def subset_plan(most: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each light size: (smaller size, larger size, subset size) of the partnerships it can enter."""
    return {n: [(*sorted((n, m)), need(n, m)) for m in range(least_partner(n), most + 1) if least_partner(m) <= n] for n in range(1, most + 1)}


def boundary(repeats: float) -> int:
    """The largest light size: up to it, enumerating subsets costs no more than the lists would, given the share of shingles that repeat."""
    best = 0
    for n in range(1, LIGHT_MOST + 1):
        keys = sum(comb(n, o) for _, _, o in subset_plan(LIGHT_MOST)[n])
        if keys > prefix(n) * (2 + COMPARISON * repeats):
            break
        best = n
    return best


def repeated(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes, counts, share): shingles found in several documents of a batch, most frequent ones if too many, and their share of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, seen = [], set()
            for _, _, data, offsets in text_slices(batch.column(0)):
                h, first = shingles(scan(data, offsets), WORDS)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    u = np.unique(h[a:b])
                    key = (len(u), int(u.sum()))
                    if len(u) and key not in seen:
                        seen.add(key)
                        parts.append(u)
            if parts:
                u, n = np.unique(np.concatenate(parts), return_counts=True)
                many = n > 1
                hashes = pa.array(np.append(u[many].astype(np.int64), 0), mask=np.append(np.zeros(many.sum(), bool), True))
                yield pa.RecordBatch.from_arrays([hashes, pa.array(np.append(n[many], n.sum()).astype(np.int64))], ["h", "n"])

    counts = written(docs.select("text").mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "repeated-shingles")
    # One row for each power of two.
    level = F.floor(F.log2("n")).cast("int")
    levels = {r.level: (r.rows, r.n) for r in counts.filter("h IS NOT NULL").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    total = counts.filter("h IS NULL").agg(F.sum("n")).first()[0] or 0
    least, rows = 2**40, 0
    for k in sorted(levels, reverse=True):
        rows += levels[k][0]
        if rows > HOT_ROWS or k < 3:
            break
        least = 2**k
    hot = counts.filter(F.col("h").isNotNull() & (F.col("n") >= least)).toArrow()
    h, n = np.asarray(hot["h"]).astype(np.uint64) if hot.num_rows else np.zeros(0, np.uint64), np.asarray(hot["n"])
    order = np.argsort(h)
    return h[order], n[order], sum(x[1] for x in levels.values()) / max(1, total)


class Order:
    """The fixed order of shingles: a 64-bit key with the frequency level above the hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes = hashes
        self.level = np.minimum(63, 1 + 4 * np.log2(np.maximum(counts, 1) / 8 + 1)).astype(np.uint64)
        self.flag = np.zeros(1 << FLAG_BITS, bool)
        self.flag[(hashes >> np.uint64(64 - FLAG_BITS)).astype(np.int64)] = True

    def keys(self, h: np.ndarray) -> np.ndarray:
        out = h >> np.uint64(6)
        if len(self.hashes) and len(h):
            maybe = np.flatnonzero(self.flag[(h >> np.uint64(64 - FLAG_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[maybe]
            out[maybe[hit]] |= self.level[at[hit]] << np.uint64(58)
        return out


def sketch(u: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parities of a set's shingles in 64 * words cells."""
    cells = 64 * words
    odd = np.bincount((u & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _sets(batch_text: pa.Array, order: Order) -> Iterator[tuple[int, list[np.ndarray]]]:
    for i, _, data, offsets in text_slices(batch_text):
        h, first = shingles(scan(data, offsets), WORDS)
        keys, out = order.keys(h), []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            k = np.sort(keys[a:b])
            if len(k) > 1:
                k = k[np.concatenate([[True], k[1:] != k[:-1]])]
            out.append(k)
        yield i, out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int64) if arrays else np.zeros(0, np.int64)))


META = "doc_id long, n_shingles int, s1 long, s2 long, sketch array<long>, wide array<long>, prefix array<long>, light array<long>"
IDENTITY = ["n_shingles", "s1", "s2"]


def _identity(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, two sums of mixed hashes [2, sets]) of sets."""
    n = np.array([len(u) for u in sets], np.int32)
    sums, some = np.zeros((2, len(sets)), np.uint64), n > 0
    if some.any():
        flat, at = np.concatenate(sets), np.cumsum(n) - n
        for k in range(2):
            sums[k, some] = np.add.reduceat(mix(flat, 20 + k), at[some])
    return n, sums.astype(np.int64)


def described(docs: DataFrame, order, light: int) -> DataFrame:
    """Of each document: the size and identity of its set, its sketches, its prefix and, if it is light, the set itself."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Order(*order.value)
        for batch in small_batches(batches):
            for i, sets in _sets(batch.column(1), own):
                n, sums = _identity(sets)
                listed = [u[: prefix(len(u))] if len(u) * 100 > PERCENT * light else none for u in sets]
                columns = [batch.column(0).slice(i, len(sets)), pa.array(n), *map(pa.array, sums)]
                columns += [_lists([sketch(u) if len(p) else none for u, p in zip(sets, listed, strict=True)]), _lists([sketch(u, WIDE) if len(p) and len(u) > WIDE_FROM else none for u, p in zip(sets, listed, strict=True)])]
                columns += [_lists(listed), _lists([u if len(u) <= light else none for u in sets])]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in META.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), META)


def light_edges(nodes: DataFrame, most: int) -> DataFrame:
    """(a, b) edges that link all light sets which share a subset of the size that their sizes call for."""
    plan = subset_plan(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import combinations

        for batch in batches:
            ids, low, high, side, keys = [], [], [], [], []
            for node, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, u = len(values), np.array(values, np.int64).astype(np.uint64)
                for small, large, size in plan.get(n, ()):
                    for chosen in combinations(range(n), size):
                        ids.append(node)
                        low.append(small)
                        high.append(large)
                        side.append(n == large and small != large)
                        keys.append(u[list(chosen)])
            sums = [np.array([int(mix(k, s).sum()) for k in keys], np.uint64).astype(np.int64) for s in (31, 32)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(side, pa.bool_()), pa.array(sums[0]), pa.array(sums[1])], ["node", "low", "high", "larger", "k1", "k2"])

    key = ["low", "high", "k1", "k2"]
    rows = written(nodes.filter(F.size("light") > 0).select("node", "light").mapInArrow(lean(run), "node long, low int, high int, larger boolean, k1 long, k2 long"), "subsets")
    least = rows.groupBy(*key).agg(F.min(F.when(~F.col("larger"), F.col("node"))).alias("small"), F.min(F.when(F.col("larger"), F.col("node"))).alias("large"), F.count(F.lit(1)).alias("n"))
    # Sets of unequal sizes link across only; sets of one size link with each other.
    least = written(least.filter("n > 1 AND (low = high OR (small IS NOT NULL AND large IS NOT NULL))"), "subset-stars")
    partner = F.when((F.col("low") == F.col("high")) | F.col("larger"), F.col("small")).otherwise(F.col("large"))
    return rows.join(least, key).select(F.col("node").alias("a"), partner.alias("b")).filter("a <> b").distinct()


def _apart(x: str, y: str) -> Column:
    """The distance of sketches, a lower bound of the symmetric difference."""
    return sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH)), F.lit(0))


def _most_apart(n: Column, m: Column) -> Column:
    """The greatest symmetric difference of linked sets of n and m."""
    return n + m - 2 * F.ceil(PERCENT * (n + m) / (100 + PERCENT) - 1e-9)


def _near(x: str, y: str, positions: bool = True) -> Column:
    """Whether sizes, sketches and, of rows of one list, positions allow a link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    fits = 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)
    if positions:
        left = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
        fits = fits & ((100 + PERCENT) * left >= PERCENT * (n + m))
    return fits & (_apart(x, y) <= _most_apart(n, m))


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(F.col(f"{x}.node"), F.col(f"{y}.node")).alias("a"), F.greatest(F.col(f"{x}.node"), F.col(f"{y}.node")).alias("b")


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, order) -> DataFrame | None:
    """Those of pairs (a, b) that link, as a written table; None where there are none. Sets are made anew from the texts in question."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Order(*order.value)
        for batch in small_batches(batches, 1024):
            for i, made in _sets(batch.column(1), own):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(made)), pa.array(_identity(made)[1][0]), _lists(made)], ["node", "s1", "items"])

    wide = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}"))
    both = (F.size("wide_a") > 0) & (F.size("wide_b") > 0)
    far = F.aggregate(F.zip_with("wide_a", "wide_b", lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda s, v: s + v)
    near = F.when(both, far <= _most_apart(F.col("n_a"), F.col("n_b"))).otherwise(True)
    kept = written(pairs.join(wide("a"), "a").join(wide("b"), "b").filter(near).select("a", "b"), "pairs")
    if kept.isEmpty():
        return None
    asked = written(kept.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(asked, "node", "left_semi")
    # Of a repeated doc_id, only the text that speaks for it, once.
    full = texts.mapInArrow(lean(sets), "node long, s1 long, items array<long>").join(nodes.select("node", "s1"), ["node", "s1"], "left_semi")
    full = written(full.dropDuplicates(["node"]).select("node", "items"), "sets")
    side = lambda x: full.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))
    links = (100 + PERCENT) * F.size(F.array_intersect("items_a", "items_b")) >= PERCENT * (F.size("items_a") + F.size("items_b"))
    out = written(kept.join(side("a"), "a").join(side("b"), "b").filter(links).select("a", "b"), "links")
    for used in (full, asked, kept):
        discard(used)
    return None if out.isEmpty() else out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    hashes, counts, share = repeated(docs)
    light = boundary(share)
    order = spark.sparkContext.broadcast((hashes, counts))
    meta = written(described(docs, order, light).withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    speaks = F.max(F.struct(*IDENTITY, "row")).alias("m")
    own = written(meta.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(speaks).select("doc_id", "m.*"), "own-sets")
    head = F.min(F.struct("doc_id", "row")).alias("k")
    equal = written(own.groupBy(*IDENTITY).agg(head).select(*IDENTITY, F.col("k.doc_id").alias("node"), F.col("k.row").alias("row")), "equal-sets")
    heads = meta.drop(*IDENTITY).join(equal, "row").withColumn("n", F.col("n_shingles"))
    nodes = written(heads.select("node", "n", "s1", "sketch", "wide"), "nodes")
    labels = None
    if light:
        links = written(light_edges(heads.select("node", "light"), light), "light-links")
        labels = None if links.isEmpty() else merged(None, links)

    postings = heads.select("node", F.posexplode("prefix").alias("pos", "h"))
    shared = postings.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("centre")).filter("size > 1")
    lists = written(postings.join(shared, "h").select("h", "node", "pos", "size", "centre"), "inverted-lists")
    done = spark.createDataFrame([], "a long, b long")
    for k in range(ROUNDS):
        pairs = written(_nearest_centres(lists, nodes) if not k else _among_components(split_lists(lists.filter(F.col("size") >= LONG), labels, nodes), done, k), "centre-pairs")
        found, done = linked(pairs, nodes, docs, order), done.unionByName(pairs)
        if found is None:
            break
        labels = merged(labels, found)
    rest = written(remaining(split_lists(lists, labels, nodes), done), "remaining-pairs")
    if (found := linked(rest, nodes, docs, order)) is not None:
        labels = merged(labels, found)
    out = meta.select("doc_id", "n_shingles")
    of_set = equal.withColumn("label", F.col("node")) if labels is None else equal.join(labels, "node", "left")
    of_set = of_set.select(*IDENTITY, F.coalesce("label", "node").alias("component"))
    of_doc = own.join(of_set, IDENTITY).select("doc_id", "component")
    return out.join(of_doc, "doc_id", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _nearest_centres(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): each set with the nearest, by sketches, of the centres of its lists that may link with it."""
    met = lists.filter("node <> centre").select(F.col("node").alias("one"), "centre").distinct()
    x, y = nodes.drop("wide").alias("x"), nodes.drop("wide").alias("y")
    met = met.join(x, F.col("one") == F.col("x.node")).join(y, F.col("centre") == F.col("y.node")).filter(_near("x", "y", positions=False))
    best = met.groupBy("one").agg(F.min(F.struct(_apart("x", "y").alias("apart"), "centre")).alias("best"))
    return best.select(F.least("one", "best.centre").alias("a"), F.greatest("one", "best.centre").alias("b")).distinct()


def _among_components(split: DataFrame, done: DataFrame, k: int) -> DataFrame:
    """(a, b) not in done: of each component, the nearest TRIES pairs with centres from the largest components of its lists, other ones in each round k."""
    place = F.xxhash64("node", "h", F.lit(k))
    within = split.filter("comp = main").groupBy("h", F.pmod(place, F.lit(CENTRES)).alias("nth")).agg(F.min(F.struct(place.alias("place"), "node", "n", "pos", "sketch")).alias("c"))
    centres = written(within.select("h", "c.node", "c.n", "c.pos", "c.sketch"), "list-centres")
    met = split.filter("comp <> main").alias("x").join(centres.alias("y"), "h").filter(_near("x", "y"))
    met = met.select("x.comp", _apart("x", "y").alias("apart"), *_pair("x", "y")).distinct().join(done, ["a", "b"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("comp").orderBy("apart", "a", "b"))
    return met.withColumn("nth", nth).filter(F.col("nth") <= TRIES).select("a", "b").distinct()


def split_lists(lists: DataFrame, labels: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """(h, node, n, pos, comp, main, blocks, sketch): those of lists that hold several components, with each row's component, the list's largest, and how many blocks of BLOCK_ROWS it makes."""
    rows = lists.select("h", "node", "pos")
    rows = rows.withColumn("comp", F.col("node")) if labels is None else rows.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    rows = written(rows, "labelled-lists")
    sizes = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("h").agg(F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("size").alias("all"))
    several = largest.filter("comps > 1").select("h", F.col("top.comp").alias("main"), F.ceil(F.col("all") / BLOCK_ROWS).cast("int").alias("blocks"))
    out = rows.join(several, "h").join(nodes.select("node", "n", "sketch"), "node").select("h", "node", "n", "pos", "comp", "main", "blocks", "sketch")
    out = written(out, "split-list-rows")
    discard(rows)
    return out


def remaining(split: DataFrame, done: DataFrame) -> DataFrame:
    """The pairs between components that still meet in lists, without those in done. At least one of a pair is outside its list's largest component; it stays in its block, and the other goes to all blocks of the list."""
    x = split.filter("comp <> main").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    y = split.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = x.alias("x").join(y.alias("y"), ["h", "block"]).filter((F.col("x.comp") != F.col("y.comp")) & _near("x", "y"))
    return met.select(*_pair("x", "y")).distinct().join(done, ["a", "b"], "left_anti")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those that are near-duplicates of a document of smaller id."""
    dropped = near_duplicates(docs).filter("component_id <> doc_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLES: dict[str, str] = {}
