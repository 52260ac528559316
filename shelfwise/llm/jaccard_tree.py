"""N-gram Jaccard join: signature trees over sets that share a rare shingle, traversed in pairs of nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.blocks import column_bytes, mixed
from shelfwise.llm.components import components
from shelfwise.llm.minhash import shingle_sets
from shelfwise.llm.shared import settled, union

#: Greatest sizes of the first size classes, and the bits of a token bitmap in each class: trees hold one class.
LIMITS = (350, 700, 1400, 2800, 5600, 11_200)
BITS = (1024, 2048, 4096, 8192, 16_384, 32_768, 65_536)
#: Children of a node.
FANOUT = 8
#: Members of a tree whose bitmaps alone are held; shingles, and EACH more a set, of one whose sets are held.
MEMBERS = 2048
SHINGLES = 1 << 22
EACH = 256
#: Buckets of the shingle counts that say which shingles are rare: a table of fixed size.
BUCKETS = 1 << 16
_DOCS = "id long, n long, k1 long, k2 long, counts array<long>"


# ---- sets and the shingles they meet by ------------------------------------------------


def _described(width: int):
    """Each set's size and 128 bits that tell it apart; last, with size -1, how many of a task's sets hold a shingle of each bucket."""
    salts = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))
    names = [f.split()[0] for f in _DOCS.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            row = 0
            for sets in shingle_sets(batch.column(1), width):
                sizes = np.array([len(s) for s in sets])
                at = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.concatenate(sets)
                counts += np.bincount((flat & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat ^ s), dtype=np.uint64)]) for s in salts]
                keys = [pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums]
                none = pa.nulls(len(sets), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array(sizes), *keys, none], names)
                row += len(sets)
        last = [pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([0]), pa.array([0]), pa.array([counts.tolist()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(last, names)

    return build


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values as unsigned, offsets) of a list column."""
    offsets = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values).view(np.uint64)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _ranks(described: DataFrame) -> np.ndarray:
    """Each bucket's place when buckets stand by the shingles counted in them, over all sets; rare ones first."""
    counted = described.select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for row in counted.collect():  # BUCKETS rows at most
        counts[row["bucket"]] = row["n"]
    ranks = np.empty(BUCKETS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return ranks


def _prefixes(ranks: np.ndarray, width: int, percent: int):
    """(id, token) of each set's first tokens in the common order.

    Two sets that meet the threshold share ``percent`` of each at least, so one of the first
    n - ceil(percent n / 100) + 1 tokens of both. A token is the shingle's hash with the rank of its
    low 16 bits put first, a bijection; rare buckets come first, so a passage that many sets share
    is met by only where a set holds hardly anything else.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for sets in shingle_sets(batch.column(1), width):
                ids = np.asarray(batch.column(0).slice(row, len(sets)))
                row += len(sets)
                kept, sizes = [], []
                for one in sets:
                    first = len(one) - -(-percent * len(one) // 100) + 1 if len(one) else 0
                    if first:
                        tokens = (ranks[(one & np.uint64(BUCKETS - 1)).astype(np.int64)] << np.uint64(48)) | (one >> np.uint64(16))
                        kept.append(np.partition(tokens, first - 1)[:first])
                    sizes.append(first)
                if kept:
                    tokens = pa.array(np.concatenate(kept).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), tokens], ["id", "token"])

    return build


def _shingled(width: int):
    """(id, n, shingles) of sets that are not empty."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for sets in shingle_sets(batch.column(1), width):
                sizes = np.array([len(s) for s in sets])
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array(sizes), lists], ["id", "n", "shingles"])
                yield rows.filter(pa.array(sizes > 0))
                row += len(sets)

    return build


def _bitmaps(flat: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """One row of packed bits for each set: a bit for each token, tokens that fall together sharing one."""
    out = np.empty((len(at) - 1, bits // 64), np.uint64)
    place = (mixed(flat) % np.uint64(bits)).astype(np.int64)
    rows = max(1, (1 << 22) // bits)
    for a in range(0, len(out), rows):
        b = min(a + rows, len(out))
        dense = np.zeros((b - a, bits), bool)
        dense[np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), place[at[a] : at[b]]] = True
        out[a:b] = np.packbits(dense, axis=1).view(np.uint64)
    return out


def size_classes(n: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(class, which sizes have it): the class a size falls in, and the next for sizes that may be linked with larger ones there."""
    least, most = np.array((0, *LIMITS)), np.array((*LIMITS, np.iinfo(np.int64).max))
    for k in range(len(least)):
        yield k, (100 * n >= percent * least[k]) & (n > 0) & (n <= most[k])


def _signed(width: int, percent: int):
    """(id, n, kind, bits) of sets in each of their size classes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for sets in shingle_sets(batch.column(1), width):
                ids = batch.column(0).slice(row, len(sets))
                row += len(sets)
                n = np.array([len(s) for s in sets])
                for kind, chosen in size_classes(n, percent):
                    rows = np.flatnonzero(chosen)
                    if len(rows):
                        at = np.concatenate([[0], np.cumsum(n[rows])])
                        bits = _bitmaps(np.concatenate([sets[k] for k in rows]), at, BITS[kind])
                        columns = [ids.take(pa.array(rows)), pa.array(n[rows]), pa.array(np.full(len(rows), kind)), pa.array([r.tobytes() for r in bits], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["id", "n", "kind", "bits"])

    return build


# ---- trees ---------------------------------------------------------------------------


class SignatureTree:
    """Nodes over runs of sets ordered by size: the OR of their bitmaps, their least and greatest size, and
    their greatest spare, the tokens of a set beyond its bits.

    Level 0 has the sets themselves, level h one node for each FANOUT nodes of level h - 1.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        spare = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, spare)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            node = (np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at))
            self.levels.append(node)

    def below(self, level: int, node: int) -> tuple[int, int]:
        """The range of a node's sets."""
        width = FANOUT**level
        return node * width, min((node + 1) * width, len(self.levels[0][0]))

    def children(self, level: int, node: int) -> tuple[int, int]:
        return node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0]))


def _possible(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a pair of sets that meets the threshold.

    Sets of two nodes have at most as many tokens in common as both ORs have bits, and one more
    for each token that shares a bit of its own set: the lesser spare of the two nodes. Sizes x and
    y need percent (x + y) / (100 + percent) in common, which the smaller one must hold.
    """
    common = np.bitwise_count(a[0][:, None] & b[0][None]).sum(2, dtype=np.int64) + np.minimum(a[3][:, None], b[3][None])
    common = np.minimum(common, np.minimum(a[2][:, None], b[2][None]))
    return common * (100 + percent) >= percent * (a[1][:, None] + b[1][None])


def traverse(left: SignatureTree, right: SignatureTree, labels_left: np.ndarray, labels: np.ndarray, percent: int, linked: Callable) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets that join components: a dual descent through two trees, or one with itself.

    ``labels_left`` says where the sets of ``left`` have their component in ``labels``, which
    holds those of ``right`` and is renamed as pairs are found. Pairs of nodes are dropped when
    the bound rules out every pair of sets below, or when all sets below are in one component:
    a link there would change nothing. ``linked(i, j)`` decides about two sets.
    """
    out: list[tuple[int, int]] = []
    one = left is right

    def joined(h: int, i: int, g: int, j: int) -> bool:
        a, b = left.below(h, i)
        c, d = right.below(g, j)
        first = labels[labels_left[a]]
        return bool((labels[labels_left[a:b]] == first).all() and (labels[c:d] == first).all())

    tops = len(left.levels) - 1, len(right.levels) - 1
    stack = [(tops[0], 0, tops[1], 0)]
    while stack:
        h, i, g, j = stack.pop()
        if joined(h, i, g, j):
            continue
        if h == 0 and g == 0:
            if labels[labels_left[i]] != labels[j] and linked(i, j):
                out.append((i, j))
                labels[labels == labels[labels_left[i]]] = labels[j]
            continue
        # the higher node opens; a node met with itself opens on both sides
        both = h == g
        a, b = left.children(h, i) if h >= g else (i, i + 1)
        c, d = right.children(g, j) if g >= h else (j, j + 1)
        lh, rg = (h - 1 if h >= g else h), (g - 1 if g >= h else g)
        inner = _possible([x[a:b] for x in left.levels[lh]], [x[c:d] for x in right.levels[rg]], percent)
        if one and both and i == j:
            inner = np.triu(inner, 1 if lh == 0 else 0)
        for x, y in np.argwhere(inner)[::-1].tolist():
            stack.append((lh, a + x, rg, c + y))
    return out


def _tasklets(batches: Iterator[pa.RecordBatch], read: Callable, keys: int) -> Iterator[list[np.ndarray]]:
    """The rows of each key, as columns; rows come sorted by their first ``keys`` columns."""
    held = None
    for batch in batches:
        columns = read(batch)
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        turn = np.zeros(max(len(columns[0]) - 1, 0), bool)
        for key in columns[:keys]:
            turn |= key[1:] != key[:-1]
        cuts = [0, *(np.flatnonzero(turn) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield [c[a:b] for c in columns]
        held = [c[cuts[-1] :] for c in columns]
    if held is not None and len(held[0]):
        yield held


def _pairs(columns: list[np.ndarray], names: tuple = ("a", "b")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], list(names))


def _objects(rows: list) -> np.ndarray:
    out = np.empty(len(rows), object)
    out[:] = rows
    return out


def _forests(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair: what names the pairs of its label, the same wherever these pairs are found, and their number."""
    _, at = np.unique(labels, return_inverse=True)
    each = mixed(mixed(a.view(np.uint64)) + b.view(np.uint64))
    names = np.zeros(at.max() + 1, np.uint64)
    np.add.at(names, at, each)
    return names[at].view(np.int64), np.bincount(at)[at]


def _proposing(percent: int):
    """(forest, pairs, a, b): pairs that bitmaps and sizes allow, as few as join all members that they allow to be joined.

    Members that they join are a forest of so many ``pairs``; members of different forests are not linked.
    """

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [*(np.asarray(batch.column(j)) for j in range(5)), _objects(batch.column(5).to_pylist())]

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("forest", "pairs", "a", "b")
        held: list[tuple[np.ndarray, ...]] = []
        for _, _, _, n, id, bits in _tasklets(batches, read, 3):
            if len(id) == 1:
                continue
            tree = SignatureTree(np.frombuffer(b"".join(bits), np.uint64).reshape(len(id), -1), n)
            _, labels = np.unique(id, return_inverse=True)
            found = np.array(traverse(tree, tree, np.arange(len(id)), labels, percent, lambda i, j: True), np.int64).reshape(-1, 2)
            if len(found):
                ends = np.sort(id[found], axis=1)
                a, b = ends[:, 0].copy(), ends[:, 1].copy()
                held.append((*_forests(a, b, labels[found[:, 0]]), a, b))
            if len(held) > 1000:
                yield _pairs([np.concatenate(c) for c in zip(*held)], names)
                held = []
        if held:
            yield _pairs([np.concatenate(c) for c in zip(*held)], names)

    return propose


def _proving(percent: int):
    """(a, b): links between components, on whole sets; members ``asked`` 1 against those with 0, such with 2 on both sides."""

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        flat, at = _lists(batch.column(8))
        sets = [flat[a:b].copy() for a, b in zip(at[:-1], at[1:])]
        return [*(np.asarray(batch.column(j).cast(pa.int64())) for j in range(8)), _objects(sets)]

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, asked, n, id, component, sets in _tasklets(batches, read, 4):
            _, labels = np.unique(component, return_inverse=True)
            for kind, chosen in size_classes(n, percent):
                left, right = (np.flatnonzero(chosen & (asked != other)) for other in (0, 1))
                if not len(left) or not len(right):
                    continue
                trees = []
                for side in (left, right):
                    at = np.concatenate([[0], np.cumsum([len(s) for s in sets[side]])])
                    trees.append(SignatureTree(_bitmaps(np.concatenate(sets[side]), at, BITS[kind]), n[side]))
                # labels of both sides in one array, the right side first
                both = np.concatenate([labels[right], labels[left]])
                places = np.arange(len(right), len(both))
                found = traverse(*trees, places, both, percent, lambda i, j: linked(sets[left[i]], sets[right[j]]))
                if found:
                    i, j = np.array(found, np.int64).T
                    yield _pairs([id[left[i]], id[right[j]]])

    return prove


# ---- the join --------------------------------------------------------------------------


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets meet the threshold."""
    whole = sets.select("id", "shingles")
    both = pairs.join(whole.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        whole.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    sized = both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("n"))
    return sized.filter(F.col("c") * (100 + percent) >= F.col("n") * percent).select("a", "b").distinct()


def _met(keys: DataFrame) -> DataFrame:
    """(g, id) of tokens that several rows have in their prefix; of tokens with the same rows one.

    Counting the rows of a token and finding them read the same shuffle, so the keys are made and moved once.
    """
    h = F.xxhash64("id")
    dealt = keys.repartition("token")
    seen = dealt.groupBy("token").agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"), F.bit_xor(h).alias("x"))
    repeated = settled(dealt.join(seen.filter("n > 1").hint("merge"), "token").select("token", "id", "n", "s", "x"))
    met = settled(repeated.groupBy("n", "s", "x").agg(F.min("token").alias("token")).select("token"))
    return repeated.select("token", "id").join(met, "token").select(F.col("token").alias("g"), "id")


def _copies(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member edges a to b, ids all of whose sets another id stands for): equal sets are named by their smallest id."""
    classes = settled(known.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").drop("last"))
    named = settled(known.join(classes, ["k1", "k2"], "left").select("id", F.coalesce("rep", "id").alias("rep")))
    edges = named.filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    stands = named.groupBy("id").agg(F.max((F.col("id") == F.col("rep")).cast("int")).alias("own"))
    return edges, stands.filter("own = 0").select("id")


def _chunked(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, part, id): members dealt to trees of bounded size, the group's lowest id in each."""
    parts = F.ceil(F.col("size") / F.lit(MEMBERS)).cast("long")
    dealt = members.select("g", F.pmod(F.xxhash64("id", "g"), parts).alias("part"), "id")
    cut = groups.filter(F.col("size") > MEMBERS).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.unionByName(cut.select("g", "part", F.col("low").alias("id")))


def _sized(chunks: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(g, part, id, low) of members with another of a size that allows a link: then the next smaller or larger one has it.

    ``low`` is the least hash of a tree's members: trees with many common members often have it in common.
    """
    known = chunks.join(sizes, "id")
    order = Window.partitionBy("g", "part").orderBy("n", "id")
    near = known.withColumn("less", F.lag("n").over(order)).withColumn("more", F.lead("n").over(order))
    near = near.filter((F.col("less") * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.col("more") * percent))
    low = F.min(F.xxhash64("id")).over(Window.partitionBy("g", "part"))
    return near.select("g", "part", "id", low.alias("low")).distinct()


def _merged(sized: DataFrame) -> DataFrame:
    """(g, part, id): the trees of whole groups with the same ``low`` as one, part -1, where that holds MEMBERS at most.

    A set stands in a tree for each passage that it shares with others, and often those are the same others.
    A tree of more members than one group has misses no pair of them.
    """
    whole = settled(sized.filter("part = 0").select("low", "id").distinct())
    wide = settled(whole.groupBy("low").agg(F.count("*").alias("members")).filter(F.col("members") > MEMBERS).select("low", F.lit(True).alias("wide")))
    one = whole.join(wide, "low", "left_anti").select(F.col("low").alias("g"), F.lit(-1).cast("long").alias("part"), "id")
    apart = sized.join(wide, "low", "left").filter(F.col("wide") | (F.col("part") != 0)).select("g", "part", "id")
    return one.unionByName(apart)


def _told_apart(chunks: DataFrame) -> DataFrame:
    """Of trees (g, part) with the same members one: what holds for its pairs holds for the others'."""
    h = F.xxhash64("id")
    prints = chunks.groupBy("g", "part").agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"), F.bit_xor(h).alias("x"))
    first = prints.groupBy("n", "s", "x").agg(F.min(F.struct("g", "part")).alias("tree")).select("tree.*")
    return chunks.join(first, ["g", "part"], "left_semi")


def _still_open(members: DataFrame, proposed: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """(g, id, component_id, main): members of several components that were not compared to the end, in clusters.

    Those are members of a forest with a pair that proved no link, as other pairs of it may have been passed over for that
    one, and of groups cut into several trees. What has a member in common makes one cluster g, so
    a member goes on once, however many shingles it met others by. ``main`` is the cluster's largest component.
    """
    forests = proposed.filter("pairs > 1")
    forests = forests.join(settled(forests.join(links, ["a", "b"], "left_anti").select("forest").distinct()), "forest", "left_semi")
    ends = forests.select(F.col("forest").alias("g"), F.explode(F.array("a", "b")).alias("id")).distinct()
    cut = members.filter(F.col("size") > MEMBERS).select("g", "id")
    labelled = settled(ends.unionByName(cut).join(found, "id", "left").withColumn("component_id", F.coalesce("component_id", "id")))
    several = labelled.groupBy("g").agg(F.min("component_id").alias("first"), F.max("component_id").alias("last"), F.min("id").alias("low")).filter("first != last")
    unfinished = settled(labelled.join(several.select("g", "low"), "g").select("id", "low", "component_id").distinct())
    cluster = components(unfinished.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component_id", "g")
    rows = settled(unfinished.select("id", "component_id").distinct().join(cluster, "id"))
    sizes = rows.groupBy("g", "component_id").agg(F.count("*").alias("n"))
    main = sizes.groupBy("g").agg(F.max_by("component_id", F.struct("n", "component_id")).alias("main"), F.count("*").alias("parts"))
    return rows.join(main.filter("parts > 1").drop("parts"), "g").select("g", "id", "component_id", "main")


def _celled(open_: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(g, cell, n, id, component_id, outside): members of the open clusters by size, where a cell holds several components.

    Cell c holds sizes from 2^(c-1) up to 2^c, and the smaller ones that the threshold lets link with those.
    """
    cells = F.explode(F.sequence(F.length(F.bin("n")), F.length(F.bin(F.floor(F.col("n") * 100 / percent)))))
    outside = F.col("component_id") != F.col("main")
    rows = settled(open_.join(sizes, "id").select("g", cells.alias("cell"), "n", "id", "component_id", outside.alias("outside")))
    several = rows.groupBy("g", "cell").agg(F.min("component_id").alias("first"), F.max("component_id").alias("last")).filter("first != last")
    return rows.join(several.select("g", "cell"), ["g", "cell"], "left_semi")


def _across(celled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of the open clusters: members outside a cluster's main component against all others of their cells.

    Where a cell holds more than a tree takes, both sides are dealt to trees by their shingles, every tree of one side
    to every tree of the other; else each member stands in it once for both sides.
    """
    weight = F.col("n") + EACH
    weights = celled.groupBy("g", "cell").agg(
        F.coalesce(F.ceil(F.sum(F.when(F.col("outside"), weight)) / F.lit(SHINGLES)).cast("long"), F.lit(0).cast("long")).alias("lefts"),
        F.ceil(F.sum(weight) / F.lit(SHINGLES)).cast("long").alias("rights"),
    )
    sized = settled(celled.join(weights.filter("lefts > 0"), ["g", "cell"]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id", "g", "cell"), F.col(n))
    columns = ["g", "cell", "l", "r", "asked", "n", "id", "component_id"]
    zero, whole = F.lit(0).cast("long"), F.col("rights") == 1
    both = sized.filter(whole).withColumn("l", zero).withColumn("r", zero).withColumn("asked", F.when(F.col("outside"), 2).otherwise(0))
    cut = sized.filter(~whole)
    asked = cut.filter("outside").withColumn("asked", F.lit(1)).withColumn("l", own("lefts")).withColumn("r", every("rights"))
    against = cut.withColumn("asked", F.lit(0)).withColumn("r", own("rights")).withColumn("l", every("lefts"))
    rows = union(*[x.select(columns) for x in (both, asked, against)]).join(sets.select("id", F.col("n").alias("m"), "shingles"), "id")
    rows = rows.filter("n = m").select(*columns, "shingles")
    keys = ["g", "cell", "l", "r"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n", "id").mapInArrow(_proving(percent), "a long, b long")


def jaccard_join(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents whose word n-grams overlap.

    A-Z are lowered, words are runs of bytes other than space and 0x09-0x0D, a document's set holds its
    distinct ``width``-word shingles, or its whole word sequence when that is shorter. Sets are linked
    when 100 * intersection >= ``percent`` * union; a class is a connected component of links, named by
    its smallest id. No link between different sets is lost: the join is exact.

    Equal sets become one. The others meet in groups by the rare shingles that a linked pair must share
    one of (``_prefixes``). Each group is a signature tree, or several of bounded size with one member in common;
    the dual traversal (``traverse``) drops pairs of nodes by the most tokens their sets can have in
    common, and pairs of nodes that are one component already. Groups that are likely to have the same members are one tree
    (``_merged``). What it proposes is confirmed on whole sets. Where a proposal fails, the members that proposals joined with
    it go on, as do those of a group that took several trees: what has common members becomes a cluster, and its
    members outside the main component are traversed against all others once more, deciding on whole sets.

    Defined cases: a null or wordless text has an empty set and is linked with nothing. A row without id is
    not linked, its component null. Rows that repeat an id are one document, linked through any of its texts, each
    row in the result. Other columns are ignored.
    """
    docs = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    described = settled(docs.mapInArrow(_described(width), _DOCS))
    all_ = described.filter("n >= 0").select("id", "n")
    edges, copies = _copies(described.filter("id is not null and n > 0").select("id", "k1", "k2"))
    edges = settled(edges)

    keys = docs.filter("id is not null").mapInArrow(_prefixes(_ranks(described), width, percent), "id long, token long")
    # copies leave after: the planner would move all keys by id for them first
    rows = settled(settled(_met(keys)).join(copies, "id", "left_anti").distinct())
    groups = rows.groupBy("g").agg(F.count("*").alias("size"), F.min("id").alias("low")).filter("size > 1")
    groups = settled(groups)
    members = settled(rows.join(groups, "g"))
    sizes = settled(all_.join(members.select("id").distinct(), "id", "left_semi").filter("n > 0").distinct())
    chunks = settled(_told_apart(settled(_merged(settled(_sized(_chunked(members, groups), sizes, percent))))))
    text_of = lambda ids: docs.join(ids.distinct(), "id").select("id", "text")
    # of all documents: bitmaps are a fraction of the texts, which a join with the members would move
    signed = settled(docs.filter("id is not null").mapInArrow(_signed(width, percent), "id long, n long, kind long, bits binary"))
    trees = chunks.join(signed, "id").select("g", "part", "kind", "n", "id", "bits")
    ordered = trees.repartition("g", "part", "kind").sortWithinPartitions("g", "part", "kind", "n", "id")
    # the same forest is found in every tree that holds its members
    proposed = settled(ordered.mapInArrow(_proposing(percent), "forest long, pairs long, a long, b long").distinct())
    shingled = lambda ids: settled(text_of(ids).mapInArrow(_shingled(width), "id long, n long, shingles array<long>"))
    pairs = settled(proposed.select("a", "b").distinct())
    links = settled(_confirmed(pairs, shingled(pairs.select(F.explode(F.array("a", "b")).alias("id"))), percent))
    open_ = settled(_still_open(members, proposed, links, components(links)))
    if not open_.isEmpty():
        celled = settled(_celled(open_, sizes, percent))
        links = union(links, settled(_across(celled, shingled(celled.select("id")), percent)))
    found = settled(components(union(links, edges)))
    return all_.join(found, "id", "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
