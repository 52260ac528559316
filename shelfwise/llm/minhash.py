"""Near-duplicate documents: b-bit MinHash with exact confirmation on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.blocks import Words, column_bytes, mixed, runs_of, sliced
from shelfwise.llm.components import components
from shelfwise.llm.shared import settled, union

BAND_ROWS = 4
BITS = 1
FIELDS = 2048
QUICK = 512
SLICE = 2000
_LOW = sum(1 << (BITS * i) for i in range(64 // BITS)) if BITS > 1 else -1


def bands_for(percent: int, miss: float) -> int:
    """Bands of four rows that leave a pair at the threshold without a common band with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** BAND_ROWS)))


def least_matches(percent: int, n: int) -> int:
    """Equal b-bit fields of ``n`` that a pair at the threshold falls short of once in three million.

    Unequal minima still agree in their low bits once in 2^b, so J of similarity shows as
    J + (1 - J) / 2^b of equal fields; the slack is 5 standard deviations of that share.
    """
    chance = 2.0**-BITS
    share = percent / 100 * (1 - chance) + chance
    return max(0, math.floor(n * share - 5 * math.sqrt(n * share * (1 - share))))


def shingle_sets(column: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """For blocks of rows: each row's sorted distinct shingle hashes (see ``near_duplicates``)."""
    data, offsets = column_bytes(column)
    for first, last in sliced(offsets):
        words = Words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lower=True)
        hashes = words.hashes()
        sets = []
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            sets.append(np.unique(runs_of(hashes[a:b], min(width, b - a))) if b > a else hashes[:0])
        yield sets


def _lists(values: np.ndarray, size: int, present: np.ndarray) -> pa.Array:
    """One list of ``size`` longs for each row of ``present``, an empty one where it is false."""
    at = np.concatenate([[0], np.cumsum(np.where(present, size, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64).ravel()))


def _minima(sets: list[np.ndarray], random: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which sets have shingles, their minima under each permutation x -> a x + b of the 64-bit hashes)."""
    sizes = np.array([len(s) for s in sets])
    present = sizes > 0
    at = np.concatenate([[0], np.cumsum(sizes[present])])[:-1]
    least = np.zeros((at.size, random.shape[1]), np.uint64)
    if at.size:
        flat = np.concatenate(sets)
        for j, (a, b) in enumerate(random.T):
            least[:, j] = np.minimum.reduceat(flat * a + b, at)
    return present, least


def _permutations(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that tell sets apart, 0 for the empty set."""
    salts = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
    return np.array([[np.sum(mixed(s ^ salt), dtype=np.uint64) for s in sets] for salt in salts], np.uint64)


def _sketches(width: int, bands: int):
    random = _permutations(bands * BAND_ROWS, 7)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for sets in shingle_sets(batch.column(1), width):
                present, least = _minima(sets, random)
                grouped = least.reshape(-1, bands, BAND_ROWS)
                band = np.full((len(least), bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                for j in range(BAND_ROWS):
                    band = mixed(band * np.uint64(0xD6E8FEB86659FD93) + grouped[:, :, j])
                keys = _set_keys(sets).view(np.int64)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                columns = [batch.column(0).slice(row, len(sets)), sizes, pa.array(keys[0]), pa.array(keys[1]), _lists(band, bands, present)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "k1", "k2", "bands"])
                row += len(sets)

    return sketch


def _signatures(width: int):
    """Full sets of the candidates, and their packed b-bit signatures."""
    random = _permutations(FIELDS, 11)
    each = 64 // BITS
    shifts = np.arange(each, dtype=np.uint64) * np.uint64(BITS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for sets in shingle_sets(batch.column(1), width):
                present, least = _minima(sets, random)
                low = (mixed(least) & np.uint64((1 << BITS) - 1)).reshape(len(least), -1, each)
                packed = np.bitwise_or.reduce(low << shifts, axis=2)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                full = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
                columns = [batch.column(0).slice(row, len(sets)), _lists(packed, FIELDS // each, present), full]
                yield pa.RecordBatch.from_arrays(columns, ["id", "sig", "shingles"])
                row += len(sets)

    return build


def _unequal(x, y):
    """Fields in which two packed longs differ: XOR, fold each field to its lowest bit, count."""
    folded = both = x.bitwiseXOR(y)
    for j in range(1, BITS):
        folded = folded.bitwiseOR(F.shiftrightunsigned(both, j))
    return F.bit_count(folded.bitwiseAND(F.lit(_LOW)))


def _may_link(percent: int):
    """Whether the signatures ``sa`` and ``sb`` leave the threshold possible: their first fields, then all."""
    quick = sum((_unequal(F.col("sa")[i], F.col("sb")[i]) for i in range(QUICK * BITS // 64)), F.lit(0))
    # the rest is folded over the arrays: spelled out, the method would outgrow what the JVM compiles
    whole = F.aggregate(F.zip_with("sa", "sb", _unequal), F.lit(0), lambda a, x: a + x)
    return (quick <= QUICK - least_matches(percent, QUICK)) & (whole <= FIELDS - least_matches(percent, FIELDS))


def estimated_similarity(matches, n: int):
    """Jaccard similarity from equal b-bit fields, corrected for chance collisions."""
    chance = 2.0**-BITS
    return (matches / F.lit(n) - F.lit(chance)) / F.lit(1 - chance)


def _promising(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate ``pairs`` (a, b) whose signatures leave the threshold possible."""
    sig = sets.select("id", "sig")
    return (
        pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        .filter(_may_link(percent))
        .select("a", "b")
    )


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the ``pairs`` (a, b) those whose full sets meet the threshold."""
    full = sets.select("id", "shingles")
    both = (
        pairs.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(full.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("common"))
    )
    return both.filter(F.col("common") * 100 >= (F.col("nx") + F.col("ny") - F.col("common")) * percent).select("a", "b")


def near_duplicates(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-8
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate classes over word shingles.

    A-Z are lowered, words are runs of bytes other than space and 0x09-0x0D, a document's set
    holds its distinct ``width``-word shingles, or its whole word sequence when that is shorter.
    Sets are linked when 100 * intersection >= ``percent`` * union; a class is a connected
    component, named by its smallest id, and that document is kept.

    Equal sets form one class member at once. The others meet in bands of four minima; each
    bucket's members are compared with its smallest and largest id, so a bucket of any size
    costs two pairs a member. Only buckets that then still hold several components go on: their
    members outside the main component are compared, in slices, with all members. Candidates
    pass if the equal low bits of their packed signatures allow the threshold, and are then
    confirmed on full sets. A pair at the threshold is missed with probability ``miss``.

    Defined cases: a null or wordless text has an empty set, is linked with nothing and kept.
    A row without id is not linked: component null, kept. Rows that repeat an id are one
    document: linked through any of its texts, each row in the result. Other columns are ignored.
    """
    bands = bands_for(percent, miss)
    docs = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sketched = settled(
        docs.mapInArrow(_sketches(width, bands), "id long, n long, k1 long, k2 long, bands array<long>")
    )
    known = sketched.filter("id is not null and n > 0")
    classes = settled(
        known.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").drop("last")
    )
    named = known.join(classes, ["k1", "k2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    member = named.filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    keys = named.filter("id = rep").select("id", F.explode("bands").alias("key"))
    buckets = settled(
        keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).filter("low < high")
    )
    rows = settled(keys.join(buckets, "key"))
    wanted = settled(rows.select("id").distinct())
    candidates = docs.join(wanted, "id").select("id", "text")
    sets = settled(candidates.mapInArrow(_signatures(width), "id long, sig array<long>, shingles array<long>").filter(F.size("shingles") > 0))
    ends = F.explode(F.array("low", "high"))
    stars = rows.select(F.col("id").alias("a"), ends.alias("b")).filter("a != b")
    stars = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = settled(_linked(settled(_promising(stars, sets, percent)), sets, percent))
    found = settled(components(links))
    rest = _across(rows, sets, found, percent)
    if rest is not None:
        links = union(links, _linked(rest, sets, percent))
    found = settled(components(union(links, member)))
    return (
        sketched.select("id", F.col("n").alias("n_shingles"))
        .join(found, "id", "left")
        .select(
            F.col("id").alias(id),
            "n_shingles",
            F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def _across(rows: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame | None:
    """Candidate pairs of different components in one bucket, those of its main component against all its members."""
    labelled = rows.join(found, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    labelled = settled(labelled.select("key", "id", "low", "size", "component_id"))
    open_ = settled(
        labelled.groupBy("key")
        .agg(
            F.min("component_id").alias("first"),
            F.max("component_id").alias("last"),
            F.max(F.when(F.col("id") == F.col("low"), F.col("component_id"))).alias("main"),
        )
        .filter("first != last")
        .select("key", "main")
    )
    if open_.isEmpty():
        return None
    slices = F.ceil(F.col("size") / F.lit(SLICE))
    placed = settled(labelled.join(open_, "key").select("key", "id", "component_id", "main", slices.alias("slices")))
    held = placed.groupBy("id").agg(F.collect_set("key").alias("keys"))  # as many as there are bands at most
    members = settled(placed.join(held, "id").join(sets.select("id", "sig"), "id"))
    asked = members.filter("component_id != main").select(
        "key",
        F.col("id").alias("a"),
        F.col("component_id").alias("ca"),
        F.col("sig").alias("sa"),
        F.col("keys").alias("ka"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"),
    )
    all_ = members.select(
        "key",
        F.pmod(F.xxhash64("id"), "slices").alias("slice"),
        F.col("id").alias("b"),
        F.col("component_id").alias("cb"),
        F.col("sig").alias("sb"),
        F.col("keys").alias("kb"),
        (F.col("component_id") == F.col("main")).alias("in_main"),
    )
    return settled(
        asked.join(all_, ["key", "slice"])
        .filter(F.col("ca") != F.col("cb"))
        .filter(F.col("in_main") | (F.col("a") < F.col("b")))
        .filter(_may_link(percent))
        .filter(F.array_min(F.array_intersect("ka", "kb")) == F.col("key"))  # a pair speaks in its first common bucket
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )
