"""Best-fit packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.shared import partitions, settled

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def load_encoder(path: str, pattern: str | None = None, added: str | None = None):
    """text -> uint32 ids of a byte-level BPE, given its rank file (base64 token, rank; one a line).

    The pattern defaults to the one published beside the file. ``added``, by default the tokenizer's
    JSON file published there, names the added tokens: their strings are one id wherever they stand.
    A text that the fast encoder gives up is encoded by the JSON file's own tokenizer, to the same ids.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    whole = added or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(whole, encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    coding = tiktoken.Encoding("pieces", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    patient = []

    def encode(text: str) -> np.ndarray:
        try:
            return coding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a run of blanks beyond what the pattern's backtracking stack holds
            if not patient:
                from tokenizers import Tokenizer

                patient.append(Tokenizer.from_file(whole))
            return np.array(patient[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def tokenised_pieces(docs: DataFrame, *, id: str, text: str, capacity: int, vocabulary: str | None, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; a null text has the end id only."""
    chosen = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(chosen)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder(body.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    for column, value in zip(out, (key, piece, start, length, zlib.crc32(data), data if with_ids else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    slim = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(encode, PIECES + (", ids binary" if with_ids else ""))


def _fill(bins: dict, gap: int, held: tuple[int, ...], times: int, s: int, rest: int) -> int:
    """Put up to ``rest`` pieces of length ``s`` into ``times`` equal bins, filling one before the next; returns how many are left."""
    each = gap // s
    full = min(times, rest // each)
    if full:
        bins[gap - each * s].append((held + (s,) * each, full))
        rest -= full * each
        times -= full
    if times and rest:
        bins[gap - rest * s].append((held + (s,) * rest, 1))
        rest, times = 0, times - 1
    if times and held:
        bins[gap].append((held, times))
    return rest


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, number of such bins) for ``counts`` pieces of each length.

    Pieces above a third of the capacity come first: the largest left is paired with the largest
    other such piece that still fits, so two at most share a bin. Smaller ones follow by falling
    length, each into the fullest bin that takes it. All pieces of one length are placed at once,
    so the work depends on the capacity and not on the number of pieces.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] > (x == a)), None)
            if b is None:
                bins[capacity - a].append(((a,), left[a]))
                left[a] = 0
            else:
                times = left[a] // 2 if a == b else min(left[a], left[b])
                left[a] -= times
                left[b] -= times
                bins[capacity - a - b].append(((a, b), times))
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        rest = left[s]
        for gap in range(s, capacity):
            for held, times in bins.pop(gap, []):
                rest = _fill(bins, gap, held, times, s, rest)
        if rest:
            _fill(bins, capacity, (), -(-rest // (capacity // s)), s, rest)
    return [x for gap in sorted(bins) for x in bins[gap]]


def _slots(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, first offset, copies in a sequence): where the pieces of each length go, by rank.

    Every length adds two kinds of bin at most, and a bin's distinct lengths add up to its capacity
    at most, so for 1024 there are some 2,400 kinds with under 45 slots each, whatever the input.
    """
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, times in bins:
        offset = 0
        for k, group in groupby(lengths):
            copies = len(list(group))
            out.append((k, used[k], used[k] + times * copies, sequence, offset, copies))
            used[k] += times * copies
            offset += k * copies
        sequence += times
    return out


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """``pieces`` with ``rank``, from 0 within each length, gapless.

    Rows of one length are numbered within hashed chunks, and the chunks' counts are summed up, so
    no task sorts all pieces of a common length.
    """
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    order = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    counts = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = dealt.withColumn("place", F.row_number().over(order) - 1)
    return numbered.join(settled(base), ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("place")).drop("chunk", "base", "place")


def pack(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Documents are tokenised whole and end with id 2; only those over ``capacity`` are cut, into
    full pieces behind a shorter first one. The bins are planned on the driver from the number of
    pieces of each length (``capacity`` numbers, whatever the input); pieces find their bin by
    their rank within their length. ``vocabulary`` is the path of a rank file.

    Defined cases: a null or empty text is the end id alone; rows without id or that repeat an id
    are packed like others; an empty table gives no rows; other columns are ignored.
    """
    pieces = settled(tokenised_pieces(docs, id=id, text=text, capacity=capacity, vocabulary=vocabulary, with_ids=with_ids))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = docs.sparkSession.createDataFrame(
        _slots(plan_bins(counts, capacity)), "length long, low long, high long, first long, at long, copies long"
    )
    held = F.broadcast(slots)  # bounded by the capacity alone
    placed = ranked(pieces, partitions(docs)).join(held, "length").filter("rank >= low and rank < high")
    ids = ["ids"] if with_ids else []
    nth = F.col("rank") - F.col("low")
    sequence = F.col("first") + F.floor(nth / F.col("copies")).cast("long")
    offset = F.col("at") + F.pmod(nth, "copies") * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, sequence.alias("sequence_id"), offset.alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, from ``pack(..., with_ids=True)``."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(inside.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p.ids))
    return grouped.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
