"""Best-fit packing of token sequences by minimum bin slack.

Each bin starts with the longest piece left. A bitset subset-sum recurrence over the lengths
still available, each as often as it is left, finds the fullest feasible combination for
the rest of the bin, and that combination is removed. Only lengths matter for this, so the
plan is made from the number of pieces of each length (at most ``capacity`` numbers,
however many pieces there are), and a combination is taken as many times at once as its
lengths allow. The pieces then find their bin by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.llm.bpe import PATTERN, tokens_of, vocabulary_path, worker_encoder
from passagekit.llm.common import import_on_workers, saved, table, text_of

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are numbered by one task, about.
PER_PART = 50_000

#: Combination taken ``times`` times: (times, ((length, copies per bin), ...)).
Combination = tuple[int, tuple[tuple[int, int], ...]]


def fullest(room: int, available: dict[int, int]) -> dict[int, int]:
    """Lengths (with copies) whose sum is the largest possible up to ``room``.

    Bit s of ``reached`` says that sum s is feasible with the lengths seen so far, longer
    ones first. The bitsets kept for each step lead back to the combination.
    """
    reached, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, copies = min(available[length], room // length), 1
        while left:
            # Copies in powers of two make every number of copies up to those left.
            taken = min(copies, left)
            steps.append((length, taken, reached))
            reached |= reached << length * taken & mask
            left, copies = left - taken, copies * 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for length, taken, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + taken
            total -= length * taken
    return chosen


def combinations(counts: dict[int, int], capacity: int) -> list[Combination]:
    """Combinations that use up ``counts`` pieces of each length, by minimum bin slack."""
    left = {length: n for length, n in counts.items() if n}
    plan = []
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        chosen = fullest(capacity - longest, {x: n for x, n in others.items() if n})
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[length] // copies for length, copies in chosen.items())
        plan.append((times, tuple(sorted(chosen.items(), reverse=True))))
        for length, copies in chosen.items():
            left[length] -= times * copies
            if not left[length]:
                del left[length]
    return plan


def places(plan: Iterable[Combination]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Where the pieces of each length go: (first rank, first bin, copies per bin, offset of the first copy)."""
    found, ranks, first_bin = {}, {}, 0
    for times, chosen in plan:
        offset = 0
        for length, copies in chosen:
            rank = ranks.get(length, 0)
            found.setdefault(length, []).append((rank, first_bin, copies, offset))
            ranks[length] = rank + times * copies
            offset += copies * length
        first_bin += times
    return found


_TOKENIZERS: dict[str, tiktoken.Encoding] = {}


def tokenizer(path: str) -> tiktoken.Encoding:
    """The worker's tokenizer with the vocabulary of a byte-level BPE file.

    Merge ranks and ids of the file run in the same order, so the ids are those of the
    file's own library, in a quarter of its time.
    """
    if path not in _TOKENIZERS:
        _, pieces_of, special = tokens_of(path)
        ranks = {b: i for i, b in pieces_of.items() if i not in special.values()}
        _TOKENIZERS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _TOKENIZERS[path]


def pieces(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    checksums: bool = False,
) -> DataFrame:
    """The tokens of each document in pieces of at most ``capacity``.

    A document is its ids followed by ``end_id``. Longer ones are cut into pieces of
    ``capacity``; only the first piece may be shorter. Columns: ``id_col``, ``piece``,
    ``start`` (ids before it), ``length`` and ``ids`` (little-endian unsigned 32-bit
    numbers), or with ``checksums`` only their unsigned ``ids_crc32``, so that no ids leave
    the task. A null text counts as empty and gives one piece of one id; null and repeated
    document ids stay as they are.
    """
    import_on_workers(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    name, kind = ("ids_crc32", "bigint") if checksums else ("ids", "binary")

    def encoded(text: str) -> bytes:
        try:
            return tokenizer(path).encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:
            # Its pattern gives up on very long runs of white space; the rank arrays divide them.
            return next(iter(worker_encoder(path).encode([text])))

    @F.arrow_udf(f"array<struct<piece: int, start: bigint, length: bigint, {name}: {kind}>>")
    def cut(texts: pa.Array) -> pa.Array:
        ends, number, starts, sizes, raws = [0], [], [], [], []
        for text in texts:
            raw = encoded(text.as_py()) + end
            n = len(raw) // 4
            bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                number.append(i)
                starts.append(a)
                sizes.append(b - a)
                raws.append(zlib.crc32(raw[4 * a : 4 * b]) if checksums else raw[4 * a : 4 * b])
            ends.append(len(number))
        columns = [
            pa.array(number, pa.int32()),
            pa.array(starts, pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array(raws, pa.int64() if checksums else pa.binary()),
        ]
        found = pa.StructArray.from_arrays(columns, names=["piece", "start", "length", name])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    cut_up = docs.select(F.col(id_col), cut(text_of(text_col)).alias("_pieces"))
    # Every text has a piece. A plain inline would be preceded by a filter on the pieces, for which Spark encodes all texts once more.
    return cut_up.select(id_col, F.inline_outer("_pieces"))


def pack(parts: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``: its sequence and its place in it, without gaps.

    All other columns are carried along, so leave out what is large. Equal rows are
    separate pieces. An empty table gives no rows; a length that is null, below 1 or
    above ``capacity`` raises ``ValueError``.
    """
    spark = parts.sparkSession
    if clash := {"_row", "_length", "_parts", "_part", *("_ranks", "_bins", "_copies", "_offsets")} & set(parts.columns):
        raise ValueError(f"columns {sorted(clash)} are named as those of the plan")
    # Numbers of the written rows, the same whenever they are read.
    parts = saved(parts).withColumn("_row", F.monotonically_increasing_id())
    # At most one number for each length up to the capacity.
    counts = {r[0]: r[1] for r in parts.groupBy(length_col).count().collect()}
    if wrong := [x for x in counts if x is None or not 1 <= x <= capacity]:
        raise ValueError(f"lengths must lie between 1 and {capacity}, not {wrong[:5]}")
    columns = [c for c in parts.columns if c != "_row"]
    # A piece that fills a sequence needs no number among its equals. Most pieces of long texts do.
    whole = parts.where(F.col(length_col) == capacity).select(
        *columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    counts.pop(capacity, None)
    found = places(combinations(counts, capacity))
    rows = [(n, -(-counts[n] // PER_PART), *map(list, zip(*where, strict=True))) for n, where in found.items()]
    lists = ("_ranks", "_bins", "_copies", "_offsets")
    schema = pa.schema([("_length", pa.int64()), ("_parts", pa.int64()), *((c, pa.list_(pa.int64())) for c in lists)])
    # As an Arrow table, since Spark would start Python workers of their own to read a list of rows.
    plan = pa.Table.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema)
    lookup = F.broadcast(spark.createDataFrame(plan))
    # Pieces of a length are dealt into parts of bounded size by their row, so that equal ones are spread too.
    some = parts.join(lookup, F.col(length_col) == F.col("_length"))
    some = some.withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")))
    sizes = saved(some.groupBy("_length", "_part").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    in_part = Window.partitionBy("_length", "_part").orderBy("_row")
    ranked = (
        some.withColumn("_rank", F.row_number().over(in_part) - 1)
        .join(starts, ["_length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    placed = ranked.withColumn("_at", F.expr("size(filter(_ranks, r -> r <= _rank)) - 1"))
    step = F.col("_rank") - F.get("_ranks", F.col("_at"))
    copies = F.get("_copies", F.col("_at"))
    return whole.unionByName(
        placed.select(
            *columns,
            (F.get("_bins", F.col("_at")) + F.floor(step / copies)).alias("sequence_id"),
            (F.get("_offsets", F.col("_at")) + step % copies * F.col(length_col)).alias("offset"),
        )
    )


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with a checksum of their ids, packed into sequences.

    See :func:`pieces` for nulls, empty and long texts and :func:`pack` for repeated rows.
    """
    return pack(pieces(docs, path, capacity, id_col=id_col, text_col=text_col, checksums=True), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"), vocabulary_path())
