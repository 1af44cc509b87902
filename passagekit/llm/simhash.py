"""Near-duplicates by SimHash fingerprints.

Fingerprints are embedded as the bit counts of their sixteen 4-bit segments. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so a
range join on the grid of embeddings finds every candidate, and each candidate is then
verified on the fingerprints themselves.

Two points of the grid at Manhattan distance 2 or less have a grid point within 1 of
both. So each fingerprint enters its own cell and the cells one step away (33 at most), and
candidates are those that share a cell. Cells with more than ``CROWDED`` fingerprints are
not paired: each of their fingerprints enters the 65 values within one bit of it, and those
that meet in one value are within 2 bits of each other, so a star to the smallest of them
links them exactly, with rows in proportion to the members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.llm.common import import_on_workers, saved, table, utf8_of
from passagekit.llm.components import components

#: The largest cell whose fingerprints are compared pair by pair.
CROWDED = 64
SEGMENTS = 16
SEED = 42


def simhash(text: bytes, words_per_shingle: int) -> int:
    """Fingerprint of one UTF-8 text as a signed 64-bit integer.

    Upper-case ASCII letters are lowered; words are divided by ASCII white space; shingles
    count as often as they occur. Fewer words than a shingle has make one shingle, no
    words the fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, 1 + len(hashes) // 16384):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprint(text_col: str, words_per_shingle: int = 3) -> Column:
    """SimHash of a text column as a long; a null text counts as empty."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py(), words_per_shingle) for t in texts], pa.int64())

    return of(utf8_of(text_col))


def _segment_counts(fp: Column) -> Column:
    """Bit counts of the sixteen 4-bit segments, 4 bits each, in one long."""

    def counts(half: Column) -> Column:
        ones, twos = F.lit(0x55555555).cast("long"), F.lit(0x33333333).cast("long")
        pairs = half.bitwiseAND(ones) + F.shiftrightunsigned(half, 1).bitwiseAND(ones)
        return pairs.bitwiseAND(twos) + F.shiftrightunsigned(pairs, 2).bitwiseAND(twos)

    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return counts(low).bitwiseOR(F.shiftleft(counts(high), 32))


def _cells(center: Column) -> Column:
    """The grid cell itself and those one step away, null where a step leaves the grid."""
    found = [center]
    for segment in range(SEGMENTS):
        count = F.shiftrightunsigned(center, 4 * segment).bitwiseAND(F.lit(15).cast("long"))
        step = F.lit(1 << 4 * segment).cast("long")
        found += [F.when(count < 4, center + step), F.when(count > 0, center - step)]
    return F.array(*found)


def _cell_links(counted: DataFrame, max_bits: int) -> DataFrame:
    """Verified pairs within cells of a bearable size, each pair in one of its cells only."""
    left = counted.select("cell", F.col("fp").alias("a_fp"), F.col("node").alias("a"))
    right = counted.select("cell", F.col("fp").alias("b_fp"), F.col("node").alias("b"))
    own = F.col("cell") - _segment_counts(F.col("a_fp"))
    other = _segment_counts(F.col("b_fp")) - F.col("cell")
    same = _segment_counts(F.col("a_fp")) == _segment_counts(F.col("b_fp"))
    # Of two cells that lie evenly between both embeddings, or are those, the lower one counts.
    here = F.when(same, own == 0).otherwise(own <= other)
    near = F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= max_bits
    pairs = left.join(right, "cell").where((F.col("a") < F.col("b")) & near & here)
    return pairs.select("a", "b")


def _star_links(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Links within crowded cells, through the values that lie within one bit."""
    members = crowded.select("fp", "node").distinct()
    values = F.array(F.col("fp"), *(_flipped(bit) for bit in range(64 if max_bits else 0)))
    reached = members.select("fp", "node", F.explode(values).alias("value"))
    if max_bits == 1:
        # Only a value that is a fingerprint itself is within 1 bit of those that reach it.
        hubs = members.select(F.col("fp").alias("value"), F.col("node").alias("a"))
    else:
        hubs = reached.groupBy("value").agg(F.min("node").alias("a"))
    links = reached.join(hubs, "value").where(F.col("a") != F.col("node"))
    return links.select("a", F.col("node").alias("b"))


def _flipped(bit: int) -> Column:
    mask = 1 << bit
    return F.col("fp").bitwiseXOR(F.lit(mask - (1 << 64) if bit == 63 else mask).cast("long"))


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``a < b`` between distinct fingerprints at most ``max_bits`` (0 to 2) apart.

    ``nodes`` has one row (``fp``, ``node``) for each fingerprint. In crowded cells only
    links of a star are returned; they connect the same nodes.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError(f"max_bits must be 0, 1 or 2, not {max_bits}")
    # Written, so that the 33 cells start from a column and not from 33 copies of its expression.
    placed = saved(nodes.select("fp", "node", _segment_counts(F.col("fp")).alias("center")))
    cells = placed.select("fp", "node", F.explode(_cells(F.col("center"))).alias("cell"))
    cells = cells.where(F.col("cell").isNotNull())
    size = F.count(F.lit(1)).over(Window.partitionBy("cell"))
    shared = saved(cells.withColumn("size", size).where("size > 1"))
    thin = _cell_links(shared.where(F.col("size") <= CROWDED), max_bits)
    thick = _star_links(shared.where(F.col("size") > CROWDED), max_bits)
    ordered = thin.unionByName(thick).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered.distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (hex) and ``component_id``.

    Fingerprints at most ``max_bits`` apart are linked; ``component_id`` is the smallest id
    reachable, the document's own included. A null or empty text has fingerprint zero and
    is linked like any other. Ids are integers; a null id is never the smallest, and a
    component of null ids only has a null ``component_id``. Repeated rows stay. Other
    columns are ignored, an empty table gives no row. ``id_col`` must not be named
    ``fingerprint`` or ``component_id``.
    """
    import_on_workers(docs.sparkSession)
    hashed = docs.select(F.col(id_col).cast("long").alias("id"), fingerprint(text_col, words_per_shingle).alias("fp"))
    hashed = saved(hashed)
    # Fingerprints of which no row has an id get a node below all ids, and null again at the end.
    least = hashed.groupBy("fp").agg(F.min("id").alias("least"))
    nodes = least.where("least IS NOT NULL").select("fp", F.col("least").alias("node"))
    joined = components(saved(links(nodes, max_bits)))
    home = least.join(joined, least["least"] == joined["node"], "left").select(
        "fp", F.coalesce("root", "least").alias("component_id")
    )
    return hashed.join(home, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: 3-word shingles, 2 bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
