"""Language-model scores by a probabilistic suffix tree over words.

The root of the tree is the smoothed distribution of all tokens of the training documents.
A context of one or two preceding tokens becomes a node if it is frequent and its
next-token distribution diverges from that of its parent, the context without its oldest token.
Each node mixes its counts with its parent's distribution, and a token is scored in the
longest context that the tree holds.

Contexts are kept by this test alone, and all tokens are told apart in them. The tree is as large as the corpus, so it stays
distributed (:mod:`suffix_contexts`). A caller who wants a small tree can name bounds by share of the
corpus (``Shares``): next tokens are told apart where they are frequent; all others form one class in the
contexts, within which the root decides. Shares add up to 1, so at most 1 / share symbols or entries
reach one, and that tree is held by the driver and every task. Counts of all tokens stay distributed in either case:
documents are dealt into blocks of bounded size, and each block gets what it needs of its own tokens by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.llm.common import id_remainder, import_on_workers, saved, table, utf8_of
from passagekit.llm.quality_rules import _some
from passagekit.llm.suffix_contexts import (
    END,
    GAIN_PER_SYMBOL,
    HELD,
    MIN_DIVERGENCE,
    PARENT_WEIGHT,
    ROOT_PRIOR,
    WholeTree,
    dealt,
    gains,
    joined,
    packed,
    parted,
    scored,
    sequence,
    unpacked,
    whole,
    words_of,
)

#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class Shares:
    """Smallest shares of all training tokens: of a symbol, of a symbol in a context of two, of a tree entry.

    Least probabilities of a small tree: a context is a candidate for the divergence test only
    if it is at least that likely, which bounds the tree whatever the corpus is. The queries name none.
    """

    symbol: float = 1e-4
    pair: float = 1e-3
    entry: float = 1e-6


def token_counts(docs: DataFrame) -> DataFrame:
    """``token`` (binary) and ``c`` over the column ``text`` (binary), the end tokens included.

    Tasks send the tokens of a part together, sorted and squeezed: a third of what they take as rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(words_of(text.as_py()))
                held[END] += 1
                if len(held) > HELD:
                    yield counted(held)
                    held.clear()
        yield counted(held)

    def counted(held: Counter[bytes]) -> pa.RecordBatch:
        by_part = dealt(held, parts)
        numbers = [packed(np.array([held[t] for t in tokens])) for tokens in by_part.values()]
        arrays = [pa.array(by_part, pa.int64()), pa.array(map(joined, by_part.values()), pa.binary()), pa.array(numbers, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "tokens", "c"])

    def add(key: tuple, sent: pa.Table) -> pa.Table:
        total: Counter[bytes] = Counter()
        for tokens, c in zip(sent["tokens"], sent["c"], strict=True):
            for token, n in zip(parted(tokens.as_py()), unpacked(c.as_py())[0].tolist(), strict=True):
                total[token] += n
        return pa.table([pa.array(total, pa.binary()), pa.array(total.values(), pa.int64())], names=["token", "c"])

    sent = docs.select("text").mapInArrow(count, "part long, tokens binary, c binary")
    return sent.groupBy("part").applyInArrow(add, "token binary, c long")


@dataclass
class Tree:
    """Symbols (frequent tokens) with root probabilities, and the nodes as sorted tables.

    Symbol number ``len(symbols)`` is the class of all other tokens. ``ones`` and ``twos``
    have, by context, its total and the weight of its parent; ``*_entries`` the counts kept
    of (context, next symbol).
    """

    symbols: dict[bytes, int]
    root: np.ndarray
    tokens: int
    distinct: int
    ones: tuple[np.ndarray, np.ndarray, np.ndarray]
    ones_entries: tuple[np.ndarray, np.ndarray]
    twos: tuple[np.ndarray, np.ndarray, np.ndarray]
    twos_entries: tuple[np.ndarray, np.ndarray]

    @property
    def other(self) -> int:
        return len(self.symbols)

    def root_probability(self, counts: np.ndarray) -> np.ndarray:
        """Smoothed probability of tokens with the given counts, unseen ones included."""
        return (counts + ROOT_PRIOR) / (self.tokens + ROOT_PRIOR * (self.distinct + 1))

    def probability(self, older: np.ndarray, last: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Probability of the next symbols (classes) in the longest contexts that are nodes."""
        base = np.int64(self.other + 1)
        p = self.root[nxt]
        p = _mixed(p, last, last * base + nxt, self.ones, self.ones_entries)
        pairs = older * base + last
        return _mixed(p, pairs, pairs * base + nxt, self.twos, self.twos_entries)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _mixed(p, contexts, entries, nodes, kept) -> np.ndarray:
    """Where a context is a node, its counts mixed with the parent's probability ``p``."""
    keys, totals, weights = nodes
    at, is_node = _find(keys, contexts)
    inside = np.nonzero(is_node)[0]
    at = at[inside]
    where, seen = _find(kept[0], entries[inside])
    counts = np.zeros(len(inside))
    counts[seen] = kept[1][where[seen]]
    p = p.copy()
    p[inside] = (counts + weights[at] * p[inside]) / (totals[at] + PARENT_WEIGHT)
    return p


def context_counts(docs: DataFrame, symbols: dict[bytes, int], pair_symbols: int) -> DataFrame:
    """``depth`` (1 or 2), ``context``, ``next`` and ``n`` of the training texts.

    Symbols are numbered by falling frequency; contexts of two consist of the first
    ``pair_symbols``. Each task adds up before the shuffle.
    """
    base = np.int64(len(symbols) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {1: [], 2: []}
        for batch in batches:
            for texts, _ in _some((t.as_py() for t in batch["text"]), range(batch.num_rows)):
                seq, text, _ = sequence(texts, symbols, len(symbols))
                at = scored(text)
                nxt, last, older = seq[at], seq[at - 1], seq[at - 2]
                held[1].append(np.unique(last * base + nxt, return_counts=True))
                both = (last < pair_symbols) & (older < pair_symbols)
                held[2].append(np.unique((older[both] * base + last[both]) * base + nxt[both], return_counts=True))
            for depth, parts in held.items():
                if sum(len(k) for k, _ in parts) > 4 * HELD:
                    held[depth] = [_summed(parts)]
                    if len(held[depth][0][0]) > 2 * HELD:
                        yield _contexts(depth, held[depth][0], base)
                        held[depth] = []
        for depth, parts in held.items():
            if parts:
                yield _contexts(depth, _summed(parts), base)

    counted = docs.select("text").mapInArrow(count, "depth int, context long, next long, n long")
    return counted.groupBy("depth", "context", "next").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _contexts(depth: int, counted: tuple[np.ndarray, np.ndarray], base: np.int64) -> pa.RecordBatch:
    keys, n = counted
    arrays = [np.full(len(keys), depth, dtype=np.int32), keys // base, keys % base, n]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["depth", "context", "next", "n"])


def grow(docs: DataFrame, counts: DataFrame, shares: Shares | None = None) -> Tree | WholeTree:
    """The tree of training texts (column ``text``, binary) with the counts of their tokens.

    It is whole unless ``shares`` bound it.
    """
    if shares is None:
        return whole(docs, counts)
    spark = docs.sparkSession
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # At most 1 / shares.symbol rows.
    frequent = counts.where(F.col("c") >= shares.symbol * tokens).where("c > 0").collect()
    frequent = sorted(((bytes(r[0]), r[1]) for r in frequent), key=lambda r: (-r[1], r[0]))
    symbols = {token: i for i, (token, _) in enumerate(frequent)}
    root = (np.array([c for _, c in frequent]) + ROOT_PRIOR) / (tokens + ROOT_PRIOR * (distinct + 1))
    root = np.append(root, max(1 - root.sum(), 1e-12))
    pair_symbols = sum(c >= shares.pair * tokens for _, c in frequent)
    contexts = saved(context_counts(docs, symbols, pair_symbols))
    base = len(symbols) + 1
    # The class of other tokens tells little of what follows, so it is no context.
    chances = spark.createDataFrame([(i, float(p)) for i, p in enumerate(root)], "next long, parent double")
    ones = contexts.where((F.col("depth") == 1) & (F.col("context") < base - 1))
    ones = ones.withColumn("total", F.sum("n").over(Window.partitionBy("context")))
    ones = ones.join(F.broadcast(chances), "next")
    totals = ones.select(F.col("context").alias("last"), "next", (F.col("n") / F.col("total")).alias("parent"))
    twos = contexts.where("depth = 2").withColumn("last", F.pmod("context", F.lit(base)))
    twos = twos.withColumn("total", F.sum("n").over(Window.partitionBy("context"))).join(totals, ["last", "next"])
    kept_ones, kept_twos = _diverging(ones), _diverging(twos)
    # Nodes and entries are bounded by the shares, so they fit the driver and every task.
    least = shares.entry * tokens
    parts = []
    for every, kept, size in ((ones, kept_ones, shares.symbol), (twos, kept_twos, shares.symbol)):
        frequent_nodes = kept.where(F.col("total") >= size * tokens)
        entries = every.join(frequent_nodes.select("context"), "context", "left_semi").where(F.col("n") >= least)
        parts.append((frequent_nodes.collect(), entries.select("context", "next", "n").collect()))
    return _built(symbols, root, tokens, distinct, base, *parts)


def _diverging(contexts: DataFrame) -> DataFrame:
    """Contexts whose next-symbol distribution diverges from their parent's, with their total."""
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("parent")))
    tested = contexts.groupBy("context").agg(F.max("total").alias("total"), gain.alias("gain"), F.count("next").alias("kinds"))
    enough = (F.col("gain") >= MIN_DIVERGENCE * F.col("total")) & (F.col("gain") >= GAIN_PER_SYMBOL * F.col("kinds"))
    return tested.where(enough).select("context", "total")


def _built(symbols, root, tokens, distinct, base, ones, twos) -> Tree:
    tables = []
    for nodes, entries in (ones, twos):
        nodes, entries = sorted(map(tuple, nodes)), sorted(map(tuple, entries))
        keys = np.array([c for c, _ in nodes], dtype=np.int64)
        totals = np.array([t for _, t in nodes], dtype=float)
        context = np.array([c for c, _, _ in entries], dtype=np.int64)
        n = np.array([n for _, _, n in entries], dtype=float)
        # What was seen too rarely to be kept is left to the parent.
        seen = np.bincount(np.searchsorted(keys, context), weights=n, minlength=len(keys)) if len(keys) else np.zeros(0)
        following = np.array([x for _, x, _ in entries], dtype=np.int64)
        tables.append(((keys, totals, totals - seen + PARENT_WEIGHT), (context * base + following, n)))
    return Tree(symbols, root, tokens, distinct, *tables[0], *tables[1])


RESULT = "n_tokens bigint, n_known bigint, base_score double, score double"


def scores(
    docs: DataFrame, counts: DataFrame, tree: Tree | WholeTree, blocks: int, end_count: int, trained: Column | None = None
) -> DataFrame:
    """``docs`` (``id``, ``text``) with ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    The contexts of a whole tree are those of the rows of which ``trained`` holds: of all, if it isn't given.
    """
    if isinstance(tree, WholeTree):
        return gains(docs, counts, tree, blocks, trained)
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(blocks, "block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}
        for batch in batches:
            for block, text in zip(batch["block"].to_pylist(), batch["text"], strict=True):
                held.setdefault(block, set()).update(words_of(text.as_py()))
        for block, tokens in held.items():
            some = list(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), block)), pa.array(some, pa.binary())], names=["block", "token"]
            )

    # All columns go in, though the id is of no use here: so both readers of the blocks share one shuffle of the texts.
    used = blocked.mapInArrow(distinct, "block long, token binary")
    known = used.join(counts, "token").select("block", "token", "c")

    def score(key: tuple, texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        counts_of = dict(zip(vocabulary["token"].to_pylist(), vocabulary["c"].to_pylist(), strict=True))
        columns = [[] for _ in range(4)]
        for some, _ in _some(texts["text"].to_pylist(), range(texts.num_rows)):
            seq, text, words = sequence(some, tree.symbols, tree.other)
            at = scored(text)
            get = counts_of.get
            flat: list[int] = []
            for ws in words:
                flat += [get(w, 0) for w in ws]
                flat.append(end_count)
            c = np.array(flat, dtype=np.int64)
            of = text[at]
            root = tree.root_probability(c)
            symbol = seq[at]
            p = tree.probability(seq[at - 2], seq[at - 1], symbol)
            # Within the class of other tokens the root decides.
            p = np.where(symbol == tree.other, p / tree.root[tree.other] * root, p)
            n = len(some)
            columns[0].append(np.bincount(of, minlength=n))
            columns[1].append(np.bincount(of, weights=c > 0, minlength=n).astype(np.int64))
            columns[2].append(np.bincount(of, weights=np.log10(root), minlength=n))
            columns[3].append(np.bincount(of, weights=np.log10(p), minlength=n))
        out = [pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in columns]
        return pa.table([texts["id"], *out], names=["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["id"].dataType.simpleString()
    return (
        blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, f"id {kind}, {RESULT}")
    )


def held_out(id_col: str = "doc_id") -> Column:
    return id_remainder(id_col, 10) == 0


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shares: Shares | None = None
) -> DataFrame:
    """Scores of all documents by a tree of those whose ``crc32`` of the id as text is not 0 modulo 10.

    Columns: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    (by the root alone) and ``score``, both in log10. The tree is whole unless ``shares`` bound
    it. A null or empty text is its end token; a null id counts as the empty text. Repeated rows
    are all counted and scored; other columns are ignored and an empty table gives no row. Without
    training documents every token has the root's probability for unseen ones.
    """
    import_on_workers(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), utf8_of(text_col).alias("text"))
    training = plain.where(~held_out("id"))
    counts = saved(token_counts(training))
    counts = counts.where("c > 0")
    tree = grow(training, counts, shares)
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Few tokens of long texts are ends, so this count is no matter of how frequent a symbol is.
    ends = counts.where(F.col("token") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    found = scores(plain, counts, tree, max(1, math.ceil(size / BLOCK_BYTES)), ends, ~held_out("id"))
    return found.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tree.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_documents(table(spark, sf_dir, "documents"))
