"""The whole suffix tree over words of :mod:`suffix_tree`: all tokens, contexts and next tokens, none left out.

Tokens are numbered by falling count. Each block of documents asks for the numbers of its own
tokens and sends what it holds of each context to the part of that context, where its occurrences in all
blocks meet: there they are counted, the context is tested, and every document gets back the
sum of what its tokens gain by their contexts. No task and no driver holds the tree.

The next tokens of a context of one word are those of all contexts of two that end with it, so both depths travel
as one. A word too frequent for one part is spread over the parts by the word before it; what follows it is
counted beforehand, and so is what follows a pair that is too frequent itself.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import saved
from passagekit.llm.quality_rules import _some

#: The token after the last word; words have no white space, so none is equal to it.
END = b"\n"
#: Added to the count of every token at the root.
ROOT_PRIOR = 0.1
#: Weight of the parent's distribution in a node, in observations.
PARENT_WEIGHT = 20.0
#: A context stays if its log-likelihood gain over its parent is at least this per
#: occurrence (nats), and this much for each of its different next symbols.
MIN_DIVERGENCE = 0.02
GAIN_PER_SYMBOL = 2.0
#: Occurrences that a part gets on average, and from which on a context is counted beforehand.
PART = 3 << 19
FREQUENT = 3 << 19
#: Tokens and grams that a part of the vocabulary holds.
NUMBERED = 300_000
#: Distinct tokens that a counting task holds before it sends them on; half as many of grams.
HELD = 400_000
#: Sums of a document are multiples of this, so that they don't depend on the order of the parts.
GRAIN = 2.0**-36


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lowered, without the end token."""
    return text.lower().split()


def sequence(texts: list[bytes], symbols: dict[bytes, int], other: int | None) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Symbols of all tokens of some texts, the text of each, and the words; every text ends with the end token.

    Before each text stand two end tokens, so that its first contexts are those of a beginning. Without ``other``
    there is a symbol of each token, made by ``symbols`` if need be.
    """
    end = symbols[END] if other is None else symbols.get(END, other)
    words = [words_of(t) for t in texts]
    flat: list[int] = []
    get = symbols.get
    for ws in words:
        flat += [end, end]
        flat += map(symbols.__getitem__, ws) if other is None else [get(w, other) for w in ws]
        flat.append(end)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(texts)) + 3
    return np.array(flat, dtype=np.int64), np.repeat(np.arange(len(texts)), sizes), words


def scored(text: np.ndarray) -> np.ndarray:
    """Positions that are tokens of their text: all but the two before it."""
    start = np.ones(len(text), dtype=bool)
    start[1:] = text[1:] != text[:-1]
    start[1:] |= start[:-1].copy()
    return np.nonzero(~start)[0]


@dataclass(frozen=True)
class WholeTree:
    """What all tasks know of the tree.

    ``first`` has, by (part of the vocabulary, count), the number of the first token; ``starts`` and ``levels``
    the counts by number. ``ones`` and ``twos`` have the contexts counted beforehand: whether each is a node, and the
    total of a pair. ``grams`` has what follows them (``token``, a context and its next token with blanks between,
    and ``c``).
    """

    tokens: int
    distinct: int
    parts: int
    first: dict[int, dict[int, int]]
    starts: np.ndarray
    levels: np.ndarray
    ones: dict[bytes, bool]
    twos: dict[tuple[bytes, bytes], tuple[int, bool]]
    grams: DataFrame | None

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of tokens by number; ``distinct`` is the number of unseen ones."""
        return self.levels[np.searchsorted(self.starts, numbers, "right") - 1]

    def root(self, counts: np.ndarray) -> np.ndarray:
        """Smoothed probability of tokens with the given counts, unseen ones included."""
        return (counts + ROOT_PRIOR) / (self.tokens + ROOT_PRIOR * (self.distinct + 1))


def _vocabulary_part(token: Column, parts: int) -> Column:
    return (F.crc32(token) % F.lit(parts)).cast("long")


def whole(docs: DataFrame, counts: DataFrame) -> WholeTree:
    """The tree of training texts (column ``text``, binary) with the counts of their tokens.

    Contexts seen ``FREQUENT`` times or more are counted here, all others in :func:`gains`.
    """
    counts = counts.where("c > 0")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # At most tokens / FREQUENT of one word and as many pairs.
    often = {bytes(r[0]): r[1] for r in counts.where(F.col("c") >= FREQUENT).collect()}
    ones, twos, grams = _beforehand(docs, counts, tokens, distinct, often) if often else ({}, {}, None)
    parts = max(1, math.ceil((distinct + (0 if grams is None else grams.count())) / NUMBERED))
    # Counts that differ add up to the tokens of a part, so they are few beside its tokens.
    held = counts.groupBy(_vocabulary_part(F.col("token"), parts).alias("part"), "c").count().toArrow()
    part, c, n = (held[x].to_numpy() for x in ("part", "c", "count"))
    order = np.lexsort((part, -c))
    part, c, n = part[order], c[order], n[order]
    numbers = np.cumsum(n) - n
    first: dict[int, dict[int, int]] = {}
    for p, level, number in zip(part.tolist(), c.tolist(), numbers.tolist(), strict=True):
        first.setdefault(p, {})[level] = number
    new = np.ones(len(c), dtype=bool)
    new[1:] = c[1:] != c[:-1]
    starts, levels = np.append(numbers[new], distinct), np.append(c[new], 0)
    return WholeTree(tokens, distinct, parts, first, starts, levels, ones, twos, grams)


def _triples(words: list[bytes]) -> Iterator[tuple[bytes, bytes, bytes]]:
    return zip([END, END, *words], [END, *words], [*words, END], strict=False)


def _gram_counts(docs: DataFrame, often: Iterable, pairs: bool) -> DataFrame:
    """``older`` (if ``pairs``), ``last``, ``next`` and ``c`` after the given contexts."""
    often = frozenset(often)
    names = ["older", "last", "next"][not pairs :]

    def counted(held: Counter) -> pa.RecordBatch:
        arrays = [pa.array(list(x), pa.binary()) for x in zip(*held, strict=True)] or [pa.array([], pa.binary())] * len(names)
        return pa.RecordBatch.from_arrays([*arrays, pa.array(list(held.values()), pa.int64())], names=[*names, "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text.as_py())
                if pairs:
                    held.update(t for t in _triples(words) if t[:2] in often)
                else:
                    held.update(t for t in zip([END, *words], [*words, END], strict=True) if t[0] in often)
                if len(held) > HELD // 2:
                    yield counted(held)
                    held.clear()
        yield counted(held)

    found = docs.select("text").mapInArrow(count, ", ".join(f"{x} binary" for x in names) + ", c long")
    return found.groupBy(*names).agg(F.sum("c").alias("c"))


def _is_node(gain, total, kinds):
    return (gain >= MIN_DIVERGENCE * total) & (gain >= GAIN_PER_SYMBOL * kinds) & (kinds > 0)


def _beforehand(docs, counts, tokens, distinct, often):
    """Nodes among the frequent contexts, and the counts of what follows these."""
    spark = docs.sparkSession
    after = saved(_gram_counts(docs, often, pairs=False))
    totals = spark.createDataFrame([(bytearray(w), c) for w, c in often.items()], "last binary, total long")
    share = (F.col("all") + ROOT_PRIOR) / (tokens + ROOT_PRIOR * (distinct + 1))
    of_all = counts.select(F.col("token").alias("next"), F.col("c").alias("all"))
    ratio = F.col("c") / F.col("total")
    gained = [F.sum(F.col("c") * F.log(ratio / F.col("parent"))).alias("gain"), F.count(F.lit(1)).alias("kinds")]
    tested = after.join(of_all, "next").withColumn("parent", share).join(F.broadcast(totals), "last")
    found = tested.groupBy("last").agg(F.max("total").alias("total"), *gained).collect()
    ones = {bytes(r["last"]): bool(_is_node(r["gain"], r["total"], r["kinds"])) for r in found}
    pairs = {(bytes(r[0]), bytes(r[1])): r[2] for r in after.where(F.col("c") >= FREQUENT).collect()}
    # No token follows an end, but two ends stand before each text.
    pairs = {pair: c for pair, c in pairs.items() if pair[1] != END}
    if END in often:
        pairs[END, END] = often[END]
    blank = F.lit(bytearray(b" "))
    grams = after.select(F.concat("last", blank, "next").alias("token"), "c")
    if not pairs:
        return ones, {}, grams
    triples = saved(_gram_counts(docs, pairs, pairs=True))
    rows = [(bytearray(o), bytearray(w), c, often[w]) for (o, w), c in pairs.items()]
    totals = spark.createDataFrame(rows, "older binary, last binary, total long, of_last long")
    parent = after.withColumnRenamed("c", "all")
    tested = triples.join(F.broadcast(totals), ["older", "last"]).join(parent, ["last", "next"])
    tested = tested.withColumn("parent", F.col("all") / F.col("of_last"))
    found = tested.groupBy("older", "last").agg(F.max("total").alias("total"), *gained).collect()
    twos = {
        (bytes(r["older"]), bytes(r["last"])): (r["total"], bool(_is_node(r["gain"], r["total"], r["kinds"]))) for r in found
    }
    return ones, twos, grams.union(triples.select(F.concat("older", blank, "last", blank, "next").alias("token"), "c"))


def _squeezed(raw: bytes) -> bytes:
    return struct.pack("<q", len(raw)) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unsqueezed(body: bytes) -> bytes:
    (size,) = struct.unpack_from("<q", body)
    return pa.decompress(memoryview(body)[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def packed(*columns: np.ndarray) -> bytes:
    """Columns of integers from 0, their bytes by significance, without the highest that are all 0."""
    head, rest = [struct.pack("<q", len(columns))], []
    for column in columns:
        column = np.ascontiguousarray(column, dtype=np.uint64)
        width = max(1, (int(column.max(initial=0)).bit_length() + 7) // 8)
        head.append(struct.pack("<qq", width, len(column)))
        rest.append(np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return _squeezed(b"".join(head + rest))


def unpacked(body: bytes) -> list[np.ndarray]:
    """The columns of :func:`packed`."""
    raw = _unsqueezed(body)
    (n,) = struct.unpack_from("<q", raw)
    at, columns = 8 + 16 * n, []
    for i in range(n):
        width, size = struct.unpack_from("<qq", raw, 8 + 16 * i)
        column = np.zeros((size, 8), dtype=np.uint8)
        column[:, :width] = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size).T
        columns.append(column.reshape(-1).view(np.int64))
        at += width * size
    return columns


def joined(tokens: list[bytes]) -> bytes:
    """Tokens as one body; :func:`parted` takes them apart."""
    return _squeezed(b"\t".join(tokens))


def parted(body: bytes) -> list[bytes]:
    return _unsqueezed(body).split(b"\t")


def dealt(tokens: Iterable[bytes], parts: int) -> dict[int, list[bytes]]:
    """Sorted tokens by part of the vocabulary."""
    by_part: dict[int, list[bytes]] = {}
    for token in sorted(tokens):
        by_part.setdefault(zlib.crc32(token) % parts, []).append(token)
    return by_part


def _add_grams(grams: set[bytes], text: bytes, ones: Collection, twos: Collection) -> None:
    """Add the tokens of a text, and what stands in it after the contexts counted beforehand."""
    words = words_of(text)
    grams.update(words)
    if ones:
        grams.update(b"%b %b" % t for t in zip([END, *words], [*words, END], strict=True) if t[0] in ones)
    if twos:
        grams.update(b"%b %b %b" % t for t in _triples(words) if t[:2] in twos)


def _asked(blocked: DataFrame, tree: WholeTree) -> DataFrame:
    """``part``, ``block`` and the different tokens, and grams of contexts counted beforehand, of each block."""
    ones, twos, parts = frozenset(tree.ones), frozenset(tree.twos), tree.parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}
        for batch in batches:
            for block, text in zip(batch["block"].to_pylist(), batch["text"], strict=True):
                _add_grams(held.setdefault(block, {END}), text.as_py(), ones, twos)
        for block, grams in held.items():
            by_part = dealt(grams, parts)
            bodies = pa.array(map(joined, by_part.values()), pa.binary())
            arrays = [pa.array(by_part, pa.int64()), pa.array([block] * len(by_part), pa.int64()), bodies]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "grams"])

    # All columns go in, though not all are of use here: so both readers of the blocks share one shuffle of the texts.
    return blocked.mapInArrow(ask, "part long, block long, grams binary")


def _answered(asked: DataFrame, counts: DataFrame, tree: WholeTree) -> DataFrame:
    """``block``, ``part`` and what was asked: numbers of tokens, counts of grams, both plus 1 and 0 if unseen."""
    first = tree.first

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        of, values = first.get(key[0].as_py(), {}), {}
        next_of = dict(of)
        for token, c in sorted(zip(known["token"].to_pylist(), known["c"].to_pylist(), strict=True)):
            if b" " in token:
                values[token] = c + 1
            else:
                values[token] = next_of[c] + 1
                next_of[c] += 1
        get = values.get
        bodies = []
        for body in asked["grams"]:
            bodies.append(packed(np.array([get(g, 0) for g in parted(body.as_py())], dtype=np.int64)))
        return pa.table([asked["block"], asked["part"], pa.array(bodies, pa.binary())], names=["block", "part", "found"])

    known = counts.where("c > 0").select("token", "c")
    if tree.grams is not None:
        known = known.union(tree.grams)
    known = known.withColumn("part", _vocabulary_part(F.col("token"), tree.parts))
    return asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, "block long, part long, found binary")


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread numbers, 31 bits."""
    mixed = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(33)).astype(np.int64)


def _order(columns: list[np.ndarray], size: int) -> np.ndarray:
    """Order by columns of numbers below ``size``."""
    if size ** len(columns) >= 1 << 63:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        key = key * size + column
    return np.argsort(key)


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def _steps(column: np.ndarray, anew: np.ndarray) -> np.ndarray:
    """Differences to the row before, the whole value where it begins anew."""
    steps = column.copy()
    steps[1:] -= column[:-1]
    return np.where(anew, column, steps)


def _sums_of_steps(steps: np.ndarray, anew: np.ndarray) -> np.ndarray:
    sums = np.cumsum(steps)
    at = np.nonzero(anew)[0]
    return sums - np.repeat(sums[at] - steps[at], np.diff(np.append(at, len(steps))))


def _grams(tree: WholeTree, found: dict[bytes, int], older: np.ndarray, last: np.ndarray, following: np.ndarray) -> list[bytes]:
    """What stands after the contexts counted beforehand, as :func:`_add_grams` has it, by the symbols ``found``."""
    grams, tokens, n = [], list(found), np.int64(len(found))
    ones = [found[w] for w in tree.ones if w in found]
    if ones:
        here = np.isin(last, ones)
        for pair in np.unique(last[here] * n + following[here]).tolist():
            grams.append(b"%b %b" % (tokens[pair // n], tokens[pair % n]))
    for o, w in tree.twos:
        if o in found and w in found:
            here = (older == found[o]) & (last == found[w])
            grams += [b"%b %b %b" % (o, w, tokens[x]) for x in np.unique(following[here]).tolist()]
    return grams


class _Block:
    """Tokens of a block, numbered within it in the order of their numbers; the last is that of unseen ones."""

    def __init__(self, tree: WholeTree, found: dict[bytes, int], triples: tuple[np.ndarray, ...], answers: pa.Table):
        # As they were asked for, so that only the answers travel back.
        asked = dealt([*found, *_grams(tree, found, *triples)], tree.parts)
        tokens, numbers, seen = [], [], []
        for part, values in zip(answers["part"].to_pylist(), answers["found"], strict=True):
            for gram, value in zip(asked[part], (unpacked(values.as_py())[0] - 1).tolist(), strict=True):
                if value < 0:
                    continue
                if b" " in gram:
                    seen.append((gram, value))
                else:
                    tokens.append(gram)
                    numbers.append(value)
        numbers = np.array(numbers, dtype=np.int64)
        order = np.argsort(numbers)
        self.at = {tokens[i]: place for place, i in enumerate(order.tolist())}
        self.unseen = len(tokens)
        #: Places of the symbols.
        self.place = np.fromiter((self.at.get(t, self.unseen) for t in found), dtype=np.int32, count=len(found))
        self.number = np.append(numbers[order], tree.distinct)
        self.count = tree.count(self.number)
        self.root = tree.root(self.count)
        # What is known beforehand, by numbers within the block.
        n = self.unseen + 1
        self.often = np.zeros(n, dtype=bool)
        self.node = np.zeros(n, dtype=bool)
        for token, node in tree.ones.items():
            if token in self.at:
                self.often[self.at[token]], self.node[self.at[token]] = True, node
        two = [(self.at[o] * n + self.at[w], *x) for (o, w), x in tree.twos.items() if o in self.at and w in self.at]
        self.pairs, self.totals, self.pair_nodes = self._columns(sorted(two), 3)
        after, third = [], []
        for gram, c in seen:
            *context, last, following = (self.at[t] for t in gram.split(b" "))
            if context:
                third.append((context[0] * n + last, following, c))
            else:
                after.append((last * n + following, c))
        self.after, self.after_n = self._columns(sorted(after), 2)
        # A pair known beforehand and a token: the pair's row and the token.
        pair, following, c = self._columns(third, 3)
        keys = np.searchsorted(self.pairs, pair) * n + following
        order = np.argsort(keys)
        self.third, self.third_n = keys[order], c[order]

    @staticmethod
    def _columns(rows: list[tuple], n: int) -> list[np.ndarray]:
        return list(np.array(rows, dtype=np.int64).reshape(-1, n).T)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted keys, 0 if there is none, and whether there is one."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return np.where(there, values[at], 0), there


def _mix(p: np.ndarray, n: np.ndarray, total: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where a context is a node, its counts mixed with the parent's probability ``p``."""
    return np.where(node, (n + PARENT_WEIGHT * p) / (total + PARENT_WEIGHT), p)


def _sums(doc: np.ndarray, gain: np.ndarray, docs: int) -> bytes:
    sums = np.bincount(doc, weights=np.rint(gain / GRAIN) * GRAIN, minlength=docs)
    at = np.nonzero(sums)[0]
    return packed(_steps(at, np.arange(len(at)) == 0), sums[at].view(np.uint64))


def _sent(tree: WholeTree, parts: int, kind: str):
    """What a block sends: a row of each document, and to each part its share of the contexts."""

    def send(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        symbols: defaultdict[bytes, int] = defaultdict()
        symbols.default_factory = symbols.__len__
        marked = "trained" in texts.column_names
        trained = texts["trained"].to_numpy() if marked else np.ones(texts.num_rows, dtype=bool)
        # Training texts come first, so that their number tells which they are.
        order, learned = np.argsort(~trained, kind="stable"), int(trained.sum())
        texts, docs = texts.take(pa.array(order)), len(order)
        pieces, begin = [], 0
        for some, _ in _some((t.as_py() for t in texts["text"]), range(docs)):
            seq, text, _ = sequence(some, symbols, None)
            seq, at = seq.astype(np.int32), scored(text)
            pieces.append((seq[at - 2], seq[at - 1], seq[at], (text[at] + begin).astype(np.int32)))
            begin += len(some)
        older, last, following, doc = (np.concatenate(x) for x in zip(*pieces, strict=True))
        del pieces
        block = _Block(tree, symbols, (older, last, following), answers)
        older, last, following = block.place[older], block.place[last], block.place[following]
        tokens = np.bincount(doc, minlength=docs)
        known = np.bincount(doc, weights=block.count[following] > 0, minlength=docs).astype(np.int64)
        base = np.bincount(doc, weights=np.log10(block.root)[following], minlength=docs)
        bodies, to = [], []
        n = np.int64(block.unseen + 1)
        if len(block.pairs):
            pair = older * n + last
            at = np.searchsorted(block.pairs, pair).clip(max=len(block.pairs) - 1)
            here = block.pairs[at] == pair
            at, l1, x1 = at[here], last[here], following[here]
            p = root = block.root[x1]
            n1, _ = _looked_up(block.after, block.after_n, l1 * n + x1)
            p = _mix(p, n1, block.count[l1], block.node[l1])
            n2, _ = _looked_up(block.third, block.third_n, at * n + x1)
            p = _mix(p, n2, block.totals[at], block.pair_nodes[at] > 0)
            bodies.append(_sums(doc[here], np.log10(p / root), docs))
            to.append(-1 - key[0].as_py())
            rest = ~here
        else:
            rest = np.ones(len(doc), dtype=bool)
        # After an unseen token there is no context.
        rest &= last < block.unseen
        older, last, following, doc = older[rest], last[rest], following[rest], doc[rest]
        part = _mixed(block.number[last])
        often = block.often[last]
        part[often] = _mixed(part[often] * (tree.distinct + 1) + block.number[older[often]])
        part = (part % parts).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = _order([last, following, older], int(n))
        order = order[np.argsort(part[order], kind="stable")]
        older, last, following, doc, part = older[order], last[order], following[order], doc[order], part[order]
        bounds = np.nonzero(_changes(part))[0]
        for begin, end in zip(bounds, [*bounds[1:], len(part)], strict=True):
            o, w, x, d = older[begin:end], last[begin:end], following[begin:end], doc[begin:end]
            new = np.nonzero(_changes(w, x, o))[0]
            repeats = np.diff(np.append(new, len(d)))
            o, w, x = o[new], w[new], x[new]
            pair = _changes(w, x)
            n1 = np.zeros(pair.sum(), dtype=np.int64)
            often = block.often[w[pair]]
            if often.any():
                w1, x1 = w[pair][often].astype(np.int64), x[pair][often]
                # Beforehand: the count, above it whether the word is a node, and a mark that this is so.
                count, _ = _looked_up(block.after, block.after_n, w1 * n + x1)
                n1[often] = count * 4 + block.node[w1] * 2 + 1
            o, w, x = block.number[o], block.number[w], block.number[x]
            columns = (_steps(w, np.arange(len(w)) == 0), _steps(x, _changes(w)), _steps(o, pair), repeats - 1, d, n1)
            bodies.append(packed(np.array([learned, docs]), *columns))
            to.append(part[begin])
        rows = len(bodies)
        home, empty = -1 - key[0].as_py(), pa.nulls
        return pa.table(
            {
                "part": pa.array([*(int(p) for p in to), *[home] * docs], pa.int64()),
                "block": pa.array([key[0].as_py()] * (rows + docs), pa.int64()),
                "body": pa.array([*bodies, *[None] * docs], pa.binary()),
                "doc": pa.concat_arrays([empty(rows, pa.int64()), pa.array(np.arange(docs), pa.int64())]),
                "id": pa.chunked_array([empty(rows, texts["id"].type), *texts["id"].chunks], texts["id"].type),
                **{
                    name: pa.concat_arrays([empty(rows, pa.array(x).type), pa.array(x)])
                    for name, x in (("n_tokens", tokens), ("n_known", known), ("base_score", base))
                },
            }
        )

    return send, f"part long, block long, body binary, doc long, id {kind}, n_tokens long, n_known long, base_score double"


def _read(body: bytes) -> tuple[np.ndarray, ...]:
    """Training texts and texts, then older, last, next and n1 of different triples, their repeats, and the texts."""
    (learned, docs), w, x, o, repeats, d, n1 = unpacked(body)
    w = np.cumsum(w)
    x = _sums_of_steps(x, _changes(w))
    pair = _changes(w, x)
    return learned, docs, _sums_of_steps(o, pair), w, x, n1[np.cumsum(pair) - 1], repeats + 1, d


def _numbered(keys: np.ndarray, small: type) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and of each key its place among them."""
    found, at = np.unique(keys, return_inverse=True)
    return found.astype(np.int64), at.astype(small)


def _tested(tree: WholeTree):
    """What a part gives back: of each block the sums of what its documents gain by the part's contexts."""
    size = np.int64(tree.distinct + 1)
    small = np.int32 if size < 1 << 31 else np.int64

    def test(key: tuple, sent: pa.Table) -> pa.Table:
        names = ["block", "body", "doc", "id", "n_tokens", "n_known", "base_score"]
        if key[0].as_py() < 0:
            return sent.select(names)
        columns = [[] for _ in range(4)]
        given, begin = [], 0
        lengths = []
        for body in sent["body"]:
            learned, _, o, w, x, n1, repeats, d = _read(body.as_py())
            seen = np.add.reduceat(d < learned, np.cumsum(repeats) - repeats, dtype=np.int32)
            for column, values in zip(columns, (seen, o, x, w), strict=True):
                column.append(values.astype(small))
            at = np.nonzero(n1)[0]
            given.append((at + begin, n1[at]))
            lengths.append(len(o))
            begin += len(o)
        # Columns are let go as soon as they are of no more use: a part has millions of rows.
        words, of_word = _numbered(np.concatenate(columns.pop()), small)
        key = of_word * size
        key += np.concatenate(columns.pop())
        entries, of_entry = _numbered(key, small)
        del of_word, key
        word, following = entries // size, entries % size
        o, seen = np.concatenate(columns.pop()), np.concatenate(columns.pop())
        n1 = np.bincount(of_entry, weights=seen, minlength=len(entries))
        beforehand = np.zeros(len(entries), dtype=np.int64)
        for at, values in given:
            beforehand[of_entry[at]] = values
        del given
        often = beforehand & 1 > 0
        n1[often] = beforehand[often] >> 2
        # Each token of training but an end has one after it, and each end a text that begins.
        total = tree.count(words).astype(float)[word]
        root = tree.root(tree.count(following))
        gain, kinds = _gain(word, n1, total, root, len(words))
        node = _is_node(gain, tree.count(words), kinds)[word]
        node[often] = beforehand[often] & 2 > 0
        p, parent = _mix(root, n1, total, node), n1 / np.maximum(total, 1)
        del total, node, entries, following, n1, beforehand, often
        key = of_entry * size
        key += o
        del o, of_entry
        triples, of_triple = _numbered(key, small)
        del key
        n2 = np.bincount(of_triple, weights=seen, minlength=len(triples))
        del seen
        entry = (triples // size).astype(small)
        triples %= size
        triples += word[entry] * size
        pairs, of_pair = _numbered(triples, small)
        del triples
        totals = np.bincount(of_pair, weights=n2, minlength=len(pairs))
        gain, kinds = _gain(of_pair, n2, totals[of_pair], parent[entry], len(pairs))
        node = _is_node(gain, totals, kinds)
        gained = np.log10(_mix(p[entry], n2, totals[of_pair], node[of_pair]) / root[entry])
        del n2, entry, of_pair
        bodies, begin = [], 0
        for body, length in zip(sent["body"], lengths, strict=True):
            _, docs, *_, repeats, d = _read(body.as_py())
            bodies.append(_sums(d, np.repeat(gained[of_triple[begin : begin + length]], repeats), int(docs)))
            begin += length
        return sent.select(names).set_column(1, "body", pa.array(bodies, pa.binary()))

    return test


def _gain(context: np.ndarray, n: np.ndarray, total: np.ndarray, parent: np.ndarray, size: int):
    """Log-likelihood that each context gains over its parent, and its different next tokens."""
    at = np.nonzero(n)[0]
    one = n[at] * np.log(n[at] / total[at] / parent[at])
    return np.bincount(context[at], weights=one, minlength=size), np.bincount(context[at], minlength=size)


def gains(docs: DataFrame, counts: DataFrame, tree: WholeTree, blocks: int, trained: Column | None = None) -> DataFrame:
    """``docs`` (``id``, ``text``) with ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    The contexts are those of the rows of which ``trained`` holds (if given), the texts the tree was grown from.
    """
    # A constant would be put in behind the shuffle, which then differs for its two readers.
    mark = [] if trained is None else [F.coalesce(trained, F.lit(False)).alias("trained")]
    marked = docs.select("id", "text", *mark)
    blocked = marked.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(blocks, "block")
    known = _answered(_asked(blocked, tree), counts, tree)
    kind = docs.schema["id"].dataType.simpleString()
    tree = replace(tree, first={}, grams=None)
    send, schema = _sent(tree, max(1, math.ceil(tree.tokens / PART)), kind)
    sent = blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send, schema)
    back = sent.groupBy("part").applyInArrow(_tested(tree), schema.removeprefix("part long, "))

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        own = rows.filter(pc.is_valid(rows["doc"])).sort_by("doc")
        gain = np.zeros(own.num_rows)
        for body in rows["body"].drop_null():
            at, sums = unpacked(body.as_py())
            gain[np.cumsum(at)] += sums.view(np.float64)
        score = pa.array(own["base_score"].to_numpy() + gain)
        return own.select(["id", "n_tokens", "n_known", "base_score"]).append_column("score", score)

    return back.groupBy("block").applyInArrow(add, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
