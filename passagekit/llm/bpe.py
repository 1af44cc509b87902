"""Byte-level BPE encoding and decoding with a public vocabulary file.

A text is divided into short words by the vocabulary's pattern. Each word is encoded over a
contiguous rank array: its part boundaries, and beside each boundary the rank of the merge of the
two parts that meet there. The smallest rank is searched by a scan, its boundary deleted
and the ranks of the two neighbouring boundaries refreshed, until no merge is left. New
words of a batch are encoded side by side, one row of the arrays for each word; words
longer than ``LONG_WORD`` bytes are too long for repeated scans and keep their ranks in a heap.
Encoded words are remembered in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import import_on_workers, table, text_of

#: The division of a text into words that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank between white space and white space or the end of the text. Without one, a text divides at its blanks.
AMBIGUOUS_BLANK = regex.compile(r"\s (?:\s|\Z)")
#: Words above this many bytes are encoded with a heap instead of scans.
LONG_WORD = 64
#: Chunks remembered by a worker before it starts anew.
REMEMBERED = 800_000
#: A rank above all others: these parts don't merge.
NEVER = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The characters by which the vocabulary file writes the 256 byte values.

    Printable Latin-1 characters stand for themselves; the other bytes in order for the
    characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def tokens_of(path: str) -> tuple[dict, dict[int, bytes], dict[str, int]]:
    """Model, bytes by id and special tokens of a byte-level BPE file."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, symbols = content["model"], byte_symbols()
    bytes_of = {i: bytes(symbols[c] for c in t) for t, i in model["vocab"].items() if all(c in symbols for c in t)}
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    return model, bytes_of | {i: t.encode() for t, i in special.items()}, special


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        model, self.bytes_of, self.special = tokens_of(path)
        symbols, ids = byte_symbols(), model["vocab"]
        self.first = np.zeros(256, dtype=np.int64)
        for symbol, byte in symbols.items():
            self.first[byte] = ids[symbol]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left id, right id) as one number -> rank, merged id
        self.merges = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array(list(self.merges), dtype=np.int64)
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.int64(2**62))
        self._ranks = np.append(np.array([r for r, _ in self.merges.values()], dtype=np.int32)[order], NEVER)
        self.merged = np.array([i for _, i in self.merges.values()], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of two arrays of ids, ``NEVER`` where there is none."""
        keys = left << 32 | right
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, self._ranks[at], NEVER)

    def encode_rows(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words, encoded side by side, each as little-endian unsigned 32-bit numbers.

        Row r of ``parts`` holds the ids of the parts of word r, row r of ``ranks`` the
        rank of merging each part with the next one.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(lengths.max())
        flat = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        parts = np.full((len(words), width + 1), -1, dtype=np.int64)
        parts[np.arange(width + 1) < lengths[:, None]] = flat
        ranks = np.full((len(words), width + 1), NEVER, dtype=np.int32)
        held = np.arange(width) < (lengths - 1)[:, None]
        rows, columns = np.nonzero(held)
        ranks[rows, columns] = self.ranks(parts[rows, columns], parts[rows, columns + 1])
        out = [b""] * len(words)
        active = np.arange(len(words))
        while len(active):
            at = ranks.argmin(axis=1)
            line = np.arange(len(active))
            least = ranks[line, at]
            done = least == NEVER
            if done.any():
                # One buffer for all words that are done; each is cut from its row.
                raw, ended = parts[done].astype("<u4").tobytes(), active[done]
                starts = range(0, len(raw), 4 * (width + 1))
                for word, start, size in zip(ended.tolist(), starts, (4 * lengths[ended]).tolist(), strict=True):
                    out[word] = raw[start : start + size]
                going = ~done
                active, parts, ranks = active[going], parts[going], ranks[going]
                at, least = at[going], least[going]
                line = np.arange(len(active))
                if not len(active):
                    break
            # The boundary after `at` goes: what follows it moves one place to the left.
            moved = np.arange(width) > at[:, None]
            parts[:, :-1] = np.where(moved, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(np.arange(width) >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            parts[line, at] = self.merged[least]
            lengths[active] -= 1
            last = lengths[active] - 1
            right = at < last
            ranks[line[right], at[right]] = self.ranks(parts[line[right], at[right]], parts[line[right], at[right] + 1])
            ranks[line[~right], at[~right]] = NEVER
            left = at > 0
            ranks[line[left], at[left] - 1] = self.ranks(parts[line[left], at[left] - 1], parts[line[left], at[left]])
        return out

    def encode_long(self, word: bytes) -> list[int]:
        """Ids of one long word: the same merges, the smallest rank taken from a heap."""
        part = [int(self.first[b]) for b in word]
        after = [*range(1, len(part)), -1]
        before = list(range(-1, len(part) - 1))
        merges = self.merges
        heap = [
            (found[0], i, part[i], part[i + 1])
            for i in range(len(part) - 1)
            if (found := merges.get(part[i] << 32 | part[i + 1]))
        ]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or part[i] != left or part[j] != right:
                continue
            part[i], part[j] = merges[left << 32 | right][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get(part[i] << 32 | part[k]):
                    heapq.heappush(heap, (found[0], i, part[i], part[k]))
            if (h := before[i]) >= 0 and (found := merges.get(part[h] << 32 | part[i])):
                heapq.heappush(heap, (found[0], h, part[h], part[i]))
        return [p for p in part if p >= 0]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Distinct words to their ids, as little-endian unsigned 32-bit numbers."""
        found, by_width = {}, {}
        for word in words:
            if len(word) > LONG_WORD:
                found[word] = np.array(self.encode_long(word), dtype="<u4").tobytes()
            else:
                by_width.setdefault((len(word) + 3) // 4, []).append(word)
        for same in by_width.values():
            for start in range(0, len(same), 16384):
                some = same[start : start + 16384]
                found.update(zip(some, self.encode_rows(some), strict=True))
        return found


class Encoder:
    """Encodes batches of texts; chunks between blanks are looked up, new ones encoded together."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary = vocabulary
        self.remembered = remembered
        self._pattern = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self._chunks: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        parted = [self._chunked(text) for text in texts]
        if len(self._chunks) > self.remembered:
            self._chunks.clear()
        known = self._chunks
        new = {c for _, chunks in parted for c in chunks if c not in known}
        self._learn(new)
        for specials, chunks in parted:
            if specials is None:
                yield b"".join(map(known.__getitem__, chunks))
            else:
                yield b"".join(specials.get(c) or known[c] for c in chunks)

    def _chunked(self, text: str) -> tuple[dict[str, bytes] | None, list[str]]:
        """Chunks that no word crosses; texts of special tokens stand among them if the text has any."""
        if self._special is None or not self._special.search(text):
            return None, self._divided(text)
        ids = {t: np.array([i], dtype="<u4").tobytes() for t, i in self.vocabulary.special.items()}
        chunks, start = [], 0
        for match in self._special.finditer(text):
            chunks += [*self._divided(text[start : match.start()]), match[0]]
            start = match.end()
        return ids, [*chunks, *self._divided(text[start:])]

    def _divided(self, text: str) -> list[str]:
        if not text:
            return []
        if AMBIGUOUS_BLANK.search(text):
            return self._pattern.findall(text)
        first, *others = text.split(" ")
        # A chunk keeps the blank before it, which belongs to its first word.
        return [first, *(" " + c for c in others)] if first else [" " + c for c in others]

    def _learn(self, chunks: set[str]) -> None:
        order, divide = list(chunks), self._pattern.findall
        words = [divide(c) for c in order]
        distinct = list({w for ws in words for w in ws})
        raw = [w.encode() for w in distinct]
        by_bytes = self.vocabulary.encode_words(raw)
        ids = dict(zip(distinct, map(by_bytes.__getitem__, raw), strict=True))
        for chunk, ws in zip(order, words, strict=True):
            self._chunks[chunk] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """Text of the ids; bytes that are not UTF-8 become replacement characters."""
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file that every machine has."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


#: Texts that are encoded together: enough to share the arrays, few enough for memory.
TOGETHER = 256


def encode_batches(path: str, texts: Iterable[str]) -> Iterator[bytes]:
    """Ids of many texts in order, encoded ``TOGETHER`` at a time."""
    encoder, some = worker_encoder(path), []
    for text in texts:
        some.append(text)
        if len(some) == TOGETHER:
            yield from encoder.encode(some)
            some = []
    yield from encoder.encode(some)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every text; a null text counts as empty."""
    import_on_workers(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        found = list(encode_batches(path, (t.as_py() for t in texts)))
        sizes = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int32)
        values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
        return pa.ListArray.from_arrays(pa.array(sizes), values)

    return docs.select(F.col(id_col), of(text_of(text_col)).alias("ids"))


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of arrays of ids; null ids give the empty text.

    An id that the vocabulary doesn't have raises ``KeyError``.
    """
    import_on_workers(tokens.sparkSession)

    @F.arrow_udf("string")
    def of(ids: pa.Array) -> pa.Array:
        vocabulary = worker_encoder(path).vocabulary
        return pa.array([decode(vocabulary, i.as_py() or ()) for i in ids], pa.string())

    return tokens.select(F.col(id_col), of(F.col(ids_col)).alias("text"))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number and a digest of its ids, and a digest of the text they decode to.

    Columns: ``id_col``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256``. Null and empty texts have no tokens; rows with equal or null ids all
    stay, other columns are ignored, and an empty table gives no row. Ids do not leave
    the task, so that no column of arrays is written.
    """
    import_on_workers(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def of(texts: pa.Array) -> pa.Array:
        vocabulary = worker_encoder(path).vocabulary
        names = [b"%d" % i for i in range(1 + max(vocabulary.bytes_of))]
        pieces, sizes, first, second = vocabulary.bytes_of, [], [], []
        for raw in encode_batches(path, (t.as_py() for t in texts)):
            ids = np.frombuffer(raw, dtype="<u4").tolist()
            sizes.append(len(ids))
            first.append(hashlib.sha256(b",".join(map(names.__getitem__, ids))).hexdigest())
            back = b"".join(map(pieces.__getitem__, ids)).decode("utf-8", errors="replace")
            second.append(hashlib.sha256(back.encode()).hexdigest())
        columns = [pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
        return pa.StructArray.from_arrays(columns, names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), of(text_of(text_col)).alias("_of")).select(id_col, "_of.*")


def vocabulary_path() -> str:
    """The installed 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents with the 50k vocabulary."""
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())
