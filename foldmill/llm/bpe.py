"""BPE encoding and decoding by batched numpy merge rounds.

Words that a task hasn't met lately are merged together: the symbols of all of
them lie in one flat array, every adjacent pair is looked up by binary search
among the sorted pair keys, and each round merges, in every word, the pair of
the lowest rank. Words met before come from a bounded memo.

A very long word has rounds of its own, in which every place merges whose rank is
the least as far to both sides as the longest token reaches: what is merged beyond
can't reach it before its turn. So the number of rounds doesn't grow with the word,
and the work grows in proportion to its length.

Results by case: null text counts as empty; empty text gives no ids; repeated
rows give repeated results; the strings of added tokens become their ids; a
very long text, or a text that is a single word, is handled alone; an empty table
gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: how byte-level BPE splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FAR = np.int64(1) << 40
#: Bytes over which a word has rounds of its own.
LONG = 2_000


def _least_around(rank: np.ndarray, reach: int) -> np.ndarray:
    """The least value from ``reach`` places before to as many behind each place."""
    wide, n = 2 * reach + 1, len(rank)
    rows = -(-(n + 2 * reach) // wide)
    flat = np.full(rows * wide, _FAR)
    flat[reach : reach + n] = rank
    block = flat.reshape(rows, wide)
    ahead = np.minimum.accumulate(block, 1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n])


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Bpe:
    """Tables of one vocabulary (some MB, whatever the corpus) and the merge rounds."""

    most = 400_000

    def __init__(self, spec: str):
        j = json.loads(spec)
        vocab, chars = dict(j["model"]["vocab"]), byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.size = max([*vocab.values(), *(a["id"] for a in j["added_tokens"])]) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        into = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.pieces = [b""] * self.size
        for s, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        self.added = {a["content"]: a["id"] for a in j["added_tokens"]}
        for s, i in self.added.items():
            self.pieces[i] = s.encode()
        self.reach = max(map(len, self.pieces))
        self._ready()

    def _ready(self):
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN)
        self.stops = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "split", "stops")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each non-empty word, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(sym), _FAR)
            if len(sym) > 1:
                key = sym[:-1] * self.size + sym[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = (self.keys[at] == key) & (word[1:] == word[:-1])
                rank[:-1][known] = self.ranks[at[known]]
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(sym)])
            over = least == _FAR
            if over.any():
                flat = sym.astype("<u4").tobytes()
                for w, s, n in zip(word[start[over]].tolist(), start[over].tolist(), size[over].tolist()):
                    out[w] = flat[4 * s : 4 * (s + n)]
                if over.all():
                    break
            goes = np.repeat(over, size)
            hit = (rank == np.repeat(least, size)) & ~goes
            i = np.flatnonzero(hit)
            run = np.r_[True, np.diff(i) != 1]  # in a run of equal symbols, every other pair merges, from the left
            i = i[(np.arange(len(i)) - np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))) % 2 == 0]
            sym[i] = self.into[rank[i]]
            keep = ~goes
            keep[i + 1] = False
            sym, word = sym[keep], word[keep]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _FAR)

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one word, by rounds of all merges that nothing farther off can forestall."""
        sym = self.first[np.frombuffer(word, np.uint8)]
        rank = self._ranks(sym[:-1], sym[1:])
        while len(rank) and rank.min() < _FAR:
            hit = (rank == _least_around(rank, self.reach)) & (rank < _FAR)
            i = np.flatnonzero(hit)
            # Pairs that overlap (equal symbols) merge every other place from the left: only as far as all of them are certain, from where their run begins.
            run = np.r_[True, (np.diff(i) != 1) | (rank[i[1:]] != rank[i[:-1]])]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))
            first = i[begin]
            certain = (first == 0) | (rank[np.maximum(first - 1, 0)] != rank[first])
            i = i[((np.arange(len(i)) - begin) % 2 == 0) & certain]
            sym[i] = self.into[rank[i]]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            here = np.cumsum(keep)[i] - 1  # places of the new symbols
            # A pair that loses its right symbol to the left one is gone; those beside a new symbol are looked up again.
            rank = rank[keep[1:]] if len(keep) > 1 else rank
            sym = sym[keep]
            stale = np.unique(np.r_[here - 1, here])
            stale = stale[(stale >= 0) & (stale < len(sym) - 1)]
            rank = rank[: len(sym) - 1]
            rank[stale] = self._ranks(sym[stale], sym[stale + 1])
        return sym.astype("<u4").tobytes()

    def pretokens(self, text: str) -> list[str]:
        if not self.stops or not any(s in text for s in self.added):
            return self.split.findall(text)
        out = []
        for k, part in enumerate(self.stops.split(text)):
            out += [part] if k % 2 else self.split.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; all new words of the texts are merged in one go."""
        if len(self.words) > self.most:
            self.words.clear()
        split = [self.pretokens(t) for t in texts]
        own = {s: np.array([i], "<u4").tobytes() for s, i in self.added.items()}
        new = list(set().union(*split) - self.words.keys() - own.keys())
        coded = [w.encode() for w in new]
        short = [w for w in coded if len(w) <= LONG]
        merged = iter(self.merge(short))
        found = {w: self.merge_long(c) if len(c) > LONG else next(merged) for w, c in zip(new, coded)}
        self.words |= {w: v for w, v in found.items() if len(w) <= 64}
        known = self.words | own if any(s in t for s in self.added for t in texts) else self.words
        return [b"".join([known[w] if w in known else found[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def in_groups(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts with about ``chars`` characters in all, so that the lists of words stay small."""
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= chars:
            yield group
            group, n = [], 0
    if group:
        yield group


def load_spec(path: str) -> str:
    """The tokenizer file, read on the driver: its size doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32; if ``keep_ids``), ids_sha256, decoded_sha256 for every row of ``docs``."""
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(Bpe(load_spec(tokenizer_path)))

    def run(batches):
        bpe = tables.value
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            for group in in_groups(texts):
                codes = bpe.encode(group)
                cols = [
                    ids.slice(at, len(group)),
                    pa.array([len(c) // 4 for c in codes], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in codes]),
                    pa.array([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in codes]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.array(codes, pa.binary()))
                    names.append("ids")
                at += len(group)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def bpe_decode(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (binary, little-endian uint32); null ids give empty text."""
    spark = coded.sparkSession
    tables = spark.sparkContext.broadcast(Bpe(load_spec(tokenizer_path)))

    def run(batches):
        bpe = tables.value
        for batch in batches:
            texts = [bpe.decode(c or b"") for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldmill.llm._shared import table

    return bpe_encode(table(spark, sf_dir, "documents"), default_path(), keep_ids=False)
