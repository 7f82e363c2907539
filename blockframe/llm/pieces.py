"""SentencePiece encoding and decoding: Viterbi over a double-array trie of pieces with log scores, byte fallback and white-space marks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe.llm.common import handing_back, table
from blockframe.llm.segments import SegmentEncoder, chunks

#: The white-space mark, U+2581.
MARK = b"\xe2\x96\x81"
#: What an unknown character costs beyond the lowest score.
UNKNOWN_PENALTY = 10.0
#: Segments up to so many bytes are decoded side by side, longer ones alone.
SIDE_BY_SIDE = 64
#: Segments decoded side by side at once.
TOGETHER = 1 << 12
#: Bytes of text encoded at once (a longer single text counts as one).
PART_BYTES = 1 << 18
#: Distinct segments that a worker remembers during a task.
REMEMBERED = 120_000
NORMAL, BYTE = 1, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """Protocol buffer fields: number, wire type, value."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, kind, data[at : at + size]
            at += size


class DoubleArray:
    """A byte trie in arrays: the child of state s by byte b is base[s] + b if check there is s + 1; value holds a piece's id or -1."""

    def __init__(self, words: dict[bytes, int]):
        tree: dict = {}
        for word, n in words.items():
            node = tree
            for b in word:
                node = node.setdefault(b, {})
            node[-1] = n
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.zeros(size, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        first, crowded, todo = 1, 1, [(0, tree)]
        for state, node in todo:
            if -1 in node:
                self.value[state] = node[-1]
            keys = [b for b in node if b >= 0]
            if not keys:
                continue
            first = used.find(0, first)
            first = len(used) if first < 0 else first
            low, at, tries = min(keys), first if len(keys) == 1 else max(first, crowded), 0
            while True:
                base = at - low
                top = base + 256
                if top >= len(used):
                    grow = len(used)
                    used += bytearray(grow)
                    self.base, self.check = np.append(self.base, np.zeros(grow, np.int32)), np.append(self.check, np.zeros(grow, np.int32))
                    self.value = np.append(self.value, np.full(grow, -1, np.int32))
                if base >= 0 and not any(used[base + b] for b in keys):
                    break
                at, tries = used.find(0, at + 1), tries + 1
                at = len(used) if at < 0 else at
            if tries > 16:  # states with several children no longer look for room before here
                crowded = max(crowded, at - 256)
            self.base[state] = base
            for b in keys:
                used[base + b] = 1
                self.check[base + b] = state + 1
                todo.append((base + b, node[b]))
        end = len(used) + 256
        self.base, self.check, self.value = (np.append(x, np.full(end - len(x), fill, np.int32)) for x, fill in ((self.base, 0), (self.check, 0), (self.value, -1)))


def zipf_scores(ranks: np.ndarray) -> np.ndarray:
    """Log scores of pieces that are known by their rank alone (0: the most frequent): by Zipf's law the k-th has the share 1 / k, over the sum of these. To single precision, as in model files."""
    order = np.empty(len(ranks), np.int64)
    order[np.argsort(ranks, kind="stable")] = np.arange(1, len(ranks) + 1)
    return (-np.log(order) - np.log((1 / np.arange(1, len(ranks) + 1)).sum())).astype(np.float32).astype(np.float64)


@dataclass
class Vocabulary:
    """pieces (bytes), scores (logarithms of shares), kinds (as in a SentencePiece model file)."""

    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str, ranked: bool = False) -> Vocabulary:
        """From a model file whose normaliser is the identity; others are refused. A Unigram model's scores are log scores. A BPE model's are the negative ranks of its
        merges: with ranked=True pieces get the log scores of these ranks (see zipf_scores), else such a file is refused too."""
        pieces, scores, kinds, dummy, model = [], [], [], True, UNIGRAM
        with open(path, "rb") as f:
            data = f.read()
        for number, _, value in _fields(data):
            if number == 1:
                got = {n: v for n, _, v in _fields(value)}
                pieces.append(got[1])
                scores.append(float(np.frombuffer(got.get(2, b"\0" * 4), "<f4")[0]))
                kinds.append(got.get(3, NORMAL))
            elif number == 2:
                model = {n: v for n, _, v in _fields(value)}.get(3, UNIGRAM)
            elif number == 3:
                norm = {n: v for n, _, v in _fields(value)}
                dummy = bool(norm.get(3, 1))
                if norm.get(2) or norm.get(4, 1):
                    raise ValueError("the model's normaliser changes texts")
        made = cls(pieces, np.array(scores), np.array(kinds), dummy)
        if model != UNIGRAM:
            if model != BPE or not ranked:
                raise ValueError("the model's scores are no log scores")
            plain = made.kinds == NORMAL
            made.scores[plain] = zipf_scores(-made.scores[plain])
        return made

    def check(self) -> Vocabulary:
        """The properties that the segments rely on: bytes to fall back on, and no piece that goes on with a mark after another character."""
        if (self.kinds == BYTE).sum() != 256 or any(MARK in p.lstrip(MARK) and MARK in p[len(p) - len(p.lstrip(MARK)) :] for p in self._normal):
            raise ValueError("the model lacks byte pieces or has pieces across words")
        return self

    @cached_property
    def _normal(self) -> dict[bytes, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}

    @cached_property
    def trie(self) -> DoubleArray:
        return DoubleArray(self._normal)

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([i for _, i in sorted((int(self.pieces[i][3:5], 16), i) for i in np.flatnonzero(self.kinds == BYTE))])

    @cached_property
    def unknown(self) -> float:
        return float(self.scores[self.kinds == NORMAL].min()) - UNKNOWN_PENALTY

    @cached_property
    def alone(self) -> np.ndarray:
        """ASCII bytes that no piece of several characters holds: segments may end on either side."""
        seen = {b for p in self._normal if len(p) > 1 for b in p}
        return np.array([b < 128 and b not in seen and b != 32 for b in range(256)])

    # -- encoding ---------------------------------------------------------------------------------------------

    def borders(self, flat: np.ndarray) -> np.ndarray:
        """Before each run of spaces, and around bytes that stand alone: no piece crosses these places, so the best path is made of the best paths between."""
        out = np.zeros(len(flat), bool)
        lone = self.alone[flat]
        out[1:] = (flat[1:] == 32) & (flat[:-1] != 32) | lone[1:] | lone[:-1]
        return out

    def encode_segments(self, segments: list[bytes]) -> list[np.ndarray]:
        marked = [s.replace(b" ", MARK) for s in segments]
        out: list = [None] * len(marked)
        order = sorted(range(len(marked)), key=lambda i: len(marked[i]))
        at = 0
        while at < len(order) and len(marked[order[at]]) <= SIDE_BY_SIDE:
            longest = min(SIDE_BY_SIDE, max(8, len(marked[order[at]]) + 3))
            end = at
            while end < len(order) and len(marked[order[end]]) <= longest and end - at < TOGETHER:
                end += 1
            for i, ids in zip(order[at:end], self._together([marked[i] for i in order[at:end]]), strict=True):
                out[i] = ids
            at = end
        for i in order[at:]:
            out[i] = self._alone(marked[i])
        return out

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Viterbi over many short texts at once: position by position, all their lattices one step further down the trie."""
        sizes = np.array([len(t) for t in texts])
        width, n = int(sizes.max(initial=0)), len(texts)
        codes = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(n, width).astype(np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        head = codes & 0xC0
        length = np.where(codes < 0x80, 1, np.where(codes < 0xE0, 2, np.where(codes < 0xF0, 3, 4)))
        for start in range(width):
            rows = np.flatnonzero((best[:, start] > -np.inf) & (sizes > start))
            if not len(rows):
                continue
            here, size = best[rows, start], length[rows, start]
            single, state, live = np.zeros(len(rows), bool), np.zeros(len(rows), np.int32), np.arange(len(rows))
            for to in range(start + 1, width + 1):
                step = base[state] + codes[rows[live], to - 1]
                good = (check[step] == state + 1) & (sizes[rows[live]] >= to)
                live, state = live[good], step[good]
                if not len(live):
                    break
                found = value[state] >= 0
                at, ids = live[found], value[state[found]]
                single[at] |= size[at] == to - start
                self._improve(best, back, piece, rows[at], start, to, here[at] + self.scores[ids], ids)
            lost = np.flatnonzero(~single)
            for n_bytes in (1, 2, 3, 4):
                at = lost[np.minimum(size[lost], sizes[rows[lost]] - start) == n_bytes]
                if len(at):
                    self._improve(best, back, piece, rows[at], start, start + n_bytes, here[at] + self.unknown, np.full(len(at), -1, np.int32))
        del head
        out = []
        back_, piece_ = back.tolist(), piece.tolist()
        for text, b, p in zip(texts, back_, piece_, strict=True):
            out.append(self._path(text, b, p))
        return out

    @staticmethod
    def _improve(best, back, piece, rows, start, to, score, ids) -> None:
        better = score > best[rows, to]  # ties: the path whose last piece began first stays
        rows = rows[better]
        best[rows, to], back[rows, to], piece[rows, to] = score[better], start, ids[better]

    def _path(self, text: bytes, back: list, piece: list) -> list[int]:
        out, at = [], len(text)
        while at:
            start = back[at]
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [int(self.byte_ids[b]) for b in reversed(text[start:at])]
            at = start
        return out[::-1]

    def _alone(self, text: bytes) -> list[int]:
        """Viterbi over one long text."""
        base, check, value, scores = self._lists
        n = len(text)
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            if here == float("-inf"):
                continue
            b = text[start]
            size = min(n - start, 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            state, single = 0, False
            for to in range(start, n):
                step = base[state] + text[to]
                if check[step] != state + 1:
                    break
                state = step
                if (got := value[state]) >= 0:
                    single |= to + 1 - start == size
                    if here + scores[got] > best[to + 1]:
                        best[to + 1], back[to + 1], piece[to + 1] = here + scores[got], start, got
            if not single and here + self.unknown > best[start + size]:
                best[start + size], back[start + size], piece[start + size] = here + self.unknown, start, -1
        return self._path(text, back, piece)

    @cached_property
    def _lists(self) -> tuple[list, list, list, list]:
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()

    @cached_property
    def encoder(self) -> SegmentEncoder:
        self.check()
        return SegmentEncoder(self.encode_segments, self.borders, most=REMEMBERED)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more entry at the end). An empty text has none."""
        return self.encoder.texts([b" " + t if self.dummy_prefix and t else t for t in texts])

    # -- decoding ---------------------------------------------------------------------------------------------

    @cached_property
    def _plain(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces one after the other, and where each begins; control pieces have none."""
        out = []
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            out.append(bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, b" ") if k == NORMAL else b"")
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in out])])

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Texts of the id sequences that begin at starts (one more entry at the end). Marks become spaces; the dummy prefix goes."""
        flat, at = self._plain
        begin, size = at[ids], at[ids.astype(np.int64) + 1] - at[ids]
        after = np.cumsum(size)
        data = flat[np.repeat(begin - (after - size), size) + np.arange(after[-1] if len(after) else 0)].tobytes()
        ends = np.concatenate([[0], after])[starts]
        cut = 1 if self.dummy_prefix else 0
        return [data[a + cut : b] if data[a : a + 1] == b" " else data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path, ranked=True).check()
    return _LOADED[path]


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ids (array of int) and round_trip in place of text_col (columns of those names are replaced). Null texts have null ids and null round_trip, empty ones none.

    Each task loads the vocabulary file at path (the same on every machine). Pieces are chosen by the highest sum of scores over each text; ties
    go to the path whose last piece begins first. A character that no piece holds becomes its UTF-8 bytes' pieces. round_trip tells whether
    decoding gives the text back: always, but for texts that hold the mark U+2581 itself, which decodes to a space.
    Repeated rows are encoded each; an empty table gives no rows. Texts may be of any length.
    """
    names = [c for c in docs.columns if c not in (text_col, "ids", "round_trip")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            column = batch.column(len(names))
            missing = column.is_null().to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts, PART_BYTES):
                ids, at = own.encode(texts[a:b])
                good = [x == y for x, y in zip(own.decode(ids, at), texts[a:b], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(missing[a:b]))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), lists, pa.array(good, mask=missing[a:b])], [*names, "ids", "round_trip"])
        own.encoder.forget()

    return docs.select(*names, F.col(text_col).alias(text_col)).mapInArrow(handing_back(run), ", ".join(filter(None, [kinds, "ids array<int>, round_trip boolean"])))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_pieces, n_bytes (pieces that are bytes), ids_crc32 (of the ids as little-endian 32-bit integers), round_trip. Null texts count as empty, rows
    of any id are encoded each; ties between paths go to the one whose last piece begins first. Other columns are ignored; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    path = model_path()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts, PART_BYTES):
                ids, at = own.encode(texts[a:b])
                good = [x == y for x, y in zip(own.decode(ids, at), texts[a:b], strict=True)]
                count = np.concatenate([[0], np.cumsum(own.kinds[ids] == BYTE)])[at]
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(np.diff(count)), pa.array(crc, pa.int64()), pa.array(good)], ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"])
        own.encoder.forget()

    return docs.select("doc_id", "text").mapInArrow(handing_back(digest), "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean")


ORACLE_SQL: dict[str, str] = {}


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, lang, source and the pieces' ids of each document (round_trip: whether they give its text back); all other columns go. Null texts have null ids."""
    return encode_pieces(docs.select("doc_id", "lang", "source", "text"), model_path())
