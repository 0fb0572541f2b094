"""Byte-level BPE: boundaries by scans of transition functions over codepoint classes, then cached pair merging.

The pattern that is followed splits contractions ('s 't 're 've 'm 'll 'd), runs of letters, of numbers and of other
characters, each with one space before it if there is one, and runs of white space, of which the last character is left
to what follows. No regular expression runs: a character's symbol is its class plus what the next one or two tell, each
symbol is a function from state to state, and functions are composed, which is associative, so that blocks of characters
are folded side by side and the blocks' functions are then scanned.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared

#: The characters with the property White_Space, and what may follow an apostrophe in a contraction.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
AFTER_ONE = "stmd"
AFTER_TWO = ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols: the four classes, the last character of white space before something else (a blank, or any other), an apostrophe that may begin a contraction of one or of two letters.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_BLANK, S_LAST, S_ONE, S_TWO = range(8)
#: States: between pieces, in a run of each class, after a blank that joins what follows, in a contraction with one or two letters to come.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, JOINED, ONE_LEFT, TWO_LEFT = range(8)
BLOCK = 64


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, for 8 symbols (and 8 more: the same at a text's start) and 8 states."""
    to, cut = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for state in range(8):
        for symbol, run in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS)):
            to[symbol, state], cut[symbol, state] = run, state not in (run, JOINED)
        to[S_SPACE, state], cut[S_SPACE, state] = IN_SPACE, state != IN_SPACE
        to[S_BLANK, state], to[S_LAST, state] = JOINED, FREE
        for symbol, left in ((S_ONE, ONE_LEFT), (S_TWO, TWO_LEFT)):
            joins = state in (IN_OTHERS, JOINED)
            to[symbol, state], cut[symbol, state] = (IN_OTHERS, False) if joins else (left, True)
    to[S_LETTER, ONE_LEFT], cut[S_LETTER, ONE_LEFT] = FREE, False
    to[S_LETTER, TWO_LEFT], cut[S_LETTER, TWO_LEFT] = ONE_LEFT, False
    to[8:] = to[:8, FREE][:, None]
    return to, cut


_TO, _CUT = _machine()
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every codepoint."""
    if not _classes:
        own = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind in "LN":
                own[cp] = LETTER if kind == "L" else NUMBER
        own[WHITE_SPACE] = SPACE
        _classes.append(own)
    return _classes[0]


def _symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first: whether a character begins a text."""
    n = len(cp)
    kind = classes()[cp]
    sym = kind.copy()  # S_LETTER..S_SPACE number as the classes do
    ends = np.append(first[1:], True)  # the text's last character
    white = kind == SPACE
    last = white & ~ends & ~np.append(white[1:], True)
    sym[last] = np.where(cp[last] == 0x20, S_BLANK, S_LAST)
    quotes = np.flatnonzero((cp == 0x27) & ~ends)
    if len(quotes):
        a = cp[quotes + 1]
        sym[quotes[np.isin(a, [ord(x) for x in AFTER_ONE])]] = S_ONE
        longer = quotes + 2 < n
        q, a = quotes[longer], a[longer]
        b, inside = cp[q + 2], ~first[q + 2]
        for x, y in AFTER_TWO:
            sym[q[inside & (a == ord(x)) & (b == ord(y))]] = S_TWO
    sym[first] += 8
    return sym


def boundaries(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin, among the codepoints of texts that follow each other."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    sym = _symbols(cp, first)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.intp)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) * 8
    table = _TO.ravel()
    # Fold each block to one function of the state before it.
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in grid:
        whole = table[row[:, None] + whole]
    # Scan the blocks' functions: after each round an entry covers twice as many blocks.
    reach = 1
    while reach < blocks:
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach], 1)
        reach *= 2
    state = np.empty(blocks, np.uint8)
    state[0], state[1:] = FREE, whole[:-1, FREE]
    # Replay the blocks from their states.
    cuts, flat = np.empty((BLOCK, blocks), bool), _CUT.ravel()
    for j, row in enumerate(grid):
        at = row + state
        cuts[j] = flat[at]
        state = table[at]
    return np.flatnonzero(cuts.T.ravel()[:n])


class Merger(dict):
    """Piece bytes -> its ids (as the bytes of uint32s), by merging the pair of lowest rank until none is left.

    Pieces that a run of texts brings anew are merged side by side; what was merged is kept, up to `most` pieces.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 600_000):
        self.ranks, self.most = ranks, most
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(ranks.values()) + 1
        # Every way to put a token together from two others: (left, right) -> its id, which is its rank.
        pairs = {ranks[t[:i]] * self.base + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def learn(self, pieces: set[bytes]) -> None:
        """Merge those that are not known yet."""
        if len(self) + len(pieces) > self.most:
            self.clear()
        by_size: dict[int, list[bytes]] = {}
        for p in pieces:
            if p not in self:
                if (whole := self.ranks.get(p)) is not None:
                    self[p] = whole.to_bytes(4, "little")
                elif len(p) > 128:
                    self[p] = np.array(self.merge_long(p), np.uint32).tobytes()
                else:
                    by_size.setdefault(len(p), []).append(p)
        for size, own in by_size.items():
            for at in range(0, len(own), 1 << 14):
                self._merge_side_by_side(own[at : at + (1 << 14)], size)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, `base` where it makes no token or where a part is missing (-1)."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], self.base)

    def _merge_side_by_side(self, pieces: list[bytes], size: int) -> None:
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)].reshape(len(pieces), size)
        ids = np.concatenate([ids, np.full((len(pieces), 1), -1)], 1)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        todo = np.arange(len(pieces))
        column = np.arange(size + 1)
        while len(todo):
            at = rank[todo].argmin(1)
            low = rank[todo, at]
            on = low < self.base
            todo, at, low = todo[on], at[on], low[on]
            if not len(todo):
                break
            ids[todo, at] = low
            closer = np.minimum(column + (column > at[:, None]), size)
            ids[todo] = np.take_along_axis(ids[todo], closer, 1)
            rank[todo] = np.take_along_axis(rank[todo], closer[:, :-1].clip(max=size - 1), 1)
            rank[todo, -1] = self.base
            rank[todo, at] = self._rank(low, ids[todo, at + 1])
            inner = at > 0
            rank[todo[inner], at[inner] - 1] = self._rank(ids[todo[inner], at[inner] - 1], low[inner])
        count = (ids >= 0).sum(1) * 4
        flat = ids.astype(np.uint32).tobytes()
        step = (size + 1) * 4
        for i, (p, n) in enumerate(zip(pieces, count.tolist())):
            self[p] = flat[i * step : i * step + n]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for one long run, with a heap over linked parts."""
        ranks, n = self.ranks, len(piece)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heappop(heap)
            if not alive[i] or (mid := nxt[i]) >= n or nxt[mid] != end:
                continue
            alive[mid], nxt[i] = False, end
            if end < n:
                prev[end] = i
                if (r := ranks.get(piece[i : nxt[end]])) is not None:
                    heappush(heap, (r, i, nxt[end]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : nxt[i]]])
            i = nxt[i]
        return out


class Vocabulary:
    """Ranks of a .tiktoken file: the merger for encoding, and the tokens' bytes laid end to end for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.merger = Merger(self.ranks)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = [str(i) for i in range(len(tokens))]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        total = int(size.sum())
        shift = self.start[ids] - (np.cumsum(size) - size)
        return self.bytes[np.repeat(shift, size) + np.arange(total)].tobytes()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _runs(texts: list[str], most: int = 400_000) -> Iterator[list[str]]:
    run, size = [], 0
    for x in texts:
        if run and size + len(x) > most:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x)
    if run:
        yield run


def encode_texts(texts: list[str], vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of each text, and where its pieces begin and end in its bytes."""
    for run in _runs(texts):
        joined = "".join(run)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = joined.encode()
        length = np.array([len(x) for x in run], np.int64)
        begins = np.concatenate([[0], np.cumsum(length)])
        first = np.zeros(len(cp) + 1, bool)
        first[begins] = True
        cut = boundaries(cp, first[:-1])
        width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        edges = np.append(at[cut], len(data))
        place = np.searchsorted(cut, begins)
        bounds = edges.tolist()
        pieces = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        ids_of = vocab.merger
        ids_of.learn(set(pieces))
        for i in range(len(run)):
            own = pieces[place[i] : place[i + 1]]
            yield np.frombuffer(b"".join([ids_of[p] for p in own]), np.uint32), edges[place[i] : place[i + 1] + 1] - at[begins[i]] if own else np.zeros(1, np.int64)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            ids, edges = [], []
            for i, e in encode_texts(b.column("text").to_pylist(), vocab):
                ids.append(i.astype(np.int32))
                edges.append(e)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(edges, pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            out = [vocab.decode(np.array(x.as_py() or [], np.int64)) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, offsets array<long>: the token ids of every whole text, and the byte offsets at which its pieces begin, then its length.

    No special tokens: their strings in a text are ordinary text. Null counts as empty, which has no ids and the offset 0.
    Repeated rows give a row each, rows without a doc_id are left out, other columns are not read.
    """
    return shared.texts(docs).mapInArrow(_encode(path), "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded binary: the bytes that the ids stand for. Null ids count as none."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, decoded binary")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            count, ids_sha, text_sha = [], [], []
            for ids, _ in encode_texts(b.column("text").to_pylist(), vocab):
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([vocab.decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() and decode() in one pass, of which only digests leave the task."""
    return shared.texts(docs).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
