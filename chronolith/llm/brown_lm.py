"""Language-model scores of a class-based bigram model whose classes come from exchange clustering.

P(w | before) = (1 - u(p)) P(c | p) n(w) / n(c), with c the class of w, p that of the word before (at first, of the end of
text), and u(p) the chance that an unknown word follows p: the share of training words seen once among those after p. An
unknown word has the probability u(p). Transitions are smoothed towards the classes' own shares.

Exchange: the most frequent words begin as classes of their own, all others as one class. In a sweep every word's neighbours
are counted by their classes, left and right, over all training texts; the word's own counts are taken off its class, and it
goes to the class where the likelihood of the class bigrams gains most: f(N) = N log N of the pair counts, less f of the
classes' counts on either side. Words that are much seen are put into every class exactly; of the others each count is worth
what one more is worth, which understates no class but the emptiest. Half of the words, by turns, move side by side; the
likelihood of the outcome is then computed exactly, and a sweep that lowers it is taken back and ends the exchange.

Nothing of the vocabulary's size is broadcast or collected. Texts are read once and coded in chunks of about CHUNK bytes: each
chunk's distinct words are sorted by hash and cut into buckets of hash ranges, which meet over all chunks to sum the counts.
From then on a word is a place in its bucket: buckets answer chunks with classes, chunks answer buckets with counts of
classes. A chunk and bucket have at most one row, and never more rows than there are distinct words in the chunks. A bucket
that more than ROWS chunks have words in, as each has that holds a frequent word, is cut into parts by chunk: parts are summed
by themselves, then together, and each part asks its own copy of the bucket.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, vec

SWEEPS = 4
#: A kind is a class, or UNKNOWN; ONCE marks words seen once.
MOST_CLASSES, UNKNOWN, ONCE, KINDS = 120, 0x7F, 0x80, 128
END_WORD = np.uint64(0xE5D0F7E47)
CHUNK, BUCKET = 2 << 20, 8 << 20
#: Rows of a bucket (one a chunk, some hundred bytes each where there are many) above which it is cut into parts of about as many.
ROWS = 1 << 18
SMOOTH, SMOOTH_UNKNOWN = 20.0, 200.0
#: Words seen so often are put into every class exactly; so many words are weighed at once.
EXACT, BLOCK = 1024, 4096
_log = logging.getLogger(__name__)


def class_count(n_tokens: int) -> int:
    """Classes by default: the fourth root of the training tokens, from 8 to MOST_CLASSES."""
    return int(max(8, min(MOST_CLASSES, n_tokens**0.25)))


def _tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts in a row, each text with END_WORD after it, and the texts' n + 1 offsets."""
    h, _, _, woff = vec.words(raw, off)
    n = len(off) - 1
    toff = woff + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    ends = toff[1:] - 1
    words = np.ones(len(out), bool)
    words[ends] = False
    out[words] = h
    out[ends] = END_WORD
    return out, toff


CODED = "chunk long, bucket int, words binary, counts binary, doc_ids binary, held binary, offsets binary, tokens binary, width int"
CODED_NAMES = [x.split()[0] for x in CODED.split(", ")]
_TYPES = [pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.int32()]


def _code(buckets: int):
    """Rows by bucket: a chunk's distinct words and their counts in training texts; and one row with the chunk's texts as numbers of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for rows, raw, off in vec.slices(batches, CHUNK):
            word, toff = _tokens(raw, off)
            held = rows.column("held_out").to_numpy(zero_copy_only=False)
            distinct = np.unique(word)
            number = np.searchsorted(distinct, word).astype(np.uint32)
            counts = np.bincount(number[np.repeat(~held, np.diff(toff))], minlength=len(distinct)).astype(np.uint32)
            bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            out: list[list] = []
            for b in np.flatnonzero(np.diff(edges)):
                a, z = edges[b], edges[b + 1]
                out.append([chunk, int(b), distinct[a:z].tobytes(), counts[a:z].tobytes(), None, None, None, None, None])
            width = max(1, (int(len(distinct) - 1).bit_length() + 7) // 8)
            planes = np.ascontiguousarray(number.view(np.uint8).reshape(-1, 4)[:, :width].T)
            out.append([chunk, None, None, None, rows.column("doc_id").to_numpy().tobytes(), held.astype(np.uint8).tobytes(), toff.tobytes(), planes.tobytes(), width])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], CODED_NAMES)
            chunk += 1

    return run


def _of(table: pa.Table, column: str, row: int, kind) -> np.ndarray:
    return np.frombuffer(table.column(column)[row].as_buffer(), kind)


def _thin(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64).tobytes()


def _thick(table: pa.Table, column: str, row: int, n: int) -> np.ndarray:
    """The n numbers of _thin."""
    raw = table.column(column)[row].as_buffer()
    return np.frombuffer(raw, {0: np.uint8, 1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[raw.size // max(n, 1)])


PLACED = "chunk long, bucket int, part int, n_words int, places binary, words binary, n binary"


def _place(group: pa.Table) -> pa.Table:
    """A bucket's words with their training counts as one row without a chunk, and per chunk the places of its words among them."""
    parts = [_of(group, "words", i, np.uint64) for i in range(group.num_rows)]
    words = np.unique(np.concatenate(parts))
    n = np.zeros(len(words), np.int64)
    places = []
    for i, w in enumerate(parts):
        at = np.searchsorted(words, w).astype(np.uint32)
        n[at] += _of(group, "counts", i, np.uint32)
        places.append(_thin(at))
    none = [None] * len(places)
    bucket = group.column("bucket")[0].as_py()
    return pa.table([pa.array([*group.column("chunk").to_pylist(), None], pa.int64()), pa.array([bucket] * (len(places) + 1), pa.int32()), pa.array([0] * (len(places) + 1), pa.int32()), pa.array([*map(len, parts), None], pa.int32()), pa.array([*places, None], pa.binary()), pa.array([*none, words.tobytes()], pa.binary()), pa.array([*none, n.tobytes()], pa.binary())], names=["chunk", "bucket", "part", "n_words", "places", "words", "n"])


MERGED = "bucket int, words binary, n binary"


def _merge_words(counts: str, kind):
    """The words of the group's rows and the sums of their counts as one row."""

    def run(group: pa.Table) -> pa.Table:
        parts = [_of(group, "words", i, np.uint64) for i in range(group.num_rows)]
        words = np.unique(np.concatenate(parts))
        n = np.zeros(len(words), np.int64)
        for i, w in enumerate(parts):
            n[np.searchsorted(words, w)] += _of(group, counts, i, kind)
        return pa.table([group.column("bucket").slice(0, 1), pa.array([words.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["bucket", "words", "n"])

    return run


def _find(asked: pa.Table, known: pa.Table) -> pa.Table:
    """As _place, for a part of a bucket whose words are known: the places of each chunk's words."""
    words = _of(known, "words", 0, np.uint64)
    parts = [_of(asked, "words", i, np.uint64) for i in range(asked.num_rows)]
    none = pa.array([None] * len(parts), pa.binary())
    places = pa.array([_thin(np.searchsorted(words, w).astype(np.uint32)) for w in parts], pa.binary())
    return pa.table([asked.column("chunk"), asked.column("bucket"), asked.column("part"), pa.array(map(len, parts), pa.int32()), places, none, none], names=["chunk", "bucket", "part", "n_words", "places", "words", "n"])


class Parts:
    """Into how many parts the buckets are cut that have more than ROWS rows; `rows` has a row per chunk and bucket."""

    def __init__(self, rows: DataFrame):
        sizes = rows.groupBy("bucket").count().where(F.col("count") > ROWS)
        hot = shared.written(sizes.select("bucket", F.ceil(F.col("count") / ROWS).cast("int").alias("parts")), "parts")
        self.count = hot.count()
        self.hot = F.broadcast(hot) if self.count <= shared.BROADCAST_ROWS else hot

    def of_rows(self, rows: DataFrame) -> DataFrame:
        """The rows of cut buckets, with their part."""
        return rows.join(self.hot, "bucket").withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("int")).drop("parts")

    def copies(self, vocabulary: DataFrame) -> DataFrame:
        """A row per bucket and part."""
        if not self.count:
            return vocabulary.withColumn("part", F.lit(0))
        parted = vocabulary.join(self.hot, "bucket", "left")
        return parted.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def placed(self, rows: DataFrame) -> DataFrame:
        """PLACED of chunk, bucket, words, counts."""
        if not self.count:
            return rows.groupBy("bucket").applyInArrow(_place, PLACED)
        whole = rows.join(self.hot, "bucket", "left_anti").groupBy("bucket").applyInArrow(_place, PLACED)
        cut = self.of_rows(rows)
        summed = cut.groupBy("bucket", "part").applyInArrow(_merge_words("counts", np.uint32), MERGED)
        words = shared.written(summed.groupBy("bucket").applyInArrow(_merge_words("n", np.int64), MERGED), "words_of_parts")
        found = cut.groupBy("bucket", "part").cogroup(self.copies(words).groupBy("bucket", "part")).applyInArrow(_find, PLACED)
        return whole.unionByName(found).unionByName(words, allowMissingColumns=True)


def _most(k: int):
    """The k most frequent words of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, n in zip(b.column("words"), b.column("n")):
                words, n = np.frombuffer(words.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)
                top = np.argsort(-n, kind="stable")[:k]
                yield pa.RecordBatch.from_arrays([pa.array(words[top]), pa.array(n[top]), pa.array([int(n.sum())] * len(top)), pa.array([int((n > 0).sum())] * len(top)), pa.array(np.arange(len(top)) == 0)], ["word", "n", "total", "types", "first"])

    return run


def _begin(own: dict[int, int], n_classes: int):
    """The classes at first: those words have their own, the others share one, the end of text is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for words in b.column("words"):
                words = np.frombuffer(words.as_buffer(), np.int64)
                kinds = np.full(len(words), n_classes - 2, np.uint8)
                for i in np.flatnonzero(np.isin(words, np.fromiter(own, np.int64, len(own)))):
                    kinds[i] = own[int(words[i])]
                kinds[words.view(np.uint64) == END_WORD] = n_classes - 1
                out.append(kinds.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("words"), b.column("n"), pa.array(out, pa.binary())], ["bucket", "words", "n", "kinds"])

    return run


VOCABULARY = "bucket int, words binary, n binary, kinds binary"


def _answer(with_counts: bool):
    """For each chunk's words of a bucket their classes (UNKNOWN without a training count, marked if seen once) and, if asked, counts."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        n, kinds = _of(known, "n", 0, np.int64), _of(known, "kinds", 0, np.uint8).copy()
        kinds[n == 0] = UNKNOWN
        kinds[n == 1] |= ONCE
        places = [_thick(asked, "places", i, k) for i, k in enumerate(asked.column("n_words").to_pylist())]
        counts = pa.array([_thin(n[p]) if with_counts else None for p in places], pa.binary())
        return pa.table([asked.column("chunk"), asked.column("bucket"), asked.column("part"), asked.column("places"), counts, pa.array([kinds[p].tobytes() for p in places], pa.binary())], names=["chunk", "bucket", "part", "places", "n", "kinds"])

    return run


ANSWERED = "chunk long, bucket int, part int, places binary, n binary, kinds binary"


def _number(coded: pa.Table, row: int) -> np.ndarray:
    planes = _of(coded, "tokens", row, np.uint8).reshape(coded.column("width")[row].as_py(), -1)
    number = np.zeros(planes.shape[1], np.int64)
    for i, p in enumerate(planes):
        number |= p.astype(np.int64) << (8 * i)
    return number


def _runs(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys (number * 256 + code): how many codes each of n numbers has, the codes, and their counts."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(keys)))
    keys = keys[starts]
    return np.bincount(keys >> 8, minlength=n).astype(np.uint16), (keys & 255).astype(np.uint8), counts.astype(np.uint32)


def _contexts(n_classes: int):
    """Per bucket the places of a chunk's words with the counts of the classes before (code) and after them (128 + code) in training texts."""

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("bucket").to_numpy())
        parts = [_of(answers, "kinds", int(i), np.uint8) for i in order]
        kinds = np.concatenate(parts) & UNKNOWN
        number, toff = _number(coded, 0), _of(coded, "offsets", 0, np.int64)
        kind = kinds[number].astype(np.int64)
        train = np.repeat(_of(coded, "held", 0, np.uint8) == 0, np.diff(toff))
        left = np.empty(len(kind), np.int64)
        left[0], left[1:] = n_classes - 1, kind[:-1]  # a text begins after an end, as each ends with one
        last = np.zeros(len(kind), bool)
        last[toff[1:] - 1] = True
        inner = np.flatnonzero(train & ~last)
        keys = np.concatenate([(number * 256 + left)[train], number[inner] * 256 + 128 + kind[inner + 1]])
        runs, codes, counts = _runs(keys.astype(np.uint32) if len(kinds) < 1 << 24 else keys, len(kinds))
        word = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        entry = np.concatenate([[0], np.cumsum(runs, dtype=np.int64)])[word]
        cut = lambda x, e: pa.array([_thin(x[a:b]) for a, b in zip(e[:-1], e[1:])], pa.binary())
        return pa.table([answers.column("bucket").take(pa.array(order)), answers.column("part").take(pa.array(order)), pa.array([len(p) for p in parts], pa.int32()), answers.column("places").take(pa.array(order)), cut(runs, word), cut(codes, entry), cut(counts, entry)], names=["bucket", "part", "n_words", "places", "runs", "codes", "counts"])

    return run


COUNTED = "bucket int, part int, n_words int, places binary, runs binary, codes binary, counts binary"
SUMMED = "bucket int, runs binary, codes binary, counts binary"


def _sum_contexts(group: pa.Table) -> pa.Table:
    """One row: the counts of the words of a bucket, or of a part of one, by code."""
    at, codes, counts, size = [], [], [], 1
    for i, n in enumerate(group.column("n_words").to_pylist()):
        places = _thick(group, "places", i, n)
        size = max(size, 1 + int(places.max(initial=0)))
        at.append(np.repeat(places.astype(np.int64), _thick(group, "runs", i, n)))
        codes.append(_of(group, "codes", i, np.uint8))
        counts.append(_thick(group, "counts", i, len(codes[-1])))
    return _totals(group, np.concatenate(at), np.concatenate(codes), np.concatenate(counts), size)


def _sum_parts(group: pa.Table) -> pa.Table:
    """One row of the rows of a bucket's parts."""
    runs, codes, counts = ([_of(group, c, i, t) for i in range(group.num_rows)] for c, t in (("runs", np.uint16), ("codes", np.uint8), ("counts", np.int64)))
    at = [np.repeat(np.arange(len(r)), r) for r in runs]
    return _totals(group, np.concatenate(at), np.concatenate(codes), np.concatenate(counts), max(map(len, runs)))


def _totals(group: pa.Table, at: np.ndarray, codes: np.ndarray, counts: np.ndarray, size: int) -> pa.Table:
    out: list[list[np.ndarray]] = [[], [], []]
    for a in range(0, size, BLOCK):
        z = min(size, a + BLOCK)
        own = (at >= a) & (at < z) if size > BLOCK else slice(None)
        total = np.bincount((at[own] - a) * 256 + codes[own], weights=counts[own], minlength=(z - a) * 256).astype(np.int64)
        on = np.flatnonzero(total)
        for x, y in zip(out, (np.bincount(on >> 8, minlength=z - a).astype(np.uint16), (on & 255).astype(np.uint8), total[on])):
            x.append(y)
    return pa.table([group.column("bucket").slice(0, 1), *(pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in out)], names=["bucket", "runs", "codes", "counts"])


def _sparse(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """Counts, kinds, and runs, codes and counts of the row's words (words after the last with a training text have no run)."""
    n, kinds, runs, codes, counts = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("n", np.int64), ("kinds", np.uint8), ("runs", np.uint16), ("codes", np.uint8), ("counts", np.int64)))
    return n, kinds, np.concatenate([runs, np.zeros(len(n) - len(runs), np.uint16)]).astype(np.int64), codes, counts


def _class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (class before, class) of the task's words."""
    total = np.zeros(KINDS * KINDS, np.int64)
    for b in batches:
        for i in range(b.num_rows):
            _, kinds, runs, codes, counts = _sparse(b, i)
            own = np.repeat(kinds, runs).astype(np.int64)
            left = codes < 128
            total += np.bincount(codes[left].astype(np.int64) * KINDS + own[left], weights=counts[left], minlength=KINDS * KINDS).astype(np.int64)
    on = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on])], ["pair", "n"])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for what doesn't depend on the classes."""
    return float(_f(pairs).sum() - _f(pairs.sum(0)).sum() - _f(pairs.sum(1)).sum())


def best_classes(pairs: np.ndarray, n: np.ndarray, kinds: np.ndarray, runs: np.ndarray, codes: np.ndarray, counts: np.ndarray, n_classes: int, turn: int) -> np.ndarray:
    """The words' classes after their turn; only words of training texts at every second place move, the end of text never."""
    free = n_classes - 1
    pairs = pairs[:n_classes, :n_classes].astype(np.float64)
    before, after = pairs.sum(1), pairs.sum(0)  # of classes as the first and as the second of a pair
    one = lambda x: _f(x + 1) - _f(x)
    # What one more count is worth: rows are codes (left, right), columns the class that the word would be in.
    worth = np.zeros((256, free), np.float32)
    worth[:n_classes], worth[128 : 128 + n_classes] = one(pairs)[:, :free], one(pairs)[:free].T
    cost = (one(before) + one(after))[:free].astype(np.float32)
    table = np.zeros((256, n_classes))
    table[:n_classes], table[128 : 128 + n_classes] = pairs, pairs.T
    edges = np.concatenate([[0], np.cumsum(runs)])
    out = kinds.copy()
    for a in range(0, len(n), BLOCK):
        z = min(len(n), a + BLOCK)
        own = slice(edges[a], edges[z])
        row, code, x = np.repeat(np.arange(z - a), runs[a:z]), codes[own].astype(np.int64), counts[own].astype(np.float64)
        dense = np.zeros((z - a, 256), np.float32)
        dense[row, code] = x
        as_second = np.bincount(row, weights=np.where(code < 128, x, 0), minlength=z - a)
        as_first = np.bincount(row, weights=np.where(code >= 128, x, 0), minlength=z - a)
        gain = (dense @ worth).astype(np.float64) - n[a:z, None] * cost
        for w in np.flatnonzero(n[a:z] >= EXACT):
            e = slice(edges[a + w] - edges[a], edges[a + w + 1] - edges[a])
            base = table[code[e], :free]
            gain[w] = (_f(base + x[e, None]) - _f(base)).sum(0) - (_f(after[:free] + as_second[w]) - _f(after[:free])) - (_f(before[:free] + as_first[w]) - _f(before[:free]))
        # The word's own class, with its counts taken off.
        home = kinds[a:z].astype(np.int64)
        with_it = table[code, home[row]]
        stay = np.bincount(row, weights=_f(with_it) - _f(np.maximum(with_it - x, 0)), minlength=z - a)
        stay -= _f(after[home]) - _f(np.maximum(after[home] - as_second, 0)) + _f(before[home]) - _f(np.maximum(before[home] - as_first, 0))
        fixed = home >= free
        gain[np.arange(z - a)[~fixed], home[~fixed]] = stay[~fixed]
        moves = ~fixed & (n[a:z] > 0) & ((np.arange(a, z) + turn) % 2 == 0)
        out[a:z][moves] = gain.argmax(1)[moves]
    return out


def _move(pairs: np.ndarray, n_classes: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [best_classes(pairs, *_sparse(b, i), n_classes, turn).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("words"), b.column("n"), pa.array(out, pa.binary())], ["bucket", "words", "n", "kinds"])

    return run


def exchange(texts: DataFrame, places: DataFrame, parts: Parts, vocabulary: DataFrame, n_classes: int, sweeps: int) -> tuple[DataFrame, list[float]]:
    """The vocabulary (VOCABULARY, written) with its classes after the exchange, and the likelihood at first and after each sweep that was kept."""
    likelihoods: list[float] = []
    kept, counted = vocabulary, None
    for turn in range(sweeps + 1):
        answers = places.groupBy("bucket", "part").cogroup(parts.copies(vocabulary).groupBy("bucket", "part")).applyInArrow(_answer(False), ANSWERED)
        partial = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_contexts(n_classes), COUNTED)
        sums = partial.groupBy("bucket", "part").applyInArrow(_sum_contexts, SUMMED)
        if parts.count:
            sums = sums.groupBy("bucket").applyInArrow(_sum_parts, SUMMED)
        now = shared.written(vocabulary.join(sums, "bucket"), "counted")
        pairs = np.zeros(KINDS * KINDS, np.int64)
        for r in now.mapInArrow(_class_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n")).toLocalIterator():  # KINDS squared rows at most
            pairs[r[0]] = r[1]
        pairs = pairs.reshape(KINDS, KINDS)
        value = likelihood(pairs)
        _log.info("exchange: likelihood %.1f after %d sweeps", value, turn)
        if likelihoods and value < likelihoods[-1]:
            shared.spent(now, vocabulary)
            break
        if vocabulary is not kept:
            shared.spent(kept)
        likelihoods.append(value)
        kept = vocabulary
        if counted is not None:
            shared.spent(counted)
        counted = now
        if turn < sweeps:
            vocabulary = shared.written(now.mapInArrow(_move(pairs, n_classes, turn), VOCABULARY), "vocabulary")
    if counted is not None:
        shared.spent(counted)
    return kept, likelihoods


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, kinds binary"


def _documents(total: int, types: int, of_class: np.ndarray):
    """Per document its base score, the emissions' log10, and its classes in order."""

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("bucket").to_numpy())  # in the order of the hashes
        k_parts = answers.column("kinds").to_pylist()
        kinds = np.frombuffer(b"".join(k_parts[i] for i in order), np.uint8)
        n = np.concatenate([_thick(answers, "n", int(i), len(k_parts[i])) for i in order]).astype(np.int64)
        base = np.log10((n + 0.5) / (total + 0.5 * (types + 1)))
        emission = np.where(n > 0, np.log10(np.maximum(n, 1) / np.maximum(of_class[kinds & UNKNOWN], 1)), 0.0)
        ids, held, toff, number = _of(coded, "doc_ids", 0, np.int64), _of(coded, "held", 0, np.uint8), _of(coded, "offsets", 0, np.int64), _number(coded, 0)
        sums = [np.add.reduceat(x[number], toff[:-1]) for x in (n > 0, base, emission)]
        text = kinds[number]
        out = (ids, held.astype(bool), np.diff(toff), *sums, [text[a:b].tobytes() for a, b in zip(toff, toff[1:])])
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def _pairs(end: int):
    """Counts of (kind before, kind) in training texts; kinds have the mark ONCE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256 * 256, np.int64)
        for b in batches:
            for held, text in zip(b.column("held_out").to_pylist(), b.column("kinds")):
                if not held:
                    x = np.frombuffer(text.as_buffer(), np.uint8).astype(np.int64)
                    total += np.bincount(np.concatenate([[end], x[:-1]]) * 256 + x, minlength=256 * 256) if len(x) > 4096 else 0
                    if len(x) <= 4096:
                        np.add.at(total, np.concatenate([[end], x[:-1]]) * 256 + x, 1)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on])], ["pair", "n"])

    return run


def transition_table(pairs: np.ndarray, of_class: np.ndarray, n_classes: int) -> np.ndarray:
    """log10 of the probability of a kind after a kind (KINDS by KINDS, UNKNOWN among them), from counts with ONCE (twice KINDS on a side)."""
    merged = pairs[:, :KINDS] + pairs[:, KINDS:]
    once = pairs[:, KINDS:].sum(1)
    before = (merged[:KINDS] + merged[KINDS:]).astype(np.float64)
    before[UNKNOWN] = merged[KINDS:].sum(0)  # after an unknown word as after one seen once
    after_once = (once[:KINDS] + once[KINDS:]).astype(np.float64)
    after_once[UNKNOWN] = once[KINDS:].sum()
    seen = before.sum(1)
    share = np.zeros(KINDS)
    share[:n_classes] = (of_class[:n_classes] + 0.5) / (of_class[:n_classes].sum() + 0.5 * n_classes)
    overall = (after_once[:n_classes].sum() + 0.5) / (seen[:n_classes].sum() + 1)
    unknown = (after_once + SMOOTH_UNKNOWN * overall) / (seen + SMOOTH_UNKNOWN)
    table = (before + SMOOTH * share) / (seen + SMOOTH)[:, None] * (1 - unknown)[:, None]
    table[:, UNKNOWN] = unknown
    return np.log10(np.maximum(table, 1e-300))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _final(table: np.ndarray, total: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = []
            for e, text in zip(b.column("emission").to_pylist(), b.column("kinds")):
                x = np.frombuffer(text.as_buffer(), np.uint8) & UNKNOWN
                score.append(e + float(table[np.concatenate([[end], x[:-1]]), x].sum()))
            n = b.column("n_tokens").to_numpy()
            rows = [b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            perplexity = 10.0 ** np.minimum(-np.array(score) / n, 300)
            yield pa.RecordBatch.from_arrays([*rows, pa.array([total] * b.num_rows, pa.int64()), b.column("base_score"), pa.array(score, pa.float64()), pa.array(perplexity)], [x.split()[0] for x in RESULT.split(", ")])

    return run


class Model:
    """What is learned from the documents that aren't held out, and the coded texts of all."""

    def __init__(self, docs: DataFrame, n_classes: int | None = None, sweeps: int = SWEEPS):
        whole = shared.texts(docs).withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1)
        buckets = shared.buckets_for(shared.text_bytes(whole), BUCKET, 32)
        coded = shared.written(whole.select("doc_id", "held_out", "text").mapInArrow(_code(buckets), CODED), "coded")
        self.texts = coded.where("bucket is null").select("chunk", "doc_ids", "held", "offsets", "tokens", "width")
        words = coded.where("bucket is not null").select("chunk", "bucket", "words", "counts")
        self.parts = Parts(words)
        placed = shared.written(self.parts.placed(words), "placed")
        self.places = placed.where("chunk is not null").select("chunk", "bucket", "part", "n_words", "places")
        words = placed.where("chunk is null").select("bucket", "words", "n")
        most = shared.written(words.mapInArrow(_most(MOST_CLASSES), "word long, n long, total long, types long, first boolean"), "most")
        self.total, self.types = (int(x or 0) for x in most.where("first").agg(F.sum("total"), F.sum("types")).first())
        self.n_classes = n_classes or class_count(self.total)
        end = int(np.array([END_WORD]).view(np.int64)[0])
        top = [r["word"] for r in most.where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(self.n_classes - 2).collect()]  # MOST_CLASSES rows at most
        begin = shared.written(words.mapInArrow(_begin({w: i for i, w in enumerate(top)}, self.n_classes), VOCABULARY), "vocabulary")
        self.vocabulary, self.likelihoods = exchange(self.texts, self.places, self.parts, begin, self.n_classes, sweeps if self.total else 0)

    def of_class(self) -> np.ndarray:
        """Training tokens by class."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n, kinds in zip(b.column("n"), b.column("kinds")):
                    total = np.bincount(np.frombuffer(kinds.as_buffer(), np.uint8), weights=np.frombuffer(n.as_buffer(), np.int64), minlength=KINDS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(KINDS, dtype=np.int32)), pa.array(total.astype(np.int64))], ["class", "n"])

        out = np.zeros(KINDS, np.int64)
        for r in self.vocabulary.select("n", "kinds").mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n")).collect():  # KINDS rows
            out[r[0]] = r[1]
        return out

    def word_classes(self) -> DataFrame:
        """word (hash as in vec.words, or END_WORD), n, class of every word of a training text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for words, n, kinds in zip(b.column("words"), b.column("n"), b.column("kinds")):
                    words, n, kinds = (np.frombuffer(x.as_buffer(), t) for x, t in ((words, np.int64), (n, np.int64), (kinds, np.uint8)))
                    on = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(words[on]), pa.array(n[on]), pa.array(kinds[on].astype(np.int32))], ["word", "n", "class"])

        return self.vocabulary.select("words", "n", "kinds").mapInArrow(run, "word long, n long, class int")

    def scores(self) -> DataFrame:
        of_class, end = self.of_class(), self.n_classes - 1
        answers = self.places.groupBy("bucket", "part").cogroup(self.parts.copies(self.vocabulary).groupBy("bucket", "part")).applyInArrow(_answer(True), ANSWERED).drop("places")
        scored = shared.written(self.texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_documents(self.total, self.types, of_class), SCORED), "scored")
        pairs = np.zeros(256 * 256, np.int64)
        for r in scored.select("held_out", "kinds").mapInArrow(_pairs(end), "pair int, n long").groupBy("pair").agg(F.sum("n")).toLocalIterator():
            pairs[r[0]] = r[1]
        return scored.mapInArrow(_final(transition_table(pairs.reshape(256, 256), of_class, self.n_classes), self.total, end), RESULT)


def scores(docs: DataFrame, n_classes: int | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D) after lower-casing A-Z; an end follows each text and
    counts as a token. The model learns from the documents that aren't held out (crc32 of the doc_id's text mod 5 is not 1)
    and scores all. base_score is that of the smoothed unigram model; perplexity is 10 ** (-score / n_tokens). n_classes
    (3 to MOST_CLASSES) is class_count of the training tokens if not given. A null or empty text is the end alone. Repeated
    rows count each and get a row each; rows without a doc_id are left out; an empty table gives an empty result; without
    a training text every word is unknown and train_tokens is 0.
    """
    return Model(docs, n_classes, sweeps).scores()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(shared.table(spark, sf_dir, "documents"))
