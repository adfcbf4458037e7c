"""Benchmark decontamination by latent semantic retrieval.

Documents are read as windows of words over the benchmark's vocabulary. A randomised SVD of TF-IDF windows gives a
latent space; windows whose cosine there with a passage of a benchmark item is high are candidates, and so are the
surroundings that hold enough of an item's rarer words to be a leak, which leaves none out. Each candidate is checked by
the longest common subsequence of words with the item, and by the item's closing words (its answer) where the rest is
only a paraphrase. Inverse document frequencies count all documents; the space is fitted on the items and on every
window of every document, and all are searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import materialize, small, text_batches, tidied

U64 = np.uint64

#: Words in half a window; windows of two halves start at each half.
HALF = 24
RANK, OVERSAMPLE, POWER_STEPS = 128, 16, 2
#: The latent space is fitted on the windows of all documents and on the items' passages, which weigh ITEM_SHARE times as
#: much as all windows, so that the space tells items apart.
ITEM_SHARE = 4.0
#: Words of less inverse document frequency are stop words; the rest weigh it to this power.
STOP_IDF, IDF_POWER = 1.0, 1.5
#: Items that one pass searches for; more take more passes. It bounds the vocabulary that is broadcast.
ITEMS_A_PASS = 20_000
SLICE_CHARS = 4_000_000
#: Least cosine of a candidate; least share of an item's words, in order, in a leak and in a paraphrase; least share of its answer.
MIN_COSINE, LEAK, PARAPHRASE, ANSWER, ANSWER_WORDS = 0.25, 0.75, 0.5, 0.85, 8


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): lower-case runs of letters and digits of each text; nulls have none."""
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}\x00-\x7f]+", " ")
    _, ends, raw = low.buffers()
    spaced = pa.py_buffer(_SPACED[np.frombuffer(raw, np.uint8)] if raw else b"")
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(low.type, len(low), [None, ends, spaced], offset=low.offset))
    flat, ends = lists.flatten(), np.asarray(lists.offsets)
    filled = pc.greater(pc.binary_length(flat), 0)
    return np.concatenate([[0], np.cumsum(np.asarray(filled))])[ends - ends[0]], flat.filter(filled)


#: ASCII letters and digits, and all bytes of other characters, as they are; other ASCII bytes are spaces.
_SPACED = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


@dataclass
class Items:
    """Benchmark items as word codes."""

    ids: list[int]
    codes: list[np.ndarray]
    vocabulary: pa.Array


def read_items(ids: list[int], texts: list[str]) -> Items:
    ends, words = word_lists(pa.array(texts, pa.string()))
    coded = words.dictionary_encode()
    index = np.asarray(coded.indices).astype(np.int32)
    kept = [(i, index[a:b]) for i, a, b in zip(ids, ends[:-1], ends[1:], strict=True) if b > a]
    return Items([i for i, _ in kept], [c for _, c in kept], coded.dictionary)


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    sizes, start = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), 0
    while start < batch.num_rows:
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most)))
        yield batch.slice(start, stop - start)
        start = stop


def encode_documents(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, codes): each text's words as 32-bit positions in the vocabulary, -1 for words outside it."""
    width = np.dtype("<i2") if len(vocabulary) < 2**15 else np.dtype("<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, 1, SLICE_CHARS):
                ends, words = word_lists(piece.column(1))
                codes = np.asarray(pc.fill_null(pc.index_in(words, value_set=vocabulary), -1)).astype(width)
                yield pa.record_batch([piece.column(0), pa.array([codes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["doc_id", "codes"])

    return docs.mapInArrow(tidied(run), "doc_id long, codes binary")


def _codes(column: pa.Array, n_words: int) -> list[np.ndarray]:
    width = "<i2" if n_words < 2**15 else "<i4"
    return [np.frombuffer(c, width) for c in column.to_pylist()]


def document_frequencies(encoded: DataFrame, n_words: int) -> tuple[np.ndarray, int]:
    """(documents that hold each word, documents): partial counts a task, summed by Spark; n_words numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_words + 1, np.int64)
        for batch in batches:
            for c in _codes(batch.column(0), n_words):
                counts[np.unique(c[c >= 0])] += 1
            counts[-1] += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["word", "n"])

    got = encoded.select("codes").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_words + 1, np.int64)
    counts[np.asarray(got["word"])] = np.asarray(got["n"])
    return counts[:-1], int(counts[-1])


def word_weights(counts: np.ndarray, n_docs: int) -> np.ndarray:
    idf = np.log((n_docs + 1) / (1 + counts))
    if not (idf >= STOP_IDF).any():  # a handful of documents tells nothing about words
        return np.ones(len(counts), np.float32)
    return np.where(idf < STOP_IDF, 0, np.maximum(idf, 0) ** IDF_POWER).astype(np.float32)


@dataclass
class Stretch:
    """Documents, or long pieces of them, as halves of windows: the words in order, and for each half its document, its number
    there, the begin and end of its piece, whether the next half goes on with it, and whether a window starts at it."""

    word: np.ndarray
    half: np.ndarray
    doc: np.ndarray
    number: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    paired: np.ndarray
    window: np.ndarray


def stretches(docs: list[np.ndarray], overlap: int = 1, most: int = 100_000) -> Iterator[Stretch]:
    """All documents, about `most` words at a time. A longer one is cut into pieces that share `overlap` halves, so that with
    one every window is in one piece, and with more every surroundings of so many halves is in some piece."""
    step, held, size = max(1, most // HALF), [], 0
    for d, c in enumerate(docs):
        for s in range(0, max(1, -(-len(c) // HALF) - overlap), step):
            piece = c[s * HALF : (s + step + overlap) * HALF]
            if held and size + len(piece) > most:
                yield _stretch(held)
                held, size = [], 0
            if len(piece):
                held.append((d, s, piece))
                size += len(piece)
    if held:
        yield _stretch(held)


def _stretch(pieces: list[tuple[int, int, np.ndarray]]) -> Stretch:
    lengths = np.array([len(c) for _, _, c in pieces])
    n = -(-lengths // HALF)
    base = np.concatenate([[0], np.cumsum(n)])
    of, at = np.repeat(np.arange(len(n)), lengths), np.repeat(np.arange(len(n)), n)
    half = base[of] + (np.arange(lengths.sum()) - (np.cumsum(lengths) - lengths)[of]) // HALF
    paired = np.append(at[1:] == at[:-1], False)
    doc, first = (np.array([p[k] for p in pieces]) for k in (0, 1))
    return Stretch(np.concatenate([c for _, _, c in pieces]), half, doc[at], first[at] + np.arange(base[-1]) - base[at], base[at], base[at + 1], paired, paired | (n == 1)[at])


class Projected:
    """TF-IDF windows of a stretch times a basis, by small dense blocks of halves over the words that occur in them."""

    def __init__(self, s: Stretch, idf: np.ndarray, basis: np.ndarray, block: int = 32):
        at = np.flatnonzero(s.word >= 0)
        at = at[idf[s.word[at]] > 0]
        word, half, n = s.word[at], s.half[at], len(s.doc)
        self.blocks, self.stretch = [], s
        y, square, cross = np.zeros((n + 1, basis.shape[1]), np.float32), np.zeros(n + 1), np.zeros(n)
        cuts, place, seen = np.searchsorted(half, np.arange(n + 2)), np.zeros(len(idf), np.int64), np.zeros(len(idf), bool)
        for a in range(0, n, block):
            b = min(n, a + block)
            k, more = slice(cuts[a], cuts[min(n, b + 1)]), min(n, b + 1) - a  # and the half after, which the last window has too
            if k.start == k.stop:
                continue
            seen[word[k]] = True
            words = np.flatnonzero(seen)
            seen[words], place[words] = False, np.arange(len(words))
            column = place[word[k]]
            x = np.bincount((half[k] - a) * len(words) + column, minlength=more * len(words)).reshape(more, len(words)).astype(np.float32) * idf[words]
            y[a:b] = x[: b - a] @ basis[words]
            square[a:b] = np.einsum("ij,ij->i", x[: b - a], x[: b - a])
            cross[a : a + more - 1] = np.einsum("ij,ij->i", x[:-1], x[1:])
            self.blocks.append((a, b, words, x[: b - a]))
        self.norm2 = np.where(s.window, square[:-1] + np.where(s.paired, square[1:] + 2 * cross, 0), 0)
        self.y = y[:-1] + np.where(s.paired[:, None], y[1:], 0)

    def add_back(self, total: np.ndarray) -> int:
        """Adds windows of unit length, transposed, times their products to total; how many windows these are."""
        own = self.norm2 > 1e-12
        z = self.y * np.where(own, 1 / np.where(own, self.norm2, 1), 0).astype(np.float32)[:, None]
        later = np.flatnonzero(self.stretch.paired)
        back = z.copy()
        back[later + 1] += z[later]
        for a, b, words, x in self.blocks:
            total[words] += x.T @ back[a:b]
        return int(own.sum())


def _sum_by_word(parts: DataFrame, v: int, width: int) -> np.ndarray:
    """Partial rows (word, part) of all tasks added up by Spark, a share of the words a task; v x width numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word in sums:
                    sums[word] += np.frombuffer(part, np.float32)
                else:
                    sums[word] = np.frombuffer(part, np.float32).astype(np.float64)
        words = sorted(sums)
        yield pa.record_batch([pa.array(words, pa.int32()), pa.array([sums[w].astype(np.float32).tobytes() for w in words], pa.binary())], ["word", "part"])

    total = np.zeros((v, width), np.float32)
    for word, part in parts.repartition("word").mapInArrow(run, "word int, part binary").toLocalIterator():
        total[word] = np.frombuffer(part, np.float32)
    return total


def latent_basis(encoded: DataFrame, items: Items, idf: np.ndarray, seed: int = 0) -> np.ndarray:
    """Words x rank: right singular vectors of the TF-IDF windows of all documents and of the items' passages.

    Randomised subspace iteration: in each step tasks multiply their windows by the current basis and back, Spark adds their
    rows up by word, and the driver adds the items' part and orthonormalises.
    """
    v, width = len(idf), min(len(idf), RANK + OVERSAMPLE)
    cut, _ = passages(items.codes)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((v, width)))[0].astype(np.float32)
    for _ in range(POWER_STEPS + 1):
        shared = encoded.sparkSession.sparkContext.broadcast((basis, idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            basis, idf = shared.value
            total, n_windows = np.zeros((v, width), np.float32), 0
            for batch in batches:
                for s in stretches(_codes(batch.column(0), v)):
                    n_windows += Projected(s, idf, basis).add_back(total)
            words = np.flatnonzero(total.any(axis=1))
            for k in range(0, len(words), 1_000):
                some = words[k : k + 1_000]
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([total[w].tobytes() for w in some], pa.binary())], ["word", "part"])
            count = np.zeros(width, np.float32)
            count[0] = n_windows
            yield pa.record_batch([pa.array([v], pa.int32()), pa.array([count.tobytes()], pa.binary())], ["word", "part"])

        total = _sum_by_word(encoded.select("codes").mapInArrow(tidied(run), "word int, part binary"), v + 1, width)
        n_windows, total = float(total[v, 0]), total[:v]
        part, n_own = np.zeros_like(total), 0
        for s in stretches(cut):  # a passage is one window at most
            n_own += Projected(s, idf, basis).add_back(part)
        total += max(1.0, ITEM_SHARE * n_windows / max(1, n_own)) * part
        basis = np.linalg.svd(total, full_matrices=False)[0].astype(np.float32)
        shared.unpersist()
    return basis[:, :RANK]


def passages(codes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(passages, position of each one's item): items longer than a window are cut like documents, at each half."""
    cut = [(c[p * HALF : (p + 2) * HALF], i) for i, c in enumerate(codes) for p in range(max(1, -(-len(c) // HALF) - 1))]
    return [c for c, _ in cut], np.array([i for _, i in cut], np.int64)


def unit_vectors(codes: list[np.ndarray], word_vectors: np.ndarray) -> np.ndarray:
    """Latent vectors of length 1 of windows or passages; one without a weighing word keeps a zero vector."""
    out = np.stack([word_vectors[c[c >= 0]].sum(axis=0) for c in codes])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0).astype(np.float32)


def _near_in_space(s: Stretch, idf, basis, latent, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(half that a window starts at, passage) of the pairs with a cosine of MIN_COSINE, both sides of length 1 in the space."""
    vectors = Projected(s, idf, basis).y
    norm = np.linalg.norm(vectors, axis=1)
    windows = np.flatnonzero(s.window & (norm > 1e-6))
    vectors = vectors[windows] / norm[windows][:, None]
    step = max(1, most // len(latent))
    for k in range(0, len(windows), step):
        r, i = np.nonzero(vectors[k : k + step] @ latent.T >= MIN_COSINE)
        yield windows[k + r], i


@dataclass
class Postings:
    """Items by their rarer words. An item of n words is a leak only where `need` of its word places are met in order, so of
    its n - need + least rarest places `least` are met at least, whichever the others are."""

    first: int
    starts: np.ndarray
    item: np.ndarray
    places: np.ndarray
    least: np.ndarray
    before: np.ndarray


def item_postings(codes: list[np.ndarray], counts: np.ndarray, block: int = 1_000) -> list[Postings]:
    out = []
    for first in range(0, len(codes), block):
        words, owners, places, least, before = [], [], [], [], []
        for i, c in enumerate(codes[first : first + block]):
            need = needed(len(c))
            least.append(max(1, need // 4))
            before.append(-(-len(c) // HALF))  # halves that the surroundings of a window reach to either side of it
            w, n = np.unique(c[np.argsort(counts[c], kind="stable")][: len(c) - need + least[-1]], return_counts=True)
            words.append(w)
            places.append(n)
            owners.append(np.full(len(w), i))
        word, order = np.concatenate(words), np.argsort(np.concatenate(words), kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(counts)))])
        out.append(Postings(first, starts, np.concatenate(owners)[order], np.concatenate(places)[order], np.array(least), np.array(before)))
    return out


def _near_by_words(s: Stretch, postings: Postings) -> tuple[np.ndarray, np.ndarray]:
    """(half that a window starts at, item): the window's surroundings hold enough of the item's rarer words. No leak is missed."""
    at, n_halves = np.flatnonzero(s.word >= 0), len(s.doc)
    n = postings.starts[s.word[at] + 1] - postings.starts[s.word[at]]
    at, n = at[n > 0], n[n > 0]
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    entry = np.repeat(postings.starts[s.word[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item = postings.item[entry].astype(np.int64)
    key = item * n_halves + np.repeat(s.half[at], n)
    order = np.argsort(key)
    key, held = key[order], np.concatenate([[0], np.cumsum(postings.places[entry][order])])
    fresh = np.flatnonzero(np.diff(key, prepend=-1))
    item, first = key[fresh] // n_halves, key[fresh] % n_halves

    def reached(begin: np.ndarray, item: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Places met from half `begin` on in surroundings that begin there, within the piece that half `piece` is in."""
        low, high = np.maximum(begin, s.begin[piece]), np.minimum(begin + 2 * postings.before[item] + 2, s.end[piece])
        return held[np.searchsorted(key, item * n_halves + high)] - held[np.searchsorted(key, item * n_halves + low)]

    enough = np.flatnonzero(reached(first, item, first) >= postings.least[item])
    # What surroundings hold from their first entry on they hold from any half since the entry before.
    since = np.concatenate([[-1], first[:-1]])
    since = np.where((np.diff(item, prepend=-1) == 0) & (since >= s.begin[first]), since, -(2**40))
    item, first, since = item[enough], first[enough], since[enough]
    low = np.maximum(np.maximum(since + 1, first - 2 * postings.before[item] - 1), s.begin[first] - postings.before[item])
    n = first - low + 1
    begin = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, piece = np.repeat(item, n), np.repeat(first, n)
    window = begin + postings.before[item]
    good = (window < s.end[piece]) & s.window[np.minimum(window, n_halves - 1)]
    begin, item, piece, window = begin[good], item[good], piece[good], window[good]
    good = reached(begin, item, piece) >= postings.least[item]
    return window[good], item[good] + postings.first


def needed(n: int) -> int:
    """Words in order that a leak of an item of n words has at least."""
    return math.ceil(PARAPHRASE * n)


def lcs(item: dict[int, int], full: int, text: np.ndarray) -> int:
    """Longest common subsequence by bits: item maps a word to the bits of its places, full has a bit a place."""
    free = full
    for word in text.tolist():
        if hit := item.get(word):
            met = free & hit
            free = ((free + met) | (free - met)) & full
    return (full & ~free).bit_count()


def _places(codes: np.ndarray) -> tuple[dict[int, int], int]:
    bits: dict[int, int] = {}
    for i, c in enumerate(codes.tolist()):
        bits[c] = bits.get(c, 0) | (1 << i)
    return bits, (1 << len(codes)) - 1


class Padded:
    """Documents one after the other with room between them, so that the words around a window are read without its ends."""

    def __init__(self, docs: list[np.ndarray], room: int):
        lengths = np.array([len(c) + room for c in docs], np.int64)
        self.docs, self.starts = docs, np.cumsum(lengths) - lengths + room
        self.flat = np.full(int(lengths.sum()) + 2 * room + 2 * HALF, -1, docs[0].dtype if docs else np.int32)
        for start, c in zip(self.starts.tolist(), docs, strict=True):
            self.flat[start : start + len(c)] = c


#: Words of an item whose places fit one machine word; longer items are compared one window at a time.
LANE = 64


def window_lcs(text: Padded, item: np.ndarray, doc: np.ndarray, window: np.ndarray, n_words: int, most: int = 2048) -> np.ndarray:
    """lcs() of an item with the surroundings of many windows at once, a step for each place of a word in these."""
    n, out, whole = len(item), np.zeros(len(doc), np.int64), _places(item)
    if n > LANE:
        return np.array([lcs(*whole, _surroundings(text.docs[d], w, n)) for d, w in zip(doc.tolist(), window.tolist(), strict=True)], np.int64)
    lane = np.uint32 if n <= 32 else np.uint64
    bits, full = np.zeros(n_words + 1, lane), lane(whole[1])  # the last is for words that no item has
    for word, places in whole[0].items():
        bits[word] = places
    around = np.lib.stride_tricks.sliding_window_view(text.flat, 2 * HALF + 2 * n)
    for k in range(0, len(doc), most):
        rows = around[text.starts[doc[k : k + most]] + window[k : k + most] * HALF - n]
        free, less = np.full(len(rows), full), np.empty(len(rows), lane)
        for met in np.take(bits, np.ascontiguousarray(rows.T), mode="wrap"):  # carries above the item's places change none of these
            np.bitwise_and(met, free, met)
            np.subtract(free, met, less)
            np.add(free, met, free)
            np.bitwise_or(free, less, free)
        out[k : k + most] = np.bitwise_count(~free & full)
    return out


def _surroundings(codes: np.ndarray, window: int, n: int) -> np.ndarray:
    """A window of a document and as many words as an item of n has to either side."""
    return codes[max(0, window * HALF - n) : (window + 2) * HALF + n]


class _Checker:
    """What is reported of windows that hold an item."""

    def __init__(self, codes: list[np.ndarray], word_vectors: np.ndarray, latent: np.ndarray, first_passage: np.ndarray):
        self.codes, self.word_vectors, self.latent, self.first_passage = codes, word_vectors, latent, first_passage

    def leak(self, codes: np.ndarray, w: int, i: int, got: int) -> tuple[int, float, float, int] | None:
        """(LCS, cosine, share of the answer, first word) if the surroundings of window w, of LCS `got`, hold item i."""
        item = self.codes[i]
        n, tail = len(item), item[-ANSWER_WORDS:]
        answer = lcs(*_places(tail), _surroundings(codes, w, n)) / len(tail)
        if got < LEAK * n and answer < ANSWER:
            return None
        vector = unit_vectors([codes[w * HALF : (w + 2) * HALF]], self.word_vectors)[0]
        cosine = float((self.latent[self.first_passage[i] : self.first_passage[i + 1]] @ vector).max())
        return got, cosine, answer, w * HALF


_SCHEMA = "doc_id long, item_id long, cosine double, lcs_words long, item_words long, answer_share double, word_start long"


def _gathered(batches: Iterator[pa.RecordBatch], v: int, most: int = 3_000_000) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Ids and codes of batches put together up to about `most` words, as the comparison with an item pays for many at once."""
    ids, docs, size = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        docs += _codes(batch.column(1), v)
        size += sum(map(len, docs[len(docs) - batch.num_rows :]))
        if size >= most:
            yield ids, docs
            ids, docs, size = [], [], 0
    if ids:
        yield ids, docs


def _search(spark, items: Items, idf: np.ndarray, counts: np.ndarray, basis: np.ndarray):
    """Both ways to the candidates, by the space and by rarer words, and the check of each."""
    v, word_vectors = len(idf), (basis * idf[:, None]).astype(np.float32)
    cut, owner_of = passages(items.codes)
    first_passage = np.searchsorted(owner_of, np.arange(len(items.codes) + 1))
    shared = spark.sparkContext.broadcast(
        (items.ids, items.codes, idf, basis, unit_vectors(cut, word_vectors), owner_of, first_passage, item_postings(items.codes, counts))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, item_codes, idf, basis, latent, owner_of, first_passage, postings = shared.value
        checker = _Checker(item_codes, (basis * idf[:, None]).astype(np.float32), latent, first_passage)
        furthest, n_items = max(int(2 * p.before.max() + 2) for p in postings), len(item_ids)
        for ids, docs in _gathered(batches, v):
            rows: dict[tuple[int, int], tuple] = {}
            widest = max(map(len, docs), default=0) // HALF + 2
            found = [np.empty(0, np.int64)]  # item, document and window in one number
            for s in stretches(docs):
                found += [(owner_of[passage] * len(docs) + s.doc[half]) * widest + s.number[half] for half, passage in _near_in_space(s, idf, basis, latent)]
            for s in stretches(docs, furthest):
                found += [(item * len(docs) + s.doc[half]) * widest + s.number[half] for half, item in (_near_by_words(s, p) for p in postings)]
            found = np.sort(np.concatenate(found))
            found = found[np.diff(found, prepend=-1) > 0]
            item, doc, window = found // (widest * len(docs)), found // widest % len(docs), found % widest
            cuts, text = np.searchsorted(item, np.arange(n_items + 1)), Padded(docs, LANE + 2 * HALF)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                k = slice(cuts[i], cuts[i + 1])
                got = window_lcs(text, item_codes[i], doc[k], window[k], v)
                for j in np.flatnonzero(got >= needed(len(item_codes[i]))).tolist():
                    d = int(doc[k][j])
                    if (leak := checker.leak(docs[d], int(window[k][j]), i, int(got[j]))) and ((d, i) not in rows or leak[:2] > rows[d, i][:2]):
                        rows[d, i] = leak
            if rows:
                keys = sorted(rows)
                yield pa.record_batch([
                    pa.array([ids[d] for d, _ in keys], pa.int64()), pa.array([item_ids[i] for _, i in keys], pa.int64()), pa.array([rows[x][1] for x in keys]),
                    pa.array([rows[x][0] for x in keys], pa.int64()), pa.array([len(item_codes[i]) for _, i in keys], pa.int64()),
                    pa.array([rows[x][2] for x in keys]), pa.array([rows[x][3] for x in keys], pa.int64()),
                ], ["doc_id", "item_id", "cosine", "lcs_words", "item_words", "answer_share", "word_start"])

    return run


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_words, item_words, answer_share, word_start): the leaks found, one row a document row and item.

    A leak holds LEAK of an item's words in order, near each other; or PARAPHRASE of them and ANSWER of its last ANSWER_WORDS
    words. word_start is the first word of the best window. Null or empty texts, and items without words, match nothing; null
    ids stay null; rows of equal id are searched each; an item id that repeats counts once for each text. The benchmark is read
    to the driver ITEMS_A_PASS items at a time; documents are read once for each such pass, whatever their length.
    """
    spark = docs.sparkSession
    text_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    passes, found = max(1, math.ceil(items.count() / ITEMS_A_PASS)), None
    for p in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()
        some = read_items([r[0] for r in rows], [r[1] for r in rows])
        if not some.ids:
            continue
        encoded = materialize(encode_documents(own, some.vocabulary), "codes")
        counts, n_docs = document_frequencies(encoded, len(some.vocabulary))
        idf = word_weights(counts, n_docs)
        basis = latent_basis(encoded, some, idf)
        one = encoded.mapInArrow(tidied(_search(spark, some, idf, counts, basis)), _SCHEMA)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], _SCHEMA) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that benchmark_leaks() names; all columns. Documents without an id stay."""
    out = materialize(benchmark_leaks(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "leaks")
    return docs.join(small(out), "doc_id", "left_anti").select(docs.columns)
