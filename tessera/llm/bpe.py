"""Byte-level BPE over a corpus by replaying merges on its distinct words.

Words (pattern matches) are encoded once each. All words of a batch are laid out as one sequence of byte tokens; an
inverted index leads from a merge to the positions of its token pair, and merges are applied in rank order, each
touching only its own positions and their neighbours. Documents then read their words' ids from the table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import text_batches, tidied

#: Words whose ids a task keeps from batch to batch; a full table is emptied, which costs time but changes nothing.
KEPT_WORDS = 300_000


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class MergeReplay:
    """Encodes many words at once with the ranks of a byte-level vocabulary; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Rank of what two tokens make together, by both in one number: every way to part a token into two.
        self.pairs = {
            left << 32 | right: rank
            for token, rank in ranks.items() for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        }
        self.byte_pairs = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a, b] = ranks.get(bytes([a, b]), -1)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word. A word that is a token is that token, as the vocabulary's library has it."""
        whole = [self.ranks.get(w) for w in words]
        parted = [w for w, r in zip(words, whole, strict=True) if r is None]
        ends = np.cumsum([len(w) for w in parted], dtype=np.int64)
        ids = self._replay(np.frombuffer(b"".join(parted), np.uint8), ends) if len(ends) and ends[-1] else np.empty(0, np.int64)
        alive = np.flatnonzero(ids >= 0)
        made = iter(np.split(ids[alive].astype("<u4"), np.searchsorted(alive, ends)[:-1]) if len(ends) else [])
        return [next(made) if r is None else np.array([r], "<u4") for r in whole]

    def _replay(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ids by the place of each token's first byte, -1 elsewhere, of words one after the other; ends: where each stops."""
        n, pair = len(raw), self.pairs.get
        last = np.zeros(n, bool)
        last[ends[ends > 0] - 1] = True
        ids = self.single[raw].tolist()
        nexts = np.where(last, -1, np.arange(1, n + 1)).tolist()
        prevs = np.where(np.concatenate([[True], last[:-1]]), -1, np.arange(-1, n - 1)).tolist()
        first = np.append(np.where(last[:-1], -1, self.byte_pairs[raw[:-1], raw[1:]]), -1)
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        found, begin = np.unique(first[order], return_index=True)
        index = {r: at.tolist() for r, at in zip(found.tolist(), np.split(order, begin[1:]), strict=True)}  # an inverted index: places of each pair
        heap = list(index)  # sorted, so a heap
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()  # leftmost first within each word
            for at, here in enumerate(places):
                then = nexts[here]
                if then < 0 or ids[here] < 0 or pair(ids[here] << 32 | ids[then]) != rank:
                    continue  # a neighbour's merge took part of the pair
                after, before, early = nexts[then], prevs[here], False
                ids[here], ids[then], nexts[here] = rank, -1, after
                if after >= 0:
                    prevs[after] = here
                    if (r := pair(rank << 32 | ids[after])) is not None:
                        if r in index:
                            index[r].append(here)
                        else:
                            index[r] = [here]
                            heapq.heappush(heap, r)
                        early = r < rank
                if before >= 0 and (r := pair(ids[before] << 32 | rank)) is not None:
                    if r in index:
                        index[r].append(before)
                    else:
                        index[r] = [before]
                        heapq.heappush(heap, r)
                    early |= r < rank
                if early:  # that pair comes before the rest of this one
                    rest = places[at + 1 :]
                    if rest:
                        index.setdefault(rank, []).extend(rest)
                        heapq.heappush(heap, rank)
                    break
        return np.array(ids, np.int64)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: The vocabulary that this worker used last, by the digest of its file.
_loaded: dict[bytes, MergeReplay] = {}


def _replay(raw: bytes) -> MergeReplay:
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = MergeReplay(parse_ranks(raw))
    return _loaded[key]


def _texts(batches: Iterator[pa.RecordBatch], raw, pattern: str, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], MergeReplay]]:
    """Slices of about `most` characters (one text at least) with the ids of each text."""
    replay, split, known = _replay(raw.value), regex.compile(pattern), {}
    for batch in batches:
        texts, start = batch.column(1).to_pylist(), 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= most):
                size += len(texts[stop] or "")
                stop += 1
            words = [split.findall(t) if t else [] for t in texts[start:stop]]
            new = set().union(*words).difference(known)
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
                new = set().union(*words)
            new = sorted(new)
            known |= zip(new, (ids.tobytes() for ids in replay.encode([w.encode() for w in new])), strict=True)
            yield batch.slice(start, stop - start), [np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4") for ws in words], replay
            start = stop


def _load(docs: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the input


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<long>, n_tokens): each match of pattern encoded separately, without special tokens.

    ranks_path: a file of base64 tokens and ranks that the driver can read; it is broadcast. A null or empty text has no
    ids; a null id stays null; repeated rows are repeated; other columns aren't read. A text of one endless word takes
    n log n steps. No shuffle.
    """
    raw = _load(docs, ranks_path)

    def run(batches):
        for rows, ids, _ in _texts(batches, raw, pattern):
            flat, ends = np.concatenate([*ids, np.empty(0, "<u4")]), np.cumsum([0, *map(len, ids)])
            listed = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat.astype("int64"))).cast(pa.list_(pa.int64()))
            yield pa.record_batch([rows.column(0), listed, pa.array(np.diff(ends), pa.int64())], ["doc_id", "ids", "n_tokens"])

    return _own(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, ids array<long>, n_tokens long")


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, bytes binary) from (doc_id, ids); null ids give null, an unknown id fails the job."""
    raw = _load(encoded, ranks_path)

    def run(batches):
        replay = _replay(raw.value)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([None if i is None else replay.decode(i) for i in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded again in the same task."""
    raw = _load(docs, ranks_path)

    def run(batches):
        for rows, ids, replay in _texts(batches, raw, pattern):
            yield pa.record_batch([
                rows.column(0), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]), pa.array([hashlib.sha256(replay.decode(i.tolist())).hexdigest() for i in ids]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _own(docs, "doc_id", "text").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
