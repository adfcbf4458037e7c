"""Exact n-gram Jaccard join by a universe partition and the pigeonhole principle.

Sets of word shingles (64-bit hashes) are grouped in size bands. Within a band's scheme the hash universe is cut into
segments, more of them than two linked sets can differ in, so two linked sets agree on the whole of some segment. A
document's signatures are the hashes of its segments' contents. Empty segments say nothing and are left out; a band has
spare segments for them, and the rare document with too few filled ones adds the one-deletion neighbourhoods of its
segments. Of its filled segments a document signs only as many as decide, the fullest first, since those agree least by
chance. Documents that share a signature become candidates, never as all pairs: each points at the least one, and those of
one anchor, their least signature, count as one. Large candidate groups are cut anew by other partitions of the universe.
The candidate groups are then verified exactly, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import connected_components, discard, give_back, materialize, small, text_batches, tidied

U64 = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)
#: Characters of text worked on at a time, and signatures that a task holds before it passes them on.
SLICE_CHARS, HELD_SIGNATURES = 2_000_000, 1_000_000
#: Documents in a verification block, and in a block of count vectors.
BLOCK, COUNT_BLOCK = 256, 4096
#: Bits of signatures and anchors that groups don't tell apart: equal rests only make more candidates.
BLUNT = U64(16)
#: Signature groups for each shuffle partition: more and smaller groups hold less in a task at once.
TARGETS_A_PARTITION = 4


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no pattern."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; nulls are empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends, flat = np.asarray(lists.offsets), lists.flatten()
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    ends = np.concatenate([[0], np.cumsum(filled)])[ends - ends[0]]
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), U64, len(coded.dictionary))
    word = known[np.asarray(coded.indices)] if len(coded) else np.empty(0, U64)
    out = []
    full = np.zeros(max(0, len(word) - k + 1), U64)
    for i in range(k):
        full += word[i : len(word) - k + 1 + i] * _ODD[i % 8] * U64(2 * (i // 8) + 1)
    full = mix(full)
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        if end - start >= k:
            h = np.sort(full[start : end - k + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif end > start:
            out.append(mix(np.array([sum(int(word[start + i]) * int(_ODD[i % 8]) for i in range(end - start)) + (int(end - start) << 57) & (2**64 - 1)], U64)))
        else:
            out.append(np.empty(0, U64))
    return out


class Bands:
    """Sizes by band, and each band's scheme: differences to survive and segments, for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]

    def _grow(self, size: int) -> None:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)

    def band(self, size: int) -> int:
        """Two sets that can link are in one band or in neighbours."""
        self._grow(size)
        low, high = 0, len(self.starts) - 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.starts[mid] <= size else (low, mid)
        return low

    @lru_cache(maxsize=None)  # noqa: B019  a scheme a band, and few bands
    def scheme(self, band: int) -> tuple[int, int]:
        """(H, m): pairs of a set in this band and one in it or the next differ in H elements at most; m segments.

        m is by cost: segments of an ordinary document, plus the chance that one has fewer than H + 1 filled segments times
        the size of the one-deletion neighbourhoods that it then needs; then half as many again as H at least, so that the
        H + 1 fullest hold few segments of one element.
        """
        self._grow(self.starts[-1])
        while len(self.starts) <= band + 1:
            self._grow(self.starts[-1])
        least, most = self.starts[band], self.starts[band + 1] - 1
        differ = (most + most * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        if differ == 0:
            return 0, 1

        def cost(m: int) -> float:
            empty = (1 - 1 / m) ** least
            mean, spread = m * (1 - empty), math.sqrt(max(1e-9, m * empty * (1 - empty)))
            short = 0.5 * math.erfc((mean - differ - 0.5) / spread / math.sqrt(2))
            return m + short * (least + m)

        return differ, max(min(range(differ + 1, 3 * differ + 8), key=cost), differ + differ // 2 + 1)

    def partner_band(self, size: int) -> int | None:
        """The band before the set's own, if that holds sets it can link with."""
        band = self.band(size)
        return band - 1 if band and size * self.num <= (self.starts[band] - 1) * self.den else None


def signatures(sets: list[np.ndarray], bands: Bands, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set), for the own band's scheme and the partner band's; each seed cuts the universe otherwise.

    With more than H filled segments a set signs the H + 1 fullest, ties by signature. Of two linked sets, take the first
    signature in that order that both have: before it either has only segments in which they differ, H at most, so both sign it.
    """
    jobs = [(i, b, *bands.scheme(b)) for i, s in enumerate(sets) if len(s) for b in {bands.band(len(s)), bands.partner_band(len(s))} if b is not None]
    jobs = [j for j in jobs if j[2]]  # without differences only equal sets link, and those are found by digest
    if not jobs:
        return np.empty(0, U64), np.empty(0, np.int64)
    which, band, differ, m = (np.array(c, np.int64) for c in zip(*jobs, strict=True))
    sizes = np.array([len(sets[i]) for i in which])
    elements = np.concatenate([sets[i] for i in which])
    base = np.concatenate([[0], np.cumsum(m)])
    dealt = mix(elements + U64(seed) * _ODD[0]) if seed else elements
    seg = (dealt % np.repeat(m, sizes).astype(U64)).astype(np.int64) + np.repeat(base[:-1], sizes)
    value = mix(elements + U64(0x632BE59BD9B4E019))
    total = np.zeros(base[-1], U64)
    np.add.at(total, seg, value)
    filled = np.bincount(seg, minlength=base[-1])
    job = np.repeat(np.arange(len(jobs)), m)
    place = mix((band[job].astype(U64) << U64(40)) + (np.arange(base[-1]) - base[job]).astype(U64))
    some = filled > 0
    sig = mix(total ^ place)
    order = np.lexsort((sig, -filled, job))
    first = np.empty(len(order), bool)
    first[order] = np.arange(len(order)) - base[job] <= differ[job]
    sigs, owners = [sig[some & first]], [which[job[some & first]]]
    short = np.flatnonzero(np.add.reduceat(some, base[:-1]) <= differ)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for j in short:
        here = slice(base[j], base[j + 1])
        mine = ends[j : j + 2]
        s, v = seg[mine[0] : mine[1]], value[mine[0] : mine[1]]
        large = filled[s] >= 2
        less = mix((total[s] - v)[large] ^ place[s[large]])
        need = int(differ[j]) + 1 - int(some[here].sum())
        blank = place[here][~some[here]] if need > int((filled[here] >= 2).sum()) else np.empty(0, U64)
        sigs += [less, mix(blank)]
        owners += [np.full(len(less) + len(blank), which[j])]
    return np.concatenate(sigs), np.concatenate(owners)


def count_vector(s: np.ndarray) -> bytes:
    """Elements in each 256th of the hash universe, 255 at most: the vectors of two sets differ by no more than the sets do."""
    return np.minimum(np.bincount((s >> U64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def pack(sig: np.ndarray, owner: np.ndarray) -> bytes:
    """Owners and sorted signatures as differences, byte plane by byte plane, then the planes of each one's owner: zero planes compress away."""
    order = np.argsort(sig, kind="stable")
    step = np.diff(sig[order], prepend=U64(0)).astype("<u8")
    ids, at = np.unique(owner[order], return_inverse=True)
    head = np.array([len(sig), len(ids)], "<u8").tobytes()
    id_step = np.diff(ids.astype("<i8").view(U64), prepend=U64(0)).astype("<u8")
    return head + id_step.view(np.uint8).reshape(-1, 8).T.tobytes() + step.view(np.uint8).reshape(-1, 8).T.tobytes() + at.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, n_ids = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    ids = np.cumsum(np.frombuffer(blob, np.uint8, 8 * n_ids, 16).reshape(8, n_ids).T.copy().view("<u8").ravel(), dtype=U64).view(np.int64)
    at = 16 + 8 * n_ids
    step = np.frombuffer(blob, np.uint8, 8 * n, at).reshape(8, n).T.copy().view("<u8").ravel()
    index = np.frombuffer(blob, np.uint8, 4 * n, at + 8 * n).reshape(4, n).T.copy().view("<u4").ravel()
    return np.cumsum(step, dtype=U64), ids[index]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component), one a node but the least: they connect what the edges (a, b) do."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (label[x], label[y], x, y):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def meet(sig: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, least owner of each, a, b): the pairs (a, b) connect all owners that share a signature, as a forest."""
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, bool)
    least = owner[new]
    of = least[np.cumsum(new) - 1] if len(sig) else owner
    differ = owner != of
    if not differ.any():
        return sig[new], least, owner[:0], owner[:0]
    pairs = np.unique(np.column_stack([owner[differ], of[differ]]), axis=0)
    return sig[new], least, *forest(pairs[:, 0], pairs[:, 1])


_FIELDS = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "blob": pa.binary()}
_SCHEMA = "kind int, a long, b long, n long, d1 long, d2 long, blob binary"
DOC, EDGE, ANCHOR, BLOB = 0, 1, 2, 3


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.record_batch([pa.array(cols[f], t) if f in cols else pa.nulls(n, t) for f, t in _FIELDS.items()], list(_FIELDS))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes, start = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), 0
    while start < batch.num_rows:
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE_CHARS)))
        yield batch.slice(start, stop - start)
        start = stop


def _sketch(k: int, num: int, den: int, targets: int, seed: int = 0):
    """Rows of four kinds: a document's size and digest; candidate pairs met in this task; the anchors of documents; signatures,
    with the anchors of their owners, for each target. Of a batch with a third column, the component, only documents of equal
    components share signatures, and there are no rows of the first kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held, n_held, seen = Bands(num, den), [], 0, set()

        def passed_on() -> Iterator[pa.RecordBatch]:
            sig, owner, a, b = meet(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            if len(a):
                yield _rows(kind=np.full(len(a), EDGE), a=a, b=b)
                # These edges lead to the least document of each group, which now stands for all of it: what groups of other
                # tasks share with this one meets there, once, and not at each of its documents.
                at = np.minimum(np.searchsorted(a, owner), len(a) - 1)
                owner = np.where(a[at] == owner, b[at], owner)
            # Documents of one anchor are one node to the targets, so that what shares many signatures isn't handed on by each.
            ids, of = np.unique(owner, return_inverse=True)
            sig = sig >> BLUNT
            anchor = np.full(len(ids), ~U64(0))
            np.minimum.at(anchor, of, sig)
            yield _rows(kind=np.full(len(ids), ANCHOR), a=ids, b=anchor.astype(np.int64))
            to = mix(sig) % U64(targets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(targets + 1, dtype=U64))
            full = np.flatnonzero(np.diff(cuts))
            parts = [order[cuts[t] : cuts[t + 1]] for t in full]
            node = anchor.astype(np.int64)[of]
            yield _rows(kind=np.full(len(full), BLOB), a=full, n=[len(part) for part in parts], blob=[pack(sig[part], node[part]) for part in parts])

        for batch in batches:
            for piece in _slices(batch, 1):
                sets, ids = shingle_sets(piece.column(1), k), piece.column(0).to_pylist()
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                if piece.num_columns < 3:
                    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    place = [2 * bands.band(len(s)) + (bands.partner_band(len(s)) is not None) if len(s) else 0 for s in sets]
                    counts = [count_vector(s) for s in sets]
                    yield _rows(kind=np.full(len(ids), DOC), a=ids, b=place, n=[len(s) for s in sets], d1=both[:, 0], d2=both[:, 1], blob=counts)
                first = [i for i, d in enumerate(digests) if ids[i] is not None and len(sets[i]) and not (d in seen or seen.add(d))]
                sig, which = signatures([sets[i] for i in first], bands, seed)
                if len(sig):
                    if piece.num_columns > 2:
                        sig = mix(sig ^ mix(np.asarray(piece.column(2))[first].astype(U64))[which])
                    held.append((sig, np.array([ids[i] for i in first], np.int64)[which]))
                    n_held += len(sig)
                if n_held >= HELD_SIGNATURES:
                    yield from passed_on()
                    held.clear()
                    seen.clear()
                    n_held = 0
        if held:
            yield from passed_on()

    return run


def _met(table: pa.Table) -> pa.Table:
    parts = [unpack(b) for b in table["blob"].to_pylist()]
    _, _, a, b = meet(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _plausible(num: int, den: int):
    """Of documents with count vectors, a forest of the pairs that these don't rule out."""

    def run(table: pa.Table) -> pa.Table:
        ids, n = table["doc_id"].to_pylist(), np.asarray(table["n"])
        x = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)
        near = np.zeros((len(ids), len(ids)), bool)
        for i in range(len(ids)):
            most = (n + n[i]) * (den - num) // (den + num)
            some = np.flatnonzero(np.abs(n - n[i]) <= most)
            near[i, some] = np.abs(x[some] - x[i]).sum(axis=1, dtype=np.int32) <= most[some]
        links = spanning_links(ids, near)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def linked_pairs(sets: list[np.ndarray], num: int, den: int, elements: int = 300_000, column_step: int = 8192) -> np.ndarray:
    """Matrix of which sets link: den * intersection >= num * union. Exact counts, from one range of hashes after another, so
    that memory hangs on the number of sets and not on their sizes."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    parts = max(1, -(-int(sizes.sum()) // elements))
    edges = np.array([(k << 64) // parts for k in range(1, parts)], U64)
    cuts = [np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]) for s in sets]
    both = np.zeros((n, n))
    for k in range(parts):
        flat = np.concatenate([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)])
        owner = np.repeat(np.arange(n, dtype=np.int32), [c[k + 1] - c[k] for c in cuts])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        same = flat[1:] == flat[:-1]
        shared = np.append(same, False) | np.insert(same, 0, False) if len(flat) else np.empty(0, bool)
        flat, owner = flat[shared], owner[shared]
        column = np.cumsum(np.diff(flat, prepend=~flat[:1]) != 0) - 1
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, column_step):
            a, b = np.searchsorted(column, [at, at + column_step])
            x = np.zeros((n, min(column_step, int(column[-1]) + 1 - at)), np.float32)
            x[owner[a:b], column[a:b] - at] = 1
            both += x @ x.T
    return den * both >= num * (sizes[:, None] + sizes[None, :] - both)


def spanning_links(ids: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same groups as all of `linked` do, fewer than there are ids; equal ids are one node."""
    out, left = [], np.ones(len(ids), bool)
    for root in range(len(ids)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            here = queue.pop()
            near = np.flatnonzero(linked[here] & left)
            left[near] = False
            out += [(ids[here], ids[j]) for j in near if ids[j] != ids[here]]
            queue += near.tolist()
    return out


def _verify(k: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_pylist()
        sets = [x for b in table.select(["text"]).to_batches() for piece in _slices(b, 0) for x in shingle_sets(piece.column(0), k)]
        links = spanning_links(ids, linked_pairs(sets, num, den)) if len(ids) > 1 else []
        del sets
        give_back()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _candidates(sketch: DataFrame, targets: int) -> DataFrame:
    """(node, component) of the documents that share signatures, from a stored sketch."""
    blobs = sketch.where(F.col("kind") == BLOB)
    # As few groups as a task can hold: a pair is handed on once a group at most.
    parts = min(targets, max(1, -(-(blobs.agg(F.sum("n")).first()[0] or 0) // HELD_SIGNATURES)))
    met = blobs.select(F.pmod("a", F.lit(parts)).alias("target"), "blob").groupBy("target").applyInArrow(_met, "a long, b long")
    met = materialize(met, "met")
    anchors = sketch.where(F.col("kind") == ANCHOR).select("a", F.col("b").alias("anchor"))
    heads = materialize(anchors.groupBy("anchor").agg(F.min("a").alias("head")), "heads")
    same = anchors.join(heads, "anchor").where("a <> head").select("a", F.col("head").alias("b"))
    a, b = (heads.select(F.col("anchor").alias(c), F.col("head").alias(f"{c}_head")) for c in "ab")
    apart = met.join(a, "a").join(b, "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    groups = connected_components(sketch.where(F.col("kind") == EDGE).select("a", "b").unionByName(same).unionByName(apart))
    discard(met)
    discard(heads)
    return groups


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs: sets link at Jaccard num / den or more.

    A document's set is its distinct k-word shingles, words being runs of anything but ASCII white space, A to Z lower-cased;
    with fewer than k words the whole sequence; a null text or one without words has the empty set and links with nothing.
    component_id is the smallest id reachable. Rows that repeat an id are one node that has the links of all of them. A null
    id links with nothing and has a null component. Other columns aren't read. Shingles count as equal where their 64-bit
    hashes are. Equal texts of one task sign once, so copies of a third of the table cost no more than a few.
    """
    spark = docs.sparkSession
    text_batches(spark)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    targets = TARGETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = materialize(own.mapInArrow(tidied(_sketch(k, num, den, targets)), _SCHEMA), "sketch")
    docs_of = sketch.where(F.col("kind") == DOC)
    rows = materialize(docs_of.select(F.col("a").alias("doc_id"), "n", "d1", "d2"), "rows")

    # Equal sets: a star around the least id, from partial minima; ids of classes of one stay out.
    salts = 32
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).alias("salt")
    nodes = rows.where("n > 0 and doc_id is not null")
    classes = nodes.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    classes = materialize(classes.select("d1", "d2", "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")), "classes")
    equal = nodes.select(F.col("doc_id").alias("a"), "d1", "d2", "n", salt("doc_id")).join(classes, ["d1", "d2", "n", "salt"]).where("a <> b").select("a", "b")

    groups = _candidates(sketch, targets)

    # Large groups are mostly chains of unlike documents that share a small segment. Linked sets share a signature under any
    # partition, so a group is cut anew by others, while that helps: each time only texts of large groups are read.
    tally = materialize(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "tally")
    in_all, seed = None, 0
    while True:
        large = tally.where(F.col("size") > BLOCK).select("component")
        before, in_all = in_all, tally.where(F.col("size") > BLOCK).agg(F.sum("size")).first()[0] or 0
        if not in_all or before is not None and 4 * in_all > 3 * before:
            break
        seed += 1
        chained = materialize(groups.join(small(large), "component").select(F.col("node").alias("doc_id"), "component"), "chained")
        again = own.join(small(chained), "doc_id").select("doc_id", "text", "component")
        anew = materialize(again.mapInArrow(tidied(_sketch(k, num, den, targets, seed)), _SCHEMA), "anew")
        cut = _candidates(anew, targets)
        discard(anew)
        groups = materialize(groups.join(small(large), "component", "left_anti").select("node", "component").unionByName(cut), "groups")
        discard(chained)
        tally = materialize(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "tally")

    # Count vectors, compared within a band and its neighbour, tell apart what is left of them without their texts; what they
    # can't tell apart stays one group.
    if in_all:
        vectors = docs_of.where("n > 0").select(F.col("a").alias("node"), "n", F.shiftright("b", 1).alias("band"), (F.col("b") % 2).alias("partner"), F.col("blob").alias("counts"))
        in_large = materialize(groups.join(small(large), "component"), "large")
        schemes = F.when(F.col("partner") == 1, F.array("band", F.col("band") - 1)).otherwise(F.array("band"))
        rows_of = materialize(vectors.join(small(in_large), "node").select("component", F.col("node").alias("doc_id"), "n", "counts", F.explode(schemes).alias("scheme")), "vectors")
        parts = materialize(rows_of.groupBy("component", "scheme").agg(F.ceil(F.count(F.lit(1)) / COUNT_BLOCK).cast("int").alias("blocks")), "parts")
        cut = rows_of.join(small(parts), ["component", "scheme"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or block <> other")
        pairs = cut.select("component", "scheme", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc_id", "n", "counts")
        refined = connected_components(pairs.groupBy("component", "scheme", "low", "high").applyInArrow(_plausible(num, den), "a long, b long"))
        groups = materialize(groups.join(small(large), "component", "left_anti").select("node", "component").unionByName(refined), "groups")
        tally = materialize(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "tally")
        for table in (in_large, rows_of, parts):
            discard(table)
    discard(sketch)

    sizes = small(tally.select("component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    placed = materialize(groups.join(sizes, "component").select("component", F.col("node").alias("doc_id"), "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")), "placed")
    # The least document of a group visits each of its blocks, which often joins them at once.
    visits = F.when(F.col("doc_id") == F.col("component"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    members = materialize(placed.select("component", "doc_id", F.explode(visits).alias("block")), "members")
    check = _verify(k, num, den)
    first = own.join(small(members), "doc_id").groupBy("component", "block").applyInArrow(check, "a long, b long")
    links = materialize(equal.unionByName(first), "links")
    labels = connected_components(links)

    wide = placed.where("blocks > 1")
    if not wide.isEmpty():
        parted = wide.join(small(labels.select(F.col("node").alias("doc_id"), F.col("component").alias("part"))), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
        parts = materialize(parted.groupBy("component").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("component"), "parted")
        rest = materialize(wide.join(small(parts), "component", "left_semi"), "rest")
        if not rest.isEmpty():  # groups of several blocks that the visits did not join: every pair of blocks meets
            other = rest.select("component", "doc_id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("block <> other")
            pairs = materialize(other.select("component", "doc_id", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")), "pairs")
            more = own.join(small(pairs), "doc_id").groupBy("component", "low", "high").applyInArrow(check, "a long, b long")
            labels = connected_components(links.unionByName(more))
    out = rows.join(small(labels.withColumnRenamed("node", "doc_id")), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without those whose group of near copies has a smaller id; all columns. Rows of one id, or of none, stay or go together."""
    out = materialize(jaccard_components(docs, k, num, den).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(small(out), "doc_id", "left_anti").select(docs.columns)
