"""Sharding, neighbours, archives, Jaccard groups, leaks, toxicity and the pipeline against brute force."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, jaccard, knn, sharding, toxicity, warc
from tessera.llm._shared import connected_components

DATA = "/root/testdata/sf0.001"


# ---- sharding ----
def test_matrix_has_exact_margins_and_the_right_mean():
    cells, shards = [50, 0, 7, 120], [60, 59, 58]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = np.array(sharding.communication_matrix(cells, shards, seed))
        assert m.sum(1).tolist() == cells and m.sum(0).tolist() == shards
        total += m
    assert np.abs(total / 400 - np.outer(cells, shards) / 177).max() < 0.6


def test_hypergeometric_matches_its_distribution():
    rng = random.Random(1)
    seen = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20_000))
    want = {k: np.prod([1]) * __import__("math").comb(5, k) * __import__("math").comb(7, 4 - k) / __import__("math").comb(12, 4) for k in range(5)}
    assert all(abs(seen[k] / 20_000 - p) < 0.012 for k, p in want.items())
    assert 0 <= sharding.hypergeometric(rng, 10**10, 3 * 10**10, 10**6) - 240_000 <= 20_000


@pytest.mark.parametrize("n, bucket", [(0, 100), (5, 100), (1000, 100), (1000, 7)])
def test_shards_are_exact_gapless_and_repeatable(spark, n, bucket):
    df = spark.createDataFrame([(i % 3 if i else None, None if i == 2 else "t" * (i % 5), "old") for i in range(n)], "doc_id long, text string, shard string").repartition(5)
    out = sharding.hypergeometric_shuffle(df, 8, seed=4, bucket_rows=bucket)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "shard", "slot"] and len(rows) == n
    sizes = Counter(r.shard for r in rows)
    assert not n or max(sizes.values()) - min([sizes[s] for s in range(8)]) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())


# ---- neighbours ----
def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 12)).astype(np.float32)
    x[50:150] = x[50]  # a hot vector: ties by id
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(7, x[7].tolist(), 1), (500, None, 1), (501, [0.0] * 12, 1), (502, [float("nan")] * 12, 1), (503, [1.0, None] * 6, 1), (None, [1.0] * 12, 1), (520, [1.0, 2.0], 1)]
    got = {}
    for r in knn.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), k=20, block_rows=7, stripe_rows=60).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(np.float64)
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert [i for _, i, _ in sorted(found)] == want and np.allclose([v for *_, v in sorted(found)], s[want], atol=0, rtol=1e-12)


def test_fewer_candidates_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert [r.vec_id for r in knn.top_inner_products(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)).collect()] == [1]
    assert knn.top_inner_products(spark.createDataFrame([], schema)).collect() == []


# ---- archives ----
def test_archives_round_trip(spark, tmp_path):
    big, text = "é" * 800, "z" * 1000
    rows = [(1, "u1", text), (2, "u\r\n2", text), (3, None, text), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", big), (None, "u", text), (8, "u", ""), (3, None, text)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(warc.warc_round_trip(pages, f"file://{tmp_path}/w").collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(None, "revisit", 3), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None)]
    by = {r.page_id: r for r in got}
    assert by[7].payload_bytes == 1600 and by[7].payload_digest == hashlib.sha1(big.encode()).hexdigest() and by[2].payload_bytes == 1000
    files = sorted(os.listdir(tmp_path / "w"))
    members = [f for f in files if f.startswith("members") and f.endswith(".gz")]
    assert len(members) == len([f for f in files if f.startswith("whole")]) == len([f for f in files if f.endswith(".idx")])
    frame = spark.createDataFrame([(f"file://{tmp_path}/w/{f}", f"file://{tmp_path}/w/{f}.idx") for f in members], "path string, index_path string")
    payloads = {r.page_id: r.payload and bytes(r.payload).decode() for r in warc.read_members(frame).collect()}
    assert payloads[7] == big and payloads[1] is None and payloads[4] == "small"
    # normalising what is normal changes no byte
    (first, *_) = members
    warc.normalise(frame.where(f"path like '%{first}'")).collect()
    assert (tmp_path / "w" / first.replace(".warc.gz", ".members.warc.gz")).read_bytes() == (tmp_path / "w" / first).read_bytes()


# ---- Jaccard ----
def brute_components(rows, k, num, den):
    fold = {i: i + 32 for i in range(65, 91)}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)) for i, t in rows}
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set() for i, w in words.items()}
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {i: new if c == old else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


def near_copies(rng, n_groups=25):
    rows, i = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE two"), (1005, "one two x")], 0
    for _ in range(n_groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([1, 3, 8, 12, 13, 14, 30, 90, 400]))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_components_equal_all_pairs(spark, k, num, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)  # large groups and groups of several blocks, so that all paths run
    monkeypatch.setattr(jaccard, "COUNT_BLOCK", 4)
    rows = near_copies(random.Random(num))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k, num, 100).collect()}
    assert got == brute_components(rows, k, num, 100)


def test_linked_sets_share_a_signature():
    rng = random.Random(9)
    for num in (80, 90):
        bands = jaccard.Bands(num, 100)
        for _ in range(600):
            x = {rng.getrandbits(64) for _ in range(rng.choice([4, 9, 10, 11, 20, 40, 150]))}
            y = set(x) | {rng.getrandbits(64) for _ in range(rng.randint(0, 3))}
            for _ in range(rng.randint(0, len(x) // 6)):
                y.discard(rng.choice(sorted(y)))
            if x != y and y and 100 * len(x & y) >= num * len(x | y):
                sig, of = jaccard.signatures([np.array(sorted(s), np.uint64) for s in (x, y)], bands)
                assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_short_documents_sign_with_deletions():
    bands = jaccard.Bands(80, 100)
    bands.scheme = lambda band: (3, 4)
    sig, of = jaccard.signatures([np.array([4, 8, 12, 5], np.uint64), np.array([4, 8, 12, 16, 5], np.uint64)], bands)
    assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_a_set_signs_no_more_segments_than_decide():
    rng = np.random.default_rng(4)
    bands, sets = jaccard.Bands(80, 100), [np.sort(rng.integers(0, 2**64, 300, dtype=np.uint64))]
    schemes = {b for b in (bands.band(300), bands.partner_band(300)) if b is not None}
    for seed in (0, 1):
        sig, _ = jaccard.signatures(sets, bands, seed)
        assert len(sig) == sum(bands.scheme(b)[0] + 1 for b in schemes)
    other, _ = jaccard.signatures(sets, bands)
    assert not set(sig.tolist()) & set(other.tolist())  # a seed cuts the universe anew


def test_equal_anchors_meet_once_whatever_the_targets():
    text = " ".join(f"w{i}" for i in range(400))
    for targets in (4, 400):  # near copies of two tasks share most signatures; their anchor is the same, so no target hands them on
        batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([f"{text} {i}"])], ["doc_id", "text"]) for i in range(2)]
        rows = [r for b in batches for x in jaccard._sketch(3, 90, 100, targets)(iter([b])) for r in x.to_pylist()]
        anchors = [r["b"] for r in rows if r["kind"] == jaccard.ANCHOR]
        blobs = {}
        for r in rows:
            if r["kind"] == jaccard.BLOB:
                blobs.setdefault(r["a"], []).append(r["blob"])
        met = sum(jaccard._met(pa.table({"blob": b})).num_rows for b in blobs.values())
        assert len(set(anchors)) == 1 and met == 0


def test_packing_and_forests():
    rng = np.random.default_rng(0)
    sig, owner = rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(-5, 40, 500)
    s, o = jaccard.unpack(jaccard.pack(sig, owner))
    assert sorted(zip(s.tolist(), o.tolist())) == sorted(zip(sig.tolist(), owner.tolist()))
    a, b = jaccard.forest(np.array([5, 7, 9, 2]), np.array([3, 5, 8, 9]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(5, 3), (7, 3), (8, 2), (9, 2)]


def test_components_of_chains_and_repeated_ids(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (60, 61), (61, 60)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 60: 60, 61: 60}
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (2, text), (2, "other words are here"), (None, text), (None, None)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(df).collect())
    assert out == [(0, 0), (0, 0), (1, 1), (2, 1), (2, 1)]
    assert sorted(r.doc_id or 0 for r in jaccard.keep_one(df).collect()) == [0, 0, 1]
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- leaks ----
def test_bit_parallel_lcs():
    rng = random.Random(5)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if False else _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        return new

    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 40))] for _ in range(2))
        assert decontaminate.lcs(*decontaminate._places(np.array(a)), np.array(b)) == plain(a, b)


def test_leaks_and_paraphrases_are_found(spark):
    rng = random.Random(8)
    prose = lambda n: [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice(['', 'n', 's'])}" for _ in range(n)]
    items = [(i, prose(rng.randint(15, 60))) for i in range(20)]
    rows, want = [(900, None), (901, ""), (None, "no id")], set()
    for i in range(120):
        w = prose(rng.randint(5, 400))
        if i < 20:
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in items[i][1]]
            want.add((i, i))
        elif i < 30:
            part = [x if j % 4 else rng.choice(prose(1)) for j, x in enumerate(items[i - 20][1])]
            at = rng.randint(0, len(w))
            w[at:at] = part[: -decontaminate.ANSWER_WORDS] + items[i - 20][1][-decontaminate.ANSWER_WORDS :]
            want.add((i, i - 20))
        rows.append((i, ", ".join(w)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (78, "..."), (0, " ".join(items[0][1]))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(df, bench).collect()}
    assert {p for p in want if p[0] < 20} <= found <= want and len(found & want) >= 28
    kept = {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in found}
    assert decontaminate.benchmark_leaks(df.limit(0), bench).collect() == [] and decontaminate.benchmark_leaks(df, bench.limit(0)).collect() == []


def test_thousands_of_items_and_long_items_lose_no_leak(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(4000)]
    prose = lambda n: [vocabulary[min(int(rng.paretovariate(0.6)), 3999)] if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(n)]
    items = [prose(rng.randint(20, 60)) for _ in range(3000)] + [prose(n) for n in (1000, 1500)] + [[vocabulary[1]] * 6 + [vocabulary[2]] * 6]
    texts = []
    for i in range(60):
        w, k = prose(rng.randint(0, 300)), 2997 + i if i < 6 else rng.randrange(3000)
        leak = [x if j % 5 or i % 2 else rng.choice(vocabulary) for j, x in enumerate(items[k])]
        at = rng.randint(0, len(w))
        texts.append(w[:at] + leak + w[at:])
    want = set()
    for d, text in enumerate(texts):
        there = set(text)
        for i, item in enumerate(items):
            n = len(item)
            if sum(x in there for x in item) < n / 2:
                continue
            for start in range(0, max(1, -(-len(text) // decontaminate.HALF) - 1) * decontaminate.HALF, decontaminate.HALF):
                near = text[max(0, start - n) : start + 2 * decontaminate.HALF + n]
                got = decontaminate.lcs(*_bits(item), np.array([hash(x) for x in near]))
                tail = item[-decontaminate.ANSWER_WORDS :]
                if got >= decontaminate.LEAK * n or got >= decontaminate.PARAPHRASE * n and decontaminate.lcs(*_bits(tail), np.array([hash(x) for x in near])) >= decontaminate.ANSWER * len(tail):
                    want.add((d, i))
                    break
    df, bench = (spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{k} long, text string") for k, rows in (("doc_id", texts), ("item_id", items)))
    got = decontaminate.benchmark_leaks(df, bench).collect()
    assert len(want) >= 60 and {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_latent_space_is_that_of_all_windows(spark):
    rng = np.random.default_rng(3)
    docs = [rng.integers(-1, 300, rng.integers(0, 200)).astype("<i2") for _ in range(1200)]  # more than any sample of 500
    docs = [np.where(c < 0, c, c % 30 + 30 * (k // 120)).astype("<i2") for k, c in enumerate(docs)]  # each 120th has words of its own
    items = decontaminate.Items([0], [np.arange(0, 300, 7)], None)
    idf = np.linspace(1, 2, 300).astype(np.float32)
    encoded = spark.createDataFrame([(i, c.tobytes()) for i, c in enumerate(docs)], "doc_id long, codes binary").repartition(5)
    h, rows = decontaminate.HALF, []
    for c in docs:
        for w in range(max(1, -(-len(c) // h) - 1)):
            own = c[w * h : (w + 2) * h]
            rows.append(np.bincount(own[own >= 0], minlength=300) * idf)
    x = np.array([r / np.linalg.norm(r) for r in rows if r.any()])
    y = np.bincount(items.codes[0][: 2 * h], minlength=300) * idf
    gram = x.T @ x + decontaminate.ITEM_SHARE * len(x) * np.outer(y, y) / (y @ y)
    best = np.linalg.eigvalsh(gram)[::-1][: decontaminate.RANK].sum()
    basis = decontaminate.latent_basis(encoded, items, idf)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)
    assert np.trace(basis.T @ gram @ basis) > 0.99 * best


def _bits(words):
    return decontaminate._places(np.array([hash(x) for x in words]))


# ---- toxicity ----
def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic, low = i % 7 == 0, i % 5 == 0
        w = [f"n{rng.randint(0, 400)}" for _ in range(rng.randint(5, 80))] + ["%%%"] * (3 * low)
        if toxic:
            w += rng.sample(["scumbag", "scumlord", "idiot", "moron"], 2)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_chain_finds_held_out_toxic_documents(spark):
    rows, labels = labelled(random.Random(4), 900)
    docs = spark.createDataFrame([(*r, 0.5) for r in [*rows, (None, "idiot moron"), (5000, None), (5001, "")]], "doc_id long, text string, p_toxic double")
    models = toxicity.train(docs, spark.createDataFrame([*labels[:600], (1, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int"))
    assert len(models) == 3 and len(models[1].extra) == 1 and len(models[2].extra) == 2
    got = {r.doc_id: r for r in toxicity.score(docs, models).collect()}
    assert {i for i, r in got.items() if r.toxic} == {i for i in range(900) if i % 7 == 0} | {None}
    kept = toxicity.drop_toxic(docs, models)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3 - len([1 for i in range(900) if i % 7 == 0]) - 1
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())


# ---- pipeline ----
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert first.columns == docs.columns
    second = corpus_pipeline.STAGES[1][1](spark, first, DATA)
    kept = {r.doc_id: r.text for r in first.collect()}
    want = brute_components(list(kept.items()), 5, 80, 100)
    assert {r.doc_id for r in second.collect()} == {i for i, (_, c) in want.items() if i == c} and second.columns == docs.columns
    out = corpus_pipeline.run(spark, DATA)
    assert 0 < out.count() <= second.count() and out.columns == ["doc_id", "ids", "n_tokens"]


def test_shingles_of_odd_texts():
    texts = ["A b\x0bc", "a B  c ", "a b c", "x", None, "", "é É z"]
    a, b, c, x, none, empty, e = jaccard.shingle_sets(pa.array(texts), 3)
    assert (a == b).all() and len(c) == 1 and c[0] != a[0] and len(x) == 1 and len(none) == len(empty) == 0 and len(e) == 1


# ---- clashes, cuts, vocabularies, held-out accuracy ----
def test_shards_keep_columns_of_any_name(spark):
    names = ["_at", "_in", "_row", "_key", "_bucket", "_upto", "_before", "_cell", "__row", "Slot"]
    df = spark.createDataFrame([tuple(1000 * (k + 1) + i for k in range(len(names))) for i in range(50)], ", ".join(f"`{n}` int" for n in names)).repartition(3)
    out = sharding.hypergeometric_shuffle(df, 4)
    assert out.columns == [*names[:-1], "shard", "slot"]
    assert sorted(tuple(r)[:9] for r in out.collect()) == sorted(tuple(r)[:9] for r in df.collect())


def test_a_cut_archive_is_an_error(tmp_path):
    import gzip
    import io

    whole = gzip.compress(warc.record_bytes("response", "u", b"x" * 5000, 5000, "d", {}))
    assert len(b"".join(warc.inflated(io.BytesIO(whole)))) > 5000
    for cut in (len(whole) - 1, len(whole) - 8, len(whole) // 2):
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.inflated(io.BytesIO(whole[:cut])))
    assert list(warc.inflated(io.BytesIO(b""))) == []


def test_a_file_that_is_there_already_stays(tmp_path, monkeypatch):
    first = warc._Writer(f"file://{tmp_path}/x/a.gz")
    first.out.write(b"one")
    first.done()
    again = warc._Writer(f"file://{tmp_path}/x/a.gz")
    again.out.write(b"one")

    class Strict:  # a store that doesn't replace files
        def __init__(self, fs):
            self.fs = fs

        def move(self, a, b):
            raise OSError("the target exists")

        def __getattr__(self, name):
            return getattr(self.fs, name)

    again.fs = Strict(again.fs)
    again.done()
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["a.gz"]


def test_two_vocabularies_in_one_worker(spark):
    import base64

    from tessera.llm import bpe

    lines = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)]
    raw = [b"\n".join([*lines, base64.b64encode(pair) + b" 256"]) for pair in (b"ab", b"bc")]
    for k in range(20):
        replay = bpe._replay(bytes(bytearray(raw[k % 2])))  # an object of its own each time
        assert [len(x) for x in replay.encode([b"abd", b"bcd"])] == [[2, 3], [3, 2]][k % 2]


def test_empty_tables(spark):
    import public_tokenizers

    from tessera.llm import bpe, licenses, pii
    from tessera.llm.queries import RANKS

    none = spark.createDataFrame([], "doc_id long, text string")
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    assert bpe.bpe_digests(none, path, pattern).collect() == [] and bpe.bpe_decode(bpe.bpe_encode(none, path, pattern), path).collect() == []
    assert licenses.license_scan(none).collect() == [] and pii.redact_pii(none).collect() == []
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    models = toxicity.train(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(none, models).collect() == [] and toxicity.drop_toxic(none, models).collect() == []
    assert jaccard.keep_one(none).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randint(0, 9000)}" for _ in range(300_000))
    item = " ".join(f"q{k} w{k}" for k in range(20))
    rows = [(1, long), (2, long + " end"), (3, f"{long} {item} {long}"), (4, "n1 n2 idiot moron scumbag")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4} or got == {1: 1, 2: 1, 3: 1, 4: 4}
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(df, bench).collect()} == {(3, 7)}
    models = toxicity.train(*(spark.createDataFrame(x, s) for x, s in zip(labelled(random.Random(4), 400), ("doc_id long, text string", "doc_id long, quality int, toxic int"), strict=True)))
    assert {r.doc_id for r in toxicity.score(df, models).collect() if r.toxic} == {4}


def test_scores_equal_a_plain_reckoning(spark):
    rows, labels = labelled(random.Random(14), 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, models).collect()}
    for i, text in rows:
        have, earlier = {c for w in toxicity.words(text) for c in toxicity.codes_of(w)}, []
        for m in models:  # each link reads the links before it
            z = m.bias + sum(w for c, w in zip(m.codes.tolist(), m.weights) if c in have) + sum(e * w for e, w in zip(earlier, m.extra, strict=True))
            earlier.append(1 / (1 + np.exp(-z)))
        assert np.allclose([got[i].p_low_quality, got[i].p_toxic, got[i].p_toxic_low_quality], earlier, atol=1e-9)
        assert got[i].n_toxic == sum(p >= 0.5 for p in earlier[1:]) and got[i].toxic == (got[i].n_toxic > 0)


def test_toxic_documents_of_the_tables_held_out(spark):
    data = "/root/testdata/sf0.1"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    models = toxicity.train(docs, labels.where("pmod(xxhash64(doc_id), 5) <> 0"))
    held = labels.where("pmod(xxhash64(doc_id), 5) = 0").select("doc_id", (labels.toxic == 1).alias("truth"))
    rows = toxicity.score(docs.join(held, "doc_id", "left_semi"), models).join(held, "doc_id").collect()
    toxic, clean = [r for r in rows if r.truth], [r for r in rows if not r.truth]
    assert len(toxic) > 50 and sum(r.toxic for r in toxic) >= 0.8 * len(toxic) and sum(r.toxic for r in clean) <= 0.01 * len(clean)
