"""The registered queries over whole tables: against their SQL, or against plain Python."""

import hashlib
import os
import zlib
from html.parser import HTMLParser

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_table_operators import brute_components
from test_text_operators import brute_base

from tessera.llm import bpe, pii, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLES[name])
    names = sorted(got.columns)
    order = [[d[0] for d in want.description].index(n) for n in names]
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    assert sorted(tuple(show(r[n]) for n in names) for r in got.collect()) == sorted(tuple(show(r[i]) for i in order) for r in want.fetchall())


def test_personal_data_of_all_documents(spark, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op1_pii(spark, DATA).collect():
        base = brute_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.listing(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)


def test_shards_of_all_documents(spark, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = queries.op2_sharding(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_tokens_of_all_documents(spark, con):
    ranks = bpe.parse_ranks(open(public_tokenizers.path(queries.RANKS), "rb").read())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op5_bpe(spark, DATA).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


class Article(HTMLParser):
    """Text blocks inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth > 0:
            self.blocks[-1] += data


def test_text_of_all_pages(spark, con):
    pages = {i: (u, h) for i, u, h in con.execute("SELECT page_id, url, html FROM pages").fetchall()}
    rows = queries.op7_main_text(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        parser = Article()
        parser.feed(pages[r.page_id][1])
        parser.close()
        want = "\n".join(b for b in (" ".join(x.split()) for x in parser.blocks) if b)
        assert r.url == pages[r.page_id][0] and r.text == want and r.n_chars == len(want)


def test_components_of_all_documents(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_jaccard(spark, DATA).collect()}
    assert got == brute_components(rows, 3, 90, 100)


def test_leaks_of_all_documents(spark, con):
    clean = lambda t: " ".join(decontaminate_words(t))
    docs = [(i, clean(t or "")) for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()]
    items = [(i, clean(t)) for i, t in con.execute("SELECT item_id, text FROM benchmark").fetchall()]
    want = {(d, i) for d, text in docs for i, item in items if f" {item} " in f" {text} "}
    assert {(r.doc_id, r.item_id) for r in queries.op3_leaks(spark, DATA).collect()} == want


def decontaminate_words(text):
    import re

    return re.findall(r"[^\W_]+", text.lower())


def test_texts_are_dealt_to_shards(spark):
    plan = queries.op2_sharding(spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [x for x in plan.split("\n\n") if ") Exchange\n" in x and " text#" in x]
    assert len(moved) >= 2  # to the cells and to the buckets of the shards


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def holds(words, item):
    """Whether some surroundings of a window hold the item, by the plain rule."""
    from tessera.llm import decontaminate as d

    n, tail = len(item), item[-d.ANSWER_WORDS :]
    if sum(w in set(words) for w in item) < d.PARAPHRASE * n:
        return False
    for start in range(0, max(1, -(-len(words) // d.HALF) - 1) * d.HALF, d.HALF):
        near = words[max(0, start - n) : start + 2 * d.HALF + n]
        if sum(w in set(near) for w in item) >= d.PARAPHRASE * n:
            got = longest_common(item, near)
            if got >= d.LEAK * n or got >= d.PARAPHRASE * n and longest_common(tail, near) >= d.ANSWER * len(tail):
                return True
    return False


def test_last_stages_of_the_pipeline_equal_plain_versions(spark, con):
    """Decontamination, personal data and tokens, each on all that the stage before kept."""
    import re

    import corpus_pipeline
    from tessera.llm._shared import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], DATA), name))
    second, third, fourth, last = ({r.doc_id: r for r in k.collect()} for k in kept[2:])
    items = [decontaminate_words(t) for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    assert set(third) == {i for i, r in second.items() if not any(holds(decontaminate_words(r.text or ""), item) for item in items)} and 0 < len(third) < len(second)
    for i, r in fourth.items():
        before, spans = third[i].text or "", brute_base(third[i].text or "")
        assert {**r.asDict(), "text": None} == {**third[i].asDict(), "text": None}
        for kind in pii.KINDS:  # as many marks as stretches that begin with this kind
            assert len(re.findall(rf"\[{kind.upper()}\]", r.text)) <= sum(s[0] == kind for s in pii.find_spans(before)[1])
        assert not spans or r.text != before
        if not spans and not pii.find_spans(before)[1]:
            assert r.text == before
        assert not [s for s in brute_base(r.text) if s[0] in ("email", "card")]
    assert set(fourth) == set(third) == set(last)
    ranks = bpe.parse_ranks(open(public_tokenizers.path(queries.RANKS), "rb").read())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.ids == enc.encode_ordinary(fourth[i].text or "") and r.n_tokens == len(r.ids) for i, r in last.items())
