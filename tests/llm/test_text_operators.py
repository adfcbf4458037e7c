"""Personal data, tokens, licences, page text: small cases with known results and brute-force versions."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, html_text, licenses, pii
from tessera.llm.queries import RANKS

CASES = [(1, None), (2, ""), (3, "mail a.b@x.com, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111 or +1 (811) 555-3281"), (3, "twice"), (None, "no id"), (4, "x" * 200_000)]


def docs(spark, rows=CASES):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, n_email int, spans string")


def brute_base(text):
    out = []
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if good(m[0])]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@given(st.text(alphabet="ab1.-+ @()4%é", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert pii.detect(text) == brute_base(text)


@pytest.mark.parametrize("text, kind, found", [
    ("jane [at] example [dot] org!", "email", "jane [at] example [dot] org"), ("bob dot b at corp dot example dot com", "email", "bob dot b at corp dot example dot com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("call plus one eight one one five five five three two eight one now", "phone", "plus one eight one one five five five three two eight one"),
    ("zehn: eins neun zwei punkt eins sechs acht punkt eins punkt zwei", "ip", "eins neun zwei punkt eins sechs acht punkt eins punkt zwei"),
    ("ana (at) mail dot example.com,", "email", "ana (at) mail dot example.com"), ("x.07 at mail1.example.com", "email", "x.07 at mail1.example.com"), ("bo @ ex.org", "email", "bo @ ex.org"),
    ("bo@ex dot org", "email", "bo@ex dot org"), ("10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"), ("10 dot 0 dot zero dot 1", "ip", "10 dot 0 dot zero dot 1"), ("+1 (8ll) 555-32Bl 4111 11l1 1111 1111", "card", "4111 11l1 1111 1111"),
    ("four 1 1 one 1111 1111 1111", "card", "four 1 1 one 1111 1111 1111"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    base, spans = pii.find_spans(text)
    assert [(k, text[s:e]) for k, s, e in spans if (k, s, e) not in base and k == kind] == [(kind, found)]


def test_prose_stays_clean():
    assert pii.find_spans("Look at example.com; at 10 o'clock, 1 2 3 4 5, at dot. Il 1 o 2.") == ([], [])
    assert pii.find_spans("We met at noon at the cafe. One or two dots, a point in time; look at that.") == ([], [])


@given(st.text(alphabet="abcd", max_size=30), st.data())
@settings(max_examples=200, deadline=None)
def test_alignment_inverts(text, data):
    cuts = sorted(data.draw(st.sets(st.integers(0, len(text)), max_size=6)))
    edits = [(a, b, data.draw(st.text(alphabet="XY", max_size=3))) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
    al = pii.Aligned(text, edits)
    for i, ch in enumerate(al.text):
        s, e = al.source_span(i, i + 1)
        assert text[s:e] == ch if ch in "abcd" else any((s, e) == x[:2] for x in edits)


def test_pii_rows_and_redaction(spark):
    got = sorted(pii.pii_spans(docs(spark)).collect(), key=lambda r: (r.doc_id or 0, r.spans))
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(None, 0, 0, 0, 0), (1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (3, 1, 1, 1, 1), (4, 0, 0, 0, 0)]
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[4].spans.startswith("email:5:14,ip:19:27,card:")
    clean = pii.redact_pii(docs(spark))
    texts = {r.text for r in clean.collect()}
    assert clean.columns == docs(spark).columns and "mail [EMAIL], ip [IP] and 300.1.1.1, card [CARD] or [PHONE]" in texts and None in texts
    assert pii.pii_spans(docs(spark, [])).collect() == []


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.parse_ranks(open(public_tokenizers.path(RANKS), "rb").read())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay_equals_the_library(spark, encoding):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé ß漢🙂'll12\n\t.  tion") for _ in range(rng.randint(0, 80))) for _ in range(800)] + ["ab" * 30_000, "<|endoftext|>", " \n \n x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None), (None, "null id"), (0, texts[0])]
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = bpe.bpe_encode(docs(spark, rows), path, pattern)
    got = encoded.collect()
    assert len(got) == len(rows)
    for r in got:
        want = encoding[1].encode_ordinary("" if r.doc_id == -1 else "null id" if r.doc_id is None else texts[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want)
    assert {r.doc_id: bytes(r.bytes).decode() for r in bpe.bpe_decode(encoded.where("doc_id >= 0"), path).collect()} == dict(enumerate(texts))
    d = {r.doc_id: r for r in bpe.bpe_digests(docs(spark, rows), path, pattern).collect()}
    assert d[5].decoded_sha256 == hashlib.sha256(texts[5].encode()).hexdigest() and d[-1].n_tokens == 0


def test_licences(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    spaced = re.sub(r"(.{40,60}) ", r"\1\n  ", mit).upper().replace("SUBLICENSE", "SUB-LICENSE")
    rows = [(1, mit), (2, "© 2021 X\n" + spaced), (3, "Hello.\nReleased under the MIT Licence.\nBye"), (3, "released under the mit license"), (4, None), (5, ""), (6, mit + " And more."), (None, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.license_id, r.scope, r.n_units) for r in licenses.license_scan(docs(spark, rows)).collect()}
    one_line = {(1, "MIT", "line", 1)}
    assert got == one_line | {(1, "MIT", "document", 1), (2, "MIT", "document", 1), (3, "MIT", "line", 2), (3, "MIT", "document", 1), (None, "CC-BY-NC-4.0", "document", 1), (None, "CC-BY-NC-4.0", "line", 1)}
    hints = licenses.HINTS.split("|")
    assert all(any(h in t.lower() for h in hints) for _, t in [*licenses.TEXTS, *licenses.notices()])


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>one<br>two  <b>three</b><p>four &lt;x&gt;<script>var t="</p>"</script><aside>side</aside><div class="comments"><p>me too</p></div></article><footer>f</footer></body></html>'


def test_marked_pages(spark):
    rows = [(1, "http://h/a", PAGE), (2, "http://h/b", None), (3, None, ""), (4, "x", "plain text &amp"), (5, "http://h/c", PAGE[:200]), (1, "http://h/a", PAGE)]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.main_text(spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string")).collect()))
    whole = "A & B\none two three\nfour <x>"
    assert got[:2] == [(1, whole, len(whole))] * 2 and got[2:5] == [(2, "", 0), (3, "", 0), (4, "plain text &", 12)] and got[5][0] == 5


def test_templates_go_where_no_article_is_marked(spark):
    page = lambda i: f'<body><div><div id="top">Site news</div><ul><li>About</li></ul></div><div><p>Story number {i}.</p><p>Shared by {"most" if i < 3 else i}</p></div><div>Imprint</div></body>'
    rows = [(i, "https://a.example/x", page(i)) for i in range(10)] + [(100 + i, "https://b.example/", page(0)) for i in range(20)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Story number 0.\nShared by most" and got[9] == "Story number 9.\nShared by 9"
    assert got[100] == "Site news\nAbout\nStory number 0.\nShared by most\nImprint"  # copies of one page are no template


def test_templates_go_inside_marked_articles_and_by_section(spark):
    page = lambda i, note: f"<body><article><h1>Title {i}</h1><p>Story number {i}.</p><div><p>{note}</p></div></article></body>"
    rows = [(i, f"https://a.example/x/{i}", page(i, "Read more of our stories")) for i in range(6)]
    rows += [(100 + i, f"https://a.example/y/{i}", page(i, f"Note {i}")) for i in range(60)]  # one section of a large host
    rows += [(200 + i, f"https://b.example/{i}", f"<body><p>{i}</p><article><p>The same article</p></article></body>") for i in range(6)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nStory number {i}." for i in range(6))
    assert got[107] == "Title 7\nStory number 7.\nNote 7" and got[203] == "The same article" and len(got) == 72


def test_licence_files_with_titles_and_licences_before_code(spark):
    wrap = lambda t: re.sub(r"(.{50,70}) ", r"\1\n", t)
    text = dict(licenses.TEXTS)
    rows = [(i, f"{licenses.TITLES[k][0]}\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n{wrap(t)}\n") for i, (k, t) in enumerate(licenses.TEXTS)]
    header = wrap(text["BSD-3-Clause"].replace(" 2. ", "\n\n2. ").replace(" THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS", 1))
    rows += [(50, f"def f():\n    pass\n\n{header}\n\nimport os\n"), (51, f"Intro.\n\n{header} More words.\n\nBye"), (52, "A\n\nSome house rules\nof ours.\n\nB")]
    house = spark.createDataFrame([("House", "Some house rules of ours")], "license_id string, text string")
    got = {(r.doc_id, r.license_id, r.scope, r.n_units) for r in licenses.license_scan(docs(spark, rows), known_texts=house).collect()}
    assert got == {(i, k, "document", 1) for i, (k, _) in enumerate(licenses.TEXTS)} | {(i, k, "paragraphs", 1) for i, (k, _) in enumerate(licenses.TEXTS)} | {(50, "BSD-3-Clause", "paragraphs", 1), (52, "House", "paragraphs", 1)}


def anonymous_page(i, words):
    """Without article, nav or telling classes: a menu, a box and a foot whose words differ from page to page."""
    say = lambda n: " ".join(words(n))
    menu = "".join(f"<li><a href='/{k}'>{say(1)}</a></li>" for k in range(3 + i % 4))
    story = f"<h1>{say(4)}</h1>" + "".join(f"<p>{say(20)}</p>" for _ in range(2 + i % 5)) + f"<ul><li>{say(5)}</li><li>{say(6)}</li></ul>"
    parts = re.findall(r"<(?:h1|p|li)>(.*?)</(?:h1|p|li)>", story)
    return f"<body><div class='m{i}'><ul>{menu}</ul></div><div class='k7'><b>{say(6)}</b></div><div class='c{i}'>{story}</div><div><p>{say(5)}</p></div></body>", "\n".join(parts)


def test_templates_whose_words_vary_go_by_their_form(spark):
    rng = random.Random(12)
    words = lambda n: [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 10**6)}" for _ in range(n)]
    pages = [anonymous_page(i, words) for i in range(40)]
    rows = [(i, f"https://c.example/{i}", p) for i, (p, _) in enumerate(pages)] + [(900, "https://lone.example/", pages[0][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert all(got[i].text == want and got[i].n_template >= 5 for i, (_, want) in enumerate(pages))
    assert got[900].n_template == 0 and got[900].text != pages[0][1]  # a site of one page has no template
    off = {r.page_id: r.text for r in html_text.main_text(df, min_pages=10**9).collect()}
    assert all(off[i] != want for i, (_, want) in enumerate(pages))


def test_counts_alone_find_the_articles_of_the_test_pages(spark):
    import os

    from test_queries import Article

    data = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.exists(data):
        pytest.skip("no test tables")
    pages = spark.read.parquet(data)
    html = {r.page_id: r.html for r in pages.collect()}
    counted = [r for r in html_text.main_text(pages, marks=False).collect() if r.n_template]
    same = 0
    for r in counted:
        article = Article()
        article.feed(html[r.page_id])
        article.close()
        same += r.text == "\n".join(b for b in (" ".join(x.split()) for x in article.blocks) if b)
    assert len(counted) > 0.9 * len(html) and same >= 0.99 * len(counted)


@pytest.mark.parametrize("source, blocks", [
    ("<a " * 350_000, 0), ('<a "' * 250_000, 0), ("<a '" * 250_001 + ">", 0), ("<div>x" * 100_000, 100_000), ("</p><div>" * 100_000, 0), ("<p>a<b>" * 50_000, 50_000), ("<script>" * 100_000, 0),
])
def test_long_odd_pages_are_read_in_linear_time(source, blocks):
    import time

    began = time.process_time()
    page = html_text.Page(source)
    page.seen()
    html_text.page_text({k: getattr(page, k) for k in ("blocks", "owner", "parent", "content", "form", "path", "bits")}, set(), set(), set(), set(), False)
    assert len(page.blocks) == blocks and time.process_time() - began < 15


def test_script_texts_and_broken_quotes():
    text = lambda s: html_text.Page(s).blocks
    assert text("<p>a</p><script>if (x<y && s=\"it's\") { t='</p>' }</script><p>b</p>") == ["a", "b"]
    assert text('<p title="5 > 4">a</p><p class="x>b</p><p>c</p>') == ["a", "b", "c"]
    assert text("<p>a<!-- <p>no --> b</p><!DOCTYPE x><p>c<!-- open") == ["a b", "c"] and text("<p>a</p><p cl") == ["a"]


def test_pages_without_rows_and_with_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, blocks int, sites int, whole int"
    assert html_text.main_text(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "https://h/a", "<p>x</p>", "old", "old", 1, 2, 3), (None, None, None, None, None, None, None, None)]
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.main_text(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, None, "", 0), (1, "https://h/a", "x", 1)]


# ---- planted disguises ----
def plain_identifiers(rng):
    word = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(n))
    digits = [rng.randint(0, 9) for _ in range(15)]
    check = next(d for d in range(10) if pii.luhn("".join(map(str, [4, *digits[:14], d]))))
    card = "".join(map(str, [4, *digits[:14], check]))
    return {
        "email": f"{word(rng.randint(3, 8))}{rng.choice(['', '.', '_'])}{word(4)}{rng.randint(1, 99)}@{word(7)}.{rng.choice(['com', 'org', 'net', 'co.uk'])}",
        "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": " ".join(card[k : k + 4] for k in range(0, 16, 4)),
        "phone": f"+{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}",
    }


def spelled(rng, text):
    names = rng.choice(["zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"]).split()
    out = []
    for ch in text:
        out.append(names[int(ch)] if ch.isdigit() else {".": "dot", "+": "plus"}.get(ch, ""))
    return " ".join(w for w in out if w)


def swapped(rng, text, table):
    some = [ch for ch in text if ch in table]
    keep = rng.choice(some)
    return "".join(table[ch] if ch in table and (ch == keep or rng.random() < 0.5) else ch for ch in text)


LOOKS = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "i": "і", "s": "ѕ"}
WIDE = {str(d): chr(0xFF10 + d) for d in range(10)} | {".": "．", "+": "＋", "@": "＠"}
ARABIC = {str(d): chr(0x0660 + d) for d in range(10)}
DISGUISES = {
    "email": [lambda r, t: t.replace("@", r.choice([" [at] ", "(at)", " {AT} ", "<at>"])).replace(".", r.choice([" [dot] ", "(dot)", "[.]"])),
              lambda r, t: t.replace("@", " at ").replace(".", " dot "), lambda r, t: t.replace("@", " @ "), lambda r, t: t.replace("@", " arroba ").replace(".", " punto "),
              lambda r, t: swapped(r, t, WIDE), lambda r, t: swapped(r, "co" + t, LOOKS), lambda r, t: t[:2] + "​" + t[2:]],
    "ip": [lambda r, t: t.replace(".", "[.]"), lambda r, t: t.replace(".", " dot "), lambda r, t: swapped(r, t, WIDE), spelled],
    "card": [lambda r, t: swapped(r, t, WIDE), lambda r, t: swapped(r, t, ARABIC), spelled, lambda r, t: t.replace(" ", "‑"), lambda r, t: swapped(r, t, {"0": "O", "1": "l"}) if t.count("0") + t.count("1") in (1, 2, 3, 4) else swapped(r, t, WIDE)],
    "phone": [lambda r, t: swapped(r, t, WIDE), spelled, lambda r, t: t.replace(" ", "‑"), lambda r, t: swapped(r, t, ARABIC)],
}


def planted(rng, n):
    """(text, kind, disguise, start, end) of identifiers in prose, one a text."""
    prose = "We went to the market and saw two of them there, near a point on the map. Der Tag war schön, la vie est un jeu; no hay mal que por bien no venga".split()
    for _ in range(n):
        kind = rng.choice(pii.KINDS)
        k = rng.randrange(len(DISGUISES[kind]))
        said = DISGUISES[kind][k](rng, plain_identifiers(rng)[kind])
        before, after = (" ".join(rng.choice(prose) for _ in range(rng.randint(2, 30))) for _ in range(2))
        yield f"{before}: {said}; {after}", kind, k, len(before) + 2, len(before) + 2 + len(said)


def test_planted_disguises_are_found_and_prose_is_left_alone(spark):
    rng = random.Random(31)
    cases = list(planted(rng, 4000))
    rows = pii.pii_spans(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string").repartition(4)).collect()
    whole, touched, wrong, missed = 0, 0, 0, {}
    for r in rows:
        _, kind, k, start, end = cases[r.doc_id]
        spans = [(a, int(b), int(c)) for a, b, c in (x.split(":") for x in r.spans.split(",") if x)]
        whole += (kind, start, end) in spans
        hit = any(a == kind and b < end and start < c for a, b, c in spans)
        touched += hit
        wrong += sum(not (b < end and start < c) for _, b, c in spans)
        if not hit:
            missed[kind, k] = missed.get((kind, k), 0) + 1
    print(f"found {touched / 4000:.4f}, exact {whole / 4000:.4f}, spans elsewhere {wrong}, missed {missed}")
    assert touched >= 0.97 * 4000 and whole >= 0.93 * 4000 and wrong <= 4


def test_long_digits_and_long_local_parts():
    assert pii.detect("1.2.3." + "0" * 5001) == [("ip", 0, 5007)] and pii.detect("1.2.3." + "9" * 5001) == []
    local = " dot ".join(f"ab{i}" for i in range(60))
    text = f"to {local} at corp dot example dot com now"
    assert [(k, text[s:e]) for k, s, e in pii.find_spans(text)[1]] == [("email", text[3:-4])]


# ---- licences, read by a second pair of eyes ----
def plain_notice(line):
    """(SPDX id) of a one-line notice by plain reading, or None."""
    words = re.sub(r"[^a-z0-9]+", " ", line.lower().replace("licence", "license")).strip()
    lead = r"(?:licensed|released|distributed|this work is licensed) under (?:the )?"
    for name, spdx in (("mit license", "MIT"), ("isc license", "ISC"), ("zlib license", "Zlib")):
        if re.fullmatch(lead + name, words):
            return spdx
    for name, spdx, versions in (
        ("apache license", "Apache", "2 0|1 1"), ("gnu general public license", "GPL", "2|2 0|3|3 0"), ("gnu lesser general public license", "LGPL", "2 1|3|3 0"),
        ("gnu affero general public license", "AGPL", "3|3 0"), ("mozilla public license", "MPL", "1 1|2 0"), ("cc0", "CC0", "1 0"),
        *((f"cc by{k.lower().replace('-', ' ')}", f"CC-BY{k}", "2 0|3 0|4 0") for k in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND")),
    ):
        if m := re.fullmatch(rf"{lead}{name} (?:version )?({versions})", words):
            v = m[1].replace(" ", ".")
            return f"{spdx}-{v if '.' in v else v + '.0'}"
    m = re.fullmatch(r"spdx license identifier ([a-z0-9 ]+)", words)
    known = {re.sub(r"[^a-z0-9]+", " ", k.lower()): k for k, _ in licenses.notices()}
    return known.get(m[1]) if m else None


def test_notices_of_the_documents_equal_a_plain_reading(spark):
    import os
    from collections import Counter

    data = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(data):
        pytest.skip("no test tables")
    table = spark.read.parquet(data)
    want = Counter((r.doc_id, k) for r in table.collect() for line in (r.text or "").split("\n") if (k := plain_notice(line)))
    got = {(r.doc_id, r.license_id): r.n_units for r in licenses.license_scan(table).where("scope = 'line'").collect()}
    assert want and got == want


def test_long_licences_by_their_digests(spark):
    import os

    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(k, spdx, open(f"{folder}/{f}").read()) for k, (f, spdx) in enumerate(files.items()) if os.path.exists(f"{folder}/{f}")]
    if not rows:
        pytest.skip("no licence files")
    cases = [(k, re.sub(r"[ \t]+", "  ", t).upper()) for k, _, t in rows] + [(100 + k, f"/* Start */\n\n{t}\n\nint main;\n") for k, _, t in rows] + [(200 + k, t[:-200]) for k, _, t in rows]
    got = {(r.doc_id, r.license_id, r.scope) for r in licenses.license_scan(docs(spark, cases)).collect()}
    assert got == {(k, spdx, "document") for k, spdx, _ in rows} | {(100 + k, spdx, "paragraphs") for k, spdx, _ in rows}
