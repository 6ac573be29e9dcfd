"""Tokens, languages, toxicity, secrets, pages, archives and the whole pipeline."""

from __future__ import annotations

import hashlib
import io
import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from basketrank.llm import bpe, decontaminate, language, secret_scan, toxicity, warc, wrappers  # noqa: E402
from basketrank.llm.html_tree import parse  # noqa: E402
from basketrank.llm.queries import QUERIES  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string"
PLAIN = {r[0]: r[1] for r in brute.ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return (
        spark.createDataFrame(brute.ROWS, SCHEMA)
        .repartition(3, "doc_id")
        .selectExpr("*", "'x' AS ids", "1 AS _id", "2 AS lang_pred", "3 AS Score")
    )


@pytest.fixture(scope="module")
def corpus(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# Tokens


def test_tokens_equal_the_library(docs, corpus):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.locate(bpe.TOKENIZER))
    for df in (docs, corpus):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, bpe.TOKENIZER).collect()}
        assert got.keys() == texts.keys()
        for doc, text in texts.items():
            ids = plain.encode(text, add_special_tokens=False).ids
            back = plain.decode(ids, skip_special_tokens=False)
            assert got[doc] == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(back))


def test_encode_then_decode_gives_the_text(docs):
    back = bpe.decode(bpe.encode(docs, bpe.TOKENIZER), bpe.TOKENIZER)
    assert {r.doc_id: r.text for r in back.collect()} == {d: t or "" for d, t in PLAIN.items()}


def test_tokens_of_hard_texts_and_a_tiny_cache():
    from tokenizers import Tokenizer

    path = bpe.locate(bpe.TOKENIZER)
    plain, own = Tokenizer.from_file(path), bpe.Codec(path, cache=3)
    for text in ("a" * 5000, "ab" * 3000 + "!", " 　\t\n x", "١٢ I'll've 'S", "\U0001f600" * 50, "-" * 4001, "é" * 999, "<|endoftext|>" * 3):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == plain.decode(ids, skip_special_tokens=False)
    assert own.decode([own.first[0xC3]]) == "�"


def test_pair_tree_root_is_the_least_key():
    assert bpe.pair_tree([5, 3, 9])[1] == 3
    assert bpe.pair_tree([bpe.NONE])[1] == bpe.NONE


# Languages


def test_language_of_held_out_rows(corpus):
    found = language.identify(corpus).join(corpus, "doc_id").collect()
    assert len(found) == corpus.count()
    assert all(r.held_out == (brute.fold(r.doc_id, 4) == 2) for r in found)
    held = [r.lang == r.lang_pred for r in found if r.held_out and r.lang]
    assert sum(held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_equals_a_plain_version(docs, corpus):
    profiles = language.learn_profiles(corpus)
    ranker = language.Ranker(profiles, cache=5)
    for text in [*PLAIN.values(), *[r.text for r in corpus.limit(40).collect()]]:
        lang, score = ranker.predict(text)
        want = brute.language(profiles, text, language.TOP, language.grams, language.place)
        assert (lang, score) == (want[0], pytest.approx(want[1]))


def test_language_without_letters_or_labels(docs, spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    assert len(got) == len(PLAIN)
    assert all(got[d] == ("und", 0.0) for d in (1, 2, 3, 18))
    bare = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify(bare).first().lang_pred == "und"
    left = language.drop_unidentified(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(PLAIN) - {1, 2, 3, 18})


# Toxicity


def test_toxicity_ranks_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(brute.fold(r.doc_id, 5) == 0 and 0 <= r.score <= 1 for r in found)
    bad, good = ([r.score for r in found if r.toxic == k] for k in (1, 0))
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert auc >= 0.9
    assert sum(s >= 0.5 for s in bad) / len(bad) >= 0.8
    assert sum(s >= 0.5 for s in good) / len(good) <= 0.02


def test_machine_learns_a_combination():
    """Terms 0 and 1 are harmless alone and toxic together."""
    import numpy as np

    rows = [[0], [1], [0, 1], [2], [0, 2], [1, 2], []] * 60
    labels = np.array([float(0 in r and 1 in r) for r in rows])
    machine = toxicity.train([10, 11, 12], [np.array(r, int) for r in rows], labels)
    assert machine.score([0, 1]) > 0.9
    assert max(machine.score(r) for r in ([0], [1], [2], [0, 2], [1, 2], [])) < 0.2


def test_words_that_are_harmless_alone_enter_as_a_pair(spark):
    """alpha and omega have the average share of toxic texts each, and all texts with both are toxic."""
    fill = lambda i: f"some words {i % 17} about thing{i % 7} and more"
    rows = []
    for i in range(1000):
        if i < 60:
            rows.append((i, f"{fill(i)} alpha omega {fill(i + 1)}", 1))
        elif i < 340:
            rows.append((i, f"{'alpha' if i < 200 else 'omega'} {fill(i)}", 0))
        else:
            rows.append((i, fill(i) + (" zeta" if i < 580 else ""), int(i < 580)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    alpha, omega, zeta = (toxicity.zlib.crc32(f"={w}".encode()) % toxicity.DIMS for w in ("alpha", "omega", "zeta"))
    assert {alpha, omega, zeta} <= set(machine.places)
    look = toxicity.Lookup(machine.places)
    value = lambda text: machine.score(look(text))
    assert min(value("x alpha omega y"), value("zeta")) > 0.8
    assert max(value("alpha x"), value("x omega"), value("neither")) < 0.3
    # Neither of them is strong by itself.
    joined = docs.join(labels, "doc_id").selectExpr("doc_id AS _id", "text AS _text", "toxic AS _toxic")
    assert not {alpha, omega} & set(toxicity.strong_terms(joined))


def test_scores_equal_a_double_loop(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit(docs, labels)
    assert len(machine.places) > 10

    def plain(text):
        import re

        found = set()
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            found |= {f"={word}"} | {f"^{word[:n]}" for n in range(4, 9) if n <= len(word)}
        at = sorted({machine.places[p] for t in found if (p := toxicity.zlib.crc32(t.encode()) % (1 << 20)) in machine.places})
        x = machine.intercept + sum(machine.weights[i] for i in at)
        for k, i in enumerate(at):
            for j in at[k + 1 :]:
                x += sum(a * b for a, b in zip(machine.vectors[i], machine.vectors[j]))
        return 1 / (1 + 2.718281828459045 ** -max(-30, min(30, x)))

    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    for row in docs.collect():
        assert abs(got[row.doc_id] - plain(row.text)) < 1e-9


def test_a_repeated_id_does_not_fill_the_driver(spark, monkeypatch):
    """Rows of one id are drawn again by their text, and equal ones train once."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda places, rows, labels: seen.append(len(rows)))
    docs = spark.range(3000).selectExpr("1L AS doc_id", "concat('text number ', id % 1500) AS text")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, sample=100)
    assert 0 < seen[0] < 400


def test_toxicity_of_hard_rows(docs, spark):
    labels = spark.createDataFrame(
        [(7, 1), (7, 0), (9, None), (None, 1), (15, 0), (99, 1)], "doc_id long, toxic int"
    )
    found = toxicity.toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in found) == sorted(PLAIN)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


# Secrets


def _base(text):
    import re

    out = [
        (m.start(), "assign", m.end())
        for m in re.finditer(
            r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text
        )
        if len(m[2]) >= 6
    ]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda x: (x[0], order.index(x[1])))


def test_base_secrets_equal_a_plain_version(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op10_secrets"](spark, small).collect():
        want = _base(texts[r.doc_id] or "")
        kinds = [k for _, k, _ in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{s}:{e}" for s, k, e in want))
        assert set(f"{k}:{s}:{e}" for s, k, e in want) <= set(filter(None, r.spans.split(",")))


@pytest.mark.parametrize(
    "text,literals",
    [
        ('seed = "Qk39fjalskdjf93"\nlogin_pwd = seed', ["Qk39fjalskdjf93"]),
        ('a = b = "x9y8z7w6v5u4"\nprivateKey: a', ["x9y8z7w6v5u4"]),
        ("cfg['signing-key'] = 'sk_' + \"live_92837498\"", ["live_92837498"]),
        ("<dbPassword>9f8e7d6c5b4a</dbPassword>", ["9f8e7d6c5b4a"]),
        ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MD", ["wJalrXUtnFEMI/K7MD"]),
        ('color = "Qk39fjalskdjf93"', []),
        ("credentials = your_credentials_here", []),
        ("the key: we met at 10:30, see http://x.org/a=b", []),
        ("if pwd == 'abcdef123456': pass", []),
        ("", []),
    ],
)
def test_literals_of_sensitive_names(text, literals):
    assert [text[s:e] for s, e, k, *_ in secret_scan.scan(text) if k == "literal"] == literals


def test_secrets_of_long_hostile_texts_take_linear_time():
    import time

    start = time.process_time()
    for piece in ("a=", "a:", 'a="', "token=", "a=b+", "a.b-", "\\\"", "<a>"):
        secret_scan.scan(piece * 20_000)
    assert time.process_time() - start < 20


@pytest.mark.parametrize(
    "make",
    [
        lambda n: 'x = x + "lit"\n' * n,
        lambda n: "".join(f'password{i} = x{i % 9} + "k3y{i}abcdef"\nx{i % 9} = password{i}\n' for i in range(n)),
        lambda n: "token=abcdef123456 " * n + 'seed = "Qk39fjalskdjf93"\npwd = seed\n' * n,
        lambda n: "name> " * n + "<a>" * n,
    ],
)
def test_twice_the_text_takes_about_twice_the_time(make):
    import time

    def seconds(text):
        start = time.process_time()
        secret_scan.scan(text)
        return time.process_time() - start

    short, long = make(8_000), make(16_000)
    # The least of several runs; the constant covers very quick ones.
    assert min(seconds(long) for _ in range(3)) <= 2.5 * min(seconds(short) for _ in range(3)) + 0.1


def test_shared_values_reach_every_target():
    text = 'a = "Qk39fjalskdjf93"\nb = a + "x9y8z7w6v5u4"\nauth_salt = b\nlogin_pwd = b\nmy_token = a\n'
    found = {text[s:e]: (name, score) for s, e, k, name, score in secret_scan.scan(text)}
    # my_token is the most sensitive target of the first, login_pwd of the second.
    assert {v: name for v, (name, _) in found.items()} == {"Qk39fjalskdjf93": "my_token", "x9y8z7w6v5u4": "login_pwd"}
    assert all(0.6 <= score <= 1 for _, score in found.values())


def test_secrets_of_hard_rows(spark):
    secret = 'api_key = "Qk39fjalskdjf93"'
    rows = [(1, None), (None, secret), (2, ""), (2, secret), (2, secret), (3, "  ")]
    schema = "doc_id long, text string, spans string, _text string, KIND int, _id int"
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], schema)
    got = secret_scan.find_secrets(df.repartition(3))
    assert got.columns == ["doc_id", "spans"]
    found = sorted((r.doc_id or 0, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in got.collect())
    spans = (("assign", 0, 26),)
    assert found == [(0, spans), (1, ()), (2, ()), (2, spans), (2, spans), (3, ())]
    assert secret_scan.find_secrets(df.limit(0)).collect() == []


# Pages


def test_unclosed_declarations_are_read_once():
    import time

    start = time.process_time()
    for piece in ("<!", "<!--", "<![CDATA[", "<?"):
        parse("<p>kept</p>" + piece * 200_000)
    assert time.process_time() - start < 5


PAGE = (
    "<html><body><header>Site</header><div id='nav'><a href=x>Home</a> <a href=y>About</a></div>"
    "<div class='cookie-notice'>We use cookies</div><div class=wrap><div class=left><h1>Title {0}</h1>"
    "<p>Hello &amp; welcome\n to story {0}<br>second line</p><p>More of <b>thing</b>s {0}, quite long really.</p>"
    "<p>Shared words</p><ul><li>one {0}<li>two</ul><div class=share>Share this</div></div>"
    "<div class=sidebar><p>Popular {0}</p></div></div><form><input name=q>Search</form>"
    "<div id=comments><p>user: nice {0}</p></div><footer>(c) 2020</footer><script>var a='<p>no</p>'</script></body>"
)
ARTICLE = (
    "<body><nav><ul><li><a href=a>{0}</a></ul></nav><!-- ad --><div class=ad>Buy {0}</div><article><h1>T{0}</h1>"
    "<p>First {0} &lt;here&gt;</p><aside>Aside</aside><section class=comments><p>me too</p></section></article></body>"
)
PAGES = [
    *[(i, "http://u@A.example.org:80/x", PAGE.format(i)) for i in range(6)],
    *[(10 + i, "https://b.example.org/x?y", ARTICLE.format(i)) for i in range(3)],
    (20, "https://b.example.org/odd", "<body><p>No article at all, a plain page</p><nav>menu</nav></body>"),
    (21, None, None),
    (22, "not an address", ""),
    (23, None, "<p>alone &#233;" + "<div>" * 3000 + "deep"),
    (24, "https://c.example.org", "<<<< & <a '\"' <b <!-- open"),
    (25, "https://c.example.org", "<article></article><nav>x</nav>"),
    (2, "http://a.example.org/again", PAGE.format(2)),
]


def test_main_text(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr(
        "*", "1 AS host", "2 AS wrapper", "3 AS text", "4 AS _id"
    )
    found = wrappers.extract(df.repartition(3)).collect()
    assert sorted(r.page_id for r in found) == sorted(p[0] for p in PAGES)
    assert all(r.n_chars == len(r.text) for r in found)
    text = {r.page_id: r.text for r in found}
    for i in range(6):
        assert text[i] == (
            f"Title {i} Hello & welcome to story {i} second line More of things {i}, quite long really. "
            f"Shared words one {i} two"
        )
    for i in range(3):
        assert text[10 + i] == f"T{i} First {i} <here>"
    assert text[20] == "No article at all, a plain page"
    assert text[21] == text[22] == text[25] == ""
    assert text[23] == "alone é deep"
    assert wrappers.extract(df.limit(0)).count() == 0


def test_main_text_of_generated_pages(spark, small):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, small).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        plain = html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner))
        assert r.text == " ".join(plain.split())


def test_deep_nesting_loses_and_leaks_nothing():
    deep = lambda n, inner="": "<div>" * n + inner + "</div>" * n
    page = "<body><div><article><p>Before {0}</p>" + deep(150) + "<p>After {0}</p></article></div></body>"
    menu = "<body><article><p>Text {0}</p>" + deep(150, "<nav>menu</nav><p>inner {0}</p>") + "<p>End</p></article></body>"
    huge = "<body><article>" + deep(50_000, "<p>core {0}</p><form>f</form>") + "<p>End {0}</p></article>" + "<b>" * 50_000
    for form, want in ((page, "Before {0} After {0}"), (menu, "Text {0} inner {0} End"), (huge, "core {0} End {0}")):
        pages = [form.format(i) for i in range(2)]
        own = wrappers._dump(wrappers.align(*(wrappers.wrap(parse(p)) for p in pages)))
        assert [wrappers.main_text(p, own) for p in pages] == [want.format(i) for i in range(2)]


def test_texts_do_not_depend_on_the_number_of_blocks():
    kinds = ("p", "h2", "pre", "blockquote", "table", "figure")
    links = "<ul>" + "<li><a href=x>other page</a></li>" * 3 + "</ul>"
    for n in (8, 40, 60, 61, 120, 300):
        pages = []
        for i in range(3):
            blocks = [(k, f"<{kinds[k % 6]}>block {k} of {i}</{kinds[k % 6]}>", f"block {k} of {i}") for k in range(n)]
            more = [
                (2, "<section>Always the same words</section>", ""),
                (3, f"<ul><li>first {i}</li><li>second {i}</li></ul>", f"first {i} second {i}"),
                (5, links, ""),
                (6, f"<section>words of {i}</section>", f"words of {i}"),
            ]
            rows = sorted(blocks + more, key=lambda row: row[0])
            html, texts = "".join(r[1] for r in rows), " ".join(r[2] for r in rows if r[2])
            pages.append((f"<body>{html}</body>", texts))
        own = wrappers.wrap(parse(pages[0][0]))
        for page, _ in pages[1:]:
            own = wrappers.align(own, wrappers.wrap(parse(page)))
        for page, want in pages:
            assert wrappers.main_text(page, wrappers._dump(own)) == want, n


def test_alignment_equals_the_plain_table():
    import random

    draw = random.Random(5)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        first = wrappers._earlier(a, b)
        for i in range(len(a)):
            for j in range(len(b)):
                assert first(i, j) == (best[i + 1][j] >= best[i][j + 1])


def test_wrapper_has_slots_options_and_repetitions():
    pages = [
        "<div><h1>a</h1><p>x</p><p>y</p></div>",
        "<div><h1>b</h1><i>new</i><p>z</p></div>",
        "<div><h1>c</h1><p>x</p><p>y</p><p>q</p></div>",
    ]
    own = wrappers.wrap(parse(pages[0]))
    for page in pages[1:]:
        own = wrappers.align(own, wrappers.wrap(parse(page)))
    (div,) = own[wrappers.ITEMS]
    kinds = [(i[wrappers.LABEL], i[wrappers.KIND]) for i in div[wrappers.ITEMS]]
    assert kinds == [("h1", "1"), ("i", "?"), ("p", "+")]
    assert div[wrappers.ITEMS][0][wrappers.ITEMS][0][wrappers.TEXT] is None
    groups = wrappers.wrap(parse("<dl>" + "<dt>k<dd>v" * 5 + "</dl>"))[wrappers.ITEMS][0]
    assert [(i[wrappers.LABEL], i[wrappers.KIND]) for i in groups[wrappers.ITEMS]] == [("dt", "+"), ("dd", "+")]


# Archives

PAYLOADS = [
    (1, "http://x/1", "<p>same</p>"),
    (2, "http://x/2", "<p>same</p>"),
    (3, None, None),
    (4, "http://x/4 é\r\n", ""),
    (5, "http://x/5", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 200 + "é"),
    (6, "http://x/6", "<p>same</p>"),
    (7, "http://x/7", "\r\n\r\n"),
    (None, "http://x/8", "<p>same</p>"),
    (6, "http://x/6", "<p>same</p>"),
]


def _digest(text):
    return warc.base32_sha1(hashlib.sha1((text or "").encode()).digest())


@pytest.mark.parametrize("chunk,least", [(7, 0), (64, 5), (1 << 20, 0)])
def test_archives_read_back(spark, chunk, least):
    pages = spark.createDataFrame(PAYLOADS, "page_id long, url string, html string").selectExpr(
        "*", "1 AS sha1", "2 AS best", "3 AS chunk"
    )
    plan = warc.plan_records(pages.repartition(3), least)
    manifest = warc.write_archives(plan, chunk=chunk, archive_bytes=500)
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAYLOADS)
    found = warc.read_records(manifest, chunk).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in found), key=key)
    want = []
    for page, _, text in PAYLOADS:
        size = len((text or "").encode())
        best = max((p for p, _, t in PAYLOADS if (t or "") == (text or "") and p is not None))
        again = size >= least and page != best
        want.append((page, size, _digest(text), "revisit" if again else "response", best if again else 0))
    assert got == sorted(want, key=key)
    chunks = warc.read_chunks(manifest, chunk).filter("record_type = 'response'").collect()
    assert all(len(r.chunk) <= chunk for r in chunks)
    whole = {}
    for r in sorted(chunks, key=lambda r: (r.record_id, r.chunk_no)):
        whole.setdefault(r.page_id, []).append(bytes(r.chunk))
    assert b"".join(whole[5]).decode() == PAYLOADS[4][2]


def test_chunks_are_cut_one_at_a_time(spark):
    text = "".join(chr(97 + i % 26) for i in range(1003))
    pages = spark.createDataFrame([(1, "http://x", text), (2, "http://y", text)], "page_id long, url string, html string")
    chunks = warc.to_chunks(warc.plan_records(pages, 1), 10)
    run = chunks._jdf.queryExecution().executedPlan().toString()
    exploded = [line for line in run.splitlines() if "Generate" in line and "explode(" in line]
    assert exploded and not any("substr" in line or "transform" in line for line in exploded)
    found = {(r.page_id, r.chunk_no): r.chunk for r in chunks.collect()}
    assert len(found) == 102 and found.pop((1, 0)) is None
    assert b"".join(bytes(found[2, k]) for k in range(101)) == text.encode()


def test_damaged_archives_are_found(spark):
    pages = spark.createDataFrame([(1, "http://x", "<p>text</p>")], "page_id long, url string, html string")
    path = warc.write_archives(warc.plan_records(pages)).first().path
    data = Path(path.removeprefix("file:")).read_bytes()
    assert len(list(warc.chunks_of(io.BufferedReader(io.BytesIO(data)), 3))) == 4
    for broken in (data.replace(b"<p>text", b"<p>test"), data[:-12]):
        with pytest.raises(ValueError):
            list(warc.chunks_of(io.BufferedReader(io.BytesIO(broken))))


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(pages).count() == 0


# The pipeline


def test_pipeline_equals_plain_stages(spark, docs, tmp_path):
    bench = spark.createDataFrame(brute.ITEMS, "item_id long, text string")
    folder = str(tmp_path / "tables")
    docs.selectExpr("doc_id", "text", "lang", "source", "1 AS n_chars", "2 AS ids").write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    rows = {d: t for d, t in PLAIN.items() if t and any(c.isalpha() for c in t)}
    rows = {max(d for d, u in rows.items() if u == t): t for t in rows.values()}
    near = brute.similar(list(rows.items()), 5, 80)
    rows = {d: t for d, t in rows.items() if near[d][1] == d}
    leaks = brute.contaminated(list(rows.items()), brute.ITEMS, decontaminate.SIZE)
    rows = {d: t for d, t in rows.items() if not leaks[d][4]}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert found.keys() == rows.keys()
    assert all(found[d].decoded_sha256 == brute.sha(t) for d, t in rows.items())


def test_pipeline_stages_keep_columns(spark, docs, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, small).columns == docs.columns
    none = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, small).count() == 0


def test_wrappers_are_plain_json(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").selectExpr("parse_url(url, 'HOST') AS host", "html")
    found = wrappers.learn_wrappers(pages).collect()
    assert len(found) == pages.select("host").distinct().count()
    assert all(json.loads(r.wrapper)[0] == "/" for r in found)
