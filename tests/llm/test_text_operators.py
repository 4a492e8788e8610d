"""Line dedup, personal data, main text, encodings and token records."""

import random

import public_tokenizers
import pytest

from joblattice.llm import bpe, line_dedup, main_text, pii, records
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "ß", "日", "12", "½", "².", "!!", "'s", "'ll", "\x1c", "\x85", " ", "　", "😀", "token", " ing", "_", "\x00"]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]


# line dedup

def test_line_dedup_drops_what_many_pages_of_a_site_share(spark):
    rows = [(i, "s" if i < 40 else None, f"menu\nbody {i}\n\nmenu\nend {i % 2}", "x") for i in range(60)]
    rows += [(100 + i, "small", "menu\nsame", "x") for i in range(4)] + [(200, "s", None, "x"), (201, "s", "menu", "x"), (201, "s", "menu", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_lines string")
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df, ratio=0.6).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert by[3] == ("body 3\n\nend 1", 5, 2) and by[45] == ("body 45\n\nend 1", 5, 2)
    assert by[100] == ("menu\nsame", 2, 0)  # too few pages
    assert by[200] == (None, 0, 0) and by[201] == ("", 1, 1)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# personal data

def test_base_spans_of_random_texts():
    rng = random.Random(2)
    parts = list("a@.1 +-_%()") + ["12", "255", "4111111111111111", "a@b.c", "1.2.3.4", "+1 (555) 123-4567", "x@y.z", "é", "256"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [s[:3] for s in pii.spans(t) if s.base] == brute.base_spans(t)


def test_added_spans_need_checksums_or_context():
    def kinds(t):
        return [s.kind for s in pii.spans(t)]

    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("his social security number is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("please call 555-123-4567") == ["phone"] and kinds("555-123-4567") == []
    assert kinds("1" * 100_000 + ".") == [] and kinds("@" * 5000) == []


def test_personal_data_of_a_table(spark):
    texts = [None, "", "mail a@b.co, card 4111 1111 1111 1111 é", "x"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] * 2, "doc_id long, text string, spans string")
    got = pii.redact(pii.find(df)).collect()
    assert len(got) == 8
    assert {r.doc_id: r.text for r in got} == {0: None, 1: "", 2: "mail [email], card [card] é", 3: "x"}
    assert pii.find(df.limit(0)).count() == 0


def test_personal_data_query(spark):
    got = {r.doc_id: r for r in pii.op4(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = brute.base_spans(r.text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[r.doc_id].base_sha256 == brute.sha(listed.encode())
        assert got[r.doc_id].n_card == sum(k == "card" for k, _, _ in want)
        assert set(listed.split(",")) - {""} <= set(got[r.doc_id].spans.split(","))


# main text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home has-sidebar"><div id="cookie-notice">We use cookies to
make this better, accept.</div><header><a href=/>Site</a></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="content">
<h1>Title &amp;  more</h1><p>Short.<p>A long <b>paragraph<i> with</b> <a href=q>one link</a> in it, &lt;b&gt; &#233;.<blockquote>Quote</blockquote>
<ul><li>one<li>two</ul><div class="ad-box">Buy now</div><table><tr><td>a<td>b</table><form>Name <input></form><p>Last words of the text, enough
to count.</div><aside>Popular</aside><section id="comments"><p>I think this article is wrong in so many ways, and will say so at length.</p>
</section><footer>c</footer><script>var x="<p>no</p>";</script></body>"""


def test_main_text_leaves_boilerplate_out():
    assert main_text.main_text(PAGE) == "\n".join([
        "Title & more", "Short.", "A long paragraph with one link in it, <b> é.", "Quote", "one", "two", "a", "b",
        "Last words of the text, enough to count."])
    assert main_text.main_text("") == "" and main_text.main_text("<nav>only menu</nav>") == ""
    assert main_text.main_text("<p>cut off <b>here</b><foot") == "cut off here"
    assert main_text.main_text("<a '" * 3000 + "<p>x</p>").endswith("x")
    assert main_text.main_text("<div>" * 5000 + "deep") == "deep"


def test_main_text_keeps_named_articles_in_main():
    post = '<article class="post" id="p1"><h1>Title</h1><p>The first paragraph of the post.<p>And its last one.</article>'
    want = "Title\nThe first paragraph of the post.\nAnd its last one."
    said = "<p>I have a great deal to say about this and will say it at length here.</p>" * 20
    links = "<ul>" + "<li><a href=x>Some other page of this site</a>" * 60 + "</ul>"
    for other in (f'<section id="comments">{said}</section>', f'<section id="comments"><article class="c">{said}</article></section>',
                  f'<div class="related"><article class="card"><p>Another post, in short.</article></div>', links):
        assert main_text.main_text(f"<body><main>{post}{other}</main></body>") == want, other
    for other in (f"<nav>{links}</nav>", f"<footer>{said}</footer>", f'<div id="comments">{said}</div>', f"<aside><article>{said}</article></aside>"):
        assert main_text.main_text(f"<body><main>{post}</main>{other}</body>") == want, other
    reply = '<article class="x"><p>A reply inside the article.</article>'
    assert main_text.main_text(f"<main>{post.replace('</article>', reply + '</article>')}</main>") == want


def test_main_text_keeps_several_articles_of_one_main():
    posts = [f'<article class="post"><h2>Post {i}</h2><p>Words of post {i}, some of them.<p>More of it.</article>' for i in range(3)]
    want = "\n".join(f"Post {i}\nWords of post {i}, some of them.\nMore of it." for i in range(3))
    footer = "<footer>" + "<p>Terms, conditions and much else that nobody reads.</p>" * 30 + "</footer>"
    assert main_text.main_text(f"<body><main>{''.join(posts)}</main>{footer}</body>") == want


def test_main_text_keeps_pages_wrapped_in_a_form():
    text = "<h1>Title</h1><p>Words of the page, quite a few of them.<p>And more."
    controls = "<label>Name <input name=n></label><select><option>One</select><button>Send</button>"
    want = "Title\nWords of the page, quite a few of them.\nAnd more."
    for inner in (text, f"<article>{text}</article>", f"<div class=c>{text}</div>", f"<main>{text}</main>"):
        assert main_text.main_text(f"<body><form action=x>{controls}{inner}</form></body>") == want, inner
        assert main_text.main_text(f"<body><form action=x><nav>Menu</nav>{inner}</form><footer>{'Much small print. ' * 5}</footer></body>") == want, inner
    assert main_text.main_text(f"<body><aside>{text}</aside></body>") == want
    assert main_text.main_text(f"<body><article>{text}</article><form>{'Sign up for our letters. ' * 30}</form></body>") == want


def test_main_text_query(spark):
    import re
    from html import unescape

    rows = {r.page_id: r for r in main_text.op2(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", p.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert rows[p.page_id].text == "\n".join(x for x in parts if x)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_main_text_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (2, "", "c")], "page_id long, html string, text string")
    assert [r.text for r in main_text.extract(df).collect()] == ["", "", ""]
    assert main_text.extract(df.limit(0)).count() == 0


# byte-level BPE

def test_encodings_equal_the_public_library(tiktoken_encoding):
    one = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    texts = random_texts(3000, 3) + ["a" * 5000, "ab" * 3000, "=" * 777, "\n " * 300, "aabbab" * 500, "<|endoftext|> x"]
    for t, got in zip(texts, one.encode(texts), strict=True):
        assert got == brute.packed(tiktoken_encoding.encode_ordinary(t)), t


def test_appends_and_edits_stay_exact(tiktoken_encoding):
    rng = random.Random(5)
    kept = bpe.Incremental(bpe.vocabulary(RANKS), public_tokenizers.PATTERN)
    text = ""
    for _ in range(600):
        new = "".join(rng.choice(PARTS) for _ in range(4))
        if rng.random() < 0.5:
            kept.append(new)
            text += new
        else:
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 6))
            kept.replace(a, b, new)
            text = text[:a] + new + text[b:]
        assert kept.text == text and kept.ids() == tiktoken_encoding.encode_ordinary(text)
    long = bpe.Incremental(bpe.vocabulary(RANKS), public_tokenizers.PATTERN, "some words to edit " * 500)
    assert long.replace(5000, 5004, "edited") < 12


def test_round_trip_query(spark, tiktoken_encoding):
    got = {r.doc_id: r for r in bpe.op3(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tiktoken_encoding.encode_ordinary(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), brute.sha(brute.packed(ids)))
        assert got[r.doc_id].decoded_sha256 == brute.sha(r.text.encode())


def test_encoding_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "hi  there", 7), (3, "hi  there", 7)], "doc_id long, text string, ids int")
    back = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in back) == [(1, b""), (2, b""), (3, b"hi  there"), (3, b"hi  there")]
    wrong = spark.createDataFrame([(None,), (bytearray(b"\xff\xff\xff\xff"),), (bytearray(b"abc"),)], "ids binary")
    assert [r.decoded for r in bpe.decode(wrong, RANKS).collect()] == [None, None, None]
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# token records

def test_checksums():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    rng = random.Random(6)
    data = [rng.randbytes(n) for n in (0, 1, 3, 4, 5, 255, 256, 257, 3000, 70_001)]
    assert [int(x) for x in records.crc32c(data)] == [records._crc_of_few(b) for b in data]
    framed = records.frame(data)
    assert records.unframe(b"".join(framed), [len(f) for f in framed]) == data
    broken = bytearray(b"".join(framed))
    broken[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        records.unframe(bytes(broken), [len(f) for f in framed])


def test_records_of_odd_tables(spark, tmp_path):
    rows = [(5, "five"), (None, "none"), (3, None), (3, ""), (4, "rep eat"), (4, "rep eat"), (9, "long " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "t").selectExpr("*", "1 as shard")
    folder = f"file://{tmp_path}/r"
    index = records.write(df, folder, JSON, text="t")
    got = [(r.doc_id, len(r.ids) // 4) for r in records.read(index.orderBy("shard", "offset"), folder).orderBy("shard", "offset").collect()]
    assert [g[0] for g in got] == [None, 3, 3, 4, 4, 5, 9]
    shuffled = records.read(index.orderBy(index.length.desc()), folder).collect()
    assert sorted(len(r.ids) // 4 for r in shuffled) == sorted(n for _, n in got)
    empty = records.write(df.limit(0), f"file://{tmp_path}/e", JSON, text="t")
    assert empty.count() == 0 and records.read(empty, f"file://{tmp_path}/e").count() == 0


def test_records_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    want, n = [], 0
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect()):
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        want.append((r.doc_id, n, len(ids), brute.crc(ids)))
        n += len(ids)
    assert sorted(map(tuple, records.op6(spark, SF).collect())) == want
