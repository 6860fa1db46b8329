"""The text operators against brute force on small tables with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.llm import (
    components, decontaminate, fingerprints, html_extract, langid, mixing, neardup, quality, suffix_array, suffix_dedup, token_counts, warc)
from voltlake.llm.common import ship, small_batches
from voltlake.session import scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}é" if rng.random() < 0.2 else f"word{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, a shared passage, nulls, ties and a long text."""
    rng = random.Random(5)
    out = []
    passage = words(rng, 90)
    for i in range(60):
        t = words(rng, rng.choice([1, 3, 8, 60, 150, 300]))
        if i % 6 == 0:
            t = f"{t} {passage} {words(rng, 20)}"
        out.append((i, t, ["en", "fr"][i % 2], f"src{i % 3}", len(t)))
    base = words(rng, 200).split()
    for i in range(60, 75):  # near copies of one text
        own = list(base)
        own[rng.randrange(200)] = f"edit{i}"
        out.append((i, " ".join(own), "en", "src0", 0))
    out += [(75, out[3][1], "en", "src0", 0), (76, out[3][1].upper(), "en", None, 0), (77, None, None, None, None), (78, "", "en", "src1", 0), (79, "?! \n", "en", "src1", 4),
            (None, out[10][1], "en", "src9", 1), out[5], out[5], (80, words(rng, 20_000, 50_000), "fr", "src2", 0), (81, "aa" * 900, "en", "src1", 1800), (82, words(rng, 100), "fr", "src0", 0),
            (82, words(rng, 100), "fr", "src0", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship(spark)
    small_batches(spark)
    extra = ["_clash", "n", "c", "tid", "rid", "h", "seg", "key", "label", "n_words", "hit", "copy", "posterior"]
    return spark.createDataFrame(rows, DOC).repartition(5).withColumns({c: F.lit("own") for c in extra})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# suffix arrays and repeated strings


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for trial in range(200):
        t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)), 0)
        if trial % 4 == 0:
            t = np.append(np.tile(t[:-1], 4), 0)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        got = suffix_array.suffix_array(t)
        assert got.tolist() == want
        phi, common = suffix_array.plcp(t.astype(np.uint8).tobytes(), got, np.arange(len(t))[::-1])
        for a, b in zip(want, want[1:]):
            n = 0
            while max(a, b) + n < len(t) - 1 and t[a + n] == t[b + n]:
                n += 1
            assert (phi[b], common[b]) == (a, n)


def test_suffix_array_recurses():
    rng = np.random.default_rng(3)
    t = np.append(rng.integers(1, 90, 500_000), 0)
    sa = suffix_array.suffix_array(t)
    at = rng.integers(0, len(t) - 1, 2000)
    for k in at.tolist():
        assert t[sa[k]: sa[k] + 12].tolist() <= t[sa[k + 1]: sa[k + 1] + 12].tolist()
    assert np.array_equal(np.sort(sa), np.arange(len(t)))


def removed_by_brute_force(rows, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i: i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                gone[i: i + length] = True
        keep = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(keep).hexdigest()))
    return out


def as_set(rows):
    return Counter(map(repr, rows))


@pytest.mark.parametrize("options", [{}, {"hot": 1, "block": 4}, {"gram": 16, "hot": 2}])
def test_repeated_strings(docs, rows, options):
    got = suffix_dedup.repeats(docs, length=100, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert as_set(tuple(r) for r in got) == as_set(removed_by_brute_force(rows, 100))


def passage_words_by_brute_force(rows, words):
    """Words of each text inside strings of ``words`` words (as bytes) that another row has."""
    spans_ = [[m.span() for m in re.finditer(rb"[^\x09-\x0d\x20]+", (r[1] or "").encode())] for r in rows]
    windows = [[(r[1] or "").encode()[a[0]: b[1]] for a, b in zip(s, s[words - 1:])] for r, s in zip(rows, spans_)]
    owners = defaultdict(set)
    for r, own in zip(rows, windows):
        for w in own:
            owners[w].add(r[:2])
    return [(r[0], len({k for i, w in enumerate(own) if len(owners[w]) > 1 for k in range(i, i + words)})) for r, own in zip(rows, windows)]


def removed_passages(rows, length, words):
    """Texts by id without repeated strings of ``length`` bytes (characters they only touch stay) and repeated strings of ``words`` words."""
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    at = [[m.span() for m in re.finditer(rb"[^\x09-\x0d\x20]+", b)] for _, b in data]
    seen = Counter(b[i: i + length] for _, b in data for i in range(len(b) - length + 1))
    again = Counter(b[x[0]: y[1]] for (_, b), s in zip(data, at) for x, y in zip(s, s[words - 1:]))
    out = {}
    for (d, b), s in zip(data, at):
        gone, both = np.zeros(len(b), dtype=bool), np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                gone[i: i + length] = True
        k = 0
        for c in b.decode():  # a character goes if all its bytes do
            n = len(c.encode())
            both[k: k + n] = gone[k: k + n].all()
            k += n
        for x, y in zip(s, s[words - 1:]):
            if again[b[x[0]: y[1]]] > 1:
                both[x[0]: y[1]] = True
        out[d] = bytes(v for v, g in zip(b, both) if not g).decode()
    return out


@pytest.mark.parametrize("options", [{"words": 51}, {"words": 12}, {"words": 3}])
def test_passage_words(docs, rows, options):
    got = suffix_dedup.repeats(docs, length=100, **options).select("doc_id", "n_removed", "n_passage_words").collect()
    want = passage_words_by_brute_force(rows, options["words"])
    assert as_set((r.doc_id, r.n_passage_words) for r in got) == as_set(want) and sum(n > 0 for _, n in want) > 15
    assert as_set((r.doc_id, r.n_removed) for r in got) == as_set((r[0], r[2]) for r in removed_by_brute_force(rows, 100))


@pytest.mark.parametrize("options", [{}, {"hot": 1, "block": 4}])
def test_copies_meet_one_row(spark, options, monkeypatch):
    """What is found of a segment is one row, however many its copies are and however it was found, so that the join with its copies adds none."""
    rng = random.Random(12)
    passage = words(rng, 80)
    texts = [f"{words(rng, 40)} {passage} {words(rng, 40)}" for _ in range(40)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    joined, plain = [], suffix_dedup._runs
    monkeypatch.setattr(suffix_dedup, "_runs", lambda seen, found: joined.append((seen, found)) or plain(seen, found))
    got = suffix_dedup.repeats(docs, length=100, words=12, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert as_set(tuple(r) for r in got) == as_set(removed_by_brute_force(list(enumerate(texts)), 100))
    assert len(joined) == 2
    for seen, found in joined:
        assert found.count() == found.select("h", "seg").distinct().count()
        assert seen.join(found, ["h", "seg"]).count() <= seen.count()


@pytest.mark.parametrize("options", [{}, {"hot": 1, "block": 4}])
def test_repeats_inside_a_text_are_one_row(spark, options, monkeypatch):
    """However often a text holds a segment, it is one row of the joins, and every place of it is still found."""
    rng = random.Random(13)
    texts = [f"{words(rng, 20)} {'ab cd ' * (30 + k)}{words(rng, 20)}" for k in range(12)] + ["ab cd " * 200, "xy " * 150, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    joined, plain = [], suffix_dedup._runs
    monkeypatch.setattr(suffix_dedup, "_runs", lambda seen, found: joined.append((seen, found)) or plain(seen, found))
    got = suffix_dedup.repeats(docs, length=100, words=12, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words").collect()
    want, passages = removed_by_brute_force(list(enumerate(texts)), 100), dict(passage_words_by_brute_force(list(enumerate(texts)), 12))
    assert as_set(tuple(r) for r in got) == as_set((*r, passages[r[0]]) for r in want) and sum(r[2] > 0 for r in want) == 14
    assert len(joined) == 2
    for seen, found in joined:
        assert seen.count() == seen.select("rid", "h", "seg").distinct().count()
        assert seen.join(found, ["h", "seg"]).count() <= 16 * len(texts)  # before: a row for each of the thousands of places


def test_once_a_text():
    rng = np.random.default_rng(5)
    for n in [0, 1, *rng.integers(2, 40, 60)]:
        own, a, b = np.sort(rng.integers(0, 4, n)), rng.integers(0, 3, n), rng.integers(0, 3, n)
        want = defaultdict(list)
        for i in range(n):
            want[own[i], a[i], b[i]].append(i + 7)
        new, more = suffix_dedup._once_a_text(own, (a, b), np.arange(n) + 7)
        assert (new + 7).tolist() == [v[0] for v in want.values()]
        assert more.to_pylist() == [v[1:] or None for v in want.values()]


def test_candidates_of_an_anchor():
    """Strings that occur in two segments of an anchor lie in the stretches that are sorted; segments without any are left out."""
    rng = random.Random(4)
    for length, gram in ((40, 8), (9, 8), (8, 8)):
        left = 0
        for _ in range(60):
            kinds = []
            for _ in range(rng.randrange(2, 6)):
                far, near = sorted((rng.randrange(length - gram + 1), rng.randrange(length - gram + 1)), reverse=True)
                sides = ["".join(rng.choice("xy") * rng.randrange(5, 30) for _ in range(20)) for _ in range(2)]
                kinds.append(((sides[0][-far:] if far else "").encode() + b"a" * gram + sides[1].encode()[: length - near - gram], far))
            starts = [{(a - i, b[i: i + length]) for i in range(len(b) - length + 1)} for b, a in kinds]
            every = Counter(x for own in starts for x in own)
            for (b, a), own, (lo, hi) in zip(kinds, starts, suffix_dedup.shared(kinds, length, gram)):
                again = [a - d for d, x in own if every[d, x] > 1]
                assert all(lo <= i and i + length <= hi for i in again)
                left += lo == hi
        assert left or length < 2 * gram


def test_texts_without_repeats(docs, rows, empty):
    out = suffix_dedup.without_repeats(docs, length=100)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    for d, n, gone, _, _ in removed_by_brute_force(rows, 100):
        assert (d in texts) == (gone < n or n == 0)
    assert texts[77] is None and texts[80] == next(r[1] for r in rows if r[0] == 80)
    assert suffix_dedup.repeats(empty).collect() == []


def test_passages_by_words(spark):
    """A passage of 51 short words goes from every copy; one of 50 in fewer bytes than the search stays."""
    rng = random.Random(8)
    short = " ".join(rng.choice("abcdefghij") for _ in range(51))
    fifty = " ".join(rng.choice("klmnopqrst") for _ in range(50))
    long = " ".join(f"{rng.randrange(10**7)}y" for _ in range(60))
    texts = [f"u{k}é {p} é{k}v" for k, p in enumerate([short, short, fifty, fifty, long, long])] + [short]
    out = {r.doc_id: r.text for r in suffix_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=256, words=51).collect()}
    assert len(short) == 101 and 6 not in out
    assert [out[k].split() for k in (0, 1)] == [[f"u{k}é", f"é{k}v"] for k in (0, 1)]  # below the bytes: whole words
    assert out[4] == "u44v" and [out[k] for k in (2, 3)] == texts[2:4]


# token counts


@pytest.mark.parametrize("block", [64, 4096, 4 << 20])
def test_token_counts(docs, rows, block):
    import base64

    import tiktoken

    with open(token_counts.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = token_counts.token_counts(docs, block=block).collect()
    assert as_set(tuple(r) for r in got) == as_set((r[0], len(enc.encode_ordinary(r[1] or ""))) for r in rows)


def test_token_scan_of_unfinished_files(spark, empty):
    from voltlake.llm.common import open_store

    folder = scratch(spark, "flat")
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    e = token_counts.EOD
    files = {"a.bin": [e, e, 1, 2, 3, 4, 5, e, 6], "b.bin": [7] * 9, "c.bin": [], "d.bin": [1, e]}
    for name, ids in files.items():
        with store.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(np.array(ids, dtype="<u2").tobytes())
    names = spark.createDataFrame([(n,) for n in files], "file string")
    for block in (2, 4, 6, 100):
        got = sorted(map(tuple, token_counts.scan(spark, folder, names, block=block).collect()))
        assert got == [("a.bin", 0, 0), ("a.bin", 1, 0), ("a.bin", 2, 5), ("a.bin", 3, 1), ("b.bin", 0, 9), ("d.bin", 0, 1)], block
    assert token_counts.token_counts(empty).collect() == []


# HTML


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu one</li></ul></nav>
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
%s<aside>side</aside><form><p>mail</p></form><div id="comments"><p>first!</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_an_article():
    body = '<article><header><h1>A &amp; B</h1></header><p>one <b>t</b>wo<br>three\n\n four<p>x &lt; y&nbsp;z<script>var a="</p>";</script><div class="ad">buy</div><p class="share">tweet</p><p>end</article>'
    assert html_extract.main_text(PAGE % body) == "A & B one two three four x < y z end"


def test_main_text_by_line_blocks():
    para = "word " * 30
    body = f"<div><a>short</a></div><br><br><div><p>{para}</p><p>tiny</p><p>{para}</p></div>"
    assert html_extract.main_text(PAGE % body) == f"short {para}tiny {para}".strip()
    assert html_extract.main_text(PAGE % "<div>short</div>") == "short"
    assert html_extract.main_text("<body><div><p>Short.</p></div><nav>menu</nav></body>") == "Short."


@pytest.mark.parametrize("body", [
    '<main class="content has-sidebar"><p>%s</p></main>', '<article class="post tag-social"><p>%s</p></article>', '<article class="post comments-open"><p>%s</p></article>',
    '<div class="content no-sidebar"><p>%s</p></div>', '<div role="main" id="search"><p>%s</p></div>', '<div itemprop="articleBody" class="widget"><p>%s</p></div>',
    '<article><h1 class="page-header">%s</h1></article>', '<article><header class="entry-header"><h1 class="header">%s</h1></header></article>'])
def test_class_words_in_main_text(body):
    para = ("word " * 30).strip()
    assert html_extract.main_text(PAGE % (body % para)) == para


@pytest.mark.parametrize("name", ["sidebar", "site-header", "cookie-notice", "user-comments", "post-comments", "fb_comments", "x y-z-comments-list", "ad_box", "x related-posts", "main-nav", "comments-area"])
def test_class_words_of_asides(name):
    para = ("word " * 30).strip()
    assert html_extract.main_text(PAGE % f'<div class="{name}"><p>menu {para}</p></div><div hidden><main><p>no</p></main></div><main role="search">no</main><div><p>{para}</p></div>') == para


@pytest.mark.parametrize("body", ['<article><section id="search"><p>%s</p></section><p>end.</p></article>', '<div class="alert"><p>%s</p></div><p>end.</p>', '<p class="social">%s</p><p>end.</p>',
                                  '<div class="widget"><div class="post no-comments"><p>%s</p></div><div class="ad">buy</div><p>end.</p></div>'])
def test_names_on_what_holds_the_text(body):
    para = ("word " * 40).strip()
    assert html_extract.main_text(PAGE % (body % para)) == f"{para} end."
    assert html_extract.main_text(PAGE % f'<article><p>{para}</p><section class="alert"><p>{para[:60]}</p></section></article>') == para
    assert html_extract.main_text(PAGE % f'<div class="ad widget"><p>{para}</p></div><div><p>Short.</p></div>') == "Short."


@pytest.mark.parametrize("before", [
    '<p>a</p><svg class="i"/>', '<svg viewBox="0 0 1 1"><path d="M0"/></svg>', '<svg class="i">', '<datalist><option value="x"></datalist>', "<datalist><option>x<option>y</datalist>",
    "<select><option>x<optgroup><option>y</optgroup></select>", "<select><option>x<option>y", "<button>b</button>", "<button>", "<template><p>t</p></template>", "<template>", "<script>var a = '<p>';</script>",
    "<style>p{}</style>", "<textarea><p>t</textarea>", "<title>t</title>", "<iframe><p>t</iframe>", "<noscript><p>t</noscript>"])
def test_dropped_elements_end(before):
    assert html_extract.main_text(f"<body><div hidden>{before}</div><article><p>one</p>{before.replace('<p>a</p>', '')}<p>two</p></article>") == "one two"


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title", "iframe", "noscript"])
def test_raw_text_runs_to_the_end(tag):
    assert html_extract.main_text(f"<article><p>one</p><{tag}>x</article><article>two</article>") == "one"


def test_short_articles_bylines_and_teasers():
    para = ("word " * 30).strip()
    nav = "<nav><li>a</li><li>b</li><li>c</li></nav>"
    assert html_extract.main_text(PAGE % "<div><h2>Fire</h2><p>No one was hurt.</p></div>") == "Fire No one was hurt."
    assert html_extract.main_text(f"{nav}<div>Two words</div>{nav}<div>A longer short text.</div>{nav}") == "A longer short text."
    assert html_extract.main_text(PAGE % f"<div><h1>Headline</h1><p>By A. B.</p><p>1 May</p><p>Rome</p><p>{para}</p></div>") == f"Headline By A. B. 1 May Rome {para}"
    teasers = "<article><p>Read this</p></article><article><p>And that</p></article>"
    assert html_extract.main_text(PAGE % f"<div><p>{para}</p><p>{para}</p></div>{nav}{teasers}") == f"{para} {para}"
    assert html_extract.main_text(PAGE % f"<article><p>{para}</p></article><div><p>elsewhere</p></div>") == para


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 5), (None, "u", "", 5), (2, "u", "<article>x", 5), (2, "u", "<article>x", 5), (3, "v", "<article><p>" + "long " * 200_000, 5)],
                                  "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url, r.text[:9], r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got == {(1, None, "", 0), (None, "u", "", 0), (2, "u", "x", 1), (3, "v", "long long", 999_999)}
    assert html_extract.extract(pages.limit(0)).collect() == []


# mixing


def test_mixing_inverts_the_distribution(docs, rows, empty):
    import math

    weights = {"src0": 0.5, "src2": 0.1, "absent": 0.2}
    at = mixing.rates(docs, weights, 2.0)
    size = defaultdict(int)
    for r in rows:
        size[r[3] if r[3] in ("src0", "src2") else None] += len(r[1] or "")
    total = sum(size.values())
    assert at["src0"] == pytest.approx(0.5 * 2 * total / size["src0"]) and at[None] == pytest.approx(0.4 * 2 * total / size[None])
    got = Counter((r.doc_id, r.text) for r in mixing.mix(docs, weights, 3, 2.0).collect())
    for (d, text), n in Counter((r[0], r[1]) for r in rows).items():
        own = str(d) if d is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"3:{own}".encode()).hexdigest()[:13], 16) / 2**52
        source = next(r[3] for r in rows if (r[0], r[1]) == (d, text))
        lam, k, c = at.get(source, at[None]), 0, 0.0
        while u >= (c := c + math.exp(-lam) * lam**k / math.factorial(k)):
            k += 1
        assert got[(d, text)] == k * n
    assert mixing.mix(empty).collect() == []
    with pytest.raises(ValueError):
        mixing.rates(docs, {"src0": 0.9, "src1": 0.9}, 1.0)


def test_mixing_order_is_global(docs):
    out = mixing.mix(docs)
    assert [c for c in out.columns if c == "copy"] == ["copy"]
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys)


# languages


def test_languages(spark, docs, rows, empty):
    import zlib

    text = {"en": "the house and the garden with this thing", "de": "das haus und der garten mit diesem ding", "fr": "la maison et le jardin avec cette chose"}
    rng = random.Random(1)
    data = [(i, " ".join(rng.choice(text[x].split()) for _ in range(40)), x) for i in range(150) for x in [rng.choice(list(text))]]
    data += [(900, None, "en"), (901, "12 !?", None), (904, "½ ² ³ Ⅷ", None), (902, text["de"] * 3 + " " + text["fr"] * 3, None), (None, text["fr"], None), (903, "дом", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[d].held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    assert all(got[i].lang_pred == x for i, _, x in data[:150])
    assert got[900].lang_pred == got[901].lang_pred == got[904].lang_pred == "und" and got[None].lang_pred == "fr" and got[903].lang_pred in text
    assert set(got[902].proportions) == {"de", "fr"} and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# decontamination


def contaminated_by_brute_force(docs, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k: k + n])].add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w = word.findall(low(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k: k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_words", [30, 200_000])
def test_decontamination(spark, docs, rows, block_words):
    rng = random.Random(8)
    items = [(i, words(rng, 25)) for i in range(12)]
    items += [(20, "Tiny Item"), (21, "one"), (22, None), (23, "?!"), (24, items[0][1][5:]), (24, "other words here"), (None, words(rng, 12)), (25, "a b a b a b a b a b a b a b"), (26, items[1][1])]
    extra = [(1000 + (i or 0), f"{words(rng, 9)} {t} {words(rng, 9)}") for i, t in items if t] + [(2000, "x tiny, ITEM y one and some more that stays"), (2001, "a b a b a b a b a b a b"), (2002, "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in items[2][1]))]
    own = [(r[0], r[1]) for r in rows] + extra
    frame = spark.createDataFrame(own, "doc_id long, text string").repartition(3).withColumn("n_words", F.lit("own"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame, bench, block_words=block_words, texts=False)
    assert as_set(tuple(r) for r in got.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == as_set(contaminated_by_brute_force(own, items, 10))
    clean = decontaminate.clean(frame, bench, block_words=block_words)
    assert clean.columns == frame.columns
    kept = clean.collect()
    again = contaminated_by_brute_force([(r.doc_id, r.text) for r in kept if r.doc_id == 2000], items, 10)
    assert 2002 not in {r.doc_id for r in kept}
    assert [r[2] for r in again] == [0]
    assert {r.text for r in kept if r.doc_id == 77} == {None}
    assert decontaminate.clean(frame, bench.limit(0)).count() == len(own)


# fingerprints


def test_fingerprints(spark, docs, rows, empty):
    got = fingerprints.fingerprints(docs, idf_band=(0.5, 9.0)).collect()
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(f"{x[0]}:{hashlib.md5(x[1].encode()).hexdigest()}".encode()).digest()))
    want = Counter()
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        k = len(t) // 4
        n = sum((r[0], r[1] or "") == (d, t) for r in rows)
        want[(d, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest())] += n
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[3] == by[75] and by[77] == by[78]
    assert np.mean([r.near_edited for r in got if r.n_chars > 300]) > 0.3 > np.mean([r.near_next for r in got if r.doc_id is not None and r.doc_id < 58])
    assert fingerprints.fingerprints(empty).collect() == []
    one = fingerprints.fingerprints(docs.filter("doc_id = 4")).first()
    assert one.near_next == 1.0


def fingerprints_by_brute_force(texts, edited, band):
    """Fingerprint of every text and edited text, and the likeness of two."""
    import math

    import regex
    import xxhash

    h = lambda x, seed=42: xxhash.xxh64_intdigest(x if isinstance(x, bytes) else x.to_bytes(8, "little", signed=True), seed=seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    terms = lambda t: {signed(h(w.encode())) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    df = Counter(x for t in texts for x in terms(t))
    known = {x for x, n in df.items() if n >= 2 and band[0] <= math.log(len(texts) / n) <= band[1]}

    def values(own):
        out = []
        for k in range(fingerprints.SLOTS):
            v = 0
            mine = [x for x in sorted(own) if (x + (1 << 63)) >> 59 == k]
            for x in mine:
                v = signed(h(x, h(v)))
            out.append(f"{v % (1 << 64):016X}"[:8] if mine else "")
        return ",".join(out)

    def one(t):
        own = terms(t) & known
        if not own:
            return "x:" + hashlib.md5(",".join(map(str, sorted(terms(t)))).encode()).hexdigest()
        level = max(0, math.ceil(math.log2(len(own) / fingerprints.SLOTS)))
        thin = lambda n: {x for x in own if ((x % (1 << 64)) >> 40) & ((1 << n) - 1) == 0}
        return f"{level}:{values(thin(level))}/{values(thin(level + 1))}"

    def like(a, b):
        if a == b:
            return 1.0
        if "x" in (a[0], b[0]):
            return 0.0
        by = [{int(f.split(":")[0]) + i: v.split(",") for i, v in enumerate(f.split(":")[1].split("/"))} for f in (a, b)]
        shared = sorted(set(by[0]) & set(by[1]))
        if not shared:
            return 0.0
        at = shared[0]
        pairs = [(u, v) for u, v in zip(by[0][at], by[1][at]) if u or v]
        return sum(u == v for u, v in pairs) / len(pairs) if pairs else 0.0

    return [one(t) for t in texts], [one(t) for t in edited], like


def test_fingerprints_by_brute_force(docs, rows):
    band = (0.5, 9.0)
    got = fingerprints.fingerprints(docs, idf_band=band).collect()
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(f"{x[0]}:{hashlib.md5(x[1].encode()).hexdigest()}".encode()).digest()))
    texts = [t for _, t in order]
    edited = [t[: len(t) - len(t) // 4] + nxt[: len(t) // 4] for t, nxt in zip(texts, texts[1:] + texts[:1])]
    every = [r[1] or "" for r in rows]  # repeated rows count in the frequencies
    all_, more, like = fingerprints_by_brute_force(every, edited, band)
    own = dict(zip(every, all_))
    want = Counter()
    for (d, t), e, nxt in zip(order, more, texts[1:] + texts[:1]):
        want[repr((d, own[t], e, like(own[t], e), like(own[t], own[nxt])))] += sum((r[0], r[1] or "") == (d, t) for r in rows)
    assert as_set((r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == want


def test_own_fingerprints_are_made_once(spark, docs):
    """Texts are looked up twice, as they are and edited; what else needs a fingerprint reads it."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        out = fingerprints.fingerprints(docs, idf_band=(0.5, 9.0))
        out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Final Plan" in plan and plan.count("Generate posexplode") == 2


def test_lexicon_is_counted_by_term(spark):
    """More terms than any table of buckets: once-only terms and too frequent ones stay out, the others are in, whatever else occurs."""
    once = [[f"rare{i}x{j}" for j in range(1500)] for i in range(400)]
    texts = [" ".join([*own, "always", f"twice{i // 2}"]) for i, own in enumerate(once)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.term for r in fingerprints.lexicon(docs, 1.6, 9.2).collect()}
    want = spark.range(200).select(F.xxhash64(F.concat(F.lit("twice"), F.col("id").cast("string"))).alias("h"))
    assert got == {r.h for r in want.collect()}
    # two texts that share their only lexicon term agree, however many once-only terms each has
    both = fingerprints.fingerprints(docs).filter("doc_id in (6, 7)").collect()
    assert both[0].fingerprint == both[1].fingerprint and not both[0].fingerprint.startswith("x:")


# WARC


def test_warc_round_trip(spark):
    import base64

    data = [(5, "http://a/\r\nX: y", "hello"), (3, "u", "hello"), (9, "u", "HELLO"), (4, None, None), (2, "v", ""), (None, "w", "hello"), (7, "z", "é" * 300_000), (7, "z", "é" * 300_000), (8, "q", "a\r\n\r\nb")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("size", F.lit("own")).repartition(3)
    got = warc.archive_and_read(pages).collect()
    first = {"hello": 3, "": 2}
    want = Counter()
    for p, _, h in data:
        h = h or ""
        ref = first.get(h) if h in first and first[h] != p else None
        want[(p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if ref is not None else "response", ref)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    folder = scratch(spark, "warc")
    index = warc.write_archives(pages.select("page_id", "url", "html"), folder)
    some = warc.read_records(index.filter("page_id in (5, 7)"), folder, gap_bytes=0).collect()
    assert sorted((r.page_id, r.url, None if r.payload is None else bytes(r.payload).decode()) for r in some)[1:] == [(7, "z", "é" * 300_000)] * 2
    assert some and {r.url for r in some} == {"http://a/\r\nX: y", "z"}
    assert warc.archive_and_read(pages.limit(0)).collect() == []


def test_ranges_are_joined():
    assert warc.coalesce([(0, 10, "a"), (10, 5, "b"), (40, 5, "c")], 20) == [[(0, 10, "a"), (10, 5, "b")], [(40, 5, "c")]]


# quality


def test_quality(spark, empty):
    rng = random.Random(4)
    good = [words(rng, rng.randrange(5, 80), 300) for _ in range(400)]
    junk = [" ".join(f"{w.upper()}!!" for w in words(rng, 40, 300).split()) for _ in range(120)]
    toxic = [" ".join(w if rng.random() > 0.1 else "scum" for w in words(rng, 40, 300).split()) for _ in range(120)]
    texts = [(t, k) for k, ts in enumerate((good, junk, toxic)) for t in ts]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(9000, None), (9001, ""), (None, good[0]), (1, texts[1][0])], "doc_id long, text string").withColumn("posterior", F.lit("own"))
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, (_, k) in enumerate(texts) if i % 2] + [(None, 0, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    caught = [got[i] for i, (_, k) in enumerate(texts) if k]
    clean = [got[i] for i, (_, k) in enumerate(texts) if not k]
    assert sum(caught) <= 0.06 * len(caught) and sum(clean) >= 0.97 * len(clean)
    assert got[9000] == got[9001] is True
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 400 * 0.95 < kept.count() < 430
    assert quality.classify(empty, labels).collect() == []
    assert quality.accepted(docs, labels.limit(0)).count() == docs.count()


def test_threshold_is_the_kth_largest(spark):
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-3, 4, 3000), np.full(500, 0.25)])
    frame = spark.createDataFrame([(float(x),) for x in keys], "key double").repartition(4)
    for k in (1, 7, 1500, 1700, 3499):
        assert quality.threshold(frame, k, bins=16) == np.sort(keys)[::-1][k - 1]
    assert quality.threshold(frame, 3500) == -np.inf


# near duplicates


def components_by_brute_force(rows, percent):
    sets = []
    for r in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(r[1])) if x]
        sets.append(frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in least[root(i)] if x is not None]
        first = (min(ids) if ids else None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), first, r[0] == first))
    return out


@pytest.mark.parametrize("options", [{}, {"leaf": 10}, {"percent": 80}])
def test_near_duplicates(docs, rows, options):
    got = neardup.near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert as_set(tuple(r) for r in got) == as_set(components_by_brute_force(rows, options.get("percent", 85)))


def test_large_node_without_a_common_centre(spark):
    """A chain of texts, each near the next only, and two families: nodes stay large, yet no link is lost."""
    rng = random.Random(9)
    text, rows_ = words(rng, 300, 10_000).split(), []
    for i in range(40):
        rows_.append((i, " ".join(text)))
        text[(i * 7) % 300] = f"step{i}"
    other = words(rng, 300, 10_000).split()
    for i in range(40, 80):
        own = list(other)
        own[rng.randrange(300)] = f"edit{i}"
        rows_.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows_, "doc_id long, text string")
    for leaf in (10, 45):
        got = neardup.near_duplicates(frame, leaf=leaf).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert as_set(tuple(r) for r in got) == as_set(components_by_brute_force(rows_, 85))


def test_heavy_parts_meet_in_pieces():
    size = np.array([5, 5, 1, 30, 2, 2, 9, 1])
    assert neardup._pieces([0, 2, 4], size, 10) == [[0, 2, 4]] and neardup._pieces([3, 6], size, 10) == [[3, 6]]
    pieces = neardup._pieces(list(range(8)), size, 20)
    assert {(a, b) for p in pieces for a in p for b in p} == {(a, b) for a in range(8) for b in range(8)} and max(size[p].sum() for p in pieces if 3 not in p) <= 20


def test_blocks_let_all_meet(spark):
    frame = spark.createDataFrame([(7, bytes([i]), 30) for i in range(30)], "node long, c binary, size long")
    groups = defaultdict(set)
    for r in neardup._blocks(frame, 8).collect():
        groups[r.g].add(bytes(r.c))
    pairs = {(a, b) for g in groups.values() for a in g for b in g}
    assert len(pairs) == 900


def test_representatives(docs, empty):
    out = neardup.representatives(docs)
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[60] == 1 and not any(ids[i] for i in range(61, 76)) and ids[77] == ids[78] == 1 and ids[None] == 0
    assert neardup.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("rows", [200_000, 9])
def test_components(spark, rows):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 60), (60, 101), (101, 102), (200, 201), (201, 200), (300, 300)]
    links = spark.createDataFrame([(str(a).zfill(3).encode(), str(b).zfill(3).encode()) for a, b in pairs], "a binary, b binary")
    got = {int(bytes(r.node)): int(bytes(r.label)) for r in components.components(links, rows=rows).collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 60, 100: 60, 101: 60, 102: 60, 200: 200, 201: 200}
