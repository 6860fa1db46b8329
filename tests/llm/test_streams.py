"""URL filter, prefix trie and periodic runs against brute force, with nulls, ties, repeated rows, long rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_operators import as_set
from voltlake.llm import periodic, prefix_trie, url_filter
from voltlake.llm.common import ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    ship(spark)


# URLs

URLS = [None, "", "no scheme/en/", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://a.www.example.com/en/", "https://x.EXAMPLE.com/en/a", "http://example.com/de/", "http://example.com",
        "http://example.net/es/1", "http://notexample.net/esp", "http://net/fr/x", "http://fr.org/a?b=c://net/fr/", "http://b.org/casino-night", "http://b.org/casinos", "http://b.org/free/a-free",
        "http://b.org/free/cheap", "http://b.org/FREE?bets", "http://cheap_pills.b.org", "http://É.org/éads track", "http://b.org:80/x", "http://com/casino", "http://b.org/" + "free2win/" * 20_000, "x://y#//z/casino", "http://b.org?ads#track"]


def judged_by_brute_force(url):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (low(m[1]), m[2]) if m else ("", "")
    fit = [(len(r), r, v) for v, r in url_filter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    hits = lambda terms: sum(bool(re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", low(url or ""))) for t in terms)
    own = "block" if hits(url_filter.STRICT) or hits(url_filter.SOFT) >= 2 else "allow"
    return (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else own)


def test_urls(spark):
    rows = [(i, u, "own") for i, u in enumerate(URLS)] + [(None, URLS[4], "own"), (3, URLS[4], "own"), (3, URLS[4], "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    assert as_set(tuple(r) for r in got) == as_set((r[0], *judged_by_brute_force(r[1])) for r in rows)
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_rules_and_terms():
    rules = url_filter.Rules([("block", "a.b/"), ("allow", "b/x/y/"), ("block", "b/x/"), ("allow", "B/")])
    assert rules.find("c.a.b", "/x/y/z") == ("b/x/y/", "allow") and rules.find("a.b", "/q") == ("a.b/", "block") and rules.find("b", "") == (None, None) and rules.find("", "/") == (None, None)
    words = url_filter.Vocabulary(["bad", "bad-word"], ["soft", "bad"])
    assert words.count("bad-word.SOFT.soft") == (2, 1) and words.count("badly/asoft/soft1") == (0, 0) and url_filter.Vocabulary([], []).count("x") == (0, 0)


# prefix trie


def trie_by_brute_force(rows, group=20, prefixes=4):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()).encode()).hexdigest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0), tie, role, text))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % prefixes
        base = abs(c) // group * group * (1 if c >= 0 else -1)
        made[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
        ends.setdefault(t, []).append(c)
    kids, total = Counter(n[:-1] for n in members if n), {}
    for n in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        leaves, saved = total.pop(("sum", n), (0, 0))
        leaves, saved = leaves or 1, saved + (len(members[n]) - 1) * words
        total[n] = (leaves, saved)
        if n:
            a, b = total.get(("sum", n[:-1]), (0, 0))
            total["sum", n[:-1]] = (a + leaves, b + saved)
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], *total[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items()]


@pytest.fixture(scope="module")
def turns():
    """Conversations that share first turns, copies of one, a long one, one with null and repeated turns, ids without their base."""
    rng = random.Random(4)
    rows = []
    for c in [*range(-45, 90), 10**12 + 3]:
        if c in (20, -20):
            continue
        n = 300 if c == 33 else rng.choice([1, 2, 2, 3, 5])
        for t in range(n):
            text = "hot first" if t == 0 and c % 3 else f"turn {rng.randrange(3)}  é\n" if t < 4 else f"own {t}"
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 1 else "user", text))
    rows += [(c, t, "user", "the same") for c in range(200, 260) for t in range(4)]
    return rows + [(7, None, None, None), (7, None, "user", None), (7, 1, "user", "tie"), (7, 1, "user", "a tie"), (8, 0, "user", "again"), (8, 0, "user", "again"), (None, 1, "user", "x"), (9, 5, "user", "word " * 50_000)]


@pytest.mark.parametrize("options", [{}, {"shards": 40, "held": 2}, {"shards": 10, "held": 5}, {"shards": 2}])
def test_trie(spark, turns, options):
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("node", "parent", "depth", "i", "h", "words")}).repartition(4)
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame, **options).collect()]
    want = trie_by_brute_force(turns)
    assert as_set(got) == as_set(want) and len(want) > 300


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(frame).collect() == [] and prefix_trie.prefix_trie(frame.limit(0)).collect() == []


def test_trie_query(spark):
    rows = duckdb.connect().execute(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert as_set(tuple(r) for r in entry.queries()["op12_prefix_trie"](spark, SF).collect()) == as_set(trie_by_brute_force(rows))


@pytest.mark.parametrize("held", [2, 3, 50, 10_000])
def test_spilling_queue(held):
    rng = random.Random(held)
    queue, want, got = prefix_trie.SpillQueue(held), [], []
    for k in range(6000):
        item = (rng.randrange(500), bytes([rng.randrange(256)]), k)
        queue.push(item)
        want.append(item)
        if rng.random() < 0.3:
            want.sort()
            assert queue.least() == want[0] and queue.pop() == want.pop(0)
    while queue.least():
        got.append(queue.pop())
    assert got == sorted(want) and len(queue.heap) == 0


# periodic runs


def runs_by_brute_force(w, times=4, least=6):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - a
            own = w[a: a + n]
            if i > a and n >= max(least, times * q) and not any(own[p:] == own[: n - p] for p in range(1, q)):
                out.append((a, n, q))
            i = max(i, a + 1)
    return sorted(out)


def periodic_by_brute_force(doc_id, text, planted=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if planted and doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_by_brute_force(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    keep = [x for i, x in enumerate(w) if not any(a + q <= i < a + n for a, n, q in runs)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(keep)))


def periodic_lists(rng):
    for _ in range(rng.randrange(1, 7)):
        k = rng.choice([1, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            q = rng.randrange(1, 14)
            unit, at = [rng.randrange(k) for _ in range(q)], rng.randrange(len(w) + 1)
            w = w[:at] + [unit[i % q] for i in range(rng.randrange(0, 7 * q))] + w[at:]
        yield w


@pytest.mark.parametrize("piece", [1, 7, 33, 1 << 17])
def test_runs(piece):
    """The same runs whether words come one by one or all at once."""
    rng = random.Random(piece)
    for _ in range(250):
        texts = list(periodic_lists(rng))
        assert periodic.runs_of(texts, piece=piece) == [runs_by_brute_force(w) for w in texts]


def test_long_runs():
    n = 100_000
    assert periodic.runs_of([[1] * n, [i % 999 for i in range(n)], list(range(n))], piece=10_000) == [[(0, n, 1)], [(0, n, 999)], []]


def test_periodic_documents(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{x}é" for x in w) for _ in range(60) for w in periodic_lists(rng)]
    rows = [(i, t, "own") for i, t in enumerate(texts)] + [(900, None, "own"), (901, "", "own"), (902, " \x0b\t\n", "own"), (None, "a b " * 9, "own"), (903, "x\u00a0y " * 8, "own"), (904, "a  b\n" * 40_000, "own"), (5, texts[5], "own"), (5, texts[5], "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = periodic.periodic_runs(docs, planted=True, texts=False).drop("clean_text").collect()
    want = [periodic_by_brute_force(*r[:2]) for r in rows if r[0] != 904]
    assert as_set(tuple(r) for r in got if r.doc_id != 904) == as_set(want) and sum(w[1] for w in want) > 100
    one = next(r for r in periodic.periodic_runs(docs).collect() if r.doc_id == 904)
    assert (one.n_runs, one.start, one.length, one.period, one.exponent_milli, one.clean_text) == (1, 0, 80_000, 2, 40_000_000, "a b")
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_periodic_query(spark):
    rows = duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet' where length(text) < 6000").fetchall()
    ids = {r[0] for r in rows}
    got = [tuple(r) for r in entry.queries()["op13_periodic_runs"](spark, SF).collect()]
    assert as_set(r for r in got if r[0] in ids) == as_set(periodic_by_brute_force(*r) for r in rows)
