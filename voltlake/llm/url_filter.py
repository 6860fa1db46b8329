"""URL filter by allow and block rules for hosts and paths, then by a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in one pass over the url. A term counts where no ASCII letter or
digit stands next to it. One strict term, or several distinct soft ones, blocks: a strict term weighs as much as LIMIT
soft ones. Rules come first: a rule fits its host and all subdomains if the path starts with the rule's, the longest wins.
Rules and terms are lists in code or configuration, sent with the job; MAX_ENTRIES bounds both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from voltlake.llm.common import small_batches

LIMIT = 2
MAX_ENTRIES = 200_000
STRICT = ("adult", "casino", "escort", "gambling", "hentai", "malware", "nude", "phishing", "poker", "porn", "porno", "sex", "slots", "spam", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "banner", "bet", "bets", "bonus", "cheap", "click", "coupon", "dating", "discount", "farm", "free", "jackpot", "keygen", "loan", "loans", "lottery", "pharma", "pills",
        "popup", "promo", "sale", "torrent", "track", "tracker", "tracking", "win", "winner")
#: (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: str | None) -> tuple[str, str]:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, in lower case, and from there to ``?`` or ``#``; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    at = rest.find("/")
    return (rest.translate(_LOWER), "") if at < 0 else (rest[:at].translate(_LOWER), rest[at:])


class Rules:
    """Rules by host; a url is looked up once for each suffix of its host."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((len(rule), len(host), slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = None
        while host:
            for own in self.by_host.get(host, ()):
                if path.startswith(own[2]) and (best is None or own[:2] > best[:2]):
                    best = own
            host = host.partition(".")[2]
        return best[3:] if best else (None, None)


class Vocabulary:
    """Weighted terms; ``count`` gives the distinct strict and soft terms of a url."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term in soft:
            self.automaton.add_word(term.translate(_LOWER), (False, term))
        for term in strict:
            self.automaton.add_word(term.translate(_LOWER), (True, term))
        if len(self.automaton):
            self.automaton.make_automaton()

    def count(self, url: str | None) -> tuple[int, int]:
        if not url or not len(self.automaton):
            return 0, 0
        text, strict, soft = url.translate(_LOWER), set(), set()
        for end, (is_strict, term) in self.automaton.iter(text):
            start = end - len(term) + 1
            if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                (strict if is_strict else soft).add(term)
        return len(strict), len(soft)


OUT = "host string, path string, rule string, verdict string, n_strict long, n_soft long, score double"


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft and score (1 and more blocks) of every row.

    A null or empty url, or one without ``://``, has an empty host and path and no rule; its terms still count. Repeated rows and null ids
    are judged like all others; a long url is read once. An empty table gives none. Other columns are ignored. Of two rules of one length the one with the longer host
    wins, then the first. A term in both lists is strict.
    """
    if len(rules) > MAX_ENTRIES or len(strict) + len(soft) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} rules or terms; keep longer lists as a table and join it by host")
    small_batches(pages.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, words = Rules(rules), Vocabulary(strict, soft)
        kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.float64()]
        for rows in batches:
            out = []
            for url in rows.column("url").to_pylist():
                host, path = host_and_path(url)
                rule, verdict = known.find(host, path)
                n_strict, n_soft = words.count(url)
                score = n_strict + n_soft / limit
                out.append((host, path, rule, verdict or ("block" if score >= 1 else "allow"), n_strict, n_soft, score))
            made = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([rows.column("page_id")] + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)], ["page_id", *(c.split()[0] for c in OUT.split(", "))])

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, " + OUT)


def judge_sql(rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, limit: int = LIMIT) -> str:
    """The same in SQL, a regular expression for every term."""
    upper, lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
    found = lambda terms: " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::bigint" for t in terms)
    longest = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0])))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}')", verdict, rule) for verdict, rule in longest for h, _, p in [rule.partition("/")]]
    case = lambda k, default: "case " + " ".join(f"when {f[0]} then '{f[k]}'" for f in fits) + f" else {default} end"
    return f"""
with u as (select page_id, translate(coalesce(url, ''), {upper}, {lower}) as low, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
r as (select page_id, low, regexp_extract(rest, '^[^?#]*') as rest from u),
h as (select page_id, low, translate(regexp_extract(rest, '^[^/]*'), {upper}, {lower}) as host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path from r),
n as (select *, {found(strict)} as n_strict, {found(soft)} as n_soft from h)
select page_id, host, path, {case(2, 'null')} as rule, {case(1, f"case when n_strict + n_soft / {limit}e0 >= 1 then 'block' else 'allow' end")} as verdict from n"""
