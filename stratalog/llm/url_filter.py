"""URL filter: host and path rules first, then a weighted vocabulary by Aho-Corasick.

One automaton holds all terms. It reads the whole URL after `://`, query and fragment too, as
it is written and percent-decoded. A hit counts if no letter or digit stands directly beside it.
One strict term rejects a URL, and so do several distinct soft terms.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Rules (verdict, host, path); they hold for subdomains and longer paths too.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# The vocabulary.
STRICT = """porn porno pornhub xxx xvideos hentai camgirl camgirls escort escorts casino casinos viagra cialis adult
spam phishing malware warez keygen crackz gambling sportsbet pokerstars sexcam milf nsfw""".split()
SOFT = """sex sexy nude naked erotic dating hookup hot teen free cheap discount bonus win winner prize lottery bet bets
betting poker slots jackpot pills pharmacy meds drugs weed vape loan loans payday credit forex crypto click clicks ad
ads adserver banner popup track tracker tracking affiliate promo farm link links seo torrent torrents download crack
serial hack cheat cheats proxy replica weightloss""".split()
LEAST_SOFT = 2


def automaton(strict=STRICT, soft=SOFT):
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def parts(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a URL; both empty without `://`."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    host, mark, after = re.fullmatch(r"([^/?#]*)([/?#]?)(.*)", rest, re.DOTALL).groups()
    lower = host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return lower, re.split(r"[?#]", mark + after, maxsplit=1)[0]


def terms(found, host: str, rest: str) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand alone in a host and what follows it, as
    written or percent-decoded."""
    strict: set[str] = set()
    soft: set[str] = set()
    for whole in {host + rest.lower(), unquote(host + rest).lower()}:
        for end, (kind, term) in found.iter(whole):
            start = end - len(term) + 1
            if (start == 0 or not whole[start - 1].isalnum()) and (end + 1 == len(whole) or not whole[end + 1].isalnum()):
                (strict if kind == "strict" else soft).add(term)
    return strict, soft


def rule_of(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of two as long, the first."""
    fitting = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting, key=lambda x: len(x[0])) if fitting else None


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=tuple(STRICT), soft=tuple(SOFT), least_soft: int = LEAST_SOFT) -> DataFrame:
    """id, host, path, rule, verdict, strict_terms and soft_terms of every row.

    A null URL, or one without `://`, has an empty host and path and is allowed, as no term
    can hit. Of two rules as long the first holds. Rows repeat as they come, an empty table
    gives no rows; other columns are not read. Time grows linearly with a URL's length.
    """

    def run(batches):
        found = automaton(strict, soft)
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                hard, mild = terms(found, host, (url or "").partition("://")[2][len(host) :])
                rule, verdict = rule_of(host, path, rules) or (None, "block" if hard or len(mild) >= least_soft else "allow")
                out.append((host, path, rule, verdict, sorted(hard), sorted(mild)))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=[id_col, "host", "path", "rule", "verdict", "strict_terms", "soft_terms"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(url_col).alias("_url")).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>")
