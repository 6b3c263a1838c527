"""Secret scans: fixed patterns, and values of credential contexts by their guess cost.

The guess cost of a value is the least number of bits over all ways to cut it into words,
dates, repeats of what stood in it before, keyboard walks and brute-force characters, found by
dynamic programming in time that grows linearly with its length. Values as hard to guess as a
generated secret are reported, others are not. Words are ranked: first those that guessers try
first, then those of a tokenizer's vocabulary, if its path is given, in its order.
"""

from __future__ import annotations

import json
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import spread

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
#: Contexts whose values are judged by their cost; their names may end longer ones, after _, -
#: or . or with a capital. The value may stand on the next line.
_GAP = r"[ \t]*+(?:\r?\n[ \t]*+)?"
CONTEXT = re.compile(
    r"""(?:(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pwd|pass(?:phrase|code|word|wd)?|secret|token|(?:(?:api|access|private|secret|auth|encryption|signing)[ _.-]?)++key|auth|authorization|credentials?|connection_?string)["']?"""
    + _GAP + r"[:=]" + _GAP + r"""(?:(?:bearer|basic|token)[ \t]++)?["']?|\bbearer[ \t]++)([^\s"'`<>,;|(){}]+)""",
    re.IGNORECASE | re.ASCII,
)
#: User of a URL; its password goes on to the next @, if nothing comes before that ends a value.
USER = re.compile(r"://[^\s/:@]*:", re.ASCII)
_PASSWORD = re.compile(r"""[^\s"'`<>,;|(){}@]*""", re.ASCII)
#: One of these stands in every text that ASSIGN or CONTEXT can match.
HINTS = ("pwd", "pass", "secret", "token", "key", "auth", "credential", "bearer", "basic", "connection", "://")
#: Bits from which a value counts as a secret.
LEAST_BITS, LEAST_LENGTH = 45.0, 8

# Words that guessers try first, by rank.
WORDS = """password admin secret welcome login master letmein dragon monkey shadow sunshine princess football baseball
iloveyou trustno superman batman hello freedom whatever qazwsx michael jordan hunter summer winter spring autumn
changeme default example sample test testing demo user username guest root system server database backup public
private token value string null none true false undefined placeholder your here enter insert replace todo dummy fake
redacted hidden xxxx config settings environment variable localhost company internal staging production development
client access key api auth basic bearer the and you for love blue green black white orange silver gold star moon
http:// https:// www. .com .org .net oauth""".split()
#: Letters that a word of a vocabulary has at least; shorter ones cost as much as brute force.
LEAST_WORD = 4
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4@310$57!", "aaeiossti")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:(?:19|20)?\d\d)", re.ASCII)


class Words:
    """Ranks of words, and the length of the longest."""

    def __init__(self, words: list[str]):
        self.rank: dict[str, int] = {}
        for word in words:
            self.rank.setdefault(word, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)


COMMON = Words(WORDS)


def vocabulary_words(path: str) -> Words:
    """The common words, then the words that a byte-level vocabulary holds whole, by its order:
    pieces of letters that begin with its mark of a space."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    pieces = (x[1:].lower() for x in sorted(vocabulary, key=vocabulary.get) if x.startswith("\u0120"))
    return Words([*WORDS, *(x for x in pieces if len(x) >= LEAST_WORD and x.isascii() and x.isalpha())])


def _steps() -> set[tuple[str, str]]:
    along = [pair for row in ROWS for pair in zip(row, row[1:])]
    down = [(a, b) for x, y in zip(ROWS[:3], ROWS[1:4]) for k, a in enumerate(x[1:] if x is ROWS[0] else x) for b in y[max(0, k - 1) : k + 1]]
    return {p for a, b in along + down for p in ((a, b), (b, a))}


STEPS = _steps()


def alphabet(value: str) -> int:
    """Size of the alphabet that brute force would have to try."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) and not value.isdigit():
        return 16
    classes = ((r"[0-9]", 10), (r"[a-z]", 26), (r"[A-Z]", 26), (r"[ -/:-@\[-`{-~]", 33), (r"[^\x00-\x7f]", 100))
    return sum(n for pattern, n in classes if re.search(pattern, value)) or 1


#: Bits of a cut between pieces, of a year, of a longer date, of the first key of a walk, of each
#: further one, and of a repeat's length.
CUT, YEAR, DAY, FIRST_KEY, NEXT_KEY, AGAIN = 1.0, 7.0, 15.0, 6.0, 1.0, 2.0
#: Characters of a repeat or walk at least, and of a date at least and at most.
LEAST_PIECE, DATES = 3, (4, 10)


def word_bits(spelled: str, lower: str, plain: str, words: Words) -> float | None:
    """Bits of a word as spelled, in lower case and without digits for letters; None if it is
    no word."""
    rank = words.rank.get(lower)
    if rank:
        cost = math.log2(rank) + 1 + CUT
    elif rank := words.rank.get(plain):
        cost = math.log2(rank) + 3 + CUT
    else:
        return None
    return cost + (0 if spelled.islower() else 1 if spelled.istitle() or spelled.isupper() else len(spelled) / 2)


def repeat_bits(end: int) -> float:
    """Bits of a piece that stood in a value before, by where it ends: its place, and some for
    its length."""
    return CUT + AGAIN + math.log2(end)


def guess_bits(value: str, words: Words = COMMON) -> float:
    """Least bits to guess value; 0 for an empty one. Time grows linearly with its length."""
    n = len(value)
    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(LEET)
    each = math.log2(alphabet(value))
    best = [0.0] + [math.inf] * n
    before = _Before()
    window: deque[int] = deque()  # cuts from which a repeat may come, cheapest first
    walks = (math.inf, math.inf, math.inf)  # a walk's cost after one, two, more characters
    for j in range(n + 1):
        if j:
            char = value[j - 1]
            step = NEXT_KEY if j > 1 and (lower[j - 2], lower[j - 1]) in STEPS else math.inf
            walks = best[j - 1] + CUT + FIRST_KEY, walks[0] + step, min(walks[1], walks[2]) + step
            longest = before.add(char)
            if j >= LEAST_PIECE:
                while window and best[window[-1]] >= best[j - LEAST_PIECE]:
                    window.pop()
                window.append(j - LEAST_PIECE)
            while window and window[0] < j - longest:
                window.popleft()
            again = best[window[0]] + repeat_bits(j) if window else math.inf
            best[j] = min(best[j], best[j - 1] + each, walks[2], again)
        here = best[j]
        for k in range(j + 3, min(n, j + words.longest) + 1):
            if (cost := word_bits(value[j:k], lower[j:k], plain[j:k], words)) is not None:
                best[k] = min(best[k], here + cost)
        if j < n and "0" <= value[j] <= "9":
            for k in range(j + DATES[0], min(n, j + DATES[1]) + 1):
                if DATE.fullmatch(value, j, k):
                    best[k] = min(best[k], here + CUT + (YEAR if k - j == 4 else DAY))
    return best[n]


class _Before:
    """The longest end of what was added so far that also ended earlier; a suffix automaton."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, char: str) -> int:
        state, at = len(self.next), self.last
        self.next.append({})
        self.length.append(self.length[at] + 1)
        self.link.append(0)
        while at >= 0 and char not in self.next[at]:
            self.next[at][char] = state
            at = self.link[at]
        if at >= 0:
            onto = self.next[at][char]
            if self.length[onto] != self.length[at] + 1:
                copy = len(self.next)
                self.next.append(dict(self.next[onto]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[onto])
                while at >= 0 and self.next[at].get(char) == onto:
                    self.next[at][char] = copy
                    at = self.link[at]
                self.link[onto] = onto = copy
            self.link[state] = onto
        self.last = state
        return self.length[self.link[state]]


def passwords(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands between user and @ in URLs; host:port is none. Each
    character is looked at a fixed number of times."""
    out, end = [], -1
    for m in USER.finditer(text):
        start = m.end()
        if start > end:
            end = _PASSWORD.match(text, start).end()
            if text[end : end + 1] == "@":
                out.append((start, start + len(text[start:end].rstrip(".:!?"))))
    return out


def spans(text: str | None, least_bits: float = LEAST_BITS, words: Words = COMMON) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed; null has none.

    The base kinds are whole matches, as they come. `guess` spans are values of credential
    contexts that cost least_bits or more, those in a base span too, and lie in no other one.
    """
    if not text:
        return []
    found = [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    small = text.lower()
    if any(hint in small for hint in HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_LENGTH]
        values = [(start, start + len(m[1].rstrip(".:!?"))) for m in CONTEXT.finditer(text) for start in (m.start(1),)]
        last = 0  # end of the latest span of kind guess
        for start, end in sorted(values + passwords(text)):
            if end - start >= LEAST_LENGTH and start >= last and guess_bits(text[start:end], words) >= least_bits:
                found.append(("guess", start, end))
                last = end
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str | None, found: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """text with every run of overlapping spans replaced by mark."""
    if not found:
        return text
    out, at = [], 0
    for _, start, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", vocabulary: str | None = None) -> DataFrame:
    """(row, spans, redacted): each row of docs as a struct, the secrets in its whole text
    and the text without them. Null and empty texts have no spans; rows repeat as they come;
    an empty table gives no rows; extra columns stay inside row, whatever their names.
    vocabulary: path of a tokenizer, whose words guessers are taken to know."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    words = docs.sparkSession.sparkContext.broadcast(vocabulary_words(vocabulary) if vocabulary else COMMON)

    def run(batches):
        for batch in batches:
            texts = batch.column(0).field(at).to_pylist()
            found = [spans(x, words=words.value) for x in texts]
            listed = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), listed, pa.array([redacted(x, f, mark) for x, f in zip(texts, found)], pa.string())], names=["row", "spans", "redacted"])

    at = docs.columns.index(text_col)
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([read.schema["row"], T.StructField("spans", T._parse_datatype_string(SPAN)), T.StructField("redacted", T.StringType())])
    return spread(read).mapInArrow(run, schema)


def listed(kinds: tuple[str, ...] | None = None) -> str:
    """SQL for `kind:start:end`, comma-joined, of the spans of the kinds, or of all."""
    chosen = f"filter(spans, s -> s.kind in ({', '.join(map(repr, kinds))}))" if kinds else "spans"
    return f"array_join(transform({chosen}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, counts and digest of the base spans, and all spans, of every row."""
    found = scan(docs.select(id_col, text_col), text_col, vocabulary=vocabulary)
    count = lambda kind: F.expr(f"size(filter(spans, s -> s.kind = '{kind}'))").cast("long")
    return found.select(
        F.col("row")[id_col].alias(id_col),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.expr(listed(KINDS[:3])), 256).alias("base_sha256"),
        F.expr(listed()).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", vocabulary: str | None = None) -> DataFrame:
    """docs, all columns and rows, secrets replaced by a mark; length_col, where docs has it,
    follows a changed text."""
    found = scan(docs, text_col, vocabulary=vocabulary)
    changed = F.size("spans") > 0
    new = {text_col: F.col("redacted")}
    if length_col in docs.columns:
        new[length_col] = F.when(changed, F.length("redacted")).otherwise(F.col("row")[length_col]).cast(docs.schema[length_col].dataType)
    return found.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
