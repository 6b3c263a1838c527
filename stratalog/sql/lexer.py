"""Query text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QuerySyntaxError

# Words that can't be names. They are matched in any case.
KEYWORDS = frozenset(
    """select from where group by having order limit as at on and or not is null missing like in between case
    when then else end cast distinct union intersect except all join inner left right outer cross asc desc true false""".split()
)
_TOKEN = re.compile(
    r"""\s+|--[^\n]*
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<string>"[^"]*"|'(?:[^']|'')*')
    |(?P<quoted>`[^`]+`)
    |(?P<word>[A-Za-z0-9_]+)
    |(?P<mark>\|\||<=|>=|<>|!=|[-+*/=<>(),.;\[\]{}:])""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, name, number, string, mark, end
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {text[at]!r} at {at}")
        kind, found = m.lastgroup, m[0]
        if kind == "word":
            word = found.lower()
            out.append(Token("keyword", word, at) if word in KEYWORDS else Token("name", found, at))
        elif kind == "quoted":
            out.append(Token("name", found[1:-1], at))
        elif kind == "string":
            out.append(Token("string", found[1:-1].replace("''", "'") if found[0] == "'" else found[1:-1], at))
        elif kind:
            out.append(Token(kind, found, at))
        at = m.end()
    return [*out, Token("end", "", len(text))]
