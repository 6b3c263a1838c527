"""Quality rules, line first: bad lines go, then documents that lose too much text go.

Each line is judged by itself for punctuation, navigation, boilerplate, symbols, shouting and
repetition; a repeat of an earlier line goes too. A document is rejected if too small a share
of its words is left, or if it fails the base rules on its whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import spread

SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_END = re.compile(r"""[.!?…:;。！？।؟]["'”’»)\]]*\s*$""")
#: Tokens that stand between the entries of a menu.
SEPARATORS = frozenset("| » › • · > < / :: - – — « ‹ →".split())
# Phrases that mark a line as boilerplate.
BOILERPLATE = """cookie policy|we use cookies|accept cookies|accept all cookies|all rights reserved|terms of use|terms of service
terms and conditions|privacy policy|click here|read more|sign in|sign up|log in|subscribe to our|newsletter|enable javascript
javascript is disabled|lorem ipsum|share this|follow us|powered by|back to top|add to cart|skip to content|leave a comment
posted by|copyright ©|loading...|advertisement""".replace("\n", "|").split("|")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
#: A line that a boilerplate phrase condemns has at most so many words.
BOILERPLATE_WORDS = 25
#: A line without an end mark needs so many words, as a wrapped line of prose has.
UNENDED_WORDS = 10
LEAST_KEPT, LEAST_WORDS, MOST_REPEATED = 0.5, 50, 50


_CODES = bytes(range(128))
_NO_LETTER, _NO_UPPER = bytes(c for c in _CODES if not chr(c).isalpha()), bytes(c for c in _CODES if not chr(c).isupper())


def letters_in(line: str) -> int:
    """Letters of a line; of an ASCII line without a loop."""
    return len(line.encode().translate(None, _NO_LETTER)) if line.isascii() else sum(map(str.isalpha, line))


def capitals_in(line: str) -> int:
    return len(line.encode().translate(None, _NO_UPPER)) if line.isascii() else sum(map(str.isupper, line))


def line_fault(line: str, words: list[str] | None = None) -> str | None:
    """Name of the first rule that a line with words fails."""
    words = _WORD.findall(line) if words is None else words
    n = len(words)
    separators = sum(map(SEPARATORS.__contains__, words))
    if separators >= 2 and 6 * separators >= n or n and separators == n:
        return "navigation"
    if n <= BOILERPLATE_WORDS and _BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 3 and _SYMBOL.search(line) and 10 * sum(1 for w in words if _SYMBOL.search(w)) >= 3 * n:
        return "symbols"
    letters = letters_in(line)
    if 2 * letters < len(line) - line.count(" "):
        return "letters"
    if n >= 5 and capitals_in(line) > 0.7 * letters:
        return "shouting"
    if n >= 12 and 3 * len(set(words)) < n:
        return "repetition"
    if n < UNENDED_WORDS and not _END.search(line):
        return "punctuation"
    return None


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\v\f\r"):
            seen.add(line)
    repeated = 0
    if len(words) >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        hit = np.zeros(len(words), bool)
        at = np.flatnonzero(times[which] >= 2)
        for k in range(3):
            hit[at + k] = True
        repeated = int(hit.sum())
    return len(words), chars, sum(map(text.count, SYMBOLS)), again, repeated


def clean(text: str | None) -> tuple[str, int]:
    """The text without its bad lines, and the words that stay. Empty lines stay."""
    kept, words, seen = [], 0, set()
    for line in (text or "").split("\n"):
        own = _WORD.findall(line)
        if own:
            if line in seen or line_fault(line, own):
                continue
            seen.add(line)
            words += len(own)
        kept.append(line)
    return "\n".join(kept), words


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, base_failed, kept, words_kept and cleaned of every row.

    Null and empty texts have no words, so they fail the base rules. Rows repeat as they
    come; an empty table gives no rows; other columns are not read.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_kept"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in counts] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("cleaned", T.StringType())])

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                n, *rest = base_counts(text or "")
                cleaned, words = clean(text)
                failed = n < LEAST_WORDS or 100 * rest[-1] > MOST_REPEATED * n
                out.append((n, *rest, words, failed, not failed and words >= LEAST_KEPT * n, cleaned))
            columns = list(zip(*out)) or [()] * 9
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=schema.names)

    return spread(docs.select(id_col, F.col(text_col).alias("_text_to_judge"))).mapInArrow(run, schema)
