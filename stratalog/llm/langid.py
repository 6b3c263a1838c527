"""Language identification in two steps: family first, then the language within it.

Families are told apart by one-versus-rest linear SVMs, languages of one family by
one-versus-one SVMs, all over hashed letter n-grams of the whole text. The models are fitted
on at most `sample` labelled rows, chosen by a hash of their id; their features, not their
texts, come to the driver. A logistic curve over the training margins gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import spread

FEATURES = 8192
#: Labelled rows that the models are fitted on, at most.
SAMPLE = 3000
UNKNOWN = "und"
# Language codes by family; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "turkic": "tr az uz kk ky tk",
    "uralic": "fi et hu",
    "indic": "hi ur bn mr ne pa gu",
    "semitic": "ar he fa",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and square-rooted shares of 1- to 3-letter sequences; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    counts = np.zeros(FEATURES, np.int64)
    edge = np.uint32(1)
    for at in range(0, len(codes), 1 << 18):  # two letters of overlap keep every sequence
        low = max(0, at - 2)
        part = np.where(is_letter[low : at + (1 << 18)], codes[low : at + (1 << 18)], edge)
        fresh = at - low
        one = part * np.uint32(2654435761)
        two = (part[:-1] * np.uint32(0x85EBCA6B)) ^ (part[1:] * np.uint32(0xC2B2AE35))
        three = two[:-1] * np.uint32(0x27D4EB2F) + part[2:] * np.uint32(0x165667B1)
        word = part != edge
        for grams, own, skip in ((one, word, fresh), (two, word[:-1] | word[1:], max(0, fresh - 1)), (three, word[1:-1] & (word[:-2] | word[2:]), 0)):
            mixed = grams[skip:][own[skip:]]
            counts += np.bincount((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(19), minlength=FEATURES)
    index = np.flatnonzero(counts)
    shares = np.sqrt(counts[index] / counts[index].sum())
    return index, shares.astype(np.float32)


@dataclass
class Model:
    """Weights (features + 1 bias) of each machine, and the slope of its logistic curve."""

    family_of: dict[str, str] = field(default_factory=dict)
    weights: np.ndarray | None = None
    slopes: list[float] = field(default_factory=list)
    families: dict[str, int] = field(default_factory=dict)  # machine of a family against the rest
    pairs: dict[tuple[str, str], int] = field(default_factory=dict)  # of a language against another

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.family_of or (found := features(text)) is None:
            return UNKNOWN, 0.0
        index, shares = found
        margins = shares @ self.weights[index] + self.weights[-1] if self.slopes else ()
        chance = [1 / (1 + np.exp(-np.clip(s * m, -30, 30))) for s, m in zip(self.slopes, margins)]
        names = sorted(set(self.family_of.values()))
        score, family = 1.0, names[0]
        if len(names) > 1:
            score, family = max((chance[k], name) for name, k in self.families.items())
        languages = sorted(x for x, f in self.family_of.items() if f == family)
        votes = dict.fromkeys(languages, 0.0)
        worst = dict.fromkeys(languages, 1.0)
        for (a, b), k in self.pairs.items():
            if a in votes:
                votes[a if margins[k] >= 0 else b] += 1
                worst[a], worst[b] = min(worst[a], chance[k]), min(worst[b], 1 - chance[k])
        best = max(languages, key=lambda x: (votes[x], worst[x]))
        return best, float(score * worst[best])


def machine(rows: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, passes: int = 12, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """A linear SVM by averaged subgradient steps, both sides weighing the same; the slope is
    that of the best logistic curve through the margins."""
    order, w, total, t = np.random.default_rng(7), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), 0
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())) * len(rows)
    sign = np.where(positive, 1.0, -1.0)
    scale = 1.0  # w is scale times the stored vector
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            t += 1
            step = 1 / (penalty * (t + 1 / penalty))
            index, shares = rows[i]
            margin = sign[i] * scale * (shares @ w[index] + w[-1])
            scale *= 1 - step * penalty
            if margin < 1:
                w[index] += step * weight[i] * sign[i] * shares / scale
                w[-1] += step * weight[i] * sign[i] * 0.1 / scale
        total += scale * w
    w = total / passes
    margins = np.array([sign[i] * (x @ w[index] + w[-1]) for i, (index, x) in enumerate(rows)])
    slopes = np.geomspace(0.25, 64, 60)
    loss = [np.log1p(np.exp(-np.clip(s * margins, -30, 30))).mean() for s in slopes]
    return w, float(slopes[int(np.argmin(loss))])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """The model of rows (language, buckets, shares)."""
    languages = np.array([x[0] for x in rows])
    vectors = [(index, shares) for _, index, shares in rows]
    model = Model(family_of={x: _FAMILY_OF.get(x.split("-")[0].lower(), f"only {x}") for x in sorted(set(languages.tolist()))})
    family = np.array([model.family_of[x] for x in languages.tolist()])
    weights = []

    def add(members: np.ndarray, positive: np.ndarray) -> int:
        w, slope = machine([vectors[i] for i in members], positive[members])
        weights.append(w)
        model.slopes.append(slope)
        return len(weights) - 1

    names = sorted(set(family.tolist()))
    if len(names) > 1:
        for name in names:
            model.families[name] = add(np.arange(len(rows)), family == name)
    for name in names:
        own = sorted(x for x, f in model.family_of.items() if f == name)
        for a, b in combinations(own, 2):
            model.pairs[a, b] = add(np.flatnonzero((languages == a) | (languages == b)), languages == a)
    if weights:
        model.weights = np.stack(weights, axis=1).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the id's CRC-32, as text, is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows with a language that are not held out.

    Rows are chosen by a hash of the id over the whole table, of one id by a hash of the text,
    so the same table teaches the same; null, empty and letterless texts teach nothing. Without
    rows the model knows no language.
    """
    pool = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    order = F.xxhash64(F.col("id").cast("string"))
    last = pool.select(order.alias("o")).orderBy("o").limit(sample).agg(F.max("o")).first()[0]  # a bounded top-k
    if last is None:
        return Model()

    def run(batches):
        for batch in batches:
            found = [(o, h, lang, x) for o, h, lang, text in zip(*(c.to_pylist() for c in batch.columns)) if (x := features(text))]
            columns = [[x[0] for x in found], [x[1] for x in found], [x[2] for x in found], [i.astype("<u2").tobytes() for *_, (i, _) in found], [s.tobytes() for *_, (_, s) in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=["o", "h", "lang", "buckets", "shares"])

    chosen = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & (F.xxhash64(F.col(id_col).cast("string")) <= F.lit(last)))
    read = chosen.select(F.xxhash64(F.col(id_col).cast("string")).alias("o"), F.xxhash64(text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = read.mapInArrow(run, "o long, h long, lang string, buckets binary, shares binary").orderBy("o", "h", "lang").limit(sample).collect()
    rows = sorted((r["lang"], r["buckets"], r["shares"]) for r in rows)
    return fit([(lang, np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(s, np.float32)) for lang, b, s in rows])


def predict(docs: DataFrame, model: Model, text_col: str = "text", columns: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """(row, language, score): each row of docs as a struct, with its prediction from the
    whole text. Null, empty and letterless texts are `und` with score 0; ties go to the first
    language in order; rows repeat as they come; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            found = [model.predict(x) for x in batch.column(0).field(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["row", *columns])

    at = docs.columns.index(text_col)
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([read.schema["row"], T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.DoubleType())])
    return spread(read).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score of every row; lang is only learned from.

    Null, empty and letterless texts are `und` with score 0, as all are where no row has a
    language. A null id counts as empty text. Repeated rows come back as often as they came,
    empty tables give no rows; other columns are not read.
    """
    model = learn(docs, id_col, text_col, lang_col)
    found = predict(docs.select(id_col, text_col), model, text_col)
    return found.select(F.col("row")[id_col].alias(id_col), held_out(F.col("row")[id_col]).alias("held_out"), "lang_pred", "score")


#: Score under which a prediction is more likely wrong than right.
LEAST_SCORE = 0.5


def keep_languages(docs: DataFrame, wanted: tuple[str, ...] | None = None, least_score: float = LEAST_SCORE, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs, all columns, whose text is in a wanted language, or in any that the model knows;
    where lang_col is null it gets the prediction.

    Texts without a letter (null and empty ones too) go, and so does a prediction scored under
    least_score. The model is learned from docs if none is given; where no row has a language
    to learn from, every text with a letter stays as it is. Rows repeat as they come; an empty
    table stays empty; columns may have any names.
    """
    model = learn(docs, id_col, text_col, lang_col) if model is None else model
    if not model.family_of:
        return docs.where(docs[text_col].rlike(r"\p{L}"))
    found = predict(docs, model, text_col)
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)
    if wanted is not None:
        good = good & F.col("lang_pred").isin(list(wanted))
    row = F.col("row")
    return found.where(good).select(*[(F.coalesce(row[c], F.col("lang_pred")) if c == lang_col else row[c]).alias(c) for c in docs.columns])
