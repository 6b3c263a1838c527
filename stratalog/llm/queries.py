"""Thin queries over the operators, one each, with their SQL where SQL can say the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_pairs, decontaminate, html_extract, langid, license_scan, packing, quality, secrets, simhash, url_filter
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("hits")


def op5_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat_pairs.conversations(table(spark, sf_dir, "conversations"))
    found = chat_pairs.format_pairs(chat_pairs.borrowed_replies(convs))
    return found.select(
        F.col("id").alias("conv_id"),
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        *["prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask"],
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"), vocabulary=byte_bpe())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


_LAST = f"list_max(list_transform(t, lambda x, i: CASE WHEN x.role = '{chat_pairs.TRAINED}' THEN i ELSE 0 END))"


def _rendered(turns: str) -> str:
    mark = f"'{chat_pairs.HEAD}' || x.role || chr(10) || x.text || '{chat_pairs.TAIL}' || chr(10)"
    return f"array_to_string(list_transform({turns}, lambda x: {mark}), '')"


def _masked(turns: str) -> str:
    head, tail = len(chat_pairs.HEAD) + 1, len(chat_pairs.TAIL) + 1
    each = f"list_transform({turns}, lambda x: length(x.role) + length(x.text) + {head + tail})"
    before = f"list_sum(list_slice({each}, 1, i - 1))"
    span = f"concat(CAST(coalesce({before}, 0) + length(x.role) + {head} AS BIGINT), ':', CAST(coalesce({before}, 0) + length(x.role) + {head} + length(x.text) + {tail - 1} AS BIGINT))"
    return f"coalesce(array_to_string(list_filter(list_transform({turns}, lambda x, i: CASE WHEN x.role = '{chat_pairs.TRAINED}' THEN {span} END), lambda x: x IS NOT NULL), ','), '')"


OP5_SQL = f"""
WITH conv AS (
    SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS t
    FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
),
own AS (SELECT conv_id, t, coalesce({_LAST}, 0) AS at FROM conv),
pair AS (
    SELECT a.conv_id, a.t AS chosen,
           CASE WHEN a.at = 0 THEN a.t WHEN b.conv_id IS NULL THEN list_slice(a.t, 1, a.at - 1)
                ELSE list_concat(list_concat(list_slice(a.t, 1, a.at - 1), [b.t[b.at]]), list_slice(a.t, a.at + 1, len(a.t))) END AS rejected
    FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id + 1 AND b.at > 0
),
prefix AS (
    SELECT *, list_min(list_filter(range(0, least(len(chosen), len(rejected)) + 1),
                                   lambda i: i = least(len(chosen), len(rejected)) OR chosen[i + 1] <> rejected[i + 1])) AS n FROM pair
),
cut AS (SELECT *, list_slice(chosen, 1, n) AS p, list_slice(chosen, n + 1, len(chosen)) AS c, list_slice(rejected, n + 1, len(rejected)) AS r FROM prefix)
SELECT conv_id, CAST(n AS BIGINT) AS n_prompt_turns, {_rendered("p")} AS prompt, {_rendered("c")} AS chosen_text, {_rendered("r")} AS rejected_text,
       {_masked("c")} AS chosen_mask, {_masked("r")} AS rejected_mask
FROM cut
"""


def _rule_sql() -> str:
    fits = [f"(CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN struct_pack(n := {len(h + p)}, rule := '{h + p}', verdict := '{v}') END)" for v, h, p in url_filter.RULES]
    return f"list_sort(list_filter([{', '.join(fits)}], lambda x: x IS NOT NULL), 'DESC')[1]"


def _terms_sql(terms: list[str]) -> str:
    hits = [f"CAST(regexp_matches(place, '(^|[^\\pL\\pN]){t}($|[^\\pL\\pN])') OR regexp_matches(decoded, '(^|[^\\pL\\pN]){t}($|[^\\pL\\pN])') AS INTEGER)" for t in terms]
    return " + ".join(hits)


OP6_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
place AS (
    SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
),
ruled AS (SELECT *, lower(rest) AS place, lower(url_decode(rest)) AS decoded, {_rule_sql()} AS r FROM place)
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN {_terms_sql(url_filter.STRICT)} >= 1 OR {_terms_sql(url_filter.SOFT)} >= {url_filter.LEAST_SOFT} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP7_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
gram AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
),
hit AS (SELECT doc_id, i, n, item FROM gram JOIN win USING (n, g)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {
    f.__name__: f
    for f in (
        *(op1_html_extraction, op2_simhash_neardup, op3_packing, op4_license_scan, op5_chat_preferences),
        *(op6_url_filter, op7_decontamination, op8_quality_rules, op9_secret_scan, op10_language_id),
    )
}


# -- SQL of the line rules and of the licence classifier ------------------------------------------


def _quoted(texts) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in texts)


def _count(pattern: str, what: str) -> str:
    return f"len(regexp_extract_all({what}, '{pattern}'))"


_TOKEN = r"[^\x20\x09-\x0D]+"
_PHRASE = "(?i)" + "|".join(re.escape(x).replace("'", "''") for x in quality.BOILERPLATE)
_ENDED = quality._END.pattern.replace("'", "''").replace(r"\s", r"[\s\x1c-\x1f\x{85}\x{a0}]")

OP8_SQL = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS w FROM documents),
line AS (
    SELECT doc_id, i, x, regexp_extract_all(x, '{_TOKEN}') AS w
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM doc)
),
ranked AS (
    SELECT *, len(w) AS n, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) > 1 AS again, {_count(r"\pL", "x")} AS letters,
           len(list_filter(w, lambda v: v IN ({_quoted(sorted(quality.SEPARATORS))}))) AS bars
    FROM line WHERE len(w) > 0
),
judged AS (
    SELECT doc_id, n, again,
        (bars >= 2 AND 6 * bars >= n) OR bars = n
        OR (n <= {quality.BOILERPLATE_WORDS} AND regexp_matches(x, '{_PHRASE}'))
        OR (n >= 3 AND 10 * len(list_filter(w, lambda v: regexp_matches(v, '[#*$%&|<>]'))) >= 3 * n)
        OR 2 * letters < length(x) - {_count(" ", "x")}
        OR (n >= 5 AND 10 * {_count(r"\p{Lu}", "x")} > 7 * letters)
        OR (n >= 12 AND 3 * len(list_distinct(w)) < n)
        OR (n < {quality.UNENDED_WORDS} AND NOT regexp_matches(x, '{_ENDED}')) AS bad
    FROM ranked
),
lines AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(n) FILTER (NOT again AND NOT bad), 0) AS words_kept FROM judged GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM win) WHERE times >= 2),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counted AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST({_count(r"[#*$%&|<>]", "text")} AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, coalesce(words_kept, 0) AS words_kept
    FROM doc LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) AND words_kept >= {quality.LEAST_KEPT} * n_words AS kept
FROM counted
"""


def op4_sql() -> str:
    """The classifier with its trained weights as a table."""
    classes, weights, bias, like, least = license_scan.trained()
    n = len(license_scan.TEMPLATES)
    rows = ", ".join(f"('{g}', {w})" for g, w in sorted(weights.items()))
    cued, wrapped = lambda what: " OR ".join(f"contains({what}, '{x}')" for x in license_scan.CUES), license_scan.WRAPPED
    sums = ", ".join(f"{b} + CAST(coalesce(sum(w[{k + 1}]), 0) AS BIGINT) AS s{k}" for k, b in enumerate(bias))
    families = ", ".join(f"struct_pack(score := s{k}, family := '{c}')" for k, c in enumerate(classes[:n]))
    templates = ", ".join(f"('{f}', {k}, '{x}', {license_scan.WEIGHT[x]}, {license_scan.weight(license_scan.pairs(t))})" for f, ts in license_scan.TEMPLATES.items() for k, t in enumerate(ts) for x in sorted(license_scan.pairs(t)))
    return f"""
WITH weight AS (SELECT * FROM (VALUES {rows}) AS v(gram, w)),
template AS (SELECT * FROM (VALUES {templates}) AS v(family, k, pair, weight, total)),
whole AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '{wrapped}', '\\1 \\2', 'g'), '{wrapped}', '\\1 \\2', 'g'), chr(10)) AS p FROM documents
          WHERE {cued("translate(lower(text), chr(10) || chr(13) || chr(9), '   ')")}),
line AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM whole),
para AS (SELECT doc_id, i, list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda v: v <> '') AS words FROM line WHERE {cued("lower(x)")}),
sized AS (SELECT doc_id, i, words, unnest([1, 2, 3]) AS n FROM para),
gram AS (
    SELECT DISTINCT doc_id, i, array_to_string(words[k:k + n - 1], ' ') AS gram
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS k FROM sized WHERE len(words) >= n)
),
scored AS (SELECT doc_id, i, {sums} FROM para LEFT JOIN gram USING (doc_id, i) LEFT JOIN weight USING (gram) GROUP BY doc_id, i),
best AS (SELECT doc_id, i, list_max([{families}]) AS b, s{n} AS u, s{n + 1} AS o FROM scored),
held AS (
    SELECT doc_id, i, max(share) AS held FROM (
        SELECT best.doc_id, best.i, k, round(CAST(sum(CASE WHEN gram IS NULL THEN 0 ELSE weight END) AS DOUBLE) / max(total), 6) AS share
        FROM best JOIN template ON template.family = b.family LEFT JOIN gram ON gram.doc_id = best.doc_id AND gram.i = best.i AND gram = pair GROUP BY ALL)
    GROUP BY doc_id, i
),
hit AS (
    SELECT doc_id, i, b.score - greatest(u, o) AS lead, CASE WHEN b.score - greatest(u, o) > {least} AND held > {license_scan.CONFIRMED} THEN b.family ELSE '{license_scan.UNKNOWN}' END AS family
    FROM best JOIN held USING (doc_id, i) SEMI JOIN gram ON gram.doc_id = best.doc_id AND gram.i = best.i AND gram IN ({_quoted(license_scan.TELLING)})
    WHERE greatest(b.score, u) - o > {like}
),
found AS (
    SELECT doc_id, count(*) AS n, string_agg(DISTINCT family, ',' ORDER BY family) AS families,
           arg_max(family, struct_pack(a := family <> '{license_scan.UNKNOWN}', b := lead, c := -i)) AS license
    FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(families, '') AS families, license FROM documents LEFT JOIN found USING (doc_id)
"""


ORACLES = {"op5_chat_preferences": OP5_SQL, "op6_url_filter": OP6_SQL, "op7_decontamination": OP7_SQL, "op8_quality_rules": OP8_SQL}


def oracles() -> dict[str, str]:
    """DuckDB SQL by query; the licence classifier is trained on the way."""
    return ORACLES | {"op4_license_scan": op4_sql()}
