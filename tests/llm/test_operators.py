"""The operators on DataFrames: odd rows, empty tables, clashing columns; and results."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import chat_pairs, common, decontaminate, html_extract, langid, license_scan, packing, quality, secrets, simhash, url_filter

from stratalog.llm.common import join_hot

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, row string, id string, w string"
TEXTS = [
    "the quick brown fox jumps over the lazy dog near the river bank today",
    "der schnelle braune fuchs springt über den faulen hund am flussufer heute",
    "le renard brun rapide saute par dessus le chien paresseux près de la rivière",
    None,
    "",
    " \n\t ",
    "1234 5678 !!",
    "token = abcdefgh1234 and more words to come after this one for sure",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t and t.startswith("the") else "de" if t and t.startswith("der") else None, "r", "i", "w") for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, "a row without an id", "en", None, None, None), (50, "long " * 60_000, "en", "r", "i", "w")]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, id_col="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[id_col], []).append(r)
    return out


# -- SimHash -----------------------------------------------------------------------------------


def brute(texts):
    """doc -> least doc reachable."""
    prints = {d: simhash.fingerprint(t) for d, t in texts.items()}
    of = {d: d for d in texts}

    def find(d):
        while of[d] != d:
            d = of[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)  # hot runs then meet chunk by chunk
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for g in range(25):
        base = list(rng.choice(words, 120))
        for k in range(12 if g else 150):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(0, 120))] = str(rng.choice(words))
            texts[len(texts)] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    want = brute(texts)
    assert found == want and len(set(want.values())) < len(texts) / 2
    monkeypatch.setattr(simhash, "blocks_to_agree", lambda n, bits: 3)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want


def test_near_duplicates_of_odd_rows(docs, nothing):
    found = by_id(simhash.near_duplicates(docs))
    assert len(found[0]) == 3 and {r.component_id for r in found[0]} == {0}
    assert {found[k][0].component_id for k in (3, 4, 5)} == {3} and found[3][0].fp == 0
    assert found[None][0].component_id is None
    assert simhash.near_duplicates(nothing).count() == 0
    kept = by_id(simhash.keep_one(docs))
    assert len(kept[0]) == 1 and len(kept[None]) == 1 and 4 not in kept and 5 not in kept and kept[3][0]["row"] == "r"
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(nothing).count() == 0


def test_keep_one_with_clashing_columns_and_repeats(spark):
    schema = "doc_id long, text string, text_key long, _text_key string, id long, component_id long, fp long, root long"
    rows = [(1, "a b c d e", 9, "k", 5, 6, 7, 8)] * 3 + [(2, "a b c d e", 9, "k", 5, 6, 7, 8), (3, "other words stand here", 1, "k", 5, 6, 7, 8), (4, None, 1, "k", 5, 6, 7, 8), (4, None, 1, "k", 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, schema)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert sorted(r.id for r in simhash.keep_one(docs.drop("doc_id"), "id").collect()) == [5, 5, 5]  # one id, three texts


def test_one_giant_component_is_no_hot_key(spark):
    """A chain of neighbours that all tasks hold parts of: one component of a third of all rows."""
    chain = [(1 << 40) - 1 << 4 & ~((1 << k) - 1) for k in range(44)]
    texts = [(i, f"word{i} alone here now") for i in range(60)]
    prints = spark.createDataFrame([(k, x) for k, x in enumerate(chain)], "id long, fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(prints)).collect()}
    assert len(set(found.values())) == 1 and len(found) >= len(set(chain)) - 1
    copies = [(100 + i, "the same text again and again") for i in range(400)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(texts + copies, "doc_id long, text string")).collect()}
    assert got == brute(dict(texts + copies))


def test_rows_to_drop_beyond_a_broadcast(spark, docs, monkeypatch):
    """More rows to drop than one broadcast holds are dropped by a shuffled join, nulls alike."""
    bench = spark.createDataFrame([(1, "brown fox jumps over"), (2, "row without an id")], "item_id long, text string")
    narrow = [simhash.keep_one(docs), decontaminate.remove_documents(docs, bench)]
    spans = decontaminate.remove_spans(docs, bench)
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = [simhash.keep_one(docs), decontaminate.remove_documents(docs, bench)]
        for a, b in zip(narrow, wide):
            assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()
            plan = b._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and 0 < a.count() < docs.count()
        assert sorted(map(str, spans.collect())) == sorted(map(str, decontaminate.remove_spans(docs, bench).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert None not in by_id(narrow[1]) and 0 not in by_id(narrow[1])


def test_hot_keys_are_joined_where_they_lie(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 7, id) as k", "id as x")
    facts = spark.range(1000).selectExpr("id as k", "id * 2 as y").where("k <> 5")
    for how in ("inner", "left"):
        found = join_hot(rows, facts, "k", how)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, rows.join(facts, "k", how).collect()), key=str)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan


def test_components_of_a_long_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (7, 6)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {i: 0 for i in range(1, n + 1)}


# -- packing -----------------------------------------------------------------------------------


def test_packing_round_trip(docs, nothing):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    found = packing.pack(docs, BPE, window=3).collect()
    want = Counter((i, t) for r in docs.collect() for i, t in [(r.doc_id, r.text)])
    ids = {k: plain.encode(k[1] or "", add_special_tokens=False).ids + [0] for k in want}
    pieces = Counter()
    for r in found:
        whole = [x for k, x in ids.items() if k[0] == r.doc_id]
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in whole)
        pieces[r.doc_id] += r.length
    assert pieces == Counter({k[0]: 0 for k in want}) + Counter({k[0]: len(ids[k]) * n for k, n in want.items()})
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024
    assert packing.pack(nothing, BPE).count() == 0
    assert {r["row"] for r in packing.pack(docs, BPE, extra=("row",)).collect()} == {"r", None}


# -- decontamination -----------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_judge(text, items):
    w, hit, names = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for win in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) == win]
            hit |= {i + k for i in at for k in range(n)}
            names |= {str(item)} if at else set()
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark, docs, nothing):
    passage = "One two three four five six seven eight nine ten eleven twelve ÉTÉ"
    items = [(1, passage), (2, "short Item"), (10, "short item"), (3, None), (4, " !? "), (5, "solo"), (None, "no id here at all")]
    texts = ["x " + passage.upper() + " y", passage[4:], "a short, item; and solo short item", "nothing here", None, "", passage * 2, "one two three four five six seven eight nine", "no id here at all", "solo " * 30_000, "été ÉTÉ straße"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], "x", "y"), (None, "solo", "x", "y")], "doc_id long, text string, item string, win string")
    found = by_id(decontaminate.judge(df, bench))
    assert len(found[0]) == 2 and found[None][0].contaminated
    named = [(i, t) for i, t in items if i is not None]
    for i, t in enumerate(texts):
        for r in found[i]:
            got = (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
            want = slow_judge(t, items if t != "no id here at all" else [])
            assert got == (slow_judge(t, named) if t != "no id here at all" else (5, 5, 0, want[3], True))
    kept = decontaminate.remove_documents(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7, 10]
    spans = {r.doc_id: r.text for r in decontaminate.remove_spans(df, bench).collect()}
    assert spans[0] == "x y" and spans[3] == "nothing here" and spans[4] is None
    assert decontaminate.judge(nothing, bench).count() == 0
    assert {r.contaminated for r in decontaminate.judge(df, bench.limit(0)).collect()} == {False}


@pytest.mark.parametrize("keys,windows", [(7, 0), (7, 300_000), (10**6, 0)])
def test_decontamination_of_a_large_benchmark(spark, monkeypatch, keys, windows):
    """More windows than one broadcast holds: several passes, and verification by a shuffled
    join; a passage that most documents hold is a hot key there."""
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_KEYS", keys)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", windows)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(vocabulary, 14))
    items = [(1, passage), (2, "short item"), (None, "no id")] + [(10 + i, " ".join(rng.choice(vocabulary, int(rng.integers(8, 16))))) for i in range(12)]
    texts = [(i, " ".join(rng.choice(vocabulary, 30)) + (" " + passage if i % 3 else "")) for i in range(60)] + [(70, items[5][1] + " short item"), (71, None), (72, "")]
    texts += texts[:5]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        judged = decontaminate.judge(df, bench)
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("LeftSemi") >= (4 if keys == 7 and windows else 1) or not windows
        assert ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan) == (not windows)
        found = by_id(judged)
        left = {r.doc_id for r in decontaminate.remove_documents(df, bench).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    named = [(i, t) for i, t in items if i is not None]
    for i, t in texts:
        want = slow_judge(t, named)
        assert len(found[i]) == sum(x == i for x, _ in texts)
        assert {(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found[i]} == {want}
    assert left == {i for i, t in texts if not slow_judge(t, named)[4]}


# -- the others ------------------------------------------------------------------------------------


def test_language_id(spark, docs, nothing):
    found = by_id(langid.identify(docs))
    assert len(found[0]) == 3 and all(found[k][0].lang_pred == "und" and found[k][0].score == 0 for k in (3, 4, 5, 6))
    assert found[0][0].held_out == (zlib.crc32(b"0") % 5 == 0) and found[None][0].held_out is True
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for x in found.values() for r in x)
    assert langid.identify(nothing).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_keep_languages(spark, docs, nothing):
    words = {"en": "the and of house water thing", "de": "und der haus wasser ding nicht", "fr": "le et maison eau chose pas"}
    rng = np.random.default_rng(3)
    rows = [(100 + i, " ".join(rng.choice(words[lang].split(), 12)), lang if i % 5 else None, "s", lang, 0.0) for i, lang in enumerate(list(words) * 40)]
    rows += [(1, None, "en", "s", None, 0.0), (2, "", "en", "s", None, 0.0), (3, "12 !", "en", "s", None, 0.0), (4, "Жизнь прекрасна", None, "s", None, 0.0), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, lang_pred string, score double")
    kept = langid.keep_languages(df)
    found = by_id(kept)
    assert kept.columns == df.columns and not {1, 2, 3} & set(found) and len(found[100]) == 3
    assert all(found[i][0].lang == lang for i, _, _, _, lang, _ in rows if i >= 100)  # where it was null as well
    assert {r.lang for r in langid.keep_languages(df, ("de",)).collect()} == {"de"}
    english = langid.fit([("en", *langid.features(t)) for _, t, _, _, lang, _ in rows if lang == "en"] + [("de", *langid.features(t)) for _, t, _, _, lang, _ in rows if lang == "fr"])
    assert {r.lang_pred for r in langid.keep_languages(df, ("de",), model=english).where("doc_id >= 100").collect()} != {"de"}  # another model keeps others
    assert langid.keep_languages(df, least_score=1.01).count() == 0
    unlabelled = langid.keep_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert not {3, 4, 5, 6} & set(by_id(unlabelled)) and {0, 1, 2, 7, 50} <= set(by_id(unlabelled)) and unlabelled.columns == docs.columns
    assert langid.keep_languages(nothing).columns == nothing.columns and langid.keep_languages(nothing).count() == 0


def test_language_id_learns_nothing_from_held_out_rows(spark):
    rows = [(i, "the house and the river" if i % 2 else "das haus und der fluss", "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    swapped = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("fr")).otherwise(F.col("lang")))
    first, second = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(x).collect()} for x in (df, swapped))
    assert first == second and all(first[i][0] == lang for i, _, lang in rows)


def test_secret_scan(docs, nothing):
    found = by_id(secrets.report(docs))
    assert (found[7][0].n_assign, found[7][0].spans, len(found[0])) == (1, "assign:0:20", 3)
    assert found[7][0].base_sha256 == hashlib.sha256(b"assign:0:20").hexdigest() and found[3][0].spans == ""
    out = secrets.redact(docs)
    assert out.columns == docs.columns and by_id(out)[7][0].text.startswith("[SECRET] and") and by_id(out)[3][0].text is None
    assert secrets.redact(docs.withColumn("n_chars", F.length("text"))).where("doc_id = 7").first().n_chars == len(TEXTS[7]) - 12
    assert secrets.report(nothing).count() == 0 and secrets.redact(nothing).count() == 0


def test_quality(docs, nothing):
    found = by_id(quality.judge(docs))
    assert found[3][0].base_failed and not found[3][0].kept and found[3][0].n_words == 0
    assert found[50][0].n_words == 60_000 and found[50][0].n_repeat_words == 60_000 and found[50][0].base_failed and len(found[0]) == 3
    good = "\n".join(f"Line{i} tells{i} of{i} river{i} number{i} and{i} boats{i}." for i in range(12))
    bad = good + "\n" + "\n".join(f"Menu{i} | Item{i} | Page{i} | Home{i} | Shop{i} | Cart{i} | Help{i}" for i in range(40))
    spark = docs.sparkSession
    found = by_id(quality.judge(spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")))
    assert found[1][0].kept and not found[2][0].kept and not found[2][0].base_failed and found[2][0].cleaned == good
    assert quality.judge(nothing).count() == 0


def test_url_filter(spark):
    rows = [(1, "http://a.cheap-pills.net/"), (2, None), (3, "no url"), (4, "https://WWW.x.org/es/"), (5, "http://spam.net/"), (5, "http://spam.net/"), (6, "http://x.com/de/1"), (7, "http://free.net/a")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    found = by_id(url_filter.judge(df), "page_id")
    assert {k: (v[0].rule, v[0].verdict) for k, v in found.items()} == {1: (None, "block"), 2: (None, "allow"), 3: (None, "allow"), 4: ("org/", "allow"), 5: (None, "block"), 6: ("com/de/", "block"), 7: (None, "allow")}
    assert len(found[5]) == 2 and found[2][0].host == "" and url_filter.judge(df.limit(0)).count() == 0


def test_long_urls_and_ordinary_words(spark):
    """A URL is read to its end; words that only hold a term are none of it."""
    long = "http://x.net/" + "a/" * 200_000
    plain = ["http://essex.net/winter/adults-only-not", "http://x.net/freedom/downloads", "http://www.museum.edu/exhibition?q=hackathon", "http://shop.de/winner-takes", "http://x.net/free/reading"]
    urls = [long + "casino", long, long + "?q=free&r=bonus", *plain]
    found = by_id(url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    assert [found[i][0].verdict for i in range(3)] == ["block", "allow", "block"] and {found[i][0].verdict for i in range(3, 8)} == {"allow"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_terms_after_the_path(spark):
    urls = ["http://x.net/go?q=casino", "/r?to=free+bonus+poker", "http://x.net/r?to=free+bonus+poker", "http://x.net/#Casino", "http://x.net/a?q=x%20c%61sino", "http://x.net/a%20casino", "http://x.net/a?q=free", "http://x.net/free?q=bonus", "http://a.org/?q=casino"]
    found = by_id(url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    assert [found[i][0].verdict for i in range(9)] == ["block", "allow", "block", "block", "block", "block", "allow", "block", "allow"]
    assert (found[0][0].host, found[0][0].path) == ("x.net", "/go")


def test_license_scan(spark, docs, nothing):
    texts = ["A text.\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.", "Her license plate was dirty.\nShe studied at MIT.", "Licensed under CC BY-NC 4.0.", "Licensed under\nthe Apache\n  License, Version\r\n2.0\n", "Words before.\nLicensed under the Eclipse Public License, version 2.0.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "Released under the MIT License.\nLicensed under the EUPL 1.2.", "the license " + "of words " * 30_000, "Ein Haus mit Garten, mit Hof. Er ist mit der Bahn gekommen", "Die Lage ümit der Stadt"]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)] + [(0, texts[0], "z", 1), (19, None, "z", 1), (None, texts[3], "z", 1)], "doc_id long, text string, hits string, paragraph int")
    found = by_id(license_scan.scan(df))
    assert [found[i][0].families for i in range(11)] == ["apache", "gpl,mit", "", "cc_by_nc", "apache", "unknown", "mit", "mit,unknown", "", "", ""]
    assert len(found[0]) == 2 and {r.n_licenses for r in found[0]} == {1} and found[19][0].license is None and found[None][0].license == "cc_by_nc"
    assert [found[i][0].license for i in (5, 7)] == ["unknown", "mit"] and found[4][0].hits[0].paragraph == 0
    assert license_scan.scan(nothing).count() == 0 and len(by_id(license_scan.scan(docs))[0]) == 3


def test_license_classes_equal_plain_python(spark):
    """The DataFrame functions give each example, and odd mixtures, the class that Python gives."""
    rng = np.random.default_rng(2)
    classes, weights, bias, like, least = license_scan.trained()
    at, w = {g: i for i, g in enumerate(weights)}, np.array(list(weights.values()))
    known = [t for _, t in license_scan.examples()]
    texts = known + ["license " + " ".join(rng.choice(" ".join(known).split(), int(rng.integers(1, 25)))) for _ in range(300)]
    texts = [t for t in texts if any(x in t for x in license_scan.CUES)]
    found = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")))
    for i, t in enumerate(texts):
        name, _, lead = license_scan.judged(t, at, w, np.array(bias), like, least)
        assert (found[i][0].license or "none") == name and (name == "none" or found[i][0].hits[0].lead == lead), t


def test_chat_pairs(spark):
    turn = "conv_id long, turn int, role string, text string, at int"
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "yes", 0), (2, 0, "user", "hi", 0), (2, 1, "assistant", "no", 0), (2, 1, "assistant", "no", 0), (4, 0, "system", None, 0), (None, 0, "user", "x", 0)]
    convs = chat_pairs.conversations(spark.createDataFrame(rows, turn))
    found = {r.id: r for r in chat_pairs.format_pairs(chat_pairs.borrowed_replies(convs)).collect()}
    assert found[1].prompt == "<|im_start|>user\nhi<|im_end|>\n" and found[1].n_prompt_turns == 1
    assert found[1].chosen_text == "<|im_start|>assistant\nyes<|im_end|>\n" and found[1].rejected_text == "<|im_start|>assistant\nno<|im_end|>\n"
    start, end = map(int, found[1].chosen_mask.split(":"))
    assert found[1].chosen_text[start:end] == "yes<|im_end|>"
    assert found[2].rejected_text == "" and found[2].rejected_mask == "" and found[4].chosen_text == "" and sorted(found) == [1, 2, 4]
    assert chat_pairs.conversations(spark.createDataFrame([], turn)).count() == 0


def test_chat_pairs_of_odd_conversations(spark):
    """Ties of turn numbers, gaps of ids, very long and very many turns, null numbers."""
    turn = "conv_id long, turn int, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "first"), (1, 5, "assistant", "x" * 300_000), (7, 1, "assistant", "y")]
    rows += [(20, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(2000)] + [(21, k, "assistant" if k % 2 else "user", f"t{k}" if k < 1999 else "other") for k in range(2000)]
    found = {r.id: r for r in chat_pairs.format_pairs(chat_pairs.borrowed_replies(chat_pairs.conversations(spark.createDataFrame(rows, turn)))).collect()}
    assert found[1].prompt == "".join(f"<|im_start|>{x}<|im_end|>\n" for x in ("system\nfirst", "user\na", "user\nb"))
    start, end = map(int, found[1].chosen_mask.split(":"))
    assert found[1].chosen_text[start:end] == "x" * 300_000 + "<|im_end|>" and found[1].rejected_text == ""  # no conversation 2
    assert found[7].prompt == "" and found[7].n_prompt_turns == 0 and found[20].n_prompt_turns == 1999
    assert (found[20].chosen_text, found[20].rejected_text) == ("<|im_start|>assistant\nt1999<|im_end|>\n", "<|im_start|>assistant\nother<|im_end|>\n")
    same = chat_pairs.conversations(spark.createDataFrame(rows, turn)).selectExpr("id", "turns as chosen", "turns as rejected")
    assert {(r.chosen_text, r.rejected_mask) for r in chat_pairs.format_pairs(same).collect()} == {("", "")}
    mask = chat_pairs.format_pairs(same.withColumn("rejected", F.lit(None).cast("array<struct<role:string,text:string>>"))).where("id = 20").first()
    spans = [tuple(map(int, x.split(":"))) for x in mask.chosen_mask.split(",")]
    assert [mask.chosen_text[a:b] for a, b in spans] == [f"t{k}<|im_end|>" for k in range(1, 2000, 2)]


def test_html_extraction(spark):
    soup = '<div id="menu">Home</div><div class="w"><div class="t"><h1>Head {i}</h1><p>Alpha text {i} that is long enough to matter</p></div><div class="u">Same words</div></div>'
    rows = [(i, f"http://A.com/{i}", soup.format(i=i)) for i in range(6)] + [(9, "http://b.com/", "<article><p>x</p></article>"), (9, "http://b.com/", "<article><p>x</p></article>"), (10, None, None), (11, "http://c.com", "")]
    df = spark.createDataFrame([(*r, "b") for r in rows], "page_id long, url string, html string, body string")
    found = by_id(html_extract.extract(df), "page_id")
    assert found[3][0].text == "Head 3\nAlpha text 3 that is long enough to matter" and found[3][0].host == "a.com" and "(<h1> # </>)" in found[3][0].wrapper
    assert len(found[9]) == 2 and found[9][0].text == "x" and found[10][0].text == "" and found[11][0].text == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_copies_are_no_template(spark):
    """Copies of a page don't make its text constant, on a host of their own or beside others."""
    page = "<body><div><h1>Head</h1><p>Text of the page</p><blockquote>A quote</blockquote></div></body>"
    other = "<body><div><h1>Other {i}</h1><p>Other text {i}</p><h6>Same words</h6></div></body>"
    rows = [(i, f"http://a.com/{i}", page) for i in range(3)] + [(3 + i, f"http://b.com/{i}", page) for i in range(3)] + [(6 + i, f"http://b.com/x{i}", other.format(i=i)) for i in range(3)]
    found = by_id(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert {found[i][0].text for i in range(6)} == {"Head\nText of the page\nA quote"}
    assert found[7][0].text == "Other 1\nOther text 1"


def generated_hosts(seed):
    """Pages of hosts with templates of their own, and the main text of each: blocks that
    differ by page, optional and repeated ones; with and without article; copies of pages."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"word{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    pages = []
    for host in range(8):
        outer = ["article", "div class=post", "main", "section class=x"][host % 4]
        house, slogan, legal = prose(12), prose(3), prose(8)
        menu = "".join(f"<li>{prose(2)}</li>" for _ in range(4))
        for k in range(int(rng.integers(6, 14))):
            text = [f"Title {host} {k} {prose(4)}"]
            body = f"<h1>{text[0]}</h1>"
            if host % 2:
                body = f"<p class=house>{house}</p>" + body  # a constant block where the text is
            for _ in range(int(rng.integers(1, 5))):
                text.append(prose(25))
                body += f"<p>{text[-1]}</p>"
            if rng.random() < 0.5:
                items = [prose(5) for _ in range(int(rng.integers(1, 4)))]
                text += items
                body += "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
            if rng.random() < 0.3:
                text.append(prose(15))
                body += f"<blockquote>{text[-1]}</blockquote>"
            body += f"<h6>{slogan}</h6>"
            page = f"<body><div class=top><ul>{menu}</ul><p>{legal}</p></div><{outer}>{body}</{outer.split()[0]}><div class=end><p>{legal}</p></div></body>"
            pages += [(len(pages) + i, f"http://host{host}.com/{k}-{i}", page, "\n".join(text)) for i in range(3 if k == 2 else 1)]
    return pages


def slow_extract(pages):
    """Wrappers, slots and texts in plain Python over all pages of a host at once."""
    out = {}
    for host in {url_filter.parts(url)[0] for _, url, *_ in pages}:
        own = {i: html_extract.Page(page) for i, url, page, *_ in pages if url_filter.parts(url)[0] == host}
        wrapper = None
        for nodes in sorted({html_extract.dumped(html_extract.folded(p.tree[1])) for p in own.values()}):
            wrapper = json.loads(nodes) if wrapper is None else html_extract.aligned(wrapper, json.loads(nodes))
        matcher, texts, contents, chars = html_extract.Matcher(wrapper), {}, {}, Counter()
        for page in own.values():
            main = [(slot, text) for slot, (_, text, noise, _) in zip(matcher.slots(page), page.blocks) if not noise]
            for slot in {x for x, _ in main}:
                texts.setdefault(slot, set()).add(tuple(t for x, t in main if x == slot))
                contents.setdefault(slot, set()).add(tuple(t for _, t in main))
                chars[slot] += 0 if page.landmark() else sum(len(t) for x, t in main if x == slot)
        slots = [[slot, chars[slot], int(len(texts[slot]) == 1 and len(contents[slot]) >= html_extract.LEAST_PAGES)] for slot in texts]
        rules = html_extract.Rules(json.dumps({"wrapper": wrapper, "slots": slots}))
        out |= {i: html_extract.main_text(page, rules) for i, url, page, *_ in pages if url_filter.parts(url)[0] == host}
    return out


@pytest.mark.parametrize("broadcast", [32_000_000, 0])
def test_html_equals_plain_python_and_the_generators_texts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_extract, "MAX_BROADCAST", broadcast)
    pages = generated_hosts(4)
    df = spark.createDataFrame([x[:3] for x in pages], "page_id long, url string, html string").repartition(5)
    found = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert found == slow_extract(pages) == {i: text for i, _, _, text in pages}


def test_html_without_its_wrapper_says_more(spark, monkeypatch):
    pages = generated_hosts(5)
    df = spark.createDataFrame([x[:3] for x in pages], "page_id long, url string, html string")
    emptied = html_extract.wrappers(df).withColumn("body", F.lit("[]"))
    monkeypatch.setattr(html_extract, "wrappers", lambda *_: emptied)
    found = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert all(len(found[i]) > len(text) for i, _, _, text in pages)


def test_html_two_pages_are_no_template(spark):
    """Two near copies share their title, a third page of its own doesn't make it constant."""
    page = "<body><article><h1>The same title</h1><p>Text {i}</p></article></body>"
    rows = [(i, f"http://a.com/{i}", page.format(i=i % 2)) for i in range(6)]
    found = by_id(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert found[1][0].text == "The same title\nText 1"


def test_html_wrapper_decides_the_text(spark):
    """A constant slot inside <article> goes, whose label path a changing slot shares."""
    form = "<body><article><div><p>Words of the house on every page</p></div><h1>Head {i}</h1><div><p>Text {i}</p>{more}</div></article></body>"
    rows = [(i, f"http://a.com/{i}", form.format(i=i, more=f"<p>More {i}</p>" * (i % 3))) for i in range(6)]
    found = by_id(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert [found[i][0].text for i in range(3)] == ["Head 0\nText 0", "Head 1\nText 1\nMore 1", "Head 2\nText 2\nMore 2\nMore 2"]
