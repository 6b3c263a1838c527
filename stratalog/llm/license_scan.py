"""License scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a run of lines of which each but the last lacks an end mark, so that a wrapped
notice is judged whole; one is a candidate if it holds a cue. Features are word 1- to 3-grams.
A multinomial logistic regression, fitted at start-up on the built-in notices, on notices of
other licences and on sentences that only sound alike, gives each family, the class `unknown`
and the class of no licence a score. A paragraph reads as a licence if it scores more above no
licence than a first threshold and holds a word pair that only notices hold. It is of the best family if its lead over the other two classes
exceeds a second one and a template of the family confirms it, of whose word pairs it must hold
most, each weighing less the more families use it; else it is `unknown`. Both thresholds are calibrated
on fits that have not seen what they judge: each part of the notices and sentences, in all
frames, is left out once.

Weights are integers, so sums don't depend on their order. All of it is DataFrame functions
within the row: nothing is joined or shuffled.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Notices by family; {v} stands for a version.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2 0", "this file is licensed to you under the apache license version 2 0", "released under the apache software license", "spdx license identifier apache 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache license version 2 0", "apache 2 0 license", "licensed under the apache license"],
    "mit": ["released under the mit license", "licensed under the mit license", "spdx license identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "this project is available under the terms of the mit license", "mit license", "mit licensed", "licensed under mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "bsd": ["licensed under the bsd license", "released under the 3 clause bsd license", "use of this source code is governed by a bsd style license", "spdx license identifier bsd 3 clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following license conditions are met", "bsd license", "bsd 3 clause license", "licensed under bsd"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu gpl version 2 or later", "spdx license identifier gpl 3 0 or later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "released under the gpl v3 license", "gnu general public license", "gpl v2", "gpl v3", "licensed under the gpl"],
    "lgpl": ["licensed under the gnu lesser general public license version 2 1", "released under the lgpl v3 license", "spdx license identifier lgpl 2 1 or later", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license", "lgpl v2 1", "licensed under the lgpl"],
    "agpl": ["licensed under the gnu affero general public license version 3", "released under the agpl v3 license", "spdx license identifier agpl 3 0 only", "under the terms of the gnu affero general public license", "gnu affero general public license", "agpl v3", "licensed under the agpl"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0", "mozilla public license", "licensed under the mpl", "mpl 2 0"],
    "cc_by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "licensed under the creative commons attribution license", "available under a cc by license", "cc by 4 0", "creative commons attribution license"],
    "cc_by_sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "available under the creative commons attribution share alike license", "cc by sa 4 0", "creative commons attribution sharealike"],
    "cc_by_nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "licensed under cc by nc sa 4 0", "available under the creative commons attribution non commercial license", "cc by nc 4 0", "cc by nc sa 4 0", "creative commons attribution noncommercial"],
    "cc_by_nd": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "cc by nd 4 0", "cc by nc nd 4 0", "creative commons attribution noderivatives"],
    "cc0": ["dedicated to the public domain under cc0 1 0", "licensed under cc0 1 0 universal", "released under the creative commons zero license cc0", "this is free and unencumbered software released into the public domain under the unlicense license", "cc0 1 0 universal", "licensed under cc0", "dedicated to the public domain"],
    "proprietary": ["copyright all rights reserved", "all rights reserved no part of this publication may be reproduced without permission of the copyright holder", "proprietary and confidential unauthorized copying is prohibited copyright", "copyright 2020 the authors all rights reserved", "all rights reserved", "proprietary and confidential"],
}
# Notices of licences of no family above.
STRANGERS = """this program is made available under the eclipse public license v 2 0|spdx license identifier epl 2 0
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted isc license
licensed under the isc license|licensed under the eupl version 1 2|licensed under the european union public licence
distributed under the boost software license version 1 0|spdx license identifier bsl 1 0|released under the zlib license
you may distribute under the terms of the artistic license|licensed under the perl artistic license 2 0
the contents of this file are subject to the common development and distribution license|licensed under the cddl
this font software is licensed under the sil open font license version 1 1|released under the microsoft public license ms pl
everyone is permitted to copy and distribute verbatim copies under the wtfpl|licensed under the postgresql license
use of this software is subject to the end user license agreement|licensed under the business source license 1 1
licensed under the server side public license|licensed under the academic free license version 3 0|the open software license 3 0 applies
this data is made available under the open database license|licensed under the upl 1 0|released under the unicode license""".replace("\n", "|").split("|")
#: Sentences with cue words that give no licence.
OTHERS = """you need a driving license to rent a car|her license was suspended last year|the license plate was dirty
the software license costs ten dollars a year|he has a fishing license|a license fee is due in march|our license server is down
the copyright debate goes on in parliament|they talked about copyright law|the apache helicopter landed|apache warriors rode west
apache tribes lived there|she studied at mit in boston|mit students built a robot|professor at mit|the gnu is an antelope
a herd of gnu crossed the river|the public domain is a legal idea|a work of public interest|creative people work in commons
the house of commons voted|mozilla released a new browser|the mozilla team met|a poetic license was taken|the bar lost its license
licensed doctors only|a licensed electrician did the work|licensed products are sold here|fully licensed restaurant with terrace
the general public was not amused|all rights of the workers were reserved for later|reserved seats are in front|cc the manager on that mail
by the way cc me|copyright is hard|what license do you need|permission was granted by the king|the agency granted a license
proprietary data formats are slow|the distribution of wealth|read the license|please choose a license|license renewal takes weeks""".replace("\n", "|").split("|")
# Sentences with the words of notices, but without a licence.
OTHERS += """the software is slow today|this software was written in haste|permission to land was denied|they asked for permission to leave
the goods are sold as is|the car comes with a two year warranty|the warranty on the fridge ran out|redistribution of land is a hard question
she was free of charge after the trial|any person may copy the recipe|the terms of the treaty were harsh|the conditions of the loan are met
the source code is hard to read|a public purpose|the version of the story we heard|attribution of the painting is doubtful|this file is too large
the foundation published a report|distribution of food began in may|the notice on the door said closed|commercial use of the land is planned
the boost to the economy was small|an eclipse of the sun|the artistic director resigned|the common people|he modified the engine
the agreement was signed by both sides|the end user was confused|open data is useful|the server is on the other side of the room
er kommt mit dem bus nach hause|mit der zeit wird alles gut|sie geht mit ihm und mit uns|ein haus mit garten und mit hof|das ist mit und ohne
die stadt mit dem fluss|il est venu avec le mit|cc 12 de agua|le domaine public est grand|la commons du village|der server mit der domain""".replace("\n", "|").split("|")
# Cues, parts of lower-case text of which a candidate holds one; each notice does.
CUES = """licen|copyright|gpl|affero|unencumbered|reserved|proprietary|redistribution|merchantability|cc0|cc by|cc-by|mpl 2|mpl-2|bsd-
wtfpl|eupl|cddl|spdx|commons|public domain|hereby""".replace("\n", "|").split("|")
UNKNOWN, NONE = "unknown", "none"
SCALE = 1000
#: Parts of the notices and sentences, each left out of one fit to calibrate on.
FOLDS = 3
#: Share of left-out sentences that may read as a licence.
MOST_WRONG = 0.02
#: A template confirms a family if a paragraph holds more than this share of its pairs' weight.
CONFIRMED = 0.5
FRAMES = ("{}", "note {}", "{} see the file for details", "as of 2021 {} unless stated otherwise", "it was the best of times and the worst for all of us in that year {} but they had not been there with him or on it by then")


def grams(words: list[str]) -> set[str]:
    """Word 1- to 3-grams."""
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def examples() -> list[tuple[str, str]]:
    """(class, text) of all that the classifier learns from, without frames."""
    out = [(family, t) for family in TEMPLATES for t in TEMPLATES[family]]
    return out + [(UNKNOWN, t) for t in STRANGERS] + [(NONE, t) for t in OTHERS]


def fitted(known: list[tuple[str, str]]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Row of each gram, integer weights and biases by class, fitted on examples in frames."""
    classes = [*TEMPLATES, UNKNOWN, NONE]
    vocabulary = sorted(set().union(*(grams(t.split()) for _, t in known)))
    at = {g: i for i, g in enumerate(vocabulary)}
    rows = [([at[g] for g in sorted(grams(frame.format(t).split())) if g in at], classes.index(k)) for (k, t), frame in product(known, FRAMES)]
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (found, _) in enumerate(rows):
        x[i, found] = 1
    y = np.eye(len(classes), dtype=np.float32)[[k for _, k in rows]]
    share = (1 / y.sum(0))[y.argmax(1)][:, None] * len(rows) / len(classes)  # every class weighs the same
    w, b, v = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32), 0.0
    rate = 20 / x.sum(1).mean()
    for step in range(200):  # full-batch gradient steps with momentum and an L2 penalty
        p = np.exp((z := x @ w + b) - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - y) * share
        v = 0.9 * v - (x.T @ p / len(rows) + 1e-4 * w)
        w += rate * v / (1 + step / 100)
        b -= 0.2 * rate * p.mean(0)
    return at, np.rint(w * SCALE).astype(int), np.rint(b * SCALE).astype(int)


def pairs(text: str) -> set[str]:
    """Neighbouring words of a text in lower case."""
    words = text.split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


#: Weight of a template's word pair: SCALE over the number of families that use it.
WEIGHT = {x: SCALE // sum(any(x in pairs(t) for t in ts) for ts in TEMPLATES.values()) for ts in TEMPLATES.values() for t in ts for x in pairs(t)}


#: Word pairs of notices that no sentence without a licence holds.
TELLING = sorted({x for ts in [*TEMPLATES.values(), STRANGERS] for t in ts for x in pairs(t)} - {x for t in OTHERS for x in pairs(t)})


def weight(found) -> int:
    return sum(WEIGHT[x] for x in found)


def share_held(found: set[str], family: str) -> float:
    """Largest share of the weight of one of a family's templates that word pairs hold."""
    return max(round(weight(found & pairs(t)) / weight(pairs(t)), 6) for t in TEMPLATES[family])


def judged(text: str, at: dict[str, int], w: np.ndarray, b: np.ndarray, like: int, least: int) -> tuple[str, int, int]:
    """(class, score above no licence, lead) of a paragraph in plain Python; the DataFrame
    functions say the same."""
    z = sum((w[at[g]] for g in grams(text.split()) if g in at), b).tolist()
    best, family = max(zip(z, TEMPLATES))
    above, lead = max(best, z[-2]) - z[-1], best - max(z[-2:])
    if above <= like or pairs(text).isdisjoint(TELLING):
        return NONE, above, lead
    return (family if lead > least and share_held(pairs(text), family) > CONFIRMED else UNKNOWN), above, lead


def held_out() -> list[tuple[str, str, dict, np.ndarray, np.ndarray]]:
    """Each example in each frame, with a fit that has not seen the example in any."""
    out = []
    for k in range(FOLDS):
        model = fitted([x for i, x in enumerate(examples()) if i % FOLDS != k])
        out += [(name, frame.format(t), *model) for (name, t), frame in product(examples()[k::FOLDS], FRAMES)]
    return out


@lru_cache(1)
def trained() -> tuple[list[str], dict[str, list[int]], list[int], int, int]:
    """Classes, integer weights of each gram, biases, and the two thresholds: MOST_WRONG of the
    left-out sentences read as a licence; the lead parts the left-out notices of the families
    from those of other licences best, as shares of either."""
    left = [(name, *judged(text, at, w, b, 0, 0)[1:]) for name, text, at, w, b in held_out()]
    above = sorted(x for name, x, _ in left if name == NONE)
    like = max(0, above[int((1 - MOST_WRONG) * len(above))])
    own, strange = ([lead for name, x, lead in left if (name == UNKNOWN) == other and name != NONE and x > like] for other in (False, True))
    parted = lambda least: sum(x > least for x in own) / len(own) - sum(x > least for x in strange) / len(strange)
    least = max(sorted({x for x in strange if x >= 0}), key=parted)
    at, w, b = fitted(examples())
    kept = {g: w[i].tolist() for g, i in at.items() if np.abs(w[i]).max() >= SCALE // 50 or g in TELLING or g in WEIGHT}
    return [*TEMPLATES, UNKNOWN, NONE], kept, b.tolist(), like, least


def cued(text: Column) -> Column:
    """Whether a text holds a cue; looking for each is many times faster than one pattern."""
    return reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in CUES])


#: A line's end that ends no paragraph: without an end mark before it, with text after it.
WRAPPED = r"([^\x09-\x0D\x20.!?:;])[ \t\r]*\n[ \t]*([^\x09-\x0D\x20])"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+", -1), "")


def paragraphs(text: Column) -> Column:
    """A text's paragraphs; two passes, as neighbouring line ends share a character."""
    for _ in range(2):
        text = F.regexp_replace(text, WRAPPED, "$1 $2")
    return F.split(text, "\n", -1)


def _grams(words: Column) -> Column:
    """Word 1- to 3-grams, repeats included; a long one that the end cuts is a shorter one."""
    two = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    three = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.concat(words, two, three)


def classified(paragraph: Column) -> Column:
    """Struct (family, lead, held) of a paragraph that reads as a licence, else null."""
    classes, weights, bias, like, least = trained()
    n = len(TEMPLATES)
    table = F.from_json(F.lit(json.dumps(weights)), "map<string, array<int>>")
    known = F.array(*map(F.lit, sorted(weights)))

    def judge(words: Column) -> Column:
        found = F.array_intersect(_grams(words), known)
        return F.get(F.transform(F.array(found), lambda found: scored(found)), F.lit(0))

    def scored(found: Column) -> Column:
        summed = F.aggregate(found, F.array(*map(F.lit, bias)), lambda z, g: F.zip_with(z, F.element_at(table, g), lambda x, y: x + y))
        return F.get(F.transform(F.array(summed), lambda z: decided(z, found)), F.lit(0))

    def decided(z: Column, found: Column) -> Column:
        families = F.array_max(F.array(*[F.struct(F.get(z, F.lit(k)).alias("score"), F.lit(c).alias("family")) for k, c in enumerate(classes[:n])]))
        return F.get(F.transform(F.array(families), lambda best: named(best, F.get(z, F.lit(n)), F.get(z, F.lit(n + 1)), found)), F.lit(0))

    def named(best: Column, unknown: Column, none: Column, found: Column) -> Column:
        lead, held = best["score"] - F.greatest(unknown, none), _share_held(found, best["family"])
        name = F.when((lead > least) & (held > CONFIRMED), best["family"]).otherwise(F.lit(UNKNOWN))
        telling = F.arrays_overlap(found, F.array(*map(F.lit, TELLING)))
        return F.when((F.greatest(best["score"], unknown) - none > like) & telling, F.struct(name.alias("family"), lead.cast("long").alias("lead"), held.alias("held")))

    return F.get(F.transform(F.array(words_of(paragraph)), judge), F.lit(0))


def _share_held(found: Column, family: Column) -> Column:
    """share_held as a Column."""
    out = F.lit(0.0)
    for name, templates in TEMPLATES.items():
        shares = []
        for t in templates:
            each = sorted(pairs(t))
            shares.append(sum((F.when(F.array_contains(found, x), WEIGHT[x]).otherwise(0) for x in each), F.lit(0)) / weight(each))
        out = F.when(family == name, F.round(F.greatest(*shares), 6)).otherwise(out)
    return out


def licenses(text: Column) -> Column:
    """Array of structs (paragraph, family, lead, held): the paragraphs of a text that read as a
    licence, by position from 0. Null and empty texts have none."""
    numbered = F.transform(paragraphs(text), lambda p, i: F.struct(i.alias("paragraph"), F.lower(p).alias("text")))
    candidates = F.filter(numbered, lambda x: cued(x["text"]))
    hits = F.filter(F.transform(candidates, lambda x: F.struct(x["paragraph"].alias("paragraph"), classified(x["text"]).alias("c"))), lambda x: x["c"].isNotNull())
    return F.transform(hits, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["c"]["family"].alias("family"), x["c"]["lead"].alias("lead"), x["c"]["held"].alias("held")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_licenses, families, license and hits of every row of docs.

    n_licenses: paragraphs that read as a licence; families: the different ones, `unknown`
    included, sorted, joined by a comma, empty if none; license: that of the largest lead, the
    first of two, known families before unknown, else null. Null and empty texts have none.
    Repeated rows come back as often as they came, empty tables give no rows; other columns
    are not read, whatever their names.
    """
    # texts without a cue, nearly all, pass without being cut; a notice's words may be on two lines
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.translate(F.lower(F.col(text_col)), "\n\r\t", "   ").alias("small"))
    none = F.array().cast("array<struct<paragraph:int,family:string,lead:bigint,held:double>>")
    found = read.select(F.col("id").alias(id_col), F.when(cued(F.col("small")), licenses(F.col("text"))).otherwise(none).alias("hits"))
    first = F.expr(f"""array_sort(hits, (a, b) -> case when (a.family = '{UNKNOWN}') <> (b.family = '{UNKNOWN}') then if(a.family = '{UNKNOWN}', 1, -1)
        when a.lead > b.lead then -1 when a.lead < b.lead then 1 else a.paragraph - b.paragraph end)""")
    return found.select(
        id_col,
        F.size("hits").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.expr("transform(hits, h -> h.family)"))), ",").alias("families"),
        F.get(first, F.lit(0))["family"].alias("license"),
        "hits",
    )
