"""License scan: a trained paragraph classifier, confirmed against templates (DataFrame operations only).

A multinomial logistic regression over sparse word n-grams (one to three
words, weights shrunk to zero by an L1 penalty) tells the licence family of a
paragraph, or none. A family is reported if its calibrated probability reaches
the threshold found on held-out rows, and if enough of the n-grams of one of
its templates occur in the paragraph (all of them for a short template), and
no smaller a share than of any other family's; otherwise the paragraph is
unknown.

So a family needs most of a template's n-grams, and without certain words they
can't be there: the anchors, some words of each template, found so that the
n-grams without them are too few. What holds no anchor is no known licence,
and is passed over exactly.

Paragraphs are runs of lines with words. Lines are judged one by one, and so is
what stands around each line break of a run, as many words on each side as the
longest template has, since notices are often wrapped: every template that goes
over a line break lies whole in one of these windows.

The model is fitted on the driver from at most ``ROWS`` rows made from the
templates by a seeded generator, and evaluated as columns. All is a
projection without a shuffle.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exclusive_sums, let

# Sentences of licences and notices as their users word them, by family.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "apache license 2.0", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "released under the apache 2.0 license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "this project is licensed under the terms of the mit license", "mit license", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "licensed under the bsd license", "use of this source code is governed by a bsd style license", "bsd 3 clause license", "bsd 2 clause license", "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "isc license"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu gpl version 2 or later", "licensed under the gpl", "released under the gnu gpl", "you should have received a copy of the gnu general public license along with this program"],
    "lgpl": ["licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license version 2.1", "gnu lgpl license", "you should have received a copy of the gnu lesser general public license along with this library", "licensed under the lgpl"],
    "agpl": ["licensed under the gnu affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu agpl version 3", "licensed under the agpl"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license", "licensed under the mozilla public license version 2.0", "mozilla public license 2.0"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license", "licensed under the eclipse public license version 2.0", "eclipse public license 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software", "released under the unlicense"],
    "cc-by": ["licensed under cc by 4.0", "cc by 4.0 license", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "cc by sa 4.0 license", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "cc by nc 4.0 license", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc0": ["dedicated to the public domain under cc0", "creative commons cc0 1.0 universal license", "no rights reserved public domain"],
    "proprietary": ["all rights reserved", "no part of this work may be reproduced without written permission all rights reserved", "unauthorized copying of this file is prohibited proprietary and confidential", "copyright all rights reserved"],
}
# Identifiers of the SPDX list, by family.
SPDX = {
    "apache-2.0": ["apache 2.0"], "mit": ["mit"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "isc": ["isc"], "gpl": ["gpl 2.0", "gpl 3.0"], "lgpl": ["lgpl 2.1", "lgpl 3.0"], "agpl": ["agpl 3.0"], "mpl": ["mpl 2.0"], "epl": ["epl 2.0"], "unlicense": ["unlicense"],
    "cc-by": ["cc by 4.0"], "cc-by-sa": ["cc by sa 4.0"], "cc-by-nc": ["cc by nc 4.0"], "cc0": ["cc0 1.0"],
}
for _family, _ids in SPDX.items():
    TEMPLATES[_family] += [f"spdx license identifier {i}" for i in _ids]
# Sentences with words of licences that are no licence.
OTHERS = ["he got his driving license last year", "the license plate of the car was lost", "she is a licensed nurse in the city", "the public library is open", "human rights are for everyone", "a table was reserved for two", "they asked for permission to leave", "the apache helicopter landed", "the public domain of politics", "creative people work here", "a copyright dispute went to court", "two seats reserved for guests", "the commons voted on the bill", "a fishing license costs money", "equal rights for women", "permission was granted by the teacher", "the gnu grazes on the plain", "the software is provided to all schools of the city", "this program was published by the foundation for free", "the terms of the agreement were made available to the public", "you may copy the file to any person in the project", "the conditions of the contract are as follows", "they use source code in many forms", "the warranty of the car is limited to two years", "spdx license identifier zlib", "licensed under the zlib license"]
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
ROWS, SEED, PRECISION, NGRAM = 2400, 11, 0.98, 3
#: The share of a template's n-grams that must occur, and words up to which a template is short.
CONTAINED, SHORT = 0.6, 5
_WORD = r"[^a-z0-9.]+"
#: Words on each side of a line break that are judged together, and the mark of a line without a word.
SIDE, BREAK = max(len(t.split()) for ts in TEMPLATES.values() for t in ts), "\0"


def tokens(line: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(_WORD, line.lower())) if w]


def grams(words: list[str]) -> list[str]:
    """The distinct n-grams."""
    return sorted({" ".join(words[i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(words) - n + 1)})


def least_grams(template: str) -> int:
    """How many of a template's n-grams must occur."""
    n = len(grams(template.split()))
    return n if len(template.split()) <= SHORT else -int(-CONTAINED * n // 1)


def anchor_words() -> list[str]:
    """Words of which any text holds one that holds enough n-grams of a template: the longest of each, until what is without them is too little."""
    out: set[str] = set()
    for t in (t for ts in TEMPLATES.values() for t in ts):
        words, every = t.split(), grams(t.split())
        mine: set[str] = set()
        for w in sorted(set(words), key=lambda w: (w not in out, -len(w), w)):
            if sum(not set(g.split()) & mine for g in every) < least_grams(t):
                break
            mine.add(w)
        out |= mine
    return sorted(out)


ANCHORS = anchor_words()


def labelled_rows(n: int = ROWS, seed: int = SEED) -> list[tuple[str, int]]:
    """(line, place in FAMILIES): templates with words lost, added and changed, and lines that are no licence."""
    r = random.Random(seed)
    filler = lambda: "".join(r.choice("abcdefghijklmnoprstuvy") for _ in range(r.randint(2, 9)))
    out = []
    for i in range(n):
        label = i // 2 % (len(FAMILIES) - 1) + 1 if i % 2 else 0
        words = (r.choice(TEMPLATES[FAMILIES[label]]) if label else r.choice([r.choice(OTHERS), " ".join([filler() for _ in range(8)] + r.sample(ANCHORS, 2))])).split()
        if len(words) > 5 and r.random() < 0.3:
            del words[r.randrange(len(words) - 3)]
        if r.random() < 0.5:
            words = [filler() for _ in range(r.randint(1, 4))] + words
        if r.random() < 0.5:
            words += [filler() for _ in range(r.randint(1, 4))]
        out.append((" ".join(words), label))
    return out


class Model:
    """Weights by n-gram and family, a bias, a temperature and the least probability."""

    def __init__(self, rows: list[tuple[str, int]], precision: float = PRECISION, steps: int = 300, rate: float = 2.0, l1: float = 2e-4):
        held = np.arange(len(rows)) // 2 // (len(FAMILIES) - 1) % 3 == 2
        told = [grams(tokens(line)) for line, _ in rows]
        count = Counter(g for gs, h in zip(told, held, strict=True) if not h for g in gs)
        self.vocabulary = sorted(g for g, n in count.items() if n >= 3)
        place = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(rows), len(place)), np.float32)
        for i, gs in enumerate(told):
            x[i, [place[g] for g in gs if g in place]] = 1
        y = np.eye(len(FAMILIES), dtype=np.float32)[[label for _, label in rows]]
        self.w, self.b = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        self.b[0] = 1.0
        seen, truth = x[~held], y[~held]
        for _ in range(steps):
            miss = self.soft(seen @ self.w + self.b) - truth
            self.w -= rate * (seen.T @ miss / len(miss))
            self.w = np.sign(self.w) * np.maximum(np.abs(self.w) - rate * l1, 0)
            self.b -= 0.5 * miss.mean(axis=0)
        some = np.abs(self.w).max(axis=1) > 0
        self.vocabulary, self.w, x = [g for g, k in zip(self.vocabulary, some, strict=True) if k], self.w[some].astype(float).round(6), x[:, some]
        self.b = self.b.astype(float).round(6)
        z, truth = x[held] @ self.w + self.b, y[held].argmax(axis=1)
        self.temperature = min((0.5, 0.75, 1.0, 1.5, 2.0), key=lambda t: -np.log(self.soft(z / t)[np.arange(len(z)), truth] + 1e-12).mean())
        p = self.soft(z / self.temperature)
        best, said = p.max(axis=1), p.argmax(axis=1)
        self.least = next((t for t in np.linspace(0.5, 0.95, 46) if (truth == said)[(said > 0) & (best >= t)].mean() >= precision), 0.95)
        self.accuracy = float((said == truth).mean())

    @staticmethod
    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


_MODELS: dict = {}


def model(rows: int = ROWS, seed: int = SEED) -> Model:
    if (rows, seed) not in _MODELS:
        _MODELS[rows, seed] = Model(labelled_rows(rows, seed))
    return _MODELS[rows, seed]


def pattern_of(words: list[str]) -> str:
    """A pattern of any of the words, by first letters, so that most places are passed over at once."""
    first = sorted({w[0] for w in words})
    return r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(re.escape(c) + "(?:" + "|".join(re.escape(w[1:]) for w in sorted(words, reverse=True) if w[0] == c) + ")" for c in first) + r")(?![A-Za-z0-9])"


ANCHOR_PATTERN = pattern_of(ANCHORS)


def _line_tokens(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(line), _WORD, -1), lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")


def _line_grams(w: Column) -> Column:
    return F.array_distinct(F.concat(*[_ngrams(w, n) for n in range(1, NGRAM + 1)]))


def _ngrams(w: Column, n: int) -> Column:
    places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(w, i, n), " "))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """The licence paragraphs of each row's text.

    Returns the id, n_paragraphs (runs of lines with words), n_cued (lines with
    an anchor word), found (array of struct<line, family, probability, contained>, family
    unknown where the threshold or the templates say so), families (the known
    ones, distinct and sorted, joined by commas) and n_unknown. A wrapped notice
    is found at the line before each line break that its family shows at only
    with both sides; cued lines beside the break are then not unknown. A null or
    empty text has none. Each row gives one row, an empty table none; other
    columns of df, whatever their names, are not read.
    """
    m = model(rows, seed)
    table = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)  # noqa: E731  # one literal, not one for each number
    vocabulary = table(dict(zip(m.vocabulary, m.w.tolist(), strict=True)), "map<string,array<double>>")
    known_grams, zero = table(m.vocabulary, "array<string>"), table(m.b.tolist(), "array<double>")
    template = lambda t: {"grams": grams(t.split()), "least": least_grams(t)}
    templates = table([[template(t) for t in ts] for ts in [["\0"], *TEMPLATES.values()]], "array<array<struct<grams:array<string>,least:int>>>")
    names = F.array(*[F.lit(f) for f in FAMILIES])

    def judged(w: Column, i: Column) -> Column:
        def of_grams(g: Column) -> Column:
            def of_scores(z: Column) -> Column:
                def of_best(best: Column) -> Column:
                    total = F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp((v - best) / m.temperature))
                    said = F.array_position(z, best).cast("int")

                    def of_shares(share: Column) -> Column:
                        kept = F.element_at(share, said)
                        known = (1 / total >= m.least) & (kept > 0) & (kept >= F.array_max(share))
                        return F.struct(i.cast("long").alias("line"), F.when(known, F.element_at(names, said)).otherwise(UNKNOWN).alias("family"), (1 / total).alias("probability"), kept.alias("contained"))

                    share = lambda t: let(F.size(F.array_intersect(t["grams"], g)), lambda n: F.when(n >= t["least"], n / F.size(t["grams"])).otherwise(0.0))
                    shares = F.transform(templates, lambda ts: F.array_max(F.transform(ts, share)))
                    none = F.struct(i.cast("long").alias("line"), F.lit(UNKNOWN).alias("family"), (1 / total).alias("probability"), F.lit(0.0).alias("contained"))
                    return F.when(said == 1, none).otherwise(let(shares, of_shares))

                return let(F.array_max(z), of_best)

            hits = F.transform(F.array_sort(F.array_intersect(g, known_grams)), lambda x: F.element_at(vocabulary, x))
            return let(F.aggregate(hits, zero, lambda a, w: F.zip_with(a, w, lambda p, q: p + q)), of_scores)

        return let(_line_grams(w), of_grams)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    anchors = F.array(*[F.lit(c) for c in ANCHORS])
    known = lambda f: f["family"] != UNKNOWN

    def at_breaks(tokens: Column) -> Column:
        """A verdict for each line break between lines with words, with an anchor word around it."""
        marked = F.transform(tokens, lambda w: F.when(F.size(w) == 0, F.array(F.lit(BREAK))).otherwise(w))

        def of_flat(flat: Column) -> Column:
            def sides(at: Column, i: Column) -> Column:
                after = F.slice(flat, at.cast("int") + 1, SIDE)
                before = F.reverse(F.slice(flat, F.greatest(at.cast("int") - SIDE, F.lit(0)) + 1, F.least(at.cast("int"), F.lit(SIDE))))
                run = lambda w: F.slice(w, 1, F.when(F.array_contains(w, BREAK), F.array_position(w, BREAK).cast("int") - 1).otherwise(F.size(w)))
                return F.struct((i - 1).alias("i"), F.reverse(run(before)).alias("b"), run(after).alias("a"))

            starts = exclusive_sums(F.transform(marked, lambda w: F.size(w).cast("long")))
            return F.filter(F.transform(starts, sides), lambda s: (F.size(s["b"]) > 0) & (F.size(s["a"]) > 0))

        windows = F.transform(let(F.flatten(marked), of_flat), lambda s: F.struct(s["i"].alias("i"), F.concat(s["b"], s["a"]).alias("w")))
        return F.filter(F.transform(F.filter(windows, lambda s: F.arrays_overlap(s["w"], anchors)), lambda s: judged(s["w"], s["i"])), known)

    def merged(own: Column, wrapped: Column) -> Column:
        """Verdicts of lines, and those of line breaks whose family neither line beside them has. All are sorted by place, a line's at twice its number and the break behind it next, so only neighbours are looked at."""
        placed = lambda fs, behind: F.transform(fs, lambda f: F.struct((2 * f["line"] + behind).alias("at"), f.alias("f")))

        def beside(events: Column, e: Column, j: Column, test: Callable[[Column, Column], Column]) -> Column:
            one = lambda d: let(F.get(events, j + d), lambda o: F.coalesce((o["at"] == e["at"] + d) & test(o, j + d), F.lit(False)))
            return one(-1) | one(1)

        def told(events: Column) -> Column:
            is_break = lambda e: e["at"] % 2 == 1
            new = F.transform(events, lambda e, j: is_break(e) & ~beside(events, e, j, lambda o, _: o["f"]["family"] == e["f"]["family"]))

            def kept(new: Column) -> Column:
                stays = lambda e, j: F.when(is_break(e), F.get(new, j)).otherwise(known(e["f"]) | ~beside(events, e, j, lambda _, k: F.get(new, k)))
                return F.array_sort(F.transform(F.filter(events, stays), lambda e: e["f"]))

            return let(new, kept)

        return let(F.array_sort(F.concat(placed(own, 0), placed(wrapped, 1))), told)

    def all_found(tokens: Column) -> Column:
        own = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.regexp_like(s["x"], F.lit(ANCHOR_PATTERN))), lambda s: judged(F.element_at(tokens, s["i"] + 1), s["i"]))
        return let(own, lambda own: let(at_breaks(tokens), lambda wrapped: merged(own, wrapped)))

    none = F.array().cast("array<struct<line:bigint,family:string,probability:double,contained:double>>")
    cued = F.regexp_like(text, F.lit(ANCHOR_PATTERN))
    found = F.when(cued, let(F.transform(lines, _line_tokens), all_found)).otherwise(none)
    n_cued = F.when(cued, F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(ANCHOR_PATTERN))))).otherwise(0).cast("long")
    n = F.regexp_count(F.concat(F.lit("\n\n"), text), F.lit(r"\n[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*(?=[^\x20\x09-\x0D])")).cast("long")
    out = df.select(F.col(id_col), n.alias("n_paragraphs"), n_cued.alias("n_cued"), found.alias("found"))
    told = F.filter("found", known)
    return out.select(
        id_col, "n_paragraphs", "n_cued", "found", F.array_join(F.array_sort(F.array_distinct(F.transform(told, lambda f: f["family"]))), ",").alias("families"), (F.size("found") - F.size(told)).cast("long").alias("n_unknown"),
    )
