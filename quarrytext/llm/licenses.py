"""Licence scans by a trained paragraph classifier (operator 9).

Native: DataFrame functions and JVM-side model fitting only.  A paragraph is a line or a run of up to
``JOINED`` adjacent lines without a blank one between, since notices are wrapped; its first and last line
have a feature that speaks for some family.  A sparse multinomial
logistic regression over hashed words and word pairs, with an unknown class, scores every one of them:

* First a bound: over the features of each line, the sum of the largest gain that any family has over
  the unknown class (never less than 0).  Where the bounds of a run's lines stay under the least bias, no
  family can be more probable than unknown, so the run is unknown and its scores are not worked out.
  The bound only follows from the weights: no list of key words decides.
* All other runs get the exact probabilities of all classes.  A family's must reach the floor calibrated
  on held-out unknown paragraphs.
* A predicted family is confirmed by comparing the run with the family's templates: ``CONFIRM`` of the
  word pairs of one must be there.  Predictions without confirmation are given apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 1 << 18  # hashed features
HALF = 1 << 10  # values of the low half of a hashed feature
JOINED = 6  # most adjacent lines that are joined
CONFIRM = 0.75  # of a template's word pairs that a paragraph must hold

# Identifying phrases and notices of licence families, normalised.
TEMPLATES: dict[str, list[str]] = {
    "AGPL": ["gnu affero general public license version 3", "gnu affero general public license", "agpl 3.0", "licensed under the agpl"],
    "Apache": ["apache license version 2.0", "apache software license", "licensed under the apache license", "apache 2.0 license", "license apache-2.0", "under the apache-2.0 license"],
    "BSD": ["bsd license", "bsd 3-clause license", "bsd 2-clause license", "license bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted"],
    "CC-BY": ["creative commons attribution 4.0 international license", "cc by 4.0", "cc by 3.0", "cc-by 4.0", "license cc-by-4.0", "creative commons attribution license"],
    "CC-BY-NC": ["creative commons attribution-noncommercial 4.0 international license", "cc by-nc 4.0", "cc by-nc 3.0", "cc by-nc 2.0", "cc-by-nc 4.0", "license cc-by-nc-4.0", "creative commons attribution-noncommercial license"],
    "CC-BY-SA": ["creative commons attribution-sharealike 4.0 international license", "cc by-sa 4.0", "cc by-sa 3.0", "cc-by-sa 4.0", "license cc-by-sa-4.0", "creative commons attribution-sharealike license"],
    "GPL": ["gnu general public license", "gnu gpl", "license gpl-3.0", "license gpl-2.0", "gpl version 3", "gpl version 2", "licensed under the gpl"],
    "ISC": ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "license lgpl-3.0", "licensed under the lgpl"],
    "MIT": ["mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "license mit", "licensed under mit", "the mit licence"],
    "MPL": ["mozilla public license version 2.0", "mozilla public license", "mpl 2.0", "license mpl-2.0"],
    "Proprietary": ["all rights reserved", "no part of this publication may be reproduced without the prior written permission of the publisher"],
    "Public-Domain": ["released into the public domain", "dedicated to the public domain", "cc0 1.0 universal", "license cc0-1.0", "the unlicense"],
}

# Opening sentences of the notices and texts of these families.
NOTICES: dict[str, list[str]] = {
    "AGPL": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "Apache": ["you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0", "licensed to the apache software foundation asf under one or more contributor license agreements"],
    "BSD": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "CC-BY": ["this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC": ["this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-SA": ["this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "GPL": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "LGPL": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "MIT": ["to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MPL": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "Public-Domain": ["this is free and unencumbered software released into the public domain", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
}
# What surrounds a phrase in the training paragraphs.
FRAMES = ["{}", "licensed under the {}", "licensed under {}", "released under the {}", "released under the terms of the {}", "this work is licensed under the {}", "this work is licensed under a {}", "this file is distributed under the {}", "see the {} for details", "copyright 2020 the authors {}", "this program is free software under the {} version 3", "you may use this file under the {}", "spdx {}", "{} version 2.0", "{} 4.0"]
# Paragraphs that hold key words without being a licence.
UNKNOWN = [
    "he lost his driving license on the road", "she got her license to teach in the spring", "the license plate was covered in mud", "a fishing license costs ten dollars", "poetic license is allowed here",
    "the pilot renewed the license last year", "human rights are universal", "the rights of the people", "all rights and duties of the citizens", "turn right and then go to the public library",
    "the general public was invited to the opening", "the museum is open to the general public", "permission to land was granted by the tower", "he asked for permission to leave the room", "the school gave permission for the trip",
    "the software crashed again and we lost our work", "software engineers met in the town hall", "binary stars orbit each other", "binary numbers have two digits", "the domain of the function is the real line",
    "the public domain of the king was vast", "creative writing is taught on monday", "a creative solution to a common problem", "the creative team met at noon", "students at mit built a robot",
    "mit researchers found a new material", "the apache helicopter landed", "the apache people lived in the southwest", "a gnu grazed on the plain", "the gnu herd crossed the river",
    "the purpose of this letter is to thank you", "on purpose he left the door open", "redistribution of wealth was debated", "the publication of the book was delayed", "the results could not be reproduced",
    "the publisher sent the book back", "we distribute food to the poor", "please modify the plan", "hereby i resign from my office", "the wish was granted by the king",
    "smoking is not permitted in this building", "cc the manager on the mail", "mix 5 cc of water", "version 2.0 of the plan was better", "version 3 of the map", "use of the pool is free of charge",
    "a copy of the letter was sent", "any person may enter", "the common attribution of the painting is wrong", "source and binary", "isc is a river", "the copyright law was changed", "copyright is a right of authors",
    "the authors of the book", "the mozilla office moved", "a license is required", "license fees went up", "licensed plumbers are rare", "licensed under the bar act", "the shop is licensed to sell wine", "released under the bridge", "released under pressure",
    "this is the house by the river", "he came by train or by car with this friend", "they sat by the fire and this went on", "this or that and the other", "with or without sugar", "stand by me and by them", "written by hand by the poet",
    "or else the other one came from the sea", "no one was there and no one came", "be it as it may", "to be or not to be", "it was as it is and was from there", "under this tree by the lake", "of this and of that with this",
    "sie kam mit dem zug mit der tante", "er sprach mit ihr und mit ihm", "mit der zeit ging es mit ihm gut", "mit und ohne zucker", "und mit dem wind kam der regen", "la maison de la mer avec les enfants", "el perro de la casa con los gatos por la calle", "no hay nadie por la noche",
    "10 0 20 0 30 numbers in a row 4 0", "in 2019 and 2020 there were 3 or 4 of this kind", "of or to and to the and the",
]


def words_of(paragraph: Column) -> Column:
    """Lower-case runs of ASCII letters and digits.  Digits become 0: the numbers of versions and years
    tell no family apart, only their shape does."""
    flat = F.translate(F.lower(paragraph), "123456789", "000000000")
    return F.array_remove(F.split(flat, "[^a-z0]+"), "")


def _pairs(words: Column) -> Column:
    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.transform(firsts, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))


def _bucket(value: Column) -> Column:
    return F.pmod(value, F.lit(SIZE)).cast("int")


def _buckets(words: Column) -> tuple[Column, Column]:
    """The hashed features of a list of words: of the words, and of the pairs."""
    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    single = F.transform(words, lambda w: _bucket(F.xxhash64(w)))
    return single, F.transform(firsts, lambda w, i: _bucket(F.xxhash64(w, F.get(words, i + 1))))


def training_rows() -> list[tuple[str, str, bool]]:
    """(paragraph, family, held out) for every phrase in every frame, the notices, and unknown paragraphs."""
    rows = []
    for family, phrases in sorted(TEMPLATES.items()):
        for phrase in phrases:
            rows += [(frame.format(phrase), family, False) for frame in FRAMES]
    for family, notices in sorted(NOTICES.items()):
        for notice in notices:
            words = notice.split()
            rows += [(" ".join(words[at:]), family, False) for at in range(3)] + [(" ".join(words[: len(words) - at]), family, False) for at in range(1, 3)]
    for k, text in enumerate(UNKNOWN):
        variants = [text, f"{text} today", f"the notice said {text}", f"copyright 2020 {text}", " ".join(reversed(text.split())), f"{text} under the law", f"see {text} for details", f"{text} version 2.0"]
        rows += [(v, "unknown", (k + q) % 4 == 0) for q, v in enumerate(variants)]
    return rows


class Model:
    """Coefficients by class over the features seen in training, and the least probability of a family."""

    def __init__(self, families: list[str], features: list[int], weights: list[list[float]], bias: list[float], floor: float):
        self.families, self.features, self.weights, self.bias, self.floor = families, features, weights, bias, floor

    def gains(self) -> list[float]:
        """By feature: the most that it adds to any family's score over unknown, at least 0."""
        unknown, *rest = self.weights
        return [max(0.0, *(w[k] - unknown[k] for w in rest)) for k in range(len(self.features))]

    def least(self) -> float:
        """What gains must exceed for any family to be more probable than unknown."""
        return self.bias[0] - max(self.bias[1:])


def _numbers(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _packed(values: dict[int, int], bits: int) -> tuple[list[int], list[int]]:
    """A small table of ``bucket << bits | value``, and by low half of the bucket where its high halves begin there."""
    rows: dict[int, list[int]] = {}
    for bucket in values:
        rows.setdefault(bucket % HALF, []).append(bucket)
    starts, taken = [0] * HALF, {}
    for low, buckets in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        start = 0
        while any(start + bucket // HALF in taken for bucket in buckets):
            start += 1
        starts[low] = start
        taken |= {start + bucket // HALF: bucket << bits | values[bucket] for bucket in buckets}
    return starts, [taken.get(at, -1) for at in range(max(starts) + SIZE // HALF)]


def _known(model: Model, words: Column) -> tuple[Column, Column]:
    """The features that have any weight, by their number from 1: those of words, and those of pairs."""
    bits = len(model.features).bit_length()
    places = {bucket: k + 1 for k, bucket in enumerate(model.features) if any(w[k] for w in model.weights)}
    # Plans hold this table several times, so it has little more than the features that training met.
    starts, table = (_numbers(v, kind) for v, kind in zip(_packed(places, bits), ("int", "bigint")))
    entry = lambda b: F.get(table, F.shiftright(b, HALF.bit_length() - 1) + F.get(starts, b.bitwiseAND(F.lit(HALF - 1))))
    number = lambda b: entry(b).bitwiseXOR(F.shiftleft(b.cast("bigint"), bits))
    return tuple(F.transform(F.filter(F.transform(part, number), lambda k: (k > 0) & (k < 1 << bits)), lambda k: k.cast("int")) for part in _buckets(words))


def _scored(frame: DataFrame, model: Model) -> DataFrame:
    """``frame(known)``, distinct features, with ``family`` (``unknown`` included) and its probability ``p``."""

    def score(weights, bias):
        table = _numbers([round(w, 9) for w in weights], "double")
        return F.aggregate("known", F.lit(float(bias)), lambda a, k: a + F.get(table, k - 1))

    scores = [F.struct(score(w, b).alias("score"), F.lit(f).alias("family")) for f, w, b in zip(model.families, model.weights, model.bias)]
    topped = frame.withColumn("__scores", F.array(*scores)).withColumn("__top", F.array_max("__scores"))
    total = F.aggregate("__scores", F.lit(0.0), lambda a, s: a + F.exp(s["score"] - F.col("__top.score")))
    return topped.withColumns({"family": F.col("__top.family"), "p": 1 / total}).drop("__scores", "__top")


def train(spark: SparkSession) -> Model:
    """Fit the classifier on the paragraphs made from the fixed values; the input takes no part."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    families = ["unknown", *sorted(TEMPLATES)]
    rows = spark.createDataFrame([(text, float(families.index(f)), held) for text, f, held in training_rows()], "paragraph string, label double, held boolean").coalesce(1)
    worded = rows.withColumn("words", words_of(F.col("paragraph")))
    made = worded.withColumn("buckets", F.array_distinct(F.concat(*_buckets(F.col("words"))))).cache()
    fit = made.filter("NOT held")
    features = sorted(r[0] for r in fit.select(F.explode("buckets")).distinct().collect())
    counted = CountVectorizerModel.from_vocabulary([str(k) for k in features], inputCol="names", outputCol="features", minTF=1.0)
    vectors = counted.transform(fit.select("label", F.col("buckets").cast("array<string>").alias("names"))).select("label", "features").cache()
    fitted = LogisticRegression(maxIter=60, regParam=2e-4, elasticNetParam=0.2, family="multinomial", standardization=False).fit(vectors)
    vectors.unpersist()
    matrix = fitted.coefficientMatrix.toArray()
    model = Model(families, features, [[float(x) for x in r] for r in matrix], [float(x) for x in fitted.interceptVector.toArray()], 0.0)
    # The floor: above what any held-out unknown paragraph gives a family.
    held = made.filter("held").withColumn("known", F.array_distinct(F.concat(*_known(model, F.col("words")))))
    wrong = _scored(held, model).agg(F.max(F.when(F.col("family") != "unknown", F.col("p")))).first()[0]
    made.unpersist()
    model.floor = min(0.9, max(0.5, float(wrong or 0.0)))
    return model


def _confirmed(pairs: Column) -> Column:
    """By family: whether one of its templates has ``CONFIRM`` of its word pairs among ``pairs``."""
    found = F.lit(False)
    for family, phrases in sorted(TEMPLATES.items()):
        held = []
        for phrase in [*phrases, *NOTICES.get(family, [])]:
            words = "".join("0" if c.isdigit() else c if c.isalpha() else " " for c in phrase).split()
            want = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
            held.append(F.size(F.array_intersect(pairs, F.lit(want))) >= CONFIRM * len(want))
        found = F.when(F.col("family") == family, F.greatest(*held) if len(held) > 1 else held[0]).otherwise(found)
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, bound: bool = True) -> DataFrame:
    """One row per input row: ``(doc_id, n_paragraphs, n_licence, families, licensed, suspected)``.

    ``n_paragraphs`` are the lines with a visible character; ``n_licence`` are those of a confirmed family, and
    one for each family that only joined lines of a block (lines without a blank one between) confirm;
    ``families`` are their distinct families, sorted and joined by commas (empty if none); ``suspected``
    are the families that the classifier gives single lines without confirmation.  A null or empty
    text has no paragraphs.  Texts and lines of any length are read whole; repeated rows and null ids
    stay; an empty table gives an empty result; other columns are ignored, so none can clash.
    ``bound=False`` works out the scores of all paragraphs, with the same result.
    """
    model = model or train(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    visible = lambda p: p.rlike(r"[^\x20\x09-\x0D]")
    counted = F.size(F.filter(F.split(text, "\n"), visible)).cast("bigint")
    blocks = F.split(text, r"\n[\x20\x09-\x0D]*\n")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), counted.alias("n_paragraphs"), blocks.alias("blocks"))
    rows = numbered.select("row", "doc_id", "n_paragraphs", F.posexplode("blocks").alias("block", "text"))
    carried = ["row", "doc_id", "n_paragraphs", "block"]
    # Of every line the features that have any weight, and apart from these the one of the pair over its end.
    lined = rows.select(*carried, F.filter(F.split("text", "\n"), visible).alias("lines"))
    worded = lined.withColumn("words", F.transform("lines", words_of))
    own = lambda w: F.array_distinct(F.concat(*_known(model, w)))
    first = lambda i: F.slice(F.coalesce(F.get("words", i), F.array().cast("array<string>")), 1, 1)
    over = lambda w, i: _known(model, F.concat(F.slice(w, F.greatest(F.size(w), F.lit(1)), 1), first(i + 1)))[1]
    known = F.transform("words", lambda w, i: F.struct(own(w).alias("own"), over(w, i).alias("over")))
    featured = worded.select(*carried, "lines", known.alias("known"))
    # What each line can gain at most; a run of lines is scored if the gains of its distinct features may do.
    gain = _numbers([0.0, *[round(g, 9) for g in model.gains()]], "double")
    gained = lambda features: F.aggregate(features, F.lit(0.0), lambda a, k: a + F.get(gain, k))
    least = F.lit(model.least() - 1e-6 if bound else -1.0)
    marked = featured.select(*carried, "lines", "known", F.transform("known", lambda k: gained(k["own"]) + gained(k["over"])).alias("gains"))
    some = F.filter(F.transform("gains", lambda g, i: F.when(g > 0, i)), lambda i: i.isNotNull())
    begun = marked.select(*carried, "lines", "known", "gains", some.alias("some"))
    runs = F.flatten(F.transform("some", lambda i: F.transform(F.sequence(F.lit(1), F.lit(JOINED)), lambda n: F.struct(i.alias("at"), n.alias("n")))))
    part = lambda c, r: F.slice(c, r["at"] + 1, r["n"])
    enough = lambda r: F.aggregate(part("gains", r), F.lit(0.0), lambda a, g: a + g) > least
    whole = lambda r: F.get("gains", r["at"] + r["n"] - 1) > 0
    chosen = begun.select(*carried, "lines", "known", F.filter(F.filter(runs, whole), enough).alias("runs"))
    inside = lambda r: F.flatten(F.transform(F.slice("known", r["at"] + 1, r["n"] - 1), lambda k: k["over"]))
    features = lambda r: F.array_distinct(F.concat(F.flatten(F.transform(part("known", r), lambda k: k["own"])), inside(r)))
    held = F.filter(F.transform("runs", lambda r: F.struct(r["at"].alias("at"), r["n"].alias("n"), features(r).alias("known"))), lambda r: gained(r["known"]) > least)
    joined = F.transform(held, lambda r: F.struct((r["n"] > 1).alias("wrapped"), r["known"].alias("known"), F.array_join(part("lines", r), " ").alias("paragraph")))
    spread = chosen.select(*carried, F.explode_outer(joined).alias("r")).select(*carried, "r.*")
    scored = _scored(spread, model)
    predicted = F.col("paragraph").isNotNull() & (F.col("family") != "unknown") & (F.col("p") >= model.floor)
    # Only the texts of predicted runs are looked at again.
    shown = scored.select(*carried, "wrapped", F.when(predicted, F.col("family")).alias("family"), words_of(F.when(predicted, F.col("paragraph"))).alias("words"))
    paired = shown.withColumn("pairs", F.array_distinct(_pairs(F.col("words"))))
    judged = paired.select(*carried, "wrapped", "family", _confirmed(F.col("pairs")).alias("sure"))
    sure, plain = F.when(F.col("sure"), F.col("family")), ~F.col("wrapped")
    placed = F.when(sure.isNotNull(), F.struct("block", "family"))
    grouped = judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_paragraphs").alias("n_paragraphs"),
        F.count(F.when(plain, sure)).alias("lines"),
        F.collect_set(F.when(plain, placed)).alias("plain"),
        F.collect_set(F.when(~plain, placed)).alias("joined"),
        F.collect_set(sure).alias("families"),
        F.collect_set(F.when(plain & ~F.col("sure"), F.col("family"))).alias("suspected"),
    )
    more = F.size(F.array_except("joined", "plain")).cast("bigint")
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    per = grouped.select("doc_id", "n_paragraphs", (F.col("lines") + more).alias("n_licence"), listed("families").alias("families"), listed("suspected").alias("suspected"))
    return per.select("doc_id", "n_paragraphs", "n_licence", "families", (F.col("n_licence") > 0).alias("licensed"), "suspected")
