"""Licence scans with a positional index of rare words; DataFrame functions only.

The licence notices (templates) are indexed by word: each posting is a template and the word's
place in it.  A template is posted under the words of its mandatory key phrases with the highest
inverse document frequency; frequencies are counted over all files.  A file is looked up by all
of its words.  Each place of a posted word votes, through its postings, for a template starting
at the place it would have; places with all votes of a template are compared with it word by
word, and its key phrases must stand where the template has them.  As a template only stands
where all words of its key phrases do, the lookup loses none.

Independently of templates, base phrases are found wherever their words stand in a row.  Files
without any of the triggers, of which every base phrase and every template's key phrases have
one, skip all of it; the triggers are taken from the templates and base phrases that are given.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words, base phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Label, notice, mandatory key phrases of the notice.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software", ("to any person obtaining a copy of this software and associated documentation files",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license", "version 2 1 of the license")),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license", "version 3 of the license")),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3 of the license")),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("boost-1", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("to any person or organization obtaining a copy of the software and accompanying documentation",)),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ("will the authors be held liable for any damages arising from the use of this software",)),
    ("zlib", "this notice may not be removed or altered from any source distribution", ("may not be removed or altered from any source distribution",)),
    ("ofl-1.1", "permission is hereby granted free of charge to any person obtaining a copy of the font software", ("to any person obtaining a copy of the font software",)),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license version 1 1",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
)
# Label and the identifier that stands for it in a tag, as words.
IDENTIFIERS = (
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-3", "gpl 3 0"), ("gpl-2", "gpl 2 0"), ("lgpl-3", "lgpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("agpl-3", "agpl 3 0"), ("bsd", "bsd 3 clause"), ("bsd", "bsd 2 clause"), ("mpl-2", "mpl 2 0"), ("isc", "isc"), ("unlicense", "unlicense"),
    ("cc0", "cc0 1 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("zlib", "zlib"), ("boost-1", "bsl 1 0"), ("epl-2", "epl 2 0"), ("ofl-1.1", "ofl 1 1"),
)
TEMPLATES += tuple((label, f"spdx license identifier {words}", (f"spdx license identifier {words}",)) for label, words in IDENTIFIERS)

#: Shorter words occur inside others too often to look for them alone.
LEAST_TRIGGER = 5

#: Votes that a place needs, as many as a template has postings, and the share of a template's words that must agree there.
LEAST_VOTES, LEAST_SHARE = 2, 0.8


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def triggers(weights: dict[str, float], templates, base) -> list[str]:
    """Words and phrases of which every base phrase and every template's key phrases have one.

    A phrase's trigger is its word with the highest idf (of equal ones the longest, then the
    first), unless a trigger chosen before lies in it; a phrase of short words is one itself.
    """
    chosen: list[str] = []
    for phrase in [*(p for p, _ in base), *(max(phrases, key=len) for _, _, phrases in templates)]:
        words = phrase.split()
        if not any(t in phrase if " " in t else any(t in w for w in words) for t in chosen):
            known = [w for w in words if len(w) >= LEAST_TRIGGER]
            chosen.append(max(known, key=lambda w: (weights.get(w, 0.0), len(w))) if known else phrase)
    return chosen


def may_match(text: Column, wanted: list[str]) -> Column:
    """Whether the text has one of the triggers, with any separators between a phrase's words (a sound filter)."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return text.rlike("(?i)" + "|".join(gap.join(map(quoted, t.split())) for t in wanted)) if wanted else F.lit(False)


def quoted(word: str) -> str:
    """The word as a regular expression; letters and digits stand for themselves."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in word)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, notice, _ in templates for w in notice.split()})


def idf(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of each licence word over all files.

    Every file gives the licence words it has, at most as many as the templates have; counts
    are combined before the shuffle, and the driver gets one row per licence word.
    """
    # the two characters beyond A-Z whose lower case has an ASCII letter are put out of its way
    text = F.replace(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\u212a"), F.lit("\u00df")), F.lit("\u0130"), F.lit("\u00df"))
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    if not templates:
        return {}
    found = docs.select(F.explode(F.array_intersect(words, _strings(vocabulary(templates)))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary(templates)}


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Places where the words of the phrase stand in a row."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    at = F.filter(F.transform(words, lambda w, i: F.when((w == parts[0]) & (i <= last), i)), lambda i: i.isNotNull())

    def follows(k: int):
        return lambda i: F.get(words, i + k) == parts[k]

    for k in range(1, len(parts)):
        at = F.filter(at, follows(k))
    return at


def _anchors(weights: dict[str, float], templates) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, place) by word: of each template LEAST_VOTES words of its key phrases, those with the highest idf.

    A template with fewer such words posts them again, so that their votes suffice.
    """
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, phrases) in enumerate(templates):
        words = notice.split()
        places = sorted({q + k for q, n in _key_places(notice, phrases) for k in range(n)}, key=lambda q: (-weights[words[q]], q))
        for k in range(LEAST_VOTES):
            q = places[k % len(places)]
            postings.setdefault(words[q], []).append((t, q))
    return postings


def _votes(places: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """(template, place) that each place of an anchor word points to, sorted."""
    index = F.create_map(*(x for w, posts in postings.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in posts)))))
    return F.array_sort(F.flatten(F.transform(places, lambda x: F.transform(F.element_at(index, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["q"]).alias("at"))))))


def _voted(votes: Column) -> Column:
    """Of the sorted votes those that LEAST_VOTES places share, once each."""
    return F.array_distinct(F.filter(votes, lambda v, i: F.get(votes, i + LEAST_VOTES - 1) == v))


def _matches(words: Column, votes: Column, templates) -> Column:
    """Of the voted places (label, share) of those where the template stands."""
    notices = F.array(*(_strings(notice.split()) for _, notice, _ in templates))
    labels = _strings(label for label, _, _ in templates)
    keys = F.array(*(F.array(*(F.struct(F.lit(q).alias("q"), F.lit(n).alias("n")) for q, n in _key_places(notice, phrases))) for _, notice, phrases in templates))

    def judge(v: Column) -> Column:
        notice = F.element_at(notices, v["t"] + 1)
        same = F.transform(notice, lambda w, q: F.coalesce(F.get(words, v["at"] + q) == w, F.lit(False)))
        share = F.size(F.filter(same, lambda x: x)) / F.size(notice)
        whole = F.forall(F.element_at(keys, v["t"] + 1), lambda k: F.forall(F.slice(same, k["q"] + 1, k["n"]), lambda x: x))
        return F.struct(F.element_at(labels, v["t"] + 1).alias("label"), F.when(whole, share).otherwise(0.0).alias("share"))

    return F.filter(F.transform(votes, judge), lambda m: m["share"] >= LEAST_SHARE)


def _key_places(notice: str, phrases: tuple[str, ...]) -> list[tuple[int, int]]:
    """(first word, words) of each key phrase in the notice."""
    out = []
    for phrase in phrases:
        before = re.search(rf"(?:^| ){re.escape(phrase)}(?: |$)", notice)
        if not before:
            raise ValueError(f"key phrase not in notice: {phrase}")
        out.append((len(notice[: before.start()].split()), len(phrase.split())))
    return out


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted) and score.

    ``score``: 1 with a base phrase, else the largest share of a template's words that stand at
    its place (0 without labels).  A null text has no words.  Rows are judged by themselves, so
    repeated rows, null ids and other columns make no difference (columns with the added
    names are replaced); an empty table gives no rows.
    """
    weights = idf(docs, templates)
    postings, wanted = _anchors(weights, templates), triggers(weights, templates, base)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__words", F.when(may_match(text, wanted), words_of(text)))
    words = F.col("__words")

    def labelled(label: str):
        return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))

    nowhere = F.expr("cast(array() as array<array<struct<at:int,label:string>>>)")
    starts = F.flatten(F.array(*(F.transform(_phrase_starts(words, phrase), labelled(label)) for phrase, label in base)) if base else nowhere)
    out = out.withColumn("__base", F.when(words.isNotNull(), starts))
    if templates:
        places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*postings))
        out = out.withColumn("__anchors", F.when(words.isNotNull(), places))
        # columns of their own, for inside a lambda an expression would be computed for each element
        out = out.withColumn("__all", F.when(F.size("__anchors") > 0, _votes(F.col("__anchors"), postings)))
        out = out.withColumn("__votes", _voted(F.col("__all")))
        out = out.withColumn("__found", F.when(F.size("__votes") > 0, _matches(words, F.col("__votes"), templates)))
    else:
        out = out.withColumn("__found", F.expr("cast(null as array<struct<label:string,share:double>>)"))
    none = F.expr("cast(array() as array<string>)")
    label = lambda c: F.coalesce(F.transform(F.col(c), lambda m: m["label"]), none)
    at = F.transform("__base", lambda m: m["at"])
    out = out.withColumns(
        {
            # the lower-casing changes no word's limits, so the words of the cased text are as many
            "n_words": F.coalesce(F.size("__words"), F.size(F.regexp_extract_all(text, F.lit(CASED_WORD), F.lit(0)))).cast("long"),
            "n_base": F.coalesce(F.size("__base"), F.lit(0)).cast("long"),
            "first_word": F.array_min(at).cast("long"),
            "last_word": F.array_max(at).cast("long"),
            "base_labels": F.array_sort(F.array_distinct(label("__base"))),
            "labels": F.array_sort(F.array_distinct(F.concat(label("__base"), label("__found")))),
            "score": F.when(F.coalesce(F.size("__base"), F.lit(0)) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("__found", lambda m: m["share"])), F.lit(0.0))),
        }
    )
    return out.drop("__words", "__base", "__anchors", "__all", "__votes", "__found")


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query: licence phrases and labels of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
