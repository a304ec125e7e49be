"""License scans with a positional rare-token index, in DataFrame functions only.

The index holds of every template the ``VOTES`` key words of highest inverse document frequency over the
whole corpus, with their positions. Each of their places in a document votes for (template, offset): the
word's position minus its position in the template. An offset with ``VOTES`` votes is verified: every word
of the template's mandatory key phrases must stand at its place. As the index words are mandatory ones, no
offset that can be verified lacks votes, whatever else the document holds. Optional words before the key
phrases may lie before the text's first word. Plain phrases are counted besides.
One pass counts the document frequencies of the template words (a table of their size), a second one
scans; both work inside the row, so no group of documents is ever gathered.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z taken as a-z.
Defined results: null or empty text has no words, no labels and score 0; repeated rows get equal
results; a null doc_id is carried through; an input without rows gives none. ``score`` is the largest
share of a verified template's words that stand at their places, 0.5 if only a plain phrase was found.
Very long texts are scanned whole. Columns of the input that bear a result's name are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.llm.storage import free_name

VOTES = 2

# Phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Customary notices and beginnings of public licenses; mandatory key phrases stand in brackets.
TEMPLATES = {
    "agpl-3.0": "licensed under the [gnu affero general public license] [version 3]",
    "apache-2.0": "licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "[redistribution and use in source and binary forms] with or without modification are [permitted provided that] the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-3-clause": "[neither the name of] the copyright holder nor the names of [its contributors may be used to endorse or promote products] derived from this software without specific prior written permission",
    "bsl-1.0": "distributed under the [boost software license version 1 0]",
    "cc-by-4.0": "this work is licensed under a [creative commons attribution 4 0] international license",
    "cc-by-nc-4.0": "licensed under [cc by nc 4 0]",
    "cc-by-sa-4.0": "licensed under [cc by sa 4 0]",
    "cc0-1.0": "[cc0 1 0 universal] public domain dedication",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the [eclipse public license] v 2 0",
    "gpl-2.0": "under the terms of the [gnu general public license] as published by the [free software foundation] either [version 2] of the license or at your option any later version",
    "gpl-3.0": "this work is licensed under the [gnu general public license version 3]",
    "isc": "[permission to use copy modify] and or [distribute this software] for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-2.1": "under the terms of the [gnu lesser general public license] as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "mit-notice": "[released under the mit license]",
    "mit-terms": "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "mpl-2.0": "this source code form is subject to the terms of the [mozilla public license] v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense": "this is free and [unencumbered software released into the public domain] anyone is free to copy modify publish use compile sell or distribute this software",
    "zlib": "[this software is provided as is without any express or implied warranty] in no event will the authors be held liable for any damages arising from the use of this software",
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same with each character named, which Java's patterns look up in a table instead of testing range by range.
_LISTED_WORD = "[^" + "".join(f"\\x{i:02X}" for i in [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]) + "]+"


def template_words(text: str) -> list[tuple[str, bool]]:
    """Words of a template and whether each is part of a key phrase."""
    out, key = [], False
    for x in text.split():
        key |= x.startswith("[")
        out.append((x.strip("[]"), key))
        key &= not x.endswith("]")
    return out


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is(words: Column, at: Column, word: str | Column) -> Column:
    return F.coalesce(F.get(words, at) == word, F.lit(False))


def _words(text: str) -> Column:
    """Lower-case words. Of all characters beyond ASCII only the Kelvin sign has a lower case within it; it is set aside first."""
    plain = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u212a"), F.lit("\u212b"))
    return F.regexp_extract_all(F.lower(plain), F.lit(_LISTED_WORD), F.lit(0))


def _list(words: Iterable[str]) -> Column:
    """The words as a literal array, made in one call."""
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def _places(parts: list[tuple[str, int]]) -> Column:
    """Words w and their places j as a literal array of structs, made in one call."""
    return F.expr("array(" + ", ".join(f"named_struct('w', '{w}', 'j', {j})" for w, j in parts) + ")")


def _present(words: Column, vocabulary: list[str]) -> Column:
    """The different words of the vocabulary that occur, by one look-up a word."""
    return F.array_intersect(words, _list(vocabulary))


def document_frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Documents of the corpus with each word of the key phrases; the result is as long as their vocabulary."""
    vocabulary = sorted({w for t in TEMPLATES.values() for w, key in template_words(t) if key})
    counts = docs.select(F.explode(_present(_words(text), vocabulary)).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in counts}


def by_rarity(frequencies: dict[str, int]) -> list[str]:
    """The key words by falling inverse document frequency, equals by name."""
    return sorted(frequencies, key=lambda w: (frequencies[w], w))


def scan(docs: DataFrame, frequencies: dict[str, int], text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    ranked = by_rarity(frequencies)
    phrase_words = sorted({w for p in PHRASES for w in p.split()})

    def has_all(present: Column, needed: list[str]) -> Column:
        return F.forall(_list(dict.fromkeys(needed)), lambda w: F.array_contains(present, w))

    def key_words(label: str) -> list[str]:
        return [w for w, key in template_words(TEMPLATES[label]) if key]

    def index_words(label: str) -> dict[str, int]:
        """The template's rarest different key words, each with its first place within the key phrases."""
        first: dict[str, int] = {}
        for at, (w, key) in enumerate(template_words(TEMPLATES[label])):
            if key:
                first.setdefault(w, at)
        return dict(sorted(first.items(), key=lambda x: ranked.index(x[0]))[:VOTES])

    marked_words = sorted({w for label in TEMPLATES for w in index_words(label)} | set(phrase_words))

    def places(words: Column, hits: Column, phrase: str) -> Column:
        parts = phrase.split()
        first = F.filter(hits, lambda h: h["w"] == parts[0])
        full = F.filter(first, lambda h: reduce(lambda a, b: a & b, [_is(words, h["p"] + j, x) for j, x in enumerate(parts) if j]))
        return F.transform(full, lambda h: h["p"])

    def coverage(words: Column, hits: Column, label: str) -> Column:
        """Largest share of the template over the verified offsets; null without any."""
        parts = template_words(TEMPLATES[label])

        def offsets_of(word: str, at: int) -> Column:
            return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["p"] - at)

        def verified(offset: Column) -> Column:
            return F.forall(_places([(w, j) for j, (w, key) in enumerate(parts) if key]), lambda e: _is(words, offset + e["j"], e["w"]))

        def share(offset: Column) -> Column:
            there = F.filter(_places([(w, j) for j, (w, _) in enumerate(parts)]), lambda e: _is(words, offset + e["j"], e["w"]))
            return F.size(there) / len(parts)

        def voted(offsets: Column) -> Column:
            """Sorted offsets to those that stand there often enough. One before the text's first word only lacks optional words."""
            return F.array_distinct(F.filter(offsets, lambda o, i: F.get(offsets, i + (VOTES - 1)) == o))

        offsets = F.array_sort(F.concat(*(offsets_of(w, at) for w, at in index_words(label).items())))
        return F.array_max(F.transform(F.filter(_let(offsets, voted), verified), share))

    def found(label: str, share: Column) -> Column:
        return F.when(share.isNotNull(), F.struct(F.lit(label).alias("label"), share.alias("share")))

    def method(words: Column, present: Column, hits: Column, label: str) -> Column:
        # no offset can be verified in a text that lacks a key word
        share = _let(coverage(words, hits, label), lambda c: found(label, c))
        return F.when(has_all(present, key_words(label)), share)

    def of_hits(words: Column, present: Column, hits: Column) -> Column:
        base = [(label, places(words, hits, phrase)) for phrase, label in PHRASES.items()]
        return F.struct(
            F.array_sort(F.concat(*(x for _, x in base))).alias("places"),
            F.array_compact(F.array(*(F.when(F.size(x) > 0, F.lit(label)) for label, x in base))).alias("base"),
            F.array_compact(F.array(*(method(words, present, hits, label) for label in TEMPLATES))).alias("found"),
        )

    def of_present(words: Column, present: Column) -> Column:
        marked = F.transform(words, lambda x, i: F.when(F.array_contains(_list(marked_words), x), F.struct(x.alias("w"), i.alias("p"))))
        needed = [p.split() for p in PHRASES] + [key_words(label) for label in TEMPLATES]
        return F.when(reduce(lambda a, b: a | b, [has_all(present, n) for n in needed]), _let(F.array_compact(marked), lambda hits: of_hits(words, present, hits)))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n"), _let(_present(words, sorted({*ranked, *phrase_words})), lambda present: of_present(words, present)).alias("of"))

    held = free_name("scan", docs.columns)
    made = docs.withColumn(held, _let(_words(text), of_words))
    s = F.col(held)
    none = F.array().cast("array<string>")
    places_found, base, methods = s["of"]["places"], F.coalesce(s["of"]["base"], none), s["of"]["found"]
    best = F.array_max(F.transform(methods, lambda x: x["share"]))
    return made.withColumns({
        "n_words": s["n"],
        "n_base": F.coalesce(F.size(places_found), F.lit(0)).cast("bigint"),
        "first_word": F.array_min(places_found).cast("bigint"),
        "last_word": F.array_max(places_found).cast("bigint"),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(base)), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce(F.transform(methods, lambda x: x["label"]), none)))), ","),
        "score": F.coalesce(best, F.when(F.size(base) > 0, 0.5), F.lit(0.0)),
    }).drop(held)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, document_frequencies(docs)).drop("text")


def _sql() -> str:
    rows = ", ".join(f"('{label}', {i}, '{w}', {key})" for label, t in TEMPLATES.items() for i, (w, key) in enumerate(template_words(t)))
    phrases = " UNION ALL ".join(
        f"SELECT a.doc_id, a.p, '{label}' AS label FROM words a " + " ".join(f"JOIN words b{j} ON b{j}.doc_id = a.doc_id AND b{j}.p = a.p + {j} AND b{j}.w = '{x}'" for j, x in enumerate(phrase.split()) if j) + f" WHERE a.w = '{phrase.split()[0]}'" for phrase, label in PHRASES.items()
    )
    return rf"""
WITH template(label, pos, word, key) AS (VALUES {rows}),
lists AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(0, len(ws))) AS p, unnest(ws) AS w FROM lists),
frequency AS (SELECT w AS word, count(DISTINCT doc_id) AS df FROM words WHERE w IN (SELECT word FROM template) GROUP BY w),
indexed AS (
    SELECT label, word, pos FROM (SELECT label, word, min(pos) AS pos FROM template WHERE key GROUP BY label, word) LEFT JOIN frequency USING (word)
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY coalesce(df, 0), word) <= {VOTES}),
voted AS (
    SELECT doc_id, label, p - pos AS o FROM words JOIN indexed ON w = word GROUP BY doc_id, label, o HAVING count(*) >= {VOTES}),
verified AS (
    SELECT v.doc_id, v.label, o, count(w.w)::DOUBLE / count(*) AS share, bool_and(w.w IS NOT NULL OR NOT key) AS ok
    FROM voted v JOIN template t ON v.label = t.label LEFT JOIN words w ON w.doc_id = v.doc_id AND w.p = o + t.pos AND w.w = t.word
    GROUP BY ALL),
method AS (SELECT doc_id, label, max(share) AS share FROM verified WHERE ok GROUP BY ALL),
base AS ({phrases}),
named AS (
    SELECT doc_id, array_to_string(list_sort(list_distinct(list(label) FILTER (plain))), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
    FROM (SELECT doc_id, label, true AS plain FROM base UNION ALL SELECT doc_id, label, false FROM method) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS b FROM base GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM method GROUP BY doc_id)
SELECT lists.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, CASE WHEN n > 0 THEN 0.5 END, 0.0)::DOUBLE AS score
FROM lists LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""


OP3_SQL = _sql()
