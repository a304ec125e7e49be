import plain
import pytest
from plain import TEXTS

from haulframe.llm import license_scan as ls

CASES = [
    (100, "Licensed under the Apache License, Version 2.0.", "apache", "apache,apache-2.0", 1),
    (101, "x " * 500 + "This work is licensed under the GNU\nGeneral-Public *License*, version 3!", "gpl", "gpl,gpl-3.0", 1),
    (102, "apache license apache license cc by", "apache,cc-by", "apache,cc-by", 3),
    (103, "Permission is hereby granted, free of charge, to any person obtaining a copy", "", "mit-terms", 0),
    (104, "Permission was hereby granted, free of charge, to any person obtaining a copy", "", "", 0),
    (105, "apache\u212a license, mit\u00e9 license, MIT LICENSE", "mit", "mit", 1),
    (106, "released under the mit license and licensed under cc by-nc 4.0", "cc-by,mit", "cc-by,cc-by-nc-4.0,mit,mit-notice", 2),
]


def test_cases(spark):
    docs = spark.createDataFrame([(d, t) for d, t, *_ in CASES], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ls.scan(docs, ls.document_frequencies(docs)).collect()}
    for d, t, base, labels, n in CASES:
        assert (got[d]["base_labels"], got[d]["labels"], got[d]["n_base"], got[d]["n_words"]) == (base, labels, n, len(plain.alnum_words(t))), d
    assert (got[101]["first_word"], got[101]["last_word"]) == (506, 506) and got[103]["first_word"] is None
    assert 0.2 < got[100]["score"] < 0.5 and got[106]["score"] == 1 and got[102]["score"] == 0.5 and got[104]["score"] == 0


def test_odd_rows(odd, none):
    got = ls.scan(odd, ls.document_frequencies(odd))
    assert set(odd.columns) <= set(got.columns)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["labels"], r["score"]) for r in got.collect()) == sorted((str(d), len(plain.alnum_words(t)), 0, "", 0.0) for d, t in TEXTS)
    assert ls.scan(none, ls.document_frequencies(none)).count() == 0


def test_frequencies_are_of_documents(spark):
    docs = spark.createDataFrame([("gnu gnu GNU",), ("gnu",), ("of the",), (None,)], "text string")
    found = ls.document_frequencies(docs)
    assert (found["gnu"], found["of"], found["apache"]) == (2, 1, 0)
    ranked = ls.by_rarity(found)
    assert ranked.index("released") < ranked.index("of") < ranked.index("gnu") == len(ranked) - 1


def test_every_template_finds_itself(spark):
    texts = [(label, f"some words before; {' '.join(w for w, _ in ls.template_words(t))} and after") for label, t in sorted(ls.TEMPLATES.items())]
    docs = spark.createDataFrame(texts, "want string, text string")
    for row in ls.scan(docs, ls.document_frequencies(docs)).collect():
        assert row["want"] in row["labels"].split(",") and row["score"] == 1


def test_columns_named_like_helpers_stay(spark):
    docs = spark.createDataFrame([("mit license", "a", "b")], "text string, scan string, __scan string")
    row = ls.scan(docs, ls.document_frequencies(docs)).head()
    assert (row["scan"], row["__scan"], row["base_labels"]) == ("a", "b", "mit")


def test_text_that_holds_all_notices_gets_all_labels(spark):
    notices = [" ".join(w for w, _ in ls.template_words(t)) for t in ls.TEMPLATES.values()]
    others = [(" ".join(notices[i:] + notices[:i]),) for i in range(0, len(notices), 5)]
    docs = spark.createDataFrame([("start; " + "; then ".join(notices),), *others], "text string")
    for row in ls.scan(docs, ls.document_frequencies(docs)).collect():
        assert set(row["labels"].split(",")) >= set(ls.TEMPLATES) and row["score"] == 1


def test_text_that_begins_with_the_key_phrase(spark):
    docs = []
    for label, t in sorted(ls.TEMPLATES.items()):
        parts = ls.template_words(t)
        first = [key for _, key in parts].index(True)
        docs.append((label, " ".join(w for w, _ in parts[first:]), (len(parts) - first) / len(parts)))
    docs.append(("", "license version 2 0", 0.0))
    docs = spark.createDataFrame(docs, "want string, text string, share double")
    for row in ls.scan(docs, ls.document_frequencies(docs)).collect():
        assert row["want"] in row["labels"].split(",") and abs(row["score"] - row["share"]) < 1e-9, row["want"]
