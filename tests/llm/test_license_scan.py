"""License scan against brute force."""

import random
import re

from pixelloom.llm.license_scan import BASE, license_scan

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base(t):
    w = words(t)
    found = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases_as_by_brute_force(spark):
    r = random.Random(6)
    bits = ["GNU", "general", "Public", "LICENSE", "apache", "Apache License", "cc-by", "CC", "BY", "mit", "MIT license,", "gnu general public license", "été", "mİt license", "mit licenKe", "x", "\n", "...", "_"]
    rows = [(i, r.choice(["", "("]) + " ".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(150)] + [(500, None), (501, ""), (502, "mit license " * 2000)]
    got = {x.doc_id: x for x in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == base(t), t
        assert set(x.base_labels.split(",")) <= set(x["labels"].split(",")) | {""} and 0 <= x.score <= 1


def test_notices(spark):
    rows = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"),
        (2, "Permission is hereby granted, free of charge, to any person getting a copy of this software and"),
        (3, "Permission is hereby granted, paid for, to any person obtaining a copy of this software and"),
        (4, "x Licensed under the Apache License, Version 2.0 (the"),
        (5, "nothing to see"),
    ]
    got = {x.doc_id: (x["labels"], x.n_base) for x in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit-notice", 0), 2: ("mit-notice", 0), 3: ("", 0), 4: ("apache,apache-2.0", 1), 5: ("", 0)}


def test_other_sentences_take_nothing_away(spark):
    """Whatever stands beside a notice, also its rarest words, it keeps its label and score."""
    notice = "Permission is hereby granted, free of charge, to any person getting a copy of this software and"
    beside = ["", "We had trouble obtaining parts.", "obtaining " * 50, "hereby granted software", "free of charge is not free of charge"]
    rows = [(2 * i, f"{b} {notice}") for i, b in enumerate(beside)] + [(2 * i + 1, f"{notice} {b}") for i, b in enumerate(beside)] + [(100 + i, "obtaining licenses hereby granted free charge person") for i in range(7)]
    got = {x.doc_id: (x["labels"], x.score) for x in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(2 * len(beside))} == {got[0]} and got[0][0] == "mit-notice" and all(got[100 + i] == ("", 0) for i in range(7))


def test_odd_tables(spark):
    schema = "doc_id long, text string, w string, row int, label string"
    assert license_scan(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "cc by", "a", 1, "b"), (1, "cc by", "a", 1, "b"), (1, "cc by", "a", 1, "b")]
    df = license_scan(spark.createDataFrame(rows, schema))
    assert sorted(str(x.doc_id) + str(x.n_base) for x in df.collect()) == ["11", "11", "None1"]
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
