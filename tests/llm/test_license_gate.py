"""Every rule's own names pass the gate and are found with nothing around them."""

import itertools
import re
from re import _parser

import pytest

from ledgerline.llm import license_scan


def forms(pattern) -> list[str]:
    """Strings of a rule's pattern: every branch, optional parts left out and taken."""

    def of(parts):
        return ["".join(x) for x in itertools.product(*map(one, parts))]

    def one(part):
        kind, value = str(part[0]), part[1]
        if kind == "LITERAL":
            return [chr(value)]
        if kind == "IN":
            return [chr(value[0][1][0] if str(value[0][0]) == "RANGE" else value[0][1])]
        if kind == "BRANCH":
            return [x for branch in value[1] for x in of(branch)]
        if kind == "SUBPATTERN":
            return of(value[3])
        if kind == "ANY":
            return ["x"]
        if kind in ("MAX_REPEAT", "MIN_REPEAT"):
            return ([""] if value[0] == 0 else []) + [x * max(value[0], 1) for x in of(value[2])]
        assert kind == "ASSERT", kind
        return [""]

    return of(_parser.parse(pattern))


@pytest.fixture(scope="module")
def names():
    """Of every family the bare names, and the names with a version."""
    return sorted({(x.strip(), label) for label, priority, _, pattern in license_scan.rules() if priority in (1, 3) for x in forms(pattern)})


GATE = license_scan.gate(license_scan.rules())


def test_gate_and_keywords_hold_every_rule():
    for _, priority, keyword, pattern in license_scan.rules():
        for text in forms(pattern) if "identifier" in pattern or "licenced" not in pattern else []:
            assert re.search(GATE, text) and keyword in f"{text} ", (text, keyword)


def test_gate_holds_every_name(names):
    for text, _ in names:
        for separator in " -\n":
            assert re.search(GATE, text.replace(" ", separator).upper()), text


def test_names_alone_are_found(spark, names):
    rows = [(i, text.title()) for i, (text, _) in enumerate(names)]
    found = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    for i, (text, label) in enumerate(names):
        assert found[i].score > 0 and found[i].detections, (text, label)


def test_texts_of_licences(spark):
    texts = {1: "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")", 2: "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided", 3: "This is WTFPL code", 4: "is free and unencumbered software released into the public domain", 5: "nothing of the kind is used here, only prose"}
    got = {r.doc_id: r.labels for r in license_scan.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "bsd", 3: "wtfpl", 4: "public-domain,unlicense", 5: ""} or got[4] == "public-domain"


def test_given_rules_need_no_gate(spark):
    docs = spark.createDataFrame([(1, "Some House-Rules apply")], "doc_id long, text string")
    assert license_scan.license_scan(docs, table=[("house", 1, "house", " house rules(?= )")]).first().labels == "house"
