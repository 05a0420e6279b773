"""Markov spans against a plain loop, and the model on strings that it was not trained on."""

import base64
import hashlib
import re

import pytest

from quillspark.llm import secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_samples(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def score(model, run):
    n = len(secrets.ALPHABET) + 1
    at = [secrets.ALPHABET.find(c) + 1 for c in run]
    return sum(float(f"{model[a * n + b]:.5g}") for a, b in zip(at, at[1:])) / (len(at) - 1)


def test_markov_spans_equal_a_plain_loop(spark, model):
    keys = [base64.b64encode(hashlib.sha256(f"held-{k}".encode()).digest()).decode().rstrip("=") for k in range(60)]
    rows = [(k, f"é the key {w} and /usr/local/share/words here\n{w[:20]},{w[3:]} AKIA{'ABCD' * 5} {hashlib.md5(w.encode()).hexdigest()} token={w}") for k, w in enumerate(keys)]
    rows += [(100 + k, t) for k, t in enumerate(["", "short", "x" * 70_000, "under_score_words_of_the_kind_that_people_write", keys[0] * 3000])]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, text in rows:
        assigned = [m.span() for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= secrets.ASSIGN_VALUE_LEAST]
        want = []
        for m in re.finditer(secrets.RUN, text):
            free = not any(a < m.end() and b > m.start() for a, b in assigned) and not re.search(f"{secrets.ACCESS}|{secrets.HEX}", m[0])
            if free and score(model, m[0]) > secrets.THRESHOLD:
                want.append(m.span())
        assert [(s["start"], s["end"]) for s in got[k] if s["kind"] == 3] == want


def test_strings_held_out(spark, model):
    """Random strings that no training counter gave, and identifiers of other words: nearly all are told apart."""
    digests = [hashlib.sha512(f"other-{k}".encode()).digest()[:24] for k in range(400)]
    random = [base64.b64encode(d).decode() for d in digests]
    words = "river stone window garden market letter silver winter orange school bridge planet castle forest mirror".split()
    plain = [f"{a}_{b}_{c}" for a in words for b in words[:5] for c in words[:5] if a != b] + [f"{a}/{b}/{b}{a}" for a in words for b in words]
    rows = [(k, f"see {v} there", kind) for k, (v, kind) in enumerate([(v, 1) for v in random] + [(v, 0) for v in plain if len(v) >= 16])]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, kind int"), model)
    hit = {r["doc_id"]: bool(r["spans"]) for r in found.collect()}
    share = lambda kind: sum(hit[k] for k, _, own in rows if own == kind) / sum(own == kind for _, _, own in rows)
    assert share(1) >= 0.9
    assert share(0) <= 0.1


def test_weights_count_as_repeated_rows(spark):
    once = spark.createDataFrame([("abcd", 0, 3), ("Zx9Q", 1, 2)], "value string, random int, n long")
    many = spark.createDataFrame([("abcd", 0)] * 3 + [("Zx9Q", 1)] * 2, "value string, random int")
    assert secrets.train(once) == secrets.train(many)


def test_columns_with_dots(spark, model):
    rows = spark.createDataFrame([(1, "password: hunter2x")], "`a.id` long, `a.text` string")
    got = secrets.digest(secrets.find_secrets(rows, model, "a.id", "a.text"), "a.id").collect()
    assert got[0]["a.id"] == 1 and got[0]["n_assign"] == 1
