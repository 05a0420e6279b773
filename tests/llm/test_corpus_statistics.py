"""Frequent lines, Merkle manifests and phrases against their SQL over hostile tables and given ones."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lines, merkle, oracle, phrases
from quillspark.llm import queries as registered
from tests.test_oracle import table_of

WORDS = [a + b for a in "ba do ki lu me".split() for b in ("", "n", "rt", "s", "ño")]


def prose(rng, n):
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS).title() if rng.random() < 0.1 else rng.choice(WORDS))
        out.append("\n" if k % 11 == 10 else rng.choice([" ", " ", " ", " ", "  ", ", ", ". ", "\t"]))
    return "".join(out)


def hostile():
    """Rows of null, empty, white, very long, repeated and copied texts; a host and a language with most rows; ties of ids."""
    rng = random.Random(3)
    footer, common = "Read More At Our Site 2024 Today", "  read more  at our site 7 today "
    rows = []
    for i in range(260):
        text = prose(rng, rng.choice([0, 3, 30, 60, 200]))
        if i % 3 == 0:
            text += "\n" + (footer if i % 2 else common)
        if i % 10 == 0:
            text = "\n".join([footer] * 9 + ["one two three four five six seven"] * 2)
        rows.append((i, text, "en" if i % 4 else "de", "hot" if i % 2 else f"s{i % 5}"))
    rows += [(300 + k, prose(random.Random(1), 90), "en", "copies") for k in range(40)]
    rows += [(905, None, "en", "hot"), (906, "", "fr", None), (907, " \n\t ", None, "s1"), (None, "Null id, null source " * 20, "fr", None), (None, "Null id, null source " * 20, "fr", None)]
    rows += [(900, prose(random.Random(2), 40_000), "en", "hot"), (901, "x" * 50_000, "one", "s1"), (902, "the same words " * 6000, None, "s2"), (903, "Ünïcode ſtraße 😀 A.B,C\x0bd\x0ce\rf " * 40, "de", "s3")]
    rows += [rows[4]] * 3
    return rows


@pytest.fixture(scope="module")
def hard(spark):
    rows = hostile()
    # Columns whose names the operators use inside, and one with a dot.
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, line string, row int, lines string, tree int, place int, hash string, key string, f int, `a.b` int"
    full = [(*r, len(r[1] or "") if r[0] != 907 else None, "x", 1, "x", 1, 1, "x", "x", 1, 1) for r in rows]
    con = duckdb.connect()
    con.register("documents", pa.table({n: [r[k] for r in full] for k, n in enumerate(("doc_id", "text", "lang", "source", "n_chars"))}))
    return spark.createDataFrame(full, schema).repartition(7), con


def equal(frame, con, sql):
    found = con.execute(sql)
    want = table_of([c[0] for c in found.description], found.fetchall())
    have = table_of(frame.columns, frame.collect())
    assert have[0] == want[0]
    assert have[1] == want[1]


@pytest.mark.parametrize("run,sql", [(lines.judge, oracle.LINES), (merkle.manifest, oracle.MERKLE), (phrases.collocations, oracle.PHRASES)])
def test_hostile_rows_equal_sql(hard, run, sql):
    equal(run(hard[0]), hard[1], sql)


@pytest.mark.parametrize("run", [lines.judge, lines.clean, merkle.manifest, phrases.collocations])
def test_empty_table(hard, run):
    assert run(hard[0].where("false")).collect() == []


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_registered_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    equal(registered.queries()[name](spark, sf), con, registered.oracle_sql()[name])


def test_lines_are_removed_and_depleted_documents_rejected(hard):
    got = {r["doc_id"]: r for r in lines.judge(hard[0]).collect()}
    assert any(r["n_removed"] and r["kept"] for r in got.values())
    assert not any(got[i]["kept"] for i in range(10, 260, 10))
    # Copies alone make no line frequent.
    assert all(got[300 + k]["n_removed"] == 0 for k in range(40))
    cleaned = lines.clean(hard[0])
    assert cleaned.columns == hard[0].columns
    before, after = ({r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in (hard[0], cleaned))
    assert cleaned.count() == hard[0].count()
    for i, r in got.items():
        if not r["n_removed"]:
            assert after[i] == before[i]
        else:
            assert len(before[i].split()) - len(after[i].split()) == r["n_removed"]


def test_many_repeated_windows(spark):
    """Texts with few and with very many repeated windows, against a plain count."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (1, 2, 3, 4, 50, 120, 400, 5000)] + ["p q r s p q r", "z z z z", "a b c x a b c"]
    got = {r["id"]: r["n_repeat_words"] for r in lines.read_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))).collect()}
    for i, text in enumerate(texts):
        w, seen, hit = text.split(), {}, set()
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                hit.update(p + d for p in places for d in (0, 1, 2))
        assert got[i] == len(hit)


def _fold(rows):
    while len(rows) > 1:
        rows = [hashlib.sha256("".join(rows[k : k + 8]).encode()).hexdigest() for k in range(0, len(rows), 8)]
    return rows[0]


def test_merkle_over_several_blocks(spark):
    """Trees of one, many and just over whole blocks; blocks of 8 and 64 leaves give the roots of plain recursion."""
    ids = [(i, f"t{i}", "big", "s", i) for i in range(700)] + [(i, f"u{i}", "whole", "s", i) for i in range(512)] + [(1, "v", "lone", "s", 1)]
    docs = spark.createDataFrame(ids, "doc_id long, text string, lang string, source string, n_chars long")
    leaf = lambda r: hashlib.sha256("".join(f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], r[1])).encode()).hexdigest()
    subroots = {t: _fold([leaf(r) for r in ids if r[2] == t]) for t in ("big", "whole", "lone")}
    root = _fold([subroots[t] for t in sorted(subroots)])
    frames = [merkle.manifest(docs, depth=depth) for depth in (1, 2)]
    rows = [sorted(map(tuple, f.collect())) for f in frames]
    assert rows[0] == rows[1] and len(rows[0]) == len(ids)
    assert {r[2] for r in rows[0]} == set(subroots.values()) and {r[3] for r in rows[0]} == {root}
    for r in rows[0]:
        # Tampering shows where the text holds a capital; these hold none.
        assert r[6]
    changed = merkle.manifest(docs.withColumn("text", F.upper("text")), depth=2)
    assert {r["doc_id"] for r in changed.where("not verified").collect()} == {i for i in range(700) if zlib.crc32(str(i).encode()) % 3 == 0}


def test_words_that_share_an_id_take_another_seed(spark):
    docs = spark.createDataFrame([("en", "one two one two three")] * 40, "lang string, text string")
    words, _, seed = phrases.dictionary(docs)
    assert seed == 0 and words.count() == 3
    ids = np.array([7, 9, 7], np.uint64)
    tokens = object.__new__(phrases._Tokens)
    tokens.data, tokens.start, tokens.stop, tokens.id = np.frombuffer(b"aa bb cc", np.uint8), np.array([0, 3, 6]), np.array([2, 5, 8]), ids
    assert not tokens.same_word(np.array([0, 1, 0]))
    assert tokens.same_word(np.array([0, 1, 2]))


def test_run_lengths_with_equal_prefixes():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 4000).astype(np.uint64) << np.uint64(50), rng.integers(0, 9, 4000).astype(np.uint64)
    mixed = (a ^ b) & np.uint64(3)
    columns, prefix, n = phrases._run_lengths([a, b], mixed, np.ones(4000, np.int64))
    want = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        want[x, y] = want.get((x, y), 0) + 1
    assert dict(zip(zip(columns[0].tolist(), columns[1].tolist(), strict=True), n.tolist(), strict=True)) == want
    assert (np.diff(prefix.astype(np.int64)) >= 0).all()


def test_long_texts_are_cut_at_breaks_only(hard, monkeypatch):
    rows = [r for r in hostile() if r[1]]
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows], "text": [r[1] for r in rows]})
    count = lambda: {(b["lang"][k].as_py(), b["word"][k].as_py()): 0 for b in phrases._count_words(0)(iter([batch])) for k in range(b.num_rows)}
    whole = count()
    monkeypatch.setattr(phrases, "PART_BYTES", 64)
    assert count() == whole
