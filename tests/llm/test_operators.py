"""The operators against brute force and exact round trips, and their defined edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from quillspark.llm import decontam, matroska, mixing, packing, quality, queries, secrets, separators, similar, simhash, tokens, urls, warc

HEX = "0123456789abcdef" * 3


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta river stone cloud light green house tower field winter summer garden window".split()) + r.choice(["", "", "s", "ed"]) for _ in range(n))


def texts():
    long = words(9, 20000)
    return [None, "", "one", "two words", words(1, 80), words(1, 80), words(1, 79) + " changed", long, f'token = "{HEX}" é AKIA{"Z" * 16}', "key " + "q7Zr9XkB2mWpL0vT3sYc8NfHdJ", words(2, 60)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, fp string, row string, node int, key string, count long, t string, gone int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 1, "x", "y", 2, "k", 3, "t", 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [(i, t, None if i == 3 else f"s{i % 3}") for i, t in enumerate(texts())]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).cache()


def bits(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_against_brute_force(docs, empty):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: bits(t) for i, t in enumerate(texts())}
    for i in prints:
        assert rows[i]["fingerprint"] == f"{prints[i]:016x}"
        reach, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in prints:
                if b not in reach and bin(prints[a] ^ prints[b]).count("1") <= 2:
                    reach.add(b)
                    todo.append(b)
        assert rows[i]["component_id"] == min(reach)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most", [40, 512])
def test_trie_join_finds_all_links(spark, most):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 30, dtype=np.uint64)
    x = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 64, 30).astype(np.uint64)) for _ in range(12)]))
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 2, 1))
    want = simhash.forest(len(x), a, b)
    got = simhash.assign(spark.createDataFrame([(i, int(v)) for i, v in enumerate(x.view(np.int64))], "id long, fp long"), 2, most).collect()
    assert {r["id"]: r["component_id"] for r in got} == dict(enumerate(want.tolist()))


def test_near_copies_leave_one(docs, empty):
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 4 in ids and 5 not in ids and 6 not in ids and {2, 3, 7, 8, 9, 10} <= ids
    assert similar.keep_one(empty).count() == 0


def exact_firsts(rows, like=0.8):
    """{id: least id of its group} by comparing all pairs."""
    sets = {i: set(similar.shingle_set(t)[1].tolist()) for i, t in rows}
    first = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= like * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((first[i], first[j]))
                first = {k: a if v == b else v for k, v in first.items()}
    return first


def test_near_copies_are_those_of_all_pairs(spark):
    own = [f"w{k}" for k in range(4000)]
    base = own[:100]
    swap = lambda w, at, n: w[:at] + own[1000 + at : 1000 + at + n] + w[at + n :]
    # Chains whose ends are below the limit: A-B and B-C are links and A-C is none.
    chain = [" ".join(w) for w in (base, swap(base, 10, 3), swap(swap(base, 10, 3), 60, 5), swap(swap(swap(base, 10, 3), 60, 5), 80, 5))]
    # A template: 40 texts of one half and of different or nearly equal other halves.
    r = random.Random(5)
    half = own[300:350]
    template = [" ".join(half + [own[2000 + 10 * (k // 4) + j + (900 * (r.random() < 0.02))] for j in range(10)] + own[2500 + 10 * (k // 4) : 2520 + 10 * (k // 4)]) for k in range(40)]
    # Near the limit on both sides.
    near = [" ".join(swap(own[600:700], 0, n)) for n in range(0, 30, 2)]
    texts_ = [t for part in (chain, template, near) for t in part] + [words(k, 50) for k in range(20)]
    rows = [(i, t) for i, t in enumerate(texts_)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = exact_firsts(rows)
    assert 1 < len(set(want.values())) < len(rows)
    for most in (similar.GROUP, 3):
        got = {x["id"]: x["first"] for x in similar.groups(df, most=most).collect()}
        assert got == want


def test_parities_rule_out_no_link():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 31, 33, 100, 700, 3000):
        for m in sorted({n, n + 1, n * 5 // 4, 3 * n}):
            for shared in (0, n // 2, n * 9 // 10, n):
                h = np.unique(r.integers(0, 2**64, n + m, dtype=np.uint64))
                a, b = h[:n], np.concatenate((h[:shared], h[n : n + m - shared]))
                differ = len(set(a.tolist()) ^ set(b.tolist()))
                assert similar.least_difference(similar.parities(a), similar.parities(b)) <= differ
                assert shared or n < 100 or similar.least_difference(similar.parities(a), similar.parities(b)) > (n + m) / 9
    none = similar.parities(np.zeros(0, dtype=np.uint64))
    assert similar.least_difference(none, none) == 0


def test_sets_of_pairs_below_the_limit_are_not_moved(spark, monkeypatch):
    # A template: two texts share 160 of their 200 shingles, a similarity of 2/3; two more are near copies.
    own = [f"w{k}" for k in range(4000)]
    rows = [(k, " ".join(own[:164] + own[1000 + 40 * k : 1040 + 40 * k])) for k in range(40)]
    rows += [(k + 40, t.replace("w" + str(1039 + 40 * k), "other")) for k, t in rows[:2]]
    moved, verified = [], similar.verified

    def seen(pairs, *rest):
        moved.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(similar, "verified", seen)
    got = {x["id"]: x["first"] for x in similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), most=16).collect()}
    assert got == exact_firsts(rows) and got[40] == 0 and got[41] == 1
    assert 2 <= sum(moved) <= 20


def test_near_copies_are_told_by_row_and_not_by_id(spark):
    a, b, c = words(1, 60), words(2, 60), words(3, 60)
    rows = [(1, a, 0), (1, b, 1), (2, c, 2), (3, a, 3), (None, b, 4), (None, words(4, 60), 5), (2, c, 6), (4, "", 7), (5, None, 8), (4, a + " more", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int").withColumnRenamed("_gone", "_id")
    got = similar.keep_one(docs.withColumn("_gone", docs["_id"])).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:20]) for r in got) == sorted([(1, a[:20]), (1, b[:20]), (2, c[:20]), (0, words(4, 60)[:20]), (4, "")])
    assert got[0]["_gone"] == got[0]["_id"]


def test_trie_pairs_are_all_pairs_of_different_roots(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 6, dtype=np.uint64)
    rows = []
    for k in range(3):
        n = 40 + 30 * k
        fps = base[r.integers(0, 6, n)] ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
        rows += [(k, 1000 * k + i, 4, int(fps.view(np.int64)[i]), 1000 * k + i % 7, n) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, node long, size long, fp long, root long, n long")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4] and bin((a[3] ^ b[3]) & simhash.MASK).count("1") <= 9}
    for most in (256, 16):
        got = [(x["a"], x["b"]) for x in similar.trie_pairs(df, most, 9).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_the_budget_of_the_tries_spares_pairs_of_the_limit():
    r = np.random.default_rng(2)
    for n in (4, 5, 8, 20, 100):
        for _ in range(400):
            shared = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)
            more = r.integers(0, 2**63, n // 4, dtype=np.uint64)
            a, b = simhash.simhash(shared), simhash.simhash(np.concatenate((shared, more)))
            assert bin(a ^ b).count("1") <= similar.BITS


def base_spans(t):
    found = []
    for m in re.finditer(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(found))


def test_secrets(spark, docs, empty):
    extra = ["é" * 5 + ' password: "abcdef" token=x1 secret = tok_12345 ' + "f" * 24, "AKIA" + "A" * 15 + " AKIA" + "B" * 40, "API_KEY=" + HEX]
    rows = frame(spark, [(i, t, "s") for i, t in enumerate(texts() + extra)])
    model = secrets.train(secrets.labelled_samples(docs))
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(rows, model)).collect()}
    for i, t in enumerate(texts() + extra):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert got[9]["spans"] == "markov:4:30" and not any(got[i]["n_markov"] for i in (2, 3, 4, 7))
    assert secrets.digest(secrets.find_secrets(empty, model)).count() == 0
    assert not any(secrets.train(secrets.labelled_samples(empty).where("random = 0")))


def test_matroska_round_trip(docs, empty):
    got = {r["doc_id"]: r for r in matroska.store_texts(docs, keep_media=True).collect()}
    for i, t in enumerate(texts()):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
    assert got[4]["media_sha256"] == got[5]["media_sha256"]
    assert matroska.store_texts(empty).count() == 0


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_matroska_lacing_and_unknown_sizes(lacing):
    parts = [b"a" * 300, b"b" * 300, b"c" * 300] if lacing == 2 else [b"a" * 300, b"b" * 255, b"c" * 7]
    sizes = [len(p) for p in parts]
    head = {0: b"", 1: b"\x02" + b"\xff\x2d" + b"\xff\x00", 2: b"\x02", 3: b"\x02" + matroska.lace_sizes(sizes)}[lacing]
    parts = parts[:1] if lacing == 0 else parts
    block = b"\x81\x00\x05" + bytes([0x80 | lacing << 1]) + head + b"".join(parts)
    cluster = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + matroska.element(matroska.CLUSTER_TIMESTAMP, b"\x0a") + matroska.element(matroska.SIMPLE_BLOCK, block)
    track = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK_ENTRY, matroska.element(matroska.TRACK_NUMBER, b"\x01") + matroska.element(matroska.CODEC_ID, b"V_X")))
    data = b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + track + cluster + cluster
    m = matroska.parse(data)
    assert [data[p[2] : p[3]] for p in m.packets] == parts * 2
    assert {p[1] for p in m.packets} == {15_000_000}
    assert len(matroska.parse(data[:-400]).packets) < 2 * len(parts) + 1 and matroska.parse(b"").packets == []


def test_packing_round_trip(docs, empty):
    full = tokens.encoder()
    want = {i: full.encode(t or "") + np.array([tokens.EOD], "<u2").tobytes() for i, t in enumerate(texts())}
    back = {}
    for r in packing.pack(docs, length=128).collect():
        ids, places = (x[0] for x in packing.matrix([r]))
        for k, (i, o) in enumerate(zip(r["doc_ids"], r["doc_offsets"], strict=True)):
            a, b = r["cu_seqlens"][k : k + 2]
            back.setdefault(i, {})[o] = ids[a:b].tobytes()
            assert places[a:b].tolist() == list(range(b - a))
    assert {i: b"".join(p for _, p in sorted(x.items())) for i, x in back.items()} == want
    assert packing.pack(empty).count() == 0


def test_best_fit_decreasing_against_scan():
    r = random.Random(5)
    for _ in range(20):
        sizes = [r.randint(1, 40) for _ in range(60)]
        rows, free = [], []
        for k in sorted(range(60), key=lambda i: (-sizes[i], i)):
            fits = [f for f in free if f >= sizes[k]]
            if fits:
                free.remove(min(fits))
            free.append((min(fits) if fits else 40) - sizes[k])
        rows = packing.best_fit_decreasing(sizes, 40)
        assert sorted(40 - sum(sizes[k] for k in x) for x in rows) == sorted(free)


@pytest.mark.parametrize("block", [1, 7, 65_536])
def test_separators(docs, empty, block, monkeypatch):
    monkeypatch.setattr(separators, "SUPER", 5)
    small = docs.where("doc_id <> 7") if block == 1 else docs
    got = separators.stitch(separators.find_separators(separators.write_flat(small, block=block))).collect()
    full = tokens.encoder()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(full.encode(t or "")) // 2 for i, t in enumerate(texts()) if block > 1 or i != 7}
    assert separators.token_counts(empty).count() == 0


def test_open_document_at_the_end(spark):
    data = np.array([1, 2, tokens.EOD, 3, 4, 5], "<u2").tobytes()
    files = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    got = separators.stitch(separators.find_separators(separators.cut_blocks(files, block=2))).orderBy("ordinal").collect()
    assert [(r["start"], r["n_tokens"], r["ends"]) for r in got] == [(0, 2, True), (3, 3, False)]


def test_decontamination(spark, docs, empty):
    passage = words(77, 40)
    edited = passage.replace("e", "3", 2)
    rows = frame(spark, [(0, words(3, 50) + " " + passage.upper() + "! " + words(4, 50), "s"), (1, edited, "s"), (2, words(5, 300), "s"), (3, None, "s"), (4, passage[: len(passage) // 2], "s")])
    bench = spark.createDataFrame([(5, passage), (6, None), (7, "tiny"), (8, passage)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(rows, bench).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {0, 1}
    assert got[0]["item_ids"] == [5, 8] and got[1]["hits"][0]["edits"] == 2
    kept = decontam.keep_clean(rows, bench)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4}
    assert decontam.contamination(empty, bench).count() == 0 and decontam.keep_clean(rows, bench.limit(0)).count() == 5


def test_alignment_against_full_table():
    r = random.Random(4)

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(60):
        p = [r.choice("abc") for _ in range(r.randint(5, 25))]
        t = [r.choice("abc") for _ in range(r.randint(0, 6))] + [c for c in p if r.random() > 0.1] + [r.choice("abc") for _ in range(r.randint(0, 6))]
        found = decontam.align(np.array([ord(c) for c in p], np.uint32), np.array([ord(c) for c in t], np.uint32), -len(p), len(t), 99)
        assert found[0] == least(p, t) and least(p, t[found[1] : found[2]]) == found[0]


def test_warc(spark):
    page = "<html><head><title>A &amp; B</title><script>x<y</script></head><body><p>One<br>two &lt;3</p><a href='/l?a=1&amp;b=2'>link</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a.com/x", page, "z"), (2, None, None, "z"), (3, "http://a.com/x", page, "z")], "page_id long, url string, html string, record string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 6
    first = {r["kind"]: r for r in rows if r["page_id"] == 1}
    headers, block = warc.read_record(bytes(first["conversion"]["record"]))
    assert block.decode() == "A & B\nOne\ntwo <3\nlink" and dict(headers)["WARC-Refers-To"] == first["metadata"]["refers_to"]
    assert first["conversion"]["record_id"].encode() in bytes(first["metadata"]["record"]) and dict(headers)["WARC-Block-Digest"] == warc.digest(block)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0 and warc.derive(b"nothing") == []
    joined = spark.createDataFrame([(bytearray(b"".join(bytes(r["record"]) for r in rows)),)], "content binary")
    assert warc.read_records(joined).count() == 6


def test_urls(spark):
    given = ["https://WWW.Casino-Win.example.com/en/12?x=1", "http://example.com/en/7", "http://sub.example.net/de/81#a", "http://a.org?x", None, "nothing", "http://de.net/de/1", "http://good.example.org/fr/1"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(given * 20)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(8)] == [
        ("www.casino-win.example.com", "/en/12", "com/en/"), ("example.com", "/en/7", "example.com/en/7"), ("sub.example.net", "/de/81", "example.net/de/8"), ("a.org", "", None), ("", "", None), ("", "", None), ("de.net", "/de/1", "net/de/"), ("good.example.org", "/fr/1", None),
    ]
    assert [got[i]["verdict"] for i in (0, 1, 2, 6, 7)] == ["block", "allow", "block", "allow", "allow"]
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_boosting_learns():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = urls.Boosted.fit(x[:1500], y[:1500])
    assert ((m.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_mixing(spark, empty):
    rows = [(i, words(i, 10 + i % 7), "big" if i % 3 else f"s{i % 4}") for i in range(900)] + [(5000, None, None), (5000, None, None), (5001, "one", None)]
    docs = frame(spark, rows)
    got = mixing.mix(docs, block_docs=16).toPandas()
    assert set(got.doc_id) == {r[0] for r in rows}
    drawn = got.groupby(got.source.fillna("null")).agg(t=("n_tokens", "sum"), w=("weight", "max"), p=("passes", "max"))
    assert drawn.p.min() == 1 and drawn.p.max() <= 2 + 1e-9
    assert np.allclose(drawn.t / drawn.t.sum(), drawn.w, atol=0.02)
    again = mixing.mix_documents(docs, block_docs=16)
    assert again.columns == docs.columns and sorted(r["doc_id"] for r in again.collect()) == sorted(got.doc_id)
    cut = mixing.mix(docs, budget=2000, block_docs=16).toPandas()
    assert 1900 <= cut.n_tokens.sum() <= 2200 and mixing.mix(empty).count() == 0
    shares = drawn.w.to_numpy()
    assert mixing.find_exponent(mixing.source_totals(docs.selectExpr("source", "1L n_tokens")), entropy=99.0) == 0 and abs(shares.sum() - 1) < 1e-9


def test_quality(spark, empty):
    bad = [" ".join(f"{w}###" for w in words(i, 30).split()) for i in range(30)] + [" | ".join(words(i, 40).split()) for i in range(30)]
    toxic = [words(i, 20) + " vilehound " + words(i + 500, 20) + " grubface " + words(i + 900, 20) for i in range(40)]
    good = [words(i + 100, 60) + "." for i in range(200)]
    rows = [(i, t, "s") for i, t in enumerate([*bad, *toxic, *good, None, ""])]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(60 <= i < 100)) for i in range(0, 290, 2)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, model).collect()}
    assert not any(got[i] for i in range(100)) and all(got[i] for i in range(100, 302))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 202
    assert quality.classify(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]


def test_url_suffixes_are_counted_over_all_rows(spark, monkeypatch):
    hosts = [f"a{k}.{'casino' if k % 3 == 0 else 'plain'}{k % 7}.com" for k in range(200)]
    pages = spark.createDataFrame([(k, f"https://{h}/x") for k, h in enumerate(hosts)] + [(900, None)], "page_id long, url string")
    rows = urls.seed_labels(urls.split_urls(pages))
    few = urls.fit(rows, most=10)
    want = {urls.suffix(h): sum(urls.suffix(g) == urls.suffix(h) for g in hosts) for h in hosts} | {"": 1}
    assert {r["suffix"]: r["n"] for r in few["suffixes"].collect()} == want
    whole = sorted(tuple(r) for r in urls.score(rows, few).collect())
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 3)
    assert sorted(tuple(r) for r in urls.score(rows, few).collect()) == whole and len(whole) == 201
