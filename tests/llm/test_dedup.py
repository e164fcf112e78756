"""Exact, substring and near deduplication and embeddings against brute force, with nulls, ties, repeats and odd columns."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowspark.llm import embedding_dedup, exact_dedup, minhash, queries, substring_dedup
from knowspark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def table_docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# Exact


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        key = (t or "").translate({c: None for c in (9, 10, 11, 12, 13, 32)})
        groups[key].append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for key, g in groups.items():
        keep = min(g)[3]
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, keep, len(g), i == keep, sha) for *_, i in g]
    return sorted(out, key=repr)


EXACT = [(5, "a b"), (3, "ab"), (4, "a b "), (1, None), (2, ""), (9, " \t\n"), (None, "only"), (None, "ab"), (7, "é b"), (8, "éb"), (6, "x" * 50_000), (10, "x" * 50_000), (11, "ab"), (11, "ab"), (12, "a b")]


def exact_rows(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=repr)


def test_exact_groups(spark):
    assert exact_rows(exact_dedup.exact_groups(docs(spark, EXACT))) == brute_exact(EXACT)
    assert exact_dedup.exact_groups(docs(spark, EXACT).limit(0)).count() == 0


def test_exact_spills(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    rng = random.Random(1)
    rows = [(i, f"text {rng.randint(0, 400)} " * 5) for i in range(3000)]
    df = docs(spark, rows).withColumn("group_size", F.lit(1)).withColumn("content_hash", F.lit("x"))
    out, n, _ = exact_dedup.exact_classes(df, budget=20_000)
    want = {i: size for i, keep, size, kept, _ in brute_exact(rows) if kept}
    assert {r.doc_id: r[n] for r in out.collect()} == want
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want)
    assert not any(d.startswith("grace-") for d in os.listdir(tmp_path))


def test_grace_table_matches_a_dict():
    rng = random.Random(2)
    grace = exact_dedup.GraceTable(lambda a, b: (a[0] + b[0],), budget=3000)
    want = defaultdict(int)
    for _ in range(4000):
        k = str(rng.randint(0, 900)).encode()
        want[k] += 1
        grace.add(int.from_bytes(hashlib.sha256(k).digest()[:8]), k, (1,), 10)
    assert {k: v[0] for _, k, v in grace.results()} == want


def test_exact_query(spark, duck, sf):
    from compare import frame_rows, sql_rows

    assert frame_rows(queries.op1_exact_dedup(spark, sf)) == sql_rows(duck, queries.ORACLE["op1_exact_dedup"])


# Substrings


def brute_substring(rows, window=20):
    order = sorted(((i is None, i or 0, (t or "").encode().split()) for i, t in rows), key=lambda r: r[:2])
    first = {}
    for none, i, w in order:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (none, i, k)), (none, i, k))
    out = []
    for none, i, w in order:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (none, i, k):
                gone[k : k + window] = [True] * window
        out.append((None if none else i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def substring_rows(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()], key=repr)


def test_substring_cases(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(40)]
    for i in (3, 11, 12, 30):  # at every offset
        rows[i] = (i, " ".join(rng.choice(words) for _ in range(i)) + " " + passage + "\ttail " + str(i))
    rows += [(50, passage + " " + passage), (51, "a " * 100), (52, None), (53, ""), (54, passage), (54, passage), (None, passage), (55, " ".join(passage.split()[:19])), (56, "é x " * 30)]
    assert substring_rows(substring_dedup.digests(docs(spark, rows))) == brute_substring(rows)
    assert substring_dedup.digests(docs(spark, rows).limit(0)).count() == 0


def test_cover_aligns_every_shift():
    d, p = substring_dedup.COVER, substring_dedup.PERIOD
    for shift in range(p):
        assert any((x + shift) % p in d for x in d)


def test_substring_query(spark, sf):
    assert substring_rows(queries.op2_substring_dedup(spark, sf)) == brute_substring(table_docs(spark, sf))


def test_substring_filter(spark):
    long = " ".join(f"x{i}" for i in range(30))
    df = docs(spark, [(1, long), (2, long), (3, long + "  own words"), (4, "a  b"), (5, None)]).withColumn("kept_text", F.lit("mine"))
    out = {r.doc_id: r for r in substring_dedup.substring_filter(df).collect()}
    assert set(out) == {1, 3, 4, 5} and out[3].text == "own words" and out[3].n_chars == 9
    assert out[4].text == "a  b" and out[5].text is None and out[1].kept_text == "mine"


# Near copies


def shingle_set(text):
    """The multiset of shingles; the k-th time of one is an element of its own."""
    w = (text or "").encode().split()
    seen = Counter()
    out = set()
    for k in range(max(1, len(w) - 4)):
        g = tuple(w[k : k + 5])
        if g:
            out.add((g, seen[g]))
            seen[g] += 1
    return frozenset(out)


def brute_near(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders[x].add(n)
    for n, (i, s) in enumerate(sets):
        for m in {m for x in s for m in holders[x] if m < n}:
            j, o = sets[m]
            if len(s & o) * 100 >= 80 * len(s | o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def near_rows(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_near_chains(spark):
    """Copies with ever more edits, so that classes hang together by links between their members only."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 500)}"
    rows, n = [], 0
    for length in (40, 80, 200):
        base = [word() for _ in range(length)]
        for edits in list(range(0, 12)) * 3:
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(length)] = word()
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, "a b c"), (n + 1, "a b  c"), (n + 2, "a b"), (n + 3, ""), (n + 4, None)]
    got = near_rows(minhash.near_classes(docs(spark, rows)))
    assert got == brute_near(rows)
    assert minhash.near_classes(docs(spark, rows).limit(0)).count() == 0


def thue_morse(n):
    """The sequence of 0 and 1 as two words that collide under every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_of_one_polynomial_hash(spark):
    x, y = thue_morse(1024)
    tail = " ".join(f"w{i}" for i in range(25))
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} x y z"), (4, f"{y} x y z"), (5, f"{x[:60]} p q r"), (6, f"{y[:60]} p q r")]
    assert substring_rows(substring_dedup.digests(docs(spark, rows))) == brute_substring(rows)
    assert near_rows(minhash.near_classes(docs(spark, rows))) == brute_near(rows)


def test_near_counts_how_often(spark):
    line = "one two three four five six seven. "
    rows = [(1, line * 50), (2, line * 49), (3, line * 20), (4, line * 19 + "eight"), (5, line), (6, line * 2)]
    got = near_rows(minhash.near_classes(docs(spark, rows)))
    assert got == brute_near(rows) and got[2] == 1 and got[3] == 3 and got[4] == 3 and got[5] == 5


def test_one_text_of_many_words(spark):
    rng = random.Random(12)
    words = [str(rng.randint(0, 10**9)) for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:280_000])), (3, "a " * 400_000), (4, "a " * 399_999 + "b"), (5, " ".join(words[5000:5030]))]
    assert substring_rows(substring_dedup.digests(docs(spark, rows))) == brute_substring(rows)
    assert near_rows(minhash.near_classes(docs(spark, rows))) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_digests_ignore_other_columns(spark):
    df = docs(spark, [(1, "a b"), (2, None)])
    for name in ("n_words", "n_removed", "kept_text", "kept_sha256", "block", "id"):
        df = df.withColumn(name, F.lit("mine"))
    assert [r[:3] for r in substring_rows(substring_dedup.digests(df))] == [(1, 2, 0), (2, 0, 0)]
    assert near_rows(minhash.near_classes(df)) == {1: 1, 2: 2}


def test_many_blocks(spark, monkeypatch):
    """A hundred times the blocks: the same result, no more partitions, and each hash still goes out once."""
    rng = random.Random(13)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + (" " + passage if i % 7 == 0 else "")) for i in range(300)]
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 100)
    blocks, parts, buckets = substring_dedup.layout(docs(spark, rows).select("text"), "text")
    assert blocks >= 100 and parts == 2 * spark.sparkContext.defaultParallelism and buckets == 4 * parts
    assert substring_rows(substring_dedup.digests(docs(spark, rows))) == brute_substring(rows)
    assert near_rows(minhash.near_classes(docs(spark, rows))) == brute_near(rows)
    h = np.sort(rng_hashes(1000))
    for n in (10, 10_000_000):
        sent = list(substring_dedup.stretches(h, n))
        assert len(sent) <= len(h) and sum(z - a for _, a, z in sent) == len(h) and all((substring_dedup.bucket_of(h[a:z], n) == b).all() for b, a, z in sent)


def rng_hashes(n):
    return np.random.default_rng(1).integers(0, 1 << 64, n, dtype=np.uint64)


def test_stretches_of_hashes(monkeypatch):
    """Buckets worked off a stretch at a time give what one pass gives."""
    import pyarrow as pa

    h = rng_hashes(5000)
    r = np.random.default_rng(2)
    parts = [np.sort(r.choice(h, 1500, replace=False)) for _ in range(6)]
    table = pa.table({"block": pa.array(range(6), pa.int32()), "hashes": pa.array([p.tobytes() for p in parts], pa.binary())})

    def answers():
        out = defaultdict(set)
        for row in substring_dedup.answer_repeats(table).to_pylist():
            out[row["block"]] |= set(np.frombuffer(row["hashes"], np.uint64).tolist())
        return out

    want = answers()
    times = Counter(x for p in parts for x in p.tolist())
    assert want == {i: {x for x in p.tolist() if times[x] > 1} for i, p in enumerate(parts)}
    monkeypatch.setattr(substring_dedup, "STRETCH", 100)
    assert answers() == want


def test_near_nulls_and_repeats(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None, text), (4, text), (2, text + " more"), (2, "something else here that is long enough to shingle"), (None, "no one has this text but me and that is fine"), (9, text), (9, text)]
    out = minhash.near_classes(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.kept) for r in out), key=repr) == sorted([(None, 2, True), (4, 2, False), (2, 2, True), (2, 2, True), (None, None, True), (9, 2, False), (9, 2, False)], key=repr)
    df = docs(spark, rows).withColumn("gone", F.lit(1))
    kept = minhash.near_dedup(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, 2, 2, None], key=repr)


def test_near_query(spark, sf):
    rows = table_docs(spark, sf)
    out = queries.op7_minhash(spark, sf).collect()
    assert {r.doc_id: r.class_id for r in out} == brute_near(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)


@pytest.mark.parametrize("weighted", [False, True])
def test_dart_minhash_estimates(weighted):
    rng = np.random.default_rng(0)
    e = minhash.mix(np.arange(900, dtype=np.uint64))
    a, b = e[:300], e[60:360]
    w = rng.uniform(0.2, 6, (2, 300)) if weighted else np.ones((2, 300))
    x, y = dict(zip(a.tolist(), w[0])), dict(zip(b.tolist(), w[1]))
    keys = set(x) | set(y)
    want = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
    s = minhash.dart_minhash(np.repeat([0, 1], 300), np.concatenate([a, b]), 2, 4000, np.concatenate(w) if weighted else None)
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    alone = minhash.dart_minhash(np.zeros(300, int), a, 1, 4000, w[0] if weighted else None)
    assert (alone[0] == s[0]).all()  # a row's signature does not depend on the others


# Embeddings


def brute_links(rows, threshold=0.95):
    good = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (n, i, v) in enumerate(good):
        for m, j, w in good[:p]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[n] += 1
                links[m] += 1
                a, b = find(n), find(m)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for n, i, _ in good:
        least[find(n)].append(i)
    return sorted(((i, links[n], min(least.get(find(n), [i]), key=lambda x: (x is None, x))) for n, (i, _) in enumerate(rows)), key=repr)


def embedding_rows(df):
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in df.collect()], key=repr)


@pytest.mark.parametrize("worth", [0.0, 2.0])
def test_embedding_cases(spark, monkeypatch, worth):
    for name, n in (("CHUNK", 16), ("CHUNK_BYTES", 16 * 4 * 8), ("NESTED", 4), ("WORTH", worth), ("BLOCK", 64)):
        monkeypatch.setattr(embedding_dedup, name, n)
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(12):
        base = rng.normal(size=8)
        for k in range(14):
            rows.append((n, (base + rng.normal(size=8) * 0.12 * (k % 5)).astype(np.float32).tolist()))
            n += 1
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, [x * 3 for x in rows[3][1]]), (n + 3, None), (n + 4, [0.0] * 8), (n + 5, [float("nan")] + [1.0] * 7), (n + 6, [float("inf")] + [1.0] * 7)]
    rows += [(n + 7, [None] + [1.0] * 7), (n + 8, []), (n + 9, [1.0, 2.0]), (n + 10, [2.0, 4.0]), (None, rows[3][1]), (n + 11, [1e30] * 8), (n + 12, [1e-30] * 8), (5, rows[40][1]), (5, [9.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("n_links", F.lit("x"))
    out = embedding_dedup.embedding_groups(df)
    assert embedding_rows(out) == brute_links(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out.collect())
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


def test_embedding_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert embedding_rows(queries.op3_embedding_dedup(spark, sf)) == brute_links(rows)


def test_chunk_of_one_dense_group():
    """Every pair is linked; counts come out at once, and one edge for each vector."""
    rng = np.random.default_rng(7)
    raw = (np.ones((900, 16)) + rng.normal(size=(900, 16)) * 0.01).astype(np.float32)
    ids, weights = np.arange(900), np.full(900, 2)
    chunk = embedding_dedup.Chunk(ids[:600], weights[:600], raw[:600], 0.95)
    out = list(chunk.meet(ids[600:], weights[600:], raw[600:]))
    assert [x.tolist() for x in out[0][:2]] == [list(range(600, 900)), [1200] * 300]
    own, links, other = chunk.own()
    assert sorted(own.tolist()) == list(range(600)) and set(links.tolist()) == {599 * 2 + 600} and len(set(other.tolist())) == 1


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
