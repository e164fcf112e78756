"""Small fixtures for what the table queries do not reach: nulls, ties, missing properties, mutations, chains."""

import pytest
from pyspark.sql import functions as F

from knowspark.functions import text as tx
from knowspark.functions import vectors as vx
from knowspark.functions.hashing import fnv1a
from knowspark.functions.values import check
from knowspark.lang import QueryError
from knowspark.operators import constraints, graph, knowledge, mutate, provenance, resolution, search, temporal
from knowspark.operators.ontology import Ontology
from knowspark.operators.security import Policies, Subject, may
from knowspark.plans.engine import Catalog, Engine
from knowspark.schema import opened, typed, view


def people(spark):
    rows = [("a", "Ann", 30, 1.5), ("b", "Bob", None, 2.0), ("c", None, 41, None), ("d", "Dan", 30, 7.0)]
    df = spark.createDataFrame(rows, "k string, name string, age int, score double")
    return view(df, "Person", F.col("k"), ("k",))


def ids(df):
    return sorted(r.koid for r in df.collect())


def test_names_within_a_word(spark):
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 11)))
    names = ["mailgateway", "x"] + [word() for _ in range(60)], ["gateway", "mailgatewayservices"] + [word() for _ in range(40)]
    m = spark.createDataFrame([(i, n, None) for i, n in enumerate(names[0])], "mention int, name string, type_hint string")
    k = spark.createDataFrame([(f"{i:02}", n, None) for i, n in enumerate(names[1])], "koid string, name string, type_hint string")
    got = {r.mention: (r.candidate, round(r.score, 9), r.verdict) for r in resolution.resolve_names(m, k).collect()}
    every = m.select("mention", F.col("name").alias("a")).crossJoin(k.select("koid", F.col("name").alias("b"))).select("mention", "koid", tx.name_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for i in range(len(names[0])):
        (s, c), (t, _) = sorted(((p.s, p.koid) for p in every if p.mention == i), key=lambda p: (-p[0], p[1]))[:2]
        assert got[i] == ((c if s >= 0.5 else None), round(s, 9), "unmatched" if s < 0.5 else "ambiguous" if s - t < 0.15 else "matched"), names[0][i]
    assert got[0][2] == "ambiguous" and got[1] == (None, 0.0, "unmatched")


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ('name != "Ann"', "bcd"), ("age != 30", "bc"), ("age == 30", "ad"), ("age == 30.0", "ad"), ("age > 30", "c"), ("name == null", "c"), ("name != null", "abd"), ("nope == 1", ""),
        ("nope != 1", "abcd"), ("nope == null", ""), ("nope > 1", ""), ('age == "30"', ""), ('age != "30"', "abcd"), ("name > 5", ""), ('age == 30 AND (name == "Ann" OR name == "Zoe")', "a"),
    ],
)
def test_filters(spark, where, want):
    e = Engine(Catalog({"Person": people(spark)}))
    assert ids(e.run(f"MATCH Person WHERE {where} RETURN name")) == list(want)


def test_strict_types(spark):
    e = Engine(Catalog({"Person": people(spark)}), strict_types=True)
    assert ids(e.run("MATCH Person WHERE age == 30.0 RETURN *")) == []
    assert ids(e.run("MATCH Person WHERE score > 1.0 RETURN *")) == ["a", "b", "d"]


def test_paging_and_projection(spark):
    e = Engine(Catalog({"Person": people(spark)}))
    out = e.run("MATCH Person LIMIT 2 OFFSET 1 RETURN age, nothing")
    assert out.columns == ["koid", "type_name", "version", "age"]
    assert [r.koid for r in out.collect()] == ["b", "c"]
    assert e.run("MATCH Person LIMIT 0 RETURN *").count() == 0
    assert [r.operator for r in e.run("MATCH Person WHERE age > 1 LIMIT 1 RETURN explain").collect()] == ["scan Person", "filter age", "limit 1 offset 0"]


def test_unknown_names(spark):
    e = Engine(Catalog({"Person": people(spark)}))
    for q, code in (("MATCH Robot RETURN *", 1030), ("MATCH Person WHERE nope == 1 RETURN *", 1031), ("MATCH Person RETURN nope", 1031)):
        with pytest.raises(QueryError) as err:
            e.analyse(q)
        assert err.value.code == code
    with pytest.raises(QueryError):
        e.run('MATCH Person WHERE name == "Ann" TRAVERSE reports_to RETURN score')


def test_search_filters_first(spark):
    e = Engine(Catalog({"Person": people(spark)}))
    out = e.run('MATCH Person WHERE age == 30 SIMILAR TO "dan" LIMIT 5 RETURN name').collect()
    assert [(r.koid, r.score) for r in out] == [("d", 1.0), ("a", 0.0)]
    assert [r.koid for r in e.run('MATCH Person SIMILAR TO "dan" SCORE BM25 RETURN name').collect()] == ["d"]
    assert e.run('MATCH Person SIMILAR TO "..." SCORE BM25 RETURN name').count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("k1", 0.9), ("k2", 0.5), ("k0", 0.0)], "koid string, score double")
    b = spark.createDataFrame([("k2", 0.8), ("k3", 0.3)], "koid string, score double")
    rrf = [(r.koid, r.score) for r in search.fuse_rrf(a, b).collect()]
    assert [k for k, _ in rrf] == ["k2", "k1", "k3"] and rrf[0][1] == pytest.approx(1 / 63 + 1 / 62)
    assert search.fuse_rrf(a, b, mode=search.RRF_RECALL).first().score == pytest.approx(1 / 62 + 1 / 61)
    assert {r.koid: r.score for r in search.fuse_weighted(a, b, 0.7, 0.3).collect()} == pytest.approx({"k1": 0.63, "k2": 0.59, "k3": 0.09, "k0": 0.0})


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r.c for r in df.select(vx.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert sum(x * x for x in vx.trigram_vector("some text")) == pytest.approx(1)
    assert not any(vx.trigram_vector("a")) and not any(vx.trigram_vector(" -! ")) and any(vx.trigram_vector("é"))
    assert vx.trigram_vector("a-b") != vx.trigram_vector("ab") and vx.trigram_vector("A-B") == vx.trigram_vector("a-b")

    def bucket(three):  # hash(h * 33 + byte) from 5381, in 128 buckets
        a, b, c = three.encode()
        return (5381 * 33**3 + a * 33**2 + b * 33 + c) % 128

    want = [0.0] * 128
    for three in ("  a", " a-", "a-b", "-b ", "b  "):
        want[bucket(three)] += 1
    size = sum(x * x for x in want) ** 0.5
    assert vx.trigram_vector("A-b") == pytest.approx([x / size for x in want])
    ranked = spark.createDataFrame([("x", float("nan")), ("y", 0.5)], "koid string, score double")
    assert [r.koid for r in search.top(ranked, 2).collect()] == ["y", "x"]


def temporal_rows(spark):
    rows = [("x", "v1", 20_000 << 16, None, None, "active"), ("x", "v2", 30_000 << 16, None, None, "active"), ("y", "w", 20_000 << 16 | 3, None, None, "active"), ("z", "d", 25_000 << 16, None, None, "deleted")]
    df = spark.createDataFrame(rows, "k string, value string, ts long, vf long, vt long, st string")
    return view(df, "Fact", F.col("k"), ("k", "ts", "vf", "vt", "st"), commit_ts=F.col("ts"), valid_from=F.col("vf"), valid_to=F.col("vt"), state=F.col("st"))


def test_versions(spark):
    v = temporal_rows(spark)
    got = lambda t: sorted((r.ko.koid, r.value) for r in temporal.as_of(v, t).collect())
    assert got(5_000) == [] and got(25_000) == [("x", "v1"), ("y", "w")] and got(35_000) == [("x", "v2"), ("y", "w")]
    assert got(20_000) == [("x", "v1")]  # the counter makes y's commit later than the snapshot
    assert [r.value for r in temporal.history(v).collect()] == ["v1", "v2", "w"]


def test_validity(spark):
    rows = [(1, 1000, 2000), (2, None, 1000), (3, 2000, None), (4, None, None), (5, 1500, 1500)]
    df = spark.createDataFrame(rows, "i int, a long, b long")
    got = lambda x, y: [r.i for r in df.where(temporal.overlaps(F.col("a"), F.col("b"), x, y)).orderBy("i").collect()]
    assert (got(0, 1000), got(1000, 2000), got(2000, 3000), got(0, 5000)) == ([2, 4], [1, 4], [3, 4], [1, 2, 3, 4])
    assert [r.i for r in df.where(temporal.valid_at(F.col("a"), F.col("b"), 1500)).orderBy("i").collect()] == [1, 4]


def test_traverse(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("a", "s", "c"), ("c", "r", "d"), ("d", "r", "e"), ("e", "r", "f")], "src string, rel_type string, dst string")
    start = spark.createDataFrame([("a",)], "koid string")
    walk = lambda *a: {r.koid: (r.rel_type, r.depth) for r in graph.traverse(e, start, *a).collect()}
    assert walk(2) == {"b": ("r", 1), "c": ("s", 1), "d": ("r", 2)}
    assert walk(9)["f"] == ("r", 4)
    assert walk(1, "in") == {"c": ("r", 1)}
    assert walk(5, "out", "s") == {"c": ("s", 1)}
    assert walk(0) == {}
    alive = spark.createDataFrame([("b",), ("c",)], "koid string")
    assert set(r.koid for r in graph.traverse(e, start, 5, alive=alive).collect()) == {"b", "c"}


def test_access(spark):
    entry = "array<struct<principal:string,action:string,effect:string>>"
    rows = [("own", "ann", "t1", None), ("other", "bob", "t1", None), ("foreign", "ann", "t2", None), ("allowed", "bob", None, [("staff", "read", "allow")]), ("denied", "bob", None, [("staff", "admin", "deny"), ("ann", "read", "allow")]), ("write", "bob", None, [("ann", "write", "allow")])]
    df = spark.createDataFrame(rows, f"k string, owner string, tenant string, acl {entry}")
    v = view(df, "Doc", F.col("k"), ("k", "owner", "tenant", "acl"), owner=F.col("owner"), tenant=F.col("tenant"), acl=F.col("acl"))
    see = lambda s, p=Policies(): sorted(r.koid for r in v.where(may(s, "read", p)).select("ko.koid").collect())
    ann = Subject("ann", ("staff",), "t1")
    assert see(ann) == ["allowed", "own"]
    assert see(ann, Policies(allow={("Doc", "read"): ("staff",)})) == ["allowed", "other", "own", "write"]
    assert see(Subject("root", tenant="t2", admin=True)) == ["allowed", "denied", "foreign", "write"]


def test_check_expressions(spark):
    df = spark.createDataFrame([(7, 2.0, "ab", True), (6, 0.0, "", False), (None, 1.0, None, None)], "i int, f double, s string, b boolean")
    run = lambda e: [r.x for r in df.select(check(df, e).alias("x")).collect()]
    assert run("i / 2 == 3") == [True, True, False]
    assert run("i / f > 3") == [True, False, False]
    assert run('s + "c" == "abc"') == [True, False, False]
    assert run("NOT b OR s") == [True, True, True]
    assert run('IF(i > 6, true, s == "x")') == [True, False, False]
    assert run("i == 7.0") == [False, False, False]
    with pytest.raises(ValueError):
        check(df, "i +")


def test_constraints(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("d", None)], "k string, n int")
    assert [(r.n, r.objects) for r in constraints.duplicates(df, ["n"]).collect()] == [(1, 2)]
    batch = spark.createDataFrame([("e", 1), ("f", 9)], "k string, n int")
    assert [r.k for r in constraints.unique_violations(df, batch, ["n"]).collect()] == ["e"]
    own = spark.createDataFrame([("a", 7, "t"), ("b", 8, "t")], "k string, n int, tenant string")
    again = spark.createDataFrame([("a", 7, "t"), ("c", 8, "u"), ("d", 9, "t"), ("e", 9, "t"), ("f", None, "t")], "k string, n int, tenant string")
    ids = lambda *a: sorted(r.k for r in constraints.unique_violations(own, again, ["n"], "k", *a).collect())
    assert ids() == ["c", "d", "e"] and ids(["tenant"]) == ["d", "e"]  # an object does not clash with itself
    v = constraints.violations(df, F.col("k"), {"present": F.col("n").isNotNull(), "small": F.col("n") < 1}, changed=["m"], uses={"present": ["n"], "small": ["m"]})
    assert sorted((r.koid, r.rule) for r in v.collect()) == [(k, "small") for k in "abcd"]


def test_ontology():
    o = Ontology({"A": None, "B": "A", "C": "B", "D": "A"})
    assert o.expand("B") == ["B", "A", "C"] and o.descendants("A") == ["B", "C", "D"] and o.is_a("C", "A")


def test_open_and_typed(spark):
    back = typed(opened(people(spark)), "Person", {"name": "string", "age": "int", "score": "double", "none": "string"})
    assert [(r.name, r.age, r.score, r.none) for r in back.orderBy("ko.koid").collect()] == [("Ann", 30, 1.5, None), ("Bob", None, 2.0, None), (None, 41, None, None), ("Dan", 30, 7.0, None)]


def test_chain(spark):
    rows = [(i, f"k{i % 2}", i // 2 + 1, "update", "human", "ann", 10 * i, f"h{i}", None, None) for i in range(6)]
    j = spark.createDataFrame(rows, "seq long, koid string, version long, kind string, origin string, actor string, ts long, payload_hash string, signature string, note string")
    c = provenance.chain(j)
    assert provenance.prove(c).count() == 0
    bad = c.withColumn("actor", F.when(F.col("seq") == 3, "eve").otherwise(F.col("actor")))
    assert [(r.seq, r.problem) for r in provenance.prove(bad).collect()] == [(3, "altered")]
    cut = c.where("seq <> 2")
    assert [(r.seq, r.problem) for r in provenance.prove(cut).collect()] == [(4, "broken link")]
    gone = c.select("koid", "version", "payload_hash").where("not (koid = 'k0' and version = 2)")
    assert [(r.koid, r.problem) for r in provenance.prove(c, gone).collect()] == [("k0", "missing payload")]


def test_names(spark):
    pairs = [("Acme", "Acme", 1.0), ("ACME", "acme", 0.95), ("Acme Type", "acme", 0.8 * 4 / 9 + 0.1), ("Acme", "Acme Corp", 0.8 * 4 / 9 + 0.1), ("Big Acme", "Acme Old", 0.7 / 3), ("Graphite", "Graphene", 0.0), ("Customer", "Customs Office", 0.0)]
    pairs += [("a.b old", "old", 0.8 * 3 / 7 + 0.1), ("new old", "cold old", 0.7 / 3), ("x y", "y  x", 0.7), ("é", "É", 0.95), ("x", "y", 0.0), ("one a.b", "a.b-c one", 0.7 / 3)]
    df = spark.createDataFrame(pairs, "a string, b string, s double")
    for r in df.withColumn("g", tx.name_similarity(F.col("a"), F.col("b"))).collect():
        assert r.g == pytest.approx(r.s), (r.a, r.b)
    assert fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_resolution(spark):
    m = spark.createDataFrame([(1, "Acme", "org"), (2, "Nobody", None), (3, "Twin", None)], "mention int, name string, type_hint string")
    k = spark.createDataFrame([("a", "Acme", "company"), ("b", "Acme", "person"), ("t1", "Twin One", None), ("t2", "Twin Two", None)], "koid string, name string, type_hint string")
    m = m.withColumn("type_hint", F.when(F.col("mention") == 1, "organization"))
    got = {r.mention: (r.candidate, r.verdict) for r in resolution.resolve_names(m, k).collect()}
    assert got == {1: ("a", "matched"), 2: (None, "unmatched"), 3: ("t1", "ambiguous")}


def test_conflicts(spark):
    f = spark.createDataFrame([("1", "The cache must be on", ["Cache"], 0.9), ("2", "The cache must not be on", ["Cache"], 0.5), ("3", "Logs are kept", ["Log"], 0.5)], "fact string, statement string, entities array<string>, confidence double")
    assert sorted((r.a, r.b, r.kind) for r in knowledge.find_conflicts(f).collect()) == [("1", "2", "ambiguous"), ("1", "2", "conflict")]
    g = spark.createDataFrame([("1", "Jobs always run at night", ["J"], 0.9), ("2", "Jobs never run at night", ["J"], 0.5), ("3", "Sync calls only", ["J"], 0.4)], f.schema)
    assert [(r.a, r.b, r.kind) for r in knowledge.find_conflicts(g).collect()] == [("1", "2", "conflict")]
    h = spark.createDataFrame([("1", "It uses Rust", ["J"], 0.9), ("2", "it uses Go", ["J"], 0.5), ("3", "IT USES GO", ["J"], 0.4)], f.schema)
    assert sorted((r.stale, r.current, r.kind) for r in knowledge.detect_staleness(h).collect()) == [("2", "1", "conflict"), ("3", "1", "conflict")]
    f = f.where("fact <> '2'").unionAll(spark.createDataFrame([("2", "Now the cache must not be on today", ["Cache"], 0.5)], f.schema))
    p = knowledge.propose(knowledge.find_conflicts(f))
    pid = p.first().proposal
    move = lambda df, to: knowledge.advance(df, spark.createDataFrame([(pid, to)], "proposal string, to string")).drop("moved")
    assert move(p, "ACCEPTED").first().status == "PROPOSED"
    assert move(move(p, "VALIDATED"), "ACCEPTED").first().status == "ACCEPTED"


def test_mutations(spark):
    heads = opened(people(spark)).withColumn("authority", F.when(F.col("koid") == "a", "legal").when(F.col("koid") == "d", "user"))
    new = mutate.evolve(heads, "a", {"age": 31, "city": "Ulm"}, 1000)
    r = new.first()
    assert (r.version, r.commit_ts, r.properties["age"].i, r.properties["city"].s, r.properties["name"].s) == (2, 1000 << 16, 31, "Ulm", "Ann")
    loser, problems = mutate.resolve_by_authority(heads, "a", "d", 5)
    assert [(x.koid, x.epistemic_status) for x in loser.collect()] == [("d", "contradicted")] and problems.count() == 0
    assert mutate.resolve_by_authority(heads, "a", "b", 5)[1].count() == 2
    parts = {x.koid: sorted(x.properties) for x in mutate.split(heads, "a", {"a1": ["name"], "a2": ["age", "score"]}, 9).collect()}
    assert parts["a1"] == ["name"] and parts["a2"] == ["age", "score"]
    merged = {x.koid: x for x in mutate.merge(heads, ["a", "d"], "a", 9, "authority").collect()}
    assert merged["a"].properties["name"].s == "Ann" and merged["d"].state == "superseded"
    ok, bad = mutate.transition(heads.withColumn("epistemic_status", F.lit("superseded")), "a", "verified", 9)
    assert ok.count() == 0 and bad.count() == 1
    conflict, none = mutate.contradict(heads, "a", "x1", "age", 99, "bob", 4)
    assert conflict.first().properties["countered"].i == 99 and none.count() == 0
    assert mutate.contradict(heads, "a", "x1", "age", 30, "bob", 4)[1].count() == 1
    moved = mutate.supersede(heads, "a", "b", 7).collect()
    assert {(x.koid, x.state) for x in moved} == {("a", "superseded"), ("b", "active")}
    assert mutate.retain(heads, "a", 50, 100).first().valid_to == 150
    assert Engine(Catalog({"Person": people(spark)}), now=3).run('UPDATE Person "b" age == 5').first().properties["age"].i == 5
    assert Engine(Catalog({"Person": people(spark)}), now=3).run('DELETE Person "b"').first().state == "deleted"
    assert Engine(Catalog({"Person": people(spark)}), now=3).run('CREATE Robot name == "R2"').first().properties["name"].s == "R2"


def test_idempotency(spark):
    heads = opened(people(spark))
    req = heads.where("koid in ('a', 'b')").withColumn("expected", F.lit(None).cast("long")).withColumn("idempotency", F.lit("same"))
    assert mutate.remember(req, heads, 5)[0].count() == 1
    seen = spark.createDataFrame([("same",)], "idempotency string")
    assert mutate.remember(req, heads, 5, seen)[0].count() == 0


def test_programs(spark):
    from knowspark.plans.programs import Program, Runner, json_chunks

    e = Engine(Catalog({"Person": people(spark)}))
    p = Program("by_name", "MATCH Person WHERE name == {{who}} OR age == {{ age }} RETURN name")
    assert ids(e.run(p.statement({"who": 'x" OR name != "', "age": 41}))) == ["c"]
    with pytest.raises(KeyError):
        p.statement({"who": "a"})
    r = Runner(e)
    first = r.run(p, {"who": "Ann", "age": 0}, "run-1")
    assert r.run(p, {"who": "Bob", "age": 0}, "run-1") is first
    assert [len(c) for c in json_chunks(people(spark).select("name", "age"), 3)] == [3, 1]


def test_bridge(spark):
    from knowspark.pipeline import bridge
    from knowspark.pipeline.blocks import explode_blocks

    cols = spark.createDataFrame([("orders", "customer_id", "int"), ("customers", "id", "int"), ("customers", "name", "text")], "table_name string, column_name string, data_type string")
    assert [(r.subject, r.object) for r in bridge.schema_relations(cols).collect()] == [("orders", "customers")]
    assert {r.name: r.mentions for r in bridge.schema_entities(cols).collect()} == {"orders": ["customer_id"], "customers": ["id", "name"]}
    d = spark.createDataFrame([(1, "text\n\n![A red plot](x.png)\n\nmore")], "doc_id long, text string")
    figures = bridge.visual_index(explode_blocks(d, "text", "doc_id"), "doc_id")
    assert [(r.figure, r.caption, r.link) for r in figures.collect()] == [("1/figure-1", "A red plot", "x.png")]
    assert bridge.similar_figures(figures, "red").count() == 1 and bridge.similar_figures(figures, "blue").count() == 0


def test_approximate_search_finds_most(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(300)
    q = e.first().embedding
    exact = {r.koid for r in search.ann(e, F.col("embedding"), q, 10, F.col("vec_id")).collect()}
    near = {r.koid for r in search.ann_approximate(e, F.col("embedding"), q, 10, F.col("vec_id"), tables=24, bucket=1.5).collect()}
    assert len(exact & near) >= 9


def test_exact_percentiles(spark):
    import random

    from knowspark.operators.evals import nearest_rank_rows
    from knowspark.plans.lineage import numbered

    r = random.Random(2)
    rows = [("a", float(r.randint(0, 50))) for _ in range(999)] + [("b", r.random()) for _ in range(20_000)] + [(None, 1.0), ("c", None), ("d", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for p in (0.0, 0.5, 0.95, 0.999):
        got = {x.g: x.v for x in nearest_rank_rows(df, "v", p, ["g"], share_of_n=True).collect()}
        for g in ("a", "b", "d", None):
            v = sorted(y for x, y in rows if x == g and y is not None)
            assert got[g] == v[int(len(v) * p)]
        assert "c" not in got
    n = [(x.g, x.v, x.i) for x in numbered(df.where("g = 'b'"), "i", "v").collect()]
    assert sorted(x[2] for x in n) == list(range(1, 20_001)) and [x[1] for x in sorted(n, key=lambda x: x[2])] == sorted(x[1] for x in n)


def test_resolve_conflict(spark):
    from knowspark.operators import claims

    heads = opened(people(spark)).withColumn("epistemic_status", F.when(F.col("koid") != "d", "asserted").otherwise("superseded")).withColumn("valid_from", F.lit(0).cast("long"))
    row = spark.createDataFrame([("x1", "a", "b")], "k string, a string, b string")
    proof = F.array(F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in (("source_artifact", "s", "string"), ("location", None, "string"), ("revision", None, "string"), ("method", "m", "string"), ("confidence", 1.0, "double"))]))
    conflict, bad = claims.claims(row, "Conflict", F.col("k"), ["a", "b"], proof, 5)
    assert bad.count() == 0 and claims.claims(row, "Conflict", F.col("k"), ["a"], F.slice(proof, 1, 0), 5)[1].first().problem == "no evidence"
    heads = heads.unionByName(conflict)
    edges = spark.createDataFrame([("c", "DERIVED_FROM", "a")], "src string, rel_type string, dst string")
    go = lambda a, b, *rest, **more: claims.resolve_conflict(heads, edges, "x1", a, b, *rest, 9, **more)
    out, none = go("a", "b", "a_preferred", "seen twice")
    assert {r.koid: r.epistemic_status for r in out.collect()}["b"] == "contradicted" and out.count() == 2 and none.count() == 0
    assert out.where("koid = 'x1'").first().properties["resolution"].s == "a_preferred"
    assert claims.resolve_conflict(out, edges, "x1", "a", "b", "a_preferred", "again", 9)[1].first().problem == "already resolved"
    assert claims.resolve_conflict(heads, edges, "a", "a", "b", "a_preferred", "no", 9)[1].first().problem == "not a conflict"
    assert go("a", "d", "a_preferred", "d is closed already")[0].count() == 1
    out, _ = go("a", "b", "both_valid", "one after the other", split_at=7)
    assert {r.koid: (r.valid_from, r.valid_to) for r in out.where("koid <> 'x1'").collect()} == {"a": (0, 7), "b": (7, None)}
    out, _ = go("a", "b", "replaced", "both wrong", replacement="d")
    assert {r.koid: r.epistemic_status for r in out.where("koid <> 'x1'").collect()} == {"a": "superseded", "b": "superseded", "c": "contradicted"}
    for wrong in (("won", "x", {}), ("replaced", "x", {}), ("a_preferred", " ", {}), ("a_preferred", "x", {"split_at": 3})):
        with pytest.raises(ValueError):
            go("a", "b", *wrong[:2], **wrong[2])


def test_batch(spark):
    from knowspark.plans.batch import batch

    heads, names = opened(people(spark)), iter("xyz")
    out, koids = batch(heads, [{"remember": {"type": "Note", "properties": {"about": "all"}}}, {"remember": {"type": "Note", "properties": {"after": "$1.koid"}}}, {"relate": {"from": "$2.koid", "rel": "next", "to": "a"}}, {"remember": {"type": "Person", "koid": "b", "properties": {"age": 6}}}, {"forget": {"koid": "d"}}], 9, lambda: next(names))
    rows = {r.koid: r for r in out.collect()}
    assert koids == ["x", "y", "y", "b", "d"] and set(rows) == {"x", "y", "b", "d"}
    assert rows["y"].properties["after"].s == "x" and rows["y"].relationships[0].target == "a" and rows["x"].version == 1
    assert rows["b"].properties["age"].i == 6 and rows["b"].properties["name"].s == "Bob" and rows["b"].version == 2 and rows["d"].state == "deleted"
    for operations, error in (([{"forget": {"koid": "$1.koid"}}], ValueError), ([{"forget": {"koid": "nobody"}}], KeyError), ([{"paint": {}}], ValueError)):
        with pytest.raises(error):
            batch(heads, operations, 9)


def test_workflows_reports_agents(spark):
    from knowspark.plans.programs import Agent, Program, Report, Runner, Workflow

    runner = Runner(Engine(Catalog({"Person": people(spark)})))
    old, named = Program("old", "MATCH Person WHERE age > {{ least }} RETURN name, age"), Program("named", "MATCH Person WHERE name == {{ who }} RETURN age")
    flow = Workflow("w", {"second": (named, ["first"]), "first": (old, [])})
    assert flow.order() == ["first", "second"]
    out = flow.run(runner, {"least": 40, "who": "Dan"}, "e1")
    assert out["first"].count() == 1 and out["second"].first().age == 30
    assert flow.run(runner, {"least": 0, "who": "Dan"}, "e1")["first"].count() == 1 and (runner.stats.hits, runner.stats.misses, runner.stats.programs) == (2, 2, 4)
    with pytest.raises(ValueError):
        Workflow("c", {"a": (old, ["b"]), "b": (old, ["a"])}).order()
    with pytest.raises(KeyError):
        Workflow("c", {"a": (old, ["z"])}).order()
    text = Report("r", "Over {{ least }}:\n{{ who_is }}", {"who_is": Program("p", "MATCH Person WHERE age >= {{ least }} LIMIT 9 RETURN name, age")}).render(runner, {"least": 30}, most=1)
    assert text.startswith("Over 30:\n") and text.endswith("...") and "Ann | 30" in text
    agent = Agent("a", "Find people.", {"old": old}, ["ann"])
    assert agent.run(runner, "ann", {"least": 1})["old"].count() == 3
    with pytest.raises(PermissionError):
        agent.run(runner, "eve", {"least": 1})
    assert sum(len(c) for c in runner.chunks(old, {"least": 1}, 2)) == 3 and runner.stats.rows == 3
