"""The store, streams, sources and the document pipeline on small files."""

import random
import sqlite3
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from knowspark.operators import provenance
from knowspark.pipeline import blocks, chunk, compile, context, extract, summary
from knowspark.plans.engine import Catalog, Engine
from knowspark.schema import opened, view
from knowspark.sources import documents, graphs, relational
from knowspark.store import Store
from knowspark.streaming import journal as js
from knowspark.streaming import windows


def rows(spark, values, version=1, at=1000, state="active"):
    df = spark.createDataFrame(values, "k string, text string")
    ref = F.when(F.col("k") == "b", F.array(F.struct(F.lit("cites").alias("rel_type"), F.lit("a").alias("target"), F.lit("out").alias("direction"))))
    return opened(view(df, "Note", F.col("k"), ("k",), version=F.lit(version), commit_ts=F.lit(at << 16), state=F.lit(state), relationships=ref))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.append(rows(spark, [("a", "first note"), ("b", "second note")]), "created", "ann", 1000)
    s.append(rows(spark, [("a", "first note, changed")], 2, 2000), "updated", "bob", 2000)
    return s


def test_store(spark, store, tmp_path):
    assert {r.koid: r.properties["text"].s for r in store.heads().collect()} == {"a": "first note, changed", "b": "second note"}
    assert [(r.seq, r.koid, r.kind) for r in store.journal().orderBy("seq").collect()] == [(1, "a", "created"), (2, "b", "created"), (3, "a", "updated")]
    assert provenance.prove(store.journal()).count() == 0
    assert [(r.src, r.rel_type, r.dst) for r in store.edges().collect()] == [("b", "cites", "a")]
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "koid string")
    assert store.get_many(ids("a", "b")).count() == 2
    with pytest.raises(KeyError):
        store.get_many(ids("a", "z"))
    store.append(rows(spark, [("b", "second note")], 2, 3000, "deleted"), "deleted", "ann", 3000)
    assert [r.type_name for r in store.types().collect()] == ["Note"] and store.get("b").count() == 0
    store.backup(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy")).same_as(store)
    assert store.compact(str(tmp_path / "small")).same_as(store)
    store.append(rows(spark, [("c", "x")]), "created", "ann", 4000)
    assert not Store(spark, str(tmp_path / "copy")).same_as(store)


def test_two_versions_in_one_append(spark, store):
    both = rows(spark, [("a", "third")], 3, 3000).unionByName(rows(spark, [("a", "fourth")], 4, 4000)).unionByName(rows(spark, [("d", "new")], 1, 3000))
    store.append(both, "updated", "ann", 3000)
    assert provenance.prove(store.journal()).count() == 0 and store.get("a").first().version == 4


def test_restore_and_list_backups(spark, store, tmp_path):
    store.backup(f"{tmp_path}/backups/one")
    store.append(rows(spark, [("e", "later")], 1, 5000), "created", "ann", 5000)
    store.backup(f"{tmp_path}/backups/two")
    assert [(r.name, r.versions) for r in store.backups(f"{tmp_path}/backups").collect()] == [("one", 3), ("two", 4)]
    fresh = Store(spark, f"{tmp_path}/fresh")
    fresh.restore(f"{tmp_path}/backups/one")
    assert fresh.versions().count() == 3 and not fresh.same_as(store)
    with pytest.raises(ValueError):
        fresh.restore(f"{tmp_path}/backups/two")


def test_embedded_chunks(spark):
    from knowspark.functions.vectors import trigram_vector

    got = chunk.embed_chunks(chunk.chunk_documents(spark.createDataFrame([(1, "Some words here."), (2, None)], "doc_id long, text string"))).collect()
    assert [r.embedding_provider for r in got] == ["trigram"] and got[0].embedding == pytest.approx(trigram_vector(got[0].text), abs=1e-6)


def test_uncommitted_versions_are_not_seen(spark, store):
    rows(spark, [("zz", "lost")]).write.mode("append").partitionBy("type_name").parquet(f"{store.path}/versions")
    assert store.get("zz").count() == 0


def test_index_stream_equals_rebuild(spark, store, tmp_path):
    out, mark = str(tmp_path / "index"), str(tmp_path / "mark")
    run = lambda: js.maintain_index(spark, f"{store.path}/journal", store.heads, F.col("properties")["text"]["s"], out, mark).awaitTermination()
    run()
    store.append(rows(spark, [("b", "quite other words")], 2, 3000), "updated", "ann", 3000)
    store.append(rows(spark, [("a", "gone")], 3, 4000, "deleted"), "deleted", "ann", 4000)
    assert js.lag(store.journal(), spark.read.parquet(out)).first().events == 2
    run()
    run()
    assert sorted((r.koid, r.token) for r in js.index(spark, out).collect()) == [("b", "other"), ("b", "quite"), ("b", "words")]
    assert js.lag(store.journal(), spark.read.parquet(out)).first().events == 0


def test_subscription_and_triggers(spark, store, tmp_path):
    got = []
    listen = lambda: js.subscribe(spark, f"{store.path}/journal", str(tmp_path / "sub"), lambda b, n: got.extend(r.seq for r in b.collect()), kinds=("updated",)).awaitTermination()
    listen()
    store.append(rows(spark, [("b", "more")], 2, 3000), "updated", "ann", 3000)
    listen()
    assert got == [3, 4]
    js.triggers(spark, f"{store.path}/journal", str(tmp_path / "trig"), {"created": lambda b: b.select("koid")}, str(tmp_path / "fired")).awaitTermination()
    assert sorted(r.koid for r in spark.read.parquet(str(tmp_path / "fired")).collect()) == ["a", "b"]
    assert [r.seq for r in js.replay(store.journal(), 2).collect()] == [3, 4]


def test_streamed_windows_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day", ["event_type"], late="1 hour")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r.window_start), r.event_type, r.events) for r in df.collect())
    assert key(spark.table("tumbled")) == key(windows.tumbling(events, "1 day", ["event_type"]))


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE author (id INTEGER PRIMARY KEY, name TEXT, score REAL)")
        c.execute("CREATE TABLE book (id INTEGER PRIMARY KEY, author_id INTEGER, title TEXT)")
        c.executemany("INSERT INTO author VALUES (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(1, 21)])
        c.executemany("INSERT INTO book VALUES (?, ?, ?)", [(1, 3, "x"), (2, None, "y")])
        c.execute("CREATE TABLE vacant (id INTEGER)")
    df = relational.read_sqlite(spark, path, "author")
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")] and df.count() == 20 and df.agg(F.sum("score")).first()[0] == 105.0
    assert relational.read_sqlite(spark, path, "vacant").count() == 0
    authors, books = relational.TableSpec("author", ["id"]), relational.TableSpec("book", ["id"], {"author_id": ("author", "written_by")})
    objects = relational.objects(df, authors, "shop")
    edge = relational.edges(relational.read_sqlite(spark, path, "book"), books, "shop").collect()
    assert len(edge) == 1 and objects.where(F.col("ko.koid") == edge[0].dst).first().name == "n3"


def test_graph_ids_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("1", "knows", "2")], "src string, rel_type string, dst string")
    out = graphs.graph_ids(df, "g", "src", "dst").first()
    assert len(out.src) == 32 and out.src != out.dst
    (tmp_path / "e.json").write_text('{"_id": {"$oid": "a"}, "n": 1}\n{"_id": {"$oid": "b"}, "n": 2}\n')
    assert graphs.read_export(spark, str(tmp_path / "e.json"), "_id struct<`$oid`:string>, n int").count() == 2


def test_documents(spark, tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    (d / "a.md").write_text("# Head\n\nThe Cache Service depends on Disk Store. Used since 2024-01-05.\n")
    (d / "sub" / "b.html").write_text("<h1>T</h1><p>Hello <b>you</b></p><script>x</script>")
    (d / "c.py").write_text('import os\nclass A(Base):\n    """Doc."""\n    def f(self):\n        return os.path.join("a")\n')
    (d / "bad.txt").write_bytes(b"\xff\xfe\x00")
    with zipfile.ZipFile(d / "w.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    got = documents.read_documents(spark, str(d))
    text = {r.path.rsplit("/", 1)[1]: r.text for r in got.collect()}
    assert text["b.html"] == "# T\n\nHello you" and text["w.docx"] == "# Top\n\nBody" and text["bad.txt"] is None
    code = {(r.kind, r.subject, r.predicate, r.object) for r in documents.explode_code(got).collect()}
    assert {("relation", "A", "inherits", "Base"), ("function", "A", "contains", "A.f"), ("relation", "A.f", "calls", "os.path.join"), ("relation", "module", "imports", "os"), ("doc", "A", "documented_as", "Doc.")} <= code
    before = spark.createDataFrame(got.select("path", "sha256").collect())
    (d / "a.md").write_text("other")
    (d / "c.py").unlink()
    (d / "n.txt").write_text("new")
    change = {r.path.rsplit("/", 1)[1]: r.change for r in documents.changed(before, documents.read_documents(spark, str(d))).collect()}
    assert change == {"a.md": "changed", "c.py": "gone", "n.txt": "new"}


def test_ingest_statement(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Head\n\nThe Cache Service depends on Disk Store. It is fast.\n\n| a | b |\n| 1 | 2 |\n")
    e = Engine(Catalog({"X": spark.createDataFrame([("a",)], "x string")}))
    out = sorted((r.kind, r.item) for r in e.run(f'INGEST "{tmp_path}" EXTRACT TABLES EXTRACT ENTITIES BUILD RELATIONSHIPS COMMIT').collect())
    assert ("relation", "The Cache Service depends_on Disk Store") in out or ("relation", "Cache Service depends_on Disk Store") in out
    assert ("table", "| a | b |\n| 1 | 2 |") in out and any(k == "entity" and "Disk Store" in i for k, i in out)


def test_blocks():
    got = blocks.blocks("# A\n\npara one\nstill one\n\n- x\n- y\n\n## B\n```\ncode  here\n```\n| a | b |\fpage two")
    assert [(b.kind, b.text, b.path, b.page) for b in got] == [
        ("heading", "A", (), 1), ("paragraph", "para one still one", ("A",), 1), ("list", "- x\n- y", ("A",), 1), ("heading", "B", ("A",), 1),
        ("code", "code  here", ("A", "B"), 1), ("paragraph", "| a | b |", ("A", "B"), 1), ("paragraph", "page two", ("A", "B"), 2),
    ]
    assert blocks.blocks(None) == [] and blocks.boundaries(["Title", "text about cats", "text about cats too"], ["heading", "paragraph", "paragraph"]) == [True, False, False]


def test_chunks():
    got = chunk.chunks([("s", "a" * 30), ("s", "b" * 30), ("s", "c" * 90), ("t", "d")], most=64, overlap=10)
    assert got == [("s", "s\n" + "a" * 30 + " " + "b" * 30), ("s", "b" * 10 + " " + "c" * 90), ("t", "t\nd")]
    assert chunk.chunks([("", "x" * 5), ("", "y" * 5)], most=5, overlap=10) == [("", "xxxxx"), ("", "yyyyy")]  # no longer than the overlap: nothing is carried
    assert chunk.chunk_text("") == []
    whole = " ".join(f"word{i}" for i in range(4000))
    parts = chunk.chunk_text("\n\n".join(whole[i : i + 500] for i in range(0, len(whole), 500)))
    assert all(len(t) <= chunk.MOST + chunk.OVERLAP + 1 for _, t in parts)


def test_summary(spark):
    t = spark.createDataFrame([(1, 0, "We decided to ship. What about tests? Nice day."), (1, 1, None), (1, 2, "TODO: please fix it")], "conv_id long, turn long, text string")
    got = sorted((r.turn, r.bucket, r.sentence) for r in summary.bucketed(t).collect())
    assert got == [(0, "decisions", "We decided to ship."), (0, "facts", "Nice day."), (0, "open_issues", "What about tests?"), (2, "actions", "TODO: please fix it")]
    t = spark.createDataFrame([(1, 0, "We met Ada Lovelace and Bob. Then Carol came! Dan left, I saw X2 and Eve"), (1, 1, None)], "conv_id long, turn long, text string")
    assert sorted(r.entity for r in summary.entities(t).collect()) == ["Ada Lovelace", "Bob", "Carol", "Eve"]


def test_context_packing():
    rows = pd.DataFrame([("u1", "entity", "alpha " * 8, 3.0), ("u2", "entity", "beta " * 8, 1.0), ("u3", "entity", "gamma " * 8, 1.0), ("f1", "fact", "x" * 200, 2.0), ("f2", "fact", "short", 1.0), ("r1", "relation", "rel", 2.0), ("r2", "relation", "weak", 0.5), ("z", "fact", "zero", 0.0)], columns=["unit", "kind", "text", "score"])
    assert context.pack(rows, 0)["unit"].tolist() == ["u1", "u2", "u3", "f1", "f2", "r1"]
    assert context.pack(rows, 40)["unit"].tolist() == ["u1", "f2", "r1"]  # the tie u2, u3 does not fit in half the budget; f1 does not fit at all
    assert context.pack(rows.iloc[:0], 10).empty


def test_context_without_a_cut(spark):
    """As packing all units at once: many better facts, ties, copies and pieces of every size."""
    r = random.Random(5)
    size = lambda: "y" * r.choice([0, 1, 5, 9, 30, 200, 900])
    rows = [(f"f{i:05}", "fact", "", f"steel market {i:05} {size()}", ["a"]) for i in range(21_000)]
    rows += [(f"g{i:03}", "fact", "", f"steel {i % 80} {size()}", []) for i in range(300)]
    rows += [(f"e{i:03}", "entity", f"steel {i % 3}", f"rod {i % 40} {size()}", ["x"] * (i % 3)) for i in range(60)]
    rows += [(f"r{i:03}", "relation", "", f"{'steel ' * (i % 2)}market {i} {size()}", []) for i in range(300)]
    units = spark.createDataFrame(rows, "unit string, kind string, name string, text string, mentions array<string>")
    tasks = spark.createDataFrame([(1, "steel market"), (2, "rods of steel")], "task int, question string")
    for budget in (0, 60, 900):
        got = sorted((x.task, x.unit, x.score, x.tokens) for x in context.compile_context(units, tasks, budget).collect())
        want = []
        for task, question in ((1, "steel market"), (2, "rods of steel")):
            scored = context.score_units(units, context.task_words(question)).where("score > 0").toPandas().sort_values(["score", "unit"], ascending=[False, True])
            want += [(task, x.unit, x.score, x.tokens) for x in context.pack(scored, budget).itertuples()]
        assert got == sorted(want), budget
        assert {x[1][0] for x in got} >= {"e", "f"} if budget in (0, 900) else got


def test_extraction(spark):
    d = spark.createDataFrame([(1, "Order Service uses Mail Gateway. nothing here. Released 2024-02-29 by Ann Lee."), (2, None)], "doc_id long, text string")
    assert [(r.subject, r.predicate, r.object) for r in extract.relations(d, "text", "doc_id").collect()] == [("Order Service", "uses", "Mail Gateway")]
    assert [r.at for r in extract.temporal(d, "text", "doc_id").collect()] == [1709164800000]
    facts = extract.facts(d, "text", "doc_id").collect()
    assert {x for f in facts for x in f.entities} >= {"Order Service", "Mail Gateway", "Ann Lee"}


def test_all_mentions(spark):
    text = " ".join(f"Then Mail Gateway sent item {i:02}." for i in range(30))
    facts = extract.facts(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", "doc_id")
    got = {r.name: r.mentions for r in extract.entities(facts).collect()}
    assert max(len(m) for m in got.values()) == 30
    assert all(m == sorted(m) for m in got.values())


def test_incremental_compile(spark):
    old = spark.createDataFrame([(1, "same"), (2, "before"), (3, "gone")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "same"), (2, "after"), (4, "mail me at a@b.org")], "doc_id long, text string")
    out = compile.compile_changed(old, new)
    assert sorted((r.doc_id, r.text) for r in out.chunks.collect()) == [(2, "after"), (4, "mail me at [email]")]
