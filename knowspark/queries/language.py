"""Queries in the language, and the operators behind its clauses."""

from __future__ import annotations

import json
import math
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import trigram_embedding, trigram_vector
from ..lang import parse_json
from ..operators import graph, search
from ..operators.ontology import Ontology, Relationship, discover_properties, discover_relationships, discover_types
from ..operators.security import Policies, Subject, first_match, may, roles_of
from ..plans.engine import Catalog, Engine
from ..schema import opened
from . import query
from . import tables as tb
from .tables import EDGES_SQL, USERS_SQL, jaccard_sql, tokens_sql

WORDS = "the market of thation and edly"
VECTOR = [round(math.sin(i * 1.7 + 0.3), 6) for i in range(64)]
NOW = 1_700_000_000_000


def engine(spark: SparkSession, d: str, now: int = NOW, **options) -> Engine:
    from ..operators.temporal import latest

    makers = {"Doc": tb.docs, "Order": tb.orders, "Customer": tb.customers, "Supplier": tb.suppliers, "Part": tb.parts, "Vector": tb.vectors, "Hybrid": tb.hybrids}
    heads = tb.Lazy({n: partial(f, spark, d) for n, f in makers.items()} | {"User": lambda: latest(tb.user_versions(spark, d))})
    versions = tb.Lazy({"User": partial(tb.user_versions, spark, d)})
    return Engine(Catalog(heads, versions, partial(tb.edges, spark, d), embed=lambda text: VECTOR), now=now, **options)


def head(kind: str, key: str) -> str:
    return f"'{kind.lower()}/' || {key} AS koid, '{kind}' AS type_name, 1::BIGINT AS version"


# Filters


def _order_sql(where: str, fields: str = "o_orderkey, o_totalprice", now: str = "") -> str:
    return f"SELECT {head('Order', 'o_orderkey')}, {fields} FROM orders WHERE epoch_ms(o_orderdate) <= {now or 800_000_000_000} AND epoch_ms(o_orderdate) + 7776000000 > {now or 800_000_000_000} AND ({where})"


def orders_at(spark: SparkSession, d: str, q: str, **options) -> DataFrame:
    return engine(spark, d, 800_000_000_000, **options).run(q)


@query(_order_sql("o_totalprice > 100000 AND o_orderstatus = 'F'"))
def scan_filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_at(spark, sf_dir, 'MATCH Order WHERE o_totalprice > 100000 AND o_orderstatus == "F" RETURN o_orderkey, o_totalprice')


@query(_order_sql("o_orderpriority IS DISTINCT FROM '1-URGENT'", "o_orderkey"))
def filter_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_at(spark, sf_dir, 'MATCH Order WHERE o_orderpriority != "1-URGENT" RETURN o_orderkey, no_such_field')


@query(_order_sql("(o_totalprice < 50000 OR o_orderpriority = '2-HIGH') AND o_orderdate >= TIMESTAMP '1995-04-01'"))
def filter_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_at(spark, sf_dir, 'MATCH Order WHERE (o_totalprice < 50000 OR o_orderpriority == "2-HIGH") AND o_orderdate >= "1995-04-01" RETURN o_orderkey, o_totalprice')


@query(f"SELECT {head('Part', 'p_partkey')}, p_partkey FROM part WHERE p_size = 10")
def filter_strict_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers and fractions never match here: the second condition finds nothing."""
    return engine(spark, sf_dir, strict_types=True).run("MATCH Part WHERE p_size == 10 OR p_retailprice > 0 RETURN p_partkey")


@query(f"SELECT {head('Part', 'p_partkey')}, p_partkey FROM part WHERE p_size IS NOT NULL AND p_brand <> 'x'")
def filter_null_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run('MATCH Part WHERE p_size != null AND missing != "x" AND p_brand != "x" RETURN p_partkey')


@query(f"SELECT {head('Customer', 'c_custkey')}, c_name, c_acctbal FROM customer ORDER BY koid LIMIT 25 OFFSET 40")
def page_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("MATCH Customer LIMIT 25 OFFSET 40 RETURN c_name, c_acctbal")


@query(f"SELECT {head('Customer', 'c_custkey')}, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 9000")
def project_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("MATCH Customer WHERE c_acctbal >= 9000 RETURN *")


@query("SELECT * FROM (VALUES (0, 'scan Doc'), (1, 'filter lang'), (2, 'text search bm25'), (3, 'project doc_id'), (4, 'limit 3 offset 0')) t(step, operator)")
def explain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = engine(spark, sf_dir).steps('MATCH Doc WHERE lang == "en" SIMILAR TO "x" SCORE BM25 LIMIT 3 RETURN doc_id')
    return spark.createDataFrame(list(enumerate(steps)), "step int, operator string")


@query(f"SELECT {head('Part', 'p_partkey')}, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_brand = 'Brand#11' AND p_size = 10")
def json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run(parse_json(json.dumps({"scan": {"type": "Part", "subject": "u"}, "filter": {"p_brand": "Brand#11", "p_size": 10}})))


# Search

_QUERY_WORDS = "[" + ", ".join(f"'{w}'" for w in tx.query_tokens(WORDS)) + "]"


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(
    f"""SELECT koid, type_name, version, round(score, 6) AS score, doc_id, lang FROM (
        SELECT {head('Doc', 'doc_id')}, doc_id, lang, {tokens_sql("concat_ws(' ', lang, source, text)")} AS w, {jaccard_sql('w', _QUERY_WORDS)} AS score FROM documents WHERE lang = 'en')
        ORDER BY score DESC, koid LIMIT 10"""
)
def text_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(engine(spark, sf_dir).run(f'MATCH Doc WHERE lang == "en" SIMILAR TO "{WORDS}" LIMIT 10 RETURN doc_id, lang'))


_BM25 = f"""d AS (SELECT 'doc/' || doc_id AS koid, doc_id, {tokens_sql("concat_ws(' ', lang, source, text)")} AS w FROM documents),
  s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM d), q AS (SELECT unnest({_QUERY_WORDS}) AS t),
  f AS (SELECT t, count(*) AS df FROM d, q WHERE list_contains(w, t) GROUP BY t)"""


@query(
    f"""WITH {_BM25} SELECT koid, 'Doc' AS type_name, 1::BIGINT AS version, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(w) / a))), 6) AS score, doc_id
        FROM d, s, f WHERE list_contains(w, t) GROUP BY koid, doc_id ORDER BY score DESC, koid LIMIT 10"""
)
def text_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(engine(spark, sf_dir).run(f'MATCH Doc SIMILAR TO "{WORDS}" SCORE BM25 LIMIT 10 RETURN doc_id'))


@query(f"SELECT token, count(*) AS objects FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tb.table(spark, sf_dir, "documents")
    return search.token_index(docs, F.col("text"), F.col("doc_id")).groupBy("token").agg(F.count(F.lit(1)).alias("objects"))


@query(f"SELECT doc_id AS koid, count(*) AS shared FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) WHERE list_contains({_QUERY_WORDS}, token) GROUP BY doc_id")
def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tb.table(spark, sf_dir, "documents")
    return search.candidates(search.token_index(docs, F.col("text"), F.col("doc_id")), WORDS)


_COS = f"list_cosine_similarity(embedding::DOUBLE[], {VECTOR}::DOUBLE[])"


@query(f"SELECT {head('Vector', 'vec_id')}, round({_COS}, 6) AS score, vec_id, label FROM embeddings ORDER BY {_COS} DESC, koid LIMIT 10")
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {"scan": {"type": "Vector", "subject": "u"}, "search": {"vector": VECTOR, "k": 10}}
    return _scored(engine(spark, sf_dir).run(parse_json(json.dumps(q))))


@query(f"SELECT {head('Vector', 'vec_id')}, round({_COS}, 6) AS score, vec_id, label FROM embeddings WHERE label % 2 = 1 ORDER BY {_COS} DESC, koid LIMIT 5")
def ann_model_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {"scan": {"type": "Vector", "subject": "u"}, "search": {"vector": VECTOR, "model": "m1"}}
    return _scored(engine(spark, sf_dir).run(parse_json(json.dumps(q))))


_SIDES = f"""h AS (SELECT 'doc/' || doc_id AS koid, {_COS} AS sv, {jaccard_sql(tokens_sql('text'), _QUERY_WORDS)} AS st FROM documents JOIN embeddings ON doc_id = vec_id),
  v AS (SELECT koid, sv AS score FROM h ORDER BY sv DESC, koid LIMIT 10), t AS (SELECT koid, st AS score FROM h ORDER BY st DESC, koid LIMIT 10),
  rv AS (SELECT koid, row_number() OVER (ORDER BY score DESC, koid) AS r FROM v WHERE score > 0), rt AS (SELECT koid, row_number() OVER (ORDER BY score DESC, koid) AS r FROM t WHERE score > 0)"""


@query(f"""WITH {_SIDES} SELECT koid, 'Hybrid' AS type_name, 1::BIGINT AS version, round(coalesce(1 / (61.0::DOUBLE + rv.r), 0) + coalesce(1 / (61.0::DOUBLE + rt.r), 0), 6) AS score, substr(koid, 5)::BIGINT AS doc_id
           FROM rv FULL JOIN rt USING (koid)""")
def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(engine(spark, sf_dir).run(f'MATCH Hybrid SIMILAR TO "{WORDS}" USING EMBEDDING bench RETURN doc_id'))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h, key = tb.hybrids(spark, d), F.col("ko.koid")
    return search.ann(h, F.col("ko.embedding"), VECTOR, 10, key), search.text_jaccard(h, F.col("text"), WORDS, 10, key)


@query(f"WITH {_SIDES} SELECT koid, round(coalesce(1 / (60.0::DOUBLE + rv.r), 0) + coalesce(1 / (60.0::DOUBLE + rt.r), 0), 6) AS score FROM rv FULL JOIN rt USING (koid)")
def fuse_rrf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(search.fuse_rrf(*_sides(spark, sf_dir), mode=search.RRF_RECALL))


@query(f"WITH {_SIDES} SELECT koid, round(0.7 * coalesce(v.score, 0) + 0.3 * coalesce(t.score, 0), 6) AS score FROM v FULL JOIN t USING (koid)")
def fuse_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(search.fuse_weighted(*_sides(spark, sf_dir), 0.7, 0.3))


@query(f"WITH {_SIDES} SELECT koid, round(score, 6) AS score FROM v")
def fuse_vector_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(search.fuse_one(_sides(spark, sf_dir)[0]))


@query(f"""WITH {_SIDES}, v2 AS (SELECT koid, sv AS score FROM h ORDER BY sv DESC, koid LIMIT 50), t2 AS (SELECT koid, st AS score FROM h ORDER BY st DESC, koid LIMIT 50),
  a AS (SELECT koid, row_number() OVER (ORDER BY score DESC, koid) AS r FROM v2 WHERE score > 0), b AS (SELECT koid, row_number() OVER (ORDER BY score DESC, koid) AS r FROM t2 WHERE score > 0)
  SELECT koid, round(coalesce(1 / (60.0::DOUBLE + a.r), 0) + coalesce(1 / (60.0::DOUBLE + b.r), 0), 6) AS score FROM a FULL JOIN b USING (koid)
  ORDER BY coalesce(1 / (60.0::DOUBLE + a.r), 0) + coalesce(1 / (60.0::DOUBLE + b.r), 0) DESC, koid LIMIT 8""")
def recall_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(search.recall_similar(tb.hybrids(spark, sf_dir), F.lit(True), VECTOR, WORDS, 8, NOW))


@query()
def trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the trigram embedding of their names, nearest to a misspelt one."""
    p = tb.table(spark, sf_dir, "part").withColumn("v", trigram_embedding("p_name"))
    return _scored(search.ann(p, F.col("v"), trigram_vector("smal stel rod"), 10, F.col("p_partkey"), [F.col("p_name")]))


# Time


@query(
    f"""WITH {USERS_SQL}, h AS (SELECT koid, max(commit_ts) AS c FROM users GROUP BY koid), live AS (SELECT koid FROM h JOIN users USING (koid) WHERE c = commit_ts AND state <> 'deleted'),
        s AS (SELECT koid, max(commit_ts) AS c FROM users WHERE commit_ts <= 1705276800000 * 65536 GROUP BY koid)
        SELECT koid, 'User' AS type_name, version, event_id, event_type FROM users JOIN s USING (koid) WHERE c = commit_ts AND state <> 'deleted'"""
)
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as they were then, those deleted since included."""
    return engine(spark, sf_dir).run('MATCH User AS_OF "2024-01-15" RETURN event_id, event_type')


@query(
    f"""WITH {USERS_SQL}, h AS (SELECT koid, max(commit_ts) AS c FROM users GROUP BY koid), live AS (SELECT koid FROM h JOIN users USING (koid) WHERE c = commit_ts AND state <> 'deleted')
        SELECT koid, 'User' AS type_name, version, event_id FROM users WHERE state <> 'deleted' AND koid IN (SELECT koid FROM live)"""
)
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("MATCH User HISTORICAL RETURN event_id")


@query(f"SELECT {head('Order', 'o_orderkey')}, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-02-01' AND epoch_ms(o_orderdate) + 7776000000 > epoch_ms(TIMESTAMP '1996-01-01')")
def between_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run('MATCH Order BETWEEN "1996-01-01" AND "1996-02-01" RETURN o_orderkey')


@query(_order_sql("TRUE", "o_orderkey"))
def valid_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_at(spark, sf_dir, "MATCH Order RETURN o_orderkey")


@query(_order_sql("o_orderstatus = 'F'", "o_orderkey, o_orderstatus"))
def epistemic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_at(spark, sf_dir, "MATCH Order EPISTEMIC verified, contradicted RETURN o_orderkey, o_orderstatus")


@query(f"SELECT {head('Doc', 'doc_id')}, doc_id FROM documents WHERE source = 'src3'")
def provenance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run('MATCH Doc SOURCE "src3" RETURN doc_id')


# Graph


def _walk_sql(starts: str, depth: int, a: str = "src", b: str = "dst", where: str = "TRUE") -> str:
    levels, seen = [f"l0 AS ({starts})"], "SELECT koid FROM l0"
    for i in range(1, depth + 1):
        levels.append(f"l{i} AS (SELECT {b} AS koid, min(rel_type) AS rel_type FROM edges JOIN (SELECT koid FROM l{i - 1}) f ON {a} = f.koid WHERE {where} AND {b} NOT IN ({seen}) GROUP BY {b})")
        seen += f" UNION ALL SELECT koid FROM l{i}"
    return f"WITH {EDGES_SQL}, " + ", ".join(levels) + " " + " UNION ALL ".join(f"SELECT koid, rel_type, {i} AS depth FROM l{i}" for i in range(1, depth + 1))


_RICH = "SELECT 'customer/' || c_custkey AS koid FROM customer WHERE c_acctbal > 9500"


@query(_walk_sql(_RICH, 1, where="rel_type = 'in_nation'"))
def traverse_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("MATCH Customer WHERE c_acctbal > 9500 TRAVERSE in_nation RETURN *")


@query(_walk_sql(_RICH, 2))
def traverse_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = tb.customers(spark, sf_dir).where("c_acctbal > 9500").select(F.col("ko.koid").alias("koid"))
    return graph.traverse(tb.edges(spark, sf_dir), starts, 2)


@query(_walk_sql("SELECT 'region/2' AS koid", 3, "dst", "src"))
def traverse_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traverse(tb.edges(spark, sf_dir), spark.createDataFrame([("region/2",)], "koid string"), 3, "in")


@query(
    _walk_sql("SELECT 'nation/7' AS koid", 2).replace(EDGES_SQL, EDGES_SQL.replace("edges AS", "one AS") + ", edges AS (SELECT * FROM one UNION ALL SELECT dst, rel_type, src FROM one)")
)
def traverse_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traverse(tb.edges(spark, sf_dir), spark.createDataFrame([("nation/7",)], "koid string"), 2, "both")


@query(_walk_sql("SELECT 'region/1' AS koid", 5, "dst", "src"))
def traverse_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deeper than there are levels: it ends when nothing is new."""
    return graph.impact(tb.edges(spark, sf_dir), spark.createDataFrame([("region/1",)], "koid string"), None, 5)


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, base AS (SELECT src, dst FROM edges),
        c AS (SELECT src, dst, 1 AS depth FROM base UNION ALL SELECT c.src, base.dst, depth + 1 FROM c JOIN base ON c.dst = base.src)
        SELECT src, dst, min(depth) AS depth FROM c GROUP BY src, dst"""
)
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(tb.edges(spark, sf_dir))


@query(
    f"""WITH {EDGES_SQL}, s AS (SELECT src AS a, rel_type, dst AS b FROM edges UNION ALL SELECT dst, rel_type, src FROM edges),
        p1 AS (SELECT [a, b] AS path, [rel_type] AS relations FROM s WHERE a = 'nation/3'),
        p2 AS (SELECT list_append(path, b) AS path, list_append(relations, rel_type) AS relations FROM p1 JOIN s ON path[-1] = a WHERE NOT list_contains(path, b))
        SELECT array_to_string(path, '>') AS path, len(relations)::INTEGER AS steps FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""
)
def expand_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.paths(tb.edges(spark, sf_dir), "nation/3", 2)
    return out.select(F.concat_ws(">", "path").alias("path"), F.size("relations").alias("steps"))


@query("SELECT 'customer/' || c_custkey AS src, 'prefers' AS rel_type, 'supplier/' || c_custkey AS dst FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def relate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New edges with both ends alive; those that point nowhere or are there already are left out."""
    c = tb.table(spark, sf_dir, "customer")
    new = c.select(tb.ref("customer", "c_custkey").alias("src"), F.lit("prefers").alias("rel_type"), tb.ref("supplier", "c_custkey").alias("dst"))
    new = new.unionAll(tb.edges(spark, sf_dir).where("src LIKE 'supplier%'"))
    live = tb.customers(spark, sf_dir).select("ko.koid").unionAll(tb.suppliers(spark, sf_dir).select("ko.koid"))
    return graph.relate(tb.edges(spark, sf_dir), new, live)


# Ontology

PARTY = Ontology({"Party": None, "Customer": "Party", "Supplier": "Party"}, (Relationship("in_nation", "Party", "Nation", "one"),))


@query("""SELECT 'customer/' || c_custkey AS koid, 'Customer' AS type_name, 1::BIGINT AS version, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 8000
          UNION ALL SELECT 'supplier/' || s_suppkey, 'Supplier', 1, s_name, s_acctbal FROM supplier WHERE s_acctbal > 8000""")
def ontology_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.customers(spark, sf_dir).withColumnsRenamed({"c_name": "name", "c_acctbal": "balance"})
    s = tb.suppliers(spark, sf_dir).withColumnsRenamed({"s_name": "name", "s_acctbal": "balance"})
    return Engine(Catalog({"Customer": c, "Supplier": s}, ontology=PARTY), now=NOW).run("MATCH Party WHERE balance > 8000 RETURN name, balance")


def _open(spark: SparkSession, d: str) -> DataFrame:
    return opened(tb.customers(spark, d)).unionByName(opened(tb.suppliers(spark, d))).unionByName(opened(tb.parts(spark, d)))


@query("SELECT 'Customer' AS type_name, count(*) AS objects FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part")
def ontology_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover_types(_open(spark, sf_dir))


_KINDS = {"Customer": ("customer", {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "text"}), "Supplier": ("supplier", {"s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "float"}), "Part": ("part", {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "float"})}


@query(" UNION ALL ".join(f"SELECT '{t}' AS type_name, '{p}' AS property, '{k}' AS kind, count(*) AS objects FROM {n}" for t, (n, ps) in _KINDS.items() for p, k in ps.items()))
def ontology_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover_properties(_open(spark, sf_dir))


@query(f"""WITH {EDGES_SQL} SELECT rel_type, split_part(src, '/', 1) AS domain, split_part(dst, '/', 1) AS "range", count(*) AS edges FROM edges GROUP BY 1, 2, 3""")
def ontology_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.edges(spark, sf_dir)
    ids = e.select(F.col("src").alias("koid")).unionAll(e.select("dst")).distinct()
    return discover_relationships(e, ids.withColumn("type_name", F.split_part("koid", F.lit("/"), F.lit(1))))


# Access


@query("""SELECT 'customer/' || c_custkey AS koid FROM customer WHERE c_mktsegment = 'BUILDING'
          OR (c_mktsegment = 'AUTOMOBILE' AND c_acctbal >= 0)""")
def acl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner of one segment who is an intern: own rows, and those that interns may read; a denial wins."""
    c = tb.customers(spark, sf_dir)
    c = c.withColumn("ko", F.col("ko").withField("tenant", F.lit(None).cast("string")))
    return c.where(may(Subject("BUILDING", ("intern",)))).select("ko.koid")


@query("SELECT 'customer/' || c_custkey AS koid FROM customer WHERE c_nationkey = 4")
def tenant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An administrator sees all of the own tenant, and nothing of others."""
    return tb.customers(spark, sf_dir).where(may(Subject("root", tenant="t4", admin=True))).select("ko.koid")


@query("SELECT 'customer/' || c_custkey AS koid FROM customer WHERE c_acctbal < 0 OR c_mktsegment <> 'AUTOMOBILE' OR c_mktsegment IS NULL OR c_mktsegment = 'AUTOMOBILE'")
def type_policy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No entry of the list speaks of staff but for low balances; the type's policy opens the rest."""
    c = tb.customers(spark, sf_dir).withColumn("ko", F.col("ko").withField("tenant", F.lit(None).cast("string")))
    return c.where(may(Subject("ann", ("staff",)), policies=Policies(allow={("Customer", "read"): ("staff",)}))).select("ko.koid")


@query("""WITH RECURSIVE inherits AS (SELECT 'n' || n_nationkey AS role, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'all' FROM region),
          g AS (SELECT 'c' || c_custkey AS principal, 'n' || c_nationkey AS role FROM customer),
          c AS (SELECT principal, role FROM g UNION ALL SELECT principal, parent FROM c JOIN inherits USING (role)) SELECT DISTINCT principal, role FROM c""")
def role_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, r = tb.table(spark, sf_dir, "nation"), tb.table(spark, sf_dir, "region")
    inherits = n.select(text("n", "n_nationkey").alias("role"), text("r", "n_regionkey").alias("parent")).unionAll(r.select(text("r", "r_regionkey"), F.lit("all")))
    grants = tb.table(spark, sf_dir, "customer").select(text("c", "c_custkey").alias("principal"), text("n", "c_nationkey").alias("role"))
    return roles_of(grants, inherits)


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'errors' WHEN value > 50 THEN 'large' WHEN event_type = 'purchase' THEN 'buyers' END AS rule,
          CASE WHEN event_type = 'error' THEN 'deny' WHEN value > 50 THEN 'review' WHEN event_type = 'purchase' THEN 'allow' ELSE 'deny' END AS effect FROM events""")
def policy_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.table(spark, sf_dir, "events")
    rule, effect = first_match(e, (("errors", F.col("event_type") == "error", "deny"), ("large", F.col("value") > 50, "review"), ("buyers", F.col("event_type") == "purchase", "allow")))
    return e.select("event_id", rule.alias("rule"), effect.alias("effect"))


@query(f"SELECT {head('Part', 'p_partkey')}, p_name FROM part WHERE p_size = 11 AND p_brand = 'Brand#2'")
def stored_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.programs import Program, Runner

    p = Program("parts", "MATCH Part WHERE p_size == {{size}} AND p_brand == {{brand}} RETURN p_name")
    return Runner(engine(spark, sf_dir)).run(p, {"size": 11, "brand": "Brand#2"})


@query("SELECT p_brand, count(*) AS parts FROM part WHERE p_size > 40 GROUP BY p_brand")
def named_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.programs import create_view

    create_view(engine(spark, sf_dir), spark, "large_parts", "MATCH Part WHERE p_size > 40 RETURN *")
    return spark.sql("SELECT p_brand, count(*) AS parts FROM large_parts GROUP BY p_brand")


@query(f"WITH {EDGES_SQL} SELECT dst AS koid, rel_type, 1 AS depth FROM edges WHERE src = 'order/1'")
def json_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run(parse_json('{"traverse": {"start": "order/1"}}'))
