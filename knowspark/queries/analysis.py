"""Aggregates, constraints, provenance, resolution, conflicts, rules and mutations over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates, claims, constraints, evals, graph, infer, knowledge, mutate, provenance, resolution, search, temporal
from ..operators.ontology import Ontology, Relationship
from ..schema import opened
from . import query
from . import tables as tb
from .tables import EDGES_SQL, STATEMENTS_SQL, USERS_SQL, jaccard_sql, space_jaccard_sql, space_words_sql, tokens_sql

NOW = 800_000_000_000

# Aggregates


@query("SELECT CASE o_orderstatus WHEN 'P' THEN 'Order' ELSE 'Order' END AS type_name, count(*) AS objects FROM orders GROUP BY 1 UNION ALL SELECT 'Customer', count(*) FROM customer")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tb.orders(spark, sf_dir).select("ko").unionByName(tb.customers(spark, sf_dir).select("ko"))
    return aggregates.count_by_type(both)


@query(f"WITH {USERS_SQL} SELECT 'User' AS type_name, state, count(*) AS objects FROM users GROUP BY state UNION ALL SELECT 'Order', CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'active' END, count(*) FROM orders GROUP BY 2")
def lifecycle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.lifecycle_metrics(tb.user_versions(spark, sf_dir).select("ko").unionByName(tb.orders(spark, sf_dir).select("ko")))


@query(f"""SELECT count(*) FILTER (e IS NULL) AS unlimited, count(*) FILTER (e > {NOW}) AS limited, count(*) FILTER (e > {NOW} AND e <= {NOW} + 2592000000) AS expiring,
           count(*) FILTER (e <= {NOW}) AS expired FROM (SELECT epoch_ms(o_orderdate) + 7776000000 AS e FROM orders)""")
def retention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.retention_summary(tb.orders(spark, sf_dir), NOW, 30 * tb.DAY)


@query("""SELECT 'Order' AS type_name, CASE WHEN o_orderstatus = 'P' THEN 'extracted' ELSE 'active' END AS state, count(*) AS objects, 0::BIGINT AS with_evidence,
          count(*) FILTER (o_orderstatus = 'F') AS verified FROM orders GROUP BY 2 UNION ALL SELECT 'Doc', 'active', count(*), count(*), 0 FROM documents""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.audit_report(tb.orders(spark, sf_dir).select("ko").unionByName(tb.docs(spark, sf_dir).select("ko")))


# Inference and constraints

_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return infer.profile(tb.table(spark, d, "part"), _COLUMNS)


@query(" UNION ALL ".join(f"SELECT '{c}' AS property, count({c})::DOUBLE / count(*) AS confidence FROM part" for c in _COLUMNS))
def infer_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.not_null(_profile(spark, sf_dir))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS property, count(DISTINCT {c})::DOUBLE / count({c}) AS confidence FROM part" for c in _COLUMNS) + ") WHERE confidence >= 0.9")
def infer_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.unique(_profile(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{c}' AS property, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM part" for c in ("p_partkey", "p_size", "p_retailprice")))
def infer_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.value_range(_profile(spark, sf_dir))


@query("""SELECT l_orderkey || '/' || l_linenumber AS koid, rule FROM lineitem, (VALUES ('net'), ('parity'), ('tax')) r(rule)
          WHERE (rule = 'net' AND NOT l_extendedprice * (1 - l_discount) > 2000) OR (rule = 'parity' AND NOT (l_linenumber // 2 * 2 = l_linenumber OR l_quantity < 49))
             OR (rule = 'tax' AND NOT (CASE WHEN l_returnflag = 'R' THEN l_tax <= 0.07 ELSE TRUE END))""")
def check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tb.table(spark, sf_dir, "lineitem")
    rules = constraints.check_rules(li, {"net": "l_extendedprice * (1 - l_discount) > 2000", "parity": "l_linenumber / 2 * 2 == l_linenumber OR l_quantity < 49", "tax": 'IF(l_returnflag == "R", l_tax <= 0.07, true)'})
    return constraints.violations(li, F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), rules)


@query("""SELECT 'order/' || o_orderkey AS koid, rule FROM orders, (VALUES ('o_totalprice:range'), ('o_orderstatus:enum'), ('o_orderpriority:pattern'), ('o_orderpriority:length'), ('o_orderkey:format')) r(rule)
          WHERE (rule = 'o_totalprice:range' AND NOT o_totalprice BETWEEN 1000 AND 400000) OR (rule = 'o_orderstatus:enum' AND o_orderstatus NOT IN ('F', 'O'))
             OR (rule = 'o_orderpriority:pattern' AND NOT regexp_matches(o_orderpriority, '^[1-4]-')) OR (rule = 'o_orderpriority:length' AND NOT strlen(o_orderpriority) BETWEEN 5 AND 12)
             OR rule = 'o_orderkey:format'""")
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tb.table(spark, sf_dir, "orders")
    rules = constraints.domain_rules(o, {"o_totalprice": ("range", 1000, 400000), "o_orderstatus": ("enum", "F", "O"), "o_orderkey": ("format", "uuid")})
    rules |= constraints.domain_rules(o, {"o_orderpriority": ("pattern", "^[1-4]-")}) | constraints.domain_rules(o, {"o_orderpriority": ("length", 5, 12)})
    return constraints.violations(o, tb.ref("order", "o_orderkey"), rules)


@query("SELECT url, count(*) AS objects FROM (SELECT regexp_replace(url, '[0-9]+.*$', '') AS url FROM pages WHERE url IS NOT NULL) GROUP BY url HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tb.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "[0-9]+.*$", "").alias("url"))
    return constraints.duplicates(pages, ["url"])


@query("SELECT o_custkey AS tenant, o_orderpriority, o_orderstatus, count(*) AS objects FROM orders GROUP BY ALL HAVING count(*) > 1")
def unique_violations_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tb.table(spark, sf_dir, "orders").withColumn("tenant", F.col("o_custkey"))
    return constraints.duplicates(o, ["o_orderpriority", "o_orderstatus"], [F.col("tenant")])


@query(f"""WITH {EDGES_SQL}, live AS (SELECT 'nation/' || n_nationkey AS koid FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 'customer/' || c_custkey FROM customer UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier)
           SELECT src, rel_type, dst, 'missing' AS rule FROM edges WHERE rel_type = 'in_nation' AND dst NOT IN (SELECT koid FROM live)
           UNION ALL SELECT src, rel_type, dst, 'domain' FROM edges WHERE rel_type = 'in_nation' AND src LIKE 'supplier%'""")
def relationship_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations from 20 on do not exist here, and suppliers are not in the relationship's domain."""
    kind = lambda t, name, key, prefix: tb.table(spark, sf_dir, t).select(tb.ref(prefix, key).alias("koid"), F.lit(name).alias("type_name"))
    objects = kind("customer", "Customer", "c_custkey", "customer").unionAll(kind("supplier", "Supplier", "s_suppkey", "supplier"))
    objects = objects.unionAll(tb.table(spark, sf_dir, "nation").where("n_nationkey < 20").select(tb.ref("nation", "n_nationkey"), F.lit("Nation")))
    o = Ontology({"Customer": None, "Supplier": None, "Nation": None}, (Relationship("in_nation", "Customer", "Nation", "one"),))
    return constraints.relationship_violations(tb.edges(spark, sf_dir).where("rel_type = 'in_nation'"), objects, o)


# Evaluation


@query("""WITH e AS (SELECT lang AS "query", doc_id AS koid FROM documents WHERE source = 'src1'), f AS (SELECT lang AS "query", doc_id AS koid FROM documents WHERE n_chars > 1000)
          SELECT "query", count(*) AS expected, count(f.koid) AS hits, count(f.koid)::DOUBLE / count(*) AS recall FROM e LEFT JOIN f USING ("query", koid) GROUP BY "query" """)
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.table(spark, sf_dir, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("koid"), "source", "n_chars")
    return evals.recall_at_k(d.where("source = 'src1'"), d.where("n_chars > 1000"))


@query("""WITH a AS (SELECT date_diff('day', o_orderdate, TIMESTAMP '2000-01-01')::BIGINT AS age FROM orders), s AS (SELECT list_sort(list(age)) AS l FROM a)
          SELECT count(age) AS objects, floor(avg(age))::BIGINT AS mean_age, max(age) AS max_age, (SELECT l[floor((len(l) - 1) * 0.95)::INTEGER + 1] FROM s) AS p_age FROM a""")
def eval_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tb.table(spark, sf_dir, "orders").select(F.expr("datediff(date'2000-01-01', cast(o_orderdate as date))").cast("long").alias("age"))
    return evals.staleness(days, "age")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)
          SELECT 'vector/' || x.vec_id AS a, 'vector/' || y.vec_id AS b, round(list_cosine_similarity(x.e, y.e), 6) AS similarity FROM v x JOIN v y ON 'vector/' || x.vec_id < 'vector/' || y.vec_id
          WHERE x.label <> y.label AND list_cosine_similarity(x.e, y.e) >= 0.4""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of the type against each other."""
    v = tb.vectors(spark, sf_dir)
    out = evals.contradictions(v, F.col("ko.embedding"), F.col("label"), F.col("ko.type_name"), 0.4, F.col("ko.koid"))
    return out.withColumn("similarity", F.round("similarity", 6))


# Journal


@query("SELECT event_id AS seq, 'user/' || user_id AS koid, event_type AS kind FROM events WHERE event_id > 5000 AND event_type IN ('error', 'signup')")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.after(tb.journal(spark, sf_dir), 5000, kinds=("error", "signup")).select("seq", "koid", "kind")


@query("""WITH RECURSIVE j AS (SELECT event_id AS seq, 'user/' || user_id AS koid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type AS kind, epoch_us(ts) // 1000 AS ts,
            sha256(event_type || '|' || event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
          c AS (SELECT koid, seq, i, sha256(concat_ws('|', repeat('0', 64), seq, koid, version, kind, ts, p, '-', 'import', '-')) AS own_hash FROM j WHERE i = 1
            UNION ALL SELECT j.koid, j.seq, j.i, sha256(concat_ws('|', c.own_hash, j.seq, j.koid, j.version, j.kind, j.ts, j.p, '-', 'import', '-')) FROM c JOIN j ON j.koid = c.koid AND j.i = c.i + 1)
          SELECT koid, seq, own_hash FROM c""")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of all users, built object by object."""
    return provenance.chain(tb.journal(spark, sf_dir)).select("koid", "seq", "own_hash")


@query("""WITH j AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events)
          SELECT 'user/' || user_id AS koid, event_id AS seq, 'altered' AS problem FROM j WHERE event_id % 1000 = 7
          UNION ALL SELECT 'user/' || user_id, event_id, 'payload differs' FROM j WHERE event_id % 500 = 3""")
def prove_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal in which some notes were altered, and some payloads no longer match."""
    j = provenance.chain(tb.journal(spark, sf_dir))
    payloads = j.select("koid", "version", F.when(F.col("seq") % 500 == 3, F.lit("other")).otherwise(F.col("payload_hash")).alias("payload_hash"))
    forged = j.withColumn("note", F.when(F.col("seq") % 1000 == 7, "forged").otherwise(F.col("note")))
    return provenance.prove(forged, payloads)


@query(f"""WITH {USERS_SQL} SELECT koid, version, NULL::VARCHAR AS origin, event_id AS seq, event_type AS kind FROM users WHERE koid IN ('user/3', 'user/11')""")
def trace_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([("user/3",), ("user/11",)], "koid string")
    return provenance.trace(tb.user_versions(spark, sf_dir), tb.journal(spark, sf_dir), ids).select("koid", "version", "origin", "seq", "kind")


@query("""SELECT lang AS "group", count(DISTINCT source) AS sources FROM documents WHERE n_chars > 10000 GROUP BY lang HAVING count(DISTINCT source) >= 2""")
def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.independent_sources(tb.docs(spark, sf_dir).where("n_chars > 10000"), F.col("lang"))


@query("SELECT 'doc/' || d.doc_id AS koid, 'DERIVED_FROM' AS rel_type, 1 AS depth FROM documents d WHERE d.doc_id = 40 UNION ALL SELECT 'doc/20', 'DERIVED_FROM', 2 UNION ALL SELECT 'doc/10', 'DERIVED_FROM', 3 UNION ALL SELECT 'doc/5', 'DERIVED_FROM', 4")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document was made from the one of half its number."""
    d = tb.table(spark, sf_dir, "documents").where("doc_id > 0")
    e = d.select(tb.ref("doc", "doc_id").alias("src"), F.lit("DERIVED_FROM").alias("rel_type"), tb.ref("doc", F.floor(F.col("doc_id") / 2)).alias("dst"))
    return provenance.lineage(e, spark.createDataFrame([("doc/80",)], "koid string"), 4)


# Resolution and merging


@query("""SELECT lang AS document, n AS "key", min(name) AS name, min(hint) AS type_hint, list_sort(list(DISTINCT doc_id::VARCHAR)) AS mentions, least(count(*) * 0.125, 1.0)::DOUBLE AS confidence
          FROM (SELECT doc_id, lang, upper(source) AS name, lower(source) AS n, 'Source' AS hint FROM documents) GROUP BY lang, n""".replace("list_sort(list(DISTINCT doc_id::VARCHAR)) AS mentions", "array_to_string(list_sort(list(DISTINCT doc_id::VARCHAR)), ',') AS mentions"))
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.table(spark, sf_dir, "documents")
    e = d.select(F.col("lang").alias("document"), F.upper("source").alias("name"), F.lit("Source").alias("type_hint"), F.array(F.col("doc_id").cast("string")).alias("mentions"), F.lit(0.125).alias("confidence"))
    return resolution.merge_entities(e).withColumn("mentions", F.concat_ws(",", "mentions"))


@query("SELECT o_orderstatus AS statement, least(count(*) * 0.0625, 1.0)::DOUBLE AS confidence, max(o_orderpriority) AS trust FROM orders GROUP BY 1")
def merge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tb.table(spark, sf_dir, "orders")
    f = o.select(F.col("o_orderstatus").alias("statement"), F.array(F.col("o_orderpriority")).alias("entities"), F.lit(0.0625).alias("confidence"), F.col("o_orderpriority").alias("trust"))
    return resolution.merge_facts(f).drop("entities")


@query("SELECT p_brand AS subject, 'has' AS predicate, p_type AS object, least(count(*) * 0.25, 1.0)::DOUBLE AS confidence FROM part GROUP BY 1, 3")
def merge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tb.table(spark, sf_dir, "part").select(F.col("p_brand").alias("subject"), F.lit("has").alias("predicate"), F.col("p_type").alias("object"), F.lit(0.25).alias("confidence"))
    return resolution.merge_relations(r)


_COMMON = "len(list_filter(tm, lambda w: list_contains(tk, w)))"
_NAME_SQL = f"""m AS (SELECT p_partkey AS mention, p_name AS name, lower(p_name) AS x, {space_words_sql('lower(p_name)')} AS tm FROM part),
  k AS (SELECT 'part/' || min(p_partkey) AS candidate, s AS name, lower(s) AS y, {space_words_sql('lower(s)')} AS tk FROM (SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS s FROM part) GROUP BY s),
  pairs AS (SELECT mention, candidate, m.name AS a, k.name AS b, x, y, len(tm) AS lt, len(tk) AS lu, {_COMMON} AS n FROM m, k),
  scored AS (SELECT mention, candidate, CASE WHEN a = b THEN 1.0::DOUBLE WHEN x = y THEN 0.95 WHEN contains(x, y) OR contains(y, x) THEN 0.8::DOUBLE * least(strlen(x), strlen(y)) / greatest(strlen(x), strlen(y)) + 0.1
      WHEN lt >= 2 AND lu >= 2 AND n > 0 THEN 0.7::DOUBLE * n / (lt + lu - n) WHEN (lt < 2 OR lu < 2) AND n > 0 THEN 0.5 ELSE 0.0 END AS score FROM pairs),
  r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, candidate) AS n FROM scored WHERE score > 0),
  best AS (SELECT mention, max(CASE WHEN n = 1 THEN score END) AS s, max(CASE WHEN n = 1 THEN candidate END) AS c, max(CASE WHEN n = 2 THEN score END) AS t FROM r GROUP BY mention)"""


@query(
    f"""WITH {_NAME_SQL} SELECT m.mention, CASE WHEN s >= 0.5 THEN c END AS candidate, round(coalesce(s, 0), 6) AS score,
        CASE WHEN s IS NULL OR s < 0.5 THEN 'unmatched' WHEN coalesce(s - t < 0.15, FALSE) THEN 'ambiguous' ELSE 'matched' END AS verdict FROM m LEFT JOIN best USING (mention)"""
)
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolve_names(*tb.names(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), k AS (SELECT label AS candidate, arg_min(e, vec_id) AS e FROM v GROUP BY label),
          s AS (SELECT vec_id AS mention, candidate, list_cosine_similarity(v.e, k.e) AS score FROM v, k),
          r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, candidate) AS n FROM s), b AS (SELECT mention, max(CASE WHEN n = 1 THEN score END) AS s, max(CASE WHEN n = 1 THEN candidate END) AS c, max(CASE WHEN n = 2 THEN score END) AS t FROM r GROUP BY 1)
          SELECT vec_id AS mention, CASE WHEN s >= 0.2 THEN c END AS candidate, round(coalesce(s, 0), 6) AS score, CASE WHEN s IS NULL OR s < 0.2 THEN 'unmatched' WHEN coalesce(s - t < 0.05, FALSE) THEN 'ambiguous' ELSE 'matched' END AS verdict
          FROM v LEFT JOIN b ON vec_id = mention""")
def resolve_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against the first one of each label."""
    e = tb.table(spark, sf_dir, "embeddings")
    mentions = e.select(F.col("vec_id").alias("mention"), F.lit(0).alias("block"), F.col("embedding").alias("vector"))
    known = e.groupBy(F.col("label").alias("koid")).agg(F.lit(0).alias("block"), F.min_by("embedding", "vec_id").alias("vector"))
    return resolution.resolve_vectors(mentions, known, 0.2, 0.05).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_NAME_SQL}, v AS (SELECT m.mention, CASE WHEN s >= 0.5 THEN c END AS candidate, CASE WHEN s IS NULL OR s < 0.5 THEN 'unmatched' WHEN coalesce(s - t < 0.15, FALSE) THEN 'ambiguous' ELSE 'matched' END AS verdict FROM m LEFT JOIN best USING (mention))
        SELECT mention, candidate, CASE WHEN verdict = 'ambiguous' THEN 'review' WHEN verdict <> 'matched' THEN 'create' WHEN p_size / 50.0 > 0.5 THEN 'update' ELSE 'skip' END AS action, CASE WHEN verdict = 'ambiguous' THEN 'warning' END AS conflict
        FROM v JOIN part ON p_partkey = mention"""
)
def commit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions, known = tb.names(spark, sf_dir)
    sure = mentions.join(tb.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mention"), (F.col("p_size") / 50).alias("confidence")), "mention")
    return resolution.commit_plan(sure, resolution.resolve_names(mentions, known), known.withColumn("confidence", F.lit(0.5)))


@query("""SELECT coalesce(n.koid, o.koid) AS koid, CASE WHEN o.koid IS NULL THEN 'new' WHEN n.koid IS NULL THEN 'gone' WHEN n.h <> o.h THEN 'changed' ELSE 'same' END AS change, 'run-2' AS run, 'shop' AS source
          FROM (SELECT 'customer/' || c_custkey AS koid, c_nationkey AS h FROM customer WHERE c_custkey % 7 <> 0) n FULL JOIN (SELECT 'customer/' || c_custkey AS koid, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END AS h FROM customer WHERE c_custkey % 3 <> 0) o USING (koid)""")
def import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.table(spark, sf_dir, "customer")
    new = c.where("c_custkey % 7 <> 0").select(tb.ref("customer", "c_custkey").alias("koid"), F.col("c_nationkey").alias("payload_hash"))
    old = c.where("c_custkey % 3 <> 0").select(tb.ref("customer", "c_custkey").alias("koid"), F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(F.col("c_nationkey")).alias("payload_hash"))
    return resolution.import_merge(old, new, "run-2", "shop")


# Knowledge


def _negated_sql() -> str:
    both = [pair for p in knowledge.NEGATIONS for pair in (p, p[::-1])]
    rest = lambda x, p: f"replace({x}, '{p}', '')"
    return " OR ".join(f"(contains(la, '{p}') AND contains(lb, '{q}') AND {space_jaccard_sql(rest('la', p), rest('lb', q), 1.0)} > 0.4)" for p, q in both)


_PAIRS_SQL = f"""{STATEMENTS_SQL}, p AS (SELECT a.entity, a.fact AS a, b.fact AS b, a.statement AS sa, b.statement AS sb, lower(a.statement) AS la, lower(b.statement) AS lb, a.confidence AS ca, b.confidence AS cb
   FROM facts a JOIN facts b ON a.entity = b.entity AND a.fact < b.fact),
   q AS (SELECT *, {_negated_sql()} AS negated, {space_jaccard_sql('sa', 'sb', 1.0)} AS near, {space_jaccard_sql('la', 'lb', 0.0)} AS s FROM p),
   c AS (SELECT entity, a, b, 'conflict' AS kind FROM q WHERE negated UNION ALL SELECT entity, a, b, 'ambiguous' FROM q WHERE near > 0.7 AND near < 0.95)"""


@query(f"WITH {_PAIRS_SQL} SELECT entity, a, b, kind FROM c")
def find_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.find_conflicts(tb.statements(spark, sf_dir))


@query(f"""WITH {_PAIRS_SQL} SELECT entity, CASE WHEN ca >= cb THEN b ELSE a END AS stale, CASE WHEN ca >= cb THEN a ELSE b END AS current,
       CASE WHEN {" OR ".join(f"contains(la, '{w}') <> contains(lb, '{w}')" for w in knowledge.CONTRARIES)} THEN 'conflict' ELSE 'divergence' END AS kind FROM q WHERE la <> lb AND s <= 0.85""")
def detect_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.detect_staleness(tb.statements(spark, sf_dir))


@query("""WITH w AS (SELECT DISTINCT lang, regexp_extract(coalesce(text, ''), '^[a-zA-Z]+') AS e FROM documents), a AS (SELECT e FROM w WHERE lang = 'en'), b AS (SELECT e FROM w WHERE lang = 'es')
          SELECT coalesce(a.e, b.e) AS entity, CASE WHEN b.e IS NULL THEN 'documented only' ELSE 'undocumented' END AS kind FROM a FULL JOIN b ON a.e = b.e WHERE a.e IS NULL OR b.e IS NULL""")
def find_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that open English documents against those that open Spanish ones."""
    d = tb.table(spark, sf_dir, "documents").withColumn("entity", F.regexp_extract(F.coalesce("text", F.lit("")), "^[a-zA-Z]+", 0))
    return knowledge.find_stale(d.where("lang = 'en'"), d.where("lang = 'es'"))


@query(f"""WITH {STATEMENTS_SQL}, a AS (SELECT * FROM facts), b AS (SELECT * FROM facts WHERE fact LIKE '%MACHINERY')
           SELECT a.entity, a.fact FROM a LEFT JOIN b USING (entity) GROUP BY 1, 2 HAVING max(coalesce({jaccard_sql(tokens_sql('a.statement'), tokens_sql('b.statement'))}, 0)) <= 0.75""")
def uncorroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tb.statements(spark, sf_dir)
    return knowledge.uncorroborated(f, f.where("fact like '%MACHINERY'"), 0.75)


@query(f"""WITH {EDGES_SQL}, d AS (SELECT DISTINCT 'customer/' || c_custkey AS entity FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)
           SELECT entity, 'direct' AS impact FROM d UNION ALL
           SELECT DISTINCT o, 'indirect' FROM (SELECT dst AS o, src AS e FROM edges UNION ALL SELECT src, dst FROM edges) WHERE e IN (SELECT entity FROM d) AND o NOT IN (SELECT entity FROM d)""")
def reconcile_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.table(spark, sf_dir, "customer").where("c_acctbal > 9000")
    sources = c.select(tb.ref("customer", "c_custkey").alias("entity"), F.col("c_mktsegment").alias("file"))
    e = tb.edges(spark, sf_dir).select(F.col("src").alias("subject"), F.col("dst").alias("object"))
    return knowledge.reconcile(spark.createDataFrame([("BUILDING",)], "file string"), sources, e)


@query(f"""WITH w AS (SELECT doc_id AS file, unnest({tokens_sql('text')}) AS w FROM documents), n(name, m) AS (VALUES ('Market', 'market'), ('Market', 'price'), ('The', 'the'), ('Onward', 'and'), ('Onward', 'onward'), ('Elle', 'elle'), ('Der', 'der')),
           h AS (SELECT file, name, max(CASE WHEN lower(name) = w THEN 0.9 ELSE 0.6 END) AS s FROM w JOIN n ON m = w GROUP BY 1, 2)
           SELECT file, count(*) AS affected, max(s)::DOUBLE AS score, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS risk FROM h GROUP BY file""")
def validate_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = spark.createDataFrame([("Market", ["price"]), ("The", []), ("Onward", ["and"]), ("Elle", []), ("Der", None)], "name string, mentions array<string>")
    files = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    return knowledge.validate_change(entities, files)


@query(f"""WITH {STATEMENTS_SQL}, {EDGES_SQL}, o AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
           SELECT (SELECT array_to_string(list_sort(list(DISTINCT statement)), ';') FROM facts WHERE entity = 'NATION_6') AS facts, (SELECT array_to_string(list_sort(list(DISTINCT r_name)), ';') FROM o WHERE n_name = 'NATION_6') AS dependencies""")
def explain_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = tb.table(spark, sf_dir, "nation"), tb.table(spark, sf_dir, "region")
    rel = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("depends_on").alias("predicate"), F.col("r_name").alias("object"))
    out = knowledge.explain_component("NATION_6", tb.statements(spark, sf_dir), rel)
    return out.select(F.concat_ws(";", "facts").alias("facts"), F.concat_ws(";", "dependencies").alias("dependencies"))


@query(f"WITH {STATEMENTS_SQL} SELECT 0 AS hop, entity, statement FROM facts WHERE entity IN (SELECT entity FROM facts WHERE statement LIKE '%of nation_6 %') UNION ALL SELECT 1, entity, statement FROM facts WHERE entity IN (SELECT b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name = 'NATION_6' AND b.n_name <> 'NATION_6')")
def trace_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tb.table(spark, sf_dir, "nation")
    rel = n.alias("a").join(n.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).where("a.n_name <> b.n_name").select(F.col("a.n_name").alias("subject"), F.lit("near").alias("predicate"), F.col("b.n_name").alias("object"))
    return knowledge.trace_requirement("of nation_6 ", tb.statements(spark, sf_dir), rel, 2)


@query(f"WITH {STATEMENTS_SQL} SELECT 'fact' AS kind, statement AS item FROM facts WHERE entity = 'NATION_12' UNION ALL SELECT 'relation', n_name || ' in ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_12'")
def expand_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = tb.table(spark, sf_dir, "nation"), tb.table(spark, sf_dir, "region")
    rel = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("in").alias("predicate"), F.col("r_name").alias("object"))
    return knowledge.expand_entity("NATION_12", tb.statements(spark, sf_dir), rel)


@query(f"WITH {_PAIRS_SQL} SELECT entity, a, b, CASE WHEN kind = 'conflict' THEN 'supersede' ELSE 'merge' END AS action, CASE WHEN kind = 'conflict' THEN 'VALIDATED' ELSE 'PROPOSED' END AS status, kind = 'conflict' AS moved FROM c")
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts are validated; a step that is not legal (accepting what was never validated) moves nothing."""
    p = knowledge.propose(knowledge.find_conflicts(tb.statements(spark, sf_dir)))
    wanted = p.select("proposal", F.when(F.col("action") == "supersede", "VALIDATED").otherwise("ACCEPTED").alias("to"))
    return knowledge.advance(p, wanted).drop("proposal")


@query("""SELECT 'late' AS rule, 'order/' || o_orderkey AS koid, 'urgent and open' AS conclusion FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'
          UNION ALL SELECT 'partial', 'order/' || o_orderkey, 'look again' FROM orders WHERE o_orderstatus = 'P'""")
def rule_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (("late", {"o_orderpriority": "1-URGENT", "o_orderstatus": "O"}, "urgent and open"), ("partial", {"o_orderstatus": "P"}, "look again"), ("none", {"missing": 1}, "never"))
    return knowledge.fire_rules(tb.orders(spark, sf_dir), rules)


@query(f"""WITH s AS (SELECT p_partkey, p_brand, p_size, {jaccard_sql(tokens_sql('p_name'), "['large', 'steel', 'rod']")} AS score FROM part)
           SELECT arg_min(p_brand, struct_pack(s := -score, k := 'part/' || p_partkey)) AS p_brand, arg_min(p_size, struct_pack(s := -score, k := 'part/' || p_partkey)) FILTER (p_size > 20) AS p_size FROM s""")
def predict_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.table(spark, sf_dir, "part")
    score = tx.jaccard(tx.tokens(F.col("p_name")), F.array(F.lit("large"), F.lit("steel"), F.lit("rod")))
    ranked = p.select(tb.ref("part", "p_partkey").alias("koid"), score.alias("score"), "p_brand", F.when(F.col("p_size") > 20, F.col("p_size")).alias("p_size"))
    return knowledge.predict(ranked, ["p_brand", "p_size"])


@query("""WITH e AS (SELECT event_id, event_type, list_distinct(list_filter(string_split_regex(lower(props), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w, value FROM events)
          SELECT 'event/' || event_id AS koid, round((3 * (CASE WHEN event_type IN ('error', 'mobile') THEN 0.5 ELSE 0 END) + 0.5 * len(list_intersect(w, ['error', 'mobile'])) / 2.0)::DOUBLE, 6) AS score
          FROM e WHERE event_type IN ('error', 'mobile') OR len(list_intersect(w, ['error', 'mobile'])) > 0 ORDER BY score DESC, koid LIMIT 20""")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.table(spark, sf_dir, "events")
    out = search.memory_search(e, F.col("event_type"), F.lit(""), F.col("props"), "error mobile", 20, tb.ref("event", "event_id"))
    return out.withColumn("score", F.round("score", 6))


# Mutations


def _users(spark: SparkSession, d: str) -> DataFrame:
    return opened(temporal.latest(tb.user_versions(spark, d)))


_HEADS_SQL = f"{USERS_SQL}, h AS (SELECT koid, max(version) AS version, max(commit_ts) AS c FROM users GROUP BY koid), heads AS (SELECT users.* FROM users JOIN h ON users.koid = h.koid AND commit_ts = c)"


@query(f"WITH {_HEADS_SQL} SELECT koid, version + 1 AS version, 1 << 16 AS commit_ts, state FROM heads WHERE event_type <> 'click'".replace("1 << 16", "(1800000000000 * 65536)"))
def remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New versions for users who expect the version they saw; those who clicked since come too late."""
    heads = _users(spark, sf_dir)
    late = F.col("properties")["event_type"]["s"] == "click"
    requests = heads.withColumn("expected", F.when(late, F.col("version") - 1).otherwise(F.col("version"))).withColumn("idempotency", F.col("koid"))
    good, _ = mutate.remember(requests, heads, 1_800_000_000_000)
    return good.select("koid", "version", "commit_ts", "state")


@query(f"WITH {_HEADS_SQL} SELECT koid, 'expected version ' || (version - 1) || ', found ' || version AS problem FROM heads WHERE event_type = 'click'")
def remember_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _users(spark, sf_dir)
    late = F.col("properties")["event_type"]["s"] == "click"
    requests = heads.withColumn("expected", F.when(late, F.col("version") - 1).otherwise(F.col("version"))).withColumn("idempotency", F.col("koid"))
    return mutate.remember(requests, heads, 1_800_000_000_000)[1]


@query(f"WITH {_HEADS_SQL} SELECT 'event_type' AS name, arg_max(event_type, struct_pack(c := commit_ts, k := koid)) AS value FROM heads WHERE koid IN ('user/1', 'user/2', 'user/3')")
def merge_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mutate.merge_properties(_users(spark, sf_dir), ["user/1", "user/2", "user/3"])
    return out.where("name = 'event_type'").select("name", F.col("value.s").alias("value"))


@query(f"WITH {_HEADS_SQL} SELECT koid, version + 1 AS version, 'deleted' AS state FROM heads WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users who ever signed up."""
    ids = tb.table(spark, sf_dir, "events").where("event_type = 'signup'").select(tb.ref("user", "user_id").alias("koid")).distinct()
    return mutate.tombstone(_users(spark, sf_dir), ids, 1_800_000_000_000).select("koid", "version", "state")


@query("""WITH RECURSIVE d AS (SELECT 4::BIGINT AS k UNION SELECT o_orderkey FROM orders JOIN d ON o_orderkey > 0 AND o_orderkey // 2 = k)
          SELECT 'order/' || o_orderkey AS koid, 2::BIGINT AS version, 'contradicted' AS epistemic_status,
                 CASE WHEN epoch_ms(o_orderdate) > 850000000000 THEN epoch_ms(o_orderdate) ELSE least(epoch_ms(o_orderdate) + 7776000000, 850000000000) END AS valid_to
          FROM orders WHERE o_orderkey IN (SELECT k FROM d) AND o_orderstatus <> 'P'""")
def invalidate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order and all that was derived from it: here each order was made from the one of half its number."""
    heads = opened(tb.orders(spark, sf_dir)).where("epistemic_status is not null")
    o = tb.table(spark, sf_dir, "orders").where("o_orderkey > 0")
    e = o.select(tb.ref("order", "o_orderkey").alias("src"), F.lit("DERIVED_FROM").alias("rel_type"), tb.ref("order", F.floor(F.col("o_orderkey") / 2)).alias("dst"))
    return mutate.invalidate(heads, e, "order/4", "auditor", "recall", 850_000_000_000).select("koid", "version", "epistemic_status", "valid_to")


@query("SELECT 'part/' || p_partkey AS koid, p_brand AS maker, 'kg' AS unit FROM part WHERE p_brand IS NOT NULL")
def migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mutate.migrate(opened(tb.parts(spark, sf_dir)), "Part", {"p_brand": "maker"}, {"unit": "kg"}, NOW)
    return out.select("koid", F.col("properties")["maker"]["s"].alias("maker"), F.col("properties")["unit"]["s"].alias("unit"))


@query("SELECT 'derived/1' AS koid, 2::BIGINT AS dependents")
def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new object from two documents; its inward references make it their dependent."""
    out = mutate.derive(opened(tb.docs(spark, sf_dir)), ["doc/1", "doc/2"], "derived/1", "Summary", {"text": "both"}, "summarise", "agent", NOW)
    refs = out.select("koid", F.explode("relationships").alias("r")).where("r.direction = 'in'")
    return refs.groupBy("koid").agg(F.count(F.lit(1)).alias("dependents"))


@query("SELECT 'doc/5' AS koid, 0.9::DOUBLE AS score, 2::BIGINT AS confirmations, 'verified' AS epistemic_status")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of one verifier counts once, however often it is brought."""
    heads = opened(tb.docs(spark, sf_dir))
    once = mutate.verify(heads, "doc/5", "eve", ["a.pdf", "b.pdf"], 0.9, NOW)
    again = mutate.verify(once, "doc/5", "eve", ["a.pdf"], 0.4, NOW + 1)
    return again.select("koid", "confidence.score", "confidence.confirmations", "epistemic_status")


@query(f"WITH {EDGES_SQL} SELECT DISTINCT src AS koid, rel_type, 1 AS depth FROM edges WHERE dst = 'nation/9'")
def dependency_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(tb.edges(spark, sf_dir), spark.createDataFrame([("nation/9",)], "koid string"), "in_nation", 1)


# Scans, snapshots, and the rest of the inventory


@query("SELECT 'customer/' || c_custkey AS koid, c_name FROM customer WHERE c_custkey = 77")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.customers(spark, sf_dir).where(F.col("ko.koid") == "customer/77").select("ko.koid", "c_name")


@query("SELECT 'customer/' || c_custkey AS koid, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tb.table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(tb.ref("customer", "o_custkey").alias("koid"))
    c = tb.customers(spark, sf_dir).select("ko.koid", "c_name")
    return c.join(ids, "koid", "left_semi")


@query(f"WITH {USERS_SQL} SELECT koid, arg_max(event_id, commit_ts) AS event_id FROM users WHERE commit_ts <= 1704844800000 * 65536 AND koid IN ('user/5', 'user/6') GROUP BY koid")
def snapshot_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two objects as they stood at an instant, deletions included."""
    v = tb.user_versions(spark, sf_dir).where(F.col("ko.koid").isin("user/5", "user/6") & (F.col("ko.commit_ts") <= 1704844800000 << 16))
    return temporal.latest(v).select("ko.koid", "event_id")


@query(f"WITH {EDGES_SQL} SELECT rel_type, count(*) AS n FROM edges WHERE src = 'customer/5' OR dst = 'customer/5' GROUP BY rel_type")
def edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.edges(spark, sf_dir)
    return e.where((F.col("src") == "customer/5") | (F.col("dst") == "customer/5")).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {USERS_SQL}, s AS (SELECT koid, max(commit_ts) AS c FROM users WHERE commit_ts <= 1705276800000 * 65536 GROUP BY koid)
           SELECT u.koid AS src, 'last_did' AS rel_type, event_type AS dst FROM users u JOIN s ON u.koid = s.koid AND commit_ts = c WHERE state <> 'deleted'""")
def snapshot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's reference to what they did last, as of an instant."""
    v = tb.user_versions(spark, sf_dir)
    refs = F.array(F.struct(F.lit("last_did").alias("rel_type"), F.col("event_type").alias("target"), F.lit("out").alias("direction")))
    return graph.snapshot_edges(v.withColumn("ko", F.col("ko").withField("relationships", refs)), 1705276800000)


@query("SELECT 'order/' || o_orderkey AS src, 'DEPENDS_ON' AS rel_type, 'order/' || (o_orderkey - 1) AS dst FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def add_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tb.table(spark, sf_dir, "orders")
    new = o.select(tb.ref("order", "o_orderkey").alias("src"), tb.ref("order", F.col("o_orderkey") - 1).alias("dst"))
    return graph.add_dependency(tb.edges(spark, sf_dir), new, tb.orders(spark, sf_dir))


@query(f"WITH {STATEMENTS_SQL} SELECT 'fact' AS kind, statement AS item FROM facts WHERE fact LIKE '%BUILDING' UNION ALL SELECT 'relation', 'x near y'")
def expand_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tb.statements(spark, sf_dir).withColumn("document", F.split_part("fact", F.lit("/"), F.lit(2)))
    none = spark.createDataFrame([], "document string, name string")
    rel = spark.createDataFrame([("BUILDING", "x", "near", "y"), ("other", "a", "near", "b")], "document string, subject string, predicate string, object string")
    return knowledge.expand_source("BUILDING", none, f, rel)


@query("""WITH s AS (SELECT n_name AS name, avg(c_acctbal)::DOUBLE AS score, n_regionkey AS r FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 3),
          p AS (SELECT x.score AS sa, y.name, row_number() OVER (PARTITION BY x.name ORDER BY y.score DESC, y.name) AS i FROM s x JOIN s y ON x.r = y.r AND x.name <> y.name WHERE x.score > 0),
          l AS (SELECT name, max(sa * 0.65) AS lift FROM p WHERE i <= 2 GROUP BY name) SELECT s.name, round(greatest(score, coalesce(lift, 0)), 6) AS score FROM s LEFT JOIN l ON s.name = l.name""")
def neighbour_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = tb.table(spark, sf_dir, "nation"), tb.table(spark, sf_dir, "customer")
    scored = n.join(c, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.avg("c_acctbal").alias("score"))
    links = n.alias("a").join(n.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).where("a.n_name <> b.n_name").select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))
    return knowledge.neighbours(scored, links, 2).withColumn("score", F.round("score", 6))


@query("SELECT 'customer/' || c_custkey AS koid, c_name AS name, c_acctbal AS balance, 'Party' AS tag FROM customer")
def conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ontology import conform as under

    o = Ontology({"Party": None}, physical={"Party": ("Customer", {"c_name": "name", "c_acctbal": "balance"})})
    return under(tb.customers(spark, sf_dir), o, "Party").select("ko.koid", "name", "balance", F.element_at("ko.tags", 1).alias("tag"))


@query("SELECT 'order/' || o_orderkey AS koid, 'superseded' AS epistemic_status FROM orders WHERE o_orderkey = 3 AND o_orderstatus <> 'P' UNION ALL SELECT 'order/' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'asserted' END FROM orders WHERE o_orderkey = 4")
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = opened(tb.orders(spark, sf_dir)).where("koid = 'order/4' or epistemic_status is not null")
    return mutate.supersede(heads, "order/3", "order/4", NOW).select("koid", "epistemic_status")


@query("SELECT 'part/9' AS koid, 2::BIGINT AS version, p_brand, 99::BIGINT AS p_size FROM part WHERE p_partkey = 9")
def evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mutate.evolve(opened(tb.parts(spark, sf_dir)), "part/9", {"p_size": 99}, NOW)
    return out.select("koid", "version", F.col("properties")["p_brand"]["s"].alias("p_brand"), F.col("properties")["p_size"]["i"].alias("p_size"))


@query("SELECT 'order/' || o_orderkey AS koid, CASE WHEN o_orderstatus = 'F' THEN 'contradicted' END AS epistemic_status FROM orders WHERE o_orderstatus = 'F'")
def epistemic_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = tb.table(spark, sf_dir, "orders").select(tb.ref("order", "o_orderkey").alias("koid"))
    heads = opened(tb.orders(spark, sf_dir)).where("epistemic_status = 'verified'")
    return mutate.transition(heads, every, "contradicted", NOW)[0].select("koid", "epistemic_status")


# Claims


@query("SELECT 'seen/' || event_id AS koid, 'observed' AS epistemic_status, 'system' AS origin, epoch_us(ts) // 1000 AS valid_from, event_type AS kind FROM events")
def observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.table(spark, sf_dir, "events")
    out, _ = claims.observe(e, "Sighting", tb.ref("seen", "event_id"), ["event_type"], tb.evidence(F.lit("journal")), NOW, tb.millis("ts"))
    return out.select("koid", "epistemic_status", "origin", "valid_from", F.col("properties")["event_type"]["s"].alias("kind"))


def _asserted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = tb.table(spark, sf_dir, "orders")
    authority = F.when(F.col("o_orderstatus") == "F", "official").when(F.col("o_orderstatus") == "O", "user").otherwise("hearsay")
    backed = F.when(F.col("o_orderpriority") != "5-LOW", tb.evidence(F.col("o_orderpriority")))
    return claims.assert_claims(o, "Order", tb.ref("order", "o_orderkey"), ["o_totalprice"], backed, authority, NOW)


@query("SELECT 'order/' || o_orderkey AS koid, CASE o_orderstatus WHEN 'F' THEN 'official' ELSE 'user' END AS authority, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'")
def assert_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asserted(spark, sf_dir)[0].select("koid", "authority", F.col("properties")["o_totalprice"]["f"].alias("price"))


@query("SELECT 'order/' || o_orderkey AS koid, CASE WHEN o_orderpriority = '5-LOW' THEN 'no evidence' ELSE 'not a valid claim' END AS problem FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'")
def assert_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asserted(spark, sf_dir)[1]


@query(f"SELECT 'run/' || p_partkey AS koid, {NOW} + 2592000000 AS valid_to, 0.5::DOUBLE AS score, p_brand AS reader FROM part WHERE p_size > 10")
def record_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.table(spark, sf_dir, "part")
    told = p.withColumn("goal", F.col("p_type")).withColumn("action", F.col("p_name")).withColumn("outcome", F.when(F.col("p_size") > 10, "kept").otherwise(" "))
    out, _ = claims.record_experiences(told, tb.ref("run", "p_partkey"), tb.evidence(F.col("p_name")), NOW, shared_with=F.array("p_brand"))
    return out.select("koid", "valid_to", "confidence.score", F.col("acl")[0]["principal"].alias("reader"))


@query("SELECT * FROM (VALUES ('part/9', 'superseded', NULL::BIGINT), ('part/9a', 'active', 1::BIGINT), ('part/9b', 'active', 2::BIGINT)) t(koid, state, properties)")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mutate.split(opened(tb.parts(spark, sf_dir)), "part/9", {"part/9a": ["p_brand"], "part/9b": ["p_size", "p_type"]}, NOW)
    return out.select("koid", "state", F.when(F.col("koid") != "part/9", F.size("properties").cast("long")).alias("properties"))


@query("SELECT 'conflict/1' AS koid, p_size::BIGINT AS claimed, 99::BIGINT AS countered FROM part WHERE p_partkey = 9")
def contradict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mutate.contradict(opened(tb.parts(spark, sf_dir)), "part/9", "conflict/1", "p_size", 99, "ann", NOW)
    return out.select("koid", F.col("properties")["claimed"]["i"].alias("claimed"), F.col("properties")["countered"]["i"].alias("countered"))


@query("SELECT lang, count(*) AS documents FROM documents WHERE source <> 'src1' GROUP BY lang")
def erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left by language once all documents of one source are erased."""
    every = opened(tb.docs(spark, sf_dir))
    ids = tb.table(spark, sf_dir, "documents").where("source = 'src1'").select(tb.ref("doc", "doc_id").alias("koid"))
    return mutate.erase(every, ids).groupBy(F.col("properties")["lang"]["s"].alias("lang")).agg(F.count(F.lit(1)).alias("documents"))


@query(f"SELECT 'part/' || p_partkey AS koid, 2::BIGINT AS version, {NOW} + 1000 AS valid_to FROM part WHERE p_partkey = 9")
def retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.retain(opened(tb.parts(spark, sf_dir)), "part/9", 1000, NOW).select("koid", "version", "valid_to")


def _statement(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    from ..plans.engine import Catalog, Engine

    return Engine(Catalog({"Part": tb.parts(spark, sf_dir)}), now=NOW).run(source)


@query("SELECT 'part/9' AS koid, 2::BIGINT AS version, 5::BIGINT AS p_size, p_brand FROM part WHERE p_partkey = 9")
def statement_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _statement(spark, sf_dir, 'UPDATE Part "part/9" p_size == 5')
    return out.select("koid", "version", F.col("properties")["p_size"]["i"].alias("p_size"), F.col("properties")["p_brand"]["s"].alias("p_brand"))


@query("SELECT 'part/9' AS koid, 2::BIGINT AS version, 'deleted' AS state")
def statement_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statement(spark, sf_dir, 'DELETE Part "part/9"').select("koid", "version", "state")


@query("SELECT 'Part' AS type_name, 1::BIGINT AS version, 'bolt' AS p_name, 7::BIGINT AS p_size")
def statement_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _statement(spark, sf_dir, 'CREATE Part p_name == "bolt", p_size == 7')
    return out.select("type_name", "version", F.col("properties")["p_name"]["s"].alias("p_name"), F.col("properties")["p_size"]["i"].alias("p_size"))


@query("SELECT 'new/1' AS koid, 1::BIGINT AS version, 'part/9' AS target UNION ALL SELECT 'part/9', 2, 'new/1'")
def batch_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new object and a stored one that refer to each other, written together."""
    from ..plans.batch import batch

    operations = [{"remember": {"type": "Note", "properties": {"text": "worn"}}}, {"relate": {"from": "$1.koid", "rel": "about", "to": "part/9"}}, {"relate": {"from": "part/9", "rel": "noted", "to": "$1.koid"}}]
    out, _ = batch(opened(tb.parts(spark, sf_dir)), operations, NOW, lambda: "new/1")
    return out.select("koid", "version", F.col("relationships")[0]["target"].alias("target"))
