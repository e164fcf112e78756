"""The document pipeline over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ontology, search
from ..pipeline import bridge, chunk, compile, context, extract, summary
from ..pipeline.blocks import explode_blocks
from ..schema import view
from . import query
from . import tables as tb
from .tables import tokens_sql


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_documents(tb.table(spark, sf_dir, "documents"))


@query()
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.embed_chunks(chunk.chunk_documents(tb.table(spark, sf_dir, "documents")))


@query()
def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_blocks(tb.table(spark, sf_dir, "documents"), "text", "doc_id")


@query()
def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.facts(tb.table(spark, sf_dir, "documents"), "text", "doc_id")


@query()
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.entities(extract.facts(tb.table(spark, sf_dir, "documents"), "text", "doc_id"))


@query()
def ontology_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.facts(tb.table(spark, sf_dir, "documents"), "text", "doc_id")
    return ontology.propose(extract.entities(found))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))::INTEGER AS {n}" for n, p in tx.SECRETS) + " FROM documents")
def secrets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.table(spark, sf_dir, "documents")
    return d.select("doc_id", *tx.secret_counts(F.col("text")))


def _redact_sql(x: str) -> str:
    for name, pattern in tx.SECRETS:
        x = f"regexp_replace({x}, '{pattern}', '[{name}]', 'g')"
    return x


@query(f"SELECT doc_id, sha256({_redact_sql('text')}) AS redacted FROM documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(tx.redact(F.col("text")).cast("binary"), 256).alias("redacted"))


@query(
    "SELECT doc_id, " + " OR ".join([f"starts_with(regexp_replace(lower(text), '^\\s+', ''), '{w}')" for w in tx.DUTIES + tx.IMPERATIVES] + [f"contains(lower(text), ' {w}')" for w in tx.DUTIES]) + " AS instruction, "
    + " OR ".join(f"contains(lower(text), '{p}')" for p in tx.INJECTIONS) + " AS injection FROM documents"
)
def injection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.findings(tb.table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "instruction", "injection")


@query("SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(
    r"""SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(p_name || ' of ' || p_brand || ' kind'), '\s+'), lambda x: x <> '')[1:3], '_') AS statement_key,
        trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS snake FROM part"""
)
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.statement_key(F.concat_ws(" ", "p_name", F.lit("of"), "p_brand", F.lit("kind"))).alias("statement_key"), tx.snake_case(F.col("p_brand")).alias("snake"))


@query("SELECT o_orderkey, epoch_ms(o_orderdate) AS at, NULL::BIGINT AS bad FROM orders")
def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tb.table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return o.select("o_orderkey", tx.iso_millis(text).alias("at"), tx.iso_millis(F.concat(text, F.lit("Z"))).alias("bad"))


def _changed(d: DataFrame) -> DataFrame:
    return d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'gone' WHEN doc_id % 13 = 0 THEN 'new' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 11 = 0 AND doc_id % 13 <> 0) OR (doc_id % 11 <> 0 AND (doc_id % 13 = 0 OR doc_id % 7 = 0))")
def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.table(spark, sf_dir, "documents")
    return compile.changes(d.where("doc_id % 13 <> 0"), _changed(d))


@query()
def compile_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of what is new or changed only."""
    d = tb.table(spark, sf_dir, "documents")
    return compile.compile_changed(d.where("doc_id % 13 <> 0"), _changed(d)).chunks


@query()
def conversation_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.bucketed(tb.table(spark, sf_dir, "conversations"))


_LOW = r"lower(s)"
_HITS = {b: " OR ".join(f"contains({_LOW}, '{c.replace(chr(39), chr(39) * 2)}')" for c in cues) for b, cues in summary.CUES.items()}
_HITS["open_issues"] += " OR ends_with(s, '?')"


@query(
    rf"""WITH p AS (SELECT conv_id, unnest(string_split(regexp_replace(text, '([.!?])', '\1' || chr(1), 'g'), chr(1))) AS raw FROM conversations),
         s AS (SELECT conv_id, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS s FROM p WHERE trim(regexp_replace(raw, '\s+', ' ', 'g')) <> ''),
         b AS ({" UNION ALL ".join(f"SELECT conv_id, '{b}' AS bucket FROM s WHERE {hit}" for b, hit in _HITS.items())}
               UNION ALL SELECT conv_id, 'facts' FROM s WHERE NOT ({" OR ".join(_HITS.values())}))
         SELECT conv_id, bucket, count(*) AS sentences FROM b GROUP BY conv_id, bucket"""
)
def conversation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.bucket_counts(tb.table(spark, sf_dir, "conversations"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entities, documents' sentences with a name as facts."""
    p = tb.table(spark, d, "part").select(tb.ref("part", "p_partkey").alias("unit"), F.lit("entity").alias("kind"), F.col("p_name").alias("name"), F.col("p_name").alias("text"), F.array("p_brand", "p_type").alias("mentions"))
    f = extract.facts(tb.table(spark, d, "documents"), "text", "doc_id").select(F.col("fact").alias("unit"), F.lit("fact").alias("kind"), F.lit("").alias("name"), F.col("statement").alias("text"), F.col("entities").alias("mentions"))
    return p.unionByName(f)


@query()
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = spark.createDataFrame([(1, "which large steel rods does the market sell"), (2, "small blue rings and thationed parts")], "task int, question string")
    return context.compile_context(_units(spark, sf_dir), tasks, 300)


_WORDS = ("large", "steel", "market")


@query(
    f"""WITH u AS (SELECT 'part/' || p_partkey AS unit, {tokens_sql('p_name')} AS w, {tokens_sql("p_brand || ' ' || p_type")} AS m FROM part),
        s AS (SELECT unit, {' + '.join(f"CASE WHEN list_contains(w, '{x}') THEN 1.0::DOUBLE WHEN len(list_filter(w, lambda x: starts_with(x, '{x[:4]}'))) > 0 THEN 0.3 ELSE 0 END" for x in _WORDS)} AS n,
                     {' + '.join(f"CASE WHEN list_contains(m, '{x}') THEN 1.0::DOUBLE WHEN len(list_filter(m, lambda x: starts_with(x, '{x[:4]}'))) > 0 THEN 0.3 ELSE 0 END" for x in _WORDS)} AS m FROM u)
        SELECT unit, round((n + 0.5 * m) * 1.2, 6) AS score FROM s"""
)
def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _units(spark, sf_dir).where("kind = 'entity'")
    return context.score_units(own, _WORDS).select("unit", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND value > 0)
          SELECT 'event/' || event_id AS koid, round((value / 1000) * 0.5, 6) AS score FROM e ORDER BY score DESC, koid LIMIT 15""")
def experience_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 0")
    confidence = F.struct((F.col("value") / 1000).alias("score"), F.lit(1).alias("confirmations"), F.lit(0).alias("last_verified"), F.array().cast("array<string>").alias("keys"))
    v = view(e, "Experience", tb.ref("event", "event_id"), confidence=confidence)
    out = search.experiences(v, F.array("event_type"), F.col("event_type"), "purchase now", 15)
    return out.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "koid").limit(15)


_BODY_SQL = r"regexp_replace(regexp_replace(coalesce(text, ''), '(?s)(^|\n)#.*$', '\1'), '^\s+|\s+$', '', 'g')"


@query(
    f"""SELECT doc_id AS id, 'Decision' AS section, sha256('take ' || source) AS body FROM documents UNION ALL SELECT doc_id, 'Status', sha256('accepted in ' || lang) FROM documents
        UNION ALL SELECT doc_id, 'Context', sha256({_BODY_SQL}) FROM documents WHERE {_BODY_SQL} <> ''"""
)
def explain_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision records: a document's text is the context, its other columns the status and the decision."""
    from ..operators.knowledge import explain_decision as sections

    d = tb.table(spark, sf_dir, "documents")
    record = F.concat(F.lit("# Record\n\n## Status\naccepted in "), "lang", F.lit("\n\n## Decision\n\ntake "), "source", F.lit("\n\n## Context\n"), F.coalesce("text", F.lit("")))
    return sections(d, record, F.col("doc_id")).withColumn("body", F.sha2(F.col("body").cast("binary"), 256))


@query(
    """SELECT * FROM (VALUES ('customer', 'references', 'nation'), ('lineitem', 'references', 'supplier') , ('supplier', 'references', 'nation'), ('nation', 'references', 'region'), ('lineitem', 'references', 'part')) t(subject, predicate, object)
       WHERE object IN ('nation', 'region', 'part')"""
)
def schema_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between the test tables, from their columns' names."""
    names = ("region", "nation", "customer", "supplier", "part", "lineitem")
    rows = [(t, f.name, f.dataType.simpleString()) for t in names for f in tb.table(spark, sf_dir, t).schema]
    return bridge.schema_relations(spark.createDataFrame(rows, "table_name string, column_name string, data_type string"))


@query("SELECT * FROM (VALUES ('o_orderdate', 'date'), ('o_totalprice', 'number'), ('o_orderpriority', 'text')) t(property, kind)")
def value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tb.table(spark, sf_dir, "orders")
    columns = ("o_orderdate", "o_totalprice", "o_orderpriority")
    pairs = F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in columns])
    return bridge.value_kinds(o.select(F.explode(pairs).alias("p")).select("p.*"))


@query()
def ann_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors to one of them, by random projections."""
    e = tb.table(spark, sf_dir, "embeddings")
    return search.ann_approximate(e, F.col("embedding"), [((i * 37) % 11 - 5) / 5 for i in range(64)], 10, F.col("vec_id"))
