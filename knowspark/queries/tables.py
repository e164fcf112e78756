"""The test tables as knowledge objects. What they lack (ids, versions, validity, edges, owners) is derived by rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import temporal
from ..schema import view

DAY = 86_400_000


class Lazy(Mapping):
    """Views by type, each made when first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]) -> None:
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __contains__(self, name: object) -> bool:
        return name in self.makers

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts) -> F.Column:
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def ref(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def evidence(source: F.Column) -> F.Column:
    return F.array(F.struct(source.alias("source_artifact"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("revision"), F.lit("import").alias("method"), F.lit(0.8).alias("confidence")))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; the source is their evidence."""
    return view(table(spark, sf_dir, "documents"), "Doc", ref("doc", "doc_id"), evidence=evidence(F.col("source")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, valid for 90 days; F is verified, O asserted, P without status but extracted."""
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "asserted")
    state = F.when(F.col("o_orderstatus") == "P", "extracted").otherwise("active")
    start = millis("o_orderdate")
    return view(table(spark, sf_dir, "orders"), "Order", ref("order", "o_orderkey"), epistemic_status=status, state=state, valid_from=start, valid_to=start + 90 * DAY)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; segment owns, nation is the tenant, a low balance denies the role intern, AUTOMOBILE allows it."""
    entry = lambda who, effect: F.struct(F.lit(who).alias("principal"), F.lit("read").alias("action"), F.lit(effect).alias("effect"))
    acl = F.when(F.col("c_acctbal") < 0, F.array(entry("intern", "deny"), entry("staff", "allow"))).when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(entry("intern", "allow")))
    return view(table(spark, sf_dir, "customer"), "Customer", ref("customer", "c_custkey"), owner=F.col("c_mktsegment"), tenant=F.concat(F.lit("t"), F.col("c_nationkey").cast("string")), acl=acl)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(table(spark, sf_dir, "supplier"), "Supplier", ref("supplier", "s_suppkey"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(table(spark, sf_dir, "part"), "Part", ref("part", "p_partkey"))


def user_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of their user, in the order of time; a click deletes nothing, an error does."""
    e = table(spark, sf_dir, "events").withColumn("_ms", millis("ts"))
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    counter = F.row_number().over(Window.partitionBy("user_id", "_ms").orderBy("event_id")) - 1
    state = F.when(F.col("event_type") == "error", "deleted").otherwise("active")
    return view(e, "User", ref("user", "user_id"), ("_ms", "props"), version=version, commit_ts=temporal.commit_ts(F.col("_ms"), counter), state=state)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings; even labels are of the model m0, odd ones of m1."""
    return view(table(spark, sf_dir, "embeddings"), "Vector", ref("vector", "vec_id"), ("embedding",), embedding=F.col("embedding"), embedding_model=F.concat(F.lit("m"), (F.col("label") % 2).cast("string")))


def hybrids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the embedding of equal number: a synthetic pairing."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return view(both.select("doc_id", "text", "embedding"), "Hybrid", ref("doc", "doc_id"), ("embedding",), embedding=F.col("embedding"), embedding_model=F.lit("bench"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys: order -placed_by-> customer -in_nation-> nation -in_region-> region, supplier -in_nation-> nation."""
    out = None
    for name, kind, key, relation, to, target in (
        ("orders", "order", "o_orderkey", "placed_by", "customer", "o_custkey"),
        ("customer", "customer", "c_custkey", "in_nation", "nation", "c_nationkey"),
        ("supplier", "supplier", "s_suppkey", "in_nation", "nation", "s_nationkey"),
        ("nation", "nation", "n_nationkey", "in_region", "region", "n_regionkey"),
    ):
        one = table(spark, sf_dir, name).select(ref(kind, key).alias("src"), F.lit(relation).alias("rel_type"), ref(to, target).alias("dst"))
        out = one if out is None else out.unionAll(one)
    return out


#: The same edges in SQL, for the oracles.
EDGES_SQL = """edges AS (
  SELECT 'order/' || o_orderkey AS src, 'placed_by' AS rel_type, 'customer/' || o_custkey AS dst FROM orders
  UNION ALL SELECT 'customer/' || c_custkey, 'in_nation', 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'in_nation', 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'in_region', 'region/' || n_regionkey FROM nation)"""

USERS_SQL = """users AS (
  SELECT 'user/' || user_id AS koid, event_id, ts, user_id, event_type, value, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'active' END AS state,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
         (epoch_us(ts) // 1000) * 65536 + row_number() OVER (PARTITION BY user_id, (epoch_us(ts) // 1000) ORDER BY event_id) - 1 AS commit_ts
  FROM events)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the journal of their users."""
    e = table(spark, sf_dir, "events")
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(
        F.col("event_id").alias("seq"), ref("user", "user_id").alias("koid"), version.alias("version"), F.col("event_type").alias("kind"), F.lit("system").alias("origin"),
        F.lit("import").alias("actor"), millis("ts").alias("ts"), F.sha2(F.concat_ws("|", "event_type", F.col("event_id").cast("string")), 256).alias("payload_hash"),
        F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("note"),
    )


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names as mentions, and one known entity for each distinct first two words of them."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    mentions = p.select(F.col("p_partkey").alias("mention"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("type_hint"))
    short = F.concat_ws(" ", F.slice(F.split("p_name", " "), 1, 2))
    known = p.groupBy(short.alias("name")).agg(F.min("p_partkey").alias("k")).select(ref("part", "k").alias("koid"), "name", F.lit("Part").alias("type_hint"))
    return mentions, known


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts on nations from their customers' standing: one for each segment, with the mean balance as confidence."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = c.groupBy("n_name", "c_mktsegment").agg(F.avg("c_acctbal").alias("bal"))
    low = F.lower(F.col("c_mktsegment"))
    text = F.concat(F.lit("market "), low, F.lit(" of "), F.lower("n_name"), F.when(F.col("bal") > 4500, " must open").otherwise(" must not open"))
    return rows.select(F.concat_ws("/", "n_name", "c_mktsegment").alias("fact"), text.alias("statement"), F.array("n_name").alias("entities"), F.round(F.col("bal") / 10000, 4).alias("confidence"))


STATEMENTS_SQL = """facts AS (
  SELECT n_name || '/' || c_mktsegment AS fact, n_name AS entity, round(avg(c_acctbal) / 10000, 4) AS confidence,
         'market ' || lower(c_mktsegment) || ' of ' || lower(n_name) || CASE WHEN avg(c_acctbal) > 4500 THEN ' must open' ELSE ' must not open' END AS statement
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment)"""


def tokens_sql(text: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def space_words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda x: x <> '')"


def space_jaccard_sql(a: str, b: str, empty: float) -> str:
    x, y = f"list_distinct({space_words_sql(a)})", f"list_distinct({space_words_sql(b)})"
    both = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN {empty} ELSE {both}::DOUBLE / (len({x}) + len({y}) - {both}) END"
