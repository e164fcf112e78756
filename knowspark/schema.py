"""Schemas of versions, edges and journal, the tagged property value, and what a row of a typed view looks like.

Two forms of one object:

* open world: a row of :data:`VERSIONS`, properties in a map of tagged values, for objects of any type;
* typed: a *view*, one column for each property beside the struct ``ko`` of everything the system keeps. Views are what
  queries run on; Catalyst prunes the fields of ``ko`` and pushes predicates on properties to the scan.

A property that an object lacks is a missing map key, or a column that the view does not have; a stored null is a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.StructType([T.StructField(n, k) for n, k in (("t", T.StringType()), ("i", T.LongType()), ("f", T.DoubleType()), ("s", T.StringType()), ("b", T.BooleanType()), ("j", T.StringType()))])
PROPERTIES = T.MapType(T.StringType(), VALUE)

_EVIDENCE = "array<struct<source_artifact:string,location:string,revision:string,method:string,confidence:double>>"
_SYSTEM = (
    ("koid", "string"), ("type_name", "string"), ("version", "bigint"), ("commit_ts", "bigint"), ("state", "string"), ("tenant", "string"),
    ("tags", "array<string>"), ("owner", "string"), ("acl", "array<struct<principal:string,action:string,effect:string>>"), ("classification", "string"),
    ("origin", "string"), ("valid_from", "bigint"), ("valid_to", "bigint"), ("epistemic_status", "string"), ("authority", "string"), ("evidence", _EVIDENCE),
    ("confidence", "struct<score:double,confirmations:bigint,last_verified:bigint,keys:array<string>>"), ("summary", "string"), ("embedding", "array<float>"),
    ("embedding_model", "string"), ("relationships", "array<struct<rel_type:string,target:string,direction:string>>"),
    ("derivation", "struct<operation:string,actor:string,model:string,timestamp:bigint,sources:array<string>,reason:string>"),
    ("invalidation", "struct<at:bigint,actor:string,reason:string>"),
)
SYSTEM = dict(_SYSTEM)
VERSIONS = ", ".join(f"{n} {k}" for n, k in _SYSTEM) + ", properties map<string,struct<t:string,i:bigint,f:double,s:string,b:boolean,j:string>>"
EDGES = "src string, rel_type string, dst string"
JOURNAL = "seq bigint, koid string, version bigint, kind string, origin string, actor string, ts bigint, payload_hash string, prev_hash string, own_hash string, signature string, note string"

# The states, statuses, ranks and relationship types of the data model.
STATES = ("draft", "observed", "extracted", "proposed", "validated", "active", "verified", "disputed", "superseded", "archived", "expired", "deleted")
STATUSES = ("observed", "asserted", "inferred", "verified", "contradicted", "superseded", "unknown")
AUTHORITIES = ("regulatory", "legal", "official", "contractual", "verified_expert", "system_of_record", "expert", "organization", "user", "machine", "unknown")


def koid(key: Column, kind: str = "") -> Column:
    """A fixed-width id whose string order is the key's order: 32 hex digits."""
    return F.lower(F.lpad(F.hex(key.cast("bigint")), 32, "0"))


def view(df: DataFrame, type_name: str, key: Column, drop: tuple[str, ...] = (), **system: Column) -> DataFrame:
    """A typed view of a table: struct ``ko``, with defaults for what is not given, then the table's columns."""
    given = {"koid": key, "type_name": F.lit(type_name), "version": F.lit(1), "state": F.lit("active"), "commit_ts": F.lit(0)} | system
    ko = F.struct(*[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in _SYSTEM])
    return df.select(ko.alias("ko"), *[c for c in df.columns if c not in drop])


def tagged(value: object) -> Column:
    """A Python value as a tagged property value."""
    kinds = {bool: ("bool", "b"), int: ("int", "i"), float: ("float", "f"), str: ("text", "s")}
    name, slot = kinds.get(type(value), ("null", "")) if value is not None else ("null", "")
    if isinstance(value, list | dict):
        import json

        name, slot, value = ("list" if isinstance(value, list) else "map"), "j", json.dumps(value, sort_keys=True)
    return F.struct(F.lit(name).alias("t"), *[F.lit(value if f.name == slot else None).cast(f.dataType).alias(f.name) for f in VALUE.fields[1:]])


def tag_column(df: DataFrame, name: str) -> Column:
    """A typed column as a tagged property value; a null becomes a stored null."""
    kind = df.schema[name].dataType
    c = F.col(name)
    tag, slot = ("bool", "b") if isinstance(kind, T.BooleanType) else ("int", "i") if isinstance(kind, T.IntegralType) else ("float", "f") if isinstance(kind, T.NumericType) else ("text", "s")
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        tag, slot, c = "list" if isinstance(kind, T.ArrayType) else "map", "j", F.to_json(c)
    return F.struct(F.when(F.col(name).isNull(), "null").otherwise(tag).alias("t"), *[(c if f.name == slot else F.lit(None)).cast(f.dataType).alias(f.name) for f in VALUE.fields[1:]])


def untag(prop: Column, kind: T.DataType) -> Column:
    """A tagged value as a plain column of ``kind``; null where the value is of another kind. Numbers promote."""
    if isinstance(kind, T.BooleanType):
        return prop["b"]
    if isinstance(kind, T.NumericType):
        return F.coalesce(prop["f"], prop["i"].cast("double")).cast(kind) if not isinstance(kind, T.IntegralType) else prop["i"].cast(kind)
    return prop["s"] if isinstance(kind, T.StringType) else F.from_json(prop["j"], kind)


def typed(versions: DataFrame, type_name: str, properties: dict[str, T.DataType | str]) -> DataFrame:
    """The view of one type of an open-world table of versions."""
    own = versions.where(F.col("type_name") == type_name)
    kinds = {n: T._parse_datatype_string(k) if isinstance(k, str) else k for n, k in properties.items()}
    return own.select(F.struct(*SYSTEM).alias("ko"), *[untag(F.col("properties")[n], k).alias(n) for n, k in kinds.items()])


def opened(v: DataFrame) -> DataFrame:
    """A view as open-world rows of :data:`VERSIONS`."""
    props = [c for c in v.columns if c != "ko"]
    pairs = [x for c in props for x in (F.lit(c), tag_column(v, c))]
    return v.select("ko.*", (F.create_map(*pairs) if pairs else F.create_map()).cast(PROPERTIES).alias("properties"))
