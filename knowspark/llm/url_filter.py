"""URL filtering by rules and, where no rule fits, by a path-template tree for each host.

The tree: a host's paths are cut into segments, all of them; segments that look like numbers, dates or hashes are
wildcards at once. Level by level, a node's literal children become one wildcard when they are variable: when there are
at least ``MIN_CHILDREN`` of them, and a new path would more likely bring an unseen one than a known one (Good and
Turing's estimate, the share of paths whose child is theirs alone). The levels end where no two paths share a node. So
each path falls under a template. From the leaves up, sibling branches whose labelled share of bad urls does not differ
significantly from their pooled share are merged. A branch's purity is its labelled share of bad urls, smoothed towards
its parent's purity, and so on up to the host's, which is smoothed towards ``PRIOR``: a branch without labels has what
it inherits. Templates of a purity of ``REJECT`` or more are rejected. Labels come from the caller, or from the urls that
the rules decide.

Everything is DataFrame aggregation and joins on (host, prefix) keys: urls are counted before they are shuffled, nodes are
joined to their paths by salted keys, so that no host or template is gathered in one task; that many pages have one url
is left to the engine's skew join.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed unless its
like are labelled bad; ids may be null or repeated, each row gets its own result; an empty table gives an empty result;
paths have any length and depth; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

MIN_CHILDREN, UNSEEN = 8, 0.5
PRIOR, STRENGTH, REJECT, CRITICAL = 0.2, 4.0, 0.8, 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production rules: action and rule; a rule is a host, then a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, action); null where none does."""
    fits = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, prefix = rule.partition("/")
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(slash + prefix)
        fits.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,action:string>")


def segment_class(segment: Column) -> Column:
    """A variable-looking segment as a wildcard that keeps its ending; any other as it is."""
    for pattern, wildcard in (
        (r"^[0-9]+(?:[-_.][0-9]+)*(\.[a-z]{1,5})?$", "{n}$1"),
        (r"^(?=.*[0-9])[0-9a-fA-F-]{8,}(\.[a-z]{1,5})?$", "{h}$1"),
    ):
        segment = F.regexp_replace(segment, pattern, wildcard)
    return segment


def templates(paths: DataFrame) -> tuple[DataFrame, int]:
    """``paths`` (host, path, ...; one row for each host and path) with the array ``template`` and its ``depth``, the number
    of nodes that it shares with other paths; and the number of levels."""
    parts = F.transform(F.filter(F.split(F.col("path"), "/"), lambda s: s != ""), segment_class)
    out = cut(paths.withColumn("parts", parts).withColumn("template", F.array().cast("array<string>")).withColumn("depth", F.lit(0)))
    level = 0
    while True:
        child = F.get("parts", F.lit(level))
        children = out.where(child.isNotNull()).groupBy("host", "template", child.alias("child")).agg(F.count(F.lit(1)).alias("n"))
        literal = ~F.col("child").startswith("{")
        nodes = children.groupBy("host", "template").agg(
            F.sum("n").alias("n"), F.sum(F.when(literal, F.col("n"))).alias("known"), F.count_if(literal).alias("children"), F.count_if(literal & (F.col("n") == 1)).alias("single")
        )
        nodes = cut(nodes.where("n > 1"))
        if nodes.isEmpty():  # each path goes on alone
            break
        variable = (F.col("children") >= MIN_CHILDREN) & (F.col("single") >= UNSEEN * F.col("known"))
        out = salted_join(out, nodes.select("host", "template", variable.alias("variable")), ["host", "template"], "path")
        step = F.when(F.col("variable") & ~child.startswith("{"), F.lit("*")).otherwise(child)
        grown = F.when(child.isNotNull(), F.concat("template", F.array(step))).otherwise(F.col("template"))
        out = out.withColumn("depth", F.when(child.isNotNull() & F.col("variable").isNotNull(), F.col("depth") + 1).otherwise(F.col("depth")))
        out = cut(out.withColumn("template", grown).drop("variable"))  # each level uses the one before twice
        level += 1
    rest = F.slice("parts", F.lit(level + 1), F.greatest(F.size("parts") - level, F.lit(0)))
    return out.withColumn("template", F.concat("template", rest)).drop("parts"), level


def merged(stats: DataFrame, levels: int) -> DataFrame:
    """``stats`` (host, template, depth, bad, good; a row for each template) with the merged ``branch``.

    A branch ends where no other path shares it. From the deepest level up, children of one parent whose share of bad urls is within ``CRITICAL`` standard
    errors of the children's pooled share become one branch ``~`` of that parent.
    """
    out = cut(stats.withColumn("branch", F.slice("template", F.lit(1), F.col("depth") + 1)))
    for level in range(levels + 1, 0, -1):
        parent = F.slice("branch", 1, level - 1)
        kids = out.where(F.size("branch") == level).groupBy("host", "branch").agg(F.sum("bad").alias("b"), F.sum("good").alias("g")).where("b + g > 0")
        kids = cut(kids.withColumn("parent", parent))
        pool = kids.groupBy("host", "parent").agg((F.sum("b") / F.sum(F.col("b") + F.col("g"))).alias("p"))
        kids = salted_join(kids, pool, ["host", "parent"], "branch")
        error = F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("b") + F.col("g")))
        near = F.abs(F.col("b") / (F.col("b") + F.col("g")) - F.col("p")) <= CRITICAL * error + 1e-12
        kids = cut(kids.where(near).select("host", "branch", F.lit(True).alias("near")))
        if not kids.isEmpty():
            out = salted_join(out, kids, ["host", "branch"], "template")
            out = cut(out.withColumn("branch", F.when(F.col("near"), F.concat(parent, F.array(F.lit("~")))).otherwise(F.col("branch"))).drop("near"))
    return out


def purities(branches: DataFrame) -> DataFrame:
    """(host, branch, purity) of rows (host, branch, bad, good): the labelled share of bad urls, smoothed from the host down."""
    own = cut(branches.groupBy("host", "branch").agg(F.sum("bad").alias("b"), F.sum("good").alias("g")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("branch")), lambda d: F.slice("branch", 1, d))
    rows = own.select("host", "branch", "b", "g", F.explode(prefixes).alias("prefix"))
    nodes = rows.groupBy("host", "prefix").agg(F.sum("b").alias("b"), F.sum("g").alias("g"))
    rows = salted_join(rows.drop("b", "g"), nodes, ["host", "prefix"], "branch")
    chain = F.array_sort(F.collect_list(F.struct(F.size("prefix").alias("d"), "b", "g")))  # as many as a branch is deep
    smooth = F.aggregate("chain", F.lit(PRIOR), lambda p, x: (x["b"] + p * STRENGTH) / (x["b"] + x["g"] + STRENGTH))
    return rows.groupBy("host", "branch").agg(chain.alias("chain")).select("host", "branch", smooth.alias("purity"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, then the template and its purity.

    ``labels`` (url, bad 0/1) teaches the templates; without it the rules' own verdicts do.
    """
    own = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if labels is None:
        told = ruled.select("host", "path", F.when(F.col("r.action") == "block", 1).when(F.col("r.action") == "allow", 0).alias("bad"))
    else:
        told = labels.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("int").alias("bad"))
        told = own.select("host", "path", F.lit(None).cast("int").alias("bad")).unionAll(told)
    counts = told.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bad") == 1).alias("bad"), F.count_if(F.col("bad") == 0).alias("good"))
    tree, levels = templates(counts)
    tree = cut(tree)
    branches = merged(tree.groupBy("host", "template").agg(F.max("depth").alias("depth"), F.sum("bad").alias("bad"), F.sum("good").alias("good")), levels)
    known = salted_join(branches.select("host", "template", "branch"), purities(branches), ["host", "branch"], "template")
    paths = salted_join(tree.select("host", "path", "template"), known.select("host", "template", "purity"), ["host", "template"], "path")
    out = ruled.join(paths, ["host", "path"], "left")
    verdict = F.coalesce(F.col("r.action"), F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), "purity")
