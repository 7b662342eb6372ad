"""Aggregates over the graph, and the guarded SQL gateway."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.code import entry_point, live_routines
from tessera.operators.metadata import current

CAP = 5000


def objects_by(objects: DataFrame, column: str) -> DataFrame:
    """Current objects by kind or configuration."""
    return current(objects).groupBy("tenant_id", column).agg(F.count(F.lit(1)).alias("n"))


def descendants(contains: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): the nodes below each root, itself included, at any depth. ``contains``: (parent, child)
    edges; cycles end, as a pair of root and node is followed once, and rounds go on until no pair is new."""
    from tessera.util import settle

    e = contains.select(F.col("parent").alias("node"), F.col("child").alias("next")).where("node is not null and next is not null").distinct()
    front = settle(roots.select(F.col("fqn").alias("root"), F.col("fqn").alias("node")).distinct())
    seen = front
    while True:
        step = front.join(e, "node").select("root", F.col("next").alias("node")).distinct()
        front = settle(step.join(seen, ["root", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def kinds_within(contains: DataFrame, objects: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects by kind within subsystems and all their descendants, each counted once."""
    seen = descendants(contains, roots)
    o = current(objects).select(F.col("fqn").alias("node"), "kind").distinct()
    return seen.join(o, "node").groupBy("root", "kind").agg(F.countDistinct("node").alias("n"))


def calls_by_kind(edges: DataFrame) -> DataFrame:
    """Edges by kind and confidence."""
    return edges.groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


def entry_points_by(routines: DataFrame) -> DataFrame:
    """Routines that the platform calls, by category."""
    return live_routines(routines).groupBy(entry_point(F.col("name")).alias("category")).agg(F.count(F.lit(1)).alias("n")).where("category is not null")


def overrides_by_mode(routines: DataFrame) -> DataFrame:
    """Overrides by mode."""
    return live_routines(routines).where("override_mode is not null").groupBy("override_mode").agg(F.count(F.lit(1)).alias("n"))


def top_fan(edges: DataFrame, side: str, k: int = 10) -> DataFrame:
    """Routines with most distinct neighbours: side "callee" for fan-in, "caller" for fan-out."""
    other = {"callee": "caller", "caller": "callee"}[side]
    return edges.groupBy("tenant_id", F.col(side).alias("fqn")).agg(F.countDistinct(other).alias("n")).orderBy(F.desc("n"), "fqn", "tenant_id").limit(k)


def code_bytes(files: DataFrame) -> DataFrame:
    """Files, bytes and lines by tenant, source and kind; null content counts as none."""
    lines = F.size(F.split("content", "\n")).cast("bigint")
    return files.groupBy("tenant_id", "source", "kind").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")).alias("n_bytes"), F.sum(F.when(F.col("content").isNull(), F.lit(0).cast("bigint")).otherwise(lines)).alias("n_lines"))


def counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct keys per table."""
    out = None
    for name, (df, key) in sorted(tables.items()):
        one = df.agg(F.countDistinct(key).alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def top_with_total(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values with the number of rows and values in all."""
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_values"))
    return g.orderBy(F.desc("n"), column).limit(k).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("n_values") > k)  # one row


class Rejected(ValueError):
    """A statement that the gateway does not run."""


#: What a statement's plan may consist of.
PLAN_NODES = "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join LateralJoin SubqueryAlias UnresolvedRelation UnresolvedWith Union Distinct Deduplicate Intersect Except UnresolvedSubqueryColumnAliases OneRowRelation UnresolvedHaving WithWindowDefinition UnresolvedInlineTable LocalRelation UnresolvedOrderBy".split()
#: Functions that read nothing but their arguments.
FUNCTIONS = frozenset(
    "count sum avg mean min max min_by max_by any_value first last median mode stddev variance collect_set collect_list count_if bool_and bool_or every some percentile approx_count_distinct"
    " abs round bround floor ceil ceiling sign sqrt power pow exp ln log log2 log10 mod pmod greatest least"
    " length char_length octet_length lower upper trim ltrim rtrim btrim lpad rpad substr substring substring_index left right replace translate reverse repeat concat concat_ws split split_part instr locate position startswith endswith contains like ilike rlike regexp regexp_like regexp_extract regexp_extract_all regexp_replace regexp_count initcap ascii chr md5 sha1 sha2 xxhash64 hash"
    " coalesce nullif ifnull nvl nvl2 if isnull isnotnull decode between case when cast try_cast string int bigint double boolean date timestamp"
    " size cardinality array array_contains array_distinct array_sort sort_array array_join array_max array_min element_at slice explode posexplode struct named_struct map map_keys map_values"
    " year quarter month day dayofmonth dayofweek hour minute second date_trunc trunc date_format to_date to_timestamp datediff date_add date_sub add_months months_between last_day extract date_part"
    " row_number rank dense_rank percent_rank ntile lag lead first_value last_value nth_value cume_dist".split()
)


def _items(seq):
    return [seq.apply(i) for i in range(seq.length())]


def check(spark: SparkSession, statement: str, tables: set[str]) -> None:
    """Rejects what is not one query over ``tables`` with harmless functions. The statement's own parsed plan is
    walked, subqueries included: every node must be of a known kind, every relation one of the tables or a name of
    the statement's own WITH, every function in ``FUNCTIONS``. So text in literals does not matter, and files,
    Java methods, commands and table functions cannot be reached."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        raise Rejected(f"not one statement of SQL: {str(e).splitlines()[0]}") from None
    known = {t.lower() for t in tables}

    def of(node, names: set[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in PLAN_NODES:
            raise Rejected(f"only queries are run: {kind}")
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in names:
                raise Rejected("no such table: " + ".".join(parts))
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                alias = pair._2()
                of(alias, names)
                names = names | {alias.alias().lower()}
        for e in _items(node.expressions()):
            inside(e, names)
        for child in _items(node.children()):
            of(child, names)

    def inside(e, names: set[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = _items(e.nameParts())
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise Rejected("no such function: " + ".".join(parts))
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery"):
            of(e.query().plan() if kind == "InSubquery" else e.plan(), names)
        for child in _items(e.children()):
            inside(child, names)

    of(plan, known)


def gateway(spark: SparkSession, statement: str, tables: dict[str, DataFrame], cap: int = 200) -> DataFrame:
    """A checked statement over the tables: at most ``cap`` rows (1 to 5000), and in ``truncated`` whether
    there are more. The tables are views of a session of their own, in which nothing else has a name."""
    s = statement.strip().rstrip(";")
    check(spark, s, set(tables))
    cap = max(1, min(cap, CAP))
    own = spark.newSession()
    rows_of = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    for name, df in tables.items():
        rows_of(own._jsparkSession, df._jdf.logicalPlan()).createOrReplaceTempView(name)
    rows = own.sql(s)
    mark = "truncated" if "truncated" not in [c.lower() for c in rows.columns] else "truncated_"
    more = rows.limit(cap + 1)
    return more.crossJoin(F.broadcast(rows.limit(cap + 1).agg((F.count(F.lit(1)) > cap).alias(mark)))).limit(cap)  # one row
