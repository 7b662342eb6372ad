"""The call graph and code intelligence over ``routines``, ``symbols``, ``calls`` and ``files``.

Two modes of names are kept apart: ``graph`` operators compare names exactly and keep CALLS as a set,
``index`` operators ignore case and count every occurrence. Repeated deliveries count once; routines that
are deleted are left out of the graph. A null qualifier is an unqualified call; calls of unknown callers
are no edges. Joins are by equality throughout; a hot method name is joined to declarations that are
unique by then, so it is read once and left to the engine's skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.util import settle

# Names of routines that the platform calls, and the category of each.
ENTRY_POINTS = {
    "обработкапроведения": "проведение",
    "обработкаудаленияпроведения": "проведение",
    "posting": "проведение",
    "передзаписью": "запись",
    "призаписи": "запись",
    "beforewrite": "запись",
    "onwrite": "запись",
    "передудалением": "удаление",
    "beforedelete": "удаление",
    "обработказаполнения": "заполнение",
    "filling": "заполнение",
    "прикопировании": "заполнение",
    "обработкапроверкизаполнения": "проверка_заполнения",
    "проверказаполнения": "проверка_заполнения",
    "fillcheckprocessing": "проверка_заполнения",
    "приустановкеновогономера": "нумерация",
    "приустановкеновогокода": "нумерация",
    "обработкаполученияданныхвыбора": "выбор",
    "приполученииданныхвыбора": "выбор",
}
FORM_EVENT = "событие_формы"
#: Words by which code names its own object.
SELF_WORDS = ("этотобъект", "thisobject", "этаформа", "thisform")


def live_routines(routines: DataFrame) -> DataFrame:
    return routines.where("deleted_at is null").dropDuplicates(["routine_id"])


def once(calls: DataFrame) -> DataFrame:
    """Each call once, by its first delivery; of equal times the least row, whole."""
    names = ["loaded_at", "caller_id", "qualifier", "qualifier_low", "method", "method_low", "line"]
    return calls.groupBy("call_id").agg(F.min(F.struct(*names)).alias("r")).select("call_id", *[f"r.{c}" for c in names])


def module_of(fqn: Column) -> Column:
    return F.substring_index(fqn, "::", 1)


def entry_point(name: Column, form_event: Column | None = None) -> Column:
    """The category of a routine that the platform calls, null for others; a form's event goes first."""
    table = F.create_map(*[F.lit(x) for kv in ENTRY_POINTS.items() for x in kv])
    got = table[F.lower(name)]
    return got if form_event is None else F.when(form_event.isNotNull(), F.lit(FORM_EVENT)).otherwise(got)


def resolve_calls(calls: DataFrame, routines: DataFrame, objects: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(call_id, caller, callee, kind, confidence, line). An unqualified call goes to the same
    module; a qualified one to the common module of that name, else to a manager module of an object of that
    name; others stay unresolved (callee null). Of routines with one name the last by id is meant.

    The three kinds of target are one keyed table, joined once: a call asks for its best rank by key, so
    there is one shuffle of the calls and not three."""
    fold = F.lower if ignore_case else (lambda c: c if isinstance(c, Column) else F.col(c))
    r = live_routines(routines).select("routine_id", "tenant_id", "fqn", "object_fqn", "module_type", "name")
    owner = F.substring_index("object_fqn", ".", -1)
    local = r.select("tenant_id", F.concat(F.lit("L:"), module_of(F.col("fqn"))).alias("scope"), fold(F.col("name")).alias("m"), "routine_id", "fqn")
    common = r.where(F.col("object_fqn").startswith("CommonModule.")).select("tenant_id", F.concat(F.lit("C:"), fold(owner)).alias("scope"), fold(F.col("name")).alias("m"), "routine_id", "fqn")
    manager = r.where("module_type = 'ManagerModule'").select("tenant_id", F.concat(F.lit("M:"), fold(owner)).alias("scope"), fold(F.col("name")).alias("m"), "routine_id", "fqn")
    targets = local.unionByName(common).unionByName(manager).groupBy("tenant_id", "scope", "m").agg(F.max(F.struct("routine_id", "fqn"))["fqn"].alias("callee"))
    callers = r.select(F.col("routine_id").alias("caller_id"), "tenant_id", F.col("fqn").alias("caller"))
    c = once(calls).join(callers, "caller_id")
    q = fold(F.col("qualifier"))
    scopes = F.when(F.col("qualifier").isNull(), F.array(F.struct(F.lit(0).alias("rank"), F.concat(F.lit("L:"), module_of(F.col("caller"))).alias("scope")))).otherwise(
        F.array(F.struct(F.lit(1).alias("rank"), F.concat(F.lit("C:"), q).alias("scope")), F.struct(F.lit(2).alias("rank"), F.concat(F.lit("M:"), q).alias("scope")))
    )
    asked = c.select("call_id", "tenant_id", "caller", "line", fold(F.col("method")).alias("m"), F.explode(scopes).alias("s")).select("call_id", "tenant_id", "caller", "line", "m", "s.rank", "s.scope")
    best = asked.join(targets, ["tenant_id", "scope", "m"], "left").groupBy("call_id").agg(F.min("tenant_id").alias("tenant_id"), F.min("caller").alias("caller"), F.min("line").alias("line"), F.min(F.when(F.col("callee").isNotNull(), F.struct("rank", "callee"))).alias("b"))
    kind = F.when(F.col("b.rank") == 0, "local").when(F.col("b.rank") == 1, "common_module").when(F.col("b.rank") == 2, "manager").otherwise("unresolved")
    return best.select("call_id", "tenant_id", "caller", F.col("b.callee").alias("callee"), kind.alias("kind"), F.when(kind == "manager", "medium").when(kind != "unresolved", "high").alias("confidence"), "line")


def call_edges(resolved: DataFrame) -> DataFrame:
    """CALLS as a set: one edge for each pair, with kind and confidence of the last call."""
    last = F.max(F.struct("call_id", "kind", "confidence"))
    return resolved.where("callee is not null").groupBy("tenant_id", "caller", "callee").agg(last.alias("l")).select("tenant_id", "caller", "callee", "l.kind", "l.confidence")


def parse_stats(resolved: DataFrame) -> DataFrame:
    """Calls by how they were resolved."""
    return resolved.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def override_edges(routines: DataFrame) -> DataFrame:
    """Edges from an overriding routine to the one it overrides, only for extension modules with a mode."""
    r = live_routines(routines).where(F.col("override_mode").isNotNull() & F.col("override_target").isNotNull() & module_of(F.col("fqn")).contains("@ext:"))
    return r.select("tenant_id", F.col("fqn").alias("src"), F.concat(F.regexp_replace(module_of(F.col("fqn")), r"@ext:.*$", ""), F.lit("::"), "override_target").alias("dst"), F.col("override_mode").alias("mode"))


def find_overrides(routines: DataFrame, object_fqn: str) -> DataFrame:
    """Override edges that touch the object on either side. Two equality filters, no OR join."""
    e = override_edges(routines)
    side = lambda c: F.regexp_extract(F.regexp_replace(module_of(F.col(c)), r"@ext:.*$", ""), r"^([^.]+\.[^.]+)", 1) == object_fqn
    return e.where(side("src") | side("dst"))


def resolve_routines(routines: DataFrame, q: str) -> DataFrame:
    """``a::b`` is an fqn, ``A.B`` a routine B of an object A, anything else a name."""
    r = live_routines(routines)
    if "::" in q:
        return r.where(F.col("fqn") == q)
    if "." in q:
        owner, name = q.rsplit(".", 1)
        return r.where((F.col("name") == name) & F.col("object_fqn").endswith("." + owner))
    return r.where(F.col("name") == q)


def find_callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct callers of the routines in ``targets`` (tenant_id, fqn)."""
    return edges.join(targets.select("tenant_id", F.col("fqn").alias("callee")), ["tenant_id", "callee"], "left_semi").select("tenant_id", "caller").distinct()


def find_callees(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """C11: distinct callees with how they were resolved."""
    return edges.join(sources.select("tenant_id", F.col("fqn").alias("caller")), ["tenant_id", "caller"], "left_semi").select("tenant_id", "callee", F.col("kind").alias("via")).distinct()


def call_graph(edges: DataFrame, routines: DataFrame) -> DataFrame:
    """Callers and callees one hop away."""
    return find_callers(edges, routines).select("tenant_id", F.col("caller").alias("fqn"), F.lit("caller").alias("side")).unionByName(find_callees(edges, routines).select("tenant_id", F.col("callee").alias("fqn"), F.lit("callee").alias("side")).distinct())


def call_path(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 8) -> DataFrame:
    """(tenant_id, src, dst, path, hops): a shortest directed path from each source to each target within
    ``max_hops``; of several the least in order of its nodes. Breadth first: each round joins the frontier to
    the edges and drops nodes that their source has seen, so cycles end; rounds are settled, and only the
    frontier's count comes to the driver."""
    e = edges.select("tenant_id", F.col("caller").alias("node"), F.col("callee").alias("next")).distinct()
    front = settle(sources.select("tenant_id", F.col("fqn").alias("src"), F.col("fqn").alias("node"), F.array("fqn").alias("path")).distinct())
    seen, found = front, None
    goal = targets.select("tenant_id", F.col("fqn").alias("dst")).distinct()
    for hop in range(max_hops + 1):
        hits = front.join(goal, (front["tenant_id"] == goal["tenant_id"]) & (front["node"] == goal["dst"])).select(front["tenant_id"], "src", "dst", "path", F.lit(hop).alias("hops"))
        found = hits if found is None else found.unionByName(hits)
        if hop == max_hops:
            break
        step = front.join(e, ["tenant_id", "node"]).groupBy("tenant_id", "src", F.col("next").alias("node")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        front = settle(step.join(seen.select("tenant_id", "src", "node"), ["tenant_id", "src", "node"], "left_anti").select("tenant_id", "src", "node", "path"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return found


def callers_upward(edges_by_name: DataFrame, name: str, depth: int = 4) -> DataFrame:
    """(level, name): callers of a name upward by name, each name once at its first level.
    ``edges_by_name``: (caller_name, callee_name), lower case."""
    e = edges_by_name.distinct()
    spark = e.sparkSession
    front = spark.createDataFrame([(0, name.lower())], "level int, name string")
    seen = front
    for level in range(1, depth + 1):
        step = e.join(front.select(F.col("name").alias("callee_name")), "callee_name", "left_semi").select(F.lit(level).alias("level"), F.col("caller_name").alias("name")).distinct()
        front = settle(step.join(seen.select("name"), "name", "left_anti").select("level", "name"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def find_handlers(routines: DataFrame, object_fqn: str | None = None) -> DataFrame:
    """Routines that the platform calls, by category."""
    r = live_routines(routines).withColumn("entry", entry_point(F.col("name"))).where("entry is not null")
    r = r if object_fqn is None else r.where(F.col("object_fqn") == object_fqn)
    return r.select("tenant_id", "fqn", "entry")


def routine_source(chunks: DataFrame) -> DataFrame:
    """(tenant_id, routine, body, parts): bodies rebuilt from code chunks without their heads, parts in order of
    their numbers."""
    parts = F.split("fqn", "#code", 2)
    bare = F.when(F.contains("text", F.lit("\n")), F.expr("substring(text, locate('\n', text) + 1)")).otherwise(F.col("text"))
    c = chunks.where("chunk_kind = 'code'").dropDuplicates(["chunk_id"]).select("tenant_id", parts[0].alias("routine"), F.coalesce(F.expr("try_cast(regexp_extract(fqn, '#code/([0-9]+)', 1) as int)"), F.lit(0)).alias("part"), bare.alias("text"), "chunk_id")
    return c.groupBy("tenant_id", "routine").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "chunk_id", "text"))), lambda x: x["text"]), "\n").alias("body"), F.count(F.lit(1)).alias("parts"))


def source_with_overrides(sources: DataFrame, overrides: DataFrame) -> DataFrame:
    """(tenant_id, routine, body, overrides): a routine's body and, by mode, each routine of an extension that
    overrides it, with its extension and body where there is one. One join for all routines."""
    over = overrides.join(sources.select("tenant_id", F.col("routine").alias("src"), F.col("body").alias("source")), ["tenant_id", "src"], "left")
    extension = F.regexp_extract("src", r"@ext:(.*?)::", 1)
    o = over.groupBy("tenant_id", F.col("dst").alias("routine")).agg(F.array_sort(F.collect_list(F.struct("mode", F.col("src").alias("fqn"), extension.alias("extension"), "source"))).alias("overrides"))
    return sources.select("tenant_id", "routine", "body").join(o, ["tenant_id", "routine"], "full")


def callers_of(calls: DataFrame, symbols: DataFrame, methods: DataFrame, kind: str | None = None, cap: int | None = None) -> DataFrame:
    """Occurrences of calls of each method_low in ``methods``, with the calling symbol. Unqualified
    calls of a routine by itself are left out. With ``cap`` the first by object, name and line are shown, as
    a page; totals come from ``call_totals`` over all rows."""
    s = symbols.dropDuplicates(["id"]).select(F.col("id").alias("caller_id"), "tenant_id", "object", "name", "name_low", "path", "source")
    c = once(calls).join(methods.select("method_low").distinct(), "method_low", "left_semi")
    rows = c.join(s, "caller_id").where(~(F.col("qualifier").isNull() & (F.col("name_low") == F.col("method_low"))))
    if kind is not None:
        rows = rows.where(F.col("object").startswith(kind + "."))
    rows = rows.select("method_low", "tenant_id", "object", "name", "path", "line", "call_id")
    if cap is None:
        return rows
    w = Window.partitionBy("method_low").orderBy("object", "name", "line", "call_id")
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap)


def call_totals(calls: DataFrame, symbols: DataFrame, methods: DataFrame) -> DataFrame:
    """C20: rows, distinct callers and objects for each method, over all occurrences. Objects are
    pre-aggregated, so that a hot method's rows meet as counts only."""
    rows = callers_of(calls, symbols, methods)
    by_object = rows.groupBy("method_low", "tenant_id", "object").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name", "path").alias("n_callers"))
    return by_object.groupBy("method_low").agg(F.sum("n").alias("n_rows"), F.sum("n_callers").alias("n_callers"), F.count(F.lit(1)).alias("n_objects"))


def call_counts(calls: DataFrame) -> DataFrame:
    """Occurrences by name."""
    return calls.select("call_id", "method_low").distinct().groupBy("method_low").agg(F.count(F.lit(1)).alias("n"))


def has_name(symbols: DataFrame, calls: DataFrame, names: DataFrame) -> DataFrame:
    """Whether each ``name_low`` is declared or called anywhere."""
    known = symbols.select("name_low").union(calls.select("method_low")).distinct().withColumn("known", F.lit(True))
    return names.select("name_low").distinct().join(known, "name_low", "left").select("name_low", F.coalesce("known", F.lit(False)).alias("known"))


def declarations(symbols: DataFrame, contains: str, limit: int = 50) -> DataFrame:
    """Declarations by a part of the name, exported and common ones first, with the total."""
    low = contains.lower()
    kind = F.substring_index("object", ".", 1)
    order = F.when(kind == "CommonModule", 0).when(kind == "Configuration", 1).when(kind == "Document", 2).when(kind == "Catalog", 3).otherwise(4)
    s = symbols.dropDuplicates(["id"]).where(F.col("name_low").contains(low)).select("id", "tenant_id", "object", "name", "export", order.alias("relevance"))
    total = s.agg(F.count(F.lit(1)).alias("total"))
    return s.orderBy(F.desc("export"), "relevance", "object", "name", "id").limit(limit).crossJoin(F.broadcast(total))


def find_declarations(symbols: DataFrame, name: str, substring: bool = False, exported_only: bool = False, object_hint: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """A window of the declarations of a name, all of them or an object's, with their number, what it counts, and
    whether the window leaves some out."""
    low = name.lower()
    s = symbols.dropDuplicates(["id"]).where(F.col("name_low").contains(low) if substring else F.col("name_low") == low)
    if exported_only:
        s = s.where("export = 1")
    if object_hint:
        s = s.where((F.col("object_low") == object_hint.lower()) | F.col("object_low").endswith("." + object_hint.lower()))
    total = s.agg(F.count(F.lit(1)).alias("total"))
    rows = s.select("id", "tenant_id", "object", "name", "path", "start_line", "export").orderBy("object", "path", "start_line", "id")
    rows = (rows.offset(offset) if offset else rows).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("scope", F.lit("object" if object_hint else "all")).withColumn("truncated", F.col("total") > offset + limit)  # one row


def callers_batch(calls: DataFrame, symbols: DataFrame, asked: DataFrame, cap: int = 40) -> DataFrame:
    """Callers of many names in one pass, each with a hint of its own (method_low, hint): a call counts if there is no
    hint, or it is qualified by it, or unqualified in an object whose name holds it. At most ``cap`` a name are shown, in order of
    object, name and line, with the number of all."""
    hints = asked.select("method_low", F.lower("hint").alias("hint")).distinct()
    s = symbols.dropDuplicates(["id"]).select(F.col("id").alias("caller_id"), "tenant_id", "object", "object_low", "name", "name_low", "path")
    c = once(calls).join(hints, "method_low").join(s, "caller_id").where(~(F.col("qualifier").isNull() & (F.col("name_low") == F.col("method_low"))))
    fits = F.col("hint").isNull() | (F.col("qualifier_low") == F.col("hint")) | (F.col("qualifier").isNull() & F.contains("object_low", F.col("hint")))
    c = c.where(fits)
    total = c.groupBy("method_low", "hint").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("method_low", "hint").orderBy("object", "name", "line", "call_id")
    top = c.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap).select("method_low", "hint", "tenant_id", "object", "name", "path", "line", "nth")
    t = total.select(F.col("method_low").alias("m"), F.col("hint").alias("h"), "total")
    return top.join(t, (F.col("m") == F.col("method_low")) & F.col("h").eqNullSafe(F.col("hint"))).drop("m", "h")


def caller_levels(calls: DataFrame, symbols: DataFrame, name: str, depth: int = 2, per_level: int = 40) -> DataFrame:
    """(level, calls, caller, path, place, total, truncated): callers of a name upward, each (path, routine) at its
    first level; at most ``per_level`` of a level are shown, the total counts all of its call rows."""
    s = symbols.dropDuplicates(["id"]).select(F.col("id").alias("caller_id"), "name", "name_low", "path")
    rows = once(calls).join(s, "caller_id").where(~(F.col("qualifier").isNull() & (F.col("name_low") == F.col("method_low")))).select(F.col("method_low").alias("calls"), F.col("name_low").alias("caller"), "path")
    front, seen_names, seen, out = calls.sparkSession.createDataFrame([(name.lower(),)], "calls string"), None, None, None
    for level in range(1, depth + 1):
        hits = settle(rows.join(front, "calls"))
        total = hits.agg(F.count(F.lit(1)).alias("total"))
        new = hits.groupBy("caller", "path").agg(F.min("calls").alias("calls"))
        new = settle(new if seen is None else new.join(seen, ["caller", "path"], "left_anti"))
        if new.isEmpty():
            break
        w = Window.orderBy("calls", "caller", "path")
        shown = new.orderBy("calls", "caller", "path").limit(per_level).withColumn("place", F.row_number().over(w))  # few rows
        one = shown.crossJoin(F.broadcast(total)).select(F.lit(level).alias("level"), "calls", "caller", "path", "place", "total", (F.col("total") > per_level).alias("truncated"))
        out = one if out is None else out.unionByName(one)
        seen = new.select("caller", "path") if seen is None else seen.unionByName(new.select("caller", "path"))
        seen_names = front if seen_names is None else seen_names.unionByName(front)
        front = settle(new.select(F.col("caller").alias("calls")).distinct().join(seen_names, "calls", "left_anti"))
    return out if out is not None else calls.sparkSession.createDataFrame([], "level int, calls string, caller string, path string, place int, total bigint, truncated boolean")


def override_hooks(symbols: DataFrame, mode: str | None = None) -> DataFrame:
    """All hooks of extensions, by mode."""
    s = symbols.where("override_mode is not null").dropDuplicates(["id"])
    return (s if mode is None else s.where(F.col("override_mode") == mode)).select("id", "tenant_id", "object", "name", "override_mode", "override_target")


def enclosing(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """The routine that a line of a file lies in, the first by start and id. A range join: equality on
    (tenant_id, path) and on blocks of ``BIN`` lines that a routine covers, then the exact condition."""
    lines = 256
    s = symbols.where("start_line is not null").dropDuplicates(["id"]).select("tenant_id", "path", "id", "start_line", F.coalesce("end_line", "start_line").alias("end_line"))
    s = s.where("end_line >= start_line").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_line") / lines), F.floor(F.col("end_line") / lines))))
    p = places.select("tenant_id", "path", "line").distinct().withColumn("bin", F.floor(F.col("line") / lines))
    hit = p.join(s, ["tenant_id", "path", "bin"]).where("line between start_line and end_line")
    return hit.groupBy("tenant_id", "path", "line").agg(F.min(F.struct("start_line", "id"))["id"].alias("id"))


def list_routines(symbols: DataFrame, path: str) -> DataFrame:
    """The routines of one file in order."""
    return symbols.where(F.col("path") == path).dropDuplicates(["id"]).select("tenant_id", "id", "name", "start_line", "end_line", "export").orderBy("tenant_id", "start_line", "id")


def read_routine(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """The lines of the routines of one name."""
    s = symbols.where(F.col("name_low") == name.lower()).dropDuplicates(["id"]).where("start_line is not null and end_line >= start_line")
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return s.join(files.select("tenant_id", "path", "content"), ["tenant_id", "path"]).select("id", "tenant_id", body.alias("body"))


def read_file(files: DataFrame, path: str) -> DataFrame:
    """Of several copies of a path the longest that is not empty."""
    f = files.where((F.col("path") == path) & (F.length("content") > 0))
    return f.groupBy("path").agg(F.max_by("content", F.struct(F.length("content"), -F.col("file_id"))).alias("content"))


def locate(symbols: DataFrame, name: str) -> DataFrame:
    """The one place a name is declared at in each tenant, or that it is ambiguous."""
    s = symbols.where(F.col("name_low") == name.lower()).select("tenant_id", "object", "module").distinct()
    return s.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_places"), F.when(F.count(F.lit(1)) == 1, F.min(F.concat_ws(".", "object", "module"))).alias("place"))


def search_code(files: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """Lines that match, with the total. Files are filtered before they are split."""
    f = files.where((F.col("kind") == "bsl") & F.col("content").rlike(pattern)).select("tenant_id", "path", F.posexplode(F.split("content", "\n")).alias("n", "text")).where(F.col("text").rlike(pattern))
    rows = f.select("tenant_id", "path", (F.col("n") + 1).alias("line"), F.regexp_replace("text", r"\r$", "").alias("text"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("tenant_id", "path", "line").limit(limit).crossJoin(F.broadcast(total))


def count_total(texts: DataFrame, column: str, pattern: str) -> DataFrame:
    """Matches in all texts, not lines."""
    return texts.where(F.col(column).rlike(pattern)).agg(F.coalesce(F.sum(F.size(F.regexp_extract_all(column, F.lit(pattern), 0)).cast("bigint")), F.lit(0)).alias("n_matches"))


def touched_routines(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Routines that changed lines (tenant_id, path, lo, hi) overlap; lo null means the whole file."""
    s = symbols.dropDuplicates(["id"]).select("tenant_id", "path", "id", "start_line", "end_line")
    h = hunks.select("tenant_id", "path", "lo", "hi").distinct()
    return s.join(h, ["tenant_id", "path"]).where("lo is null or (start_line <= hi and coalesce(end_line, start_line) >= lo)").select("tenant_id", "id").distinct()


def changed_objects(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """Changed files by object."""
    from tessera.operators.metadata import path_object

    h = hunks.select("tenant_id", "path").distinct().join(files.select("tenant_id", "path", "source"), ["tenant_id", "path"])
    return h.select("tenant_id", "source", path_object(F.col("path")).alias("object"), "path").where("object is not null").groupBy("tenant_id", "source", "object").agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


def review_set(hunks: DataFrame, symbols: DataFrame, calls: DataFrame, objects: DataFrame, limit: int = 100) -> DataFrame:
    """Touched routines by risk: exported first, then entry points, hooks and callers. A caller's
    call counts unless its qualifier names another common module."""
    t = touched_routines(hunks, symbols).join(symbols.dropDuplicates(["id"]), ["tenant_id", "id"]).select("tenant_id", "id", "object", "name", "name_low", F.coalesce("export", F.lit(0)).alias("export"))
    own = F.lower(F.substring_index("object", ".", -1))
    commons = objects.where("kind = 'CommonModule'").select("tenant_id", F.lower("name").alias("qualifier_low")).distinct().withColumn("common", F.lit(True))
    tenant = symbols.dropDuplicates(["id"]).select(F.col("id").alias("caller_id"), "tenant_id")
    c = calls.dropDuplicates(["call_id"]).join(tenant, "caller_id").join(commons, ["tenant_id", "qualifier_low"], "left").select("tenant_id", F.col("method_low").alias("name_low"), "qualifier_low", "common")
    c = c.groupBy("tenant_id", "name_low", "qualifier_low", "common").agg(F.count(F.lit(1)).alias("n"))  # a hot name meets the routines as counts
    foreign = F.col("common") & (F.col("qualifier_low") != own) & ~F.col("qualifier_low").isin(*SELF_WORDS)
    n = t.join(c, ["tenant_id", "name_low"]).where(~F.coalesce(foreign, F.lit(False))).groupBy("tenant_id", "id").agg(F.sum("n").alias("callers"))
    hooks = symbols.where("override_mode is not null").dropDuplicates(["id"]).groupBy("tenant_id", F.col("override_target_low").alias("name_low")).agg(F.count(F.lit(1)).alias("hooks"))
    out = t.join(n, ["tenant_id", "id"], "left").join(hooks, ["tenant_id", "name_low"], "left").select("tenant_id", "id", "object", "name", "export", entry_point(F.col("name")).isNotNull().alias("is_entry"), F.coalesce("hooks", F.lit(0)).alias("hooks"), F.coalesce("callers", F.lit(0)).alias("callers"))
    return out.orderBy(F.desc("export"), F.desc("is_entry"), F.desc("hooks"), F.desc("callers"), "id").limit(limit)
