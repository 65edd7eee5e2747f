"""Queries over the test tables: each operator on a table that is like what it is made for."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, quality, text
from .operators import chains, components, facts, graph, joins, metrics, postings, rank, rewrite, scratch, totals
from .plans import diagrams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path (host labels, last first, then the path) and html of pages."""
    url = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    host, rest = F.get(F.split(url, "/"), F.lit(0)), F.regexp_replace(url, r"^[^/]*/?", "")
    labels = F.array_join(F.reverse(F.split(host, r"\.")), "/")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(labels, F.lit("/"), rest).alias("path"), "html")


# Words that occur in the test tables, for operators whose default words don't.
PAGE_WORDS = [(50, ["blog"]), (30, ["shop", "news"]), (-5, ["fr"])]
PAGE_PURPOSES = [("blog", "Posts"), ("com", "Company"), ("org", "Organisation"), ("de", "German"), ("fr", "French")]
EVENT_FEATURES = [("Buying", ["purchase", "click"]), ("Looking", ["view"]), ("Failing", ["error"]), ("Nothing", ["zzz"])]
PART_LIBRARY = ["brand#11", "brand#12", "brand#23"]


# --- rankings ---


@query
def importance_rank(spark, sf_dir):
    pages = page_paths(spark, sf_dir).select("page_id", "path", F.regexp_count("html", F.lit("<script")).alias("n_classes"), F.regexp_count("html", F.lit("<a ")).alias("n_functions"))
    return rank.top_files(pages, 12, "page_id", words=PAGE_WORDS).select("page_id", "score")


@query
def top_classes(spark, sf_dir):
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n_parts"))
    return rank.largest(brands, "n_parts", "brand", 12)


@query
def topk_per_parent(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rank.first_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query
def group_top_other(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    groups = counts.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return rank.top_and_other(groups, "nation", "n", 8, "other").select("nation", "n", F.col("rank").cast("long").alias("rank"))


@query
def rate_schedule(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = rank.schedule(events, "at", 3_600_000_000, ["user_id"], ["at", "event_id"])
    return out.select("event_id", F.col("start").cast("long").alias("start"))


# --- directories and classification ---


@query
def dir_rollup(spark, sf_dir):
    out = facts.directory_rollup(page_paths(spark, sf_dir))
    return out.select("dir", F.col("depth").cast("long").alias("depth"), "n_files")


@query
def dir_purpose(spark, sf_dir):
    dirs = facts.directory_rollup(page_paths(spark, sf_dir))
    return dirs.select("dir", facts.directory_purpose(F.col("dir"), F.col("n_files"), PAGE_PURPOSES).alias("purpose"))


@query
def common_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("/data/store/orders/"), F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"))
    return paths.common_prefix(rows).select(F.array_join("prefix", "/").alias("prefix"))


@query
def folder_nodes(spark, sf_dir):
    dirs = facts.directory_rollup(page_paths(spark, sf_dir).withColumn("file_ord", F.col("page_id")))
    return rank.folder_nodes(dirs).select(F.col("node").cast("long").alias("node"), "dir", F.col("parent_node").cast("long").alias("parent_node"))


@query
def path_functions(spark, sf_dir):
    p = page_paths(spark, sf_dir)
    c = F.col("path")
    return p.select("page_id", paths.short_path(c, 2).alias("short"), paths.anchor(c).alias("anchor"), paths.safe_id(F.lit("F"), c).alias("node"), paths.name_of(c).alias("name"), paths.tail(c, 2).alias("tail"), paths.matches_glob(c, "*/blog/*/*").alias("in_blog"))


@query
def entry_points(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.get(F.split("p_name", " "), F.lit(0)), F.lit(".py")).alias("path"), F.col("p_partkey").alias("file_ord"), F.col("p_name").alias("summary"))
    first, second = "red.py", "blue.py"
    out = facts.entry_points(parts, [first], [second, first], ["green"], ["steel", "almond"])
    return out.select(F.col("file_ord").alias("p_partkey"), "type", "description")


@query
def feature_keywords(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"))
    return facts.keyword_features(events, "name", EVENT_FEATURES).select(F.col("ord").cast("long").alias("ord"), "feature")


@query
def import_classes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_size") < 5, F.lit("src.")).otherwise(F.lit("")), F.col("p_brand"), F.lit("."), F.col("p_partkey").cast("string")).alias("module"))
    kinds = parts.select(facts.import_kind(F.col("module"), stdlib=PART_LIBRARY).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def most_used(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return facts.most_common(parts, "p_brand")


@query
def architecture_vote(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    kinds = F.get(F.array(F.lit("models"), F.lit("services"), F.lit("domain"), F.lit("misc"), F.lit("lib")), F.col("r_regionkey") % 5)
    files = nations.select(F.concat(kinds, F.lit("/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit(".py")).alias("path"))
    return facts.architecture(files).select("primary_pattern", "description", F.array_join("patterns", ",").alias("patterns"))


@query
def language_mix(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d."), F.col("lang")).alias("path"))
    kinds = [(".en", "English"), (".de", "German"), (".fr", "French")]
    return metrics.language_counts(files, "path", kinds).select("language", "n_files")


@query
def diagram_text(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d."), F.col("lang")).alias("path"))
    return diagrams.language_pie(files, "path", [(".en", "English"), (".de", "German"), (".fr", "French")])


@query
def dependency_diagram(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return diagrams.dependencies(rows.select(F.col("r_name").alias("src"), F.col("n_name").alias("dst")))


# --- sums ---


@query
def file_statistics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_functions"), F.countDistinct("l_returnflag").alias("n_classes"))
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end"))
    return facts.file_statistics(lines, spans)


@query
def complexity_overview(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("cyclomatic"), F.max("l_returnflag").alias("flag"))
    return facts.complexity_overview(lines, "cyclomatic", ["flag"])


@query
def complexity_dist(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_calls"))
    return metrics.call_buckets(lines)


def _supply(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), (F.col("l_partkey") % 500).cast("string")).alias("dst"))


@query
def coupling(spark, sf_dir):
    edges = _supply(spark, sf_dir)
    ids = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 500).cast("string")).alias("id")).distinct()
    vertices = ids.unionByName(parts)
    return metrics.coupling(joins.existing_edges(edges, vertices), vertices)


@query
def cohesion(spark, sf_dir):
    symbols = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("module"), F.col("s_nationkey").alias("name"))
    references = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 25).alias("module"), F.col("c_nationkey").alias("ref"))
    return metrics.cohesion(symbols, references)


@query
def xref_index(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("references"))
    symbols = orders.select(F.lit("o").alias("file_path"), F.col("l_orderkey").cast("string").alias("name"), "references")
    return metrics.cross_references(symbols)


@query
def xref_search(spark, sf_dir):
    """Orders with parts of both a supplier and the next one, by the blocks of the index."""
    lines = table(spark, sf_dir, "lineitem")
    uses = lines.select(F.col("l_suppkey").alias("ref"), F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("used_by"))
    key = F.col("s_suppkey")
    wanted = table(spark, sf_dir, "supplier").select(key.alias("query"), F.explode(F.array(key, key + 1)).alias("ref"))
    named = postings.users(uses)
    return postings.search(scratch.Scratch(spark).result(postings.blocks(uses, named)), wanted, named)


@query
def xref_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("ref"), F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("used_by"))
    return postings.counts(postings.blocks(lines, postings.users(lines)))


def _event_symbols(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("calls"))
    kind = F.when(F.col("user_id") % 3 == 0, "method").otherwise("function")
    return events.select(F.concat(F.lit("make_u"), (F.col("user_id") % 7).cast("string")).alias("name"), kind.alias("type"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file_path"), F.lit(None).cast("string").alias("parent"), (F.col("user_id") % 5 == 0).alias("is_exported"), (F.col("user_id") % 4 == 0).alias("is_async"), F.array().cast("array<string>").alias("decorators"), "calls", F.col("calls").alias("references"), "user_id")


@query
def data_sources(spark, sf_dir):
    return metrics.data_sources(_event_symbols(spark, sf_dir), ["purch", "sign"])


@query
def error_calls(spark, sf_dir):
    return metrics.error_handling(_event_symbols(spark, sf_dir)).select("name", F.array_join("calls", ",").alias("calls"))


@query
def async_calls(spark, sf_dir):
    return metrics.async_patterns(_event_symbols(spark, sf_dir), ["view", "click"]).select("name", F.array_join("patterns", ",").alias("patterns"))


@query
def design_patterns(spark, sf_dir):
    return metrics.design_patterns(_event_symbols(spark, sf_dir))


@query
def api_boundary(spark, sf_dir):
    return metrics.api_boundary(_event_symbols(spark, sf_dir)).select("user_id", "name")


# --- graphs ---


def _hierarchy(spark, sf_dir) -> DataFrame:
    """Customers depend on nations, nations on regions."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    up = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    low = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    return low.unionByName(up)


@query
def transitive_deps(spark, sf_dir):
    return graph.closure(_hierarchy(spark, sf_dir))


@query
def topo_levels(spark, sf_dir):
    return graph.topological_levels(_hierarchy(spark, sf_dir)).select("node", F.col("level").cast("long").alias("level"))


@query
def entry_leaf_nodes(spark, sf_dir):
    edges = _hierarchy(spark, sf_dir)
    vertices = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    entry = graph.entry_nodes(edges, vertices).withColumn("kind", F.lit("entry"))
    return entry.unionByName(graph.leaf_nodes(edges, vertices).withColumn("kind", F.lit("leaf")))


def _transitions(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("event_type").alias("src"), after.alias("dst")).filter("dst is not null").distinct()


@query
def cycles(spark, sf_dir):
    return graph.cycles(_transitions(spark, sf_dir)).select(F.array_join("cycle", ">").alias("cycle"))


@query
def cycle_members(spark, sf_dir):
    return graph.cycle_members(_transitions(spark, sf_dir))


@query
def call_chains(spark, sf_dir):
    return graph.call_chains(_hierarchy(spark, sf_dir)).select(F.array_join("chain", ">").alias("chain"))


def _order_history(spark, sf_dir) -> DataFrame:
    """An order depends on the customer's last order before it, and on the first one."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    both = orders.select(F.col("o_orderkey").alias("src"), F.array(F.lag("o_orderkey").over(before), F.first("o_orderkey").over(before)).alias("dst"))
    return both.select("src", F.explode(F.array_compact("dst")).alias("dst")).filter("src <> dst").distinct()


def _priority_turns(spark, sf_dir) -> DataFrame:
    """From an order's priority to that of the customer's next order, once for each such order; nodes are a
    customer's priorities. The links of a customer lie together, as the window leaves them."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    node = F.concat_ws(":", F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1))
    after = F.lead(node).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.select(node.alias("src"), after.alias("dst")).filter("dst is not null")


@query
def strong_components(spark, sf_dir):
    return components.components(_priority_turns(spark, sf_dir))


@query
def history_levels(spark, sf_dir):
    return graph.topological_levels(_order_history(spark, sf_dir))


@query
def chain_counts(spark, sf_dir):
    return chains.chain_counts(_order_history(spark, sf_dir)).select("node", F.col("n").cast("long").alias("n"))


@query
def last_chain(spark, sf_dir):
    """The last chain of each customer's latest order, drawn by its rank."""
    links = _order_history(spark, sf_dir)
    tops = links.join(links.select(F.col("dst").alias("src")), "src", "left_anti").select("src").distinct()
    counts = chains.chain_counts(links).withColumnRenamed("node", "src")
    wanted = tops.join(counts, "src").select(F.col("src").alias("start"), (F.col("n") - 1).cast("long").alias("rank"))
    return chains.chains_at(links, wanted).select("start", "rank", F.array_join(F.transform("chain", lambda c: c.cast("string")), ">").alias("chain"))


@query
def reachable_pairs(spark, sf_dir):
    """Does an order go back to the customer's first one, and to that of the next customer?"""
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("dst"))
    asked = orders.select(F.col("o_orderkey").alias("src"), F.explode(F.array("o_custkey", F.col("o_custkey") + 1)).alias("o_custkey")).join(first, "o_custkey").select("src", "dst")
    return components.reaches(_order_history(spark, sf_dir), asked)


@query
def graph_export(spark, sf_dir):
    edges = _hierarchy(spark, sf_dir)
    vertices = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return graph.export(edges, vertices).select("id", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"))


def _flagged(spark, sf_dir):
    """src, dst: return flags (three hubs) and the parts that have them."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("flag:"), "l_returnflag").alias("src"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"))


@query
def adjacency_blocks(spark, sf_dir):
    out = graph.adjacency(_flagged(spark, sf_dir), 1000)
    return out.select("id", "direction", "block", "first", "last", F.col("n").cast("long").alias("n"), F.array_join("neighbours", ",").alias("neighbours"))


@query
def adjacency_json(spark, sf_dir):
    return graph.export_blocks(graph.adjacency(_flagged(spark, sf_dir), 500))


@query
def fact_totals(spark, sf_dir):
    """Totals over orders after all of them came, every third was revised and every fifth went; each batch is sent twice."""

    def rows(orders):
        status, customer, year = F.col("o_orderstatus"), F.col("o_custkey").cast("long"), F.year("o_orderdate").cast("string")
        entry = lambda fact, key, value: F.struct(F.lit(fact).alias("fact"), key.alias("key"), value.alias("value"))
        facts = F.array(entry("orders", status, F.lit(1).cast("long")), entry("customers", status, customer), entry("year", year, F.lit(1).cast("long")))
        return orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.inline(facts))

    orders = table(spark, sf_dir, "orders")
    gone = F.col("o_orderkey") % 5 == 0
    revised = orders.filter((F.col("o_orderkey") % 3 == 0) & ~gone).withColumn("o_orderstatus", F.lit("X")).withColumn("o_custkey", F.col("o_custkey") * 2)
    removed = orders.filter(gone).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"))
    kept = totals.FactTotals(spark, scratch.result_folder(spark, "totals"))
    for _ in range(2):
        kept.apply("all", rows(orders))
        kept.apply("revised", rows(revised), removed)
    kept.compact()
    return kept.totals()


# --- joins ---


@query
def cache_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = text.content_key(F.col("lang"), F.col("text"))
    return docs.select("doc_id", own.alias("content_key"), text.cache_key(F.col("lang"), own).alias("cache_key"))


@query
def cache_miss(spark, sf_dir):
    """Documents that a cache of English ones and of the benchmark does not hold."""
    from .sources.cache import DocCache

    cache = DocCache(spark, f"{graph.shared_folder(spark)}/cache-{uuid.uuid4().hex}")
    key = F.md5(F.col("text").cast("binary")).alias("key")
    known = table(spark, sf_dir, "documents").filter("lang = 'en'").select(key).unionByName(table(spark, sf_dir, "benchmark").select(key)).distinct()
    cache.put(known.select("key", F.lit("en").alias("language"), F.lit("{}").alias("details")))
    _, misses = cache.lookup(table(spark, sf_dir, "documents").select("doc_id", key))
    return misses.select("doc_id")


@query
def dedup_last_wins(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.length("text").alias("n"))
    return joins.last_wins(talk, ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn", F.col("n").cast("long").alias("n"))


def _flag_sides(spark, sf_dir):
    declared = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").cast("string").alias("default"), F.lit("").alias("description"), F.lit(False).alias("optional"))
    status = F.when(F.col("l_linestatus") == "F", "F").otherwise("O")
    documented = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), status.alias("name"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("type"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).alias("default"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("description"), (F.col("l_linenumber") % 3 == 0).alias("optional"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    return declared, documented


@query
def param_left_merge(spark, sf_dir):
    return joins.merge_declared(*_flag_sides(spark, sf_dir), ["key"])


@query
def param_left_merge_compat(spark, sf_dir):
    return joins.merge_declared(*_flag_sides(spark, sf_dir), ["key"], compat=True)


@query
def param_full_merge(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("desc"))
    base = talk.filter("turn % 2 = 0").select("conv_id", F.expr("turn div 2").alias("slot"), "desc")
    refined = talk.filter("turn % 2 = 1").select("conv_id", F.expr("turn div 2").alias("slot"), "desc")
    out = joins.merge_drafts(base, refined, ["conv_id", "slot"])
    return out.select("conv_id", "slot", "origin", F.length("desc").cast("long").alias("n"))


@query
def section_best_of(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    base = talk.filter("turn % 2 = 0").select("conv_id", F.expr("turn div 2").alias("slot"), F.col("text").alias("b"))
    refined = talk.filter("turn % 2 = 1").select("conv_id", F.expr("turn div 2").alias("slot"), F.col("text").alias("r"))
    both = base.join(refined, ["conv_id", "slot"])
    b, r = F.col("b"), F.col("r")
    best = joins.pick_by_score(b, r, quality.score_summary(b), quality.score_summary(r), text.strip(r) != "")
    return both.select("conv_id", "slot", F.md5(best.cast("binary")).alias("best"))


# --- text ---


@query
def summary_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    vague = ["the idiot", "stupid", "license", "###"]
    return docs.select("doc_id", F.round(quality.score_summary(F.col("text"), vague), 3).alias("score"))


@query
def weak_sections(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    t = F.col("text")
    details = F.from_json(F.to_json(F.struct(t.alias("summary"), F.struct(F.col("role").alias("type"), t.alias("desc")).alias("returns"), F.array(t).alias("notes"), F.array(t).alias("throws"), F.struct(t.alias("strategy")).alias("error_handling"))), quality.DETAILS)
    return talk.select("conv_id", "turn", F.array_join(quality.weak_sections(details), ",").alias("weak"))


@query
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_whitespace(F.col("text")).cast("binary")).alias("h"))


@query
def text_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 40).alias("t"))


@query
def text_indent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.indent_lines(F.col("text"), 4).cast("binary")).alias("h"))


@query
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("h"))


@query
def diagram_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_label(F.col("text"), 60).alias("label"))


@query
def file_names(spark, sf_dir):
    c = F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.sanitize_filename(c).alias("name"), text.safe_output_name(c).alias("folder"))


@query
def line_counts(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.count_lines(c).cast("long").alias("n"), F.length(text.ensure_newline_ending(c)).cast("long").alias("ended"))


@query
def code_markers(spark, sf_dir):
    c = F.concat(F.lit("```python\n"), F.col("p_name"), F.lit("\n```"))
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_code_markers(c).alias("body"))


@query
def lenient_json(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" ok"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("none "), F.col("event_type")))
    out = text.lenient_json(raw, "k bigint, summary string")
    return events.select("event_id", out["k"].alias("k"), out["summary"].alias("summary"))


@query
def docstrings(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    details = F.from_json(F.to_json(F.struct(F.col("p_name").alias("summary"), F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("type"), F.lit("size").alias("desc"), F.col("p_size").cast("string").alias("default"))).alias("params"), F.struct(F.lit("int").alias("type"), F.lit("a value").alias("desc")).alias("returns"))), quality.DETAILS)
    return part.select("p_partkey", quality.docstring(details).alias("doc"))


# --- rewriting and checks ---


@query
def section_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = rewrite.dedup_sections(docs, heading=F.length("line") < 60)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query
def url_fix(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    c = F.concat(F.lit("see http://host:"), (3000 + F.col("user_id") % 100).cast("string"), F.col("event_type"), F.lit(" and C:\\tmp\\"), F.col("event_type"), F.lit(" in srcmain"))
    return events.select("event_id", rewrite.fix_separators(rewrite.fix_port(rewrite.drop_windows_paths(c))).alias("t"))


@query
def drop_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(rewrite.drop_lines(F.col("text"), ["License", " token = ", "###"]).cast("binary")).alias("h"))


@query
def validate_output(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    end = F.when(F.col("p_size") % 3 == 0, F.lit(" curl `GET items` C:\\x")).when(F.col("p_size") % 3 == 1, F.lit(" http://h:80a your-repo")).otherwise(F.lit(" srcindex appmain"))
    return part.select("p_partkey", F.array_join(rewrite.issues(F.concat(F.col("p_name"), end)), "; ").alias("issues"))


@query
def normalize_defaults(spark, sf_dir):
    """Project documents of documents and their labels, with what is missing filled in."""
    from .operators import schema

    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    labelled = F.when(F.col("quality").isNotNull(), F.array(F.struct(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("name"))))
    doc = F.to_json(F.struct(F.col("lang").alias("project_name"), F.array(F.struct(labelled.alias("functions"))).alias("files")))
    d = schema.normalize(schema.parse(doc))
    f = F.get(d["files"], F.lit(0))
    fn = F.get(f["functions"], F.lit(0))
    return rows.select("doc_id", d["project_name"].alias("project"), f["path"].alias("path"), fn["name"].alias("function"), fn["returns"]["type"].alias("returns"), F.size(f["classes"]).cast("long").alias("n_classes"))


@query
def validate_rows(spark, sf_dir):
    from .operators import schema

    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    json = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit('{"project_name": "p", "files": [{"path": "'), k, F.lit('"}]}')))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit('{"files": [{"path": "'), k, F.lit('"}]}')))
        .when(F.col("p_size") % 4 == 2, F.lit('{"project_name": "p", "files": [{"functions": "x"}]}'))
        .otherwise(F.lit('{"project_name": "p"}'))
    )
    doc = schema.normalize(schema.parse(json))
    return part.select("p_partkey", F.array_join(schema.errors(json), "; ").alias("errors"), doc["project_name"].alias("project"), F.size(doc["files"]).cast("long").alias("n_files"))


# --- parsers: embedded sources, one row for each part ---


def dealt_parts(spark, sf_dir) -> DataFrame:
    """Parts dealt to all cores, as the table may be one partition; its rows are small, files are made after."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return part.repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")


def _sources(spark, sf_dir, language: str, make) -> DataFrame:
    from .operators.extraction import parse_files, symbols

    part = dealt_parts(spark, sf_dir)
    files = part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").cast("int").alias("file_ord"), F.lit(language).alias("language"), make(F.get(F.split("p_name", " "), F.lit(0))).alias("content"))
    rows = symbols(parse_files(files))
    return rows.select("path", "class_name", "name", "signature", F.col("returns.type").alias("returns"), F.size("parameters").cast("long").alias("n_parameters"))


@query
def python_symbols(spark, sf_dir):
    return _sources(spark, sf_dir, "python", lambda w: F.concat(F.lit("def "), w, F.lit("(a, b=1, *, c: int = 2) -> str:\n    return a\n\nclass K(Base):\n    def get_"), w, F.lit("(self):\n        return 1\n")))


@query
def js_symbols(spark, sf_dir):
    return _sources(spark, sf_dir, "javascript", lambda w: F.concat(F.lit("export async function "), w, F.lit("(a, b = 2, ...rest) { if (a) { return '}'; } }\nclass K extends B { get_"), w, F.lit("(x) { for (;;) {} } }\n")))


@query
def ts_symbols(spark, sf_dir):
    return _sources(spark, sf_dir, "typescript", lambda w: F.concat(F.lit("const "), w, F.lit(" = (a: number, b?: string): boolean => { return true; };\ninterface K { get_"), w, F.lit("(x: string): void; }\n")))


@query
def java_symbols(spark, sf_dir):
    return _sources(spark, sf_dir, "java", lambda w: F.concat(F.lit("public class K extends B {\n  public K(int a) {}\n  static int get_"), w, F.lit("(String a, List<String> b) throws IOException { return 1; }\n}\n")))


def queries() -> dict[str, Query]:
    from . import queries_source  # noqa: F401  registers its own

    return dict(QUERIES)
