"""Import, dependency and trade graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.operators import graph, route_rules
from auditloom.plans.bound.base import bind, table
from auditloom.plans.bound.corpus import FUNCTIONS, SHOWN, corpus, facts_of
from auditloom.plans.bound.tables import PAGE_PATH_SQL, page_paths
from auditloom.plans.expected import PATH_SQL, findings_sql, per_template_sql, sums_sql
from auditloom.plans.seeded import hub_files, ring_files
from auditloom.session import cut
from auditloom.sources.facts import extract_facts, imports, store_facts
from auditloom.sources.files import select_python
from auditloom.sources.lines import to_lines

# Members of a ring in order, their successor, and whether the group's number is even.
RING_SQL = """
    SELECT source AS repo, doc_id, doc_id // 80 AS block,
           coalesce(lead(doc_id) OVER (PARTITION BY source, doc_id // 80 ORDER BY doc_id),
                    CASE WHEN (doc_id // 80) % 2 = 0 THEN min(doc_id) OVER (PARTITION BY source, doc_id // 80) END) AS target
    FROM documents
"""


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_files(table(spark, sf_dir, "documents"))


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ring(spark, sf_dir)
    found = imports(store_facts(extract_facts(files, ["Import", "ImportFrom"])))
    return graph.import_edges(found, graph.module_index(files))


@bind("g1_module_index", f"""
    SELECT source AS repo, file AS path, replace(replace(file, '.py', ''), '/', '.') AS module
    FROM (SELECT source, doc_id, {PATH_SQL} AS file FROM documents WHERE doc_id % 33 NOT IN (6, 32))
""")
def module_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_index(corpus(spark, sf_dir, with_text=False))


@bind("g2_import_edges", f"""
    SELECT repo, 'src/pkg/m' || doc_id || '.py' AS src, 'src/pkg/m' || target || '.py' AS dst
    FROM ({RING_SQL}) WHERE target IS NOT NULL
""")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_edges(spark, sf_dir)


PREFIX_SQL = f"""
    SELECT DISTINCT split_part(path, '/', 1) AS prefix, 1 AS depth FROM (SELECT page_id, {PAGE_PATH_SQL} AS path FROM pages)
    WHERE page_id % 2 = 0
    UNION SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/'), 2
    FROM (SELECT page_id, {PAGE_PATH_SQL} AS path FROM pages) WHERE page_id % 3 = 0 AND contains(path, '/')
"""


@bind("g2_longest_url_prefix", f"""
    SELECT page_id, arg_max(prefix, length(prefix)) AS prefix, max(depth) AS depth FROM (
        SELECT page_id, p.prefix, p.depth FROM (SELECT page_id, {PAGE_PATH_SQL} AS path FROM pages) u
        JOIN ({PREFIX_SQL}) p ON u.path = p.prefix OR starts_with(u.path, p.prefix || '/'))
    GROUP BY page_id
""")
def longest_url_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page the longest of the known path prefixes its url starts with."""
    pages = page_paths(spark, sf_dir).select("page_id", "path")
    cells = F.split("path", "/")
    one = pages.filter("page_id % 2 = 0").select(F.element_at(cells, 1).alias("prefix"), F.lit(1).alias("depth"))
    two = pages.filter("page_id % 3 = 0 AND contains(path, '/')").select(
        F.array_join(F.slice(cells, 1, 2), "/").alias("prefix"), F.lit(2).alias("depth")
    )
    index = one.unionByName(two).distinct()
    return graph.longest_prefix(pages, [], "path", index, "prefix", "/").select("page_id", "prefix", "depth")


# The members of a closed ring from its smallest path on, once around.
CYCLE_SQL = """
    SELECT repo, block, list(path ORDER BY doc_id) AS members, min(path) AS root FROM (
        SELECT source AS repo, doc_id // 80 AS block, doc_id, {name} AS path FROM documents)
    WHERE block % 2 = 0 GROUP BY ALL
"""
ROTATED_SQL = (
    "list_concat(list_slice(members, list_position(members, root), len(members)), "
    "list_slice(members, 1, list_position(members, root)))"
)


@bind("g3_circular_imports", f"""
    SELECT repo, root AS file, 'Circular import: ' || array_to_string({ROTATED_SQL}, ' -> ') AS detail
    FROM ({CYCLE_SQL.format(name="'src/pkg/m' || doc_id || '.py'")})
""")
def circular_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.circular_imports(ring_edges(spark, sf_dir)).select("repo", "file", "detail")


@bind("g3_long_rings", """
    SELECT 'b' || (doc_id // 2000) AS repo, CAST(min(doc_id) AS VARCHAR) AS root, count(*) + 1 AS n_members,
           md5(string_agg(CAST(doc_id AS VARCHAR), '>' ORDER BY doc_id) || '>' || min(doc_id)) AS way
    FROM documents WHERE doc_id // 2000 % 2 = 0 GROUP BY doc_id // 2000
""")
def long_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ring of 2,000 documents for every second block of ids; the other blocks stay chains."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2000).alias("block"))
    # A block has a fixed number of ids, so no window grows with the table.
    group = Window.partitionBy("block")
    following = F.lead("doc_id").over(group.orderBy("doc_id"))
    target = F.coalesce(following, F.when(F.col("block") % 2 == 0, F.min("doc_id").over(group)))
    # Names of equal length sort like numbers.
    name = lambda c: F.format_string("%012d", c)
    edges = rows.select(F.concat(F.lit("b"), F.col("block").cast("string")).alias("repo"), name("doc_id").alias("src"), target.alias("to"))
    edges = edges.filter("to IS NOT NULL").select("repo", "src", name("to").alias("dst"))
    return shown_ways(graph.cycles_per_repo(edges))


# Blocks of 200 documents in the order of their ids, each a graph of one of five kinds, by n nodes and position k:
# a ring with a chord 50 -> 150; a ladder without a cycle; two rings that share node 100; a chain with one
# edge back, 120 -> 119; a ladder with an edge from the last node to the first.
BLOCKS_SQL = """
    SELECT doc_id, doc_id // 200 AS block, doc_id // 200 % 5 AS kind, count(*) OVER w AS n,
           row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id) - 1 AS k
    FROM documents WINDOW w AS (PARTITION BY doc_id // 200)
"""


@bind("g3_chords_and_chains", f"""
    SELECT 'b' || block AS repo, CAST(min(doc_id) AS VARCHAR) AS root, count(*) + 1 AS n_members,
           md5(string_agg(CAST(doc_id AS VARCHAR), '>' ORDER BY doc_id) || '>' || min(doc_id)) AS way
    FROM ({BLOCKS_SQL}) WHERE n > 1 AND CASE kind
        WHEN 0 THEN n <= 151 OR k <= 50 OR k >= 150
        WHEN 2 THEN n > 101 AND k <= 100
        WHEN 3 THEN n > 120 AND k IN (119, 120)
        WHEN 4 THEN n > 2 AND (k = 0 OR k % 2 = (n - 1) % 2)
        ELSE false END
    GROUP BY block
""")
def chords_and_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest cycles of long rings, ladders and chains, some with a second way."""
    group = Window.partitionBy("block")
    # A block has a fixed number of ids, so no window grows with the table.
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 200).alias("block")).withColumns({
        "n": F.count("*").over(group), "k": F.row_number().over(group.orderBy("doc_id")) - 1, "kind": F.col("block") % 5,
    })
    to = lambda when, k: F.when(when, k)
    kind, n, k = F.col("kind"), F.col("n"), F.col("k")
    targets = F.array(
        to(k + 1 < n, k + 1), to(kind.isin(1, 4) & (k + 2 < n), k + 2), to((kind == 0) & (k == 50) & (n > 150), F.lit(150)),
        to(kind.isin(0, 4) & (k + 1 == n) & (n > 1), F.lit(0)), to((kind == 2) & (k == 100) & (n > 101), F.lit(0)),
        to((kind == 2) & (k + 1 == n) & (n > 101), F.lit(100)), to((kind == 3) & (k == 120), F.lit(119)),
    )
    steps = rows.select("block", "doc_id", F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("k"))
    name = lambda c: F.format_string("%012d", c)
    edges = steps.join(rows.select("block", "k", F.col("doc_id").alias("to")), ["block", "k"]).select(
        F.concat(F.lit("b"), F.col("block").cast("string")).alias("repo"), name("doc_id").alias("src"), name("to").alias("dst"))
    return shown_ways(graph.cycles_per_repo(edges))


def shown_ways(cycles: DataFrame) -> DataFrame:
    """Root, length and digest of cycles whose names are numbers."""
    short = F.transform("cycle", lambda n: n.cast("long").cast("string"))
    return cycles.select(
        "repo", F.col("root").cast("long").cast("string").alias("root"), F.size("cycle").cast("long").alias("n_members"),
        F.md5(F.array_join(short, ">")).alias("way"),
    )


TRADE_SQL = """
    SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY ALL HAVING count(*) > (SELECT count(*) / 300 FROM lineitem)
"""


@bind("g3_trade_cycles", f"""
    WITH RECURSIVE edge AS ({TRADE_SQL}), reach(src, dst) AS (
        SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src)
    SELECT format('{{:02d}}', a.src) AS nation, format('{{:02d}}', min(b.dst)) AS root
    FROM reach a JOIN reach b ON a.src = b.src JOIN reach c ON c.src = b.dst AND c.dst = a.src
    WHERE a.src = a.dst GROUP BY a.src
""")
def trade_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that trade in circles: busy directed edges from customer to supplier nation."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    counted = (
        lines.join(suppliers, "s_suppkey").join(orders.join(customers, "c_custkey"), "l_orderkey")
        .groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    )
    busy = spark.sql(
        "SELECT c_nationkey, s_nationkey FROM {counted} WHERE n > (SELECT sum(n) / 300 FROM {counted})", counted=cut(counted)
    )
    edges = busy.select(
        F.lit("trade").alias("g"), F.format_string("%02d", "c_nationkey").alias("src"),
        F.format_string("%02d", "s_nationkey").alias("dst"),
    )
    return graph.cyclic_components(edges).select(F.col("node").alias("nation"), "root")


@bind("g4_high_coupling", """
    SELECT source AS repo, 'src/pkg/m' || min(doc_id) || '.py' AS file,
           'File imports ' || (count(*) - 1) || ' different modules.' AS detail
    FROM documents GROUP BY source, doc_id // 320 HAVING count(*) > 11
""")
def high_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = hub_files(table(spark, sf_dir, "documents"))
    facts = store_facts(extract_facts(files, ["Import", "ImportFrom"]))
    edges = graph.import_edges(imports(facts), graph.module_index(files))
    return graph.high_coupling(edges).select("repo", "file", "detail")


@bind("g4_customers_with_many_parts", """
    SELECT o_custkey, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    GROUP BY o_custkey HAVING count(DISTINCT l_partkey) > 40
""")
def customers_with_many_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    bought = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey")
    return graph.fan_out(bought, ["o_custkey"], "l_partkey", 40)


def route_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts and routes of the seeded corpus."""
    files = corpus(spark, sf_dir)
    facts = store_facts(extract_facts(files, [*FUNCTIONS, "Call"]))
    return facts, route_rules.routes(facts, to_lines(select_python(files)))


ROUTES = [(28, "read_a", "GET", 1, False), (28, "health", "GET", 5, False), (28, "read_b", "GET", 9, True)]


@bind("g5_routes", per_template_sql(ROUTES, ["function", "method", "line", "protected"]))
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir)
    found = route_rules.routes(facts_of(spark, sf_dir, *FUNCTIONS), to_lines(select_python(files)))
    return found.select("repo", F.col("path").alias("file"), "function", "method", "line", "protected")


@bind("g6_dependency_edges", f"""
    SELECT repo, 'f' || doc_id AS function, 'f' || target AS dependency FROM ({RING_SQL}) WHERE target IS NOT NULL
""")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_rules.dep_edges(extract_facts(ring(spark, sf_dir), ["Call"]))


@bind("g7_dependency_graph", f"""
    SELECT repo, e.function, 'route' AS type, 'GET' AS method, min(file) AS file, arg_min(e.line, file) AS line,
           bool_or(e.protected) AS protected, '' AS dependencies
    FROM ({per_template_sql(ROUTES, ["function", "method", "line", "protected"])}) e GROUP BY repo, e.function
    UNION ALL
    SELECT source, 'f', 'dependency', NULL, NULL, NULL, NULL,
           string_agg('nowhere_' || doc_id, ',' ORDER BY 'nowhere_' || doc_id) FROM documents WHERE doc_id % 33 = 29 GROUP BY source
""")
def dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, found = route_tables(spark, sf_dir)
    nodes = route_rules.dep_graph(found, route_rules.dep_edges(facts))
    return nodes.withColumn("dependencies", F.array_join("dependencies", ","))


@bind("g8_circular_dependencies", f"""
    SELECT repo, 'Circular dependency involving ''' || list_extract({ROTATED_SQL}, -2) || ''' and ''' || root || '''.' AS detail
    FROM ({CYCLE_SQL.format(name="'f' || doc_id")})
""")
def circular_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = route_rules.dep_edges(extract_facts(ring(spark, sf_dir), ["Call"]))
    return route_rules.circular_dependencies(edges).select("repo", "detail")


@bind("g9_unprotected_routes", findings_sql("FASTAPI-UNPROTECTED-ROUTE"))
def unprotected_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_rules.unprotected_routes(route_tables(spark, sf_dir)[1]).select(*SHOWN)


@bind("g10_missing_dependencies", findings_sql("FASTAPI-MISSING-DEP"))
def missing_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = store_facts(facts_of(spark, sf_dir, *FUNCTIONS, "Call"))
    return route_rules.missing_dependencies(facts).select(*SHOWN)


@bind("g11_dependency_metrics", sums_sql({
    "routes_found": {28: 3}, "dependencies_found": {29: 1}, "unprotected_routes": {28: 2}, "dependency_cycles": {},
}, keep_zero=False))
def dependency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, found = route_tables(spark, sf_dir)
    cycles = route_rules.circular_dependencies(route_rules.dep_edges(facts))
    return route_rules.dep_metrics(found, facts, cycles)
