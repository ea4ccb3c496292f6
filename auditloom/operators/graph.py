"""Cycles in large directed graphs, and the import graph built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from auditloom.operators.findings import emit
from auditloom.session import cut_counting, cut_round, forget, stored

# Fixed value: a file that imports more local files than this is highly coupled.
MANY_IMPORTS = 10


# Fixed value: labels a node draws in a turn; more of them make fewer turns of wider rows.
LABELS = 4

# Fixed value: from this many links on, a turn passes labels over links of 1, 2, 4, ... edges before it uses all at once.
SWEPT_LINKS = 1_000_000


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, g, name) of all nodes, and (src, dst) of all edges by these numbers.

    A number names a node of one graph, and numbers of a graph sort like its names, so searches
    join and compare single numbers. ``edges(g, src, dst)`` are expected without repeats.
    """
    ends = edges.select("g", F.col("src").alias("name")).union(edges.select("g", "dst")).distinct()
    names = stored(ends.orderBy("g", "name").select(F.monotonically_increasing_id().alias("node"), "g", "name"), "graph")
    for end in ("src", "dst"):
        known = names.select(F.col("node").alias("number"), F.col("g").alias("known_g"), F.col("name").alias("known"))
        edges = edges.join(known, F.col("g").eqNullSafe(F.col("known_g")) & (F.col(end) == F.col("known"))).drop("known_g", "known", end)
        edges = edges.withColumnRenamed("number", end)
    return names, edges.select("src", "dst")


def ring_nodes(edges: DataFrame) -> DataFrame:
    """(node, root, left) of the components that are one plain ring.

    ``root`` is the ring's smallest node and ``left`` the number of steps to it, 0 for itself.
    Pointer doubling: every step doubles the stretch in which a node knows the smallest and how far
    it is, so the number of jobs is the logarithm of the longest ring. Nodes whose way leads to a
    branching or an end drop out.
    """
    plain = edges.filter("src <> dst").distinct()
    forked = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    leaving = plain.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"), F.count("*").alias("n"))
    entering = plain.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    single = leaving.filter("n = 1").join(entering.filter("n = 1").select("node"), "node").join(
        forked, "node", "left_anti").select("node", "next")
    state, size = cut_counting(single.withColumns({"low": F.col("node"), "left": F.lit(0).cast("long")}), F.lit(True))
    changed, turn = size, 0
    while changed:
        far = state.select(F.col("node").alias("next"), F.col("next").alias("beyond"), F.col("low").alias("low_beyond"), F.col("left").alias("more"))
        lower = F.col("low_beyond") < F.col("low")
        step = state.join(far, "next").select(
            "node", F.col("beyond").alias("next"), F.least("low", "low_beyond").alias("low"),
            F.when(lower, F.col("more") + (1 << turn)).otherwise(F.col("left")).alias("left"), lower.alias("lower"),
        )
        seen = Observation()
        step = cut_round(step.observe(seen, F.count("*").alias("n"), F.count_if("lower").alias("lower")), turn)
        got = seen.get
        changed = got["n"] and (got["lower"] or size - got["n"])
        forget(state)
        state, size, turn = step, got["n"], turn + 1
    return state.select("node", F.col("low").alias("root"), "left")


def spelled(placed: DataFrame, names: DataFrame) -> DataFrame:
    """(g, root, cycle): the names of ``placed(root, node, at)`` in the order of ``at``, from the root around to it.

    The root's ``at`` is null. A row is as long as its cycle.
    """
    ordered = F.sort_array(F.collect_list(F.struct("at", "name")))
    ways = placed.join(names, "node").groupBy("root").agg(F.first("g").alias("g"), F.transform(ordered, lambda p: p["name"]).alias("nodes"))
    return ways.select("g", F.col("nodes")[0].alias("root"), F.concat("nodes", F.slice("nodes", 1, 1)).alias("cycle"))


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the given nodes."""
    left = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti")
    return left.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def dead_ends(edges: DataFrame) -> DataFrame:
    """(node) of nodes on plain ways that end, or that begin from nothing; none lies on a cycle.

    A node with one way on points to its end; a node with one way in, to its start. Pointer
    doubling finds the last node of every such way in as many jobs as the logarithm of its length.
    """
    ahead = edges.select(F.lit(True).alias("ahead"), F.col("src").alias("node"), F.col("dst").alias("next"))
    ways = ahead.unionByName(edges.select(F.lit(False).alias("ahead"), F.col("dst").alias("node"), F.col("src").alias("next")))
    single = ways.groupBy("ahead", "node").agg(F.min("next").alias("next"), F.count("*").alias("n"))
    ends = stored(ways.select("ahead", F.col("next").alias("node")).distinct().join(single, ["ahead", "node"], "left_anti"), "graph")
    ended = ends.select("ahead", F.col("node").alias("next"), F.lit(True).alias("ended"))
    # A way that is known to end points nowhere; one that reaches a fork keeps pointing there.
    state, found = cut_counting(single.filter("n = 1").join(ended, ["ahead", "next"], "left").select(
        "ahead", "node", F.when(F.col("ended").isNull(), F.col("next")).alias("next")), F.col("next").isNull())
    before = turn = 0
    while found > before:
        before, passed, turn = found, state, turn + 1
        far = state.select("ahead", F.col("node").alias("next"), F.col("next").alias("beyond"), F.lit(True).alias("known"))
        state, found = cut_counting(state.join(far, ["ahead", "next"], "left").select(
            "ahead", "node", F.when(F.col("known"), F.col("beyond")).otherwise(F.col("next")).alias("next")), F.col("next").isNull(), turn)
        forget(passed)
    return state.filter("next IS NULL").select("node").unionByName(ends.select("node")).distinct()


def trim(edges: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Edges without dead ends, as long as a round drops an eighth of them at least, and their number.

    So the number of rounds is logarithmic; what stays may still hold edges off every cycle.
    """
    current = edges
    while size:
        kept, left = cut_counting(without(current, stored(dead_ends(current), "graph")), F.lit(True))
        if 8 * (size - left) < size:
            return kept, left
        current, size = kept, left
    return current, size


def skip_links(edges: DataFrame, names: DataFrame) -> tuple[DataFrame, int]:
    """(src, dst, w): the edges, and ways of w = 2, 4, 8, ... edges along chosen neighbours; and their number.

    Every node has four pointers: its least and greatest neighbour ahead and behind. Pointers are
    doubled until they span the largest graph. A link says that a way exists and how long it is, so
    links change neither who reaches whom nor distances, only how many steps a search takes. A node
    has at most four links for each power of two.
    """
    chosen = []
    for ahead, node, other in ((True, "src", "dst"), (False, "dst", "src")):
        for least in (True, False):
            pick = F.min(other) if least else F.max(other)
            chosen.append(edges.groupBy(F.col(node).alias("node")).agg(pick.alias("next")).select(
                F.lit(ahead).alias("ahead"), F.lit(least).alias("least"), "node", "next"))
    state = chosen[0]
    for more in chosen[1:]:
        state = state.unionByName(more)
    state, size = cut_counting(state, F.lit(True))
    states = [state]
    # One row for each graph.
    nodes = state.select("node").distinct().join(names, "node")
    most = nodes.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    links, span = edges.select("src", "dst", F.lit(1).cast("long").alias("w")), 1
    while size and 2 * span <= most:
        far = state.select("ahead", "least", F.col("node").alias("next"), F.col("next").alias("beyond"))
        state, size = cut_counting(state.join(far, ["ahead", "least", "next"]).select(
            "ahead", "least", "node", F.col("beyond").alias("next")), F.lit(True), len(states))
        span *= 2
        states.append(state)
        links = links.unionByName(state.filter("node <> next").select(
            F.when(F.col("ahead"), F.col("node")).otherwise(F.col("next")).alias("src"),
            F.when(F.col("ahead"), F.col("next")).otherwise(F.col("node")).alias("dst"), F.lit(span).cast("long").alias("w"),
        ))
    links, size = cut_counting(links.groupBy("src", "dst").agg(F.min("w").alias("w")), F.lit(True))
    forget(*states)
    return links, size


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(g, node, root) for every node on a cycle of ``edges(g, src, dst)``; root is its component's smallest node."""
    return Cycles(edges).components()


class Cycles:
    """The cyclic part of ``edges(g, src, dst)``: plain rings, loops, and a core of whatever is left.

    Every search takes a number of jobs that grows with the logarithm of the graph: rings, dead
    ends and links by pointer doubling; components by forward and backward reach over links, with
    labels drawn anew each round; shortest ways over links. State is one row for each node, edge
    or link, never a table of reachable pairs; nodes are numbers until the result names them.
    Rounds are cut off from their lineage through the shared checkpoint folder. Edges without a
    graph count only as loops.
    """

    def __init__(self, edges: DataFrame):
        wanted = edges.select("g", "src", "dst").filter("src = dst OR (src <> dst AND g IS NOT NULL)").distinct()
        distinct, self.n_loops = cut_counting(wanted, F.col("src") == F.col("dst"))
        self.names, by_number = numbered(distinct)
        every, size = cut_counting(by_number, F.col("src") != F.col("dst"))
        self.loops = every.filter("src = dst")
        plain, size = trim(every.filter("src <> dst"), size)
        # A ring with a loop on it isn't plain.
        self.rings = ring_nodes(plain.unionByName(self.loops)) if size else self.nothing(every)
        self.core, self.size = cut_counting(without(plain, self.rings), F.lit(True)) if size else (plain, 0)
        self.links, self.n_links = skip_links(self.core, self.names) if self.size else (None, 0)

    @staticmethod
    def nothing(edges: DataFrame) -> DataFrame:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("root"), F.lit(0).cast("long").alias("left")).filter(F.lit(False))

    def core_components(self) -> DataFrame:
        """(node, root) for nodes that are on a cycle of the core or have a loop."""
        found = None
        active, size, turn = self.links, self.n_links, 0
        while size:
            coloured = colours(active, turn, size >= SWEPT_LINKS)
            part = coloured.filter("drawn IS NOT NULL").select(F.lit(turn).alias("turn"), "drawn", "colour", "node")
            found = part if found is None else found.unionByName(part)
            active, size = cut_counting(same_colours(active, coloured), F.lit(True))
            turn += 1
        out = self.loops.select(F.col("src").alias("node"), F.col("src").alias("root"))
        if found is not None:
            # A node that nothing leads back to is no component.
            roots = found.groupBy("turn", "drawn", "colour").agg(F.min("node").alias("root"), F.count("*").alias("n")).filter("n > 1")
            out = out.unionByName(found.join(roots, ["turn", "drawn", "colour"]).select("node", "root"))
        # A loop on a larger component's node names its node as root; the smaller root wins.
        return stored(out.groupBy("node").agg(F.min("root").alias("root")), "graph")

    def components(self) -> DataFrame:
        found = self.rings.select("node", "root").unionByName(self.core_components())
        root = self.names.select(F.col("node").alias("root"), F.col("name").alias("root_name"))
        return found.join(self.names, "node").join(root, "root").select("g", F.col("name").alias("node"), F.col("root_name").alias("root"))

    def shortest(self) -> DataFrame:
        """(g, root, cycle): a shortest cycle through each component's smallest node.

        Of equally short ones it is that whose nodes, read from the root on, sort first.
        """
        placed = self.rings.select("root", "node", F.when(F.col("node") != F.col("root"), -F.col("left")).alias("at"))
        if self.size or self.n_loops:
            placed = placed.unionByName(shortest_cycles(self.core.unionByName(self.loops), self.links, self.core_components()))
        return spelled(placed, self.names)


def colours(links: DataFrame, turn: int, swept: bool) -> DataFrame:
    """(node, ahead_0, back_0, ..., drawn, colour): the least labels that reach a node and that it reaches.

    Every node draws LABELS labels a turn. Where the least of one drawing that reaches a node is also the
    least that it reaches, node and owner of the label reach each other: ``colour`` is that label,
    ``drawn`` its drawing, and they name the component. All nodes of a component share all least labels,
    so those of the others part wherever they differ; of a way without cycles about a sixth stays
    together, so the number of turns is logarithmic in expectation. The hash of one number is one to
    one, so no two nodes draw the same label.

    ``swept``, labels first pass over links of each length once, which takes them along most of a way for
    the price of one round; after that a round sends on what the round before changed, over all links.
    """
    labels = [f"label_{i}" for i in range(LABELS)]
    sends = links.select(F.lit(True).alias("ahead"), F.col("src").alias("sender"), F.col("dst").alias("node"), "w").unionByName(
        links.select(F.lit(False).alias("ahead"), F.col("dst").alias("sender"), F.col("src").alias("node"), "w"))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    drawn = {c: F.xxhash64(F.lit(turn * LABELS + i), "node") for i, c in enumerate(labels)}
    every = F.lit(True).alias("fresh")
    state, changed = cut_counting(nodes.withColumns(drawn).select(
        F.explode(F.array(F.lit(True), F.lit(False))).alias("ahead"), "node", *labels, every), F.col("fresh"))
    longest, span = (links.agg(F.max("w")).first()[0] if swept else 0), 1
    while changed:
        passed = state
        if span <= longest:
            state = stored(least_labels(state, sends.filter(F.col("w") == span), labels).withColumn("fresh", every), "graph")
            span *= 2
        else:
            state, changed = cut_counting(least_labels(state, sends, labels), F.col("fresh"))
        forget(passed)
    both = state.groupBy("node").agg(*[
        F.max(F.when(F.col("ahead") == F.lit(ahead), F.col(c))).alias(side + c.removeprefix("label"))
        for ahead, side in ((True, "ahead"), (False, "back")) for c in labels])
    met = [F.col(f"ahead_{i}") == F.col(f"back_{i}") for i in range(LABELS)]
    coloured = stored(both.withColumns({
        "drawn": F.coalesce(*[F.when(m, F.lit(i)) for i, m in enumerate(met)]),
        "colour": F.coalesce(*[F.when(m, F.col(f"ahead_{i}")) for i, m in enumerate(met)]),
    }), "graph")
    forget(state)
    return coloured


def least_labels(state: DataFrame, sends: DataFrame, labels: list[str]) -> DataFrame:
    """(ahead, node, labels, fresh): each node's least labels after its fresh senders' came in; fresh if one fell."""
    fresh = state.filter("fresh").select("ahead", F.col("node").alias("sender"), *labels)
    sent = sends.join(fresh, ["ahead", "sender"]).select("ahead", "node", *labels, *[F.lit(None).cast("long").alias("had_" + c) for c in labels])
    known = state.select("ahead", "node", *labels, *[F.col(c).alias("had_" + c) for c in labels])
    least = known.unionByName(sent).groupBy("ahead", "node").agg(
        *[F.min(c).alias(c) for c in labels], *[F.max("had_" + c).alias("had_" + c) for c in labels])
    return least.select("ahead", "node", *labels, F.expr(" OR ".join(f"{c} < had_{c}" for c in labels)).alias("fresh"))


def same_colours(links: DataFrame, coloured: DataFrame) -> DataFrame:
    """Links between nodes that no component was found for yet and that share all least labels."""
    shared = [f"{side}_{i}" for side in ("ahead", "back") for i in range(LABELS)]
    left = coloured.filter("drawn IS NULL")
    start = left.select(F.col("node").alias("src"), *shared)
    end = left.select(F.col("node").alias("dst"), *[F.col(c).alias("end_" + c) for c in shared])
    same = F.expr(" AND ".join(f"{c} = end_{c}" for c in shared))
    return links.join(start, "src").join(end, "dst").filter(same).select("src", "dst", "w")


def within_components(edges: DataFrame, components: DataFrame, *more: str) -> DataFrame:
    """(root, src, dst, ...): edges between nodes of one component; ways between them stay inside."""
    start = components.select(F.col("node").alias("src"), "root")
    end = components.select(F.col("node").alias("dst"), F.col("root").alias("other"))
    return edges.join(start, "src").join(end, "dst").filter("root = other").select("root", "src", "dst", *more)


def distances_to_root(links: DataFrame, components: DataFrame) -> DataFrame:
    """(node, d): edges on a shortest way from each node to its root.

    Relaxation over links by those rows alone that the round before has changed.
    """
    roots = components.select(F.col("root").alias("node"), F.lit(0).cast("long").alias("d")).distinct()
    known, changed = cut_counting(roots.withColumn("fresh", F.lit(True)), F.col("fresh"))
    while changed:
        passed = known
        moved = known.filter("fresh").select(F.col("node").alias("dst"), F.col("d").alias("rest"))
        tried = links.join(moved, "dst").select(F.col("src").alias("node"), (F.col("w") + F.col("rest")).alias("d"))
        both = known.select("node", "d", F.col("d").alias("before")).unionByName(tried.withColumn("before", F.lit(None).cast("long")))
        known, changed = cut_counting(both.groupBy("node").agg(F.min("d").alias("d"), F.max("before").alias("before")).select(
            "node", "d", (F.col("before").isNull() | (F.col("d") < F.col("before"))).alias("fresh")), F.col("fresh"))
        forget(passed)
    return known.drop("fresh")


def shortest_cycles(edges: DataFrame, links: DataFrame | None, components: DataFrame) -> DataFrame:
    """(root, node, at) for the ``components(node, root)`` of a graph and its ``skip_links``, if it has any.

    Each node points to the neighbour nearest to the root, of equally near ones to the smallest;
    the way that begins at the root is read by doubling the pointers, and its nodes sort by their
    distance. ``at`` is null for the root and grows along the way.
    """
    inner = stored(within_components(edges, components), "graph")
    known = inner.select("src", "dst", F.lit(1).cast("long").alias("w"))
    if links is not None:
        known = stored(within_components(links, components, "w").select("src", "dst", "w"), "graph")
    distance = distances_to_root(known, components)
    nearest = inner.join(distance.withColumnRenamed("node", "dst"), "dst").groupBy("root", F.col("src").alias("node")).agg(
        F.min(F.struct("d", "dst")).alias("to"))
    pointer = stored(nearest.select("root", "node", F.col("to.dst").alias("next")), "graph")
    # The way ends where it comes back to the root.
    jump = pointer.filter("node <> root AND next <> root").select("node", "next")
    on_way, found = cut_counting(pointer.filter("node = root AND next <> root").select("root", F.col("next").alias("node")), F.lit(True))
    before = turn = 0
    while found > before:
        before, passed, turn = found, on_way, turn + 1
        ahead = jump.join(on_way, "node").select("root", F.col("next").alias("node"))
        on_way, found = cut_counting(on_way.unionByName(ahead).distinct(), F.lit(True), turn)
        forget(passed)
        if found > before:
            far = jump.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
            jump = cut_round(jump.join(far, "next").select("node", F.col("beyond").alias("next")), turn)
    placed = on_way.join(distance, "node").select("root", "node", (-F.col("d")).alias("at"))
    return placed.unionByName(components.select("root", F.col("root").alias("node"), F.lit(None).cast("long").alias("at")).distinct())


def module_index(files: DataFrame) -> DataFrame:
    """(repo, module, path): the file behind each dotted module name.

    A stub and a source of one module share the name; the larger path is kept.
    """
    stem = F.regexp_replace("path", r"\.pyi?$", "")
    module = F.translate(F.regexp_replace(stem, r"(^|/)__init__$", ""), "/", ".")
    return files.filter("is_py").groupBy("repo", module.alias("module")).agg(F.max("path").alias("path"))


def longest_prefix(
    rows: DataFrame, keys: list[str], name: str, index: DataFrame, indexed: str, separator: str = "."
) -> DataFrame:
    """Join each row with the longest separator-bounded prefix of ``name`` in the index.

    Prefixes are exploded and equi-joined; an aggregate keeps the longest match, so no
    row is compared with names it does not start with.
    """
    cells = F.split(name, "\\" + separator)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(cells)), lambda n: F.array_join(F.slice(cells, F.lit(1), n), separator)
    )
    row_columns = rows.columns
    tried = rows.select("*", F.explode(prefixes).alias(indexed))
    matched = tried.join(index, [*keys, indexed])
    extra = [c for c in index.columns if c not in keys and c != indexed]
    best = F.max_by(F.struct(indexed, *extra), F.length(indexed)).alias("_best")
    return matched.groupBy(*row_columns).agg(best).select(
        *row_columns, F.col("_best." + indexed).alias(indexed), *[F.col("_best." + c).alias(c) for c in extra]
    )


def import_edges(imports: DataFrame, index: DataFrame) -> DataFrame:
    """(repo, src, dst): files importing files of the same repository, without repeats.

    Each module name is resolved once per repository, however many files import it.
    """
    wanted = imports.select("repo", F.col("path").alias("src"), F.col("module").alias("imported")).distinct()
    known = index.select("repo", "module", F.col("path").alias("dst"))
    names = imports.select("repo", F.col("module").alias("imported")).distinct()
    resolved = longest_prefix(names, ["repo"], "imported", known, "module").select("repo", "imported", "dst")
    return wanted.join(resolved, ["repo", "imported"]).select("repo", "src", "dst").distinct()


def cycles_per_repo(edges: DataFrame) -> DataFrame:
    """(repo, root, cycle) for edges(repo, src, dst)."""
    return Cycles(edges.withColumnRenamed("repo", "g")).shortest().withColumnRenamed("g", "repo")


def circular_imports(edges: DataFrame) -> DataFrame:
    detail = F.concat(F.lit("Circular import: "), F.array_join("cycle", " -> "))
    return emit(cycles_per_repo(edges), "ARCH-CIRCULAR-IMPORT", detail=detail, file="root")


def fan_out(edges: DataFrame, keys: list[str], target: str, more_than: int) -> DataFrame:
    """Sources with more than so many distinct targets, with the number as ``n``."""
    pairs = edges.select(*keys, target).distinct()
    return pairs.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)


def high_coupling(edges: DataFrame) -> DataFrame:
    detail = F.format_string("File imports %d different modules.", F.col("n"))
    return emit(fan_out(edges, ["repo", "src"], "dst", MANY_IMPORTS), "ARCH-HIGH-COUPLING", detail=detail, file="src")
