"""Graphs of cells and sheets: reach, cycles, chains, taint.

Each step is a join of a frontier with the edges; lineage is cut in the shared folder. Long chains of single links are
followed by doubling, so a chain of n hops takes log2(n) joins, be it a chain of links or a stretch of a larger graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.model import Model
from tallygrid.operators.labels import bare_link

#: Names of sheets.
STATEMENTS = ("AFS", "IFS", "Consolidated", "Balance Sheet", "BS", "Cash Flow", "Cashflow", "CFS", "P&L", "Profit and Loss", "Income Statement")
NOT_ORPHANS = ("cover", "read me", "readme", "toc", "table of contents", "instruction", "check", "audit", "control", "version", "change log", "changelog", "glossary", "note", "legend", "vba", "disclaimer")
DIVIDEND = r"(?i)\b(dividend|distribution|shareholder return|equity distribution|equity payout|cash sweep|distributable cash|equity top[\s-]?up|minimum[\s-]?cash|funding gap|equity injection|capital call)\b"


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read again; without one, to a folder of the warehouse, which
    all executors share as well."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    saved = df.checkpoint(eager=True)
    # As rows of unknown size: a checkpoint keeps the estimate of its plan, which joins of a frame with itself square in
    # each round, until estimating takes longer than joining.
    return DataFrame(spark._jsparkSession.createDataFrame(saved._jdf.javaRDD(), saved._jdf.schema()), spark)


#: Chains of single links up to so many hops are walked step by step.
SHORT_CHAIN = 16


def reach(edges: DataFrame, seeds: DataFrame, every: int = 5) -> DataFrame:
    """node and wave (steps from the nearest seed) of all nodes that edges (src, dst) lead to from the seeds (node).

    Where long chains of nodes with a single way on lie in the graph, each wave follows them to their ends by doubling;
    the number of waves then is that of the branchings on a path.
    """
    edges = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    seen = cut(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("wave", F.lit(0)))
    jumps = _jumps(edges)
    if jumps:
        return _reach_by_jumps(edges, seen, jumps)
    frontier, wave = seen, 0
    while True:
        wave += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("wave", F.lit(wave)))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
        if wave % every == 0:
            seen = cut(seen)


def _jumps(edges: DataFrame) -> list[DataFrame]:
    """For nodes with a single way on: where 1, 2, 4, ... hops over such nodes lead (src, dst). None if no chain is over
    SHORT_CHAIN hops. On a cycle of such nodes hops go round; more of them than nodes are never needed."""
    single = edges.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("dst")).where("n = 1 AND src <> dst").select("src", "dst")
    out, hops, n = [cut(single)], 1, None
    while True:
        last = out[-1]
        onward = cut(last.join(last.select(F.col("src").alias("dst"), F.col("dst").alias("further")), "dst").select("src", F.col("further").alias("dst")))
        hops *= 2
        if onward.isEmpty():
            return out if hops > SHORT_CHAIN else []
        out.append(onward)
        n = n or out[0].count()
        if hops > n:
            return out if hops > SHORT_CHAIN else []


def _nearest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.min("wave").alias("wave"))


def _reach_by_jumps(edges: DataFrame, seen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    branching = cut(edges.join(jumps[0].select("src"), "src", "left_anti"))
    frontier = seen
    while True:
        for k, jump in enumerate(jumps):
            sent = frontier.join(jump, frontier["node"] == jump["src"]).select(F.col("dst").alias("node"), (F.col("wave") + F.lit(1 << k)).alias("wave"))
            frontier = cut(_nearest(frontier.union(sent)))
        old = seen.withColumnRenamed("wave", "before")
        frontier = cut(frontier.join(old, "node", "left").where("before IS NULL OR wave <= before").drop("before"))
        seen = cut(_nearest(seen.union(frontier)))
        step = _nearest(frontier.join(branching, frontier["node"] == branching["src"]).select(F.col("dst").alias("node"), (F.col("wave") + 1).alias("wave")))
        old = seen.withColumnRenamed("wave", "before")
        frontier = cut(step.join(old, "node", "left").where("before IS NULL OR wave < before").drop("before"))
        if frontier.isEmpty():
            return seen


def component_of_cycle(edges: DataFrame) -> DataFrame:
    """node and cycle (its smallest node) of all nodes on cycles of edges (src, dst).

    Chains are contracted first, by doubling: nodes with one way out go into the node that ends their chain, then nodes
    with one way in. A chain that closes on itself is a cycle. What is left is painted: every node gets the ancestor of
    least rank in a random order, and those that it reaches back are its cycle's. An edge between colours is on no
    cycle, so it goes, and the rest is worked through again in another order. Last, chains are put back where a cycle
    runs through them.
    """
    edges = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle"))
    found = _cycles_of(edges.where("src <> dst"), 0)
    if found is None:
        return loops
    least = found.groupBy("cycle").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    rings = cut(found.join(least, "cycle").select("node", F.col("least").alias("cycle")))
    return rings.union(loops.join(rings.select("node"), "node", "left_anti"))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _joined(*found: DataFrame | None) -> DataFrame | None:
    some = [f for f in found if f is not None]
    out = some[0] if some else None
    for f in some[1:]:
        out = out.union(f)
    return out


def _cycles_of(edges: DataFrame, order: int) -> DataFrame | None:
    """node and cycle of a graph without self-links; None if it has no cycle. order: the random order of this round."""
    out = _Chains(edges)
    back = _Chains(_turned(out.rest))
    core, found = _turned(back.rest), _joined(out.rings, back.rings)
    if not core.isEmpty():
        ahead = _least_ancestor(core, order).select("node", F.col("color").alias("ahead"))
        pair = lambda color, name: (color.select(F.col("node").alias("src"), F.col(name).alias("c1")), color.select(F.col("node").alias("dst"), F.col(name).alias("c2")))
        a, b = pair(ahead, "ahead")
        same = cut(core.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("ahead")))
        behind = _least_ancestor(_turned(same), order) if not same.isEmpty() else None
        if behind is not None:
            colors = cut(behind.join(ahead, "node"))
            a, b = pair(colors, "color")
            # A cycle's nodes have both colours in common; those that share them with their root are done.
            rest = cut(same.join(a, "src").join(b, "dst").where("c1 = c2 AND c1 <> ahead").select("src", "dst"))
            found = _joined(found, colors.where("color = ahead").select("node", F.col("ahead").alias("cycle")))
            if not rest.isEmpty():
                found = _joined(found, _cycles_of(rest, order + 1))
    found = out.put_back(back.put_back(found))
    return found if found is None else cut(found)


class _Chains:
    """Nodes with a single way on, taken out of a graph: rest (edges between the others; what a chain leads to stands for
    the chain), rings (node, cycle: chains that close on themselves), and what put_back() needs."""

    def __init__(self, edges: DataFrame):
        self.rest, self.rings, self.looped = edges, None, None
        links = cut(edges.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("at")).where("n = 1").select(F.col("src").alias("node"), "at", F.least("src", "at").alias("least")))
        self.n = links.count()
        if not self.n:
            return
        inner = links.select(F.col("node").alias("at"))
        #: For 1, 2, 4, ... hops: where they lead from each node, its end at most; open: not at its end.
        self.jumps, hops = [cut(links.join(inner.withColumn("open", F.lit(True)), "at", "left").select("node", "at", "least", F.coalesce("open", F.lit(False)).alias("open")))], 1
        while hops <= self.n and not (last := self.jumps[-1]).where("open").isEmpty():
            onward = last.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("least").alias("least_on"), F.col("open").alias("open_on"))
            step = last.join(onward, "at", "left")
            self.jumps.append(cut(step.select("node", F.coalesce("further", "at").alias("at"), F.least("least", F.coalesce("least_on", "least")).alias("least"), F.coalesce("open_on", F.lit(False)).alias("open"))))
            hops *= 2
        last = self.jumps[-1]
        # Who is still on the way after more hops than there are nodes is on a ring, and every node of one is led to.
        on_ring = last.where("open").select(F.col("at").alias("node")).distinct()
        self.rings = last.join(on_ring, "node", "left_semi").select("node", F.col("least").alias("cycle"))
        ends = last.where("NOT open").select(F.col("node").alias("dst"), F.col("at").alias("end"))
        others = edges.join(links.select(F.col("node").alias("src")), "src", "left_anti")
        chains = links.select(F.col("node").alias("dst"), F.lit(True).alias("chain"))
        mapped = cut(others.join(chains, "dst", "left").join(ends, "dst", "left").where("chain IS NULL OR end IS NOT NULL").select("src", F.coalesce("end", "dst").alias("dst"), F.when(F.col("chain"), F.col("dst")).alias("entry")))
        self.entries = mapped.where("entry IS NOT NULL")
        self.looped = mapped.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")).distinct()
        ways = mapped.where("src <> dst").select("src", "dst").distinct()
        self.rest = cut(ways.join(mapped.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))

    def put_back(self, found: DataFrame | None) -> DataFrame | None:
        """found, with the chains that its cycles run through: from an entry that one of a cycle's nodes leads to, up to a
        node of the same cycle."""
        if self.looped is None:
            return found
        looped = self.looped if found is None else self.looped.join(found.select("node"), "node", "left_anti")
        found = cut(_joined(found, looped))
        if found.isEmpty():
            return None
        at = lambda name, cycle: found.select(F.col("node").alias(name), F.col("cycle").alias(cycle))
        marks = cut(self.entries.join(at("src", "c1"), "src").join(at("dst", "c2"), "dst").where("c1 = c2").select(F.col("entry").alias("node"), F.col("c1").alias("cycle")).distinct())
        for jump in self.jumps:
            if marks.isEmpty():
                break
            on = marks.join(jump.where("open").select("node", "at"), "node").select(F.col("at").alias("node"), "cycle")
            marks = cut(marks.union(on).distinct())
        return found.union(marks.join(found.select("node"), "node", "left_anti"))


def _least_ancestor(edges: DataFrame, order: int) -> DataFrame:
    """node and color: of the node and all that lead to it the least in a random order. A colour is an ancestor, so its
    own colour is one too: each step also takes that, and reach grows by a factor."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    color = cut(nodes.withColumn("color", F.struct(F.xxhash64("node", F.lit(order)).alias("rank"), F.col("node").alias("node"))))
    while True:
        sent = edges.join(color, edges["src"] == color["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("got"))
        hop = color.join(sent, "node", "left").select("node", "color", F.least("color", F.coalesce("got", "color")).alias("new"))
        further = color.select(F.col("node").alias("at"), F.col("color").alias("jump"))
        hop = hop.withColumn("at", F.col("new.node")).join(further, "at").select("node", F.least("new", "jump").alias("new"), "color")
        color = cut(hop.select("node", F.col("new").alias("color"), (F.col("new") < F.col("color")).alias("changed")))
        if color.where("changed").isEmpty():
            return color.select("node", F.col("color.node").alias("color"))
        color = color.drop("changed")


def chain_ends(links: DataFrame, most: int | None = None) -> DataFrame:
    """From links (node, next; at most one of each node): node, last (where following them ends) and hops.

    Followed by doubling. Nodes on a cycle, or that lead into one, have no end and are left out; so are those with more
    than `most` hops if it is given.
    """
    at = cut(links.select("node", F.col("next").alias("last"), F.lit(1).cast("long").alias("hops")).where("node <> next"))
    n, jump = at.count(), 1
    while jump <= max(1, n):
        onward = at.select(F.col("node").alias("last"), F.col("last").alias("further"), F.col("hops").alias("more"))
        at = cut(at.join(onward, "last", "left").select("node", F.coalesce("further", "last").alias("last"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        if at.select("last").join(links.select(F.col("node").alias("last")), "last", "left_semi").isEmpty():
            break
        jump *= 2
    ends = at.join(links.select(F.col("node").alias("last")), "last", "left_anti")
    return ends if most is None else ends.where(F.col("hops") <= most)


def cell_edges(model: Model) -> DataFrame:
    """Edges from each formula to the first corner of its references; those inside COLUMNS() and ROWS() don't count."""
    place = ["workbook_id", "sheet", "row", "col"]
    inside = model.calls.where(F.col("fn").isin("COLUMNS", "ROWS")).select(*place, F.col("open_at"), F.col("end_at"))
    refs = model.refs.select(*place, "pos", "to_sheet", "r1", "c1")
    kept = refs.join(inside, place, "left").groupBy(*place, "pos", "to_sheet", "r1", "c1").agg(F.bool_or(F.coalesce(F.col("pos").between(F.col("open_at"), F.col("end_at")), F.lit(False))).alias("structural")).where("NOT structural")
    return kept.select(F.struct(*place).alias("src"), F.struct("workbook_id", F.col("to_sheet").alias("sheet"), F.col("r1").alias("row"), F.col("c1").alias("col")).alias("dst")).distinct()


def cycles(model: Model) -> DataFrame:
    """Cycles of formulas (strongly connected sets): one row for each with its size and whether a row label on it speaks
    of distributions. A single search in depth would list some of the simple cycles; whole sets don't depend on order."""
    rings = component_of_cycle(cell_edges(model))
    words = model.texts.groupBy("workbook_id", "sheet", "row").agg(F.min_by("txt", "col").alias("label"))
    rows = rings.select("node.*", "cycle").join(words, ["workbook_id", "sheet", "row"], "left")
    return rows.groupBy("workbook_id", "cycle").agg(F.count("*").alias("cells"), F.bool_or(F.coalesce(F.col("label").rlike(DIVIDEND), F.lit(False))).alias("distribution"))


def statement_sheet(name):
    from tallygrid.functions.text import keyword_in_sheet

    out = F.lit(False)
    for k in STATEMENTS:
        out = out | (keyword_in_sheet(name, k) if len(k) <= 3 else F.lower(name).contains(k.lower()))
    return out


def orphan_sheets(sheets: DataFrame, dependencies: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Sheets with no way to or from a financial statement. Downstream, the walk doesn't pass through sheets that the
    upstream walk has reached, save the statements themselves."""
    seeds = sheets.where(statement_sheet(F.col("sheet")))
    node = lambda c: F.struct("workbook_id", F.col(c).alias("sheet"))
    up = reach(dependencies.select(node("target").alias("src"), node("precedent").alias("dst")), seeds.select(node("sheet").alias("node")))
    starts = up.where("wave = 0").select("node")
    blocked = up.where("wave > 0").select(F.col("node").alias("dst"))
    down_edges = dependencies.select(node("precedent").alias("src"), node("target").alias("dst")).join(blocked, "dst", "left_anti")
    down = reach(down_edges, starts)
    reached = up.select("node").union(down.select("node")).distinct().select("node.*")
    low = F.lower("sheet")
    excluded = F.lit(False)
    for k in NOT_ORPHANS:
        excluded = excluded | low.contains(k)
    some = seeds.select("workbook_id").distinct()
    out = sheets.join(some, "workbook_id", "left_semi").join(reached, ["workbook_id", "sheet"], "left_anti").where(~excluded)
    return out if inputs is None else out.join(inputs, ["workbook_id", "sheet"], "left_anti")


KEY_OUTPUTS = ("irr", "npv", "ebitda", "dscr", "moic", "equity multiple", "development margin", "exit multiple", "equity irr", "project irr")


#: A set of sources is a bitmap in a long.
MOST_SOURCES = 62


def trace(model: Model, sources: DataFrame, depth: int = 15) -> DataFrame:
    """What formulas rest on, for many sources at once: workbook_id, sheet, row, col, outputs (how many sources of its
    workbook lead there), depth (steps from the nearest) and what is there: formula, error, dead end (blank) or input.

    sources: places of a workbook with k from 1 to MOST_SOURCES. The walk keeps one row for each cell, with the set of
    sources that reached it as a bitmap; a step sends on only what is new to a cell. Cells of unknown sheets are left out.
    """
    node = F.struct("workbook_id", "sheet", "row", "col")
    edges = cut(cell_edges(model))
    seen = cut(sources.groupBy(node.alias("node")).agg(F.expr("bit_or(shiftleft(1L, k - 1))").alias("bits")).select("node", "bits", F.col("bits").alias("new"), F.lit(0).alias("depth")))
    for wave in range(1, depth + 1):
        frontier = seen.where("new <> 0").select(F.col("node").alias("src"), "new")
        step = frontier.join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.bit_or("new").alias("got"))
        before, got = F.coalesce("bits", F.lit(0)), F.coalesce("got", F.lit(0))
        met = seen.drop("new").join(step, "node", "full_outer")
        seen = cut(met.select("node", before.bitwiseOR(got).alias("bits"), got.bitwiseAND(F.bitwise_not(before)).alias("new"), F.coalesce("depth", F.lit(wave)).alias("depth")))
        if seen.where("new <> 0").isEmpty():
            break
    real = model.sheets.select("workbook_id", "sheet")
    places = seen.select("node.*", F.bit_count("bits").cast("long").alias("outputs"), "depth").join(real, ["workbook_id", "sheet"], "left_semi")
    state = model.cells.select("workbook_id", "sheet", "row", "col", "formula", "err", (F.col("kind") == "blank").alias("blank"))
    what = F.when(F.col("formula").isNotNull(), "formula").when(F.col("err").isNotNull(), "error").when(F.coalesce("blank", F.lit(True)), "dead end").otherwise("input")
    return places.join(state, ["workbook_id", "sheet", "row", "col"], "left").select("workbook_id", "sheet", "row", "col", what.alias("what"), "outputs", "depth")


def key_output_chains(model: Model, most_outputs: int = 15, depth: int = 10) -> DataFrame:
    """Blank or error cells that key outputs lead to over their references, with how many outputs do and in how few steps.

    The first most_outputs formula outputs of a workbook (by position) are followed over up to depth steps.
    """
    from pyspark.sql import Window as W

    from tallygrid.operators.labels import labelled_values

    if most_outputs > MOST_SOURCES:
        raise ValueError(f"at most {MOST_SOURCES} outputs of a workbook")
    outputs = labelled_values(model.cells, KEY_OUTPUTS, 8).where("is_formula").select("workbook_id", "sheet_idx", "sheet", "row", "col").distinct()
    order = W.partitionBy("workbook_id").orderBy("sheet_idx", "sheet", "row", "col")
    outputs = outputs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_outputs)
    return trace(model, outputs, depth).where("what IN ('error', 'dead end')")


def daisy_chains(model: Model, most: int = 20) -> DataFrame:
    """Bare links to bare links that nothing else uses, by row and number of hops. Chains of more than `most` hops count
    as `most`."""
    to_sheet, letters, to_row = bare_link(F.col("formula"), F.col("sheet"))
    key = lambda s, a: F.concat_ws("!", "workbook_id", s, a)
    f = model.formulas.withColumns({"node": key("sheet", "addr"), "next": F.when(to_row.isNotNull(), key(to_sheet, F.concat(letters, to_row.cast("string"))))})
    links = cut(f.where("next IS NOT NULL AND next <> node").select("node", "next", "workbook_id", "sheet", "row", "col", "addr"))
    from tallygrid.functions.addresses import address

    corners = model.refs.select(F.concat_ws("!", "workbook_id", "sheet", "addr").alias("user"), F.explode(F.array(F.concat_ws("!", "workbook_id", "to_sheet", address(F.col("r1"), F.col("c1"))), F.concat_ws("!", "workbook_id", "to_sheet", address(F.col("r2"), F.col("c2"))))).alias("next"))
    fan_in = corners.where("user <> next").distinct().groupBy("next").agg(F.count("*").alias("users"))
    second = links.select(F.col("node").alias("next"))
    starts = links.join(second, "next", "left_semi").join(fan_in, "next", "left").where("coalesce(users, 0) <= 1")
    ends = chain_ends(links.select("node", "next")).select("node", F.least("hops", F.lit(most)).alias("hops"), "last")
    rows = starts.join(ends, "node")
    # The hops of the target on: the first link to a bare link isn't one itself.
    return rows.groupBy("workbook_id", "sheet", "row", "hops").agg(F.count("*").alias("cells"), F.min("addr").alias("sample"))


def taint(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything that depends on the seeds, with the number of steps: edges lead from a formula (src) to what it uses
    (dst)."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds)


#: Functions that put another value in the place of an error.
MASKS = r"(?i)\bIFERROR\s*\(|\bIFNA\s*\("


def over_sheets(model: Model, refs: DataFrame) -> DataFrame:
    """refs with one row for each sheet that a reference over several (`first:last`) spans, in the order of tabs; the two
    named ones where either is unknown."""
    end = lambda k: F.split_part("to_sheet", F.lit(":"), F.lit(k))
    spans = refs.where(F.contains("to_sheet", F.lit(":"))).withColumns({"_a": end(1), "_b": end(2)})
    tabs = model.sheets.select("workbook_id", "sheet", "sheet_idx")
    known = lambda name, end: tabs.select("workbook_id", F.col("sheet").alias(end), F.col("sheet_idx").alias(name))
    spans = spans.join(known("_i", "_a"), ["workbook_id", "_a"], "left").join(known("_j", "_b"), ["workbook_id", "_b"], "left")
    inner = spans.where("_i IS NOT NULL AND _j IS NOT NULL").join(tabs.select("workbook_id", F.col("sheet").alias("_sheet"), F.col("sheet_idx").alias("_k")), "workbook_id").where("_k BETWEEN least(_i, _j) AND greatest(_i, _j)")
    rest = spans.where("_i IS NULL OR _j IS NULL").withColumn("_sheet", F.explode(F.array_distinct(F.array("_a", "_b"))))
    rows = [x.withColumn("to_sheet", F.col("_sheet")).select(refs.columns) for x in (inner, rest)]
    return refs.where(~F.contains("to_sheet", F.lit(":"))).unionByName(rows[0]).unionByName(rows[1])


def dependency_edges(model: Model, most_cells: int = 2000) -> DataFrame:
    """Edges from each formula (src) to every cell there is (dst) in the ranges it refers to, over sheets as well; ranges of
    over most_cells cells don't count. Ranges meet cells by bands of rows, so none is written out."""
    from tallygrid.operators.ranges import covered

    refs = model.refs.where((F.col("r2") - F.col("r1") + 1).cast("long") * (F.col("c2") - F.col("c1") + 1) <= most_cells)
    rects = over_sheets(model, refs.select("workbook_id", "sheet", "row", "col", "to_sheet", "r1", "c1", "r2", "c2")).distinct()
    rects = rects.select("workbook_id", F.struct("workbook_id", "sheet", "row", "col").alias("src"), "to_sheet", "r1", "c1", "r2", "c2")
    met = covered(rects, model.cells.select("workbook_id", "sheet", "row", "col"))
    return met.select("src", F.struct("workbook_id", F.col("to_sheet").alias("sheet"), F.col("cell_row").alias("row"), F.col("cell_col").alias("col")).alias("dst")).distinct()


def masking_seeds(model: Model, edges: DataFrame, broken: DataFrame) -> DataFrame:
    """node of the formulas that may hide an error: those that catch errors, and those that refer to a broken cell (place)."""
    node = F.struct("workbook_id", "sheet", "row", "col")
    catching = model.formulas.where(F.col("formula").rlike(MASKS)).select(node.alias("node"))
    users = edges.join(broken.select(node.alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("node"))
    return catching.union(users).distinct()


def likely_masked(model: Model, broken: DataFrame) -> DataFrame:
    """workbook_id, sheet, row and col of all formulas whose value may rest on a hidden error: the seeds and what depends
    on them. broken: places of cells that didn't resolve or lead out of the workbook."""
    edges = cut(dependency_edges(model))
    return taint(edges, masking_seeds(model, edges, broken)).select("node.*", "wave")


def recalculation(cells: DataFrame, again: DataFrame, tainted: DataFrame) -> DataFrame:
    """Compares cached numbers with recalculated ones (place, value): mismatch, likely masked (tainted), unresolved (NaN
    or no value) or match. The tolerance is 1, or 0.1 % of the cached number if that is more."""
    place = ["workbook_id", "sheet", "row", "col"]
    rows = cells.where("formula IS NOT NULL AND kind = 'number'").select(*place, F.col("num").alias("cached")).join(again.select(*place, "value"), place, "left")
    rows = rows.join(tainted.select(*place, F.lit(True).alias("tainted")), place, "left")
    unsure = F.col("value").isNull() | F.isnan("value") | F.col("cached").isNull() | F.isnan("cached")
    off = F.abs(F.col("cached") - F.col("value")) > F.greatest(F.lit(1.0), 0.001 * F.abs("cached"))
    state = F.when(unsure, "unresolved").when(off & F.coalesce("tainted", F.lit(False)), "likely masked").when(off, "mismatch").otherwise("match")
    return rows.select(*place, "cached", "value", state.alias("state"))
