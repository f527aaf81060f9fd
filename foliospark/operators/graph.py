"""Knowledge graph: nodes and edges as tables, traversal by joins of frontiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


#: Pairs that a task makes and adds up, about.
PAIRS = 1 << 21


def cooccurrence(mentions: DataFrame, place: list[str], entity: str = "entity") -> DataFrame:
    """e1, e2, weight of mentions (place, entity): pairs e1 < e2 of one place, by the products of their counts there.

    Mentions are counted by place first, so that the self-join sees each entity of a place once. Pairs are counted
    before they are made: there are as many tasks as they call for, and where these are more than the session's, the
    sums are made in as many partitions, too.
    """
    conf = mentions.sparkSession.conf
    n = cut(mentions.groupBy(*place, entity).agg(F.count("*").alias("n")))
    k = n.groupBy(*place).agg(F.count("*").alias("k"))
    parts = int((k.agg(F.sum(F.expr("k * (k - 1) div 2"))).first()[0] or 0) // PAIRS) + 1
    dealt = n.repartition(parts, *place)
    left, right = dealt.select(*place, F.col(entity).alias("e1"), F.col("n").alias("n1")), dealt.select(*place, F.col(entity).alias("e2"), F.col("n").alias("n2"))
    weights = left.join(right.hint("merge"), place).where("e1 < e2").groupBy("e1", "e2").agg(F.sum(F.col("n1") * F.col("n2")).cast("long").alias("weight"))
    usual = conf.get("spark.sql.shuffle.partitions")
    if parts <= int(usual):
        return weights
    conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return cut(weights)
    finally:
        conf.set("spark.sql.shuffle.partitions", usual)


def _ways(notes: DataFrame) -> DataFrame:
    """target, note_id: what names a note, its path without .md, its path, or its title."""
    ways = [F.replace(F.col("relative_path"), F.lit(".md"), F.lit("")), F.col("relative_path"), F.col("title")]
    return reduce(DataFrame.unionAll, [notes.select(w.alias("target"), F.col("id").alias("note_id")) for w in ways]).where("target is not null").distinct()


#: Links of a target, and notes that it names, that meet in one cell, about.
CELL = 1024


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links (source, target) with note_id, null where no note is meant, of notes (id, relative_path, title).

    A target names a note by its path without .md, by its path, or by its title. Equi-joins and a union do what a
    disjunctive join would need a nested loop for; a note that a link means in several ways is there once. Links of a
    target and the notes that it names are both split, so that a common target is no single task's.
    """
    links, ways = cut(links), cut(_ways(notes))
    many = lambda df, n: df.groupBy("target").agg(F.ceil(F.count("*") / CELL).alias(n))
    sizes = cut(many(ways, "_parts").join(many(links, "_blocks"), "target"))
    # Partitions by what is made of them: their rows say little about that.
    cells = sizes.agg(F.sum(F.col("_parts") * F.col("_blocks"))).first()[0] or 1
    spread = lambda df: df.repartition(-(-cells // 8), "target", "_block", "_part")
    deal = lambda df, key, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1)))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(m, F.lit(1)) - 1)))
    left = deal(links.join(sizes, "target", "left"), "source", "_block", F.col("_blocks"), "_part", F.col("_parts"))
    right = deal(ways.join(sizes, "target"), "note_id", "_part", F.col("_parts"), "_block", F.col("_blocks")).drop("_blocks", "_parts")
    # A cell may hold no notes: only links of targets that name none stay without.
    met = spread(left).join(spread(right), ["target", "_block", "_part"], "left").where("note_id is not null or _parts is null")
    return met.select("source", "target", *[c for c in links.columns if c not in ("source", "target")], "note_id")


def backlinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """note_id, n_backlinks, first_source of notes that links (source, target) of other notes mean, as resolve_links
    finds them. Sources are counted once for each set of targets that name a note, not for each note."""
    l = cut(links.select("source", "target").where("source is not null").distinct())
    named = cut(_ways(notes).join(l.select("target").distinct(), "target", "left_semi"))
    own = named.join(l, (F.col("note_id") == F.col("source")) & (named["target"] == l["target"]), "left_semi").select("note_id").distinct().withColumn("own", F.lit(True))
    sets = cut(named.groupBy("note_id").agg(F.sort_array(F.collect_set("target")).alias("targets")))
    each = cut(sets.select("targets").distinct().select("targets", F.explode("targets").alias("target")).join(l, "target").select("targets", "source").distinct())
    first = each.groupBy("targets").agg(F.count("*").alias("n"), F.min("source").alias("first"))
    second = each.join(first, "targets").where("source > first").groupBy("targets").agg(F.min("source").alias("second"))
    found = sets.join(first, "targets").join(second, "targets", "left").join(own, "note_id", "left")
    n = F.col("n") - F.when(F.col("own"), 1).otherwise(0)
    return found.select("note_id", n.alias("n_backlinks"), F.when(F.col("first") == F.col("note_id"), F.col("second")).otherwise(F.col("first")).alias("first_source")).where("n_backlinks > 0")


def canonical(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each unordered pair once, smaller end first, at its largest weight; self-loops stay."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "kind", "weight").groupBy("a", "b").agg(F.min_by("kind", "weight").alias("kind"), F.max("weight").alias("weight"))


#: Fixed value: the source type of documents that are notes.
NOTE = "obsidian-note"


def build(documents: DataFrame, mentions: DataFrame, tags: DataFrame | None = None, links: DataFrame | None = None, with_documents: bool = True, with_entities: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label, size) and edges (a, b, kind, weight).

    documents (id, title, and source_type where some are notes), mentions (document, chunk, entity), tags (document,
    tag), links (source, note_id). Sizes are 3 for documents and notes, 2 for entities, 1.5 for tags. Edges join
    documents to their entities and tags, entities that share chunks, and linked documents, each pair once and only
    where both ends exist. What is not asked for, or not given, is left out, and edges to it.
    """
    doc, ent, tag = (lambda c, p=p: F.concat(F.lit(p), c.cast("string")) for p in ("doc:", "entity:", "tag:"))
    kind = F.when(F.col("source_type") == NOTE, "note").otherwise("document") if "source_type" in documents.columns else F.lit("document")
    shown = documents if with_documents else documents.limit(0)
    nodes = [shown.select(doc(F.col("id")).alias("id"), kind.alias("kind"), F.col("title").alias("label"), F.lit(3.0).alias("size"))]
    held = shown.select(F.col("id").alias("document"))
    edge = lambda df, a, b, kind, w: df.select(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"), w.alias("weight"))
    one = F.lit(1).cast("long")
    edges = []
    if with_entities:
        nodes.append(mentions.select("entity").distinct().select(ent(F.col("entity")).alias("id"), F.lit("entity").alias("kind"), F.col("entity").alias("label"), F.lit(2.0).alias("size")))
        edges.append(edge(mentions.select("document", "entity").distinct().join(held, "document", "left_semi"), doc(F.col("document")), ent(F.col("entity")), "mention", one))
        edges.append(edge(cooccurrence(mentions, ["document", "chunk"]), ent(F.col("e1")), ent(F.col("e2")), "co-occurrence", F.col("weight")))
    if tags is not None:
        nodes.append(tags.select("tag").distinct().select(tag(F.col("tag")).alias("id"), F.lit("tag").alias("kind"), F.col("tag").alias("label"), F.lit(1.5).alias("size")))
        edges.append(edge(tags.distinct().join(held, "document", "left_semi"), doc(F.col("document")), tag(F.col("tag")), "tag", one))
    if links is not None:
        ends = links.where("note_id is not null").join(held.withColumnRenamed("document", "source"), "source", "left_semi").join(held.withColumnRenamed("document", "note_id"), "note_id", "left_semi")
        edges.append(edge(ends, doc(F.col("source")), doc(F.col("note_id")), "link", one))
    none = edge(held.limit(0), doc(F.col("document")), doc(F.col("document")), "link", one)
    return reduce(DataFrame.unionAll, nodes), canonical(reduce(DataFrame.unionAll, edges or [none]))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """entities, documents (notes too), relations and communities of a graph. Nodes without edges are communities of
    their own; fewer than three nodes form none."""
    of = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    counts = nodes.agg(of("entity").alias("entities"), of("document", "note").alias("documents"), F.count("*").alias("n"))
    found = communities(edges)
    groups = found.agg(F.countDistinct("community").alias("joined"), F.count("*").alias("inside"))
    all_of = counts.crossJoin(edges.agg(F.count("*").alias("relations"))).crossJoin(groups)
    return all_of.select("entities", "documents", "relations", F.when(F.col("n") < 3, 0).otherwise(F.col("joined") + F.col("n") - F.col("inside")).cast("long").alias("communities"))


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of edges (a, b)."""
    return edges.select(F.col("a").alias("from"), F.col("b").alias("to")).union(edges.select("b", "a")).distinct()


#: Starts that are searched from in one row: the bits of a number.
BITS = 64


def distances(edges: DataFrame, starts: DataFrame, depth: int, pairs: DataFrame | None = None) -> DataFrame:
    """start, node, distance of all nodes within depth steps of starts (start); of pairs (start, target), whose starts
    are among these, the target too, however far.

    Starts are searched from in blocks: a row holds a node and the block's starts that have come to it, as bits.
    """
    both = cut(arcs(edges))
    kind = dict(both.dtypes)["from"]
    starts = starts.select(F.col("start").cast(kind).alias("start")).where("start is not null").distinct()
    buckets = starts.count() // (BITS * 3 // 4) + 1
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("start")) - 1
    dealt = starts.withColumn("bucket", F.pmod(F.xxhash64("start"), F.lit(buckets))).withColumn("place", place)
    numbered = cut(dealt.select("start", (F.col("bucket") + buckets * F.floor(F.col("place") / BITS)).alias("block"), F.pmod("place", F.lit(BITS)).alias("bit")))
    levels = [cut(numbered.select("block", F.col("start").alias("node"), F.expr("shiftleft(1L, bit)").alias("mask")).groupBy("block", "node").agg(F.bit_or("mask").alias("mask")))]
    found = [levels[0]]
    todo, far = None, []
    if pairs is not None:
        wanted = pairs.select(F.col("start").cast(kind).alias("start"), F.col("target").cast(kind).alias("node")).distinct().where("start <> node")
        todo = cut(wanted.join(both.select(F.col("from").alias("node")).distinct(), "node", "left_semi").join(numbered, "start"))
    while len(levels) <= depth or (todo is not None and not todo.isEmpty()):
        step = len(levels)
        ahead = levels[-1].join(both, F.col("node") == F.col("from")).groupBy("block", F.col("to").alias("node")).agg(F.bit_or("mask").alias("mask"))
        # What is next to a level lies in the one before it, in itself, or is new.
        for near in levels[-2:]:
            ahead = ahead.join(near.withColumnRenamed("mask", "known"), ["block", "node"], "left").select("block", "node", F.expr("mask & ~coalesce(known, 0L)").alias("mask"))
        level = cut(ahead.where("mask <> 0"))
        if level.isEmpty():
            break
        levels.append(level)
        if step <= depth:
            found.append(level)
        if todo is not None:
            each = cut(todo.join(level, ["block", "node"], "left").withColumn("here", F.expr("mask is not null and shiftright(mask, bit) & 1L = 1")))
            if step > depth:
                far.append(each.where("here").select("start", "node", F.lit(step).alias("distance")))
            todo = each.where("not here").drop("mask", "here")
    names = numbered.groupBy("block").agg(F.collect_list(F.struct("bit", "start")).alias("starts"))
    rows = reduce(DataFrame.unionAll, [x.withColumn("distance", F.lit(k)) for k, x in enumerate(found)]).join(names, "block")
    near = rows.select(F.explode(F.expr("filter(starts, s -> shiftright(mask, s.bit) & 1L = 1)")).alias("s"), "node", "distance").select("s.start", "node", "distance")
    return reduce(DataFrame.unionAll, far, near)


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, distance of all nodes within depth steps of starts (start)."""
    return distances(edges, starts, depth)


def neighbourhood(edges: DataFrame, start: str, depth: int = 2, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, distance) within depth (at most 5) of start, the nearest most of them, and the edges by which a
    search in that order finds nodes: for each node found from one of these, that to the first node before it."""
    found = reachable(edges, edges.sparkSession.createDataFrame([(start,)], "start string"), min(depth, 5)).select("node", "distance")
    kept = cut(found.orderBy("distance", "node").limit(most))
    above = found.select(F.col("node").alias("from"), F.col("distance").alias("above"))
    steps = arcs(edges).join(above, "from").join(found, F.col("to") == F.col("node")).where("distance = above + 1")
    tree_edges = steps.groupBy("node").agg(F.min("from").alias("from")).join(kept.select(F.col("node").alias("from")), "from", "left_semi")
    ends = tree_edges.select(F.least("from", "node").alias("x"), F.greatest("from", "node").alias("y"))
    same = (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))
    return kept, edges.join(ends, same, "left_semi")


#: Levels of a search that one plan walks back.
WALK = 6


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int | None = None) -> DataFrame:
    """start, target, length, path of pairs (start, target) that a path joins, of at most depth edges if that is given; of equal ones the first in order.

    Each start is searched once, whatever the number of its targets, until all are found or nothing new can be
    reached. A level of the search holds nodes with the node before them, numbered in the order of their paths, so
    that no path is kept meanwhile; paths are then walked back from the targets, a row for each pair.
    """
    both, todo = cut(arcs(edges)), cut(pairs.distinct())
    kind = dict(todo.dtypes)["start"]
    found = [todo.where("start = target")]
    todo = todo.where("start <> target")
    levels = [cut(todo.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(None).cast(kind).alias("before"), F.lit(0).cast("long").alias("place")))]
    while depth is None or len(levels) <= depth:
        last = levels[-1].join(todo.select("start").distinct(), "start", "left_semi").select("start", F.col("node").alias("from"), "place")
        ahead = last.join(both, "from").groupBy("start", F.col("to").alias("node")).agg(F.min(F.struct("place", "from")).alias("by"))
        # What is next to a level lies in the one before it, in itself, or is new.
        for near in levels[-2:]:
            ahead = ahead.join(near, ["start", "node"], "left_anti")
        # Numbers rise with the order of rows, over all partitions of a sorted table.
        ahead = ahead.orderBy("start", "by.place", "node").select("start", "node", F.col("by.from").alias("before"), F.monotonically_increasing_id().alias("place"))
        level = cut(ahead)
        if level.isEmpty():
            break
        levels.append(level)
        here = level.select("start", F.col("node").alias("target"), F.lit(True).alias("here"))
        each = cut(todo.join(here, ["start", "target"], "left"))
        found.append(each.where("here").drop("here"))
        todo = each.where("here is null").drop("here")
    rows = lambda k: found[k].select("start", "target", F.lit(k).alias("length"), F.col("target").alias("node"), F.array("target").alias("path"))
    walk = rows(len(levels) - 1)
    for k in range(len(levels) - 1, 0, -1):
        walk = walk.join(levels[k].select("start", "node", "before"), ["start", "node"])
        walk = walk.select("start", "target", "length", F.col("before").alias("node"), F.concat(F.array("before"), "path").alias("path")).union(rows(k - 1))
        if k % WALK == 0:
            walk = cut(walk)
    return walk.select("start", "target", "length", "path")


#: Modularity that a step must gain for as many nodes to move in the next.
LEAST = 1e-4


def _dealt(df: DataFrame) -> DataFrame:
    """df for a join by shuffle: tables of nodes that are joined in each of many steps would all go through the driver
    if they were broadcast."""
    return df.hint("merge")


def _joined(labels: DataFrame, both: DataFrame, total: float) -> tuple[DataFrame, float]:
    """node, k, own, label, w for each label next to a node and its own, of labels (node, k, loop, label), with the
    modularity of that partition."""
    near = both.join(_dealt(labels.select(F.col("node").alias("other"), "label")), "other").select("node", "label", "w").union(labels.select("node", "label", "loop"))
    rows = cut(near.groupBy("node", "label").agg(F.sum("w").alias("w")).join(_dealt(labels.select("node", "k", "loop", F.col("label").alias("own"))), "node"))
    # Each node has one row of its own label.
    by_label = rows.where("label = own").groupBy("label").agg(F.sum("w").alias("w"), F.sum("k").alias("k"))
    return rows, by_label.agg(F.sum(F.col("w") / total - F.pow(F.col("k") / total, 2))).first()[0]


def _moved(both: DataFrame, labels: DataFrame, total: float) -> tuple[DataFrame, float]:
    """labels (node, k, loop, label) after nodes have moved to labels next to them for as long as modularity grows.

    Nodes move at once, but only a part of them, by hash, in a step. A step that loses is taken back. After one that
    gains less than LEAST half as many may move: where two nodes would swap for ever, one of them stays.
    """
    rows, best = _joined(labels, both, total)
    step, part = 0, 2
    while part <= 16:
        step += 1
        held = rows.join(_dealt(labels.groupBy("label").agg(F.sum("k").alias("held"))), "label")
        mine = F.col("label") == F.col("own")
        # Loops move with their node and count in every label alike.
        link = F.when(mine, F.col("w") - F.col("loop")).otherwise(F.col("w"))
        gain = link - F.col("k") * (F.col("held") - F.when(mine, F.col("k")).otherwise(0.0)) / F.lit(total)
        each = held.select("node", "own", "label", gain.alias("gain"), mine.alias("mine"))
        to = each.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "label")).alias("to"), F.max(F.when(F.col("mine"), F.col("gain"))).alias("stay"))
        wish = F.when(-F.col("to.loss") > F.col("stay") + 1e-9, F.col("to.label"))
        chosen = F.when(F.pmod(F.xxhash64("node", F.lit(step)), F.lit(part)) == 0, F.col("better"))
        new = cut(labels.join(_dealt(to.select("node", wish.alias("better"))), "node").select("node", "k", "loop", F.coalesce(chosen, "label").alias("label"), F.col("better").isNotNull().alias("moves")))
        if new.where("moves").isEmpty():
            break
        new = new.drop("moves")
        new_rows, quality = _joined(new, both, total)
        part = 2 if quality > best + LEAST else part * 2
        if quality > best:
            labels, rows, best = new, new_rows, quality
    return labels, best


def communities(edges: DataFrame) -> DataFrame:
    """node, community of weighted edges, without loops: modularity by levels (Louvain's method).

    Nodes move between communities while that raises modularity; then communities become nodes, and so on, until a
    level brings nothing. A community bears its first node's name; fewer than three nodes form none.
    """
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    level = cut(edges.where("a <> b").select(*pair, F.col("weight").cast("double").alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    member = cut(level.select(F.col("a").alias("node")).union(level.select("b")).distinct().withColumn("community", F.col("node")))
    if member.limit(3).count() < 3:
        return member.limit(0)
    total, best = 2.0 * level.agg(F.sum("w")).first()[0], -1.0
    while True:
        both = level.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other"), "w").union(level.where("a <> b").select("b", "a", "w"))
        loops = level.where("a = b").select(F.col("a").alias("node"), (2 * F.col("w")).alias("w"))
        ends = both.select("node", "w", F.lit(0.0).alias("loop")).union(loops.select("node", "w", F.col("w").alias("loop")))
        labels = cut(ends.groupBy("node").agg(F.sum("w").alias("k"), F.sum("loop").alias("loop")).withColumn("label", F.col("node")))
        labels, quality = _moved(both, labels, total)
        if quality <= best + 1e-9:
            break
        best = quality
        to = _dealt(labels.select("node", "label"))
        member = cut(member.join(to.withColumnRenamed("node", "community"), "community").select("node", F.col("label").alias("community")))
        ends = level.join(to.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        level = cut(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))
    first = member.groupBy("community").agg(F.min("node").alias("first"))
    return member.join(_dealt(first), "community").select("node", F.col("first").alias("community"))


def modularity(edges: DataFrame, found: DataFrame) -> float:
    """Of a partition (node, community), on weighted edges without loops."""
    e = edges.where("a <> b").join(found.select(F.col("node").alias("a"), F.col("community").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("community").alias("y")), "b")
    total = e.agg(F.sum("weight")).first()[0]
    inside = e.where("x = y").groupBy("x").agg(F.sum("weight").alias("inside"))
    degree = e.select("x", "weight").union(e.select("y", "weight")).groupBy("x").agg(F.sum("weight").alias("degree"))
    m = degree.join(inside, "x", "left").agg(F.sum(F.coalesce("inside", F.lit(0)) / total - F.pow(F.col("degree") / (2.0 * total), 2))).first()[0]
    return float(m)


def find_node(nodes: DataFrame, text: str) -> DataFrame:
    """The first node (id, label, ord) whose label is text or whose id contains it."""
    hit = nodes.where((F.col("label") == text) | F.col("id").contains(text))
    return hit.orderBy("ord").limit(1)


def suggestions(nodes: DataFrame, text: str, most: int = 5) -> DataFrame:
    return nodes.where(F.lower("label").contains(text.lower())).orderBy("ord").limit(most)


def tree(parents: DataFrame) -> DataFrame:
    """key, root, depth, path of parents (key, parent): keys whose parent is missing are roots. By joins of a frontier.
    Keys in a cycle of parents, or below one, have no root: they stay as rows with root, depth and path null."""
    p = cut(parents.select("key", "parent"))
    keys = p.select(F.col("key").alias("parent"))
    frontier = p.join(keys, "parent", "left_anti").select("key", F.col("key").alias("root"), F.lit(0).alias("depth"), F.col("key").cast("string").alias("path"))
    out = frontier = cut(frontier)
    while True:
        below = p.join(frontier.select(F.col("key").alias("parent"), "root", "depth", "path"), "parent")
        frontier = cut(below.select("key", "root", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", F.col("key").cast("string")).alias("path")))
        if frontier.isEmpty():
            break
        out = out.union(frontier)
    none = [F.lit(None).cast(kind).alias(name) for name, kind in out.dtypes[1:]]
    return out.union(p.join(out.select("key"), "key", "left_anti").select("key", *none).distinct())


def folders(paths: DataFrame) -> DataFrame:
    """path, parent, name, depth, is_file: the folder tree of paths (path), as rows."""
    parts = paths.select(F.split("path", "/").alias("parts"))
    each = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))
    node = F.array_join(F.slice("parts", 1, F.col("k")), "/")
    parent = F.when(F.col("k") > 1, F.array_join(F.slice("parts", 1, F.col("k") - 1), "/"))
    return each.select(node.alias("path"), parent.alias("parent"), F.get("parts", F.col("k") - 1).alias("name"), (F.col("k") - 1).alias("depth"), (F.col("k") == F.size("parts")).alias("is_file")).distinct()


def with_descendants(tree_rows: DataFrame, hit: Column) -> DataFrame:
    """Rows of a tree (path, ...) that meet hit or have a descendant that does."""
    hits = tree_rows.where(hit).select(F.split("path", "/").alias("parts"))
    above = hits.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice(F.col("parts"), 1, k), "/"))).alias("path")).distinct()
    return tree_rows.join(above, "path", "left_semi")


def community_members(edges: DataFrame, found: DataFrame, community: str, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first most nodes of a community (node, community), and the edges among them."""
    members = cut(found.where(F.col("community") == community).orderBy("node").limit(most).select("node"))
    inside = edges.join(members.select(F.col("node").alias("a")), "a", "left_semi").join(members.select(F.col("node").alias("b")), "b", "left_semi")
    return members, inside
