"""Nearest reference by a quadtree, distance join on crossed cells, and reachability on a directed network."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.scale import RoundTables

_BITS, _DEPTH = 3, 30


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def _finite(*names: str) -> Column:
    test = F.lit(True)
    for n in names:
        test &= F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return test


def reference_tree(references: DataFrame, label: str, ref_x: str, ref_y: str, leaf: int, tables: RoundTables) -> tuple[list[DataFrame], DataFrame]:
    """Quadtree over reference places: inner and leaf nodes of every level, and the places of the leaves.

    A level halves each side of its parents ``_BITS`` times. A node keeps the box around its places and their number; nodes
    of at most ``leaf`` places are not divided. Node keys are cell numbers of the whole extent, ``_DEPTH`` bits a side.
    """
    refs = references.where(_finite(ref_x, ref_y)).groupBy(F.col(ref_x).cast("double").alias("_rx"), F.col(ref_y).cast("double").alias("_ry")).agg(F.min(label).alias("_label"))
    refs = tables.store(refs)
    box = refs.agg(F.min("_rx"), F.max("_rx"), F.min("_ry"), F.max("_ry")).first()
    if box[0] is None:
        return [], refs
    unit = max(box[1] - box[0], box[3] - box[2], 1e-12) * (1 + 1e-9) / 2**_DEPTH
    cell = lambda c, low: F.least(F.floor((F.col(c) - low) / F.lit(unit)), F.lit(2**_DEPTH - 1)).cast("long")
    left = refs.withColumns({"_ix": cell("_rx", box[0]), "_iy": cell("_ry", box[2])})
    levels, places = [], None
    for depth in range(0, _DEPTH + 1, _BITS):
        keyed = left.withColumns({"_kx": F.shiftright("_ix", _DEPTH - depth), "_ky": F.shiftright("_iy", _DEPTH - depth)})
        nodes = keyed.groupBy("_kx", "_ky").agg(
            F.min("_rx").alias("_x0"), F.max("_rx").alias("_x1"), F.min("_ry").alias("_y0"), F.max("_ry").alias("_y1"), F.count(F.lit(1)).alias("_n")
        )
        closed = (F.col("_n") <= leaf) if depth < _DEPTH else F.lit(True)
        nodes = tables.store(nodes.withColumn("_leaf", closed))
        levels.append(nodes)
        ends = keyed.join(nodes.where("_leaf").select("_kx", "_ky"), ["_kx", "_ky"]).select(
            F.lit(len(levels) - 1).alias("_level"), "_kx", "_ky", "_rx", "_ry", "_label"
        )
        places = ends if places is None else places.unionByName(ends)
        if nodes.where("not _leaf").isEmpty():
            break
        left = tables.store(keyed.join(nodes.where("not _leaf").select("_kx", "_ky"), ["_kx", "_ky"], "left_semi").select("_rx", "_ry", "_label", "_ix", "_iy"))
    return levels, places


def nearest_candidates(
    points: DataFrame, references: DataFrame, x: str, y: str, label: str, ref_x: str = "ref_x", ref_y: str = "ref_y", leaf: int = 8
) -> DataFrame | None:
    """(``_x``, ``_y``, ``_rx``, ``_ry``, ``_label``): the reference places that each distinct location is compared with.

    Locations go down the tree together. Every box has a reference on each of its sides, which bounds the distance to the
    nearest from above; a node whose box lies farther than the least bound so far is dropped. What is left at the end are
    a few leaves per location, whatever its distance from the references. ``None`` without references.
    """
    tables = RoundTables(points.sparkSession)
    levels, places = reference_tree(references, label, ref_x, ref_y, leaf, tables)
    if not levels:
        return None
    spots = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(_finite("_x", "_y")).distinct()
    px, py = F.col("_x"), F.col("_y")
    gap = lambda p, low, high: F.greatest(low - p, p - high, F.lit(0.0))
    lowest = F.pow(gap(px, F.col("_x0"), F.col("_x1")), 2) + F.pow(gap(py, F.col("_y0"), F.col("_y1")), 2)
    near = lambda p, low, high: F.least(F.abs(p - low), F.abs(p - high))
    far = lambda p, low, high: F.greatest(F.abs(p - low), F.abs(p - high))
    sides = [
        F.pow(near(px, F.col("_x0"), F.col("_x1")), 2) + F.pow(far(py, F.col("_y0"), F.col("_y1")), 2),
        F.pow(far(px, F.col("_x0"), F.col("_x1")), 2) + F.pow(near(py, F.col("_y0"), F.col("_y1")), 2),
    ]
    here = Window.partitionBy("_x", "_y")
    # a rounding error must not drop the box that holds the nearest or its tie
    may = F.col("_low") <= F.col("_bound") * (1 + 1e-9)

    def entered(nodes: DataFrame, level: int) -> DataFrame:
        return nodes.select(
            "_x", "_y", "_old", F.lit(level).alias("_level"), "_kx", "_ky", "_leaf", lowest.alias("_low"), F.least(*sides).alias("_high")
        )

    root = levels[0].withColumn("_root", F.lit(0))
    held = entered(spots.withColumns({"_root": F.lit(0), "_old": F.lit(float("inf"))}).join(F.broadcast(root), "_root"), 0)
    for level in range(len(levels)):
        bounded = held.withColumn("_bound", F.least(F.min("_high").over(here), F.min("_old").over(here)))
        held = tables.store(bounded.where(may).select("_x", "_y", F.col("_bound").alias("_old"), "_level", "_kx", "_ky", "_leaf", "_low", "_high"))
        if level + 1 == len(levels):
            break
        children = levels[level + 1].withColumns({"_ux": F.shiftright("_kx", _BITS), "_uy": F.shiftright("_ky", _BITS)})
        parents = held.where("not _leaf").select("_x", "_y", "_old", F.col("_kx").alias("_ux"), F.col("_ky").alias("_uy"))
        held = held.where("_leaf").unionByName(entered(parents.join(children, ["_ux", "_uy"]), level + 1))
    return held.select("_x", "_y", "_level", "_kx", "_ky").join(places, ["_level", "_kx", "_ky"]).select("_x", "_y", "_rx", "_ry", "_label")


def nearest_reference(
    points: DataFrame,
    references: DataFrame,
    x: str,
    y: str,
    label: str,
    ref_x: str = "ref_x",
    ref_y: str = "ref_y",
    leaf: int = 8,
) -> DataFrame:
    """Each point with the label and plain degree distance of its nearest reference (ties: smallest label).

    Works per distinct location, so a hot location costs one search; see :func:`nearest_candidates`. References sharing a
    place are reduced to one. Points and references without a finite place are left out: such points get nulls, as all
    points do without references.
    """
    met = nearest_candidates(points, references, x, y, label, ref_x, ref_y, leaf)
    if met is None:
        return points.withColumns({label: F.lit(None).cast("string"), "distance": F.lit(None).cast("double")})
    square = F.pow(F.col("_x") - F.col("_rx"), 2) + F.pow(F.col("_y") - F.col("_ry"), 2)
    best = met.groupBy("_x", "_y").agg(F.min(F.struct(square.alias("d2"), F.col("_label").alias("l"))).alias("_b"))
    nearest = best.select("_x", "_y", F.col("_b.l").alias(label), F.sqrt("_b.d2").alias("distance"))
    match = (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))
    return points.join(nearest, match, "left").drop("_x", "_y")


def _distance(px: Column, py: Column, x1: Column, y1: Column, dx: Column, dy: Column, length2: Column) -> Column:
    along = F.when(length2 == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length2))
    )
    ex, ey = px - (x1 + along * dx), py - (y1 + along * dy)
    return F.sqrt(ex * ex + ey * ey)


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Plane distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    return _distance(px, py, x1, y1, dx, dy, dx * dx + dy * dy)


def crossed_cells(lines: DataFrame, radius: float, side: Column) -> DataFrame:
    """Cells (``_cx``, ``_cy``) of width ``side`` that a segment widened by ``radius`` meets, found column by column.

    In a column only the stretch of the line inside it, widened, is entered, so the number of cells grows with the length
    of the segment and not with the area of its box.
    """
    reach = F.lit(float(radius))
    at = lambda v: F.floor(v / F.col("_side")).cast("long")
    dx, dy = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    low, high = F.least("_x1", "_x2") - reach, F.greatest("_x1", "_x2") + reach
    columns = lines.withColumn("_side", side).withColumn("_cx", F.explode(F.sequence(at(low), at(high))))
    # widened by a little more, so that rounding cannot leave a cell out
    slack = reach * 1.000001 + F.col("_side") * 1e-9
    clip = lambda edge: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("_x1")) / dx))
    enter, leave = clip(F.col("_cx") * F.col("_side") - slack), clip((F.col("_cx") + 1) * F.col("_side") + slack)
    first = F.when(dx == 0, F.col("_y1")).otherwise(F.col("_y1") + enter * dy)
    last = F.when(dx == 0, F.col("_y2")).otherwise(F.col("_y1") + leave * dy)
    rows = F.sequence(at(F.least(first, last) - slack), at(F.greatest(first, last) + slack))
    return columns.withColumn("_cy", F.explode(rows))


def points_near_segments(
    points: DataFrame,
    segments: DataFrame,
    point: Mapping[str, str],
    segment: Mapping[str, str],
    radius: float = 0.001,
    cell: float | None = None,
    most_columns: int = 512,
    widths: int = 3,
    factor: int = 16,
    task_pairs: int = 100_000_000,
) -> DataFrame:
    """(segment id, point id, distance) for points closer than ``radius`` to a segment.

    ``point``: id, x, y. ``segment``: id, x1, y1, x2, y2. A segment is entered into the cells that it crosses (see
    :func:`crossed_cells`), a point into its own cell, and pairs meet by an equi-join on the cell. Cells are ``cell`` wide
    (ten radii if not given); segments longer than ``most_columns`` of them go by cells ``factor`` times as wide, up to
    ``widths`` widths, and points are entered once per width in use. Rows without a finite place meet nothing.

    Where points and segments crowd, pairs outnumber rows by far: they are counted per cell first. Cells narrower than
    asked, down to the radius, are taken where that leaves fewer pairs, and cells are dealt out so that a task compares
    about ``task_pairs`` of them; a cell with more is cut by its segments and its points are repeated.
    """
    side = cell or max(radius * 10, 1e-9)
    lines = segments.select(
        F.col(segment["id"]).alias("segment_id"),
        *[F.col(segment[k]).cast("double").alias(f"_{k}") for k in ("x1", "y1", "x2", "y2")],
    ).where(_finite("_x1", "_y1", "_x2", "_y2"))
    span = F.greatest(F.abs(F.col("_x2") - F.col("_x1")), F.abs(F.col("_y2") - F.col("_y1"))) / F.lit(float(side * most_columns))
    width = F.lit(0)
    for k in range(1, widths):
        width = F.when(span > float(factor ** (k - 1)), F.lit(k)).otherwise(width)
    lines = lines.withColumn("_width", width)
    in_use = sorted(r[0] for r in lines.select("_width").distinct().collect())
    dots = points.select(
        F.col(point["id"]).alias("point_id"),
        F.col(point["x"]).cast("double").alias("_px"),
        F.col(point["y"]).cast("double").alias("_py"),
    ).where(_finite("_px", "_py"))

    def entered(width: float) -> tuple[DataFrame, DataFrame]:
        """Points and segments in cells of ``width``, and wider ones for long segments."""
        entries = F.array(
            *[
                F.struct(F.lit(k).alias("_width"), _cell(F.col("_px"), width * factor**k).alias("_cx"), _cell(F.col("_py"), width * factor**k).alias("_cy"))
                for k in in_use or [0]
            ]
        )
        cells = crossed_cells(lines, radius, F.lit(float(width)) * F.pow(F.lit(float(factor)), F.col("_width")))
        return dots.withColumn("_e", F.explode(entries)).select("point_id", "_px", "_py", "_e.*"), cells

    def counted(inside: DataFrame, cells: DataFrame) -> DataFrame:
        """Points and segments of each cell that has both."""
        mine, theirs = (f.groupBy(*place).agg(F.count(F.lit(1)).cast("double").alias(n)) for f, n in ((inside, "_p"), (cells, "_s")))
        return mine.join(theirs, place)

    place, tables = ["_width", "_cx", "_cy"], RoundTables(points.sparkSession)
    inside, cells = entered(side)
    product = F.col("_p") * F.col("_s")
    total = [F.coalesce(F.sum(product), F.lit(0.0)), F.coalesce(F.max(product), F.lit(0.0))]
    counts = tables.store(counted(inside, cells))
    pairs, most = counts.agg(*total).first()
    if pairs > task_pairs and side >= 2 * radius > 0:
        fine = entered(max(radius, side / factor))
        fewer = tables.store(counted(*fine))
        left = fewer.agg(*total).first()
        if left[0] < pairs:
            (inside, cells), counts, (pairs, most) = fine, fewer, left
    if most > task_pairs:
        # each of these cells has ``task_pairs`` of all pairs at least, so the list is short
        large = F.broadcast(counts.where(product > task_pairs).select(*place, F.ceil(product / task_pairs).cast("int").alias("_cuts")))
        cuts = F.coalesce("_cuts", F.lit(1))
        inside = inside.join(large, place, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("_cuts")
        cells = cells.join(large, place, "left").withColumn("_cut", F.pmod(F.xxhash64("segment_id", "_x1", "_y1", "_x2", "_y2"), cuts).cast("int")).drop("_cuts")
        place = [*place, "_cut"]
    if pairs > task_pairs:
        # a join that makes many rows out of few: its tasks follow the pairs and not the bytes
        parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, int(pairs // task_pairs) * 4))
        inside, cells = inside.repartition(parts, *place), cells.repartition(parts, *place)
    # what a pair needs of its segment is made once a segment and cell
    reach = F.lit(float(radius))
    dx, dy = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    cells = cells.select(
        *place, "segment_id", F.col("_x1"), F.col("_y1"), dx.alias("_dx"), dy.alias("_dy"), (dx * dx + dy * dy).alias("_l2"),
        (F.least("_x1", "_x2") - reach).alias("_left"), (F.greatest("_x1", "_x2") + reach).alias("_right"),
        (F.least("_y1", "_y2") - reach).alias("_low"), (F.greatest("_y1", "_y2") + reach).alias("_high"),
    )
    met = inside.join(cells, place).where("_px >= _left and _px <= _right and _py >= _low and _py <= _high")
    away = _distance(F.col("_px"), F.col("_py"), F.col("_x1"), F.col("_y1"), F.col("_dx"), F.col("_dy"), F.col("_l2"))
    return met.select("segment_id", "point_id", away.alias("distance")).where(F.col("distance") < radius)


def directed_edges(segments: DataFrame, start: str, end: str, order: str, code: str) -> DataFrame:
    """Edge rows pointing along the flow: order 1 keeps the drawn direction, any other reverses it."""
    along = F.coalesce(F.col(order) == 1, F.lit(False))
    return segments.select(
        F.when(along, F.col(start)).otherwise(F.col(end)).alias("src"),
        F.when(along, F.col(end)).otherwise(F.col(start)).alias("dst"),
        F.col(code).alias("code"),
    )


def _chased(pointers: DataFrame, tables: RoundTables) -> DataFrame:
    """(node, to) at the end of each chain of pointers, by jumps that double in length; nodes on a closed ring are left out."""
    members = pointers.select(F.col("node").alias("to"), F.lit(True).alias("open"))
    held = tables.store(pointers.join(members, "to", "left").select("node", "to", F.coalesce("open", F.lit(False)).alias("open")))
    jumps = max(held.count(), 1).bit_length() + 1
    for _ in range(jumps):
        # only pointers to a node of a chain are joined, and no two nodes of a chain point to the same one
        going = held.where("open")
        if going.isEmpty():
            break
        ahead = held.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("open").alias("_open"))
        moved = going.join(ahead, "to").select("node", F.col("_to").alias("to"), F.col("_open").alias("open"))
        before, held = held, tables.store(held.where("not open").unionByName(moved))
        tables.drop(before)
    return held.where("not open").select("node", "to")


def contracted(edges: DataFrame, keep: DataFrame, tables: RoundTables) -> tuple[DataFrame, DataFrame]:
    """Edges between junctions, and (junction, node) for the nodes of the chains that leave it.

    ``edges``: distinct ``src``, ``dst``; ``keep``: ``node``s that stay junctions. All other nodes with one edge in and one
    edge out belong to a chain: they are reached exactly when the junction before the chain is.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    inner = tables.store(degrees.where("out = 1 and into = 1").join(keep.select("node").distinct(), "node", "left_anti").select("node"))
    before = _chased(edges.select(F.col("dst").alias("node"), F.col("src").alias("to")).join(inner, "node"), tables)
    after = _chased(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).join(inner, "node"), tables)
    chains = tables.store(before.withColumnRenamed("to", "junction").join(after.withColumnRenamed("to", "dst"), "node"))
    plain = edges.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti")
    short = plain.select("src", "dst").unionByName(chains.select(F.col("junction").alias("src"), "dst"))
    return tables.store(short.where("src <> dst").distinct()), chains.select("junction", "node")


def downstream(edges: DataFrame, sources: DataFrame, source: str = "source", rounds: int = 64) -> DataFrame:
    """(source, node) for every node reachable from each source, the source itself included.

    Chains are contracted first. Then round i joins what is reached so far with the pairs of junctions 2**i edges apart and
    joins these pairs with themselves, so the number of rounds is the logarithm of the greatest distance. A round that
    reaches nothing new ends the search: a node farther away would have one at exactly that distance before it. A pair of a
    junction with itself lies on no shortest way and is dropped, so rings end too.
    """
    tables = RoundTables(edges.sparkSession)
    hops = tables.store(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    reached = tables.store(sources.select(F.col(source).alias("source"), F.col(source).alias("node")).where("node is not null").distinct())
    step, inside = contracted(hops, reached, tables)
    for _ in range(rounds):
        ahead = reached.join(step.withColumnRenamed("src", "node"), "node").select("source", F.col("dst").alias("node")).distinct()
        new = tables.store(ahead.join(reached, ["source", "node"], "left_anti"))
        if new.isEmpty():
            chained = reached.join(inside.withColumnRenamed("node", "_inner"), F.col("node") == F.col("junction"))
            return reached.unionByName(chained.select("source", F.col("_inner").alias("node")))
        known, reached = reached, tables.store(reached.unionByName(new))
        longer = step.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("_end")), "dst").select("src", F.col("_end").alias("dst"))
        used, step = step, tables.store(longer.where("src <> dst").distinct())
        tables.drop(known, new, used)
    raise RuntimeError(f"reachability did not finish in {rounds} rounds")


def downstream_segments(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, code) of the edges with both endpoints among the nodes reached from the source."""
    first = edges.select("src", "dst", "code").join(
        reached.select("source", F.col("node").alias("src")), "src"
    )
    last = reached.select("source", F.col("node").alias("dst"))
    return first.join(last, ["source", "dst"], "left_semi").select("source", "code").distinct()
