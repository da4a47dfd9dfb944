"""Range, band, priority and key-checked joins as DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _levels(intervals: DataFrame, start: str, end: str, width: int) -> list[int]:
    """Bin widths, each eight times the one before, up to the longest interval (one row to the driver)."""
    longest = intervals.agg(F.max(F.col(end) - F.col(start))).first()[0] or 0
    out = [width]
    while out[-1] < longest and len(out) < 12:
        out.append(out[-1] * 8)
    return out


def range_join(points: DataFrame, intervals: DataFrame, on: list[str], pos: str, start: str, end: str, width: int = 1024, how: str = "inner", half_open: bool = False) -> DataFrame:
    """Points with the intervals that hold them: ``start <= pos <= end`` (``< end`` if half-open).

    An equi-join on bins with the range as residual. An interval goes to the level whose bins are
    at least as wide as it is long, so it covers two bins at most however long it is; a point looks
    into one bin of each level. No pair appears twice. ``how`` is ``inner`` or ``left_semi``. Rows
    with a null key, position or bound match nothing; intervals with ``end < start`` hold nothing.
    Key columns come from the points.
    """
    levels = _levels(intervals, start, end, width)
    size = F.col(end) - F.col(start)
    level = F.lit(levels[-1])
    for w in reversed(levels[:-1]):
        level = F.when(size <= w, F.lit(w)).otherwise(level)
    iv = intervals.where(F.col(end) >= F.col(start)).withColumn("_w", level.cast("long"))
    iv = iv.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("_w")), F.floor(F.col(end) / F.col("_w")))))
    iv = iv.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], *[c for c in iv.columns if c not in on])
    pt = points.withColumn("_pw", F.explode(F.array(*[F.lit(w).cast("long") for w in levels]))) if len(levels) > 1 else points.withColumn("_pw", F.lit(levels[0]).cast("long"))
    pt = pt.withColumn("_pbin", F.floor(F.col(pos) / F.col("_pw")))
    cond = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(on)] + [F.col("_pw") == F.col("_w"), F.col("_pbin") == F.col("_bin"), F.col(pos) >= F.col(start)]
    cond.append(F.col(pos) < F.col(end) if half_open else F.col(pos) <= F.col(end))
    on_all = reduce(lambda a, b: a & b, cond)
    if how == "left_semi":
        return _semi(points, iv, levels, pos, cond, on)
    return pt.join(iv, on_all, "inner").drop("_pw", "_pbin", "_w", "_bin", *[f"_k{i}" for i in range(len(on))])


def range_max(points: DataFrame, intervals: DataFrame, on: list[str], pos: str, start: str, end: str, by: list[str], value: str, each: Column | None = None, width: int = 1024, whole: bool = False, size: tuple[int, int] | None = None) -> DataFrame:
    """Points with the largest ``value`` of each group ``by`` of the intervals that hold them (closed, of whole numbers): one row for each row of ``points`` and group.

    Intervals are cut at the edges of bins and, within a bin and group, into stretches that do not overlap, each with its
    largest value. So no pair comes twice, and only intervals and points are shuffled, not the pairs. ``each`` is an array
    of structs of ``by`` and ``value`` that stands for an interval's own; it is made after the shuffle. ``whole`` gives the array
    of all distinct values instead of the largest. ``size`` is the number of intervals and the sum of their lengths, if known.
    """
    iv = intervals.where(F.col(end) >= F.col(start))
    n, length = size if size is not None else iv.agg(F.count(F.lit(1)), F.sum(F.col(end) - F.col(start) + 1)).first()
    w = max(width, -(-int(length) // n)) if n else width  # at most two pieces an interval, on average
    iv = iv.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], *by, F.col(value).alias("_v"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    iv = iv.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / F.lit(w)), F.floor(F.col("_e") / F.lit(w)))))
    keys = [f"_k{i}" for i in range(len(on))] + ["_bin"]
    iv = iv.repartition(*keys)
    if each is not None:
        iv = iv.withColumnRenamed("_v", value).select(*keys, "_s", "_e", F.explode(each).alias("_g")).select(*keys, "_s", "_e", *[F.col(f"_g.{c}").alias(c) for c in by], F.col(f"_g.{value}").alias("_v"))
    piece = F.struct(F.greatest("_s", F.col("_bin") * w).alias("lo"), F.least("_e", F.col("_bin") * w + (w - 1)).alias("hi"), F.col("_v").alias("v"))
    g = iv.groupBy(*keys, *by).agg(F.collect_list(piece).alias("_p"))
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform("_p", lambda x: F.array(x["lo"], x["hi"] + 1)))))
    g = g.withColumn("_c", F.when(F.size("_p") > 1, edges))
    held = lambda at: F.filter("_p", lambda x: (x["lo"] <= at) & (x["hi"] >= at))
    cut = F.transform(F.sequence(F.lit(0), F.size("_c") - 2), lambda i: F.struct(F.get("_c", i).alias("lo"), (F.get("_c", i + 1) - 1).alias("hi"), (F.array_distinct if whole else F.array_max)(F.transform(held(F.get("_c", i)), lambda x: x["v"])).alias("v"), (F.size(held(F.get("_c", i))) > 0).alias("on")))
    one = F.transform("_p", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), (F.array(x["v"]) if whole else x["v"]).alias("v"), F.lit(True).alias("on")))
    g = g.select(*keys, *by, F.explode(F.when(F.col("_c").isNull(), one).otherwise(cut)).alias("_x")).where("_x.on")
    pt = points.withColumn("_pbin", F.floor(F.col(pos) / F.lit(w)))
    cond = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(on)] + [F.col("_pbin") == F.col("_bin"), F.col(pos) >= F.col("_x.lo"), F.col(pos) <= F.col("_x.hi")]
    return pt.join(g, reduce(lambda a, b: a & b, cond)).select(*points.columns, *by, F.col("_x.v").alias(value))


def _semi(points: DataFrame, iv: DataFrame, levels: list[int], pos: str, cond: list[Column], on: list[str]) -> DataFrame:
    """Points with an interval at some level, level by level: what one level finds does not go on to the next, so a row is kept once, and copies stay copies."""
    out, rest = None, points
    for k, w in enumerate(levels):
        at = rest.withColumn("_pw", F.lit(w).cast("long")).withColumn("_pbin", F.floor(F.col(pos) / F.lit(w)))
        here, on_all = iv.where(F.col("_w") == w), reduce(lambda a, b: a & b, cond)
        hit = at.join(here, on_all, "left_semi").drop("_pw", "_pbin")
        out = hit if out is None else out.union(hit)
        if k + 1 < len(levels):
            rest = at.join(here, on_all, "left_anti").drop("_pw", "_pbin")
    return out


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_pos: str, right_pos: str, window: int) -> DataFrame:
    """Pairs no further apart than ``window`` (closed): bins as wide as the window, the right side in three of them."""
    a = left.withColumn("_bin", F.floor(F.col(left_pos) / F.lit(window)))
    b = F.floor(F.col(right_pos) / F.lit(window))
    r = right.withColumn("_rbin", F.explode(F.array(b - 1, b, b + 1)))
    r = r.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], *[c for c in r.columns if c not in on])
    cond = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(on)] + [F.col("_bin") == F.col("_rbin"), F.abs(F.col(left_pos) - F.col(right_pos)) <= window]
    return a.join(r, reduce(lambda x, y: x & y, cond)).drop("_bin", "_rbin", *[f"_k{i}" for i in range(len(on))])


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order: as a minimum of structs, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    tagged = df.select(*key, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest]).alias("_s"))
    best = tagged.groupBy(*key).agg(F.min("_s").alias("_s"))
    return best.select(*[F.col(c) if c in key else F.col(f"_s.{c}").alias(c) for c in df.columns])


def unique_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key no other row has; all rows of a repeated key are dropped."""
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    return g.where("_n = 1").select(*df.columns)


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` itself; fails when a key repeats."""
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated key {key}")
    return df


def align_global(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], order: list[Column]) -> tuple[DataFrame, str]:
    """Join on the first pair of keys that gives any row at all; right rows are kept first per key by ``order``.

    Returns the join and the key that was used. Fails if no key gives a row.
    """
    for lk, rk in keys:
        r = first_per(right.where(F.col(rk).isNotNull()), [rk], order)
        r = r.withColumnRenamed(rk, "_rk") if rk != "_rk" else r
        joined = left.join(r, F.col(lk) == F.col("_rk")).drop("_rk")
        if not joined.isEmpty():
            return joined, lk
    raise ValueError("no key aligns the two tables")


def align_row(left: DataFrame, lookup: DataFrame, keys: list[tuple[str, str]], value: str, order: list[Column]) -> DataFrame:
    """``left`` with ``value`` looked up by the first key that has it, row by row; of repeated keys the last by ``order`` counts."""
    out, got = left, []
    for i, (lk, rk) in enumerate(keys):
        last = lookup.where(F.col(rk).isNotNull()).groupBy(F.col(rk).alias(f"_k{i}")).agg(F.max_by(value, F.struct(*order)).alias(f"_v{i}"))
        out = out.join(last, F.col(lk) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        got.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*got)).drop(*[f"_v{i}" for i in range(len(keys))])


def left_fill(left: DataFrame, right: DataFrame, on: list[str], fill: dict[str, float]) -> DataFrame:
    """Every left row with the right row of its (unique) key, or the fill values."""
    return left.join(right, on, "left").na.fill(fill)


def antijoin_identity(edges: DataFrame, ids: DataFrame, row: str = "row_idx", col: str = "col_idx", value: str = "r2") -> DataFrame:
    """Edges and an edge of value 1 from every identifier without a diagonal to itself."""
    diag = edges.where(F.col(row) == F.col(col)).select(F.col(row).alias("_d"))
    lone = ids.join(diag, F.col(ids.columns[0]) == F.col("_d"), "left_anti").select(F.col(ids.columns[0]).alias(row))
    return edges.select(row, col, value).unionByName(lone.select(row, F.col(row).alias(col), F.lit(1.0).alias(value)))
