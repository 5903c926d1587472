"""Exact k-th smallest value, distributed, with bounded driver state.

Spark's exact ``percentile`` keeps a value->count map per group and merges it
in one task, so on a global column it funnels every distinct value through a
single task.  ``select_kth`` instead narrows a bracket per target by repeated
bucket counting.  Values are compared by an order-preserving 64-bit integer
(the bit pattern of a double, an integer itself, seven bytes of a string), so a
bracket is a range of integers: every pass divides it by ``BUCKETS``, whatever
the values, infinite ones included, and six passes resolve any column.

A pass is one scan and one aggregate of at most ``BUCKETS`` rows per target;
the bucket that holds the target's rank is chosen inside Spark, so the driver
gets one row per target and pass.

Unweighted values need two scans only: a mergeable quantile sketch of all groups
gives every target a narrow bracket, and one aggregate counts the values inside
the brackets one by one and those between them as a whole.  Should a sketch miss,
its targets are narrowed as above, so the result is exact in any case.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BUCKETS = 2048
_TOP = 1 << 63
#: Sketch: quantiles read per group, and its accuracy (rank error at most n / ACCURACY).
GRID, ACCURACY = 1000, 10_000
#: Most counted values that the last step reads on the driver; more are narrowed in Spark.
COUNTED = 200_000


@dataclass
class _Target:
    tid: int
    gid: int
    k: float          # 0-based rank within the group (weighted)
    lo: int = 0
    hi: int = 0
    below: float = 0.0  # weight of the group's keys < lo
    found: bool = False

    @property
    def open(self) -> bool:
        return self.found and self.lo < self.hi


def double_key(v: Column) -> Column:
    """Order-preserving long of a double (both zeros alike)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.when(v == 0, F.lit(0.0)).otherwise(v)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_TOP - 1))).otherwise(bits)


def key_double(key: int) -> float:
    return struct.unpack("<d", struct.pack("<q", key ^ (_TOP - 1) if key < 0 else key))[0]


def select_kth(data: DataFrame, targets: list[tuple[int, int]], *, gid: str = "gid", value: str = "v",
               weight: str | None = None) -> dict[tuple[int, int], float | None]:
    """Exact k-th smallest ``value`` per group for each ``(group id, k)``.

    ``data`` has an integer group column ``gid``, a numeric ``value`` column
    (nulls and NaN ignored) and optionally a non-negative ``weight`` (default 1).
    Returns ``{(gid, k): value}``; ``None`` when the group has < k+1 weight.
    """
    v = F.col(value).cast("double")
    data = data.filter(v.isNotNull() & ~F.isnan(v))
    if weight is None:
        base = data.select(F.col(gid).cast("long").alias("_g"), v.alias("_v")).filter(F.col("_g").isin(sorted({g for g, _ in targets})))
        base = base.persist(StorageLevel.MEMORY_AND_DISK)  # scanned twice
        try:
            return _by_brackets(base, targets)
        finally:
            base.unpersist()
    keyed = data.select(F.col(gid).alias("_g"), double_key(v).alias("_k"), F.col(weight).alias("_w"))
    got = select_keys(keyed, targets)
    return {t: None if k is None else key_double(k) for t, k in got.items()}


def _grid_brackets(sketch: dict, targets) -> dict[int, list[tuple[float, float]]]:
    """{group: disjoint intervals of values} that hold the targets if the sketch keeps its promise."""
    wide: dict[int, list] = {}
    for g, k in targets:
        n, grid = sketch.get(g, (0, None))
        if 0 <= k < n:
            lo, hi = int((k / n - 2 / ACCURACY) * GRID) - 1, int((k / n + 2 / ACCURACY) * GRID) + 2
            wide.setdefault(g, []).append((grid[lo] if lo >= 0 else float("-inf"), grid[hi] if hi <= GRID else float("inf")))
    out: dict[int, list[tuple[float, float]]] = {}
    for g, spans in wide.items():
        for lo, hi in sorted(spans):
            mine = out.setdefault(g, [])
            if mine and lo <= mine[-1][1]:
                mine[-1] = mine[-1][0], max(mine[-1][1], hi)
            else:
                mine.append((lo, hi))
    return out


def _by_brackets(base: DataFrame, targets) -> dict[tuple[int, int], float | None]:
    shares = [i / GRID for i in range(GRID + 1)]
    sketch = {r["_g"]: (r["n"], r["q"]) for r in base.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", shares, ACCURACY).alias("q")).collect()}
    spans = _grid_brackets(sketch, targets)
    out: dict[tuple[int, int], float | None] = {t: None for t in targets}
    if not spans:
        return out
    frame = base.sparkSession.createDataFrame(  # one row per group
        [(g, [float(a) for a, _ in s], [float(b) for _, b in s]) for g, s in spans.items()], "_g long, _lo array<double>, _hi array<double>")
    below = F.size(F.filter("_hi", lambda x: x < F.col("_v")))
    zone = F.size(F.filter("_lo", lambda x: x <= F.col("_v"))) + below  # odd inside a bracket, even between two
    zoned = base.join(F.broadcast(frame), "_g").select("_g", zone.alias("_z"), "_v")
    counts = zoned.groupBy("_g", "_z", F.when(F.col("_z") % 2 == 1, F.col("_v")).alias("_in")).agg(
        F.count(F.lit(1)).alias("c"), F.max("_v").alias("top")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = counts.limit(COUNTED + 1).collect()
        if len(rows) > COUNTED:
            weighted = counts.select("_g", double_key(F.coalesce("_in", "top")).alias("_k"), F.col("c").cast("double").alias("_w"))
            got = select_keys(weighted, targets)
            inside = {t: None if k is None else key_double(k) for t, k in got.items()}
            inside = {t: v for t, v in inside.items() if v is None or any(a <= v <= b for a, b in spans[t[0]])}
        else:
            inside = _at_ranks(rows, targets)
    finally:
        counts.unpersist()
    missed = [t for t in targets if t not in inside and 0 <= t[1] < sketch.get(t[0], (0,))[0]]
    out |= inside
    if missed:
        got = select_keys(base.select("_g", double_key(F.col("_v")).alias("_k"), F.lit(1.0).alias("_w")), missed)
        out |= {t: None if k is None else key_double(k) for t, k in got.items()}
    return out


def _at_ranks(rows, targets) -> dict[tuple[int, int], float]:
    """Values at the targets' ranks; a rank that falls between the brackets is left out."""
    by_group: dict[int, list] = {}
    for r in rows:
        by_group.setdefault(r["_g"], []).append((r["_z"], r["_in"] if r["_in"] is not None else float("-inf"), r["_in"], r["c"]))
    found = {}
    for g, ordered in by_group.items():
        wanted, upto, at = sorted(k for gid, k in targets if gid == g), 0, 0
        for _, _, value, c in sorted(ordered, key=lambda x: x[:2]):
            upto += c
            while at < len(wanted) and wanted[at] < upto:
                if value is not None:
                    found[(g, wanted[at])] = value
                at += 1
    return found


def select_keys(data: DataFrame, targets: list[tuple[int, int]]) -> dict[tuple[int, int], int | None]:
    """The k-th smallest long ``_k`` (weights ``_w``) of group ``_g`` for each ``(group, k)``."""
    gids = sorted({g for g, _ in targets})
    base = data.select(F.col("_g").cast("long").alias("_g"), F.col("_k").cast("long").alias("_k"),
                       F.col("_w").cast("double").alias("_w"))
    # Every pass scans the same narrow rows: materialise them once so that the
    # passes never recompute the caller's upstream plan.
    base = base.filter(F.col("_g").isin(gids) & F.col("_k").isNotNull() & (F.col("_w") > 0)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _narrow(base, targets)
    finally:
        base.unpersist()


_FRAME = T.StructType([T.StructField(n, t) for n, t in (
    ("_tid", T.LongType()), ("_tg", T.LongType()), ("_lo", T.LongType()), ("_hi", T.LongType()), ("_width", T.LongType()),
    ("_wide", T.BooleanType()), ("_rank", T.DoubleType()))])


def _narrow(base: DataFrame, targets) -> dict[tuple[int, int], int | None]:
    stats = {r["_g"]: r for r in base.groupBy("_g").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"),
                                                         F.sum("_w").alias("n")).collect()}
    ts = []
    for i, (g, k) in enumerate(targets):
        s = stats.get(g)
        ts.append(_Target(i, g, k, s["lo"], s["hi"], found=True) if s is not None and 0 <= k < s["n"] else _Target(i, g, k))
    while active := [t for t in ts if t.open]:
        # Small, proven-size frame: one row per open target.
        frame = base.sparkSession.createDataFrame(
            [(t.tid, t.gid, t.lo, t.hi, -(-(t.hi - t.lo + 1) // BUCKETS), t.hi - t.lo >= _TOP, float(t.k - t.below)) for t in active],
            _FRAME)
        hit = base.join(F.broadcast(frame), (F.col("_g") == F.col("_tg")) & F.col("_k").between(F.col("_lo"), F.col("_hi")))
        # A range wider than a long is cut by its top bits instead of its distance from the lower end.
        bucket = F.when(F.col("_wide"), F.shiftright("_k", 53)).otherwise(F.expr("(_k - _lo) div _width"))
        counts = (hit.groupBy("_tid", "_rank", bucket.alias("_b"))
                  .agg(F.sum("_w").alias("c"), F.min("_k").alias("lo"), F.max("_k").alias("hi")))
        upto = F.sum("c").over(Window.partitionBy("_tid").orderBy("_b"))  # at most BUCKETS rows per target
        chosen = counts.withColumn("upto", upto).filter("upto > _rank AND upto - c <= _rank")
        for r in chosen.select("_tid", "lo", "hi", (F.col("upto") - F.col("c")).alias("before")).collect():
            t = ts[r["_tid"]]
            t.lo, t.hi, t.below = r["lo"], r["hi"], t.below + r["before"]
    return {(t.gid, t.k): t.lo if t.found else None for t in ts}


_BYTES = 7  # a string's bytes by sevens are non-negative longs


def select_kth_any(data: DataFrame, targets: list[tuple[int, int]], *, gid: str = "gid", value: str = "v") -> dict[tuple[int, int], object]:
    """``select_kth`` for any orderable column; values come back in the column's own type.

    Integers, dates and timestamps compare as longs, floating values by their bits, strings by
    their bytes, seven at a time, each round among the rows tied so far.
    """
    kind = data.schema[value].dataType
    v = F.col(value)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return select_kth(data, targets, gid=gid, value=value)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return select_keys(data.select(F.col(gid).alias("_g"), v.cast("long").alias("_k"), F.lit(1.0).alias("_w")), targets)
    if not isinstance(kind, T.StringType):
        raise TypeError(f"no selection order for {kind.simpleString()}")
    # One row per target and tied value; a target keeps the rank that is left among its ties.
    open_ = data.select(F.col(gid).cast("long").alias("_g"), v.alias("_s")).filter(F.col("_s").isNotNull())
    ranks = {t: (t[0], t[1], b"") for t in targets}
    out: dict[tuple[int, int], object] = {}
    at = 1
    while ranks:
        rows, wanted = None, []
        for number, (t, (g, k, prefix)) in enumerate(ranks.items()):
            part = open_.filter((F.col("_g") == g) & (F.substring(F.col("_s").cast("binary"), 1, at - 1) == F.lit(bytearray(prefix))))
            part = part.select(F.lit(number).alias("_g"), "_s")
            rows = part if rows is None else rows.unionByName(part)
            wanted.append((number, k))
        piece = F.substring(F.col("_s").cast("binary"), at, _BYTES)
        padded = F.rpad(F.hex(piece), 2 * _BYTES, "0")
        keyed = rows.select("_g", F.conv(padded, 16, 10).cast("long").alias("_k"), F.octet_length("_s").alias("_n"), F.lit(1.0).alias("_w")).persist()
        try:
            found = select_keys(keyed, wanted)
            keys = {n: found[(n, k)] for n, k in wanted}
            conds = F.create_map(*[x for n, key in keys.items() if key is not None for x in (F.lit(n), F.lit(key))]) if any(
                key is not None for key in keys.values()) else None
            below = {} if conds is None else {r["_g"]: (r["b"], r["longest"]) for r in keyed.groupBy("_g").agg(
                F.count_if(F.col("_k") < conds[F.col("_g")]).alias("b"),
                F.max(F.when(F.col("_k") == conds[F.col("_g")], F.col("_n"))).alias("longest")).collect()}
        finally:
            keyed.unpersist()
        left = {}
        for number, (t, (g, k, prefix)) in enumerate(list(ranks.items())):
            if keys[number] is None:
                out[t] = None
                continue
            whole = prefix + keys[number].to_bytes(_BYTES, "big")
            before, longest = below[number]
            if longest <= at + _BYTES - 1:
                out[t] = whole.rstrip(b"\0").decode()
            else:
                left[t] = (g, k - before, whole)
        ranks, at = left, at + _BYTES
    return out


def approx_quantiles(data: DataFrame, gid: str, value: str, probs: list[float],
                     accuracy: int = 10_000) -> dict[tuple[int, float], float | None]:
    """One-pass ``percentile_approx`` per group (the ``exact=False`` path).

    Rank error is at most n / accuracy; values are actual data points, not
    interpolated.
    """
    rows = (data.groupBy(F.col(gid).alias("_g"))
                .agg(F.percentile_approx(F.col(value).cast("double"), probs, accuracy).alias("q")).collect())
    out = {}
    for r in rows:
        for p, q in zip(probs, r["q"] or [None] * len(probs)):
            out[(r["_g"], p)] = q
    return out


def quantiles(data: DataFrame, gid: str, value: str, counts: dict[int, int],
              probs: list[float], extra: list[tuple[int, int]] | None = None, exact: bool = True):
    """Linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``).

    ``counts`` is the non-null count per group (already known by the caller's
    one-pass aggregate).  Two order statistics per probability.  ``extra``
    (group, k) order statistics are resolved in the same passes; when given,
    the result is ``(quantiles, {(group, k): value})``.  ``exact=False``
    answers the probabilities with one ``percentile_approx`` pass instead
    (extra order statistics are still exact).
    """
    if not exact:
        approx = approx_quantiles(data, gid, value, probs)
        out = {(g, p): approx.get((g, p)) for g in counts for p in probs}
        if extra is not None:
            return out, select_kth(data, sorted(set(extra)), gid=gid, value=value) if extra else {}
        return out
    want: list[tuple[int, int]] = []
    for g, n in counts.items():
        if not n:
            continue
        for p in probs:
            h = (n - 1) * p
            lo = int(h // 1)
            want.append((g, lo))
            if lo + 1 < n:
                want.append((g, lo + 1))
    got = select_kth(data, sorted(set(want) | set(extra or [])), gid=gid, value=value)
    out = {}
    for g, n in counts.items():
        for p in probs:
            if not n:
                out[(g, p)] = None
                continue
            h = (n - 1) * p
            lo = int(h // 1)
            a = got[(g, lo)]
            frac = h - lo
            if frac == 0 or lo + 1 >= n:
                out[(g, p)] = a
            else:
                b = got[(g, lo + 1)]
                out[(g, p)] = a + (b - a) * frac
    if extra is not None:
        return out, {k: got[k] for k in extra}
    return out
