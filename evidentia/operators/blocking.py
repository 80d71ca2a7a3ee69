"""Candidate pairs: blocking self-join, forced and forbidden pairs, and the cap per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import ErConfig
from evidentia.functions.text import alias_norm, folded

#: What finding pairs needs of either side, and what is joined to the pairs that are left.
CARRIED = ("ord", "obs_id", "entity_norm", "role", "modality", "location", "time_offset_sec")
JOINED = ("entity", "content", "confidence")


def _side(obs: DataFrame, side: str) -> DataFrame:
    return obs.select("case_id", *(F.col(c).alias(f"{c}_{side}") for c in CARRIED))


def gap() -> Column:
    return F.abs(F.col("time_offset_sec_a") - F.col("time_offset_sec_b"))


def same_place() -> Column:
    a, b = folded(F.col("location_a")), folded(F.col("location_b"))
    return (a != "") & (a == b)


def same_role() -> Column:
    return folded(F.col("role_a")) == folded(F.col("role_b"))


def cross_modal() -> Column:
    return F.lower("modality_a") != F.lower("modality_b")


def blocked_in(cfg: ErConfig) -> Column:
    return same_place() | (gap() <= cfg.temporal_window_sec) | (cross_modal() & same_role() & (gap() <= cfg.max_temporal_gap_sec))


def named(pairs: DataFrame) -> DataFrame:
    """obs_id_1 <= obs_id_2 by string order, the pair's name."""
    return pairs.withColumn("obs_id_1", F.least("obs_id_a", "obs_id_b")).withColumn("obs_id_2", F.greatest("obs_id_a", "obs_id_b"))


def pairs_by_join(obs: DataFrame, cfg: ErConfig) -> DataFrame:
    """All blocked-in pairs of each case by one self-join on case_id; a, the first by place in the case."""
    return named(_side(obs, "a").join(_side(obs, "b"), "case_id").where((F.col("ord_a") < F.col("ord_b")) & blocked_in(cfg)))


def pairs_by_buckets(obs: DataFrame, cfg: ErConfig) -> DataFrame:
    """The same pairs as pairs_by_join, for cases of many observations: each alternative is an equi-join.

    Same place joins on the place; the two time bands join on time buckets as wide as the band, one side in its own bucket and
    its neighbours; the wider band on the role too. Each branch leaves out what an earlier one finds, so no pair comes twice and
    none needs to be made distinct.
    """
    a, b = _side(obs, "a"), _side(obs, "b")
    w, g = max(1, cfg.temporal_window_sec), max(1, cfg.max_temporal_gap_sec)
    first = F.col("ord_a") < F.col("ord_b")
    place = lambda s: folded(F.col(f"location_{s}"))
    by_place = a.withColumn("_k", place("a")).where("_k != ''").join(b.withColumn("_k", place("b")), ["case_id", "_k"]).where(first).drop("_k")

    def band(width: int, *keys: tuple[str, Column, Column]) -> DataFrame:
        left, right = a, b
        for name, x, y in keys:
            left, right = left.withColumn(name, x), right.withColumn(name, y)
        t = F.floor(F.col("time_offset_sec_a") / width)
        left = left.withColumn("_t", F.explode(F.array(t - 1, t, t + 1)))
        right = right.withColumn("_t", F.floor(F.col("time_offset_sec_b") / width))
        names = [k for k, _, _ in keys]
        return left.join(right, ["case_id", "_t", *names]).where(first & (gap() <= width)).drop("_t", *names)

    near = band(w).where(~same_place() & (gap() <= cfg.temporal_window_sec))
    wide = band(g, ("_r", folded(F.col("role_a")), folded(F.col("role_b")))).where(~same_place() & (gap() > cfg.temporal_window_sec) & cross_modal())
    return named(by_place.unionByName(near).unionByName(wide))


#: Seconds of a case's time that one task sums up in pair_totals().
SPAN = 86_400


def pair_totals(obs: DataFrame, cfg: ErConfig) -> DataFrame:
    """(case_id, n_pairs, total_gap) of the pairs of pairs_by_join, for each case that has any: exact, and no pair is made.

    A pair is blocked in by place, by time, or by time, role and modality; by inclusion and exclusion the totals are sums over six
    sets of keys that both sides share, of pairs within (or beyond) a gap. Those follow from running counts and sums of times along a
    key's time: a row meets what lies before it, less what lies before its band. Observations of equal keys and time are one row with
    a count, and running sums start anew each SPAN, from the spans' own sums; so work grows with the rows, whatever the pairs.
    Pairs of equal ord, which no self-join on ord_a < ord_b makes, are taken off in the same way.
    """
    w, g = cfg.temporal_window_sec, cfg.max_temporal_gap_sec
    near, wide = ([w] if w >= 0 else []), g > w and g >= 0
    # keys both sides share: (by place, role, modality), the sign of all pairs, the signs of those farther apart than each gap
    sets: list[tuple[str, int, dict[int, int]]] = [("", len(near), {h: -1 for h in near}), ("p", 1 - len(near), {h: 1 for h in near})]
    for keys, sign in (("r", 1), ("rm", -1), ("pr", -1), ("prm", 1)) if wide else ():
        sets.append((keys, sign * (1 - len(near)), {h: sign for h in near} | {g: -sign}))
    place, role, modality = folded(F.col("location")), folded(F.col("role")), F.lower("modality")
    rows = obs.where("case_id is not null and ord is not null").select("case_id", "ord", place.alias("p"), role.alias("r"), modality.alias("m"), F.col("time_offset_sec").alias("t"))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("case_id", "ord")))
    rows = rows.withColumn("tie", F.explode(F.when(F.col("_n") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    rows = rows.withColumn("at", F.when(F.col("tie"), F.col("ord")).otherwise(F.lit(0)))
    alike = rows.groupBy("case_id", "tie", "at", "p", "r", "m", "t").agg(F.count("*").alias("n"))

    def keyed(i: int, keys: str) -> Column:
        own = F.struct(F.lit(i).alias("k"), *((F.col(c) if c in keys else F.lit("")).alias(c) for c in "prm"))
        return F.when(F.col("p") != "", own) if "p" in keys else own

    by = ["case_id", "tie", "at", "k", "p", "r", "m"]
    some = alike.select("case_id", "tie", "at", "t", "n", F.explode(F.array(*(keyed(i, keys) for i, (keys, _, _) in enumerate(sets)))).alias("_s")).where("_s is not null")
    some = some.select("case_id", "tie", "at", "_s.*", "t", "n").groupBy(*by, "t").agg(F.sum("n").alias("n"))

    def sign(of: list[int]) -> Column:
        return F.element_at(F.array(*(F.lit(x).cast("long") for x in of)), F.col("k") + 1)

    def meets(at: Column, after: int, n: Column, signs: list[int]) -> Column:
        return F.struct(at.alias("pos"), F.lit(after).alias("after"), n.alias("add"), (sign(signs) * F.col("n")).alias("q"))

    points = [meets(F.col("t"), 0, F.col("n"), [s for _, s, _ in sets])]
    points += [meets(F.col("t") - h - 1, 1, F.lit(0).cast("long"), [far.get(h, 0) for _, _, far in sets]) for h in sorted({h for _, _, far in sets for h in far})]
    points = some.select(*by, "t", F.explode(F.array(*points)).alias("_e")).select(*by, "t", "_e.*").where("after = 0 or q != 0").withColumn("span", F.floor(F.col("pos") / SPAN))
    spans = points.groupBy(*by, "span").agg(F.sum("add").alias("n0"), F.sum(F.col("add") * F.col("t")).alias("s0"))
    before = Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*by, "span", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n0", "s0")))
    run = Window.partitionBy(*by, "span").orderBy("pos", "after").rowsBetween(Window.unboundedPreceding, 0)
    met = points.join(spans, [*by, "span"]).withColumn("n", F.col("n0") + F.sum("add").over(run)).withColumn("s", F.col("s0") + F.sum(F.col("add") * F.col("t")).over(run))
    # of its own n, a row meets half of n * (n - 1) at gap 0
    n_pairs = F.col("q") * F.col("n") - F.when(F.col("after") == 0, F.shiftright(F.col("q") * (F.col("add") + 1), 1)).otherwise(F.lit(0))
    gaps = F.col("q").cast("decimal(19,0)") * (F.col("t") * F.col("n") - F.col("s")).cast("decimal(19,0)")
    off = F.when(F.col("tie"), -1).otherwise(1)
    totals = met.groupBy("case_id").agg(F.sum(off * n_pairs).alias("n_pairs"), F.sum(off * gaps).cast("long").alias("total_gap"))
    return totals.where("n_pairs > 0")


def _normed(constraints: DataFrame) -> DataFrame:
    a, b = alias_norm(F.col("alias_a")), alias_norm(F.col("alias_b"))
    return constraints.select("case_id", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def _alias_pair(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("lo", F.least("entity_norm_a", "entity_norm_b")).withColumn("hi", F.greatest("entity_norm_a", "entity_norm_b"))


def forced_pairs(obs: DataFrame, must_merge: DataFrame) -> DataFrame:
    """Pairs of observations whose aliases a must_merge row names: they become candidates, nothing more."""
    m = _normed(must_merge)
    a = _side(obs, "a").join(m, "case_id").where(F.col("entity_norm_a") == F.col("lo"))
    out = a.join(_side(obs, "b"), "case_id").where((F.col("entity_norm_b") == F.col("hi")) & (F.col("obs_id_a") != F.col("obs_id_b"))).drop("lo", "hi")
    swap = F.col("ord_a") > F.col("ord_b")
    ordered = out.select("case_id", *(F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for x, y in (("a", "b"), ("b", "a")) for c in CARRIED))
    return named(ordered).dropDuplicates(["case_id", "obs_id_1", "obs_id_2"])


def without_forbidden(pairs: DataFrame, must_not_merge: DataFrame) -> DataFrame:
    """Pairs whose aliases no must_not_merge row names."""
    return _alias_pair(pairs).join(_normed(must_not_merge), ["case_id", "lo", "hi"], "left_anti").drop("lo", "hi")


def forbidden_pairs(obs: DataFrame, must_not_merge: DataFrame) -> DataFrame:
    """(case_id, obs_id_1, obs_id_2) of every pair that must_not_merge names."""
    return forced_pairs(obs, must_not_merge).select("case_id", "obs_id_1", "obs_id_2")


def capped(pairs: DataFrame, most: int | None) -> DataFrame:
    """The first `most` pairs of each case: forced ones, then by obs_id_1 and obs_id_2. None: all."""
    if most is None:
        return pairs
    w = Window.partitionBy("case_id").orderBy(F.col("forced").desc(), "obs_id_1", "obs_id_2")
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def with_sides(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Pairs with the rest of both sides' columns: texts are joined to the pairs that are left, not carried through the search for them."""
    for side in "ab":
        pairs = pairs.join(obs.select("case_id", F.col("obs_id").alias(f"obs_id_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in JOINED)), ["case_id", f"obs_id_{side}"])
    return pairs


def candidates(obs: DataFrame, cfg: ErConfig, must_merge: DataFrame | None = None, must_not_merge: DataFrame | None = None, large_cases: bool = True) -> DataFrame:
    """Candidate pairs with both sides' columns and `forced`; constraints that are None don't exist.

    large_cases: pairs are found by buckets, whatever a case's size; else by one self-join of each case, for cases known to be small.
    """
    found = (pairs_by_buckets if large_cases else pairs_by_join)(obs, cfg)
    out = found.withColumn("forced", F.lit(False))
    if must_merge is not None:
        forced = forced_pairs(obs, must_merge).withColumn("forced", F.lit(True))
        out = forced.unionByName(out.join(forced.select("case_id", "obs_id_1", "obs_id_2"), ["case_id", "obs_id_1", "obs_id_2"], "left_anti"))
    if must_not_merge is not None:
        out = without_forbidden(out, must_not_merge)
    return with_sides(capped(out, cfg.max_pairs), obs)
