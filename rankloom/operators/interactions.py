"""Interaction logs: de-duplication, k-core, splits, histories, statistics.

All functions take the names of the user, item, time and group columns, so that several categories are processed in one
pass. Rows whose user or item is null are dropped, since they belong to no sequence; null times sort first, null
ratings stay. Extra columns pass through where the row count stays the same and are dropped by aggregating functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import cut, cut_counted

U, I, TS, G = "user_id", "parent_asin", "ts_ms", ("category",)


def dedupe_earliest(df: DataFrame, user: str = U, item: str = I, ts: str = TS, group: Sequence[str] = G, tie: Sequence[str] = ("ingested_at", "rating")) -> DataFrame:
    """One row per (group, user, item): the one with the smallest ``ts``, ties broken by ``tie`` and then by all other columns.

    A minimum over a struct aggregates before the shuffle, so a hot item sends one row per map task and user only.
    """
    keys = [*group, user, item]
    rest = [c for c in (ts, *tie) if c in df.columns]
    rest += [c for c in df.columns if c not in keys and c not in rest]
    return df.filter(F.col(user).isNotNull() & F.col(item).isNotNull()).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first")).select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def core_filter(df: DataFrame, k: int, user: str = U, item: str = I, group: Sequence[str] = G, max_rounds: int = 1000) -> DataFrame:
    """Largest subset in which every user and every item has at least ``k`` rows: both sides at once, round after round, until no row goes.

    ``df`` should hold distinct pairs. Each round counts both sides (aggregated before the shuffle) and removes the rows of the
    short ones by anti-joins; adaptive execution broadcasts the removed keys when they turn out small and splits hot keys when
    they don't. Rounds are cut by checkpoints. An empty core is returned as an empty frame.
    """
    if k <= 1:
        return df
    null_safe = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    cur, n = cut_counted(df)
    for _ in range(max_rounds):
        users = cur.groupBy(*group, user).count().filter(F.col("count") < k).drop("count")
        items = cur.groupBy(*group, item).count().filter(F.col("count") < k).drop("count")
        nxt = cur.join(users, null_safe(cur, users, [*group, user]), "left_anti")
        nxt = nxt.join(items, null_safe(nxt, items, [*group, item]), "left_anti")
        nxt, m = cut_counted(nxt)
        done, cur, n = m == n, nxt, m
        if done or m == 0:
            return cur
    raise ValueError(f"no fixed point after {max_rounds} rounds")


def _order(user: str, item: str, ts: str, group: Sequence[str]):
    return Window.partitionBy(*group, user).orderBy(F.col(ts).asc_nulls_first(), F.col(item))


def with_position(df: DataFrame, user: str = U, item: str = I, ts: str = TS, group: Sequence[str] = G) -> DataFrame:
    """Adds ``pos`` (from 1, by time and then item) and ``n`` (rows of the user)."""
    return df.withColumn("pos", F.row_number().over(_order(user, item, ts, group))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*group, user)))


def _split() -> Column:
    return F.when(F.col("pos") == F.col("n"), "test").when(F.col("pos") == F.col("n") - 1, "valid").otherwise("train")


def leave_one_out(df: DataFrame, user: str = U, item: str = I, ts: str = TS, group: Sequence[str] = G) -> DataFrame:
    """Adds ``split``: the last row of a user is test, the one before it valid, the rest train. A single row is test."""
    return with_position(df, user, item, ts, group).withColumn("split", _split()).drop("pos", "n")


def sequences(df: DataFrame, maxlen: int = 20, user: str = U, item: str = I, ts: str = TS, group: Sequence[str] = G, min_history: int = 1) -> DataFrame:
    """Adds ``split`` and ``history`` (at most ``maxlen`` earlier items, oldest first; 0 lifts the limit). Train rows need ``min_history`` earlier items; valid and test rows always come out.

    One window ordering serves position, split and history: a single shuffle by user.
    """
    w = _order(user, item, ts, group)
    frame = w.rowsBetween(-maxlen if maxlen else Window.unboundedPreceding, -1)
    out = with_position(df, user, item, ts, group).withColumn("history", F.collect_list(item).over(frame)).withColumn("split", _split())
    return out.filter((F.col("split") != "train") | (F.col("pos") > min_history)).drop("pos", "n")


def split_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n_rows"))


def category_stats(df: DataFrame, user: str = U, item: str = I, group: Sequence[str] = G) -> DataFrame:
    """Users, items, rows, mean / smallest / largest / upper-median sequence length and sparsity of each group.

    The upper median is the element at index n // 2 of the sorted lengths. It is found from the histogram of lengths,
    so no list of users is ever gathered.
    """
    per_user = df.groupBy(*group, user).agg(F.count(F.lit(1)).alias("len"))
    hist = per_user.groupBy(*group, "len").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*group)
    ranked = hist.withColumn("upto", F.sum("m").over(w.orderBy("len"))).withColumn("users", F.sum("m").over(w))
    a = ranked.groupBy(*group).agg(
        F.sum("m").alias("n_users"),
        F.sum(F.col("m") * F.col("len")).alias("n_interactions"),
        F.min("len").alias("min_seq_len"),
        F.max("len").alias("max_seq_len"),
        F.min(F.when(F.col("upto") > F.floor(F.col("users") / 2), F.col("len"))).alias("median_seq_len"),
    )
    b = df.groupBy(*group, item).agg(F.lit(1).alias("_one")).groupBy(*group).agg(F.count(F.lit(1)).alias("n_items"))
    on = [a[g].eqNullSafe(b[g]) for g in group]
    out = a.join(b, on) if group else a.crossJoin(b)  # two single rows where there is no group
    n, u, i = F.col("n_interactions"), F.col("n_users"), F.col("n_items")
    return out.select(*[a[g] for g in group], "n_users", "n_items", "n_interactions", F.round(n / u, 4).alias("avg_seq_len"), "median_seq_len", "min_seq_len", "max_seq_len", F.round(1 - n / (u * i), 8).alias("sparsity"))


def explicit_positive(df: DataFrame, threshold: float = 4.0, rating: str = "rating") -> DataFrame:
    """Rows rated at least ``threshold``; null ratings are not positive."""
    return df.filter(F.col(rating) >= threshold)


def temporal_split(df: DataFrame, ratios: tuple[int, int, int] = (8, 1, 1), user: str = U, item: str = I, ts: str = TS, group: Sequence[str] = G) -> DataFrame:
    """Per-user split in time order by shares: row ``pos`` of ``n`` is train up to floor(n*a/s), valid up to floor(n*(a+b)/s), else test."""
    a, b, c = ratios
    s, n, pos = a + b + c, F.col("n"), F.col("pos")
    return with_position(df, user, item, ts, group).withColumn("split", F.when(pos <= F.floor(n * a / s), "train").when(pos <= F.floor(n * (a + b) / s), "valid").otherwise("test")).drop("pos", "n")


#: Times are looked at in steps of 2**40, 2**25 and 2**10 of their unit before single instants, so no task sorts more than 2**15 of them.
_STEPS = (40, 25, 10, 0)


def temporal_split_global(df: DataFrame, ratios: tuple[int, int, int] = (8, 1, 1), ts: str = TS, group: Sequence[str] = G) -> DataFrame:
    """Split at two instants per group, so that all rows of one instant fall on the same side. ``ts`` is an integer; null comes before all.

    The instants are found by counting: coarse steps of time first, then only the step that holds the instant, and so on. Neither rows
    nor distinct instants are sorted as a whole, and what is joined back is one row per group.
    """
    a, b, c = ratios
    s, groups = a + b + c, list(group)
    gk = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(groups, gk, strict=True)], F.col(ts).cast("bigint").alias("_t"))
    hist = cut(rows.groupBy(*gk, F.shiftright("_t", 10).alias("_s")).agg(F.count(F.lit(1)).alias("m")))
    total = hist.groupBy(*gk).agg(F.sum("m").alias("total"), F.coalesce(F.sum(F.when(F.col("_s").isNull(), F.col("m"))), F.lit(0)).alias("base"))
    # per group and cut: rows before the step in question, and that step; an instant is on the near side if rows up to it times s don't exceed total times the share
    at = total.select(*gk, "total", "base", F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(r).alias("share")) for i, r in enumerate((a, a + b))])).alias("x")).select(*gk, "total", "base", "x.cut", "x.share")
    at = at.withColumn("best", F.when(F.col("base") > 0, F.when(F.col("base") * s <= F.col("total") * F.col("share"), F.lit(-(2**63))).cast("bigint"))).withColumn("step", F.lit(None).cast("bigint"))
    for i, bits in enumerate(_STEPS):
        src = hist.filter("_s is not null") if bits else rows.filter("_t is not null").groupBy(*gk, "_t").agg(F.count(F.lit(1)).alias("m"))
        fine = F.shiftright("_s", bits - 10) if bits else F.col("_t")
        coarse = F.shiftright(fine, _STEPS[i - 1] - bits) if i else F.lit(None).cast("bigint")
        steps = src.select(*gk, fine.alias("_f"), coarse.alias("_c"), "m")
        if not bits:  # single instants of the steps in question only, counted before they are joined
            want = at.select(*gk, F.col("step").alias("_c")).filter("_c is not null").distinct()
            near = rows.withColumn("_c", F.shiftright("_t", _STEPS[i - 1]))
            near = near.join(want.select(*[F.col(k).alias(f"w{k}") for k in gk], F.col("_c").alias("w_c")), [near[k].eqNullSafe(F.col(f"w{k}")) for k in gk] + [near["_c"] == F.col("w_c")], "left_semi")
            steps = near.groupBy(*gk, F.col("_t").alias("_f"), "_c").agg(F.count(F.lit(1)).alias("m"))
        steps = steps.groupBy(*gk, "_f", "_c").agg(F.sum("m").alias("m"))
        names = [F.col(k).alias(f"h{k}") for k in gk]
        h = steps.select(*names, "_f", "_c", "m")
        j = at.join(h, [at[k].eqNullSafe(F.col(f"h{k}")) for k in gk] + ([at["step"] == h["_c"]] if i else []) or [F.lit(True)])
        w = Window.partitionBy(*gk, "cut").orderBy("_f")
        upto = F.col("base") + F.sum("m").over(w)
        run = j.withColumn("upto", upto).withColumn("ok", F.col("upto") * s <= F.col("total") * F.col("share"))
        # the last step that is wholly on the near side, and the first that isn't, in which the instant lies
        got = run.groupBy(*gk, "cut").agg(
            F.max(F.when(F.col("ok"), F.struct("_f", "upto"))).alias("in_"), F.min(F.when(~F.col("ok"), F.col("_f"))).alias("out_")
        ).select(*[F.col(k).alias(f"r{k}") for k in gk], F.col("cut").alias("rcut"), "in_", "out_")
        ends = F.shiftleft(F.col("in_._f") + 1, bits) - 1 if bits else F.col("in_._f")  # last instant of that step
        at = at.join(got, [at[k].eqNullSafe(F.col(f"r{k}")) for k in gk] + [at["cut"] == F.col("rcut")], "left")
        at = cut(at.select(*gk, "total", F.coalesce("in_.upto", "base").alias("base"), "cut", "share", F.coalesce(ends, "best").alias("best"), F.col("out_").alias("step")))
    cuts = at.groupBy(*gk).agg(F.max(F.when(F.col("cut") == 0, F.col("best"))).alias("_b0"), F.max(F.when(F.col("cut") == 1, F.col("best"))).alias("_b1"))
    t = F.coalesce(F.col(ts).cast("bigint"), F.lit(-(2**63)).cast("bigint"))
    part = F.when(t <= F.col("_b0"), "train").when(t <= F.col("_b1"), "valid").otherwise("test")
    return df.join(cuts, [df[g].eqNullSafe(F.col(k)) for g, k in zip(groups, gk, strict=True)] or [F.lit(True)]).withColumn("split", part).drop(*gk, "_b0", "_b1")


def semi_items(meta: DataFrame, inter: DataFrame, item: str = I) -> DataFrame:
    """Metadata rows of items that occur in ``inter``; repeated metadata rows all stay."""
    return meta.join(inter.select(item).distinct(), item, "left_semi")


def meta_coverage(meta: DataFrame, inter: DataFrame, item: str = I) -> DataFrame:
    """One row: items, metadata rows kept, rows scanned, share. Repeated metadata rows can raise the share above 1."""
    items = inter.select(item).filter(F.col(item).isNotNull()).distinct()
    per = meta.groupBy(item).agg(F.count(F.lit(1)).alias("m"))
    j = items.join(per, item, "left")
    kept = j.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_matched"))
    scanned = meta.agg(F.count(F.lit(1)).alias("n_scanned"))
    return kept.crossJoin(scanned).select("n_items", "n_matched", "n_scanned", F.round(F.try_divide(F.col("n_matched"), F.col("n_items")), 4).alias("coverage"))


def popularity(df: DataFrame, k: int, item: str = I, group: Sequence[str] = G) -> DataFrame:
    """The ``k`` most frequent items of each group, ties by item."""
    w = Window.partitionBy(*group).orderBy(F.desc("n_rows"), F.col(item))
    return df.groupBy(*group, item).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def item_neighbors(df: DataFrame, queries: DataFrame, k: int, user: str = U, item: str = I) -> DataFrame:
    """The ``k`` items whose users are most like a query item's, by cosine of the sets of users: (query_item, item, score, rank), ties by item.

    ``queries`` has a column ``query_item``: a stated set of items against all items. Repeated pairs of user and item count once, rows without either not at
    all; items that share no user with a query don't come out. Only co-occurrences with query items are counted, aggregated before the shuffle.
    """
    pairs = df.select(F.col(user).alias("_u"), F.col(item).alias("_i")).filter("_u is not null and _i is not null").distinct()
    size = pairs.groupBy("_i").agg(F.count(F.lit(1)).alias("n"))
    asked = pairs.join(queries.select(F.col("query_item").alias("_i")).distinct(), "_i", "left_semi").select("_u", F.col("_i").alias("query_item"))
    both = asked.join(pairs, "_u").filter("query_item <> _i").groupBy("query_item", "_i").agg(F.count(F.lit(1)).alias("both"))
    scored = both.join(size.select(F.col("_i").alias("query_item"), F.col("n").alias("nq")), "query_item").join(size, "_i")
    scored = scored.select("query_item", F.col("_i").alias(item), (F.col("both") / F.sqrt(F.col("nq") * F.col("n"))).alias("score"))
    w = Window.partitionBy("query_item").orderBy(F.round("score", 9).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranking_metrics(df: DataFrame, rank: str = "rank0", ks: Sequence[int] = (5, 10), by: Sequence[str] = ()) -> DataFrame:
    """Mean recall, NDCG and MRR at each k for one relevant item per row; ``rank`` counts from 0, negative or null is a miss."""
    r = F.col(rank)
    aggs = []
    for k in ks:
        hit = (r >= 0) & (r < k)
        aggs += [
            F.avg(F.when(hit, 1.0).otherwise(0.0)).alias(f"recall_{k}"),
            F.avg(F.when(hit, 1.0 / F.log2(r + 2.0)).otherwise(0.0)).alias(f"ndcg_{k}"),
            F.avg(F.when(hit, 1.0 / (r + 1.0)).otherwise(0.0)).alias(f"mrr_{k}"),
        ]
    return (df.groupBy(*by) if by else df.groupBy()).agg(*aggs)


def pad_left(history: Column, length: int, fill: str = "") -> Column:
    """Array of exactly ``length`` entries: the last ones, filled up on the left. Null counts as empty."""
    h = F.coalesce(history, F.array().cast("array<string>"))
    tail = F.slice(h, F.greatest(F.size(h) - length + 1, F.lit(1)), length)
    return F.concat(F.array_repeat(F.lit(fill), F.greatest(length - F.size(tail), F.lit(0))), tail)


def gate(found: DataFrame, target: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """Compare counts with published ones: ``exact``, ``off_by_one`` (no count further than 1) or ``different``; ``missing`` without a target."""
    t = target.select(key, *[F.col(c).alias(f"_t_{c}") for c in counts])
    d = [F.abs(F.col(c) - F.col(f"_t_{c}")) for c in counts]
    worst = F.greatest(*d) if len(d) > 1 else d[0]
    return found.join(t, key, "left").select(key, F.when(worst.isNull(), "missing").when(worst == 0, "exact").when(worst <= 1, "off_by_one").otherwise("different").alias("verdict"))
