import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.operators import harvest as H
from rankloom.operators import interactions as N
from rankloom.operators import resolve as R
from rankloom.operators import search as S
from rankloom.operators import semid as M

INTER = "category string, user_id string, parent_asin string, ts_ms long, rating double"


def inter(spark, rows):
    return spark.createDataFrame(rows, INTER)


def test_worked_sequence(spark):
    df = inter(spark, [("c", "u", i, t, 5.0) for t, i in enumerate("abcde", 1)] + [("c", "v", "a", 1, None), ("c", "w", "a", 1, 1.0), ("c", "w", "b", 2, 1.0)])
    got = {(r.user_id, r.parent_asin): (r.split, r.history) for r in N.sequences(df, 2).collect()}
    assert got[("u", "b")] == ("train", ["a"]) and got[("u", "c")] == ("train", ["a", "b"]) and ("u", "a") not in got
    assert got[("u", "d")] == ("valid", ["b", "c"]) and got[("u", "e")] == ("test", ["c", "d"])
    assert got[("v", "a")] == ("test", []) and got[("w", "b")] == ("test", ["a"]) and got[("w", "a")] == ("valid", [])


def test_dedupe_and_core_against_plain_python(spark):
    rng = random.Random(3)
    rows = [("c", f"u{rng.randrange(25)}", f"i{rng.randrange(20)}", rng.randrange(9), float(rng.randrange(5))) for _ in range(300)]
    rows += [("c", None, "i1", 1, 1.0), ("c", "u1", None, 1, 1.0)] + rows[:20]
    one = N.dedupe_earliest(inter(spark, rows))
    want = {}
    for c, u, i, t, r in rows:
        if u and i:
            want[(u, i)] = min(want.get((u, i), (99, 9.0)), (t, r))
    assert {(r.user_id, r.parent_asin): (r.ts_ms, r.rating) for r in one.collect()} == want
    for k in (5, 7, 50):
        pairs = set(want)
        while True:
            cu, ci = Counter(u for u, _ in pairs), Counter(i for _, i in pairs)
            kept = {(u, i) for u, i in pairs if cu[u] >= k and ci[i] >= k}
            if kept == pairs:
                break
            pairs = kept
        assert {(r.user_id, r.parent_asin) for r in N.core_filter(one, k).collect()} == pairs


def test_stats_upper_median_and_empty(spark):
    rows = [("c", f"u{n}", f"i{j}", j, 1.0) for n in (1, 2, 3, 4) for j in range(n)]
    r = N.category_stats(inter(spark, rows)).first()
    assert (r.n_users, r.n_items, r.n_interactions, r.median_seq_len, r.avg_seq_len) == (4, 4, 10, 3, 2.5)
    empty = inter(spark, [])
    assert N.category_stats(empty).count() == N.sequences(empty).count() == N.core_filter(empty, 2).count() == N.temporal_split_global(empty).count() == 0


def test_metrics(spark):
    m = N.ranking_metrics(spark.createDataFrame([(0,), (4,), (7,), (-1,)], "rank0 int")).first()
    assert [round(x, 6) for x in m] == [0.5, 0.346713, 0.3, 0.75, 0.425579, 0.33125]


def test_upsert_todo_and_windows(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 5, "keep")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 2, "late"), ("c", None, None)], "k string, v int, x string")
    assert sorted((r.k, r.x) for r in H.upsert(base, new, ["k"], "v").collect()) == [("a", "new"), ("b", "keep"), ("c", None)]
    assert [r.k for r in H.todo(new, base, "k").collect()] == ["c"]
    w = H.month_windows(spark, datetime.date(2024, 1, 30), datetime.date(2024, 3, 2)).orderBy("window_start").collect()
    assert [(str(r[0]), str(r[1])) for r in w] == [("2024-01-30", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-02")]
    assert H.month_windows(spark, datetime.date(2024, 2, 1), datetime.date(2024, 1, 1)).count() == 0


def test_topic_filter(spark):
    df = spark.createDataFrame([("Cold-Start", "x", "cs"), ("other", "about cold start", "cs"), ("other", "cold start", "bio"), (None, None, None)], "title string, abstract string, cat string")
    assert H.topic_filter(df, ["cold start"], ["cold start"], ["cs"], category="cat").count() == 2
    assert H.topic_filter(df, [], ["cold start"]).count() == 4


def test_choose_and_fuzzy(spark):
    idx = spark.createDataFrame([("1", "A Title", "Ann Lee"), ("2", "A title", "Bob Ray"), ("3", "Same", "X Y"), ("4", "Same", "X Y"), ("5", "One long title about matching papers", "Ann Lee"), ("6", None, None)], "arxiv_id string, title string, surname string")
    p = spark.createDataFrame([("p1", "a title!", "Ann Lee"), ("p2", "same", "X Y"), ("p3", "none", "Z"), ("p4", None, None), ("p5", "One long title about matching paper", "A. Lee")], "paper_key string, title string, authors string")
    assert {r.paper_key: r.arxiv_id for r in R.choose_exact(p, idx).collect()} == {"p1": "1", "p2": None, "p3": None, "p4": None, "p5": None}
    assert [(r.paper_key, r.arxiv_id) for r in R.fuzzy_fill(p.filter("paper_key = 'p5'"), idx, idx.filter("false")).collect()] == [("p5", "5")]


def test_fuzzy_candidates_lose_no_pair(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    mk = lambda n, p: [(f"{p}{i}", " ".join(rng.sample(words, rng.randrange(1, 8))), "A Lee") for i in range(n)]
    a, b = mk(40, "p"), mk(40, "e")
    want = {(x, y) for x, t, _ in a for y, u, _ in b if len(set(t.split()) & set(u.split())) / len(set(t.split()) | set(u.split())) >= 0.6}
    c = R.fuzzy_candidates(spark.createDataFrame(a, "paper_key string, title string, authors string"), spark.createDataFrame(b, "arxiv_id string, title string, surname string"))
    assert {(r.paper_key, r.arxiv_id) for r in c.collect()} == want and want


def test_search(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(900, None)]
    rows += [(901, rows[0][1]), (902, rows[0][1])]
    ix = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(7, rows[0][1])], "query_id long, embedding array<double>")
    got = [r.vec_id for r in S.cosine_topk(ix, q, 5).orderBy("rank").collect()]
    dot = lambda v: sum(a * b for a, b in zip(v, rows[0][1], strict=True))
    assert got == [i for i, v in sorted((x for x in rows if x[1]), key=lambda x: (-round(dot(x[1]), 9), x[0]))[:5]]
    assert S.cosine_topk(ix, q.limit(0), 5).count() == 0
    docs = S.embed(spark.createDataFrame([("a", "deep ranking", "d", 2020, 5), ("b", "deep ranking models", "d", 2021, 9), ("c", "", "d", 2020, 1)], "arxiv_id string, text string, domain string, pub_year int, citation_count int"), "text")
    e = S.SearchEngine(docs, domains=("d",))
    assert [r.arxiv_id for r in e.search("deep ranking", sort_by="citations", rerank_k=2).orderBy("rank").collect()] == ["b", "a"]
    assert e.search("  ").count() == 0 and e.search("deep", years=[2021]).count() == 1
    with pytest.raises(ValueError):
        e.search("x", domain="nope")


def test_identifiers(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [1, 2]), (2, [3, 4])], "item_idx long, codes array<int>")
    assert {r.item_idx: r.digit for r in M.collision_digit(df).collect()} == {0: 0, 1: 1, 2: 0}
    with pytest.raises(ValueError):
        M.collision_digit(df, width=1)
    keys = spark.createDataFrame([(f"k{i % 37:02d}",) for i in range(100)] + [(None,)], "k string")
    assert [r.item_idx for r in M.dense_index(keys, "k").orderBy("k").collect()] == list(range(37))
    pad, mask = M.pad_right(M.offset_tokens(F.col("codes"), 2, 10), 4, 20)
    assert tuple(df.filter("item_idx = 2").select(pad, mask).first()) == ([3, 14, 20, 20], [1, 1, 0, 0])
    ranks = M.rank_of(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x")], "query_id int, rank int, value string"), spark.createDataFrame([(1, "b"), (2, "y")], "query_id int, target string"))
    assert {r.query_id: r.rank0 for r in ranks.collect()} == {1: 1, 2: -1}


def test_beam(spark):
    steps = [(h, p, c, lp) for h in (0, 1) for p in (0, 1) for c, lp in ((0, -0.1 - p), (1, -0.5))]
    s = spark.createDataFrame(steps, "level int, prev int, code int, logp double")
    out = M.beam_search(spark.createDataFrame([(9, 0)], "query_id int, prev int"), s, 2, 2).orderBy("rank").collect()
    best = sorted(((a, b), la + lb) for h, p, a, la in steps for g, q, b, lb in steps if h == 0 and p == 0 and g == 1 and q == a)
    want = sorted(best, key=lambda x: (-x[1], x[0]))[:2]
    assert [tuple(r.path) for r in out] == [w[0] for w in want]


def test_kmeans_codes(spark):
    rows = [(i, [float(i % 2) * 10 + (i % 3) * 0.01, 1.0]) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    books = M.fit_residual_kmeans(df, 1, 2, normalize=False)
    by = defaultdict(set)
    for r in M.encode(df, books, normalize=False).collect():
        by[r.codes[0]].add(r.vec_id % 2)
    assert sorted(map(sorted, by.values())) == [[0], [1]]


def test_global_split_against_sorting(spark):
    rng = random.Random(11)
    rows = []
    for g in ("a", "b", None, "one"):
        n = 1 if g == "one" else 160
        span = {"a": 10**12, "b": 40, None: 2**44}.get(g, 5)
        rows += [(g, "u", "i", None if rng.random() < 0.05 and g == "b" else rng.randrange(-span, span), 1.0) for _ in range(n)]
    got = Counter((r.category, r.ts_ms, r.split) for r in N.temporal_split_global(inter(spark, rows)).collect())
    want = Counter()
    for g in {r[0] for r in rows}:
        ts = [r[3] if r[3] is not None else -(2**63) for r in rows if r[0] == g]
        for t in ts:
            upto = sum(x <= t for x in ts)
            want[g, None if t == -(2**63) else t, "train" if upto * 10 <= len(ts) * 8 else "valid" if upto * 10 <= len(ts) * 9 else "test"] += 1
    assert got == want


def test_search_per_value_and_lengths(spark):
    rng = random.Random(2)
    ix = [(i, [rng.gauss(0, 1) for _ in range(3 if i % 7 else 2)], rng.choice(["x", "y", None])) for i in range(90)]
    q = [(100 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(4)] + [(999, None)]
    df, qd = spark.createDataFrame(ix, "vec_id long, embedding array<double>, label string").repartition(3), spark.createDataFrame(q, "query_id long, embedding array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for per in (None, "label"):
        got = {(r.query_id, r.label if per else 0, r["rank"]): r.vec_id for r in S.cosine_topk(df, qd, 4, per=per).collect()}
        want = {}
        for qi, v in q[:-1]:
            for label in {"x", "y", None} if per else {0}:
                best = sorted(((-dot(v, e), i) for i, e, x in ix if len(e) == 3 and (not per or x == label)))[:4]
                want |= {(qi, label, k + 1): i for k, (_, i) in enumerate(best)}
        assert got == want
    self_out = S.cosine_topk(df, df.select(F.col("vec_id").alias("query_id"), "embedding"), 2, exclude_self=True)
    assert self_out.filter("query_id = vec_id").count() == 0 and S.cosine_topk(df.limit(0), qd, 3).count() == 0


def test_bm25_and_lookup(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None)], "doc_id long, words array<string>")
    q = spark.createDataFrame([(7, ["a", "a"]), (8, ["z"]), (9, None)], "query_id long, words array<string>")
    assert [(r.query_id, r.doc_id) for r in S.bm25_topk(docs, q, 5).collect()] == [(7, 1)]
    ids = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "arxiv_id string")
    rec = spark.createDataFrame([("a", ("t",)), ("a", ("t",)), ("c", ("x",))], "arxiv_id string, rec struct<title string>")
    assert sorted((r.arxiv_id, r.found) for r in H.batch_results(ids, rec).collect()) == [("a", True), ("b", False)]
    v = spark.createDataFrame([("KDD2016",), ("ICML2017",), (None,), ("odd",)], "venue_short string")
    assert H.venue_years(v, ["KDD"]).count() == H.venue_years(v, [], [2017]).count() == 1 and H.venue_years(v).count() == 4


def test_seeding_and_revival(spark):
    """Seeds differ and lie far apart; a centroid without rows takes the row furthest off; drawing follows squared distances."""
    rows = [(i, [10.0 * (i % 4), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    c = M.plus_plus(df, [], 4, "vec_id", "embedding", False)
    assert sorted(x[0] for x in c) == [0.0, 10.0, 20.0, 30.0]
    assert len(M.plus_plus(df, [], 9, "vec_id", "embedding", False)) == 4 and len(M.plus_plus(df.limit(0), [], 3, "vec_id", "embedding", False)) == 0
    dead = [[[0.0, 1.0], [900.0, 1.0]]]
    assert M.fit_residual_kmeans(df, 1, 2, 1, normalize=False, init=dead)[0][1][0] == 900.0
    assert M.fit_residual_kmeans(df, 1, 2, 1, normalize=False, init=dead, revive=True)[0][1][0] == 30.0
    pair = spark.createDataFrame([(i, [0.0 if i < 50 else 1.0 if i < 90 else 2.0]) for i in range(100)], "vec_id long, embedding array<double>")
    second = Counter(float(M.plus_plus(pair, [], 2, "vec_id", "embedding", False)[1][0]) for _ in range(1))
    assert sum(second.values()) == 1


def test_runs_and_lists(spark):
    runs = spark.createDataFrame([("g", "b", 0.5), ("g", "a", 0.5), ("g", "c", 0.1), ("h", "x", None), (None, "y", 0.2)], "g string, run string, m double")
    assert sorted(map(str, M.best_run(runs, "m", ["g"]).collect())) == sorted(["Row(g='g', run='a', m=0.5)", "Row(g=None, run='y', m=0.2)"])
    gen = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank int, value string")
    tgt = spark.createDataFrame([(1, "b"), (2, "b"), (3, None)], "query_id int, target string")
    r = M.evaluate_generated(gen, tgt).first()
    assert (r.recall_5, r.mrr_5) == (0.5, 0.25)


def test_item_neighbors_against_plain_python(spark):
    rng = random.Random(6)
    rows = [("c", rng.choice("uvwxyz"), f"i{rng.randrange(9)}", 1, 1.0) for _ in range(60)] + [("c", None, "i1", 1, 1.0), ("c", "u", None, 1, 1.0)]
    users = defaultdict(set)
    for _, u, i, _, _ in rows:
        if u and i:
            users[i].add(u)
    q = spark.createDataFrame([("i1",), ("i2",), ("i1",), ("none",)], "query_item string")
    got = {(r.query_item, r["rank"]): (r.parent_asin, round(r.score, 9)) for r in N.item_neighbors(inter(spark, rows), q, 3).collect()}
    want = {}
    for a in ("i1", "i2"):
        s = sorted((-round(len(users[a] & users[b]) / (len(users[a]) * len(users[b])) ** 0.5, 9), b) for b in users if b != a and users[a] & users[b])
        want |= {(a, k + 1): (b, -x) for k, (x, b) in enumerate(s[:3])}
    assert got == want and N.item_neighbors(inter(spark, []), q, 3).count() == 0
