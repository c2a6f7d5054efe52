from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.functions import vectors as V


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_names_and_titles(spark):
    got = values(spark, [("Shashank Gupta 0001",), ("Maarten de Rijke",), (None,), ("",)], "a string", X.surname_of("a"), X.clean_author("a"))
    assert got == [("gupta", "Shashank Gupta"), ("rijke", "Maarten de Rijke"), ("", ""), ("", "")]
    got = values(spark, [("Loïc",), ("α-Rank \\emph{fast}",), (None,)], "a string", X.normalize_title("a"), X.norm_title("a"))
    assert got == [("lo c", "loic"), ("rank emph fast", "alpha rank fast"), ("", "")]
    got = values(spark, [("collaborative-filtering",), ("Cold_Start",), ("next/item",)], "a string", X.normalize_text("a"))
    assert [g[0] for g in got] == ["collaborative filtering", "cold start", "next item"]
    got = values(spark, [("li", "Kalinin"), ("Smith", "Jones"), ("", "x")], "a string, b string", X.surnames_match("a", "b"))
    assert [g[0] for g in got] == [True, False, True]
    got = values(spark, [("Ann Lee", "A. Lee"), ("Ann Lee", "Bob Lee"), ("", "x")], "a string, b string", X.same_first_author("a", "b"))
    assert [g[0] for g in got] == [True, False, False]


def test_similarity(spark):
    got = values(spark, [("abc", "abd"), ("", ""), (None, None)], "a string, b string", F.round(X.title_similarity("a", "b"), 4))
    assert [g[0] for g in got] == [0.6667, 1.0, 1.0]
    got = values(spark, [("abcd", "abce"), (None, "x")], "a string, b string", X.sequence_ratio("a", "b"))
    assert got == [(0.75,), (None,)]


def test_identifiers(spark):
    ids = ["2512.25075", "hep-th/9901001", "math/0401001", "x", None]
    assert [g[0] for g in values(spark, [(i,) for i in ids], "a string", X.year_of("a"))] == ["2025", "1999", "2004", "unknown_year", "unknown_year"]
    assert [g[0]["year"] for g in values(spark, [(i,) for i in ids], "a string", X.chrono_key("a"))] == [2025, 1999, 2004, 0, 0]
    got = values(spark, [("http://arxiv.org/abs/2301.00001v2",), ("nothing",)], "a string", X.extract_arxiv_id("a"))
    assert [g[0] for g in got] == ["2301.00001", None]
    assert [g[0] for g in values(spark, [("Computer Science; Math",), ("",), (None,), ("--",)], "a string", X.subject_of("a"))] == ["Computer_Science", "Unknown", "Unknown", "Unknown"]


def test_venues(spark):
    got = values(spark, [("Accepted at ICML'26",), ("ICML 2026",), ("ACL",), ("NAACL 2025",), (None,), ("ICML and NeurIPS 2024",)], "a string", X.canonical_venue("a"))
    assert [g[0] for g in got] == ["ICML2026", "ICML2026", "ACL", "null", "null", "NeurIPS2024"]
    got = values(spark, [("to appear", None), ("note", None), ("x", " J. 1 ")], "c string, j string", X.extract_venue("c", "j"))
    assert [g[0] for g in got] == ["to appear", "null", "J. 1"]


def test_sections_and_bins(spark):
    text = "# T\n\n## § 1 - Intro.\nbody one\n## § 3 — Method\n\nbody two\n"
    got = values(spark, [(text,), (None,), ("no headings",)], "c string", X.extract_sections("c"))
    assert [[(s["name"], s["body"]) for s in g[0]] for g in got] == [[("intro", "body one"), ("method", "body two")], [], []]
    got = values(spark, [("T", text), ("T", "plain")], "t string, c string", X.select_sections_text("t", "c", ["Method"]))
    assert [g[0] for g in got] == ["T\n\nbody two", "T\n\nplain"]
    assert [g[0] for g in values(spark, [("u1",), ("AE2ZZ",)], "u string", X.user_bin("u"))] == [602804, 84294]
    got = values(spark, [("Acme_recsys_20250406_T",), ("bad",), (None,)], "s string", X.filename_meta("s"))
    assert [(g[0]["venue"], g[0]["is_preprint"], g[0]["pub_date"]) for g in got] == [("RecSys", False, "2025-04-06"), ("", False, ""), ("", False, "")]


def test_python_float(spark):
    nums = [1.5, 1e7, 0.0001, 12345678.5, 1e-5, 0.00025, 1e16, 60.0]
    assert [g[0] for g in values(spark, [(n,) for n in nums], "x double", X.python_float("x"))][:4] == ["1.5", "10000000.0", "0.0001", "12345678.5"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [[round(x, 6) for x in r[0]] for r in df.select(V.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_three_decimals_as_printed(spark):
    rng = __import__("random").Random(4)
    nums = [0.2485, 0.1725, 0.0625, 0.1875, -0.5, 0.0, 1.0, 0.9995, 2.0005] + [round(rng.uniform(-1, 2), 4) for _ in range(300)]
    assert [float(g[0]) for g in values(spark, [(n,) for n in nums], "x double", X.three_decimals("x"))] == [float(f"{n:.3f}") for n in nums]


def test_match_text_round_trip(spark):
    df = spark.createDataFrame([(0.9, [("2502.12510", 0.97, 0.853, "t" * 90, "Lee")]), (None, [])], "s double, c array<struct<arxiv_id string, rerank double, recall double, title string, surname string>>")
    got = [tuple(r.p) for r in df.select(X.parse_match(X.render_match("s", "c")).alias("p")).collect()]
    assert got == [(0.9, 0.97, "2502.12510", "Lee"), (0.0, 0.0, None, "")]
    assert [g[0] for g in values(spark, [("2301.00001v12",), ("solv-int/9901001v2",), ("solv-int/9901001",), (None,)], "a string", X.arxiv_key("a"))] == ["2301.00001", "solv-int/9901001", "solv-int/9901001", None]
