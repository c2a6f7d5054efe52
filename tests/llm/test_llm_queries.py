"""Operators on small tables: brute force, nulls, repeats, empty tables, extra columns."""

import itertools
import random

from pyspark.sql import functions as F

from rankloom.llm import chunks, leaks, listings, names, spam, titles, tokens, works

P2 = "arxiv_id string, title string, x int"


def test_titles(spark):
    a = [("1", "Noisy Clicks", 1), ("1", "Noisy Clicks", 1), ("2", "Beam Search", 1), ("3", None, 1), ("4", "Cafe", 1), ("5", "", 1), ("6", "Deep Beam", 1)]
    b = [("1", "Nоisy Cliсks", 2), ("2", "Beam search", 2), ("3", "x", 2), ("4", "Café", 2), ("5", " ", 2), ("6", "Ｄｅｅｐ　Beam", 2)]
    got = titles.same_looking(spark.createDataFrame(a, P2), spark.createDataFrame(b, P2))
    assert sorted(r.arxiv_id for r in got.collect()) == ["1", "6"]
    none = spark.createDataFrame([], P2)
    assert titles.same_looking(none, none).count() == 0


def test_unknown_words_stay(spark):
    df = spark.createDataFrame([("Zоrblax runs",)], "title string")
    assert titles.repair_titles(df).first().form == "Zоrblax runs"


def test_tokens_nulls(spark):
    df = spark.createDataFrame([(1, "hello world", "k"), (2, None, "k"), (3, "", "k")], "doc_id long, text string, ids string")
    assert {r.doc_id: r.ids for r in tokens.encode_column(df).collect()} == {1: [31373, 995], 2: [], 3: []}


def test_split(spark):
    text = "## § 1 - a\n" + "word " * 1000 + "\n## § 2 - b\nshort\n"
    df = spark.createDataFrame([("p", text, 1), ("p", text, 1), ("q", None, 1), ("r", "", 1)], "paper_id string, content string, text int")
    assert [tuple(r) for r in chunks.cut_sections(df).collect()] == [("p", 1)]
    pieces = [r for r in chunks.split_texts(df.limit(1), ["paper_id"], "content").orderBy("piece_no").collect()]
    back = pieces[0].text + "".join(b.text[a.stop - b.start :] for a, b in itertools.pairwise(pieces))
    assert back == text and all(len(r.text) <= 3000 for r in pieces)


def test_radius_join_is_exact(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcd", k=rng.randrange(4, 9)))
    left, right = sorted({word() for _ in range(120)}), sorted({word() for _ in range(90)})

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a in left for b in right if lev(a, b) <= 2}
    got = names.radius_join(spark.createDataFrame([(x,) for x in left], "key string"), spark.createDataFrame([(x,) for x in right], "ref_key string"), 2, 7, 3)
    assert {tuple(r) for r in got.collect()} == want


def test_link_authors(spark):
    refs = spark.createDataFrame([(1, "Edmund M. Hesandomak", "person"), (2, "Kalnzeholu Ranking Consortium", "group"), (3, None, None)], "author_id long, full_name string, kind string")
    p = spark.createDataFrame([("a", "Edmund M. Hesandomak; E. Hesandomak ;Wei Hesandomak; The Kalnzeholu Ranking Consortium"), ("a", "Edmund M. Hesandomak; E. Hesandomak ;Wei Hesandomak; The Kalnzeholu Ranking Consortium"), ("b", None), (None, "E. Hesandomak")], "arxiv_id string, authors string")
    c = spark.createDataFrame([("c", "hesandomak"), ("d", "Hesandomak, Edmund"), ("e", None), ("f", "")], "arxiv_id string, surname string")
    got = sorted(tuple(r) for r in names.link_authors(p, c, refs).collect())
    assert got == [("a", 2, 1), ("a", 4, 2), ("d", 0, 1)]
    assert names.link_authors(p, c, refs.limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(3)
    item = " ".join(f"alpha{i}" for i in range(50))
    noise = " ".join(f"beta{rng.randrange(900)}" for _ in range(80))
    half = " ".join(item.split()[:30])
    docs = [(1, noise + " " + item.upper() + " " + noise), (2, noise), (3, noise + " " + half), (4, None), (5, ""), (6, " ".join(item.split()[:15])), (1, noise + " " + item.upper() + " " + noise)]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 7), (3, 7)]
    assert leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_of_short_items_and_in_blocks(spark):
    short = [(1, "one two three four five six seven eight"), (2, "red green blue"), (3, " ".join(f"w{i}" for i in range(18)))]
    docs = [(1, "x y one two three four five six z"), (2, "a red green blue b"), (3, " ".join(f"w{i}" for i in range(9))), (4, "one two red w1 w2")]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(short, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (2, 2), (3, 3)]
    # five items of many blocks open with one instruction: a text of the instruction alone holds none of them
    head = "Read the long passage below with care and then give the one right answer to the question that follows after it here."
    items = [(i, head + " " + " ".join(f"item{i}word{k}" for k in range(15))) for i in range(5)]
    for most in (100, 1):
        one = leaks.find_leaks(spark.createDataFrame([(1, head)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), leaks.LeakConfig(max_items=most))
        assert one.count() == 0


def test_leaks_joined_give_the_same_rows(spark):
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(700)}" for _ in range(rng.choice([8, 20, 45, 70, 110])))) for i in range(40)]
    docs = []
    for k in range(60):
        w = items[k % 40][1].split()
        docs.append((k // 2, " ".join([f"n{rng.randrange(900)}" for _ in range(30)] + [x for x in w[: int(len(w) * rng.uniform(0.3, 1))] if rng.random() > 0.1])))
    d, i = spark.createDataFrame(docs + docs[:5] + [(99, None), (98, "")], "doc_id long, text string"), spark.createDataFrame(items + items[:3] + [(77, None)], "item_id long, text string")
    a, b = (sorted(tuple(r) for r in leaks.find_leaks(d, i, leaks.LeakConfig(max_items=m)).collect()) for m in (1000, 0))
    assert a == b and len(a) > 20


def test_spam_rows(spark):
    docs = [(1, "cheap mouse mat online, buy flash cards sale, " * 10), (2, None), (3, ""), (4, "We read the paper and it was clear to us that the method works. " * 5), (1, "cheap mouse mat online, buy flash cards sale, " * 10)]
    assert [r.doc_id for r in spam.find_spam(spark.createDataFrame(docs, "doc_id long, text string")).collect()] == [1]
    assert spam.find_spam(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_function_words_are_learnt_by_language(spark):
    en, de = "we saw that the method is good for item {} and user {}", "wir sahen dass die methode gut ist für fall {}"
    rows = [(i, en.format(i, chr(97 + i % 26) * 2), "en") for i in range(60)] + [(100 + i, de.format(i), "de") for i in range(40)] + [(200, "odd words only", "xx"), (201, "the the", None), (202, None, "en")]
    got = spam.learn_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(got) == ["en", "de"] and {"that", "the", "for", "and", "is"} <= got["en"] and {"dass", "die", "ist", "für"} <= got["de"] and "aa" not in got["en"]


LISTING = "parent_asin string, title string, store string, categories array<string>, features array<string>, description array<string>, details string, rating_number long, type string"
KINDS = ["Puzzle Book", "Soap Bar", "Hair Dryer", "Flash Cards", "Wireless Controller", "Gaming Headset", "Nail File", "Mouse Mat"]


def catalogue(n=24):
    """Listings of other makers, from which common words, store forms and types can be learnt: each has its maker, a store and a text that names its kind."""
    out = []
    for i in range(n):
        maker, kind = f"Maker{chr(97 + i)}orbem", KINDS[i % len(KINDS)]
        shop = [maker, f"{maker} Official", f"Visit the {maker} Store", f"Maker{chr(97 + (i + 5) % n)}orbem Warehouse"][i % 4]
        out.append((f"m{i}", f"{maker} Line{chr(97 + i)}ovel {kind} | Hot Deal", shop, ["Things", kind], ["Comes in a set, made for daily use"], [f"The Line{chr(97 + i)}ovel {kind.lower()} was made by {maker}."], f'{{"Manufacturer": "{maker}"}}', 1, "x"))
    return out


def test_listings(spark):
    def row(a, title, feats=(), store="Dunksilora", n=1):
        return (a, title, store, ["Books", "Flash Cards"], list(feats), None, "{}", n, "clash")

    rows = [row("a", "Dunksilora Lorelloflin Flash Cards, 12-pack"), row("b", "flash cards | pack of 12 | by DUNKSILORA Lorelloflin | Hot Deal", store="Venikamo Warehouse"), row("c", "Dunksilora Lorelloflin Flash Cards", ["6 pieces"]), row("d", None), row("e", "", store=None), ("f", None, None, None, None, None, None, None, None)]
    rows += [row("a", "Dunksilora Lorelloflin Flash Cards, 12-pack", n=5)] + [row(f"z{i}", f"Kalntoyore Marenihem{'abc'[i]}x Flash Cards", store="Kalntoyore") for i in range(3)]
    g = {r.parent_asin: r.group_id for r in listings.group_listings(spark.createDataFrame(rows + catalogue(), LISTING)).collect()}
    assert len(g) == 9 + 24 and g["a"] == g["b"] != g["c"] and g["f"] == "f" and g["m0"] == "m0"
    assert listings.same_pairs(listings.group_listings(spark.createDataFrame([], LISTING))).count() == 0
    alone = {r.parent_asin for r in listings.group_listings(spark.createDataFrame(rows[3:6], LISTING)).collect()}
    assert alone == {"d", "e", "f"}


def test_no_step_of_the_listings_is_planned_as_a_large_tree(spark, monkeypatch):
    """The driver plans a step's tree anew after each of its exchanges and keeps every version."""
    widest, cut = [], listings.cut
    monkeypatch.setattr(listings, "cut", lambda df: widest.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")) or cut(df))
    out = listings.same_pairs(listings.group_listings(spark.createDataFrame(catalogue(), LISTING)))
    widest.append(out._jdf.queryExecution().executedPlan().toString().count("Exchange "))
    assert max(widest) <= 20, widest


def test_what_a_catalogue_teaches(spark):
    """Names, common words, store forms and types are learnt; nothing depends on how the texts are worded."""
    one = listings.prepared(spark.createDataFrame(catalogue() + [("t", "Cheap Hto Puzzle Book", None, None, None, None, None, 1, "x")], LISTING))
    words = {r.word: r for r in listings.lexicon(one).collect()}
    assert all(words[w].common for w in ("hot", "deal", "puzzle", "daily", "made")) and words["makeraorbem"].brand and words["lineaovel"].name and not words["lineaovel"].common
    assert {r.word for r in listings.store_brands(one).filter("parent_asin in ('m1', 'm2')").collect()} == {"makerborbem", "makercorbem"} and listings.store_brands(one).filter("parent_asin = 'm3'").count() == 0
    types = {r.phrase: r.type for r in listings.type_table(one, listings.marked_words(one, listings.lexicon(one))).collect()}
    assert types["flash cards"] == "flash cards" and "hot deal" not in types


def test_short_brands_and_lines(spark):
    def row(a, title, maker, store=None, feats=()):
        return (a, title, store or maker, ["Things", "Hair Dryer"], list(feats), [], f'{{"Manufacturer": "{maker}"}}', 1, "x")

    rows = [row("a", "Bosch Ixo Hair Dryer, 1200 W", "Bosch"), row("b", "hair dryer / Ixo / 1.2 kW", "Bosch", "Bosch Official"), row("c", "Sony Ixe Hair Dryer", "Sony"), row("d", "Sony Alpha hair dryer", "Sony"), row("e", "Hair Dryer by SONY Alpha", "Sony")]
    g = {r.parent_asin: r.group_id for r in listings.group_listings(spark.createDataFrame(rows + catalogue(), LISTING)).collect()}
    assert g["a"] == g["b"] and g["d"] == g["e"] and len({g[x] for x in "acd"}) == 3


def test_lines_with_a_typing_error_anywhere(spark):
    """Every single error, also one in the middle of the line, leads to the common spelling."""
    goods, p = ("griynneto", "lorelloxin"), [("o", "flash cards", "dunksilora", "fenayabachs")]
    for good in goods:
        n = len(good)
        bad = {good[:i] + "q" + good[i + 1 :] for i in range(n)} | {good[:i] + good[i + 1] + good[i] + good[i + 2 :] for i in range(n - 1)} | {good[:i] + good[i + 1 :] for i in range(n)} | {good[:i] + "q" + good[i:] for i in range(n + 1)}
        p += [(f"{good}{i}", "flash cards", "dunksilora", good) for i in range(3)] + [(f"{good} {w}", "flash cards", "dunksilora", w) for w in sorted(bad - {good})]
    fields = ", ".join(f"{f} {'double' if f in listings.NUMBERS else 'string'}" for f in listings.FIELDS)
    rows = [(*x, *[None] * len(listings.ATTRIBUTES)) for x in p]
    got = {r.parent_asin: r.line for r in listings.settle_names(spark.createDataFrame(rows, f"parent_asin string, type string, {fields}")).collect()}
    assert len(got) == len(p) and got.pop("o") == "fenayabachs"
    assert {(a, x) for a, x in got.items() if not a.startswith(x)} == set()


def test_listings_without_a_type(spark):
    """A typing error in the type word, or no word of a type at all, doesn't part a listing from its product."""

    def row(a, title, cat="Flash Cards", store="Dunksilora"):
        return (a, title, store, ["Books", cat] if cat else [], [], None, "{}", 1, "x")

    rows = [row(f"a{i}", f"Dunksilora Lorelloflin {t}, 12-pack") for i, t in enumerate(["Flash Cards", "flash cards", "Flash Cards"])]
    rows += [row(f"z{i}", f"Kalntoyore {x} Wireless Controller", "Wireless Controller", "Kalntoyore") for i, x in enumerate(["Marenihemax", "Fenayabach", "Griynnetorp"])]
    rows += [row("w", "wireess controller, Marenihemax", None, "kalntoyore"), row("h", "Flahs Cards Lorelloflin, pack of 12", None), row("n", "Dunksilora Lorellofiln, 12-pack", None), row("o", "Dunksilora Lorelloflin, 6-pack", None)]
    g = {r.parent_asin: r.group_id for r in listings.group_listings(spark.createDataFrame(rows + catalogue(), LISTING)).collect()}
    assert len(g) == len(rows) + 24 and g["w"] == g["z0"] and g["z0"] != g["z1"]
    assert g["a0"] == g["a1"] == g["a2"] == g["h"] == g["n"] != g["o"]


def test_listings_of_rare_type_phrases(spark):
    """One listing's own sentence tells its type, with or without a category elsewhere, and the count of other listings doesn't matter."""

    def row(a, title, said, cat=None, store="Kaldrajuni"):
        return (a, title, store, ["Video Games", cat] if cat else [], [], [f"Colour of this {said}: pink."], "{}", 1, "x")

    rows = [row(f"a{i}", "gaming headset, Kaldrajuni Fenayabach", "gaming headset", "Gaming Headset") for i in range(3)]
    rows += [row("r", "headset for gamers, Kaldrajuni Fenayabach", "headset for gamers"), row("s", "lab gloves, Lorelloxin", "lab gloves", "Nitrile Gloves", "Griynneto"), row("t", "Griynneto Lorelloxin", "lab gloves", None, "Griynneto")]
    rows += [row("u", "reading lamp, Dunksilora Marenihemax", "reading lamp", None, "Dunksilora"), row("v", "Dunksilora reading lamp", "reading lamp", None, "Dunksilora"), row("w", "Dunksilora Venovinaro garden hose", "garden hose", None, "Dunksilora")]
    rows += catalogue()
    one = listings.prepared(spark.createDataFrame(rows, LISTING))
    types = {r.phrase: r.type for r in listings.type_table(one, listings.marked_words(one, listings.lexicon(one))).collect()}
    assert types["lab gloves"] == "nitrile gloves" and types["headset for gamers"] is None
    g = {r.parent_asin: r.group_id for r in listings.group_listings(spark.createDataFrame(rows, LISTING)).collect()}
    assert len(g) == len(rows) and g["r"] == g["a0"] == g["a2"] and g["s"] == g["t"] and g["u"] == g["v"] != g["w"]


def test_works(spark):
    rng = random.Random(6)
    words = ["graph", "sparse", "ranking", "deep", "session", "bandit", "causal", "fair", "music", "travel", "query", "cold", "budget", "offline", "privacy", "neural"]
    ents, paps = [], []
    for i in range(60):
        t = " ".join(rng.sample(words, 8))
        sur = f"Surnam{chr(97 + i % 26)}{chr(97 + i // 26)}xel"
        ents.append((f"20{10 + i % 12:02d}.{10000 + i}"[2:], t, sur.lower()))
        if i % 2:
            paps.append((f"k{i}", t.title(), f"Ann {sur}, Bob Ray", f"ICML20{10 + i % 12:02d}", None))
        else:
            paps.append((f"k{i}", t.title(), "Wei Otherman", f"ICML20{10 + i % 12:02d}", None))
    paps += [("n1", None, None, None, None), ("n2", "", "x", None, None), paps[1]]
    ents += [(None, "x", "y"), ("1", None, None), ents[1]]
    p = spark.createDataFrame(paps, "paper_key string, title string, authors string, venue_short string, fetched_at timestamp_ntz")
    e = spark.createDataFrame(ents, "arxiv_id string, title string, surname string")
    log = spark.createDataFrame([("k1", "x", 0.5), (None, None, None)], "paper_key string, matched_title string, title_sim double")
    got = {(r.paper_key, r.arxiv_id) for r in works.match_works(p, e, log).filter("confidence > 0.5").collect()}
    assert got == {(f"k{i}", ents[i][0]) for i in range(1, 60, 2)}
    assert works.match_works(p.limit(0), e, log).filter(F.col("confidence") > 0.5).count() == 0


def test_short_surnames_and_shared_titles(spark):
    """Li, Wu and Kim are linked like anybody; two entries of one title are both candidates of a paper without an author; hot titles lose no same surname."""
    rng = random.Random(8)
    words = ["graph", "sparse", "ranking", "deep", "session", "bandit", "causal", "fair", "music", "travel", "query", "cold", "budget", "offline", "privacy", "neural"]
    names_ = ["Wei Li", "Ann Wu", "Soo Kim", "Bo Xu", "Margaret Yorynnelett"]
    ents, paps = [], []
    for i in range(60):
        t, who = " ".join(rng.sample(words, 8)), names_[i % 5]
        ents.append((f"{10 + i % 12}01.{10000 + i}", t, [who, who.split()[1].lower(), ", ".join(reversed(who.split()))][i % 3]))
        paps.append((f"k{i}", t.title(), who if i % 2 else "Otto Zorn", f"ICML20{10 + i % 12}", None))
    paps.append(("bare", ents[1][1], None, "ICML2011", None))
    ents.append(("2401.99999", ents[1][1], "Olga Wild"))
    p = spark.createDataFrame(paps, "paper_key string, title string, authors string, venue_short string, fetched_at timestamp_ntz")
    e = spark.createDataFrame(ents, "arxiv_id string, title string, surname string")
    log = spark.createDataFrame([], "paper_key string, matched_title string, title_sim double")
    want = {(f"k{i}", ents[i][0]) for i in range(1, 60, 2)}
    for hot in (works.HOT, 0):
        works.HOT, was = hot, works.HOT
        got = works.match_works(p, e, log).collect()
        works.HOT = was
        assert {(r.paper_key, r.arxiv_id) for r in got if r.confidence > 0.5 and r.paper_key != "bare"} == want
        assert {r.arxiv_id for r in got if r.paper_key == "bare"} == {ents[1][0], "2401.99999"}


def test_titles_of_very_many_pairs_lose_no_candidate(spark):
    """Where pairs are made by several tasks, two known authors need nothing in common, as anywhere else."""
    who = "array<struct<word:string,initial:string>>"
    title = "graph ranking for cold sessions"
    near, far = title.replace("cold", "warm"), "a fair bandit of music travel"
    p = [(i, title if i % 3 else near, [(f"aabbc{chr(97 + i)}dq", "a")] if i % 5 else []) for i in range(12)] + [(100, far, [("otherman", "o")])]
    e = [(i, near if i % 4 == 0 else title, [(f"zzyyx{chr(97 + i)}wv", "z")] if i % 7 else []) for i in range(9)] + [(200, far.replace("fair ", ""), [("elsewise", "e")])]
    p, e = spark.createDataFrame(p, f"pid long, tk string, who {who}"), spark.createDataFrame(e, f"eid long, tk string, who {who}")
    for hot in (works.HOT, 4, 0):
        works.HOT, was = hot, works.HOT
        try:
            got = [tuple(r) for r in works.candidates(p, e).collect()]
        finally:
            works.HOT = was
        assert sorted(got) == [(i, j) for i in range(12) for j in range(9)] + [(100, 200)]


def test_names_of_two_letters(spark):
    refs = spark.createDataFrame([(1, "Wei Li", "person"), (2, "Ann Wu", "person")], "author_id long, full_name string, kind string")
    p = spark.createDataFrame([("a", "Li, Wei; W. Li; Ann Wu; Wu A.; Wei Wu")], "arxiv_id string, authors string")
    c = spark.createDataFrame([("c", "li")], "arxiv_id string, surname string")
    assert sorted((r.author_pos, r.author_id) for r in names.link_authors(p, c, refs).collect()) == [(1, 1), (2, 1), (4, 2)]
