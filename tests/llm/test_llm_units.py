"""Pure-Python parts against brute force and literal cases."""

import random

import numpy as np
import pytest

from rankloom.llm import chars as C
from rankloom.llm import chunks as K
from rankloom.llm import leaks as L
from rankloom.llm import listings as G
from rankloom.llm import names as N
from rankloom.llm import spam as S
from rankloom.llm import tokens as E
from rankloom.llm import works as W


def test_visible_form():
    assert C.visible("Ｄｅｅｐ　Ｎｅｔｓ") == "Deep Nets"
    assert C.visible("résumé co­op​") == "résumé coop"
    assert C.visible("a‑b ﬁt") == "a-b fit"
    assert C.visible("x² – y") == "x² – y" and C.visible("") == ""
    assert C.mixed_tokens("Plain text") == [] and C.mixed_tokens("Привет мир") == []
    assert C.mixed_tokens("Nоisy А Clicks") == [("Nоisy", ["Noisy"]), ("А", ["A"])]
    # Armenian, Cherokee and phonetic letters; words of another script that aren't look-alikes throughout stay
    assert [f[0] for _, f in C.mixed_tokens("Nօisy Ꭲnput for nɑme trees")] == ["Noisy", "input", "name"]
    assert C.mixed_tokens("Learning Привет from дом data") == [] and C.mixed_tokens("On λ-calculus") == []
    assert C.script("を") == "HIRAGANA" and C.mixed_tokens("BERTを use") == []
    assert C.undo_mojibake("JosÃ©") == "José" and C.undo_mojibake("José") == "José"


def test_tokens_against_library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = E.PrefixEncoder(E.default_ranks())
    rng = random.Random(2)
    bits = ["a", "e", " ", "\n", "t", "th", "ing", "1", "é", "中", "​", "<|endoftext|>", "'s", "\x1c", "\xa0", "🙂", "..", "\t", " the", "ß"]
    for s in ["", "a" * 4000, " " * 500 + "x", *("".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(1500))]:
        assert e.encode(s).tolist() == t.encode(s, add_special_tokens=False).ids
    assert e.encode(None).tolist() == []


def test_cuts():
    rng = random.Random(1)
    bits = ["a", "bb ", "c. ", "\n", "\n\n", "\r\n", "## § 1 - x\n", "é", "x" * 16, "```\n", "。"]
    for _ in range(800):
        texts = ["".join(rng.choices(bits, k=rng.randrange(150))) for _ in range(3)]
        limit = rng.randrange(8, 80)
        overlap = rng.randrange(limit // 3 + 1)
        for t, c in zip(texts, K.greedy_cuts(texts, limit, overlap), strict=True):
            if not t:
                assert c == []
                continue
            assert c[0][0] == 0 and c[-1][1] == len(t) and all(0 < b - a <= limit for a, b in c)
            for (_, b), (x, y) in zip(c, c[1:], strict=False):
                assert x <= b < y and b - x <= overlap and (x < b or not overlap)
            assert len(t) > limit or len(c) == 1
    heads = "## § 1 - a\n```\n## § 2 - no\n```\n~~~\n## § 3 - no\n~~~\r\n## § 9 — b\n### § 1 - no\n"
    assert [heads[i : i + 10] for i in K.section_starts(heads)] == ["## § 1 - a", "## § 9 — b"]


def test_cuts_equal_step_by_step_greedy():
    """Pointer doubling marks the cuts that following the successors one by one gives."""
    text = " ".join("w" * random.Random(i).randrange(1, 9) for i in range(400))
    cuts = K.greedy_cuts([text], 100, 20)[0]
    for (a, b), (x, y) in zip(cuts, cuts[1:], strict=False):
        nxt = text[x : x + 100]
        assert y == len(text) or len(nxt) - len(nxt.rstrip(" ").rsplit(" ", 1)[-1]) - 1 <= y - x


NAMES = [
    ("Edmund M. Hesandomak", "person", ["E. M. Hesandomak", "Hesandomak, E.", "HESANDOMAK Edmund", "Ned Hesandomak", "EM Hesandomak", "EdmundHesandomak", "Edmund M. Hesandomka", "Dr. Edmund Hesandomak, PhD", "E.M.Hesandomak", "Edm. Hesandomak", "Edmund M. Hesandomak 0004"], ["Hesandomak", "Wei Hesandomak", "Edmund K. Hesandomak", "W. Hesandomak", "Edmund Lorandobek", ""]),
    ("Hui-Ying van der Zepebiuld", "person", ["H.-Y. van der Zepebiuld", "van der Zepebiuld, Hui-Ying", "Hui Ying van der Zepebiuld", "hui-yingvanderzepebiuld", "Hui-Ying v.d. Zepebiuld"], ["van der Zepebiuld", "Min-Jae van der Zepebiuld"]),
    ("Kalnzeholu Tokenisation Working Group", "group", ["The Kalnzeholu Tokenisation WG", "Tokenisation Working Group Kalnzeholu", "kalnzeholu-tokenisation working group team"], ["Kalnzeholu Ranking Working Group", "Kalnzeholu"]),
]


@pytest.mark.parametrize("full,kind,yes,no", NAMES)
def test_names(full, kind, yes, no):
    assert [n for n in yes if not N.means(n, full, kind)] == []
    assert [n for n in no if N.means(n, full, kind)] == []


def test_osa_is_the_edit_distance():
    assert [N.osa("abcd", x, 2) for x in ("abcd", "abdc", "abc", "xbcy", "xyzw", "")] == [0, 1, 1, 2, 3, 3]


def test_leak_embedding_and_check():
    cfg = L.LeakConfig()
    item = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(200)]
    doc = other[:50] + item[:20] + ["changed"] + item[21:34] + other[50:90]
    assert L.held_words(doc, item) >= 0.5
    assert L.held_words(other[:50] + item[:12] + other[50:], item) < 0.3
    assert L.held_words(other[:20] + item[:18] + other[20:90] + item[30:48] + other[90:], item) >= 0.5
    assert L.held_words([], item) == L.held_words(item, []) == 0.0
    assert L.strip_shared("Read this and answer. text number 3 goes on", {("read", "this", "and", "answer")}) == ["text", "number", "3", "goes", "on"]
    assert L.strip_shared("Read this. x", set()) == ["read", "this", "x"]
    assert [L.window_size(n) for n in (3, 27, 28, 42, 63, 98, 900)] == [3, 3, 4, 6, 9, 14, 14]
    # words at the ends of a run count, however short the piece between two changed words
    run = [f"w{i}" if i % 6 else "x" for i in range(60)]
    assert L.held_words(run, item) == 50 / 60
    # a text of the same pattern, of which every other word differs, holds next to nothing
    assert L.held_words([f"w{i}" if i % 2 else f"x{i}" for i in range(60)], item) < 0.2


def test_tables_reach_the_target_recall():
    for size in (4, 6, 9, 14):
        rates = L.hit_rates(size, L.LeakConfig())
        assert rates[L.tables_for(size, L.LeakConfig()) - 1] >= 0.95 and rates == sorted(rates)


def _brute(doc, item):
    """Best local alignment, cell by cell, over the whole rectangle."""
    cells, runs = {}, []
    for d, w in enumerate(doc):
        for k, v in enumerate(item):
            if v == w:
                cand = [(cells[d0, k0][0] + 1 - L.COST * (max(d - d0, k - k0) - 1), cells[d0, k0][1] + 1, *cells[d0, k0][2:]) for d0 in range(d - L.GAP - 1, d) for k0 in range(k - L.GAP - 1, k) if (d0, k0) in cells]
                cells[d, k] = max([(1.0, 1, k, d), *cand], key=lambda c: c[:2])
                runs.append((cells[d, k][1], cells[d, k][2], k + 1, cells[d, k][3]))
    runs = [r for r in runs if r[0] >= min(L.RUN, len(item))]
    return max([r[0] for r in runs] + [t + t2 - max(0, z - a2) for t, _, z, ds in runs for t2, a2, _, ds2 in runs if a2 >= z - 2 and ds2 > ds], default=0) / len(item)


def test_recall_of_leaks_against_brute_force():
    """Items of 40 to 120 words held by 0.55 and more at a change rate of 0.16: candidates and check together find nine tenths and more of what exhaustive alignment finds."""
    rng, cfg = np.random.default_rng(7), L.LeakConfig()
    found = true = 0
    for _ in range(250):
        n = int(rng.integers(40, 120))
        item = [f"i{x}" for x in rng.integers(0, 4000, n)]
        noise = lambda m: [f"n{x}" for x in rng.integers(0, 4000, m)]
        spoil = lambda ws: [x for w in ws for x in ([w] if rng.random() > 0.16 else noise(1) if rng.random() < 0.5 else [])]
        h = int(n * 0.34)
        a = int(rng.integers(0, n - 2 * h + 1))
        doc = noise(40) + spoil(item[a : a + h]) + noise(30) + spoil(item[n - h :]) + noise(40)
        if _brute(doc, item) < 0.5:
            continue
        true += 1
        ix = L._Index([(1, item)], cfg)
        if ix.candidates(*L._flat([doc], {}), cfg):
            found += L.held_words(doc, item) >= 0.5
    assert true > 80 and found >= 0.97 * true


def test_alignment_equals_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        item, doc = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 22))], [rng.choice("abcdefghxyz") for _ in range(rng.randrange(0, 40))]
        held = L.held_words(doc, item)
        assert L.Bounds(doc).allow(item, held)  # the bounds never refuse what the alignment grants
        assert abs(held - _brute(doc, item)) <= 1 / len(item) + 1e-9  # ties of score may keep another run of the same


def test_second_run_is_found_beside_many_repetitions():
    item = [f"w{i}" for i in range(60)]
    doc = [x for r in range(41) for x in [*item[:17], *(f"v{r}x{i}" for i in range(9))]] + item[30:46]
    assert L.held_words(doc, item) == 33 / 60
    rng = random.Random(5)
    for _ in range(400):
        runs = []
        for _ in range(rng.randrange(1, 25)):
            a = rng.randrange(30)
            z = a + rng.randrange(5, 20)
            runs.append((rng.randrange(5, z - a + 1), a, z, rng.randrange(40)))
        pairs = [t + t2 - max(0, z - a2) for t, _, z, ds in runs for t2, a2, _, ds2 in runs if a2 >= z - 2 and ds2 > ds]
        assert L.best_ordered(runs) == max([r[0] for r in runs] + pairs)


NORMS = S.Norms({"en": frozenset("the a and it is to of for with that on my we was at after in this be could".split())}, {"en": 0.33}, {"en": 0.185}, {"en": 1 / 3})


def spam(text, norms=NORMS):
    langs, owners = norms.owners()
    x = S.measure(text, owners, len(langs))
    share, sure = S.judge(x, np.zeros(len(x), dtype=np.int64), 1, norms)
    return float(share[0]), bool(sure[0])


def test_spam():
    prose = "The tuner arrived on time and it works well with my old guitar, although the clip could be a bit stronger. " * 3
    assert spam(prose)[0] < 0.2
    bad = ["cheap mouse mat online, buy flash cards sale, discount memory card, " * 6, "- [cheap mat](https://a.example/1)\n" * 9, "https://a.example/x/1\n" * 9, "Home > Books > Cards\n" * 9, "#flash-cards #cheap-cards #buy_cards " * 8, "Buy flash cards here because flash cards deals on flash cards beat every flash cards. " * 5]
    bad += ["cheap mouse mat, buy flash cards, discount memory card, mouse pad sale", "| mat 4.20 USD | cards 9.90 USD | pad 3.10 USD |\n" * 9, "HOL electronic gauge 42.39 USD in stock add cart\nTAM week organiser 66.79 USD in stock add cart\n" * 3]
    for t in bad:
        share, sure = spam(t)
        assert share > 0.5 and sure, t
    assert spam("") == (0.0, True) and spam(" \n")[0] == 0.0
    assert spam(prose + "\n\nKeywords: a, b, c\n[1] https://x.example/1\n")[0] < 0.5
    assert spam(prose + "\n| a | b |\n| 1 | 2 |\n" * 20)[0] < 0.5
    # cut texts: too little to tell
    for t in ("Replacing hypergraph conv", "Earlier drafts blame", "Next idea: swap graph neural networks for", "本文提出HOL-Ive，用于冷启动排序，并在Kesifazepa-22M上"):
        share, sure = spam(t)
        assert share <= 0.5 or not sure, t
    assert spam("Readers reported higher trust among several groups of listeners here", S.Norms())[0] == 0.0  # nothing learnt, nothing proved


def test_norms_come_from_the_table():
    langs, owners = NORMS.owners()
    x = np.concatenate([S.measure("We saw that the method of this paper is good for the task. " * 20, owners, 1), S.measure("mat, cards, pads, pens, books, bags", owners, 1)])
    n = S.norms_of(NORMS.words, S._histograms(x, langs))
    assert abs(n.median["en"] - 8 / 13) < 0.01 and n.repeated["en"] == 1 / 3 and n.separators["en"] < 0.02
    # cut of the bound of chance: no function word among twelve proves it, among five it doesn't
    odds = S._log_odds(np.array([0.0, 0.0, 4.0]), np.array([12.0, 5.0, 12.0]), np.array([0.33, 0.33, 0.33]))
    assert odds[0] >= S.PROOF > odds[1] and odds[2] == 0.0


def test_listing_fields():
    p = G.parse("Lorenigali Hesammalund piano keyboard rack / 55.1\" / 120g", ["0.12 kg", "Tested in 30 workshops"], ["Colour of this piano keyboard rack: sunny yellow."], ["lorenigali"], ["piano keyboard rack"], ["piano", "keyboard", "rack"], ["lorenigali"], [])
    assert (p["brand"], p["line"], p["colour"], p["weight"], round(p["length"])) == ("lorenigali", "hesammalund", "yellow", 120.0, 1400)
    assert G.parse("Bosch Ixo drill", [], [], ["bosch"], [], ["drill"], ["bosch"], [])["line"] == "ixo" and G.parse("Sony Alpha tent", [], [], ["sony"], [], ["tent"], [], [])["line"] == "alpha"
    p = G.parse(None, None, None, None, None, None, None, None)
    assert p["brand"] is None and p["line"] is None
    assert G.parse("40 sheets (80 pages), dozen, 1.7 Fl. Oz", [], [], [], [], [], [], [])["extent"] == 80.0
    assert G.shared_runs(["cheap", "music", "stand", "ixo"], ["cheap", "music", "stand"], ["Every music stand. Stand by", "cheap"]) == ["cheap", "music stand"] and G.shared_runs(None, None, None) == []
    assert [G.errors(a, b) for a, b in (("ixo", "ixe"), ("sony", "sonny"), ("kalntoyore", "kalntoyo"))] == [0, 1, 2]


def test_title_and_author_similarity():
    a = W.title_key("<i>Na\\\"{i}ve</i> POI Discovery &amp; MoE")
    assert a == "naive point of interest discovery and mixture of experts"
    assert min(W.title_match("graph neural networks for ads", "gnns for ads", False, False)) == 1.0
    assert W.title_match("deep nets for music disc", "deep nets for music discovery in silos", True, False)[0] == 1.0
    assert W.title_match("deep nets for ads", "wide trees for ads", False, False)[0] < 0.6
    assert W.title_match("", "x", False, False) == (0.0, 0.0)
    sims = [W.author_similarity("Edmund P. Cörandoren", x) for x in ("corandoren", "CORANDOREN, E.", "Wei Cörandoren", "Kalandolund", "", "Edmund Cörandoren")]
    assert [round(s, 2) for s in sims] == [0.9, 0.95, 0.2, 0.0, 0.5, 1.0]


def test_short_surnames():
    assert W.author_similarity("Wei Li", "Wei Li") == W.author_similarity("Soo Kim", "Kim, Soo") == 1.0
    assert W.author_similarity("Ann Wu", "wu") == 0.9 and W.author_similarity("Wei Li", "Li Wei") == 1.0
    assert max(W.author_similarity("Soo Kim", "Soo Lim"), W.author_similarity("Wei Li", "Wei Wu")) <= 0.2
    assert W.surnames("Wei Li") == [("li", "w"), ("wei", "l")] and W.surnames("Li, Wei") == [("li", "w")] and W.surnames("wu") == [("wu", "")]
    for full, yes, no in (("Wei Li", ["Li, Wei", "W. Li", "Li Wei", "li wei"], ["Wei Lu", "Ann Li", "Li"]), ("William Wu", ["Bill Wu", "Wu, W."], ["Ann Wu"]), ("Soo Kim", ["S. Kim", "KIM Soo"], ["Soo Lim"])):
        keys = set(N.reference_keys(full, "person"))
        assert [n for n in yes if not N.means(n, full, "person") or not keys & set(N.name_keys(n))] == []
        assert [n for n in no if N.means(n, full, "person")] == []


def test_unknown_authors_in_the_mixture():
    """What a component expects in place of an unknown author similarity is the regression on the known dimensions."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(5, 5))
    cov, mean = a @ a.T + np.eye(5), np.arange(5.0)
    x = rng.multivariate_normal(mean, cov, 4000)
    y = x.copy()
    y[:, W._AUTHOR] = W.UNKNOWN
    z, rest = W.expected(y, mean, cov)
    assert abs(np.mean((z - x)[:, W._AUTHOR])) < 0.1 and abs(np.var((z - x)[:, W._AUTHOR]) / rest - 1) < 0.1


def test_clusters_never_contradict():
    """The summaries of clusters refuse exactly what a comparison of all members refuses, and large runs come in pieces."""
    import pandas as pd

    rng = random.Random(3)
    for _ in range(20):
        n = 40
        g = pd.DataFrame({f: [rng.choice([None, "a", "b"]) if f == "colour" else "same" for _ in range(n)] for f in G.STRINGS})
        for f in G.NUMBERS:
            g[f] = [rng.choice([np.nan, 100.0, 102.0, 104.5, 120.0]) if f in ("length", "pieces") else np.nan for _ in range(n)]
        g["copies"] = 1
        n_f = len(G._ORDER)
        label = G.cluster_blocks(g, np.array([0]), np.array([n]), {"share": 0.5, "m": np.tile([0.05, 1.0, 0.95], (n_f, 1)), "u": np.tile([0.6, 1.0, 0.4], (n_f, 1))})
        codes, numbers = G._arrays(g)
        i, j = np.triu_indices(n, 1)
        bad = (G._levels(codes, numbers, i, j) == 0).any(1)
        assert not (bad & (label[i] == label[j])).any() and len(set(label)) < n
    pairs = [(int(x), int(y)) for i, j in G._pairs(np.array([0, 5]), np.array([5, 60]), 100) for x, y in zip(i, j, strict=True)]
    assert len(pairs) == len(set(pairs)) == 10 + 1770 and all(x < y for x, y in pairs)
