"""Each operator against a plain version on small data with nulls, repeats, ties and clashing columns."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.operators import spread
from termweave.llm import encode, frequency, leaks, pairs, residue, similar, topn


def extra(frame):
    """With columns whose names clash with the operators' own."""
    return frame.withColumn("n", F.lit("x")).withColumn("size", F.lit(None).cast("string")).withColumn("part", F.lit(1)).withColumn("kind", F.lit("k"))


def test_top_n_with_ties_nulls_and_a_large_group(spark):
    pick = random.Random(1)
    rows = [("big" if pick.random() < 0.4 else f"g{pick.randint(0, 40)}", f"i{pick.randint(0, 60)}", pick.choice([0.1, 0.2, 0.3, -0.0, 0.0, None, math.nan])) for _ in range(3000)]
    rows += [(None, "a", 0.1), ("g1", None, 0.1), ("", "only", 5.0)] + rows[:50]
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best.setdefault(g, {}).setdefault(i, s)
            best[g][i] = min(best[g][i], s)
    wanted = {(g, i, p) for g, items in best.items() for p, (i, _) in enumerate(sorted(items.items(), key=lambda x: (x[1], x[0]))[:5], 1)}
    frame = extra(spark.createDataFrame(rows, "grp string, item string, score double").repartition(7))
    assert {(r.grp, r.item, r.position) for r in topn.top_n(frame, 5).collect()} == wanted
    assert topn.top_n(frame.where("false"), 5).count() == 0


def test_term_frequency(spark, monkeypatch):
    monkeypatch.setattr(frequency, "TASK_TOKENS", 700)
    pick = random.Random(2)
    rows = [(pick.choice("fg"), f"r{pick.randint(0, 30)}", pick.choice(["hot"] * 5 + ["", "a", "b", "ä"])) for _ in range(4000)]
    wanted = {}
    for f, r, t in rows:
        seen = wanted.setdefault((f, t), [0, set()])
        seen[0] += 1
        seen[1].add(r)
    frame = extra(spark.createDataFrame(rows + [(None, "r1", "a"), ("f", None, "a"), ("f", "r1", None)], "field_name string, record string, term string").repartition(5))
    out = frequency.term_frequency(frame)
    assert {(r.field_name, r.term): (r.occurrences, r.records) for r in out.collect()} == {k: (n, len(s)) for k, (n, s) in wanted.items()}
    assert frequency.term_frequency(frame.where("false")).count() == 0
    marks = frequency.marked(spark.createDataFrame([("f", "a", 9, 1), ("f", "b", 9, 2), ("f", "c", 9, 5)], "field_name string, term string, occurrences long, records long"), 8)
    assert [r.mark for r in marks.orderBy("term").collect()] == ["rare", None, "common"]


def poisson_binomial_tail(chances, k):
    dist = np.array([1.0])
    for p in chances:
        dist = np.convolve(dist, [1 - p, p])
    return dist[k:].sum()


def test_tails_follow_the_exact_distribution():
    pick = np.random.default_rng(3)
    for _ in range(60):
        p, weight = pick.uniform(0.001, 0.6, 4), pick.integers(1, 30, 4)
        chances = np.repeat(p, weight)
        k = int(pick.integers(1, len(chances)))
        mean, tail = pairs.upper_tails(p[None, :], weight.astype(float), np.array([float(k)]))
        exact = poisson_binomial_tail(chances, k)
        assert math.isclose(mean[0], chances.sum(), rel_tol=1e-9)
        assert math.isclose(tail[0], exact, rel_tol=0.06, abs_tol=1e-12), (k, tail[0], exact)


def log_binomial_tail(n, p, k):
    """ln P(X >= k), summed from the greatest term."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, k + 400)]
    return max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))


@pytest.mark.parametrize("p,k", [(1e-6, 12), (1e-5, 50), (1e-4, 205), (1e-3, 1320), (1e-6, 22), (3e-7, 5)])
def test_tails_of_a_million_records(p, k):
    wanted = log_binomial_tail(10**6, p, k)
    mean, tail = pairs.upper_tails(np.array([[p, 0.0]]), np.array([1e6, 5.0]), np.array([float(k)]))
    assert math.isclose(mean[0], 1e6 * p, rel_tol=1e-9) and abs(math.log(tail[0]) - wanted) < 0.06, (math.log10(tail[0]), wanted / math.log(10))


def test_error_of_classes_above_the_exact_ones():
    """Frequencies that share a class: how far ln p is off for pairs nine standard deviations above their expected count."""
    records, worst = 10**6, 0.0
    for f in (520, 700, 1500, 6000, 40_000):
        low = 512 * math.exp(math.floor(math.log(f / 512) * pairs.ITEM_STEPS) / pairs.ITEM_STEPS)
        middle = low * math.exp(1 / pairs.ITEM_STEPS / 2)
        for a in (low, middle, low * math.exp(1 / pairs.ITEM_STEPS)):
            count = math.ceil(middle**2 / records + 9 * middle / records**0.5 + 5)
            tails = [pairs.upper_tails(np.array([[x * x / records**2]]), np.array([float(records)]), np.array([count]))[1][0] for x in (a, middle)]
            worst = max(worst, abs(math.log(tails[0]) / math.log(tails[1]) - 1))
    print("worst", worst)
    assert worst < 0.04


def test_pair_counts_null_and_rates(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 6)
    monkeypatch.setattr(spread, "HOT_ROWS", 30)
    pick = random.Random(4)
    baskets = {f"r{i}": {f"i{int(abs(pick.gauss(0, 5)))}" for _ in range(pick.choice([0, 1, 3, 30]))} | ({"x", "y"} if i % 9 == 0 else set()) for i in range(120)}
    rows = [(r, i) for r, items in baskets.items() for i in items]
    frame = extra(spark.createDataFrame(rows + rows[:40] + [(None, "i1"), ("r1", None)], "record string, item string"))
    wanted = {}
    for items in baskets.values():
        for a, b in itertools.combinations(sorted(items), 2):
            wanted[a, b] = wanted.get((a, b), 0) + 1
    out = pairs.cooccurrence(frame, len(baskets)).collect()
    assert {(r.item_a, r.item_b): r.n_both for r in out} == wanted
    single = {i: sum(i in s for s in baskets.values()) for i in {i for s in baskets.values() for i in s}}
    assert all(r.n_a == single[r.item_a] and r.n_b == single[r.item_b] and math.isclose(r.lift, r.n_both * 120 / (r.n_a * r.n_b)) for r in out)
    ps, total = sorted(r.p_value for r in out), len(single) * (len(single) - 1) // 2
    for r in out:
        assert math.isclose(r.q_value, min(1, min(p * total / sum(x <= p for x in ps) for p in ps if p >= r.p_value)), rel_tol=1e-9)
    assert min(out, key=lambda r: r.p_value)[:2] == ("x", "y")
    some = {(r.item_a, r.item_b): r.n_both for r in pairs.cooccurrence(frame, 120, 5).collect()}
    assert some == {k: n for k, n in wanted.items() if n >= 5}
    assert pairs.cooccurrence(frame.where("false"), 0).count() == 0


def test_rates_of_p1_are_over_all_pairs(spark, tmp_path):
    from termweave.llm import queries

    pick = random.Random(8)
    genes = [(f"G{i}", sorted({f"k{int(abs(pick.gauss(0, 6)))}" for _ in range(3)}), [], "") for i in range(60)]
    spark.createDataFrame(genes, "id string, keywords array<string>, protein_names array<string>, function_text string").write.parquet(f"{tmp_path}/gene.parquet")
    out = queries.p1_pairs(spark, str(tmp_path)).collect()
    n = len({k for g in genes for k in g[1]})
    total, ps = n * (n - 1) // 2, [r.p_value for r in out]
    assert len(ps) < total
    for r in out:
        assert math.isclose(r.q_value, min(1, min(p * total / sum(x <= p for x in ps) for p in ps if p >= r.p_value)), rel_tol=1e-9)


def test_similar_sets(spark, monkeypatch):
    monkeypatch.setattr(similar, "MAX_SUBSETS", 20)
    monkeypatch.setattr(spread, "HOT_ROWS", 25)
    pick = random.Random(5)
    base = [[f"v{pick.randint(0, 60)}" for _ in range(pick.randint(2, 14))] for _ in range(40)]
    sets = {}
    for i in range(220):
        s = set(pick.choice(base))
        for _ in range(pick.randint(0, 2)):
            s.add(f"v{pick.randint(0, 60)}")
        if pick.random() < 0.3:
            s.discard(next(iter(s)))
        sets[f"r{i}"] = s
    rows = [(r, v) for r, s in sets.items() for v in s]
    frame = extra(spark.createDataFrame(rows + rows[:30] + [(None, "v1"), ("r1", None)], "record string, value string"))
    big = {r: s for r, s in sets.items() if len(s) >= 4}
    wanted = {(a, b) for a, b in itertools.combinations(sorted(big), 2) if 10 * len(big[a] & big[b]) >= 7 * len(big[a] | big[b])}
    members, classes = similar.set_classes(frame, 4)
    linked = similar.similar_classes(classes, 7, 10, 4)
    assert {tuple(r) for r in similar.record_pairs(members, linked).collect()} == wanted
    links = {r.record: r for r in similar.class_links(members, classes, linked).collect()}
    assert set(links) == set(big) and all(links[r].n_links == sum(r in p for p in wanted) for r in big)
    assert all(links[r].class_id == min(x for x in big if big[x] == big[r]) for r in big)
    assert similar.set_classes(frame.where("false"), 4)[1].count() == 0


def test_encoding_joins_anywhere(spark, monkeypatch):
    coder = encode.coder(f"{encode.FOLDER}/{encode.VOCABULARY}")
    plain = coder.encode
    pick = random.Random(6)
    alphabets = [" \n\t'sabtreé字1 2 .,! \u3000\x1c\x85'll're", "abcdefghijklmnopqrstuvwxyz", "etaoin", "字語漢春天的早晨", "01", "!'s", " \n", "😀é", "a'ls1"]
    for leaf in (1, 3, 8, 40):
        monkeypatch.setattr(encode, "LEAF", leaf)
        for n in range(400):
            text = "".join(pick.choice(alphabets[n % len(alphabets)]) for _ in range(pick.randint(0, 300)))
            assert coder.encoded(text) == plain(text), (leaf, text)
            cuts = sorted(pick.sample(range(len(text) + 1), min(3, len(text))))
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
            assert coder.reduced([plain(p) for p in parts if p]) == plain(text)
    monkeypatch.setattr(encode, "SEGMENT", 50)
    texts = [None, "", " ", "short <|endoftext|> text", "don't stop " * 60, "x" * 130, "short <|endoftext|> text"]
    frame = extra(spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = sorted((r.doc_id, list(r.ids)) for r in encode.encode_texts(frame).collect())
    assert got == sorted((i // 2, plain(t) if t else []) for i, t in enumerate(texts))
    back = encode.decode_ids(spark.createDataFrame([(1, plain("Ünï 字")), (2, []), (3, None)], "doc_id long, ids array<int>"))
    assert {r.doc_id: r.text for r in back.collect()} == {1: "Ünï 字", 2: "", 3: ""}


def test_windows_stay_small_in_a_text_without_blanks():
    coder = encode.coder(f"{encode.FOLDER}/{encode.VOCABULARY}")
    pick = random.Random(10)
    text = "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    wanted = coder.encode(text)
    done = []
    plain, coder.encode = coder.encode, lambda t: done.append(len(t)) or plain(t)
    try:
        assert coder.encoded(text) == wanted
    finally:
        coder.encode = plain
    assert sum(done) < 1.2 * len(text)


ITEM = "Late in autumn, Kekartbias sketched 822 gendpeonddoils using wooden spoons, because Staendiarqua produces some 443 queondhiaglurors for Panddrialsund."
HEAD = "\n\n{}\n00:00:{:02d},100 --> 00:00:{:02d},900\n"


def cues(parts):
    return "".join(HEAD.format(i, i, i + 1) + p for i, p in enumerate(parts, 1))


def test_quotations(spark):
    words = ITEM.split()
    shuffled = words[:]
    random.Random(7).shuffle(shuffled)
    texts = {
        1: cues([" ".join(words[:6]), "<i>Wait.</i>", " ".join(words[6:12]), " ".join(words[12:])]),
        2: cues(["- " + " ".join(words[:8]).upper(), "NARRATOR: " + " ".join(words[8:]).replace("because", "becuase").replace("wooden", "woden").replace("produces", "prodcues")]),
        3: cues([" ".join(words[:4]), "We burned the dog."]),
        4: cues([" ".join(shuffled)]),
        5: cues([" ".join(words[:3]) + " nothing else. " * 60 + " ".join(words[10:])]),
        6: "",
        7: None,
        8: "x" * 20_000,
        9: " ".join(words),
    }
    documents = extra(spark.createDataFrame([*texts.items(), (9, " ".join(words))], "doc_id long, text string"))
    items = extra(spark.createDataFrame([(5, ITEM), (6, "Another thing altogether."), (7, ""), (8, None)], "item_id long, item_text string"))
    got = leaks.quotations(documents, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 5), (2, 5), (9, 5), (9, 5)]
    first = next(r for r in got if r.doc_id == 9)
    assert texts[9][first.start : first.end] == ITEM and first.words_common == len(leaks.words_of(ITEM))
    assert leaks.quotations(documents, items.where("false")).count() == 0


def test_quotations_of_ordinary_short_and_other_script_items(spark):
    plain = "The man with the old dog went down to the river and sat there until the night came over the hill"
    words = plain.split()
    slipped = " ".join(w[:-1] if i % 2 and len(w) >= 4 else w for i, w in enumerate(words[:13]))
    items = [(i, f"{plain} {i}") for i in range(30)] + [(100, "Ferry timetable"), (101, "Старый паром медленно пересёк холодную реку перед самым рассветом")]
    russian = items[-1][1]
    texts = {
        1: cues(["Well.", " ".join(words[:9]), " ".join(words[9:])]), 2: cues([slipped]), 3: cues(["They burned the timetables."]), 4: cues([russian]),
        5: cues([russian.encode("cp1251").decode("latin-1")]), 6: cues([" ".join(reversed(words))]), 7: cues(["We burned the dog."]), 8: cues(["Он купил новую лодку, и всё."]),
    }
    wanted = {(d, i) for d in (1, 2) for i in range(30)} | {(3, 100), (4, 101), (5, 101)}
    got = leaks.quotations(spark.createDataFrame([*texts.items()], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted


def test_one_splitter_gives_words_and_offsets():
    pick = random.Random(9)
    letters = "ab 'Ré\n\t-字 и!\u3000\xa0\x1crnll1|"
    for _ in range(300):
        text = "".join(pick.choice(letters) for _ in range(40))
        placed = leaks.placed_words(text)
        assert leaks.words_of(text) == [w for w, _, _ in placed]
        assert all(0 <= a < b <= len(text) and text[a:b].strip() for _, a, b in placed)


CASES = {
    1: "Северный олень переплыл широкую реку ранней весной",
    2: "春天的早晨老人独自坐在河边钓鱼",
    3: "Hasta luego",
    4: "Seven green bottles",
    5: "Twenty grey geese crossed the frozen lake at dusk",
    6: "Twenty grey geese crossed the frozen lake at dusk",
}


def test_items_quoted_word_for_word(spark):
    items = [*CASES.items(), *((10 + i, f"What is the capital city of {x}?") for i, x in enumerate("Peru Chad Mali Oman Cuba Fiji Iraq Laos Togo Niue".split()))]
    texts = [(i, cues(["Well.", t, "Go on."])) for i, t in items]
    got = {(r.doc_id, r.item_id): r for r in leaks.quotations(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()}
    assert all((i, i) in got for i, _ in items) and (5, 6) in got and (6, 5) in got
    text = texts[4][1]
    assert text[got[5, 5].start : got[5, 5].end] == CASES[5]


def test_residue(spark):
    case = {
        "Subtitles by {{ name }}": True, "Hello ${user}, welcome back.": True, "%1$s": True, "Synced for {0} on {0}": True, "by [INSERT TITLE HERE]": True, "by <SPEAKER>": True,
        "by (((имя_переводчика)))": True, "by *TU TEXTO AQUÃ\x8d*": True, "Lorem ipsum dolor sit amet.": True, "Error 404: página no encontrada": True, "Sorry. 502 Bad Gateway (code 7)": True,
        "Please enable JavaScript\nto view the captions.": True, "Îøèáêà 500: ñòðàíèöà íå íàéäåíà": True, "null": True, "[object Object]": True, "<html><body>no</body></html>": True, "Plaoeholder line": True,
        "I wrote {curly} braces on the board.": False, "{\\an8}Error. Error. That's all the machine says.": False, "[NAME CALLED OVER SPEAKER]": False, "You have to enable JavaScript, grandpa.": False,
        "He printed lorem ipsum on all the cards.": False, "She scored 100% again, 100%!": False, "(ERROR BEEP)": False, "Watch more at www.x.example - no sign-up": False, "♪ la la ♪": False, "Not now.": False,
    }
    rows = [(i, cues(["Who's there?", t, "Wait."]), f"s{i % 3}") for i, t in enumerate(case)]
    rows += [(100, None, None), (101, "", "s"), (102, " \n ", "s"), (103, "1\r\n00:01 - 00:02\r\n\r\nnull\r\n", None)]
    frame = extra(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = {r.doc_id for r in residue.residue_documents(frame).collect()}
    assert found == {i for i, wanted in enumerate(case.values()) if wanted} | {103}
    assert residue.residue_documents(frame.where("false")).count() == 0


def test_residue_in_other_words(spark):
    case = {
        "Page not found": True, "An error has occurred.": True, "Turn on scripts to continue.": True, "HTTP/1.1 410 Gone": True, "Página não encontrada": True, "Pagina non trovata": True,
        "Your session has expired, please log in again. Contact the administrator.": True, "Impossible de charger la page": True, "Ñòðàíèöà íå íàéäåíà": True, "JavaScript vereist": True,
        "Praesent Lorem ipsum dolor sit amet, consectetur banana elit": True,
        "The session expired an hour ago, your honour.": False, "The page said four-oh-four, page not found, so I drove here myself.": False, "I can't see the page.": False, "No connection.": False, "We need access.": False,
        "Access denied, says the robot, and then it opens the door anyway.": False, "Lorem ipsum is not Latin, Clara, it's nonsense.": False, "Error. Error.": False, "Gone.": False, "Tu dois activer JavaScript, papi.": False,
    }
    rows = [(i, cues(["Who's there?", t, "Wait."])) for i, t in enumerate(case)]
    rows += [(100, cues(["Wait.", "The page you are looking", "for could not", "be found.", "Who?"])), (101, cues(["The page you are looking at", "for an hour", "was found."])), (102, cues(["Please enable JavaScript", "to view the captions."]))]
    rows += [(103, cues(["Из-за ошибки", "страница не найдена"]))]
    # a wrong encoding may leave no letter; such messages must not be taken for one another
    rows += [(200, cues(["\u2564\u042b \u2553\u2555\u2550", "\u256c\u256a\u255a\u2534\u2569\u2514 \u2560\u2568\u255a \u255f\u2514\u251c\u2568\u2559\u255f\u2569\u253c"])), (201, cues(["\u252c\u2550\u2559\u2565\u2568\u253c\u2550\u2550\u2580\u2580 \u256c\u256a\u255a\u2534\u2569\u2514 \u2567\u2568\u255a \u255f\u2514\u251c\u2568\u2559\u255f\u2569\u253c"]))]
    case_more = {201}
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    found = {r.doc_id for r in residue.residue_documents(frame).collect()}
    assert found == {i for i, wanted in enumerate(case.values()) if wanted} | {100, 102, 103} | case_more


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p2_classes", "p3_terms", "p5_top", "p6_roundtrip"])
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    from termweave.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}'")
    frame = queries.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, frame.select(columns).collect()))) == sorted(map(str, wanted))
