import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refrain.llm import decontamination, html_text, language_id, line_templates, near_duplicates, shingles, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, k int, component string, n_dropped string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1, "clash", "clash") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# Near duplicates


def plain_components(rows, n, percent):
    sets = []
    for i, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    comp = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return {i: (len(s), comp.get(i)) for i, s in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_brute_force(spark, n, percent):
    rng = random.Random(n)
    rows = [(0, None), (1, ""), (2, " \t "), (3, "one"), (4, "ONE "), (5, "two words"), (None, "one"), (6, "word " * 30_000)]
    for g in range(6):  # chains of edits: members at the far ends are linked through others only
        base = words(rng, rng.choice([8, 60, 200]))
        for _ in range(18):
            rows.append((len(rows) + 10, " ".join(base)))
            base = list(base)
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = f"x{rng.random()}"
    rows += [(len(rows) + 10 + k, " ".join(words(rng, 50))) for k in range(40)]
    rng.shuffle(rows)
    got = near_duplicates.near_duplicates(frame(spark, rows), words=n, percent=percent).collect()
    want = plain_components(rows, n, percent)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_large_group_is_settled_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PROBES", 8)
    monkeypatch.setattr(near_duplicates, "BASES", 16)
    rng = random.Random(5)
    base = words(rng, 60)
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randrange(7)):
            t[rng.randrange(60)] = f"y{rng.random()}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(frame(spark, rows), words=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows, 3, 85).items()}


def test_texts_that_share_an_id_link_what_each_links(spark):
    rng = random.Random(8)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = lambda w: " ".join([*w[:-1], f"z{rng.random()}"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (9, near(b)), (11, " ".join(c)), (11, " ".join(c)), (12, near(c)), (None, near(c)), (None, " ".join(words(rng, 30)))] * 3
    got = near_duplicates.near_duplicates(frame(spark, rows), words=3, percent=85).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True), (12, 11, False), (None, None, True)}


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(9)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = lambda w: " ".join([*w[:-1], f"z{rng.random()}"])
    rows = [(4, near(a)), (3, " ".join(a)), (None, near(a)), (None, " ".join(b)), (None, near(b)), (6, None), (6, ""), (8, " ".join(c)), (8, "another text")]
    clash = frame(spark, rows * 3).withColumnsRenamed({"k": "copy", "component": "__doc", "doc": "__key"})
    got = near_duplicates.drop_near_duplicates(clash)
    assert got.columns == clash.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([rows[1], *[r for r in kept if r[0] is None], *rows[5:7] * 3, *rows[7:]], key=str)
    assert sum(r[0] is None for r in kept) == 1 and near_duplicates.drop_near_duplicates(clash.limit(0)).count() == 0


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.near_duplicates(frame(spark, [])).count() == 0


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = np.unique(h[:1200]), np.unique(h[300:])
    true = 900 / 1500
    assert abs((shingles.signature(a, 512) == shingles.signature(b, 512)).mean() - true) < 0.08


def test_words_split_at_ascii_space_only():
    _, counts = shingles.word_hashes(pa.array([" a b ", "a\xa0b", None, "", "\x0b\x0c a", "É é E e"]))
    assert counts.tolist() == [2, 1, 0, 0, 1, 4]
    hashes, _ = shingles.word_hashes(pa.array(["É é E e"]))
    assert len(set(hashes.tolist())) == 3


# Line templates


def test_recurring_templates(spark):
    rows = [(i, f"Posted on {i} May by user{i}\n{'abcdef'[i]} line of {'ghijkl'[i]} own\nshort one {'abcdef'[i]}\n") for i in range(4)]
    rows += [(10, None), (11, ""), (None, "Posted on 9 May by user9"), (12, "the same line here again\n" * 3), (13, "Posted  on\t7 May by user7")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.drop_recurring_lines(frame(spark, rows)).collect()}
    assert got[0] == (rows[0][1], 0)  # the first document keeps its line
    for i in (1, 2, 3):
        assert got[i] == (f"{'abcdef'[i]} line of {'ghijkl'[i]} own\nshort one {'abcdef'[i]}\n", 1)
    assert got[10] == (None, 0) and got[11] == ("", 0) and got[None] == ("", 1) and got[13] == ("", 1)
    assert got[12] == (rows[-2][1], 0)  # one document, however often it repeats a line
    assert line_templates.drop_recurring_lines(frame(spark, [])).count() == 0


def test_recurring_short_lines(spark):
    rows = [(i, f"All rights reserved.\nLes.\npage {i}\n\nown line number {'abcd'[i]} here") for i in range(4)] + [(9, "Les. ")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.drop_recurring_lines(frame(spark, rows), constant=0.9).collect()}
    assert got[0] == (rows[0][1], 0) and got[9] == ("", 1)
    for i in (1, 2, 3):  # what a mask would make equal stays, as does an empty line
        assert got[i] == (f"page {i}\n\nown line number {'abcd'[i]} here", 2)


def test_fields_are_generalised_in_the_leaf(spark):
    people = ["Anna", "Ben", "Carla", "Dora"]
    rows = [(i, f"Posted by {p} today\nown text of {p} that is said only once and nowhere else in any other words {i}x") for i, p in enumerate(people)]
    rows += [(10 + i, f"Posted by nobody in {w} of the house") for i, w in enumerate(["room", "hall"])]  # two values are no field
    rows += [(20 + i, f"It was {a} {b} {c}") for i, (a, b, c) in enumerate(zip("abcd", "efgh", "ijkl", strict=True))]  # running text
    drop = lambda **kw: {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(frame(spark, [(i, t.split("\n")[0]) for i, t in rows]), **kw).collect()}
    assert drop() == {i: int(i in (1, 2, 3)) for i, _ in rows}
    assert drop(distinct=4) == dict.fromkeys([i for i, _ in rows], 0)
    assert drop(depth=3) == dict.fromkeys([i for i, _ in rows], 0)  # names lead to leaves of their own


def test_long_lines_recur_in_two_documents(spark):
    passage = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.drop_recurring_lines(frame(spark, [(1, f"{passage}\nend"), (2, f"start\n{passage}"), (3, passage + " more")])).collect()}
    assert got == {1: (f"{passage}\nend", 0), 2: ("start", 1), 3: (passage + " more", 0)}


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    rows = [(i, f"Posted on {i} May\nbody {'abcd'[i]}") for i in range(4)] + [(5, "Posted on 5 May\nunique a"), (5, "unique b\nunique c"), (None, "unique d\nPosted on 7 May"), (None, "unique e\nunique f")]
    want = [(i, t if i == 0 else "\n".join(x for x in t.split("\n") if not x.startswith("Posted"))) for i, t in rows]
    got = [(r.doc_id, r.text) for r in line_templates.drop_recurring_lines(frame(spark, rows * 3)).collect()]
    assert sorted(got, key=str) == sorted(want * 3, key=str)


def test_leaves_past_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, f"Posted by {p} today") for i, p in enumerate(["Anna", "Ben", "Carla"])]
    monkeypatch.setattr(line_templates, "BROADCAST_LEAVES", 0)
    assert sum(r.n_dropped for r in line_templates.drop_recurring_lines(frame(spark, rows)).collect()) == 2


def test_templates_of_long_and_odd_lines(spark):
    rows = [(i, "x" * 50_000 + "\n" + "a b c d\n" * 2000 + "u://v @ : :: 1") for i in range(3)]
    got = line_templates.drop_recurring_lines(frame(spark, rows)).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got] == [0, 2002, 2002] and got[1].text == ""


# Decontamination


def test_lcs_matches_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 30))], [rng.randrange(6) for _ in range(rng.randrange(40))]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert decontamination.lcs_length(decontamination.masks(a), len(a), b) == row[-1]


def leak_fixture(rng):
    items = [(k, " ".join([*words(rng, rng.randrange(12, 70), 4000)]) + ". " + " ".join(words(rng, 5, 4000))) for k in range(30)]
    docs, truth = [], set()
    for d in range(300):
        body = words(rng, rng.randrange(5, 600), 4000)
        if d % 10 == 0:
            k = rng.randrange(len(items))
            item = items[k][1].split()
            if d % 20 == 0:  # a paraphrase: some words replaced, one dropped
                for _ in range(len(item) // 6):
                    item[rng.randrange(len(item))] = f"r{rng.random()}"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() for w in item] if d % 30 == 0 else item
            truth.add((d, k))
        docs.append((d, " ".join(body)))
    return items, docs, truth


def test_leaks_are_found_and_clean_documents_left(spark):
    items, docs, truth = leak_fixture(random.Random(2))
    docs += [(1000, None), (1001, ""), (None, items[0][1]), (1002, "w1 " * 30_000)]
    bench = spark.createDataFrame([*items, (50, None), (51, "..."), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), bench).collect()}
    assert got == truth | {(None, 0)}
    kept = {r.doc_id for r in decontamination.decontaminate(frame(spark, docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in truth} - {None}


def test_short_and_reworded_items_inside_the_same_vocabulary(spark):
    rng = random.Random(7)
    items = [(k, " ".join(words(rng, 1 + k % 8, 600))) for k in range(64)] + [(100 + k, " ".join(words(rng, rng.randrange(15, 60), 600))) for k in range(40)]
    docs, truth = [], set()
    for d, (k, text) in enumerate(items * 3):
        body, item = words(rng, rng.randrange(100, 400), 600), text.split()
        if k >= 100:  # up to 38 % of the words replaced, and not the answer
            end = len(item) - max(1, len(item) // 4)
            for j in rng.sample(range(end), int(0.38 * len(item))):
                item[j] = words(rng, 1, 600)[0]
            truth.add((d, k))
        at = rng.randrange(len(body) + 1)
        body[at:at] = item
        docs.append((d, " ".join(body)))
    truth |= {(d, k) for d, t in docs for k, x in items if f" {x} " in f" {t} "}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), bench).collect()}
    assert truth <= got


def test_long_items_need_their_answer(spark):
    rng = random.Random(11)
    items = [(k, " ".join(words(rng, n, 3000)) + ". " + " ".join(words(rng, 12, 3000))) for k, n in enumerate([128, 140, 260, 500])]
    docs = []
    for k, text in items:
        body = words(rng, 300, 3000)
        cut = text.split()[:-12]
        docs += [(10 * k, " ".join([*body, *text.split(), *body])), (10 * k + 1, " ".join([*body, *cut, *body])), (10 * k + 2, " ".join([*body, *cut[: len(cut) // 2], *body]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), bench).collect()}
    assert got == {(10 * k, k) for k, _ in items}


def test_rows_are_removed_by_their_own_text(spark):
    items, docs, truth = leak_fixture(random.Random(2))
    leak, clean = docs[min(truth)[0]][1], next(t for d, t in docs if d not in {d for d, _ in truth})
    rows = [(1, leak), (1, clean), (None, leak), (None, clean), (2, None), (1, leak)]
    kept = decontamination.decontaminate(frame(spark, rows).withColumnRenamed("k", "key").withColumnRenamed("doc", "row"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(1, clean), (None, clean), (2, None)], key=str) and "row" in kept.columns


def test_leaks_of_nothing(spark):
    bench = spark.createDataFrame([(1, "some words of an item that is long enough")], "item_id long, text string")
    assert decontamination.leaks(frame(spark, []), bench).count() == 0
    assert decontamination.leaks(frame(spark, [(1, "a text")]), bench.limit(0)).count() == 0


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 7)
    items, docs, truth = leak_fixture(random.Random(4))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == truth


# Toxicity


def toxic_rows(rng, n):
    out = []
    for i in range(n):
        body, bad = words(rng, 60, 400), rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 4)):
                body[rng.randrange(60)] = rng.choice(["idiot", "moron", f"vequ{rng.randrange(999)}"])
        out.append((i, " ".join(body), int(bad), int(rng.random() < 0.8)))
    return out


def test_chain_on_held_out_rows(spark):
    rows = toxic_rows(random.Random(1), 1500)
    docs = frame(spark, [(i, t) for i, t, _, _ in rows] + [(None, "idiot"), (5000, None), (5001, ""), (5002, "word " * 30_000)])
    labels = spark.createDataFrame([(i, q, b, "x") for i, _, b, q in rows if i % 3] + [(1, None, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    chain = toxicity.train(docs, labels, toxicity.label_categories())
    assert chain.categories == ["low_quality", "toxic", "toxic_low_quality"] and [len(m.earlier) for m in chain.models] == [0, 1, 2]
    got = {r.doc_id: r for r in toxicity.score(docs, chain, "toxic").collect()}
    held = [(got[i].rejected, bool(b)) for i, _, b, _ in rows if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert not got[5000].rejected and not got[5001].rejected and len(got) == len(rows) + 4
    assert got[5000].text is None and got[5000].component == "clash"


def test_chain_without_labels(spark):
    docs = frame(spark, [(1, "a text"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, toxicity.label_categories())
    assert [r.rejected for r in toxicity.score(docs, chain, "toxic").collect()] == [False, False]
    assert toxicity.score(docs.limit(0), chain, "toxic").count() == 0


def test_sample_is_bounded(spark):
    rows = toxic_rows(random.Random(3), 200)
    labels = spark.createDataFrame([(i, q, b) for i, _, b, q in rows], "doc_id long, quality int, toxic int")
    assert toxicity.train(frame(spark, [(i, t) for i, t, _, _ in rows]), labels, toxicity.label_categories(), sample=50).models


# Language identification


def test_languages_of_held_out_rows(spark):
    rng = random.Random(2)
    ends = {"aa": ["tion", "ing", "the"], "bb": ["keit", "ung", "der"], "cc": ["ción", "mente", "el"]}
    rows = [(i, " ".join(rng.choice("bcdfg") + rng.choice(ends[lang]) for _ in range(rng.randrange(5, 80))), lang) for i in range(600) for lang in [rng.choice(list(ends))]]
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "12 !? 34", "bb"), (None, "bing ction", None), (903, "bing " * 30_000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, lang string, score string")
    model = language_id.train(docs, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i % 3 == 1]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and 0 <= got[903].score <= 1
    none = language_id.train(docs, F.lit(False))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


# HTML


def page(body, host="a.example"):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_main_text(spark):
    prose = "Some running text that is long enough to win, with commas &amp; more."
    article = f"<h1>Head</h1><p>{prose}<br>next <b>bold</b></p><aside>no</aside><ul><li>one<li>two</ul><form>no</form><div class='comments'><p>{prose * 9}</p></div><p>last&nbsp;one"
    rows = [(1, "http://A.example/x", page(f"<nav><a href=/>menu</a></nav><div class=ad>buy {prose}</div><article>{article}</article><footer>foot</footer>")), (2, "http://a.example/y", None), (3, None, ""), (4, "bad url", "<p>only this"), (5, "http://a.example/z", "<article><p>tiny</article>"), (1, "http://A.example/x", "plain text")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): r for r in html_text.main_text(docs).collect() if r.text != "plain text"}
    assert got[1, "http://A.example/x"].text == f"Head\n\n{prose.replace('&amp;', '&')} next bold\n\none\n\ntwo\n\nlast one"
    assert got[2, "http://a.example/y"].text == "" and got[3, None].text == "" and got[4, "bad url"].text == "only this" and got[5, "http://a.example/z"].text == "tiny"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_text(docs).count() == len(rows) and html_text.main_text(docs.limit(0)).count() == 0


def test_host_paths_win_over_the_page(spark):
    good = lambda n: page("<div class='box7'>" + f"<p>{'words in the article body ' * n}</p>" + f"</div><div class='teaser'><p>{'long teaser of some other page ' * 20}</p></div>")
    rows = [(i, "http://h.example/", good(60)) for i in range(9)] + [(9, "http://h.example/", good(2))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].startswith("words in the article body") and "teaser" not in got[9]


@pytest.mark.parametrize("tag", ["article", "main"])
def test_nested_and_split_article_bodies(spark, tag):
    long, short = "words in the article body " * 40, "words of a shorter part " * 10
    nested = page(f"<nav><a href=/>menu</a></nav><{tag}><h1>Head</h1><p>lead</p><div class=body><p>{long}</p><aside>no</aside></div><p>end</p></{tag}><div class=teaser><p>{short}</p></div>")
    split = page(f"<{tag}><section class=one><p>{short}</p></section><section class=two><div><p>{long}</p></div></section></{tag}><footer>foot</footer>")
    rows = [(i, "http://n.example/", nested) for i in range(3)] + [(i, "http://s.example/", split) for i in range(3, 6)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(3)} == {f"Head\n\nlead\n\n{long.strip()}\n\nend"}
    assert {got[i] for i in range(3, 6)} == {f"{short.strip()}\n\n{long.strip()}"}


def test_broken_markup_is_survived():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class=\"a", "<b", ">", "</", "<!--", "-->", "<script>", "</script>", "&amp", "&#x41;", "text ", "<li>", "<table><tr><td>", "</table>", "<!x", "<a href='x'>", "\0"]
    for _ in range(500):
        html_text.extract(html_text.blocks("".join(rng.choice(bits) for _ in range(30))), [])
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert html_text.extract(html_text.blocks(deep), []) == "x"
    deep = "<div class='some long class name'>" * 50_000 + "x"
    assert html_text.extract(html_text.blocks(deep), []) == "x"


PROSE = "Running text of the article, which goes on for a while and has commas and full stops."


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article><p>{PROSE}</p><svg width=1 /><p>end</p></article>", [PROSE, "end"]),
        (f"<article><p>{PROSE}</p><noscript><p>end</p></article>", [PROSE, "end"]),
        (f"<article><p>{PROSE} <math><mi>x</mi><mo>=</mo></math> 1</p></article>", [f"{PROSE} x= 1"]),
        (f"<div class='hentry comments-open'><article><p>{PROSE}</p></article></div>", [PROSE]),
        (f"<article class='post has-comments'><p>{PROSE}</p></article>", [PROSE]),
        (f"<form action=x><main><p>{PROSE}</p></main><p>go</p></form>", [PROSE]),
        (f"<form action=x><div id=c><p>{PROSE}</p><p>more</p></div></form>", [PROSE, "more"]),
        (f"<article><p>{PROSE}</p><h2 id='share-price'>Head</h2><div class='social-science'><p>{PROSE}</p></div><p class='skip-list'>end</p></article>", [PROSE, "Head", PROSE, "end"]),
        (f"<article><p class=\"lead>{PROSE}</p><p class=\"x\">end</p></article>", [PROSE, "end"]),
        (f"<article><p data-x='<p>no</p>'>{PROSE}</p></article>", [PROSE]),
        (f"<article><p>{PROSE}</p><div class='share-buttons'><p>tell</p></div><div class='site-footer'>x</div><div id='comments-area'><p>{PROSE}</p></div><div class='see-related'><a href=x>one</a> <a href=y>two</a></div></article>", [PROSE]),
        (f"<article><p>{PROSE}</p><form><p>name</p></form></article>", [PROSE]),
    ],
)
def test_pages_that_lost_or_gained_text(body, want):
    assert html_text.extract(html_text.blocks(page(body)), []).split("\n\n") == want


def test_generated_pages_are_extracted_whole(spark):
    rng = random.Random(12)
    rows, truth = [], {}
    inner = ["nav", "aside", "form", "footer", "div class='advert'", "div class='site-nav'", "div id='cookie-banner'", "ul class='share-links'", "section class='comments'", "div role=navigation"]
    for i in range(200):
        host, parts, body = f"h{i % 7}.example", [], []
        for _ in range(rng.randrange(2, 12)):
            if rng.random() < 0.3:
                tag = rng.choice(inner)
                body.append(f"<{tag}><p>{' '.join(words(rng, 8))}</p></{tag.split()[0]}>")
            else:
                parts.append(" ".join(words(rng, rng.randrange(15, 60))))
                tag = rng.choice(["p", "h2", "blockquote", "li", "div", "pre", "p class=lead"])
                body.append(f"<{tag}>{parts[-1].replace(' ', rng.choice([' ', chr(10), ' <b>x</b> ']), 1).replace(' <b>x</b> ', ' ')}</{tag.split()[0]}>")
        wrap = ["article", "main", "div class=entry"][i % 7 % 3]
        around = f"<header><p>site</p></header><div class=menu><a href=x>m</a></div><{wrap}>{''.join(body)}</{wrap.split()[0]}><aside><p>{' '.join(words(rng, 9))}</p></aside>"
        rows.append((i, f"http://{host}/{i}", page(around)))
        truth[i] = "\n\n".join(parts)
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [i for i in truth if got[i] != truth[i]] == []
