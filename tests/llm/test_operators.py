"""Dealt operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm.boilerplate import Stream, furniture, main_content, suffix_array
from shelfmark.llm.distinctive import distinctive_terms
from shelfmark.llm.encoding import ByteBpe
from shelfmark.llm.frequency import BurstTrie, count_values, marked_values
from shelfmark.llm.leaks import leaked_items, longest_run, myers, pieces_of
from shelfmark.llm.lines import excessive_lines, repeated_lines, without_lines
from shelfmark.llm.lookalikes import Rewriter, rewritten
from shelfmark.llm.neardup import groups, shingle_hashes, similar_classes, similar_groups, similar_pairs, sketch
from shelfmark.llm.quality import FIELDS, text_quality
from shelfmark.llm.terms import terms_of

WORDS = "amber cellar stone Gold ιστός кость 石 naïve x1 2020 the of and lid jar ring".split()
SCHEMA = "doc_id long, source string, title string, body string, text string, term string, key string, line int"


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        body = " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))
        rows.append((i, rng.choice(["a", "a", "b", None]), rng.choice([None, "", "Title " + rng.choice(WORDS)]), rng.choice([None, "", "  ", body, body, body, body]), None, "t", "k", 1))
    rows.append((n, "a", None, "word " * 50_000 + "end", None, "t", "k", 1))
    return [(*r[:4], "\n".join(x for x in r[2:4] if x) if r[2] or r[3] else r[3] if r[3] is not None else r[2], *r[5:]) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_distinctive_terms(docs, rows):
    got = {(r.doc_id, r.term): (r.tf, r.df, r.ppmi) for r in distinctive_terms(docs, "doc_id", ["title", "body"]).collect()}
    counts = {r[0]: Counter(terms_of((r[2] or "") + "\n" + (r[3] or ""))) for r in rows}
    df, n_t = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        n_t.update(c)
    z = sum(sum(c.values()) ** 0.75 for c in counts.values())
    want = {(d, t): (k, df[t], max(0.0, math.log(k * z / (n_t[t] * sum(c.values()) ** 0.75)))) for d, c in counts.items() for t, k in c.items()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=1e-9)
    few = {(r.doc_id, r.term) for r in distinctive_terms(docs, "doc_id", ["title", "body"], min_tf=2, max_df=40, pattern="^[a-z]+$").collect()}
    assert few == {k for k, v in want.items() if v[0] >= 2 and v[1] <= 40 and re.fullmatch("[a-z]+", k[1])}
    assert distinctive_terms(docs.limit(0), "doc_id", ["title", "body"]).count() == 0


def test_repeated_lines(spark):
    notice = "Read our  cookie policy"
    rows = [(i, "s", f"Own line {chr(97 + i)}\n {notice.upper()} \nPage {i} of 99\n12\n") for i in range(6)] + [(6, "s", None), (7, None, notice), (8, "t", notice), (9, "s", ""), (10, "s", "Own line a\n READ OUR COOKIE POLICY\nPage 3 of 99\n12\n")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, body string, size string, forms string")
    found = sorted(map(tuple, excessive_lines(docs, "doc_id", "source", "body").collect()))
    assert found == sorted((i, k) for i in [*range(6), 10] for k in (2, 3))
    counts = {r.n_docs: (r.n_clusters, r.n_dates) for r in repeated_lines(docs, "doc_id", "source", "body").collect()}
    assert counts == {7: (6, 1)}
    dates = spark.createDataFrame([(i, f"2020-01-0{i + 1}") for i in range(6)], "doc_id long, d string").select("doc_id", F.col("d").cast("date").alias("published_on"))
    assert {r.n_dates for r in repeated_lines(docs, "doc_id", "source", "body", dates=dates).collect()} == {6}
    assert repeated_lines(docs, "doc_id", "source", "body", dates=dates, min_dates=7).count() == 0
    clean = {r.doc_id: r.body for r in without_lines(docs, "doc_id", "body", excessive_lines(docs, "doc_id", "source", "body")).collect()}
    assert clean[0] == "Own line a\n12\n" and clean[6] is None and clean[8] == notice and clean[9] == ""
    assert excessive_lines(docs.limit(0), "doc_id", "source", "body").count() == 0


def test_cleaning_keeps_articles_published_again(spark, tmp_path):
    from shelfmark.llm.queries import p3_clean

    notice, today = "Read our cookie policy", "Closed for the holiday today"
    bodies = [f"Own line {chr(97 + i)}\n{notice}" for i in range(6)] + ["An article about amber\nin two lines"] * 6 + [f"Other line {chr(97 + i)}\n{today}" for i in range(5)]
    days = [f"2020-01-0{i + 1}" for i in range(6)] + ["2020-02-01"] * 11
    undated = [f"Undated line {chr(97 + i)}\n{notice}" for i in range(5)]
    docs = [(i, i, "s", b) for i, b in enumerate(bodies)] + [(100 + i, 100 + i, "t", b) for i, b in enumerate(undated)] + [(200, 200, "s", None)]
    spark.createDataFrame(docs, "doc_id long, page_id long, source string, body string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(i, "s", d) for i, d in enumerate(days)] + [(100 + i, "t", "unknown") for i in range(5)]
    spark.createDataFrame(pages, "page_id long, source string, published string").withColumn("crawled_at", F.lit(None).cast("timestamp_ntz")).write.parquet(f"{tmp_path}/site_pages.parquet")
    spark.createDataFrame([("s", "en", "UTC", "dmy"), ("t", "en", "UTC", "dmy")], "source string, lang string, tz string, date_order string").write.parquet(f"{tmp_path}/sites.parquet")
    clean = {r.doc_id: r.body for r in p3_clean(spark, str(tmp_path)).collect()}
    assert clean == {i: b if i >= 6 else b.split("\n")[0] for i, b in enumerate(bodies)} | {100 + i: b.split("\n")[0] for i, b in enumerate(undated)} | {200: None}


def test_lookalikes():
    change = Rewriter({})
    cases = {
        "ｆｕｌｌ　ｗｉｄｔｈ": ("full width", {"styled", "space"}), "ﬁnd 𝖻𝗋": ("find br", {"styled"}), "café": ("café", {"unjoined"}), "が": ("が", {"unjoined"}), "ru​ns": ("runs", {"invisible"}),
        "a b": ("a b", {"space"}), "brυsһ": ("brush", {"script"}), "Rumаda": ("Rumada", {"script"}), "масtер": ("мастер", {"script"}), "Rumаdapoѕの指輪": ("Rumadaposの指輪", {"script"}),
        "👩‍🔬 👍🏽 ❤️": ("👩‍🔬 👍🏽 ❤️", set()), "½ m² “x” – y’s é i̯": ("½ m² “x” – y’s é i̯", set()), "кость και λόγος": ("кость και λόγος", set()), "Redobegaの灯": ("Redobegaの灯", set()),
        "Ã  Â Ã©": ("Ã  Â Ã©", set()), "tab\tline\r\n": ("tab\tline\r\n", set()), "": ("", set()), "™ №": ("™ No", {"styled"}),
    }
    for text, want in cases.items():
        assert change.rewrite(text) == want, text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abсео́e​ ｆﬁ 石の👩‍🔬é\n", max_size=20))
def test_one_form_is_stable(text):
    change = Rewriter({})
    once, _ = change.rewrite(text)
    assert change.rewrite(once)[0] == once


def test_rewritten_tables(spark, docs):
    odd = spark.createDataFrame([(1, None, "x​y"), (2, "ｆ", None), (3, "", "plain"), (3, "", "plain")], "doc_id long, title string, body string").withColumn("field", F.lit(1)).withColumn("text", F.lit(2))
    got = sorted((r.doc_id, r.field, r.text, r.kinds) for r in rewritten(odd, "doc_id", ["title", "body"]).collect())
    assert got == [(1, "body", "xy", ["invisible"]), (2, "title", "f", ["styled"]), (3, "body", "plain", []), (3, "body", "plain", []), (3, "title", "", []), (3, "title", "", [])]
    assert rewritten(odd.limit(0), "doc_id", ["title", "body"]).count() == 0


def test_frequencies(spark, docs, rows, monkeypatch):
    from shelfmark.llm import frequency

    monkeypatch.setattr(frequency, "LEAST_ROUTE", 3)
    got = {r.term: (r.occurrences, r.records) for r in count_values(F.col("body"), docs.repartition(3)).collect()}
    occurrences, records = Counter(), Counter()
    for r in rows:
        occurrences.update(terms_of(r[3]))
        records.update(set(terms_of(r[3])))
    assert got == {t: (n, records[t]) for t, n in occurrences.items()}
    lists = spark.createDataFrame([(["a", "a", None, ""],), (None,), ([],), (["A b"],)], "v array<string>")
    assert {r.term: (r.occurrences, r.records) for r in count_values(F.col("v"), lists).collect()} == {"a": (2, 1), "": (1, 1), "A b": (1, 1)}
    marks = {r.term: r.mark for r in marked_values(spark.createDataFrame([("a", 1, 1), ("b", 9, 4), ("c", 9, 3)], "term string, occurrences long, records long"), 10, 0.3).collect()}
    assert marks == {"a": "rare", "b": "common", "c": None}
    assert count_values(F.col("body"), docs.limit(0)).count() == 0


@given(st.lists(st.text(alphabet="ab\0c", max_size=6), max_size=60))
def test_burst_trie_counts(terms):
    trie = BurstTrie(limit=2)
    for t in terms:
        trie.add(t, 1, 1)
    counts = Counter()
    for prefix, suffixes, n, _ in trie.subtrees():
        for s, k in zip(suffixes, n):
            counts[prefix + s] += k
    if not any("\0" in t for t in terms):
        assert counts == Counter(terms)


def test_suffix_array():
    import numpy as np

    rng = np.random.default_rng(3)
    codes = rng.integers(0, 3, 200)
    order, rank = suffix_array(codes, 256)
    assert list(order) == sorted(range(200), key=lambda i: tuple(codes[i:]))
    stream = Stream()
    for page, lines in enumerate((["a b", "c"], ["a b", "a b"], ["c", "a"])):
        for line in lines:
            stream.add(page, line.split())
    pages, first = stream.pages(stream.spans)
    assert list(pages) == [2, 2, 2, 2, 2, 1] and sum(first) == 3


def test_furniture(spark):
    rows = []
    for i in range(40):
        body = [f"Home > Topic{i} > Place{i}", "Shop", f"The object number {chr(97 + i % 26)} was found near the old mill by somebody.", "", f"Page {i} of 40", "Related records", f"Jar and lid, Place{i * 7}", f"Ring of Town{i}"]
        if i % 2:
            body = body[1:4]
        rows.append((i, "h", f"Name {chr(97 + i % 26)}{i} | Museum H" if i % 2 else f"Name {i}", "\n".join(body)))
    rows += [(90, "h", None, None), (91, None, "Lone", "Shop\nOwn text stands here."), (92, "h", "", "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, title string, body string, host int, block int")
    found = defaultdict(set)
    for r in furniture(docs, "doc_id", "source", "title", "body").collect():
        found[r.doc_id].add(r.line_no)
    assert found[2] == {1, 2, 5, 6, 7, 8} and found[3] == {0, 1} and 90 not in found
    assert found[91] == {1}  # what both hosts repeat is furniture on either
    main = {r.doc_id: (r.title, r.body) for r in main_content(docs, "doc_id", "source", "title", "body").collect()}
    assert main[3] == ("Name d3", rows[3][3].split("\n")[1] + "\n") and main[90] == (None, None) and main[92] == ("", "") and main[2][0] == "Name 2"
    assert furniture(docs.limit(0), "doc_id", "source", "title", "body").count() == 0


def test_near_duplicates(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(60)]
    for base in list(texts):
        for edits in (0, 1, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    rows = [(i, " ".join(t), None) for i, t in enumerate(texts)] + [(900, None, None), (901, "", ""), (902, "two words", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, title string, body string, rep string")
    sets = {r[0]: set(zip(*[terms_of((r[1] or "") + "\n" + (r[2] or ""))[k:] for k in range(3)])) for r in rows}
    sets = {k: s for k, s in sets.items() if s}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    got = [tuple(r) for r in similar_pairs(docs, "doc_id", ["title", "body"], 3, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.98 * len(want)
    # large classes stay short: copies with their representative, others with it alone
    short = {tuple(r) for r in similar_pairs(docs, "doc_id", ["title", "body"], 3, 0.6, expanded=1).collect()}
    members, _ = similar_classes(docs, "doc_id", ["title", "body"], 3, 0.6)
    rep = {r.key: r.rep for r in members.collect()}
    assert rep.keys() == sets.keys() and {(min(rep[a], rep[b]), max(rep[a], rep[b])) for a, b in got if rep[a] != rep[b]} | {(rep[k], k) for k in rep if rep[k] != k} == short
    assert similar_pairs(docs.limit(0), "doc_id", ["title", "body"]).count() == 0


def test_groups(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.label for r in groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges))
    assert groups(spark.createDataFrame([], "a long, b long")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e", None), (2, "a b c d e", None), (3, "x", ""), (4, None, None)], "doc_id long, title string, body string")
    assert sorted(tuple(r) for r in similar_groups(docs, "doc_id", ["title", "body"]).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_sketches_estimate_similarity():
    words = [f"v{i}" for i in range(3000)]
    a, b = sketch(shingle_hashes(words[:2000], 1)), sketch(shingle_hashes(words[500:2500], 1))
    assert abs((a == b).mean() - 1500 / 2500) < 0.12


def test_encoding(spark):
    from tokenizers import Tokenizer

    texts = ["Hello world", "", None, "  spaced   out \n\n\t x", "naïve café 石の 👩‍🔬 ‘ⲡⲏⲓ’", "<|endoftext|> it's 12345 ABCdef", "a" * 700, "Zemufekes zhgq " * 3000, "  x　", "don't you'll we've", "\r\n\r\n x  \n"]
    docs = spark.createDataFrame([(i, t, "k", [1]) for i, t in enumerate(texts)], "doc_id long, text string, word string, ids array<int>")
    own = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    own.encode_special_tokens = True
    bpe = ByteBpe("/opt/tokenizers/byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs, "doc_id", "text")
    got = {r.doc_id: r.ids for r in coded.collect()}
    for i, t in enumerate(texts):
        assert got[i] == (own.encode(t, add_special_tokens=False).ids if t else []), t and t[:40]
    back = {r.doc_id: r.t for r in coded.select("doc_id", bpe.decode(F.col("ids")).alias("t")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert bpe.encode(docs.limit(0), "doc_id", "text").count() == 0
    assert spark.range(1).select(bpe.decode(F.array(F.lit(60000)))).first()[0] is None


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abc"), max_size=20))
def test_myers(pattern, text):
    rows = [[0] * (len(text) + 1)]
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (p != t)))
        rows.append(row)
    assert myers(pattern, text) == min(rows[-1])


def test_leaks(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate((9, 10, 14, 40, 60, 60))] + [(50, None), (51, ""), (52, "Short one")]
    items.append((53, items[4][1]))
    rows = []
    for i in range(80):
        text = rng.choices(words, k=50)
        item = items[i % 6][1].split()
        at = rng.randrange(len(item))
        rows.append((i, " ".join(text[:20] + item[at : at + rng.choice([5, 9, 10, 11, 60])] + text[20:]).title()))
    rows += [(100, None), (101, ""), (102, "w1 " * 20_000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, run int")
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = lambda t: {tuple(x) for w in [terms_of(t)] for x in zip(*[w[k:] for k in range(10)])}
    want = {(d, i) for d, t in rows for i, u in items if windows(t) & windows(u)}
    got = leaked_items(docs, table, "doc_id", "text", "item_id", "text")
    assert {(r.doc_id, r.item_id) for r in got.where("run >= 10").collect()} == want and want
    assert leaked_items(docs.limit(0), table, "doc_id", "text", "item_id", "text").count() == 0
    assert leaked_items(docs, table.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert pieces_of(list(range(12)), 10) == [0, 5] and longest_run(list("abcdef"), list("xbcdey"), [(2, 2)], 2) == 4


def test_quality(spark):
    texts = [
        (1, "T", "T\n- copper jar\n- bone pin\n- old lamp\n- ring, gold\n- iron saw", "list"), (2, None, "item;cm;place\njar;12;mill\nlid;-;attic\nring;3;hall\nlamp;4;mill", "table"),
        (3, "T", "T\nThe lid was found in the mill. It had been washed and then sold to a dealer in the town.", "prose"), (4, "T", "T\nqwlkej asdlkjh hqwe sdkjfh qwrtz lkjhg sdfgh wrtpl kjhgf xcvbn", "junk"),
        (5, "T", "T", None), (6, None, None, None), (7, None, "", None), (8, None, " \n\t", None), (9, "", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 2000, "junk"),
    ]
    docs = spark.createDataFrame([(i, t, x, "k", 1.0) for i, t, x, _ in texts], "doc_id long, title string, text string, kind string, words double")
    got = {r.doc_id: r for r in text_quality(docs, "doc_id", "text", "title").collect()}
    assert {i: got[i].kind for i, *_ in texts} == {i: k for i, _, _, k in texts}
    assert got[3].words == 20 and got[3].punctuated == 1.0 and got[6].words is None and set(FIELDS) <= set(got[3].asDict())
    assert text_quality(docs.limit(0), "doc_id", "text", "title").count() == 0


def test_model_tells_kinds_of_unseen_texts_apart():
    import json

    import numpy as np

    from shelfmark.llm.quality import KINDS, MODEL, Trees, statistics
    from shelfmark.llm.quality_training import HOLDOUT

    stored = json.loads(MODEL.read_text())
    x = np.array([statistics(t, stored["pairs"], {}) for _, t in HOLDOUT])
    guess = [KINDS[k] for k in Trees(stored["kinds"]).probabilities(x).argmax(axis=1)]
    assert sum(g == k for g, (k, _) in zip(guess, HOLDOUT)) >= 0.95 * len(HOLDOUT)
