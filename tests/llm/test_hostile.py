"""Inputs that once gave wrong results, crashed an operator or made it quadratic."""

import random
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import frequency
from shelfmark.llm.boilerplate import furniture, main_content
from shelfmark.llm.frequency import BurstTrie, count_values
from shelfmark.llm.neardup import _met, similar_groups, similar_pairs


def counted(trie):
    counts = Counter()
    for prefix, suffixes, n, _ in trie.subtrees():
        for s, k in zip(suffixes, n):
            counts[prefix + s] += k
    return counts


@given(st.lists(st.text(alphabet="ab\0c", max_size=6), max_size=60))
def test_burst_trie_counts_values_with_any_character(terms):
    trie = BurstTrie(limit=2)
    for t in terms:
        trie.add(t, 1, 1)
    assert counted(trie) == Counter(terms) and trie.size == len(set(terms))


def test_values_with_long_common_beginnings(spark):
    values = ["x" * 1_200 + str(i) for i in range(1_100)] + ["x" * n for n in range(1, 90)] + ["y" * 300_000 + str(i) for i in range(3)]
    trie = BurstTrie()
    for v in values * 2:
        trie.add(v, 1, 1)
    assert counted(trie) == Counter(values * 2)
    rows = spark.createDataFrame([([v, "ab", "ab\0"],) for v in values], "v array<string>").repartition(4)
    got = {r.term: (r.occurrences, r.records) for r in count_values(F.col("v"), rows).collect()}
    assert got == {v: (1, 1) for v in values} | {"ab": (len(values),) * 2, "ab\0": (len(values),) * 2}


def test_routes_are_cut_again_where_few_are_split(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(4_000)]
    rows = spark.createDataFrame([(words[i : i + 20],) for i in range(0, 4_000, 20)], "v array<string>").repartition(3)
    monkeypatch.setattr(frequency, "LEAST_ROUTE", 50)
    monkeypatch.setattr(frequency, "ROUTES", 4)
    monkeypatch.setattr(frequency, "MERGED", 100)
    monkeypatch.setattr(frequency, "HELD", 300)
    got = {r.term: r.occurrences for r in count_values(F.col("v"), rows).collect()}
    assert got == Counter(words)


def versions(n, rng):
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(1, 5)):
            text[rng.randrange(120)] = f"x{i}-{rng.randrange(9)}"
        out.append((i, " ".join(text)))
    return out


def test_many_versions_of_one_page_give_links_and_not_pairs(spark):
    rng = random.Random(3)
    rows = versions(500, rng) + [(1000 + i, " ".join(f"own{i}q{k}" for k in range(50))) for i in range(100)]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, title string, body string")
    runs = {i: set(zip(*[t.replace("-", " ").split()[k:] for k in range(3)])) for i, t in rows}
    alike = lambda a, b: len(runs[a] & runs[b]) >= 0.6 * len(runs[a] | runs[b]) - 1e-9
    want = {(a, b) for a in range(500) for b in range(a + 1, 500) if alike(a, b)}
    got = [tuple(r) for r in similar_pairs(docs, "doc_id", ["title", "body"], 3, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    short = [tuple(r) for r in similar_pairs(docs, "doc_id", ["title", "body"], 3, 0.6, expanded=100, marked=True).collect()]
    assert {(a, b) for a, b, _ in short} <= want and not any(w for _, _, w in short) and len(short) < 64 * 19 * 500
    tied = {r.doc_id: r.group for r in similar_groups(docs, "doc_id", ["title", "body"], 3, 0.6).collect()}
    assert {tied[i] for i in range(500)} == {0} and all(tied[i] == i for i in tied if i >= 1000)
    one_band = spark.range(3_000).select(F.col("id").alias("key"), F.lit(7).cast("long").alias("band"))
    assert _met(one_band)[0].count() < 3 * 3_000


def test_pairs_at_the_threshold_that_bands_of_a_template_pass_over(spark):
    # 60 runs in common and 20 own ones: exactly 60 %; documents of other pairs have the 56 of the template in common
    template, rows = [f"w{i}" for i in range(58)], []
    for k in range(400):
        both = template + [f"p{k}x{i}" for i in range(4)]
        rows += [(2 * k + s, " ".join(both + [f"o{k}x{s}x{i}" for i in range(20)]), None) for s in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    got = [tuple(r) for r in similar_pairs(docs, "doc_id", ["title", "body"], 3, 0.6).collect()]
    assert sorted(got) == [(2 * k, 2 * k + 1) for k in range(400)]
    assert {r.doc_id: r.group for r in similar_groups(docs, "doc_id", ["title", "body"], 3, 0.6).collect()} == {i: i // 2 * 2 for i in range(800)}


def test_all_pairs_of_more_than_a_thousand_versions_and_copies(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{base} v{i} x{i}", None) for i in range(1_100)] + [(5_000 + i, "four words of copies", None) for i in range(1_050)] + [(9_000, "four words of copies here", None), (9_001, "own words alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    got = similar_pairs(docs, "doc_id", ["title", "body"], 3, 0.6, marked=True).toPandas()
    assert got["whole"].all() and not got.duplicated().any() and (got["doc_id_a"] < got["doc_id_b"]).all()
    assert (got["doc_id_b"] < 5_000).sum() == 1_100 * 1_099 // 2 and (got["doc_id_a"] >= 5_000).sum() == 1_051 * 1_050 // 2 and len(got) == (1_100 * 1_099 + 1_051 * 1_050) // 2


def test_pairs_of_short_and_uneven_texts_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    texts = [rng.choices(words, k=rng.randint(1, 9)) for _ in range(300)]
    for t in texts[:100] + [[f"l{i}" for i in range(n)] for n in (90, 200)]:
        for k in (1, 2, len(t) // 6, len(t) // 5, len(t) // 4):
            texts.append(t[: len(t) - k] or t)
            texts.append(t + [f"e{len(texts)}x{i}" for i in range(k)])
    docs = spark.createDataFrame([(f"k{i}", " ".join(t), None) for i, t in enumerate(texts)], "doc_id string, title string, body string")
    for width, threshold in ((1, 0.5), (2, 0.6), (3, 0.8), (1, 1.0)):
        sets = {f"k{i}": set(zip(*[t[j:] for j in range(width)])) for i, t in enumerate(texts) if len(t) >= width}
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
        got = [tuple(r) for r in similar_pairs(docs, "doc_id", ["title", "body"], width, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def pages_with_notices(n, rng):
    """Pages whose notices stand inside lines of own text and over line breaks, at other places on each."""
    notice = "this museum uses small files to count visits and to keep the shop basket alive for a day"
    legal = "all pictures may be used for teaching if the name\nof the house and the number of the piece are given with them"
    own = lambda k: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        a, b, c, d = own(rng.randint(3, 9)), own(rng.randint(3, 9)), own(rng.randint(2, 6)), own(rng.randint(5, 9))
        if i % 2:
            rows.append((i, "h", None, f"{a} {notice} {b}\n{c} {legal} {d}"))
            want[i] = [f"{a} {b}", c, d]
        else:
            rows.append((i, "h", None, f"{a} {b}\n{c}"))
            want[i] = [f"{a} {b}", c]
    return rows, want


def test_boilerplate_inside_lines_and_over_line_breaks(spark):
    from shelfmark.llm import boilerplate

    rows, want = pages_with_notices(60, random.Random(5))
    docs = spark.createDataFrame([*rows, (900, "other", "T", rows[1][3])], "doc_id long, source string, title string, body string")
    for rules in (False, True):
        got = {r.doc_id: r.body.split("\n") for r in main_content(docs, "doc_id", "source", "title", "body", long=12, rules=rules).collect()}
        assert {i: got[i] for i in want} == want and got[900] == rows[1][3].split("\n")
    assert {r.doc_id for r in furniture(docs, "doc_id", "source", "title", "body", long=12, rules=False).collect()} == set()
    block, boilerplate.BLOCK = boilerplate.BLOCK, 7  # a host of many blocks gives the same
    try:
        got = {r.doc_id: r.body.split("\n") for r in main_content(docs, "doc_id", "source", "title", "body", long=12, rules=False).collect()}
    finally:
        boilerplate.BLOCK = block
    assert {i: got[i] for i in want} == want
    whole = spark.createDataFrame([(i, "h", None, f"{b.split(chr(10))[0]}\nthe first half of a notice that breaks its line at no fixed place{chr(10) if i % 2 else ' '}and goes on after it for as many words as before it did") for i, _, _, b in rows], "doc_id long, source string, title string, body string")
    lines = {(r.doc_id, r.line_no) for r in furniture(whole, "doc_id", "source", "title", "body", share=0.3, long=12, rules=False).collect()}
    assert {(i, k) for i in range(60) for k in ((2, 3) if i % 2 else (2,))} == lines


def test_letters_without_a_counterpart_are_named_and_stay():
    from shelfmark.llm.lookalikes import Rewriter

    change = Rewriter({})
    assert change.rewrite("abшd") == ("abшd", {"mixed"}) and change.rewrite("naд") == ("naд", {"mixed"})
    assert change.rewrite("brυsһ шаl") == ("brush шаl", {"script", "mixed"}) or change.rewrite("brυsһ")[1] == {"script"}


def test_error_budget_of_leaks(spark):
    from shelfmark.llm.leaks import allowed_errors, leaked_items

    assert allowed_errors(20, 10, None) == (3, 5) and allowed_errors(20, 10, 0.3) == (6, 2) and allowed_errors(20, 10, 0.0) == (0, 5)
    words = [f"w{i}" for i in range(20)]
    texts = []
    for edits in range(9):
        changed = list(words)
        for k in range(edits):
            changed[2 + 2 * k if edits > 6 else 3 * k] = f"x{k}"
        texts.append(("before " * 3 + " ".join(changed) + " after")) 
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, "w1 " * 30)], "item_id long, text string")
    for budget, most in ((0.0, 0), (0.1, 2), (0.3, 6), (None, 3)):
        got = {r.doc_id for r in leaked_items(docs, items, "doc_id", "text", "item_id", "text", budget=budget).where("distance <= errors").collect()}
        assert got == set(range(most + 1)), budget
    long = spark.createDataFrame([(1, " ".join(words) + " filler" * 200_000 + " " + " ".join(words)), (2, "w1 " * 30_000)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.run) for r in leaked_items(long, items, "doc_id", "text", "item_id", "text").collect()} == {(1, 1, 20), (2, 2, 30)}


def test_blocks_of_items_by_characters(spark, monkeypatch):
    from shelfmark.llm import leaks

    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(40)]
    docs = spark.createDataFrame([(i, "own text " + t) for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 700)
    found = leaks.leaked_items(docs, spark.createDataFrame(items, "item_id long, text string"), "doc_id", "text", "item_id", "text")
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(40)}


def test_encoding_of_repeated_rows_and_very_long_texts(spark):
    from tokenizers import Tokenizer

    from shelfmark.llm.encoding import ByteBpe

    rng = random.Random(2)
    long = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(20_000))
    rows = [(1, "zqxv text"), (1, "zqxv text"), (1, None), (2, long), (2, ""), (3, "x" * 5_000 + " zqxv")]
    own = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    own.encode_special_tokens = True
    got = sorted((r.doc_id, r.ids) for r in ByteBpe("/opt/tokenizers/byte_bpe_50k.tiktoken").encode(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect())
    assert got == sorted((i, own.encode(t, add_special_tokens=False).ids if t else []) for i, t in rows)


def test_numbers_of_lines_alike_in_all_ways_of_counting(spark):
    from shelfmark.llm.lines import repeated_lines

    docs = spark.createDataFrame([(i, "s", f"notice {i}\nown {chr(97 + i)}") for i in range(8)], "doc_id long, source string, body string")
    dates = spark.createDataFrame([(i, "2020-01-01") for i in range(8)], "doc_id long, d string").select("doc_id", F.col("d").cast("date").alias("published_on"))
    rows = [sorted((r.n_docs, r.n_clusters, r.n_dates) for r in repeated_lines(docs, "doc_id", "source", "body", dates=d).collect()) for d in (None, dates)]
    assert rows == [[(8, 8, 1)], [(8, 8, 1)]]


def test_runs_that_many_documents_share_shuffle_no_pairs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(60)) for _ in range(600)]
    texts += [f"{t[:-1]}{c} h" for t, c in zip(texts[:20], "gh" * 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    store, none = spark._jsc.sc().statusStore(), spark._sc._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda x: [x.apply(k) for k in range(x.size())])(store.stageList(None, False, False, none, None))}
    before = stages()
    got = {(r.id_a, r.id_b) for r in similar_pairs(docs, "id", ["body"], width=3, threshold=0.6).collect()}
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert max(n for k, n in stages().items() if k not in before) <= 65 * len(texts)  # bands; pairs of documents that share a run are over 100,000
    sets = [set(zip(w, w[1:], w[2:])) for w in map(str.split, texts)]
    assert got == {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])} and len(got) >= 20
