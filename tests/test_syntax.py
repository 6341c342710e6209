import pytest
from hypothesis import given
from hypothesis import strategies as st

from shelfmark.plans.syntax import Not, emit, parse, proximity

VECTORS = [
    ("golden", '"golden"*'), ("golden coffin tomb", '"golden" AND "coffin" AND "tomb"*'), ("golden coffin ", '"golden" AND "coffin"*'), ("a", '"a"'), ("cat a", '"cat" AND "a"'),
    ("G7510", '("G7510"* OR "G"* + "7510"*)'), ("G 7510", '("G7510"* OR "G"* + "7510"*)'), ("G7510 tomb", '("G7510" OR "G" + "7510") AND "tomb"*'),
    ("A644_NS", '("A644NS"* OR "A644"* + "NS"* OR "A"* + "644"* + "NS"*)'), ("HUMFA_14-11-206", '("HUMFA1411206"* OR "HUMFA"* + "14"* + "11"* + "206"*)'),
    ('golden" OR category:collection', '"golden" AND "OR" AND "category" AND "collection"*'), ('say "hello"', '"say" AND "hello"'), ("", None), (" \t\n", None),
    ('"golden coffin"', '"golden" + "coffin"'), ("khufu OR cheops", '"khufu" OR "cheops"*'), ("title:giza tomb", '{title}:"giza" AND "tomb"*'), ("tomb -equipment", '"tomb" NOT "equipment"*'),
    ("-equipment", '"equipment"*'), ("near(coffin gold, 5)", 'NEAR("coffin" "gold"*, 5)'), ("title:(giza tomb)", '{title}:("giza" AND "tomb"*)'), ("body:tomb OR title:giza", '{body}:"tomb" OR {title}:"giza"*'),
    ("category:collection", '"category" AND "collection"*'), ("(khufu OR cheops) pyramid", '("khufu" OR "cheops") AND "pyramid"*'), ("(khufu", '"khufu"*'), ("near(khufu pyramid", '"near" AND "khufu" AND "pyramid"*'),
]


@pytest.mark.parametrize("text,want", VECTORS)
def test_expressions(text, want):
    node = parse(text)
    assert (emit(node) if node else None) == want


def test_corrections_widen_but_never_exclude():
    known = {"cartouchr": ["cartouche"]}.get
    assert emit(parse("cartouchr limestone"), correct=known) == '("cartouchr" OR "cartouche") AND "limestone"*'
    assert emit(parse("limestone -cartouchr granite"), correct=known) == '("limestone" AND "granite"*) NOT "cartouchr"'
    assert emit(parse("title:cartouchr"), correct=known) == '{title}:"cartouchr"*'


def test_without_positions_adjacency_is_conjunction():
    assert emit(parse('"golden coffin" tomb'), positions=False) == '("golden" AND "coffin") AND "tomb"*'
    assert emit(parse("near(coffin gold)"), positions=False) == '"coffin" AND "gold"*'


def test_proximity_needs_two_bare_words():
    phrase, near = proximity(parse("copper kiln ven"))
    assert emit(phrase) == '"copper" + "kiln" + "ven"' and emit(near) == 'NEAR("copper" "kiln" "ven"*, 8)'
    assert proximity(parse("copper")) is None and proximity(parse("copper OR kiln")) is None
    assert proximity(parse('copper "kiln vent"')) is None


@given(st.text(alphabet='abG7 "()-,:\n_é', max_size=30))
def test_no_text_fails(text):
    node = parse(text)
    if node is not None:
        assert emit(node)


def test_exclusions_stack():
    node = parse("a -b -c")
    assert isinstance(node, Not) and isinstance(node.left, Not)


def test_every_row_has_its_expression(spark, tmp_path):
    from shelfmark.queries import query_emit_all

    rows = [
        (1, "cartouchr limestone", {"cartouchr": ["cartouche", None]}, '("cartouchr" OR "cartouche") AND "limestone"*'), (2, "limestone -cartouchr granite", {"cartouchr": ["cartouche"]}, '("limestone" AND "granite"*) NOT "cartouchr"'),
        (3, "limestone cartouchr", {"cartouchr": ["Cartouche", "cart"], "other": ["x"]}, '"limestone" AND ("cartouchr"* OR "Cartouche"* OR "cart"*)'), (3, "limestone cartouchr", {"cartouchr": ["Cartouche", "cart"], "other": ["x"]}, '"limestone" AND ("cartouchr"* OR "Cartouche"* OR "cart"*)'),
        (4, "reading-room oak", None, '"reading" AND "room" AND "oak"*'), (5, "title:cartouchr", {"cartouchr": ["cartouche"]}, '{title}:"cartouchr"*'), (6, "tomb", {"tomb": None}, '"tomb"*'), (7, " ", {"a": ["b"]}, None), (8, None, None, None),
    ]
    spark.createDataFrame([r[:3] for r in rows], "query_id long, q string, corrections map<string, array<string>>").write.parquet(f"{tmp_path}/query_vectors.parquet")
    got = sorted(map(tuple, query_emit_all(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((k, q, fts) for k, q, _, fts in rows), key=str)
