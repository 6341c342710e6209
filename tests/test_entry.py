import __spark_entry__ as entry


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).schema.names == ["id", "band", "proximity", "score"]


def test_core_stands_alone():
    from pathlib import Path

    root = Path(entry.__file__).parent / "shelfmark"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "shelfmark.llm" not in path.read_text()
