import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1] / "evidentia"


def test_nothing_else_imports_the_corpus_operators():
    for f in ROOT.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"evidentia\.llm|from \.+llm|import llm", f.read_text()), f


def test_no_local_checkpoints():
    assert not [f for f in ROOT.rglob("*.py") if "localCheckpoint(" in f.read_text()]


def test_entry_has_the_three_functions():
    import __spark_entry__ as entry

    assert callable(entry.entry) and set(entry.oracle_sql()) <= set(entry.queries())
