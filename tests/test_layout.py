"""The training-data subpackage can be taken away."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.module or ""
            yield from (f"{node.module}.{a.name}" for a in node.names)


def test_nothing_else_imports_it():
    others = [p for p in (ROOT / "curatrix").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert len(others) > 15
    assert not [(p.name, i) for p in others for i in imports(p) if i.startswith("curatrix.llm") or i == "corpus_pipeline"]


def test_every_query_has_its_sql_or_a_reason():
    import __spark_entry__ as entry

    without = set(entry.queries()) - set(entry.oracle_sql())
    assert without <= {"op1_sharding", "op2_quality", "op4_decontamination", "op5_hmm", "op6_secrets", "op7_neardup", "op8_bpe", "op10_toxicity", "pipeline"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).first()
    assert 0 <= row.score <= 100
