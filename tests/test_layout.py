"""The library stands without its training-data subpackage."""

import ast
import glob
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_llm():
    for path in glob.glob(f"{ROOT}/vitrail/**/*.py", recursive=True):
        if "/llm/" in path:
            continue
        for node in ast.walk(ast.parse(open(path).read())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[0] == "capture_id" and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and all(isinstance(q, str) for q in entry.oracle_sql().values())


def test_scans_read_only_what_they_need(spark, sf):
    from vitrail.operators import htmltree, timeline

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    events = plan(timeline.QUERIES["interaction_score"](spark, sf))
    assert "value" not in events.split("ReadSchema: ")[1].split(">")[0]
    pages = plan(htmltree.QUERIES["html_node_counts"](spark, sf))
    assert "url" not in pages.split("ReadSchema: ")[1].split(">")[0] and "Python" not in pages
