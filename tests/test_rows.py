import json

import pytest

from loomspark.operators import anchors as A
from loomspark.operators import corpus, results
from loomspark.operators import rows as R


def _graph(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_dependency_rows(spark):
    graph = _graph(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")])
    known = spark.createDataFrame([("a", "rust"), ("b", "rust"), ("b", "rust"), ("c", None), (None, "rust"), ("lone", "python")], "path string, language string")
    rows = [(r.path, json.loads(r.data)) for r in R.dependency_rows(graph, known).collect()]
    assert len(rows) == 8
    told = {(p, k): d[k] for p, d in rows for k in d if k.startswith("depend")}
    assert told["a", "depends_on"] == ["b", "c"] and told["c", "depended_by"] == ["a", "b"] and told["lone", "depends_on"] == []
    assert [json.loads(r.data)["depended_by"] for r in R.dependency_rows(graph, known, "c", reverse=True).collect()] == [["a", "b"]]
    assert R.dependency_rows(graph, known, "unknown").count() == 0
    assert R.dependency_rows(graph.limit(0), known.limit(0)).count() == 0


def test_a_hot_file_is_no_single_value(spark):
    graph = _graph(spark, [(f"f{i:04d}", "hot") for i in range(500)])
    known = spark.createDataFrame([("hot", "rust")], "path string, language string")
    got = [json.loads(r.data)["depended_by"] for r in R.dependency_rows(graph, known, "hot", reverse=True, names=50).collect()]
    assert len(got) == 10 and max(map(len, got)) < 120 and sorted(sum(got, [])) == [f"f{i:04d}" for i in range(500)]


def test_cycle_and_tree_rows(spark):
    cycles = spark.createDataFrame([("b", "a"), ("a", "a"), *((f"z{i}", "z0") for i in range(5))], "path string, cycle string")
    got = {r.path: r for r in R.cycle_rows(cycles, names=3).collect()}
    assert got["a"].errors[0].code == "CIRCULAR_DEPENDENCY" and got["a"].errors[0].message.endswith("a -> b") and json.loads(got["a"].data) == {"cycle": ["a", "b"], "cycle_length": 2}
    assert json.loads(got["z0"].data) == {"cycle_length": 5}
    assert R.cycle_rows(cycles.limit(0)).count() == 0
    graph = _graph(spark, [("a", "b")])
    assert R.tree_rows(graph, None).first().errors[0].code == "TREE_REQUIRES_FILE" and R.tree_rows(graph, "a").first().excerpt == "b" and R.tree_rows(graph, "q").count() == 0


def test_mark_and_lint_rows(spark):
    files = spark.createDataFrame([("p", "one\ntwo\n"), ("e", "")], "path string, content string")
    specs = spark.createDataFrame([("p", 1, 9, "a", ["t"], 1), ("p", 3, 3, "b", None, None), ("p", 4, 4, "c", [], 1), ("p", 0, 1, "d", [], 1), ("p", 2, 1, "f", [], 1), ("none", 1, 1, "g", [], 1)], "path string, start_line long, end_line long, id string, tags array<string>, version int")
    got = {r.excerpt: (r.kind, r.range and (r.range.start, r.range.end), r.confidence) for r in R.mark_rows(files, specs).collect()}
    assert got["Anchor 'a' marked successfully"] == ("anchor", (1, 11), "high") and got["Anchor 'b' marked successfully"][1] == (3, 5)
    assert sum(v == ("error", None, "low") for v in got.values()) == 4
    assert {r.path: (r.marks, r.failed) for r in A.mark(files, specs.filter("path = 'p'")).collect()} == {"p": (2, 3)}
    done = A.mark(files, specs.filter("id in ('a', 'b')")).selectExpr("path", "new_content as content")
    asked = spark.createDataFrame([("p", "a")], "path string, id string")
    assert [(r.kind, r.excerpt) for r in R.unmark_rows(A.unmark(done, asked)).collect()] == [("anchor", "Anchor 'a' removed")]
    bad = spark.createDataFrame([("p", "<!--Q:begin id=x-->\n<!--Q:end id=x-->\n<!--Q:begin id=y-->\n")], "path string, content string")
    assert {(r.errors[0].code, r.confidence) for r in R.lint_rows(A.lint(bad)).collect()} == {("EMPTY_ANCHOR", "medium"), ("UNPAIRED_BEGIN", "high")}
    assert json.loads(R.anchor_rows(A.parse(done)).filter("excerpt is not null").first().data)["id"] in ("a", "b")


def test_formats_and_line_ranges(spark):
    rows = results.to_results(spark.createDataFrame([("b",), ("a",), (None,)], "path string"), "file", "scan")
    assert [x.get("path") for x in json.loads(results.written(rows, "json").first().text)] == ["a", "b", None]
    assert results.written(rows, "JSONL").count() == 3 and json.loads(results.written(rows.limit(0), "json").first().text) == []
    with pytest.raises(ValueError):
        results.written(rows, "xml")
    assert corpus.line_range("3:7") == (3, 7)
    for text in ("3", "3:7:9", "a:3", "7:3", "0:3", "-1:2", ""):
        with pytest.raises(ValueError):
            corpus.line_range(text)
