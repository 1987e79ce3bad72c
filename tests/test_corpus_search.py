import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.globs import path_glob, search_glob
from loomspark.functions.hashing import xxh3_hex
from loomspark.functions.heuristic import CJK_RANGES, SIGNS, heuristic_tokens
from loomspark.functions.paths import base_name, extension
from loomspark.operators import corpus, search
from loomspark.sources import changes, directory

ALPHABET = "aB1 _.,\n\r\t\x00\xa0é漢。！😀́<-"


def random_texts(n=120, size=40):
    rng = random.Random(9)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def lines_model(t):
    parts = t.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def tokens_model(t):
    cjk = sum(any(a <= ord(c) <= b for a, b in CJK_RANGES) for c in t)
    sign, low = sum(c in SIGNS for c in t), sum(ord(c) < 128 for c in t)
    up = lambda a, b: -(-a // b)
    return up(low - sign, 4) + up(sign, 2) + up(2 * cjk, 3) + up(len(t) - low - cjk, 2)


def test_scalars_against_a_model(spark):
    texts = random_texts() + ["", "a", "\n", "\n\n", "x\r\ny", "word " * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], "i int, t string")
    c = F.col("t")
    rows = df.select("i", "t", T.lines_of(c).alias("lines"), T.line_count(c).alias("n"), T.chars_no_space(c).alias("ns"), T.english_words(c).alias("w"), heuristic_tokens(c).alias("tok"), T.utf8_cut(c, 7).alias("cut"), xxh3_hex()("t").alias("h")).collect()
    import re

    import xxhash

    for r in rows:
        if r.t is None:
            assert r.tok == 0 and r.lines is None and r.h == ""
            continue
        assert r.lines == lines_model(r.t) and r.n == len(r.lines)
        assert r.w == len(re.findall("[A-Za-z0-9]{2,}", r.t)) and r.tok == tokens_model(r.t)
        best = r.t
        while len(best.encode()) > 7:
            best = best[:-1]
        assert r.cut == best and r.h == xxhash.xxh3_64_hexdigest(r.t.encode())
    assert xxhash.xxh3_64_hexdigest(b"") == "2d06800538d394c2"


def test_keywords_and_previews(spark):
    cases = [("Parser parser walks THAT tree tree index cache value", ["Parser", "walks", "tree", "index", "cache"], "Parser parser walks THAT tree tree index cache value"), ("the and that", [], "the and that"), ("\n <!-- x -->\n  hi \n", [], "hi"), ("漢字文化 abc", ["漢字文", "字文化", "漢字", "字文", "文化"], "漢字文化 abc"), ("", [], None), ("x" * 80, ["x" * 80], "x" * 60 + "...")]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    for r in df.select("i", T.keywords(F.col("t"), 5).alias("k"), T.preview(F.col("t")).alias("p")).collect():
        assert r.k == cases[r.i][1] and r.p == cases[r.i][2]


def test_globs_and_paths(spark):
    df = spark.createDataFrame([("src/main.rs",), ("src/main.py",), ("vendor/a/b/c",), ("src/vendor",), ("docs/README.md",), ("readme.md",), (".x",), ("a.b/c",)], "path string")
    hit = lambda g: {r.path for r in df.filter(path_glob(F.col("path"), g)).collect()}
    assert hit("*.rs") == {"src/main.rs"} and hit("vendor/*") == {"vendor/a/b/c"} and hit("README.md") == {"docs/README.md"} and hit("src*py") == {"src/main.py"} and hit("**/*") == set()
    line = lambda g: {r.path for r in df.filter(search_glob(F.col("path"), g)).collect()}
    assert line("*.md") == {"docs/README.md", "readme.md"} and line("**/b/*") == {"vendor/a/b/c"} and line("src/*") == {"src/main.rs", "src/main.py", "src/vendor"}
    got = {r.path: (r.b, r.e) for r in df.select("path", base_name(F.col("path")).alias("b"), extension(F.col("path")).alias("e")).collect()}
    assert got[".x"] == (".x", "") and got["a.b/c"] == ("c", "") and got["src/main.rs"] == ("main.rs", "rs")


def extract_model(t, a, b, most):
    rows = lines_model(t)[a - 1 : b]
    if len(lines_model(t)) < a:
        return None
    out, n = "", 0
    for k, x in enumerate(rows):
        size = len(x.encode())
        if n + size + 1 > most:
            cut = x
            while len(cut.encode()) > max(0, most - n):
                cut = cut[:-1]
            return (a + k, out + cut, True)
        n += size + (1 if out else 0)
        out = out + "\n" + x if out else x
    return (a + len(rows) - 1, out, False)


def test_extract_against_a_model(spark):
    texts = random_texts(80, 60) + ["", "one\ntwo\nthree\nfour\nfive"]
    df = spark.createDataFrame([(str(i), t, "z") for i, t in enumerate(texts)] + [("n", None, "z")], "path string, content string, excerpt string")
    for a, b, most in ((1, 3, 10), (2, 4, 1000), (1, 100, 25), (100, 200, 10)):
        got = {r.path: (r.range_end, r.excerpt, r.truncated) for r in corpus.extract(df, a, b, most).collect()}
        want = {str(i): m for i, t in enumerate(texts) if (m := extract_model(t, a, b, most))}
        assert got == want
    for a, b in ((10, 5), (0, 10)):
        with pytest.raises(ValueError):
            corpus.extract(df, a, b)


def test_bounded_reads(spark):
    rows = [("ok", b"abc"), ("long", "é".encode() * 10), ("bad", b"a\xffb"), ("nul", b"a\x00b"), ("gone", None), ("none", b"")]
    df = spark.createDataFrame(rows, "path string, raw binary")
    got = {r.path: r for r in corpus.bounded_read(df, truncate_size=5).collect()}
    assert got["long"].content == "éé" and got["long"].truncated and got["long"].warnings == ["FILE_TRUNCATED"]
    assert got["bad"].content == "a�b" and got["bad"].lossy and got["gone"].skipped and got["none"].content == "" and got["nul"].content == "a\x00b"
    strict = {r.path: r.skip_reason for r in corpus.bounded_read(df, size_strategy="skip", encoding_strategy="skip", max_size=6).collect()}
    assert strict == {"ok": None, "long": "too large", "bad": "invalid encoding", "nul": "binary", "gone": "unreadable", "none": None}


def test_search(spark):
    df = spark.createDataFrame([("a/x.md", "one index\nIndex two  \nindexes\nindex\n"), ("a/y.rs", "index"), ("b/z.md", None), ("b/e.md", "")], "path string, content string")
    hits = lambda *a, **k: sorted((r.path, r.line_no) for r in search.match(df, *a, **k).collect())
    assert hits("index") == [("a/x.md", 1), ("a/x.md", 3), ("a/x.md", 4), ("a/y.rs", 1)]
    assert hits("INDEX", ignore_case=True, word=True) == [("a/x.md", 1), ("a/x.md", 2), ("a/x.md", 4), ("a/y.rs", 1)]
    assert hits("index", max_count=1, include=["*.md"]) == [("a/x.md", 1)] and hits("index", exclude=["a/*"], scopes=["b"]) == []
    assert [r.excerpt for r in search.match(df, "two").collect()] == ["Index two"]
    around = search.match(df, "two", context=1).collect()[0]
    assert around.before == ["one index"] and around.after == ["indexes"]
    assert search.count_matches(df.limit(0), "x").collect()[0][0] == 0


def test_scan_and_tree(spark, tmp_path):
    for p, t in {"README.md": "r", "docs/guide.md": "g", "docs/deep/er/x.txt": "x", ".hid/a": "a", "build/o.bin": "o", "src/.gitignore": "*.tmp", "src/a.tmp": "t", "src/main.rs": "m"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    df = directory.read_tree(spark, str(tmp_path), contents=True, ignore="build/")
    got = {r.path: bytes(r.raw) for r in df.filter("not is_dir").collect()}
    assert got == {"README.md": b"r", "docs/guide.md": b"g", "docs/deep/er/x.txt": b"x", "src/main.rs": b"m"}
    assert {r.path for r in corpus.scan(df, kind="dir").collect()} == {"docs", "docs/deep", "docs/deep/er", "src"}
    assert {r.path for r in corpus.scan(df, scope="docs", max_depth=2).collect()} == {"docs/guide.md", "docs/deep"}
    assert [r.path for r in corpus.find(df, "GUIDE").collect()] == ["docs/guide.md"]
    assert directory.read_tree(spark, str(tmp_path), hidden=True).filter("path = '.hid/a'").count() == 1
    assert directory.read_tree(spark, str(tmp_path / "none")).count() == 0
    before = corpus.fingerprint(corpus.scan(df)).collect()
    assert corpus.snapshot(corpus.scan(df), str(tmp_path / "snap")).count() == 8 and before[0].files == 8


def test_ignore_rules_and_split_walk(spark, tmp_path):
    files = {".gitignore": "*.log\n!keep.log\nout/\n/only.txt", ".ignore": "*.bak", ".git/info/exclude": "secret.txt", "a.log": "", "keep.log": "", "x.bak": "", "secret.txt": "", "only.txt": "", "sub/only.txt": "", "out/o.txt": "", "all.me": "", "sub/all.me": ""}
    files |= {f"d{i}/e{k}/f.txt": "t" for i in range(12) for k in range(3)}
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "d1" / "back").symlink_to(tmp_path)
    rules = tmp_path.parent / "rules"
    rules.write_text("all.me\n")
    want = {"keep.log", "sub/only.txt", *(p for p in files if p.startswith("d"))}
    for n in (1, 2, 8):
        got = [r.path for r in directory.read_tree(spark, str(tmp_path), partitions=n, excludes_file=str(rules)).filter("not is_dir").collect()]
        assert sorted(got) == sorted(want), n


def test_large_files_come_whole(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"x" * 200_000)
    read = lambda strategy, **o: corpus.bounded_read(directory.read_tree(spark, str(tmp_path), contents=True, **o), size_strategy=strategy, max_size=150_000 if strategy == "skip" else 64 << 20, disk_size="size").first()
    assert len(read("full").content) == 200_000 and len(read("truncate").content) == 65_536 and read("truncate").truncated
    assert read("skip", max_bytes=1000).skip_reason == "too large"
    assert read("full", max_bytes=1000).skip_reason == "not read whole" and len(read("truncate", max_bytes=66_560).content) == 65_536


def test_latest_and_lines(spark):
    df = spark.createDataFrame([("a", "x\ny", 1, 7), ("a", "z", 2, 8), ("b", None, None, 1), (None, "q", 1, 1)], "path string, text string, mtime_ms long, doc_id long")
    files = corpus.document_files(df)
    assert [(r.path, r.content) for r in files.collect()] == [("a", "z")]
    rows = corpus.lines(spark.createDataFrame([("a", "x\ny", 5)], "path string, content string, line_no int")).collect()
    assert [(r.line_no, r.text) for r in rows] == [(1, "x"), (2, "y")]


def test_json_lists(spark):
    assert [t["timeout"] for t in changes.parse_tasks('{"id": "a", "cmd": "x"}')] == [300]
    assert len(changes.parse_tasks('[{"id": "a", "cmd": "x"}, {"id": "b", "cmd": "y"}]')) == 2
    assert len(changes.parse_tasks('{"tasks": [{"id": "a", "cmd": "x"}], "groups": [{"tasks": [{"id": "b", "cmd": "y"}]}]}')) == 2
    with pytest.raises(ValueError):
        changes.parse_tasks('[{"id": "a"}]')
    assert changes.marks_table(spark, '{"marks": [{"path": "p", "start_line": 1, "end_line": 2, "id": "i"}]}').count() == 1
    assert changes.git_arguments(staged=True, commit="x") == ["diff", "--name-only", "--cached"]
