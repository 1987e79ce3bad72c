import random

from loomspark.functions.paths import lexical_path
from loomspark.operators.hierarchy import cycle_members, descendants, hierarchy


def brute(links):
    up = {}
    for n, p in links:
        if n is not None and p is not None:
            up[n] = min(p, up.get(n, p))
    out = {}
    for n in {*up, *up.values()}:
        seen, x = [], n
        while x in up and x not in seen:
            seen.append(x)
            x = up[x]
        out[n] = (min(seen[seen.index(x):]), -1) if x in up else (x, len(seen))
    return out


def run(spark, links, **kw):
    df = spark.createDataFrame(links, "node string, parent string")
    return hierarchy(df, **kw)


def test_small_forest_with_cycles(spark):
    links = [("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "z"), ("s", "s"), ("t", "s"), ("b", "a"), (None, "q"), ("q", None)]
    got = {r.path: (r.root_path, r.depth) for r in run(spark, links).collect()}
    assert got == brute(links)
    assert got["w"] == ("x", -1) and got["t"] == ("s", -1) and got["c"] == ("a", 2)


def test_random_forests_in_small_blocks(spark):
    rng = random.Random(3)
    for size, block in ((60, 7), (200, 11)):
        nodes = [f"n{i:03d}" for i in range(size)]
        rng.shuffle(nodes)
        links = [(n, rng.choice(nodes[: max(1, i)]) if rng.random() < 0.9 else rng.choice(nodes)) for i, n in enumerate(nodes) if rng.random() < 0.97]
        tree = run(spark, links, with_paths=True, block_rows=block)
        want = brute(links)
        rows = tree.collect()
        assert {r.path: (r.root_path, r.depth) for r in rows} == want and len(rows) == len(want)
        up = dict(links)
        for r in rows:
            if r.depth < 0:
                assert r.way is None
                continue
            assert r.way[0] == r.root_path and r.way[-1] == r.path and len(r.way) == r.depth + 1
            assert all(up[b] == a for a, b in zip(r.way, r.way[1:]))
        pairs = descendants(tree).collect()
        assert len(pairs) == sum(d for _, d in want.values() if d > 0)
        assert cycle_members(tree).count() == sum(d < 0 for _, d in want.values())


def test_one_long_ring_over_all_blocks(spark):
    n = 40
    links = [(f"r{(7 * i) % n:02d}", f"r{(7 * (i + 1)) % n:02d}") for i in range(n)] + [("leaf", "r05")]
    got = {r.path: (r.root_path, r.depth) for r in run(spark, links, block_rows=3).collect()}
    assert got == {**{f"r{i:02d}": ("r00", -1) for i in range(n)}, "leaf": ("r00", -1)}


def test_long_chain(spark):
    links = [(f"{i + 1:05d}", f"{i:05d}") for i in range(3000)]
    got = {r.path: r.depth for r in run(spark, links, block_rows=500).collect()}
    assert got == {f"{i:05d}": i for i in range(3001)}


def test_ways_of_a_long_chain(spark):
    links = [(f"{i + 1:05d}", f"{i:05d}") for i in range(2000)] + [("side", "01000"), ("ring", "ring"), ("low", "ring")]
    got = {r.path: r.way for r in run(spark, links, with_paths=True, block_rows=300).collect()}
    names = [f"{i:05d}" for i in range(2001)]
    assert got == {**{n: names[: i + 1] for i, n in enumerate(names)}, "side": [*names[:1001], "side"], "ring": None, "low": None}


def test_empty_and_extra_columns(spark):
    assert run(spark, []).count() == 0
    df = spark.createDataFrame([("b", "a", "t", 1)], "node string, parent string, top string, gap int")
    assert {r.path for r in hierarchy(df).collect()} == {"a", "b"}


def test_spellings(spark):
    cases = {" a/./b//c ": "a/b/c", ".\\a\\b": "a/b", "a/x/../b": "a/b", "../a": "a", "a/b/../../c": "c", "./": None, "": None, None: None, "/a": "a", "a..b/c": "a..b/c", "a/..": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.q for r in df.select("p", lexical_path(df.p).alias("q")).collect()}
    assert got == cases
