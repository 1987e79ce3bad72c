import random

import numpy as np

from loomspark.llm import packing, split


def brute_fill(sizes, capacity):
    room, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
        if k is None:
            k = len(room)
            room.append(capacity)
        room[k] -= sizes[i]
        out[i] = k
    return out


def test_first_fit_decreasing_equals_brute_force():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 50, 333):
        sizes = [rng.randint(0, 30) for _ in range(n)]
        assert packing.first_fit_decreasing(np.array(sizes, np.int64), 30).tolist() == brute_fill(sizes, 30)


def test_items_are_whole_unless_above_the_capacity(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 7, i]), "t", rng.choice([None, 0, rng.randint(1, 40), 101, 230])) for i in range(400)]
    sizes = spark.createDataFrame(rows, "doc_id long, tokenizer string, n_tokens long")
    windows = spark.createDataFrame([(1, "t", 40), (2, "t", 100), (3, "t", None), (4, "other", 5), (5, "t", 0)], "window_id long, tokenizer string, capacity_tokens long")
    got = packing.pack_items(sizes, windows, group_items=90).collect()
    assert {r.window_id for r in got} == {1, 2}
    for w, cap in ((1, 40), (2, 100)):
        mine = [r for r in got if r.window_id == w]
        assert sum(r.n_tokens for r in mine) == sum(r[2] or 0 for r in rows)
        assert sum(r.piece == 0 for r in mine) == len(rows)
        fill = {}
        for r in mine:
            fill[r.bin_group, r.bin] = fill.get((r.bin_group, r.bin), 0) + r.n_tokens
        assert max(fill.values()) <= cap
        least = -(-sum(fill.values()) // cap)
        assert len(fill) <= least * 11 / 9 + 6 * len({g for g, _ in fill}) + 1
        for r in mine:
            if r.piece:
                assert r.start_token == r.piece * cap
    assert packing.pack_items(sizes.limit(0), windows).count() == 0
    report = packing.fill_report(packing.pack_items(sizes, windows)).collect()
    assert all(r.containers >= r.least and 0 < r.fill <= 1 for r in report)


def check_split(text, limit, overlap, unit):
    pieces = split.split_text(text, limit, overlap, unit)
    m = split.Measure(text, unit)
    if m.size(0, len(text)) <= limit:
        assert not pieces
        return
    assert "".join(text[i:j] for i, j, _, _ in pieces) == text
    over = max(0, overlap or 0)
    over = over if over < limit else limit // 2
    before = 0
    for n, (i, j, o, size) in enumerate(pieces):
        start = i - o
        assert size == m.size(start, j) and (size <= limit or all(split._joined(text, k) for k in range(i + 1, j)))
        assert before <= start <= i and (n or o == 0) and m.size(start, i) <= over
        if n and over and start > before:
            assert m.size(start - 1, i) > over or split._joined(text, start - 1) or split._joined(text, start)
        before = start


def test_pieces_fit_cover_and_overlap():
    rng = random.Random(1)
    parts = ["word ", "x", ". ", "\n\n", "\n", "漢", "。", "é", "( ", "😀", "́", "\r\n"]
    for _ in range(250):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 300)))
        for unit in ("tokens", "bytes"):
            limit = rng.randint(4, 80)
            check_split(text, limit, rng.choice([0, 0, 1, 5, limit // 3, limit, 2 * limit, None, -3]), unit)


def test_cuts_at_natural_boundaries():
    text = "One two three four.\n\nFive six seven eight nine."
    assert [text[i:j] for i, j, _, _ in split.split_text(text, 30, 0, "bytes")] == ["One two three four.\n\n", "Five six seven eight nine."]
    assert split.split_text("a" * 10, 10, 3, "bytes") == [] and split.split_text("", 0, 0, "bytes") == []
    assert split.split_text(None, 3, 0, "bytes") == [] and split.split_text("abc", None, 0, "bytes") == []
    check_split("a" * 200_000, 1000, 100, "bytes")


def test_items_and_limits(spark):
    a = spark.createDataFrame([(1, "i", "word " * 100, 9), (2, "i", "word " * 4, 9), (3, "i", None, 9), (4, None, "word " * 100, 9), (5, "j", "word " * 100, 9)], "anchor_key long, id string, content string, size int")
    p = spark.createDataFrame([(1, ["i", "i", "zz"], 20, 5), (2, ["i", "j"], 125, None), (3, ["i"], None, 5), (4, None, 5, 5), (5, ["i"], 4, 1)], "pack_id long, anchors array<string>, max_tokens long, overlap_tokens long")
    f = spark.createDataFrame([(1, 1, "é" * 50), (2, 1, "é" * 5), (3, None, "é" * 50), (4, 2, "é" * 50), (5, 1, None)], "file_id long, config_id int, content string")
    c = spark.createDataFrame([(1, 10, 3), (2, None, 3)], "config_id int, truncate_size long, overlap_bytes long")
    got = sorted(map(tuple, split.oversized(a, p, f, c).select("item_kind", "item_id", "limit_id").collect()))
    assert got == [("anchor", 1, 1), ("anchor", 1, 5), ("anchor", 2, 5), ("file", 1, 1)]
    pieces = split.split_pieces(a, p, f, c).orderBy("item_kind", "item_id", "limit_id", "piece").collect()
    assert "".join(r.content[r.overlap_chars :] for r in pieces if (r.item_kind, r.item_id, r.limit_id) == ("anchor", 1, 1)) == "word " * 100
    assert all(r.size <= 10 for r in pieces if r.item_kind == "file")
    assert split.split_pieces(a.limit(0), p.limit(0), f.limit(0), c.limit(0)).count() == 0
