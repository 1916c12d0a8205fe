"""Leaks, packing and splitting: brute force, round trips, nulls, empty and long texts, copies, clashing columns."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismara.llm import leaks, packing, splitting
from prismara.llm.fmindex import FMIndex, suffix_array
from prismara.llm.splitting import Cutter
from prismara.llm.tokens import encoder

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
DOCS = "doc_id long, text string, item_id string, `end` int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, doc_id string, word int")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index_finds_every_occurrence(text, pattern):
    full = np.array([*text, 0])
    assert suffix_array(full).tolist() == sorted(range(len(full)), key=lambda i: full[i:].tolist())
    index = FMIndex(np.array(text, np.int64), 4, 3)
    low, high = index.ranges(np.array([pattern]))
    want = [i for i in range(len(text)) if text[i : i + len(pattern)] == pattern]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def brute_leaks(texts, tests, width):
    held = defaultdict(set)
    for i, t in tests:
        w = leaks.words(t or "")
        for k in range(len(w) - width + 1):
            held[tuple(w[k : k + width])].add(i)
    out = set()
    for d, t in texts:
        w = leaks.words(t or "")
        for k in range(len(w) - width + 1):
            out |= {(d, i) for i in held.get(tuple(w[k : k + width]), ())}
    return {x for x in out if None not in x}


@pytest.mark.parametrize("shard", [20, 10_000])
def test_leaks_equal_brute_force(spark, shard):
    rng = random.Random(shard)
    say = lambda n: rng.choice([" ", ", ", "\r\n", "_"]).join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(WORDS, k=n))
    tests = [(i, say(rng.randint(0, 12))) for i in range(12)] + [(90, None), (91, ""), (92, "One Two Three four FIVE")]
    texts = [(d, say(rng.randint(0, 30))) for d in range(40)] + [(100, None), (101, ""), (102, "x one, two\n+three FOUR-five! y"), (None, "one two three four five")]
    texts += [texts[3], (200, " ".join([*["filler"] * 5_000, "one two three four five", *["filler"] * 5_000]))]
    got = leaks.spans(docs(spark, texts), items(spark, tests), 5, shard_words=shard).select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in got.collect()} == brute_leaks(texts, tests, 5)


def test_leak_spans_merge_and_number_words(spark):
    got = leaks.spans(docs(spark, [(1, "zero a b c d e f two"), (2, "a b c x a b c")]), items(spark, [(7, "A B C D E F"), (8, "a b c")]), 3)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7, 1, 7), (1, 8, 1, 4), (2, 7, 0, 3), (2, 7, 4, 7), (2, 8, 0, 3), (2, 8, 4, 7)]
    assert leaks.spans(docs(spark, []), items(spark, [(1, "a b c")]), 3).count() == 0
    assert leaks.spans(docs(spark, [(1, "a b c")]), items(spark, []), 3).count() == 0


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    rows, tests = [(d, " ".join(WORDS[d % 4 :])) for d in range(8)], [(i, " ".join(WORDS[i:])) for i in range(5)]
    whole = {tuple(r) for r in leaks.leaked(docs(spark, rows), items(spark, tests), 5).collect()}
    monkeypatch.setattr(leaks, "ITEM_CHARS", 60)
    assert {tuple(r) for r in leaks.leaked(docs(spark, rows), items(spark, tests), 5).collect()} == whole == brute_leaks(rows, tests, 5)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(5)
    rows = [(d, " ".join(rng.choices(WORDS, k=rng.randint(0, 120)))) for d in range(300)] + [(1_000, None), (1_001, ""), (1_002, "word " * 1_000), (None, "lost")]
    rows += [(5_000 + i, "one text many times over") for i in range(200)] + [rows[4]]
    packed = packing.pack(docs(spark, rows), 256).collect()
    sizes = {d: len(encoder().encode_ordinary(t or "")) for d, t in rows if d is not None}
    by_doc, by_box = defaultdict(list), defaultdict(int)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_box[r.container_id] += r.n_tokens
    assert set(by_doc) == set(sizes) and max(by_box.values()) <= 256
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in pieces) == sizes[d]
        assert len(pieces) == max(1, -(-sizes[d] // 256)) and all(r.n_tokens == 256 for r in pieces[:-1])
        assert [r.first_token for r in pieces] == [256 * i for i in range(len(pieces))]
    assert sum(by_box.values()) / (256 * len(by_box)) > 0.95
    assert packing.pack(docs(spark, []), 256).count() == 0


def test_hilbert_order_moves_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).max() == 1


def whole(text, limit, overlap):
    cutter = Cutter(limit, overlap)
    pieces = cutter.pieces(text)
    count = lambda t: len(encoder().encode_ordinary(t))
    if not pieces:
        return count(text) <= limit
    assert "".join(p[4][p[1] - p[0] :] for p in pieces) == text
    assert all(text[p[0] : p[2]] == p[4] and count(p[4]) <= limit for p in pieces)
    assert all(a[2] == b[1] and b[0] <= b[1] for a, b in zip(pieces, pieces[1:]))
    return all(count(text[b[0] : b[1]]) >= overlap - 2 or b[0] == 0 for b in pieces[1:])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*WORDS, "\n", "\n\n", "  ", ". ", "日本語。", "😀", "diff --git a b\n", "@@ -1 +1 @@\n", "\r\n", "\t", "é"]), max_size=300), st.integers(16, 60))
def test_split_round_trip(parts, limit):
    assert whole("".join(parts), limit, limit // 4)


@pytest.mark.parametrize("text", ["", "x" * 20_000, "あ" * 3_000, "😀" * 2_000, " \n" * 4_000, "a b " * 4_000, "\n" * 5_000, "one line, no end. " * 2_000])
def test_split_of_awkward_texts(text):
    assert whole(text, 64, 16)


def test_split_prefers_files_to_lines():
    body = lambda w: "".join(f"+    {w} = {w}({i})\n" for i in range(14))
    text = "message\n\n" + "".join(f"diff --git a/{w} b/{w}\n@@ -1 +1 @@\n{body(w)}" for w in WORDS)
    pieces = Cutter(400, 0).pieces(text)
    cuts = [p[1] for p in pieces[1:]]
    assert len(cuts) > 2 and sum(text[c:].startswith("diff --git") for c in cuts) >= 0.7 * len(cuts)


@pytest.mark.parametrize("end", [". ", " "])
def test_split_of_one_line_follows_topics(end):
    """Without a line end, valleys at sentence ends count, and without these those between words."""
    rng = random.Random(11)
    topics = [[f"{a}{b}" for b in ("ing", "er", "ed", "ly", "ness", "able")] for a in ("stone", "river", "cloud", "metal", "garden", "window")]
    text, changes = "", []
    for t in range(12):
        changes.append(len(text))
        text += "".join(" ".join(rng.choices(topics[t % 6], k=8)) + end for _ in range(10))
    assert whole(text, 400, 0)
    cuts = [p[1] for p in Cutter(400, 0).pieces(text)[1:]]
    near = sum(min(abs(c - x) for x in changes) <= 40 for c in cuts)
    assert len(cuts) >= 4 and near >= 0.7 * len(cuts)


def test_phrases_name_every_item_once():
    made = leaks.Phrases([(3, "a b c d"), (1, "b c d e"), (1, "a b c"), (9, None), (4, "a")], 3)
    at = {tuple(p): made.items[made.starts[i] : made.starts[i + 1]].tolist() for i, p in enumerate(made.patterns)}
    word = made.vocabulary
    assert at == {tuple(word[w] for w in "abc"): [1, 3], tuple(word[w] for w in "bcd"): [1, 3], tuple(word[w] for w in "cde"): [1]}
    assert len(leaks.Phrases([], 3).patterns) == 0 == len(leaks.Phrases([(1, "a b")], 3).patterns)


def test_split_rows(spark):
    rows = [(1, "short"), (2, None), (3, ""), (4, "word and word again. " * 200), (None, "word " * 900), (5, "line of words\n" * 400)]
    got = splitting.split(docs(spark, rows), 64, 16)
    assert got.columns == ["doc_id", "piece_no", "start", "new_from", "end", "n_tokens", "text"]
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {4, 5}
    for d, text in ((4, rows[3][1]), (5, rows[5][1])):
        pieces = got.where(F.col("doc_id") == d).orderBy("piece_no").collect()
        assert "".join(p.text[p.new_from - p.start :] for p in pieces) == text
    with pytest.raises(ValueError):
        splitting.split(docs(spark, rows), 64, 40)


def test_split_gives_repeated_rows_once(spark):
    long, longer = "line of words\n" * 400, "other line of words\n" * 400
    rows = [(1, long), (2, long), (1, long), (3, "short"), (3, longer), (4, long), (4, longer), (None, long)]
    got = splitting.split(docs(spark, rows), 64, 16).collect()
    assert len({(r.doc_id, r.piece_no) for r in got}) == len(got) and {r.doc_id for r in got} == {1, 2, 3, 4}
    for d, text in ((1, long), (2, long), (3, longer), (4, longer)):
        assert "".join(p.text[p.new_from - p.start :] for p in sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece_no)) == text
