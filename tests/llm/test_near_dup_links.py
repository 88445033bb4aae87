"""Links against an exact join: recall by similarity at both widths, repeated ids, and rows without an id."""

import random

import pytest

from tesselwork.llm import near_dup
from tesselwork.llm.near_dup import near_duplicates, one_of_each

DRAW = random.Random(11)


def word():
    return "".join(DRAW.choice("abcdefghijklmnopqrst") for _ in range(7))


def changed(words, n):
    out = words[:]
    for i in DRAW.sample(range(len(out)), n):
        out[i] = word()
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_recall_of_all_links_by_exact_join(spark, width):
    """Pairs at 0.8 and a little above and below it: each is found if and only if its sets say so."""
    from test_results import components_of

    texts, at = {}, 0
    for _ in range(400):
        base = [word() for _ in range(DRAW.randint(60, 160))]
        hits = max(1, round(len(base) * DRAW.uniform(0.02, 0.13) / (1 if width == 2 else 2.9)))
        texts[at], texts[at + 1] = " ".join(base), " ".join(changed(base, hits))
        at += 2
    want = components_of(texts, width)
    linked = sum(want[i] != i for i in texts)
    assert 120 < linked < 390  # some pairs on either side
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=width).collect()}
    assert got == want


@pytest.fixture(scope="module")
def shared():
    a, b = [word() for _ in range(80)], [word() for _ in range(80)]
    near = " ".join(changed(b, 3))
    a, b = " ".join(a), " ".join(b)
    return [(5, a), (5, b), (7, b), (9, near)], near


def test_rows_that_share_an_id_lose_no_link(spark, shared):
    rows, _ = shared
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got == [(5, 5), (5, 5), (7, 5), (9, 5)]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame([(8, "x y z " + rows[0][1]), *rows[2:]], "doc_id long, text string"), width=2).collect())
    assert got == [(7, 7), (8, 8), (9, 7)]


def test_rows_without_an_id_meet_near_copies(spark, shared):
    rows, near = shared
    frame = spark.createDataFrame([(None, near), (7, rows[1][1]), (None, "alone in the world")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(frame, width=2).collect()}
    assert [v for (i, n), v in got.items() if i is None and n > 5] == [(7, False)] and got[7, 79] == (7, True) and got[None, 3] == (None, False)


def test_one_of_each_group_stays(spark, shared):
    rows, near = shared
    table = [*rows, (7, rows[1][1]), (None, near), (None, "alone in the world"), (None, "alone in the world"), (1, None), (1, None), (2, "")]
    frame = spark.createDataFrame([(i, t, "keep", 3) for i, t in table], "doc_id long, text string, h string, node long")
    out = one_of_each(frame, width=2)
    assert out.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(5, rows[0][1]), (5, rows[1][1]), (None, "alone in the world"), (1, None), (1, None), (2, "")], key=str)


def test_large_buckets_in_blocks(spark):
    """Clusters that share many words but lie under the threshold, and chains between them."""
    from test_results import components_of

    core = [word() for _ in range(60)]
    texts = {}
    for c in range(6):
        centre = changed(core, 9)
        for k in range(25):
            texts[100 * c + k] = " ".join(changed(centre, DRAW.randint(0, 4)))
    want = components_of(texts, 2)
    assert 6 <= len(set(want.values())) < len(texts)
    kept = near_dup.BLOCK
    for block in (kept, 10):
        near_dup.BLOCK = block
        try:
            got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=2).collect()}
        finally:
            near_dup.BLOCK = kept
        assert got == want
