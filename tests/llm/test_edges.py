"""Nulls, empty and long texts, ties, repeats, an empty table and clashing extra columns, for every operator."""

import pytest
from odd_rows import ODD

from tesselwork.llm import chat, html_text, media, pii, quality_model
from tesselwork.llm.catalog import vocabulary
from tesselwork.llm.mixing import mix_sources
from tesselwork.llm.near_dup import near_duplicates
from tesselwork.llm.packing import pack
from tesselwork.llm.quality_rules import quality_rules
from tesselwork.llm.sharding import shuffle_shards

RUNS = {
    "pii": pii.find,
    "redact": pii.redact,
    "sharding": shuffle_shards,
    "packing": lambda d: pack(d, vocabulary()),
    "media": lambda d: media.demux(media.mux(d)),
    "quality_model": quality_model.classify,
    "good_rows": quality_model.good_rows,
    "quality_rules": quality_rules,
    "near_dup": lambda d: near_duplicates(d, width=2),
    "mixing": mix_sources,
    "html": lambda d: html_text.extract(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(odd, name):
    rows = RUNS[name](odd).collect()
    if name == "good_rows":
        assert 0 < len(rows) < len(ODD)
    elif name == "packing":
        assert {r.doc_id for r in rows} == {i for i, *_ in ODD}
    else:
        assert len(rows) == len(ODD)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(empty, name):
    assert RUNS[name](empty).collect() == []


def test_odd_near_dup(odd):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd, width=2).collect()}
    assert {(4, 13, 4, True), (5, 13, 4, False), (1, 0, 1, True), (2, 0, 2, True), (8, 0, 8, True), (3, 1, 3, True), (None, 0, None, False)} <= got


def test_odd_quality_rules(odd):
    got = {r.doc_id: r for r in quality_rules(odd).collect() if r.doc_id}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[7].n_repeat_words == 60_000 and not got[7].kept
    assert got[4].n_words == 14 and got[4].kept


def test_odd_redact(odd):
    got = {r.doc_id: r.text for r in pii.redact(odd).collect() if r.doc_id}
    assert got[1] is None and got[9] == "mail <EMAIL> or <PHONE> from <IP> now"
    assert pii.redact(odd).columns == odd.columns


def test_odd_mix(odd):
    rows = mix_sources(odd).collect()
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert sum(r.target for r in {r.source: r for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 3, "assistant", "x"), (2, 1, "assistant", "a\\b<|end|>\n<|turn|>")]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, seq long")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(chat.log_of_turns(frame))).collect()}
    assert out[1].n_turns == 3 and out[None].loss_chars == 1 and out[2].loss_chars == len("a\\b<|end|>\n<|turn|>")
    assert chat.digests(chat.formatted(chat.log_of_turns(frame.limit(0)))).collect() == []
