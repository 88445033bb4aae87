"""Results against brute force, round trips and held-out labels on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest

from tesselwork.llm import catalog, chat, html_text, media, pii, quality_model
from tesselwork.llm.mixing import awards, targets
from tesselwork.llm.near_dup import minhash, odd_sketch, shingles, sketch_similarity
from tesselwork.llm.packing import first_fit_decreasing
from tesselwork.llm.sharding import communication_matrix, hypergeometric
from tesselwork.llm.tokens import id_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def result(spark, folder):
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = catalog.QUERIES[name](spark, folder).toPandas()
        return kept[name]

    return of


# --- 1


def plain_base(t):
    p = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for i, (k, x) in enumerate(p.items()):
        for m in re.finditer(x, t):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(sum(map(int, str(int(c) * (1 + j % 2)))) for j, c in enumerate(reversed(d)))
            if k == "email" or k == "ip" and all(int(a) <= 255 for a in m[0].split(".")) or k == "card" and 12 <= len(d) <= 19 and total % 10 == 0 or k == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), i, k, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_base_spans_on_random_texts():
    draw = random.Random(3)
    for _ in range(20_000):
        t = "".join(draw.choice("1234567890.+-@ a(%b)") for _ in range(draw.randint(0, 40)))
        good = sorted(pii.base_spans(t)[0], key=lambda c: (c[0], pii.BASE.index(c[2])))
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in good) == plain_base(t), t


def test_pii_query(result, documents):
    got = result("op1_weak_supervision_pii").set_index("doc_id")
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        base = plain_base(t)
        assert got.base_sha256[i] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got.spans[i].split(","))


def test_em_finds_the_bad_labeler():
    draw = np.random.default_rng(5)
    votes = Counter()
    for _ in range(4000):
        truth = draw.random() < 0.5
        right = [0.95, 0.9, 0.9, 0.85, 0.52, 0.9]
        votes["secret", "".join(str(int(truth == (draw.random() < r))) for r in right)] += 1
    theta, _ = pii.estimate(dict(votes))
    hits = [t[1][1] for t in theta]
    assert min(hits[:4]) > 0.8 > 0.65 > hits[4]


# --- 2


def test_matrix_sums_and_law():
    m = np.array(communication_matrix([500, 300, 201], [101, 100, 400, 400], 1))
    assert m.sum(axis=1).tolist() == [500, 300, 201] and m.sum(axis=0).tolist() == [101, 100, 400, 400]
    draw = np.random.default_rng(0)
    big = [hypergeometric(draw, 2 * 10**9, 3 * 10**9, 10_000) for _ in range(2000)]
    assert abs(np.mean(big) - 4000) < 5 and 40 < np.std(big) < 58


def test_sharding_query(result, documents):
    got = result("op2_hypergeometric_shards")
    n = got.groupby("shard").size()
    assert len(got) == len(documents) and n.max() - n.min() <= 1 and len(n) == 40
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    text = dict(zip(documents.doc_id, documents.text, strict=True))
    for r in got.to_dict("records"):
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())


# --- 3


def test_tokens_equal_the_library(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(catalog.vocabulary())
    of = id_bytes(catalog.vocabulary())
    draw = random.Random(6)
    mixed = ["".join(draw.choice(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "ab", "'ll", "1", "é", "日", "."]) for _ in range(draw.randint(0, 12))) for _ in range(500)]
    for x in [*documents.text[:100], *mixed, "", " ", "  a  b ", "a\n b", "don't we'll \t\r\n z", "<|endoftext|> hi", "a <|endoftext|> b", "日本語 12"]:
        assert np.frombuffer(of(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_first_fit_decreasing_equals_the_plain_loop():
    draw = random.Random(1)
    for _ in range(200):
        items = [draw.randint(1, 100) for _ in range(draw.randint(1, 60))]
        bins, want = [], [None] * len(items)
        for i in sorted(range(len(items)), key=lambda i: -items[i]):
            at = next((k for k, used in enumerate(bins) if used + items[i] <= 100), len(bins))
            if at == len(bins):
                bins.append(0)
            want[i] = (at, bins[at])
            bins[at] += items[i]
        assert first_fit_decreasing(items, 100) == want


def test_packing_query(result, documents):
    got = result("op3_first_fit_packing")
    of = id_bytes(catalog.vocabulary())
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        ids = of(t) + bytes(4)
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) // 4 == own.doc_tokens.iloc[0]
        for r in own.to_dict("records"):
            assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 1024 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.98


def test_repeated_rows_are_dealt_to_many_groups(spark):
    from tesselwork.llm.packing import pack

    rows = [(1, "the same row again and again")] * 900 + [(i, f"row {i}") for i in range(2, 100)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), catalog.vocabulary(), docs_per_group=50).toPandas()
    groups = got[got.doc_id == 1].sequence_id.floordiv(1 << 32).value_counts()
    assert len(got) == len(rows) and len(groups) == 20 and groups.max() < 90
    assert got.groupby("sequence_id").length.sum().max() <= 1024


# --- 4

PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>end", "* x\n* y\n  * z\n\nend"),
    ("<ol start=3><li>x<li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"),
    ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
    ("<table><tr><td rowspan=2>aa<td>b<tr><td>dd<tr><td colspan=2>wide cell<td>e</table>", "aa  b\n    dd\nwide cell  e"),
    ("x<script>var a='</p>'</script>y<!-- z --><style>.h{display:none}</style><i class='q h'>no</i> w", "xy w"),
    ("<div hidden>a</div><span style='display: none'>b</span>c&amp;d &lt;e&gt;", "c&d <e>"),
    ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<dl><dt>T<dd>D<dd>E</dl>", "T\n    D\n    E"),
    ("<select><option>o<option>p</select>", "o\np"),
    ("1 < 2 <b title='a>b'>x</b>", "1 < 2 x"),
    ("<div>" * 5000 + "deep", "deep"),
    ("", ""),
]


@pytest.mark.parametrize(("html", "text"), PAGES, ids=range(len(PAGES)))
def test_html(html, text):
    assert html_text.text_of(html) == text


class Plain(HTMLParser):
    """The visible words of a page in order, a star for each item of a list, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden, self.glued = [], [], False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "head", "template", "noscript"):
            self.hidden.append(tag)
        if tag == "li":
            self.words.append("*")
        self.glued &= tag in ("a", "b", "i", "em", "strong", "span")

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        self.glued &= tag in ("a", "b", "i", "em", "strong", "span")

    def handle_data(self, data):
        if self.hidden:
            return
        parts = data.split()
        if parts and self.glued and not data[0].isspace():
            self.words[-1] += parts.pop(0)
        self.words += parts
        if data:
            self.glued = bool(self.words) and not data[-1].isspace()


def test_html_query_keeps_every_visible_word(result, folder):
    """Every page of the table, word by word and in order, against another parser."""
    pages = pd.read_parquet(f"{folder}/pages.parquet")
    got = result("op4_layout_text").set_index("page_id").text
    checked = 0
    for i, h in zip(pages.page_id, pages.html, strict=True):
        plain = Plain()
        plain.feed(h)
        plain.close()
        assert got[i].split() == plain.words, i
        checked += len(plain.words) > 5
    assert checked == len(pages) >= 50


def test_tables_of_any_width_are_aligned():
    """Every cell's first line begins in its column's place, whatever the other cells hold, and no text is lost."""
    draw = random.Random(21)
    for _ in range(300):
        columns, rows, n = draw.randint(1, 6), draw.randint(1, 6), 0
        cells = []
        for r in range(rows):
            cells.append([])
            for c in range(columns):
                lines = []
                for _ in range(draw.randint(1, 3)):
                    n += 1
                    lines.append(f"[{n}]" + draw.choice(["", "x" * draw.randint(1, 30), "wide " * draw.randint(12, 40) + "end", "y" * draw.randint(61, 150)]))
                cells[r].append(lines)
        html = "<table>" + "".join("<tr>" + "".join("<td>" + "<br>".join(x) + "</td>" for x in row) + "</tr>" for row in cells) + "</table>"
        text = html_text.text_of(html)
        at = {}
        for line in text.split("\n"):
            for m in re.finditer(r"\[([0-9]+)\]", line):
                at[int(m[1])] = (m.start(), line[m.start() :])
        k = 0
        places: dict[int, set] = {}
        for row in cells:
            for c, lines in enumerate(row):
                for x in lines:
                    k += 1
                    places.setdefault(c, set()).add(at[k][0])
                    assert at[k][1].startswith(x) and at[k][1][len(x) : len(x) + 2] in ("", "  "), text
        assert all(len(p) == 1 for p in places.values()) and sorted(min(p) for p in places.values()) == [min(places[c]) for c in range(columns)], text
        assert len(text) < 70 * columns * len(at) + sum(len(x) for row in cells for lines in row for x in lines)


# --- 5


@pytest.mark.parametrize("n", [0, 1, 169, 170, 171, 191, 192, 193, 12_288, 12_289, 40_000, 120_001])
def test_transport_stream_round_trip(n):
    data = media.padded("x" * n)
    stream = media.mux_bytes(data)
    got = media.demux_bytes(stream)
    assert len(stream) % 188 == 0 and b"".join(p for p, _, _ in got["pes"]) == data and got["faults"] == 0
    assert [t for _, t, _ in got["pes"]] == [3600 * k for k in range(len(got["pes"]))] and got["pes"][0][2]


def test_transport_stream_faults():
    stream = media.mux_bytes(media.padded("y" * 30_000))
    assert media.demux_bytes(stream[: 188 * 10] + stream[188 * 11 :])["faults"] == 1
    assert media.demux_bytes(stream[: 188 * 11] + stream[188 * 10 :])["faults"] == 0  # a packet sent twice
    assert media.demux_bytes(b"\x00" + stream[1:])["bad_sync"] == 1
    assert media.demux_bytes(b"")["pes"] == [] and media.demux_bytes(b"junk" * 100)["program"] is None


def stream_of(programs: dict, split: int) -> bytes:
    """A stream of several programs: {program: (map PID, [(type, PID, payload)])}; tables in pieces of ``split`` bytes."""
    counters: Counter = Counter()

    def packets(pid, data):
        out, first = b"", True
        while data or first:
            head = b"\x00" if first else b""
            piece, data = data[: split - len(head)], data[split - len(head) :]
            body = head + piece
            room = 184 - len(body)
            field = b"" if not room else bytes([room - 1]) + (b"\x00" + b"\xff" * (room - 2) if room > 1 else b"")
            out += bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 0xFF, (0x30 if field else 0x10) | counters[pid] & 15]) + field + body
            counters[pid] += 1
            first = False
        return out

    pat = media._section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, (pid, _) in programs.items()))
    out = packets(0, pat)
    for n, (pid, streams) in programs.items():
        es = b"".join(bytes([kind]) + (0xE000 | own).to_bytes(2, "big") + b"\xf0\x03\x52\x01\x07" for kind, own, _ in streams)
        out += packets(pid, media._section(2, n, (0xE000 | streams[0][1]).to_bytes(2, "big") + b"\xf0\x00" + es))
    for _, streams in programs.values():
        for _, own, payload in streams:
            block, _ = media._packets(media._pes(payload, 90_000 * own), 0, True)
            block[:, 1] = block[:, 1] & 0xE0 | own >> 8
            block[:, 2] = own & 0xFF
            out += block.tobytes()
    return out


@pytest.mark.parametrize("split", [184, 40, 11])
def test_programs_and_tables_over_several_packets(split):
    programs = {7: (0x30, [(27, 0x31, b"video" * 900), (15, 0x32, b"sound" * 50)]), 9: (0x40, [(6, 0x41, b"more")])}
    got = media.demux_bytes(stream_of(programs, split))
    assert got["streams"] == [(7, 27, 0x31), (7, 15, 0x32), (9, 6, 0x41)] and (got["program"], got["pid"], got["stream_type"]) == (7, 0x31, 27)
    assert [x for x, _, _ in got["pes"]] == [b"video" * 900, b"sound" * 50, b"more"] and [t for _, t, _ in got["pes"]] == [90_000 * x for x in (0x31, 0x32, 0x41)]
    assert got["faults"] == got["bad_sync"] == got["damaged"] == 0


def test_damaged_streams_do_not_fail():
    draw = random.Random(8)
    whole = [media.mux_bytes(media.padded("z" * 9_000)), stream_of({1: (0x30, [(27, 0x31, b"v" * 700)])}, 30)]
    for k in range(6000):
        data = bytearray(whole[k % 2][: 188 * draw.randint(1, 12)])
        for _ in range(draw.randint(1, 8)):
            at = draw.randrange(len(data))
            data[at - at % 188 + draw.randrange(14) if draw.random() < 0.7 and at - at % 188 + 14 < len(data) else at] = draw.randrange(256)
        got = media.demux_bytes(bytes(data))
        assert media.feature(got)


def test_media_query_stores_times_and_access_points(result, documents):
    got = result("op5_transport_streams").set_index("doc_id")
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        n = max(1, -(-len(t.encode()) // (192 * 64)))
        assert list(got.pts[i]) == [3600 * k for k in range(n)] and list(got.access[i]) == [k % 4 == 0 for k in range(n)]


def test_media_query(result, documents):
    got = result("op5_transport_streams").set_index("doc_id")
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        raw = t.encode()
        data = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (got.n_bytes[i], got.payload_bytes[i], got.payload_sha256[i], got.tail_crc32[i]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))


# --- 6


def test_quality_model_on_labels(result, folder):
    labels = pd.read_parquet(f"{folder}/labels.parquet").merge(result("op6_weak_label_quality"), on="doc_id")
    assert (labels.kept == (labels.quality == 1)).mean() > 0.97


def test_quality_em_weighs_labellers():
    _, p = quality_model.estimate({"----1111": 900, "0---1101": 40, "-0--1001": 30, "--001-0-": 20, "------1-": 5})
    assert p["----1111"] > 0.9 and p["------1-"] > 0.5 and max(p["0---1101"], p["-0--1001"], p["--001-0-"]) < 0.1


def test_quality_model_equals_its_plain_version(result, documents):
    """What is kept of the written rows is what the whole text says, word by word and without any memory of words."""
    import math

    def plain(t):
        w = WORD.findall(t)
        n, c = max(1, len(w)), Counter(w)
        good = re.compile(r"[(\"'¿¡]?\w[\w'’.-]*+[.,;:?!)\"']?")
        return {
            "symbols": sum(t.count(x) for x in "#*$%&<>{}\\^~=") / n, "bars": t.count("|") / n, "marks": (t.count("!") + t.count("?")) / n, "repeats": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
            "shouting": sum(k for x, k in c.items() if x.isupper() and sum(map(str.isalpha, x)) > 1) / n, "variety": len(c) / n**0.85, "top": max(c.values(), default=0) / n,
            "sentences": (t.count(". ") + t.count(".\n") + t.endswith(".")) / n, "plain": sum(k for x, k in c.items() if good.fullmatch(x)) / n, "digits": sum(map(str.isdigit, t)) / max(1, len(t)), "words": len(w),
        }

    got = result("op6_weak_label_quality").set_index("doc_id")
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        want, have = plain(t), quality_model.measures(t)
        assert set(want) == set(have) and all(math.isclose(want[k], have[k]) for k in want)
        assert got.votes[i] == quality_model.vote(want)


# --- 7


def test_chat_query(result, folder):
    turns = pd.concat([pd.read_parquet(f"{folder}/conversations.parquet"), pd.DataFrame(catalog.INJECTED, columns=["conv_id", "turn", "role", "text"])])
    got = result("op7_event_sourced_chat").set_index("conv_id")
    for conv, g in turns.groupby("conv_id"):
        g = g.sort_values(["turn", "role", "text"])
        whole = "".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text, strict=True))
        loss = "".join(g.text[g.role == "assistant"])
        row = got.loc[conv]
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (len(g), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_fold():
    events = [("open", 1, "user", "a"), ("open", 2, "assistant", "dr"), ("delta", 2, "", "aft"), ("regenerate", 2, "", ""), ("delta", 2, "", "new"), ("open", 3, "user", "c"), ("edit", 1, "", "A"), ("delta", 9, "", "lost")]
    assert chat.fold(events) == [(1, "user", "A"), (2, "assistant", "new"), (3, "user", "c")]
    assert chat.fold([*events, ("regenerate", 2, "", "z")]) == [(1, "user", "A"), (2, "assistant", "z")]
    assert chat.fold([*events, ("delete", 3, "", "")])[-1][0] == 2


def test_escapes_are_reversible():
    draw = random.Random(2)
    for _ in range(3000):
        t = "".join(draw.choice(["<|turn|>", "<|text|>", "<|end|>\n", "</s>", "[INST]", "[/INST]", "\\", "l", "b", "<", "[", "|>", "<<SYS>>", "x\n"]) for _ in range(draw.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and not re.search(r"<\|[a-z_]+\|>|</?s>|\[/?INST\]", chat.escape(t))
        assert chat.read_back(chat.render([(t, t), ("assistant", t)])[0]) == [(t, t), ("assistant", t)]


# --- 8


def test_quality_rules_query(result, documents, folder):
    got = result("op8_adaptive_quality").set_index("doc_id")
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert got.base_failed[i] == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and not (got.kept[i] and got.base_failed[i])
    labels = pd.read_parquet(f"{folder}/labels.parquet").join(got, on="doc_id")
    assert not labels[labels.quality == 0].kept.any() and labels[(labels.quality == 1) & ~labels.base_failed].kept.mean() > 0.97


# --- 9


def components_of(texts: dict, width: int) -> dict:
    """Brute force over all pairs."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(low))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_near_dup_query(result, documents):
    got = result("op9_odd_sketch_near_dup").set_index("doc_id")
    want = components_of(dict(zip(documents.doc_id, documents.text, strict=True)), 2)
    assert got.component_id.to_dict() == want and (got.kept == (got.index == got.component_id)).all()


def test_near_dup_chains_and_mixed_buckets(spark):
    """A chain whose ends are far apart, a group without a centre, and a large bucket dealt into blocks."""
    from tesselwork.llm import near_dup

    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = {k: " ".join([*(word() for _ in range(0)), *base[3 * k : 3 * k + 60]]) for k in range(12)}
    other = [word() for _ in range(80)]
    for k in range(60):
        mine = other[:]
        for _ in range(4):
            mine[draw.randrange(80)] = word()
        texts[100 + k] = " ".join(mine)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = components_of(texts, 2)
    kept = near_dup.BLOCK
    for block in (kept, 7):
        near_dup.BLOCK = block
        try:
            got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame, width=2).collect()}
        finally:
            near_dup.BLOCK = kept
        assert got == want


def test_odd_sketch_estimates_high_similarity():
    draw = np.random.default_rng(4)
    off = []
    for _ in range(40):
        whole = draw.integers(0, 2**63, 2000, dtype=np.uint64)
        a, b = np.unique(whole[:1800]), np.unique(whole[200:])
        ones = np.bitwise_count(odd_sketch(minhash(a)).view(np.uint64) ^ odd_sketch(minhash(b)).view(np.uint64)).sum()
        off.append(sketch_similarity(ones) - 0.8)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_shingles_of_short_texts():
    assert len(shingles("one")) == 1 and len(shingles("")) == 0 and len(shingles(" \n")) == 0 and len(shingles(None)) == 0
    assert shingles("A b").tolist() == shingles("a\tB").tolist() != shingles("b a").tolist()


# --- 10


def test_targets_reshare_the_excess():
    assert targets([100, 10, 10], [5, 2, 1], 3) == [75.0, 30.0, 15.0]
    assert targets([10, 1000], [5, 2], 3) == [30.0, 980.0]
    assert targets([0, 5], [5, 2], 3) == [0.0, 5.0] and targets([], [], 3) == []


def test_sainte_lague_known_result():
    order = awards([53, 24, 23], [99] * 3, 7)
    assert Counter(order) == {0: 3, 1: 2, 2: 2}
    assert Counter(awards([53, 24, 23], [1, 99, 99], 7)) == {0: 1, 1: 3, 2: 3}


def test_mix_query(result, documents):
    got = result("op10_sainte_lague_mix").merge(documents[["doc_id", "source", "text"]], on="doc_id")
    assert (got["size"] == got.text.map(lambda t: len(WORD.findall(t)))).all() and (got.taken <= 3 * got["size"]).all()
    sizes = got.groupby("source")["size"].sum().sort_index()
    want = targets(sizes.tolist(), [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first")).sort_index()
    assert np.allclose(by.target, want) and (abs(by.taken - by.target) <= 0.01 * by.target + 2).all()
