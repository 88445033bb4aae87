"""Thresholds of small made tables, and the verdict on a whole table against exact quartiles in plain Python."""

import math
import random
import re
from collections import Counter

import pandas as pd
import pytest

from tesselwork.llm import quality_rules as rules

RNG = random.Random(3)


def prose(n=60):
    return " ".join("".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 8))) for _ in range(n))


def signs(every=2, n=60):
    return " ".join(w + " #"[i % every == 0] for i, w in enumerate(prose(n).split()))


def spaced():
    return " ".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=90))


@pytest.fixture(scope="module")
def judged(spark):
    kinds = {"prose": prose, "spaced": spaced, "signs": signs}
    rows = [(src, lang, kind) for src, lang, kind, n in [
        ("clean", "en", "prose", 300), ("clean", "en", "spaced", 5),
        ("dirty", "en", "prose", 70), ("dirty", "en", "signs", 30),
        ("torn", "en", "prose", 65), ("torn", "en", "spaced", 35),
        ("any", None, "prose", 60), ("any", None, "spaced", 3),
    ] for _ in range(n)]
    frame = spark.createDataFrame([(i, kinds[k](), lang, src) for i, (src, lang, k) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in rules.quality_rules(frame).collect()}
    out = {}
    for i, row in enumerate(rows):
        out.setdefault(row, set()).add(kept[i])
    return out


@pytest.mark.parametrize(("source", "lang", "kind"), [("clean", "en", "spaced"), ("dirty", "en", "signs"), ("torn", "en", "spaced"), ("any", None, "spaced")])
def test_junk_goes_however_common_in_its_source(judged, source, lang, kind):
    assert judged[source, lang, kind] == {False}


def test_prose_stays(judged):
    assert all(kept == {True} for (_, _, kind), kept in judged.items() if kind == "prose")


def test_one_text_passes_in_one_source_and_fails_in_another(spark):
    same = signs(4)
    texts = [("code", signs(3)) for _ in range(120)] + [("books", prose()) for _ in range(80)] + [("code", same), ("books", same)]
    frame = spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.kept, r.failed) for r in rules.quality_rules(frame).collect()}
    assert got[len(texts) - 2] == (True, []) and got[len(texts) - 1] == (False, ["symbols_per_word"])
    assert sum(not kept for kept, _ in got.values()) == 1


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t: str) -> dict:
    w = WORD.findall(t)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in rules.SYMBOLS for c in t), "n_marks": t.count("!"), "n_upper": len(re.findall(r"[A-ZÀ-ÖØ-Þ]", t)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_echoes": sum(a == b for a, b in zip(w, w[1:], strict=False)),
        "n_repeat_words": len({k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}),
    }


def verdicts(raw: pd.DataFrame, least_rows: int = 40, reach: float = 3.0) -> list[bool]:
    """The rule as it is written down, over sorted lists."""
    rows = [counts(t) | {"lang": lang, "source": source} for t, lang, source in zip(raw.text, raw.lang, raw.source, strict=True)]
    for r in rows:
        r["good"] = r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]

    def quartile(group, m, q):
        count, of, _ = rules.MEASURES[m]
        line = sorted(r[count] / max(1, r[of]) for r in group)
        return round(line[max(0, math.ceil(q * len(line)) - 1)], rules.DIGITS)

    out, made = [], {}

    def quartiles(key, group):
        if key not in made:
            made[key] = {m: (quartile(group, m, 0.25), quartile(group, m, 0.75)) for m in rules.MEASURES}
        return made[key]

    good = [r for r in rows if r["good"]]
    by_lang, by_pair = {}, {}
    for r in good:
        by_lang.setdefault(r["lang"], []).append(r)
        by_pair.setdefault((r["lang"], r["source"]), []).append(r)
    for r in rows:
        ok, pair = r["good"], (r["lang"], r["source"])
        if ok:
            wide = quartiles(r["lang"], by_lang[r["lang"]]) if len(by_lang[r["lang"]]) >= least_rows else quartiles(None, good)
            sets = [wide] + ([quartiles(pair, by_pair[pair])] if len(by_pair[pair]) >= least_rows else [])
            for m, (count, of, fills) in rules.MEASURES.items():
                n = max(1, r[of])
                for quart in sets:
                    q1, q3 = quart[m]
                    high = q3 + reach * (q3 - q1 + math.sqrt(q3 * n * fills + fills**2) / n)
                    low = q1 - reach * (q3 - q1 + math.sqrt(q1 * n * fills + fills**2) / n)
                    ok &= r[count] / n <= high and not (m in rules.TWO_SIDED and r[count] / n < low)
        out.append(ok)
    return out


def test_kept_equals_exact_quartiles(spark, folder):
    """With sketches larger than the table, which hold every value."""
    raw = pd.read_parquet(f"{folder}/documents.parquet")
    raw["source"] = raw.source.str.replace(r"\d+", lambda m: str(int(m[0]) % 3), regex=True)  # pairs of 40 rows and less
    assert raw.groupby(["lang", "source"]).size().agg(["min", "max"]).pipe(lambda s: s["min"] < s["max"])
    frame = spark.createDataFrame(raw[["doc_id", "text", "lang", "source"]])
    got = {r.doc_id: r.kept for r in rules.quality_rules(frame, k=4096, least_rows=12).collect()}
    want = verdicts(raw, least_rows=12)
    assert [got[i] for i in raw.doc_id] == want and 0 < sum(want) < len(want)
