"""Quality classifier from weak labels: overlapping heuristics vote, EM weighs them, a hashed linear scorer learns.

Each heuristic labeller looks at one property of a text and says poor, fine, or abstains. The counts of vote
patterns (at most 3^8, whatever the input) go to the driver, where EM estimates every labeller's accuracy and the
probability that a text with a given pattern is good. These posteriors label a bounded sample of texts, and a
linear scorer over hashed features is trained on it; the scorer alone decides on every text.

Texts are read once: what a text shows (its votes, the outlines of its words, its measures) is written as a table of
small rows, from which EM, the sample and the scores are taken.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselwork.llm.batches import slices
from tesselwork.sources.scratch import written

_PLAIN = re.compile(r"[(\"'¿¡]?\w[\w'’.-]*+[.,;:?!)\"']?")
LABELLERS = ("symbols", "bars", "shouting", "marks", "repeats", "variety", "plain", "prose")
FAULT_ONLY = 4  # the first labellers, which see faults or nothing
SLOTS = 1 << 14
#: What a text of a few words cannot show reads as in ordinary prose.
TYPICAL = {"repeats": 0.0, "variety": 1.2, "top": 0.05, "sentences": 0.1}
#: Measures that are features, by bins of 0.05.
BINNED = ("symbols", "bars", "marks", "digits", "plain", "shouting", "repeats", "variety", "top", "sentences")
MOST_BIN = 2.0  # measures are binned up to here

_SIGNS, _MARKS = frozenset("#*$%&<>{}\\^~="), frozenset("!?")
#: What one word shows: slot of its outline, signs, bars, marks, digits, whether it shouts, whether it is plain.
_Word = tuple[int, int, int, int, int, bool, bool]
_words: dict[bytes, _Word] = {}
KNOWN_WORDS = 100_000  # words that a Python worker remembers; then it starts anew


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


def _shown(raw: bytes) -> _Word:
    word = raw.decode()
    core = word.strip("#*$%&<>{}|!?.,;:()\"'")
    tail = word[len(core) :] if word.startswith(core) else word.replace(core, "", 1)
    case = "N" if not core else "U" if core.isupper() and len(core) > 1 else "T" if core.istitle() else "l" if core.islower() else "m"
    if len(_words) >= KNOWN_WORDS:
        _words.clear()
    out = _words[raw] = (
        _slot(f"w{case}{min(len(core), 12) // 3}{tail[:3]}"), sum(c in _SIGNS for c in word), word.count("|"), sum(c in _MARKS for c in word), sum(map(str.isdigit, word)),
        word.isupper() and sum(map(str.isalpha, word)) > 1, _PLAIN.fullmatch(word) is not None,
    )
    return out


def shown(text: str) -> tuple[dict[str, float], dict[int, int]]:
    """Properties of a whole text, each a share or a mean, and how often each slot of a word's outline occurs.

    Words are runs other than space and U+0009 to U+000D: what bytes.split makes. Each word is looked at once for
    each time that a worker meets it anew.
    """
    words = text.encode().split()
    n, counted = max(1, len(words)), Counter(words)
    outlines: dict[int, int] = {}
    signs = bars = marks = digits = shouts = plain = 0
    for word, times in counted.items():
        slot, s, b, m, d, shout, is_plain = _words.get(word) or _shown(word)
        outlines[slot] = outlines.get(slot, 0) + times
        signs += s * times
        bars += b * times
        marks += m * times
        digits += d * times
        shouts += shout * times
        plain += is_plain * times
    return {
        "symbols": signs / n,
        "bars": bars / n,
        "shouting": shouts / n,
        "marks": marks / n,
        "repeats": sum(map(eq, words, islice(words, 1, None))) / n,
        "variety": len(counted) / n**0.85,
        "top": max(counted.values()) / n if words else 0.0,
        "sentences": (text.count(". ") + text.count(".\n") + text.endswith(".")) / n,
        "plain": plain / n,
        "digits": digits / max(1, len(text)),
        "words": len(words),
    }, outlines


def measures(text: str) -> dict[str, float]:
    return shown(text)[0]


def vote(m: dict[str, float]) -> str:
    """One of 1 (fine), 0 (poor) and - (abstains) for each labeller, by fixed heuristic cuts.

    The first four see only faults and else abstain; the others also vouch for a text. Every fault is in the view of
    two labellers at least, so that their agreement can be weighed.
    """
    few = m["words"] < 8
    fault = lambda poor: "0" if poor else "-"
    both = lambda poor, fine: "0" if poor else "1" if fine else "-"
    return "".join(
        (
            fault(m["symbols"] > 0.25),
            fault(m["bars"] > 0.15),
            fault(m["shouting"] > 0.4 and m["words"] > 2),
            fault(m["marks"] > 0.3 and m["words"] > 2),
            "-" if few else both(m["repeats"] > 0.3, m["repeats"] < 0.08),
            "-" if few else both(m["variety"] < 0.25 or m["top"] > 0.4, m["variety"] > 0.6),
            both(m["plain"] < 0.7, m["plain"] > 0.93),
            both(m["digits"] > 0.3, 0 < m["sentences"] < 0.4),
        )
    )


_BIN_SLOTS = {name: [_slot(f"m{name}{k}") for k in range(int(20 * MOST_BIN) + 1)] for name in BINNED}


def features(m: dict[str, float], outlines: dict[int, int]) -> dict[int, float]:
    """Hashed features: outlines of words (their case, signs and length, not their letters) and binned measures."""
    total = max(1, m["words"])
    out = {slot: math.sqrt(times / total) for slot, times in outlines.items()}
    if m["words"] < 8:
        m = m | TYPICAL
    for name in BINNED:
        for slot in _BIN_SLOTS[name][: int(20 * min(MOST_BIN, m[name])) + 1]:
            out[slot] = out.get(slot, 0.0) + 0.5
    return out


def estimate(counts: dict[str, int], rounds: int = 60) -> tuple[np.ndarray, dict[str, float]]:
    """EM: P(vote | class) as [labeller][class][vote 0, 1, -], and P(fine | pattern).

    Pseudo-counts in proportion to the rows say that a labeller is more often right than wrong.
    """
    keys = sorted(counts)
    if not keys:
        return np.zeros((len(LABELLERS), 2, 3)), {}
    n = np.array([counts[k] for k in keys], dtype=float)
    seen = np.array([["01-".index(v) for v in k] for k in keys])
    j = np.arange(seen.shape[1])[None, :]
    says = (seen != 2) | (j < FAULT_ONLY)  # seeing no fault says something; having no opinion does not
    prior = np.array([[0.5, 0.3, 0.2], [0.02, 0.78, 0.2]]) * max(4.0, 0.02 * n.sum())
    theta, share = np.repeat((prior / prior.sum(axis=1, keepdims=True))[None], seen.shape[1], axis=0), 0.8
    for _ in range(rounds):
        logs = (np.log(theta)[j, :, seen] * says[:, :, None]).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(logs[:, 1] - logs[:, 0] + math.log(share / (1 - share)), -30, 30)))
        for c, mass in ((0, n * (1 - p)), (1, n * p)):
            for v in range(3):
                theta[:, c, v] = prior[c, v] + ((seen == v) * mass[:, None]).sum(axis=0)
        theta /= theta.sum(axis=2, keepdims=True)
        share = (8 + (n * p).sum()) / (10 + n.sum())
    return theta, dict(zip(keys, p.tolist(), strict=True))


def train(rows: list[tuple[dict[int, float], float]], epochs: int = 120, step: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, both classes weighing the same; the last slot is the bias."""
    weights = np.zeros(SLOTS + 1)
    if not rows:
        weights[SLOTS] = 4.0
        return weights
    aim = np.array([p for _, p in rows])
    mass = np.where(aim >= 0.5, 0.5 / max(1, (aim >= 0.5).sum()), 0.5 / max(1, (aim < 0.5).sum()))
    row = np.repeat(np.arange(len(rows)), [len(f) + 1 for f, _ in rows])
    col = np.concatenate([[*f, SLOTS] for f, _ in rows]).astype(np.int64)
    val = np.concatenate([[*f.values(), 1.0] for f, _ in rows])
    square = np.full(SLOTS + 1, 1e-10)
    for _ in range(epochs):
        score = np.bincount(row, val * weights[col], len(rows))
        off = mass * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - aim)
        grad = np.bincount(col, off[row] * val, SLOTS + 1) + ridge * weights / len(weights)
        square += grad**2
        weights -= step * grad / np.sqrt(square)
    return weights


def score(text: str | None, weights: np.ndarray) -> float:
    """The scorer's probability that the text is good; 0 for a null or empty one."""
    return probability(*shown(text), weights) if text else 0.0


def probability(m: dict[str, float], outlines: dict[int, int], weights: np.ndarray) -> float:
    z = weights[SLOTS] + sum(weights[k] * v for k, v in features(m, outlines).items())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_SHOWN = "h long, votes string, measures array<double>, slots array<short>, times array<int>"
_NAMES = (*BINNED, "words")


def look(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return h (a hash of id and text), votes, measures and outlines of every row, and doc_id; the one reading of the
    texts. A null or empty text has no measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seen = [shown(t or "") for t in b.column(1).to_pylist()]
            empty = [not t for t in b.column(1).to_pylist()]
            cols = [
                pa.array([vote(m) for m, _ in seen], pa.string()),
                pa.array([None if none else [m[k] for k in _NAMES] for (m, _), none in zip(seen, empty, strict=True)], pa.list_(pa.float64())),
                pa.array([list(o) for _, o in seen], pa.list_(pa.int16())),
                pa.array([list(o.values()) for _, o in seen], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, b.column(2)], ["h", "votes", "measures", "slots", "times", "doc_id"])

    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    return written(rows.mapInArrow(run, f"{_SHOWN}, doc_id long"), "quality-shown")


def _of_row(measured: list | None, slots: list, times: list) -> tuple[dict[str, float], dict[int, int]]:
    return dict(zip(_NAMES, measured, strict=True)), dict(zip(slots, times, strict=True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 6_000) -> np.ndarray:
    """Weights of the scorer for these texts."""
    return fit_seen(look(docs, id_col, text_col), most_rows)


def fit_seen(seen: DataFrame, most_rows: int = 6_000) -> np.ndarray:
    """Weights of the scorer from rows of ``look``. Accuracies use all rows; the scorer trains on at most ``most_rows``
    of them: the first by a hash of the text within each half of the posterior."""
    _, p = estimate(dict(seen.groupBy("votes").count().collect()))  # at most 3^8 patterns
    fine = [k for k, v in p.items() if v >= 0.5]
    some = seen.where("measures IS NOT NULL")
    rows = {}
    for good in (True, False):
        half = some.where(F.col("votes").isin(fine) == good)
        picked = half.select("h").distinct().orderBy("h").limit(most_rows // 2)  # of repeated rows one
        rows |= {r.h: r for r in half.join(F.broadcast(picked), "h").dropDuplicates(["h"]).collect()}
    return train([(features(*_of_row(r.measures, r.slots, r.times)), p[r.votes]) for _, r in sorted(rows.items())])


def _scored(seen: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, h, score and votes of the rows of ``look``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            measured, slots, times = (b.column(i).to_pylist() for i in (2, 3, 4))
            scores = [0.0 if m is None else probability(*_of_row(m, s, t), weights) for m, s, t in zip(measured, slots, times, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(5), b.column(0), pa.array(scores, pa.float64()), b.column(1)], ["doc_id", "h", "score", "votes"])

    return seen.mapInArrow(run, "doc_id long, h long, score double, votes string")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Return doc_id, score, votes and kept for every row.

    A null or empty text is rejected with a score of 0. Rows with a null id and repeated rows are kept as rows and
    judged alike. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    seen = look(docs, id_col, text_col)
    out = _scored(seen, fit_seen(seen))
    return out.select("doc_id", "score", "votes", (F.col("score") >= threshold).alias("kept"))


def good_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the scorer takes.

    Null and empty texts go. The texts are read once more here, so that they need no shuffle to meet their scores.
    """
    weights, at = fit(docs, id_col, text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([score(t, weights) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
