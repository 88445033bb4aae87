"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

One scan of the texts finds the base spans (fixed patterns and checks, always kept) and further candidates
(credentials, account and identity numbers, names of persons, postal addresses, and base-like matches that failed
their check). Six labelers vote on
each candidate: two by pattern, two by gazetteer, one by the words before it, one by shape; each says private, not
private, or abstains. Only the table of vote patterns, at most 3^6 for each kind, reaches the driver, where EM
estimates each labeler's reliability and the probability of every pattern. Those probabilities label a bounded
sample of candidates on which a logistic span classifier is trained; it decides on every candidate.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselwork.llm.batches import slices
from tesselwork.sources.scratch import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "secret", "name", "address")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{12,}+")
_DIGIT = re.compile(r"[0-9]")
_CAPITALS = re.compile(r"(?<![\w.@-])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++(?:[ -][A-ZÀ-ÖØ-Þ](?:\.|[a-zß-öø-ÿ'’]++)){1,3}(?![\w@])")
_ADDRESS = re.compile(
    r"(?<![\w.])(?:[0-9]{1,5}[A-Za-z]?,? (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)\b"
    r"|[A-ZÄÖÜ][a-zäöüß]+(?:stra(?:ß|ss)e|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?\b"
    r"|[0-9]{1,4},? (?:bis |ter )?(?:rue|avenue|boulevard|place|chemin|impasse) (?:de |du |des |la |le |l['’])*[A-ZÀ-Þ][\w'’-]+"
    r"|(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo) (?:de |del |la |las |los )*[A-ZÁ-Ú]\w+,? (?:n\.?º? ?)?[0-9]{1,4}\b)"
)

# Gazetteers.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "SG.")
CARD_PREFIXES = ("34", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
IBAN_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR UA".split())
LOCAL_NETS = ("0.", "10.", "127.", "169.254.", "192.168.", "224.", "255.")
PRIVATE_WORDS = frozenset(
    (
        "account address api apikey auth bank bearer call card cell contact credential credentials credit email fax host iban key live lives login mail mastercard mobile name passcode passwd password phone pin pwd secret signed social ssn tel telephone token visa "
        "adresse anschrift handy heißt karte kennwort konto passwort rufnummer telefon unterzeichnet wohnhaft wohnt "
        "appelle carte compte courriel demeurant habite nom passe portable signé téléphone "
        "clave contraseña correo cuenta dirección domicilio firmado llama móvil nombre tarjeta teléfono vive"
    ).split()
)
TITLES = frozenset("mr mrs ms miss dr prof sir herr herrn frau monsieur madame mme mlle señor señora sr sra don doña".split())
GIVEN_NAMES = frozenset(
    (
        "Alice Andrew Anna Anne Barbara Benjamin Charles Christopher Daniel David Elizabeth Emily Emma George Grace Henry Jack Jacob James Jane Jennifer Jessica John Joseph Joshua Karen Kevin Laura Linda Lisa Margaret Mark Mary Matthew Michael Nancy Oliver Olivia Patricia Paul Peter Rachel Rebecca Richard Robert Ruth Samuel Sarah Simon Sophia Steven Susan Thomas William "
        "Andreas Anja Bernd Birgit Claudia Dieter Elke Franz Fritz Greta Günter Hans Heike Heinrich Helga Ingrid Jürgen Karl Katharina Klaus Lukas Manfred Monika Petra Sabine Stefan Uwe Ursula Werner Wolfgang "
        "Amélie Antoine Brigitte Camille Céline Chloé Claire Étienne François Françoise Guillaume Hélène Isabelle Jacques Jean Julien Louis Lucie Marc Marie Mathieu Michel Monique Nathalie Nicolas Philippe Pierre Sébastien Sylvie Thierry "
        "Alejandro Ana Antonio Carlos Carmen Diego Elena Fernando Francisco Isabel Javier Jorge José Juan Lucía Luis Manuel María Marta Miguel Pablo Pedro Pilar Rafael Rosa Sofía Teresa"
    ).split()
)
NOT_NAMES = frozenset("Avenue Boulevard Chapter Church City College Company Court Day Drive Hall Hospital House Island Lane License Park Place Prize River Road Saint School Square Street University Way".split())
PLAIN_WORDS = frozenset("chapter checksum commit doi figure isbn issn item line page part release revision section sha sku table ticket v ver version vol volume".split())


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: a local part is the whole run before its @, so only @ signs need a look."""
    done = 0
    while (at := text.find("@", done)) >= 0:
        start = at
        while start > done and _LOCAL_CHARS.get(text[start - 1], False):
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1


_LOCAL_CHARS = dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-", True)


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, kind) of base spans, and of matches that failed their check."""
    good, bad = [(a, b, "email") for a, b in _emails(text)], []

    def put(ok: bool, m: re.Match, kind: str) -> None:
        (good if ok else bad).append((m.start(), m.end(), kind))

    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            put(all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")), m, "ip")
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if len(digits) >= 12:
                    put(len(digits) <= 19 and luhn(digits), m, "card")
        if "+" in text:
            for m in _PHONE.finditer(text):
                put(9 <= sum(c.isdigit() for c in m[0]) <= 15, m, "phone")
    return good, bad


def _mod97(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _names(text: str) -> list[tuple[int, int, str]]:
    """Runs of capitalised words that begin with a known given name, or that a title stands before."""
    out = []
    for m in _CAPITALS.finditer(text):
        first = re.split("[ -]", m[0], maxsplit=1)[0]
        if first in GIVEN_NAMES:
            out.append((m.start(), m.end(), "name"))
        elif first.lower() in TITLES and " " in m[0]:
            out.append((m.start() + len(first) + 1, m.end(), "name"))
        else:
            before = text[max(0, m.start() - 12) : m.start()].rstrip(" .").rpartition(" ")[2].lower()
            if before in TITLES:
                out.append((m.start(), m.end(), "name"))
    return out


def _further(text: str) -> list[tuple[int, int, str]]:
    out = _names(text)
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), m.end(), "address") for m in _ADDRESS.finditer(text)]
    out += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text)]
    out += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text)]
    for m in _TOKEN.finditer(text):
        value = m[0].strip("=/+-")
        low = m.start() + m[0].index(value) if value else m.start()
        if "=" in value:  # name=value: the value is the candidate
            cut = value.rindex("=") + 1
            low, value = low + cut, value[cut:]
        if len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            out.append((low, low + len(value), "secret"))
    return out


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def votes(text: str, start: int, end: int, kind: str, checked: bool) -> str:
    """Six characters of 1 (private), 0 (not) and - (abstains). checked: the span passed its base check."""
    value, before = text[start:end], text[max(0, start - 32) : start]
    words = re.findall(r"[^\W\d_]+", before.lower())[-3:]
    digits = sum(c.isdigit() for c in value)
    strict = {
        "email": value.rpartition(".")[2].isalpha(),
        "ip": checked,
        "card": len(re.sub(r"[^0-9]", "", value)) in (14, 15, 16) and not re.search(r"[ -][0-9]{1,2}(?=[ -])", value),
        "phone": 10 <= digits <= 13,
        "ssn": value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[-4:] != "0000",
        "iban": 15 <= len(value.replace(" ", "")) <= 34,
        "secret": bool(re.fullmatch(r"(?:[0-9a-f]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|[A-Za-z0-9_+/-]{32,})", value)),
        "name": len(value.split()) >= 2 and all(len(w) > 2 or w.endswith(".") for w in value.split()),
        "address": True,
    }[kind]
    one = "1" if strict else ("-" if kind == "secret" else "0")
    check = _mod97(value.replace(" ", "")) if kind == "iban" else checked if kind in BASE else None
    two = "-" if check is None else "01"[check]
    known = {
        "card": value.startswith(CARD_PREFIXES), "iban": value[:2] in IBAN_COUNTRIES, "secret": value.startswith(KEY_PREFIXES),
        "name": re.split("[ -]", value, maxsplit=1)[0] in GIVEN_NAMES,
    }.get(kind, False)
    sample = (kind == "ip" and value.startswith(LOCAL_NETS)) or len(set(re.sub(r"\W", "", value))) <= 2
    three = "1" if known else "-"
    parts = re.split(r"[-_/+]", value)
    slug = kind == "secret" and len(parts) > 2 and all(x.isalpha() or x.isdigit() or not x for x in parts)  # words joined by signs
    place = kind == "name" and any(w in NOT_NAMES for w in value.split())
    four = "0" if sample or slug or place or any(w in PLAIN_WORDS for w in words) or before.endswith(("/", "#", "v")) else "-"
    five = "1" if any(w in PRIVATE_WORDS or (kind == "name" and w in TITLES) for w in words) else "-"
    six = "-"
    if kind == "address":  # a number of five digits and a single word is as often a count
        six = "1" if sum(w[:1].isupper() for w in value.split()) >= 2 or value[0].isalpha() else "-"
    if kind == "secret":
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False))
        six = "1" if _entropy(value) >= 3 and digits >= 3 and turns >= 4 else "0"
    return one + two + three + four + five + six


SLOTS = 1 << 12


def _slots(text: str, start: int, end: int, kind: str, pattern: str) -> list[int]:
    """Hashed features of a candidate: its kind, votes, outline, length, and the word before."""
    value = text[start:end][:64]
    outline = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", value))))[:12]
    word = re.findall(r"\w+", text[max(0, start - 32) : start].lower())[-1:]
    names = [f"k{kind}", f"o{kind}{outline}", f"l{kind}{(end - start).bit_length()}", f"w{''.join(word)}"]
    names += [f"v{i}{v}" for i, v in enumerate(pattern)] + [f"p{kind}{pattern}"]
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


def candidates(text: str) -> list[dict]:
    """Base spans and further candidates of a whole text, with votes and features, in order."""
    good, bad = base_spans(text)
    out = []
    starts = sorted(x for x, _, _ in good)
    reach = list(accumulate((y for _, y, _ in sorted(good)), max))
    inside = lambda a, b: (i := bisect_right(starts, a)) > 0 and reach[i - 1] >= b
    more = [c for c in _further(text) if not inside(c[0], c[1])]
    for spans, base, checked in ((good, True, True), (bad, False, False), (more, False, False)):
        for a, b, kind in spans:
            pattern = votes(text, a, b, kind, checked)
            out.append({"kind": kind, "start": a, "end": b, "base": base, "votes": pattern, "slots": _slots(text, a, b, kind, pattern)})
    return sorted(out, key=lambda c: (c["start"], KINDS.index(c["kind"]), c["end"]))


@dataclass
class Model:
    """What was learnt: reliabilities by labeler, class and vote; weights of the span classifier."""

    reliability: list[list[list[float]]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS))
    bias: float = 0.0

    def probability(self, slots: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(self.weights[slots].sum())))))


_VOTE = {"0": 0, "1": 1, "-": 2}


def estimate(patterns: dict[tuple[str, str], int], rounds: int = 50) -> tuple[list, dict[tuple[str, str], float]]:
    """EM over counts of (kind, votes): reliabilities [labeler][class][vote], and P(private) of every pattern.

    Priors of a few counts say that a labeler is more often right than wrong; they also name the classes.
    """
    keys = sorted(patterns)
    if not keys:
        return [], {}
    count = np.array([patterns[k] for k in keys], dtype=float)
    seen = np.array([[_VOTE[v] for v in p] for _, p in keys])
    kind = np.array([KINDS.index(k) for k, _ in keys])
    prior = np.array([[8.0, 2.0, 4.0], [2.0, 8.0, 4.0]])  # [class][vote 0, 1, abstain]
    labelers = seen.shape[1]
    theta = np.repeat((prior / prior.sum(axis=1, keepdims=True))[None], labelers, axis=0)
    share = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        logs = np.log(theta)[np.arange(labelers)[None, :], :, seen].sum(axis=1)
        odds = logs[:, 1] - logs[:, 0] + np.log(share[kind]) - np.log1p(-share[kind])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for j in range(labelers):
            for v in range(3):
                hit = seen[:, j] == v
                theta[j, 1, v] = prior[1, v] + (count * p)[hit].sum()
                theta[j, 0, v] = prior[0, v] + (count * (1 - p))[hit].sum()
        theta /= theta.sum(axis=2, keepdims=True)
        for k in range(len(KINDS)):
            own = kind == k
            share[k] = (5 + (count * p)[own].sum()) / (10 + count[own].sum())
    return theta.tolist(), dict(zip(keys, p.tolist(), strict=True))


def train(rows: list[tuple[list[int], float, float]], epochs: int = 300, step: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on (slots, probability, count) by full gradient steps with per-slot scaling."""
    weights, bias = np.zeros(SLOTS), 0.0
    if not rows:
        return weights, bias
    slots = np.array([r[0] for r in rows])
    aim, count = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    count /= count.sum()
    square, square_b = np.full(SLOTS, 1e-8), 1e-8
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(bias + weights[slots].sum(axis=1), -30, 30)))
        off = count * (p - aim)
        grad = np.bincount(slots.ravel(), np.repeat(off, slots.shape[1]), SLOTS) + ridge * count.mean() * weights
        square += grad**2
        square_b += off.sum() ** 2
        weights -= step * grad / np.sqrt(square)
        bias -= step * off.sum() / math.sqrt(square_b)
    return weights, bias


_FOUND = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("slots", pa.list_(pa.int32()))])
)
_FOUND_SQL = "array<struct<kind: string, start: long, end: long, base: boolean, votes: string, slots: array<int>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id and the array of candidates of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([candidates(t.as_py() or "") for t in b.column(1)], _FOUND)], ["doc_id", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, found {_FOUND_SQL}")


def fit(scanned: DataFrame, most_rows: int = 20_000) -> Model:
    """Learn from scanned rows. Reliabilities use every candidate; the classifier at most ``most_rows`` distinct ones,
    the first by hash of their features."""
    every = scanned.select(F.explode("found").alias("c")).select("c.*")
    counted = every.groupBy("kind", "votes").count().collect()  # at most 3^6 patterns for each kind
    reliability, p = estimate({(r.kind, r.votes): r["count"] for r in counted})
    shapes = every.groupBy("kind", "votes", "slots").count()
    rows = shapes.orderBy(F.xxhash64("slots", "kind"), "kind", "votes", "slots").limit(most_rows).collect()
    weights, bias = train([(r.slots, p[r.kind, r.votes], r["count"]) for r in rows])
    return Model(reliability, weights, bias)


def decided(found: list[dict], model: Model, threshold: float) -> list[dict]:
    """Base spans, and further ones that the classifier takes. Of further spans that are equal or lie within one taken
    before, the first stays; those that overlap in part all stay."""
    out, done = [], -1
    for c in found:
        if c["base"]:
            out.append(c)
        elif c["kind"] not in BASE and c["end"] > done and model.probability(c["slots"]) >= threshold:
            out.append(c)
            done = c["end"]
    return out


def spell(spans: list[dict]) -> str:
    return ",".join(f"{c['kind']}:{c['start']}:{c['end']}" for c in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Return doc_id, n_ of each base kind, base_sha256, spans and n_added for every row.

    Null and empty texts have no spans. Rows with a null id and repeated rows are kept and judged alike. An empty
    table gives no rows. Other columns of ``docs`` are not read.
    """
    scanned = written(scan(docs, id_col, text_col), "pii-candidates")
    model = fit(scanned)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def one(doc, found) -> tuple:
        base = [c for c in found if c["base"]]
        kinds, spans = Counter(c["kind"] for c in base), decided(found, model, threshold)
        return (doc, *(kinds[k] for k in BASE), hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans), len(spans) - len(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [one(d, f) for d, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return scanned.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[dict]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for c in spans:
        if c["start"] >= at:
            out += [text[at : c["start"]], f"<{c['kind'].upper()}>"]
        at = max(at, c["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Return ``docs`` with personal data in the text column masked. Null texts stay null, other columns as they are."""
    model = fit(written(scan(docs, id_col, text_col), "pii-candidates"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t if t is None else masked(t, decided(candidates(t), model, threshold)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
