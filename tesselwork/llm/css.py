"""Which elements style sheets show: display and visibility by the cascade, as on a screen of 1280 x 720.

Selectors are made of tags, classes, ids and attributes, joined by descendant and child combinators; rules with
others (states, positions, ``:not``, siblings), rules nested in rules and container queries are passed over.
"""

from __future__ import annotations

import re
from functools import lru_cache

_PIECE = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|url\(\s*[^\"'()\s][^()]*\)|\\.|[{};]|[^\"'/\\{};uU]+|.", re.S | re.I)
_IDENT = r"(?:[\w-]|\\[0-9A-Fa-f]{1,6}[ \t\n]?|\\[^\n])+"
_SIMPLE = re.compile(rf"([.#]?)({_IDENT})|(\*)|(:root)\b|\[\s*({_IDENT})\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|({_IDENT}))\s*(i|s)?\s*)?\]", re.I)
_JOIN = re.compile(r"\s*(>)\s*|\s+")
_ESCAPE = re.compile(r"\\(?:([0-9A-Fa-f]{1,6})[ \t\n]?|(.))", re.S)

DISPLAYS = frozenset(
    "none contents block inline inline-block flow flow-root flex inline-flex grid inline-grid table inline-table table-row table-cell table-caption table-column table-column-group table-row-group table-header-group table-footer-group list-item run-in ruby ruby-base ruby-text ruby-base-container ruby-text-container math -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex".split()
)
VISIBILITIES = frozenset("visible hidden collapse".split())
GLOBAL = frozenset("inherit initial unset revert revert-layer".split())

# The screen that a page is laid out for.
NUMBERS = {"width": 1280, "height": 720, "device-width": 1280, "device-height": 720, "aspect-ratio": 1280 / 720, "device-aspect-ratio": 1280 / 720, "resolution": 1, "device-pixel-ratio": 1, "color": 8, "monochrome": 0, "color-index": 0}
WORDS = {
    "orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "forced-colors": "none", "hover": "hover", "any-hover": "hover",
    "pointer": "fine", "any-pointer": "fine", "scripting": "enabled", "display-mode": "browser", "update": "fast", "color-gamut": "srgb", "grid": "0",
}
UNITS = {"": 1, "px": 1, "em": 16, "rem": 16, "pt": 4 / 3, "in": 96, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "dppx": 1, "x": 1, "dpi": 1 / 96, "dpcm": 2.54 / 96}


def _number(text: str) -> float | None:
    m = re.fullmatch(r"([+-]?[\d.]{1,20})([a-z]*)(?:\s*/\s*([\d.]{1,20}))?", text.strip())
    try:
        return float(m[1]) * UNITS[m[2]] / float(m[3] or 1)
    except (TypeError, KeyError, ValueError, ZeroDivisionError):
        return None


def _feature(text: str) -> bool | None:
    """Whether (feature) holds; none if it is unknown."""
    name, colon, value = (p.strip() for p in text.partition(":"))
    name = name.removeprefix("-webkit-")
    if not colon:
        if name in NUMBERS:
            return NUMBERS[name] != 0
        if name in WORDS:
            return WORDS[name] not in ("0", "none", "no-preference")
        parts = [p.strip() for p in re.split(r"(<=|>=|<|>|=)", text)]
        if len(parts) not in (3, 5):
            return None
        sides = [NUMBERS.get(p, _number(p)) for p in parts[::2]]
        if None in sides:
            return None
        at = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "=": lambda a, b: a == b}
        return all(at[op](a, b) for op, a, b in zip(parts[1::2], sides, sides[1:], strict=False))
    if name in WORDS:
        return WORDS[name] == value
    n = _number(value)
    if n is None:
        return None
    if name[:4] in ("min-", "max-") and name[4:] in NUMBERS:
        return NUMBERS[name[4:]] >= n if name[1] == "i" else NUMBERS[name[4:]] <= n
    return NUMBERS[name] == n if name in NUMBERS else None


def _condition(text: str, depth: int = 0) -> bool | None:
    text = text.strip()
    if m := re.match(r"not\b", text):
        v = _condition(text[m.end() :], depth + 1) if depth < 20 else None
        return None if v is None else not v
    units, word, at, level = [], "", 0, 0
    for i, c in enumerate(text):
        if c == "(":
            if not level:
                word, at = word + text[at:i].strip() + " ", i + 1
            level += 1
        elif c == ")":
            level -= 1
            if level < 0:
                return None
            if not level:
                units.append(text[at:i].strip())
                at = i + 1
    joins = set(word.split())
    if not units or level or text[at:].strip() or len(joins) > 1 or not joins <= {"and", "or"}:
        return None
    values = [(_condition(u, depth + 1) if depth < 20 else None) if re.match(r"\(|not\b", u) else _feature(u) for u in units]
    if joins == {"or"}:
        return True if True in values else None if None in values else False
    return False if False in values else None if None in values else True


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds."""
    for one in media.lower().split(","):
        one = one.strip()
        m = re.match(r"(?:(not|only)\s+)?([a-z][\w-]*)(?!\s*\()", one)
        if not m or m[2] in ("not", "only", "and", "or"):
            held = _condition(one) if one else not media.strip()
        else:
            rest = one[m.end() :].strip()
            held = m[2] in ("all", "screen")
            if rest:
                more = _condition(rest[3:]) if rest.startswith("and") else None
                held = False if not held or more is False else more
            if m[1] == "not" and held is not None:
                held = not held
        if held:
            return True
    return False


def declarations(text: str) -> list[tuple[str, str, bool]]:
    """(display or visibility, value, important) of one declaration; what browsers drop is dropped."""
    name, _, value = text.partition(":")
    name = name.strip().lower()
    if name not in ("display", "visibility", "all"):
        return []
    value = " ".join(value.lower().split())
    important = value.endswith("important") and value[:-9].rstrip().endswith("!")
    if important:
        value = value[:-9].rstrip()[:-1].rstrip()
    if name == "all" and value in GLOBAL:
        return [("display", value, important), ("visibility", value, important)]
    if name == "all":
        return []
    if "var(" in value:
        value = "unset"
    words = value.split()
    known = DISPLAYS if name == "display" else VISIBILITIES
    ok = value in GLOBAL or words and all(w in known for w in words) and (len(words) == 1 or name == "display" and "none" not in words)
    return [(name, value, important)] if ok else []


@lru_cache(maxsize=1024)
def read(sheet: str) -> tuple[tuple, ...]:
    """(selectors, property, value, important, layer) of what holds on a screen, in order; (None, layer) where one is named."""
    if not re.search("display|visibility|all", sheet, re.I):
        return ()
    out: list[tuple] = []
    frames: list[tuple] = [(True, None, "")]  # of each open block: whether it holds, its selectors, its layer
    text: list[str] = []

    def ended() -> str:
        whole = "".join(text).strip()
        text.clear()
        holds, selectors, layer = frames[-1]
        if holds and selectors is not None:
            out.extend((selectors, *d, layer) for d in declarations(whole))
        return whole

    for piece in _PIECE.findall(re.sub(r"<!--|-->", " ", sheet)):
        if piece == "{":
            head = "".join(text).strip()
            text.clear()
            holds, selectors, layer = frames[-1]
            if head.startswith("@"):
                m = re.match(r"@([\w-]+)\s*(.*)", head, re.S)
                name, rest = (m[1].lower(), m[2].strip()) if m else ("", "")
                if name == "layer":
                    layer = f"{layer}.{rest or len(out)}"
                    out.append((None, layer))
                holds &= name == "layer" or name == "media" and on_screen(re.sub(r"\s+", " ", rest)) or name == "supports" and not rest.lower().startswith("not")
                frames.append((holds, selectors, layer))
            else:
                frames.append((holds and selectors is None, head, layer))
        elif piece == "}":
            if len(frames) > 1:
                ended()
                frames.pop()
            else:
                text.append(piece)
        elif piece == ";":
            layer = frames[-1][2]
            whole = ended()
            if whole[:6].lower() == "@layer":
                out.extend((None, f"{layer}.{n.strip()}") for n in whole[6:].split(","))
        elif not piece.startswith("/*"):
            text.append(piece)
    ended()
    return tuple(out)


def _plain(ident: str) -> str:
    return _ESCAPE.sub(lambda m: chr(min(int(m[1], 16), 0x10FFFF)) if m[1] else m[2], ident) if "\\" in ident else ident


@lru_cache(maxsize=16_384)
def selector(text: str) -> tuple[tuple[str, tuple], ...] | None:
    """Its compounds, each with the combinator before it; none if it has parts that are not read."""
    out: list[tuple[str, tuple]] = []
    at, join = 0, ""
    text = text.strip()
    while at < len(text):
        parts, first = [], at
        while m := _SIMPLE.match(text, at):
            if m[2] and not m[1] and at != first or m[3] and at != first:
                return None
            if m[2]:
                parts.append((m[1] or "tag", _plain(m[2]) if m[1] else _plain(m[2]).lower()))
            elif m[4]:
                parts.append(("root", ""))
            elif m[5]:
                value = next((v for v in m.group(7, 8, 9) if v is not None), "")
                parts.append(("attr", (m[5].lower(), m[6] or "", value, (m[10] or "").lower() == "i")))
            at = m.end()
        if at == first:
            return None
        out.append((join, tuple(parts)))
        if at < len(text):
            if not (m := _JOIN.match(text, at)):
                return None
            join, at = m[1] or " ", m.end()
            if at == len(text):
                return None
    return tuple(out) or None


def _attribute(attrs: dict, rule: tuple) -> bool:
    name, op, want, loose = rule
    if name not in attrs:
        return False
    have = attrs[name]
    if loose:
        have, want = have.lower(), want.lower()
    if not op:
        return True
    if op == "=":
        return have == want
    if op == "~=":
        return want in have.split()
    if op == "|=":
        return have == want or have.startswith(want + "-")
    return bool(want) and (have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have)


class Styles:
    """The style sheets of a page. What ancestors match is carried down in bits, so each element is looked at once."""

    def __init__(self, sheets: list[str]):
        self.steps: dict[str, list[tuple]] = {}
        ranks: dict[str, int] = {}
        bits, order = 0, 0
        for sheet in sheets:
            for selectors, *rest in read(sheet):
                if selectors is None:
                    ranks.setdefault(rest[0], len(ranks))
                    continue
                name, value, important, layer = rest
                order += 1
                rank = ranks[layer] if layer else 1 << 30
                for one in re.split(r"(?<!\\),", selectors):
                    if not (steps := selector(one)):
                        continue
                    kinds = [k for _, parts in steps for k, _ in parts]
                    weight = (kinds.count("#"), sum(k in (".", "attr", "root") for k in kinds), kinds.count("tag"))
                    before = 0
                    for i, (join, parts) in enumerate(steps):
                        last = i == len(steps) - 1
                        own = 0 if last else 1 << bits
                        bits += not last
                        key = next((k + v for kind in "#." for k, v in parts if k == kind), next((v for k, v in parts if k == "tag"), "*"))
                        found = (name, value, (important, 0, -rank if important else rank, weight, order)) if last else None
                        self.steps.setdefault(key, []).append((parts, join, before, own, found))
                        before = own

    def __call__(self, tag: str, attrs: dict, above: int, parent: int, root: bool = False) -> tuple[dict, int]:
        """The winning values of display and visibility, where any are declared, and the bits of what is matched."""
        best: dict[str, tuple] = {}
        own = 0
        if self.steps:
            classes = attrs.get("class", "").split()
            for key in ("*", tag, *(f".{c}" for c in dict.fromkeys(classes)), f"#{attrs.get('id', '')}"):
                for parts, join, before, bit, found in self.steps.get(key, ()):
                    if before and not before & (parent if join == ">" else above):
                        continue
                    if all(
                        v == tag if k == "tag" else v in classes if k == "." else v == attrs.get("id") if k == "#" else root if k == "root" else _attribute(attrs, v) for k, v in parts
                    ):
                        own |= bit
                        if found and (found[0] not in best or found[2] > best[found[0]][0]):
                            best[found[0]] = (found[2], found[1])
        if "style" in attrs:
            for i, one in enumerate(re.sub(r"/\*.*?(?:\*/|\Z)", "", attrs["style"], flags=re.S).split(";")):
                for name, value, important in declarations(one):
                    rank = (important, 1, 0, (0, 0, 0), i)
                    if name not in best or rank > best[name][0]:
                        best[name] = (rank, value)
        return {name: value for name, (_, value) in best.items()}, own
