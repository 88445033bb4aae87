"""Rules on short printed texts as column expressions: noise, readings one letter apart, printed sizes, lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Upper case, other signs than letters and digits as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " "))


def is_noise(text: Column) -> Column:
    """At most one letter or digit, or one character three times or more and nothing else."""
    core = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    return (F.length(core) <= 1) | F.coalesce(F.regexp_replace(core, F.concat(F.lit("(?i)"), F.substring(core, 1, 1)), F.lit("")) == "", F.lit(False)) & (F.length(core) >= 3)


def one_substitution(a: Column, b: Column) -> Column:
    """Words of three letters or more and of equal length that differ in one."""
    return (F.length(a) == F.length(b)) & (F.length(a) >= 3) & (F.levenshtein(a, b) == 1)


def feet(text: Column) -> Column:
    """12'6" and 12' as feet; null where the text is no such length."""
    f = F.regexp_extract(text, r"^\s*([0-9]+)\s*'", 1)
    i = F.regexp_extract(text, r"'\s*-?\s*([0-9]+)\s*\"", 1)
    return F.when(f != "", f.cast("double") + F.when(i != "", i.cast("double") / 12).otherwise(0.0))


def printed_size(text: Column) -> Column:
    """struct(width, height, unit, area) of a printed size in feet and inches, metres, or centimetres; else null."""
    imperial = r"([0-9]+'\s*-?\s*(?:[0-9]+\")?)\s*[xX×]\s*([0-9]+'\s*-?\s*(?:[0-9]+\")?)"
    metric = r"([0-9]+(?:[.,][0-9]+)?)\s*(m|cm)?\s*[xX×]\s*([0-9]+(?:[.,][0-9]+)?)\s*(m|cm)\b"
    number = lambda k: F.regexp_replace(F.regexp_extract(text, metric, k), ",", ".").try_cast("double")
    scale = F.when(F.regexp_extract(text, metric, 4) == "cm", 0.01).otherwise(1.0)
    w1, h1 = feet(F.regexp_extract(text, imperial, 1)), feet(F.regexp_extract(text, imperial, 2))
    w2, h2 = number(1) * scale, number(3) * scale
    size = lambda w, h, u: F.struct(w.alias("width"), h.alias("height"), F.lit(u).alias("unit"), (w * h).alias("area"))
    return F.when(w1.isNotNull() & h1.isNotNull(), size(w1, h1, "ft")).when(w2.isNotNull() & h2.isNotNull(), size(w2, h2, "m"))


def plausible_size(size: Column) -> Column:
    """No side under 2.5 ft or 0.75 m."""
    return F.least(size["width"], size["height"]) >= F.when(size["unit"] == "ft", 2.5).otherwise(0.75)


def longest_phrase(texts: DataFrame, id_col: str, text_col: str, phrases: list[tuple[str, str]]) -> DataFrame:
    """The longest phrase (then the first by order of letters) that each text holds as whole words, and its name.

    The lexicon is a literal list of the plan, not a table that grows.
    """
    held = F.array(*[F.when(F.contains(F.concat(F.lit(" "), F.col(text_col), F.lit(" ")), F.lit(f" {p} ")), F.struct(F.lit(-len(p)).alias("n"), F.lit(p).alias("phrase"), F.lit(name).alias("name"))) for p, name in phrases])
    best = F.array_min(F.array_compact(held))
    return texts.select(id_col, best["phrase"].alias("phrase"), best["name"].alias("name")).where("phrase IS NOT NULL")


def compact_feet(digits: Column) -> Column:
    """Digits whose foot mark was lost, 108 for 10'8": inches are the last digits that leave 3 to 30 feet and at most 11
    inches, two of them before one; else null."""
    def cut(k: int) -> Column:
        f, i = F.substring(digits, F.lit(1), F.length(digits) - k).try_cast("int"), F.substring(digits, F.length(digits) - k + 1, F.lit(k)).try_cast("int")
        return F.when(f.between(3, 30) & (i <= 11) & (F.length(digits) > k), F.struct(f.alias("feet"), i.alias("inches")))

    return F.coalesce(cut(2), cut(1))
