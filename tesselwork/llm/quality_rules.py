"""Quality rules whose thresholds adapt to each language and source, from mergeable quantile sketches.

Every measure of a text is a count over its opportunities (symbols over words, capitals over letters), made by column
expressions. Per language and source one KLL sketch of each rate is built by partial aggregation (a sketch has a
bounded size and sketches of parts merge, so a hot source is never gathered in one task). Its quartiles say what is
usual there: a text fails where its rate lies beyond them by ``reach`` times their distance and ``reach`` times the
noise that counting in a text of its length has. There are no fixed cutoffs: the same text may pass in one source and
fail in another. Pairs with few rows take the quartiles of their language, or of all rows, from the merged sketches.
No pair excuses more than its language does, so that a source in which poor texts are common does not excuse them. The
quartiles are joined back to filter the rows. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselwork.llm.columns import text_or_empty, words
from tesselwork.sources.scratch import written

SYMBOLS = "#*$%&|<>"
#: measure -> (count, opportunities, opportunities that one event fills): a word has some five letters, and a repeat
#: is at least two windows of five words. By these sizes the noise of counting goes, not by what is good or poor.
MEASURES = {
    "chars_per_word": ("word_chars", "n_words", 5),
    "symbols_per_word": ("n_symbols", "n_words", 1),
    "marks_per_word": ("n_marks", "n_words", 1),
    "upper_share": ("n_upper", "word_chars", 5),
    "dup_line_share": ("n_dup_lines", "n_lines", 1),
    "repeat_share": ("n_repeat_words", "n_words", 10),
    "echo_share": ("n_echoes", "n_words", 1),
}
TWO_SIDED = ("chars_per_word",)  # the others cannot be too low
DIGITS = 3  # quartiles are rounded to so many digits, since a sketch's vary by its random bits
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once for each row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _union_of_windows(starts: Column) -> Column:
    """How many words five-word windows cover that begin at these sorted places."""
    widths = F.transform(starts, lambda at, i: F.least(F.lit(5), F.coalesce(F.get(starts, i + 1) - at, F.lit(5))))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda all_, x: all_ + x)


def _repeated_starts(found: Column) -> Column:
    """Of (hash, place) sorted by hash: the sorted places of those whose neighbour has the same hash."""
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter(found, lambda x, i: same(F.get(found, i - 1), x) | same(F.get(found, i + 1), x))
    return F.array_sort(F.transform(twice, lambda x: x["i"]))


def repeat_words(word: Column) -> Column:
    """Words that lie in five-word windows found twice or more in the array, first ones included.

    Windows count as equal where their 64-bit hashes are equal.
    """

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return bind(bind(pairs, _repeated_starts), _union_of_windows)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
        some = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(w) < 6, F.lit(0).cast("long")).otherwise(some)

    return bind(word, of)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of each whole text; a null text has none."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text_or_empty(F.col(text_col)).alias("t"))
    length = lambda chars: F.length(F.translate("t", chars, ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "word_chars": length(" \t\n\x0b\x0c\r"),
        "n_symbols": F.length("t") - length(SYMBOLS),
        "n_marks": F.length("t") - length("!"),
        "n_upper": F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", "")),
        "n_lines": bind(lines, F.size),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
    }
    echoes = lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False))))
    by_word = bind(words(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), echoes(w).cast("long").alias("n_echoes")))
    return rows.select("doc_id", "lang", "source", by_word.alias("w"), *[c.cast("long").alias(k) for k, c in counts.items()]).select(
        "doc_id", "lang", "source", "w.n_words", "w.n_repeat_words", "w.n_echoes", *counts
    )


def _shares(rows: DataFrame) -> DataFrame:
    return rows.withColumns({m: (F.col(count) / F.greatest(F.col(of), F.lit(1))).cast("double") for m, (count, of, _) in MEASURES.items()})


def quartiles(shares: DataFrame, k: int, least_rows: int) -> DataFrame:
    """Per language and source: of each measure, the pair's own quartiles and those that bound them."""
    names = list(MEASURES)
    own = shares.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in names])
    merged = lambda d, *keys: d.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in names])
    own = written(own, "quality-sketches")  # sketches draw at random: one draw serves every later step
    by_lang, every = written(merged(own, "lang"), "quality-sketches-lang"), written(merged(own), "quality-sketches-all")

    def cut(d: DataFrame, tag: str) -> DataFrame:
        def one(m: str) -> Column:
            q = F.kll_sketch_get_quantile_double(F.col(m), F.array(F.lit(0.25), F.lit(0.75)))
            return F.struct(*[F.bround(F.get(q, F.lit(i)), DIGITS).alias(name) for i, name in enumerate(("q1", "q3"))]).alias(m)

        return d.where("n > 0").select(*[c for c in ("lang", "source") if c in d.columns], F.col("n").alias(f"n_{tag}"), F.struct(*[one(m) for m in names]).alias(tag))

    a, b, c = cut(own, "own").alias("a"), cut(by_lang, "wide").alias("b"), cut(every, "all").alias("c")
    both = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang"))).join(F.broadcast(c), F.lit(True), "left")  # c is one row
    outer = F.when(F.col("n_wide") >= least_rows, F.col("wide")).otherwise(F.col("all"))
    bound = F.when(F.col("a.lang").isNull(), F.col("own")).otherwise(outer)  # rows without a language share none
    inner = F.when(F.col("n_own") >= least_rows, F.col("own")).otherwise(outer)
    return both.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), inner.alias("own"), F.when(F.col("n_own") >= least_rows, bound).otherwise(outer).alias("bound"))


def beyond(measure: str, own: str, bound: str, reach: float) -> Column:
    """Whether a row's rate lies beyond the fences that either pair of quartiles sets for a text of its length."""
    count, of, fills = MEASURES[measure]
    n = F.greatest(F.col(of), F.lit(1))

    def outside(of_group: str) -> Column:
        q1, q3 = F.col(f"{of_group}.{measure}.q1"), F.col(f"{of_group}.{measure}.q3")
        noise = lambda q: F.sqrt(q * n * fills + F.lit(fills * fills)) / n
        out = F.col(measure) > q3 + F.lit(reach) * (q3 - q1 + noise(q3))
        return out | (F.col(measure) < q1 - F.lit(reach) * (q3 - q1 + noise(q1))) if measure in TWO_SIDED else out

    return outside(own) | outside(bound)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    k: int = 400,
    reach: float = 3.0,
    least_rows: int = 40,
) -> DataFrame:
    """Return doc_id, lang, source, the counts, base_failed, failed (names of measures beyond fences) and kept.

    A text fails the base rules with fewer than 10 words, or where over 20 % of its words are in repeated windows.
    Quartiles come from all rows that pass them; null languages and sources are groups like others, a null or empty
    text has no words and fails. Repeated rows are judged alike. An empty table gives no rows. Other columns are
    not read. Groups of up to ``k`` rows have exact quartiles, larger ones those of a sketch.
    """
    rows = measured(docs, id_col, text_col, lang_col, source_col)
    bad = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = _shares(written(rows.withColumn("base_failed", bad), "quality-counts"))
    limits = quartiles(rows.where(~F.col("base_failed")), k, least_rows)
    joined = rows.alias("r").join(limits.alias("f"), F.col("r.lang").eqNullSafe(F.col("f.lang")) & F.col("r.source").eqNullSafe(F.col("f.source")), "left")
    failed = F.array_compact(F.array(*[F.when(beyond(m, "f.own", "f.bound", reach), F.lit(m)) for m in MEASURES]))
    return joined.select(
        "doc_id", F.col("r.lang").alias("lang"), F.col("r.source").alias("source"), *COUNTS, "base_failed", failed.alias("failed"),
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
    )
