"""Quality rules with thresholds that follow each language and source, in DataFrame functions only.

Four shares of every document go into quantile sketches per language and source. Sketches merge, so a
hot source is summed up before it is shuffled, and a group too small for its own quantiles takes those of
its language or, failing that, of all documents. Two of the shares are 0 almost everywhere; their rows above 0
have sketches of their own, of which a high quantile is the least threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from smeltery.llm.folders import stored
from smeltery.llm.native import covered, let, starts

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RUN = 8
SHARES = ("symbol_share", "dup_line_share", "repeat_share", "word_length")
FLOORS = {"symbol_share": 0.02, "dup_line_share": 0.02, "repeat_share": 0.02, "word_length": 2.0}
"""Smallest distance of a threshold from the upper quartile, so that groups without spread keep their rows."""
TAILS = ("dup_line_share", "repeat_share")
"""Shares that are 0 in most rows, where quartiles say nothing: a threshold is at least the ``TAIL`` quantile of the
language's rows above 0; failing that, of all rows above 0; failing that, ``fallback_tails``."""
FALLBACK_TAILS = {"dup_line_share": 0.25, "repeat_share": 0.20}
TAIL, TAIL_SIZE = 0.98, 1000


def _repeated(words: Column) -> Column:
    """Words inside windows of ``RUN`` words that the text has at least twice."""
    hashes = F.transform(starts(F.size(words), RUN), lambda s: F.xxhash64(F.slice(words, s + 1, RUN)))

    def walk(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def spans(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
            return covered(F.transform(twice, lambda x: F.struct(x["i"].alias("lo"), (x["i"] + RUN).alias("hi"))))

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, spans)).otherwise(F.lit(0))

    return let(hashes, walk)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _with_measures(docs: DataFrame, text: str, **more: Column) -> DataFrame:
    """row (all columns of the input in one struct, so that no name meets ours), ``more`` and the measures."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    word_counts = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("rep")))
    out = docs.select(
        F.struct("*").alias("row"),
        *[c.alias(n) for n, c in more.items()],
        word_counts.alias("words"),
        line_counts.alias("lines"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return out.select(
        "row",
        *more,
        F.col("words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        F.col("lines.n").cast("long").alias("n_lines"),
        F.col("words.rep").cast("long").alias("n_repeat_words"),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words (long) added.

    Columns of these names are replaced, all others stay as they are. Null and empty texts have 0
    everywhere. Lines without a word are not counted as lines.
    """
    return _with_measures(docs.drop(*MEASURES), text).select("row.*", *MEASURES)


def thresholds(rows: DataFrame, spread: float, least_rows: int, fallback_tails: dict[str, float] | None = None) -> DataFrame:
    """g_lang, g_source and the highest share that each rule lets pass; rows have the columns lang, source and the shares."""
    fallback_tails = fallback_tails or {}
    positive = {f"{s}_tail": F.when(F.col(s) > 0, F.col(s)) for s in TAILS}
    sketched = rows.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(
        F.count("*").alias("n"),
        *[F.kll_sketch_agg_double(s).alias(s) for s in SHARES],
        *[F.kll_sketch_agg_double(c, TAIL_SIZE).alias(name) for name, c in positive.items()],
    )
    group = stored(sketched, "quality-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(s).alias(s) for s in SHARES], *[F.kll_merge_agg_double(name, TAIL_SIZE).alias(name) for name in positive]]
    by_lang = group.groupBy("g_lang").agg(*merged)
    every = group.agg(*merged)

    def limits(df: DataFrame, prefix: str) -> DataFrame:
        def limit(s: str) -> Column:
            low, high = (F.kll_sketch_get_quantile_double(F.col(s), F.lit(q)) for q in (0.25, 0.75))
            return high + F.greatest(F.lit(FLOORS[s]), F.lit(spread) * (high - low))

        def tail(s: str) -> Column:
            sketch = F.col(f"{s}_tail")
            enough = F.kll_sketch_get_n_double(sketch) >= F.greatest(F.lit(least_rows), F.lit(1))
            return F.when(enough, F.kll_sketch_get_quantile_double(sketch, F.lit(TAIL)))

        keys = [c for c in ("g_lang", "g_source") if c in df.columns]
        return df.select(
            *[F.col(k).alias(f"{prefix}_{k}") for k in keys],
            F.when(F.col("n") >= least_rows, F.struct(*[limit(s).alias(s) for s in SHARES])).alias(f"{prefix}_limits"),
            F.struct(*[tail(s).alias(s) for s in TAILS]).alias(f"{prefix}_tails"),
        )

    l, s = limits(by_lang, "l"), limits(group, "s").drop("s_tails")
    joined = s.join(l, F.col("s_g_lang").eqNullSafe(F.col("l_g_lang")), "left")
    total = limits(every, "e").select(F.struct("e_limits", "e_tails").alias("e")).scalar()
    found = joined.select(F.col("s_g_lang").alias("g_lang"), F.col("s_g_source").alias("g_source"), "s_limits", "l_limits", "l_tails", total.alias("e"))
    found = found.withColumn("quartiles", F.coalesce("s_limits", "l_limits", "e.e_limits"))

    def least(s: str) -> Column:
        by_quartiles = F.col(f"quartiles.{s}")
        if s not in TAILS:
            return by_quartiles
        # without a quantile of its own the rule has no threshold, unless one is given
        known = F.coalesce(f"l_tails.{s}", f"e.e_tails.{s}", F.lit(fallback_tails.get(s)).cast("double"))
        return F.when(by_quartiles.isNotNull() & known.isNotNull(), F.greatest(by_quartiles, known))

    return found.select("g_lang", "g_source", F.struct(*[least(s).alias(s) for s in SHARES]).alias("limits"))


def judge_quality(
    docs: DataFrame, spread: float = 3.0, least_rows: int = 50, fallback_tails: dict[str, float] | None = FALLBACK_TAILS, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """All rows with the measures, base_failed and kept added; columns of these names are replaced, all others stay.

    ``base_failed``: under 20 words, or more than 30 in 100 words repeated. ``kept`` is false there, and where
    a share lies over the upper quartile of its language and source by more than ``spread`` quartile distances
    (and by more than its floor). Shares of ``TAILS`` also have to lie over a high quantile of the language's
    rows above 0; where under ``least_rows`` such rows exist at all, over the share in ``fallback_tails``, and
    with none given the rule is off there. Only rows that pass the base rules count for the quartiles. Groups
    under ``least_rows`` rows use their language's, then all rows' quartiles; if those are too few as well,
    the base rules alone decide. Null languages and sources are groups of their own; null and empty texts
    fail the base rules; repeated rows are judged each; an empty table gives no rows.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    chars, words, lines = (F.nullif(F.col(c), F.lit(0)) for c in ("word_chars", "n_words", "n_lines"))
    given = docs.drop("base_failed", "kept", *MEASURES)
    rows = stored(
        _with_measures(given, text, lang=F.col(f"`{lang}`"), source=F.col(f"`{source}`")).select(
            "*",
            failed.alias("base_failed"),
            (F.col("n_symbols") / chars).alias("symbol_share"),
            (F.col("n_dup_lines") / lines).alias("dup_line_share"),
            (F.col("n_repeat_words") / words).alias("repeat_share"),
            (F.col("word_chars") / words).alias("word_length"),
        ),
        "quality-measures",
    )
    limits = stored(thresholds(rows.where("NOT base_failed"), spread, least_rows, fallback_tails), "quality-limits")
    judged = rows.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    over = F.lit(False)
    for s in SHARES:
        over = over | F.coalesce(F.col(s) > F.col(f"limits.{s}"), F.lit(False))
    return judged.select("row.*", *MEASURES, "base_failed", (~F.col("base_failed") & ~over).alias("kept"))
