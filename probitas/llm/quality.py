"""Quality rules with thresholds that adapt to each language and source; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, broadcast_if_small, let, set_aside, stage

SYMBOLS = "#*$%&|<>"
#: Values below this have a bin each in the sketch; above, each power of two has half as many bins.
EXACT_BELOW = 64
#: A fence needs at least so many documents of its (lang, source); else the language's sketch, else everyone's.
LEAST_DOCS = 100
#: A document is dropped by a measure above q3 + FENCE * max(q3 - q1, its least spread), whatever share that is.
FENCE = 6
#: The measures that are fenced, per 1000 words, with their least spread. The base rule leaves at most 200 repeated words
#: per 1000, so that measure's fence has to start below.
MEASURES = {"m_repeat": 30, "m_symbols": 40, "m_dup_lines": 40, "m_long_words": 1500}


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of ``text``."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many words lie in a window of five words that is found twice or more in the text.

    A first sort of the windows' 64-bit hashes tells whether any repeats, which few texts have; only then
    (hash, place) pairs are sorted, and the places of repeats are summed up as the union of their windows.
    """
    return let(words, lambda w: _repeated_words(w, window))


def _repeated_words(words: Column, window: int) -> Column:
    n = F.size(words) - (window - 1)
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(window)])
    places = F.sequence(F.lit(0), n - 1)

    def union(sorted_places: Column) -> Column:
        return F.aggregate(
            sorted_places,
            F.struct(F.lit(0).alias("sum"), F.lit(-window).alias("last")),
            lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(window), p - acc["last"])).alias("sum"), p.alias("last")),
            lambda acc: acc["sum"],
        )

    def found(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        twice = F.filter(places, lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return union(F.array_sort(F.transform(twice, lambda i: F.get(pairs, i)["p"])))

    distinct = F.size(F.array_distinct(F.transform(places, at)))
    slow = let(F.array_sort(F.transform(places, lambda i: F.struct(at(i).alias("h"), i.alias("p")))), found)
    return F.when(n < 2, 0).when(distinct == n, 0).otherwise(slow).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text has no words and fails the base rule. word_chars counts code points.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    length = F.char_length(body)
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    out = docs.withColumns(
        {
            "_words": words_of(F.col(text)),
            "_lines": lines,
            "word_chars": F.char_length(F.translate(body, BLANKS, "")).cast("long"),
            "n_symbols": (length - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    ).drop("_words", "_lines")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def bin_of(value: Column) -> Column:
    """The sketch's bin of an integer from 0: its own below 64, else by its five leading bits."""
    bits = F.length(F.bin(value))
    over = bits - 6
    return F.when(value < EXACT_BELOW, value).otherwise(EXACT_BELOW + (over - 1) * 32 + F.call_function("shiftright", value, over.cast("int")) - 32).cast("int")


def top_of_bin(b: Column) -> Column:
    """The largest value of a bin."""
    step = F.floor((b - EXACT_BELOW) / 32).cast("int") + 1
    lead = (b - EXACT_BELOW) % 32 + 33
    return F.when(b < EXACT_BELOW, b).otherwise(F.call_function("shiftleft", lead.cast("long"), step) - 1).cast("long")


def fences(measured: DataFrame, groups: list[str]) -> DataFrame:
    """One row per level (group, language, all) and measure with the fence.

    The sketch of a measure is its counts per logarithmic bin (relative error below 1/32), which merge by
    addition: one partial aggregation gives the sketches of all (lang, source); those of the languages and of
    the whole are their sums. Their size depends on the number of groups and bins, not on that of rows.
    """
    # failed documents give nulls here, not a filter: one on base_failed would be pushed below the measures
    stack = "stack({}, {}) as (measure, value)".format(len(MEASURES), ", ".join(f"'{m}', if(base_failed, null, {m})" for m in MEASURES))
    cells = measured.selectExpr(*groups, stack).filter("value is not null").groupBy(*groups, "measure", bin_of(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))
    cells = stage(cells, "sketch")
    levels = [groups[: len(groups) - i] for i in range(len(groups) + 1)]
    out = None
    for level, keys in enumerate(levels):
        sketch = cells.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
        bins = F.array_sort(F.collect_list(F.struct("bin", "n")))  # as many entries as bins, at most some two thousand
        got = sketch.groupBy(*keys, "measure").agg(bins.alias("bins"), F.sum("n").alias("docs"))

        def quantile(q: float) -> Column:
            def step(acc: Column, x: Column) -> Column:
                seen = acc["seen"] + x["n"]
                hit = acc["bin"].isNull() & (seen >= F.ceil(F.col("docs") * q))
                return F.struct(seen.alias("seen"), F.when(hit, x["bin"]).otherwise(acc["bin"]).alias("bin"))

            start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bin"))
            return top_of_bin(F.aggregate("bins", start, step, lambda acc: acc["bin"]))

        floor = F.element_at(F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv]), F.col("measure"))
        got = got.withColumns({"q1": quantile(0.25), "q3": quantile(0.75)})
        fence = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), floor)
        row = got.groupBy(*keys).pivot("measure", list(MEASURES)).agg(F.first(fence)).join(got.groupBy(*keys).agg(F.first("docs").alias("docs")), keys, "inner") if keys else got.groupBy(F.lit(1).alias("_one")).pivot("measure", list(MEASURES)).agg(F.first(fence)).withColumn("docs", F.lit(LEAST_DOCS).cast("long")).drop("_one")
        row = row.filter(F.col("docs") >= LEAST_DOCS).select(F.lit(level).alias("level"), *[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in groups], *MEASURES)
        out = row if out is None else out.unionByName(row)
    return stage(out, "fences")


def apply_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` with the base measures and ``kept``.

    kept is false where the base rule fails, else false where a measure is beyond the fence of the document's
    (lang, source); groups of under 100 documents take the language's fence, then everyone's. Quartiles set the fence, so
    up to a quarter of a group may lie beyond it and none has to. Null languages
    and sources form groups of their own. An empty table gives an empty result. Other columns pass through, those of
    the new names are replaced; without ``keep_text`` the text is dropped. Measures are made once and staged.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    slim, restore = set_aside(docs, [text, lang, source], new)
    base = measure(slim, text)
    base = stage(base if keep_text else base.drop(text), "measures")
    per = lambda a, scale: F.floor(F.col(a) * scale / F.greatest(F.col("n_words"), F.lit(1))).cast("long")
    base = base.withColumns(
        {"_lang": F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("")), "_source": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")), "m_repeat": per("n_repeat_words", 1000), "m_symbols": per("n_symbols", 1000), "m_dup_lines": per("n_dup_lines", 1000), "m_long_words": per("word_chars", 1000)}
    )
    keep = ["n_words", "base_failed", "_lang", "_source", *MEASURES]
    table = fences(base.select(*keep), ["_lang", "_source"])
    # (languages + 1) * (sources + 1) + 1 rows; its stored size is checked before it is broadcast.
    at = lambda level, name: table.filter(F.col("level") == level).select(*[k for k in ("_lang", "_source")[: 2 - level]], F.struct(*MEASURES).alias(name))
    hint = broadcast_if_small(table) is not table
    side = lambda x: F.broadcast(x) if hint else x
    everyone = table.filter(F.col("level") == 2).select(*MEASURES).first() or {m: None for m in MEASURES}
    out = base.join(side(at(0, "_f0")), ["_lang", "_source"], "left").join(side(at(1, "_f1")), ["_lang"], "left")
    fence = F.coalesce("_f0", "_f1", F.struct(*[F.lit(everyone[m]).cast("long").alias(m) for m in MEASURES]))
    beyond = [F.coalesce(F.col(m) > fence[m], F.lit(False)) for m in MEASURES]
    any_beyond = beyond[0] | beyond[1] | beyond[2] | beyond[3]
    return restore(out.withColumn("kept", ~(F.col("base_failed") | any_beyond)), *new)
