"""Parsing of free-text answers as native column expressions.

Patterns carry Java's Unicode word, class and line rules so that they act on any script as they do on ASCII.
All work is per row: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C

UNICODE, CASELESS = "(?Ud)", "(?iUd)"
#: All that Unicode calls white space, as ``(?U)\\s`` does.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def fold(label: Column) -> Column:
    """Lower case without white space at both ends."""
    return F.lower(strip(label))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


#: Where a word may be broken without being too long: after a hyphen between two words of letters, and around a dash of hyphens.
_LETTER, _BEFORE_DASH = r"[\w&&[^\d]]", r"""[\w!"'&.,?]"""
BREAKS = rf"""(?U)(?<={_LETTER}{{2}}-|{_LETTER}-{_LETTER}-)(?={_LETTER}-?{_LETTER})|(?<={_BEFORE_DASH})(?=-{{2,}}\w)|(?<={_BEFORE_DASH}-{{2,99}})(?=\w)"""


def wrap(text: Column, width: int = 58, lines: int | None = None) -> Column:
    """The lines of ``text`` as an array, filled word by word to at most ``width`` characters; with ``lines`` the first so many.

    White space of any kind is one blank. A word goes to the next line where it does not fit, in parts where it has hyphens;
    one longer than a line fills the rest of its line and is cut, after a hyphen where there is one. No text has no lines.
    """
    clean = squeeze(F.coalesce(text, F.lit("")))
    if lines is not None:  # later characters can not reach the first lines
        clean = F.left(clean, F.lit((lines + 1) * (width + 1)))
    words = F.filter(F.split(clean, " "), lambda w: w != "")
    pieces = F.flatten(F.transform(words, lambda w: F.transform(F.split(w, BREAKS), lambda p, i: F.struct(p.alias("text"), (i == 0).alias("gap")))))
    state = lambda done, now, rest: F.struct(done.alias("done"), now.alias("now"), rest.alias("rest"))
    closed = lambda done, now: F.when(F.rtrim(now) == "", done).otherwise(F.concat(done, F.array(F.rtrim(now))))
    blank, none = F.lit(""), F.array().cast("array<string>")

    def step(s: Column) -> Column:
        done, now, rest = s["done"], s["now"], s["rest"]
        room = F.lit(width) - F.char_length(now)
        head = F.left(rest, room)
        hyphen = F.char_length(head) - F.locate("-", F.reverse(head)) + 1  # the place of the last one, from 1
        cut = F.when(head.contains("-") & (hyphen > 1) & F.left(head, hyphen - 1).rlike("[^-]"), hyphen).otherwise(room)
        return (
            F.when(F.char_length(rest) <= room, state(done, F.concat(now, rest), blank))
            .when(F.char_length(rest) <= width, state(closed(done, now), rest, blank))
            .otherwise(state(closed(done, F.concat(now, F.left(rest, cut))), blank, F.substring(rest, cut + 1, F.char_length(rest))))
        )

    def add(s: Column, piece: Column) -> Column:
        full = F.char_length(s["now"]) >= width
        gap = piece["gap"] & (s["now"] != "")
        begin = F.when(gap & full, state(closed(s["done"], s["now"]), blank, piece["text"])).otherwise(state(s["done"], F.when(gap, F.concat(s["now"], F.lit(" "))).otherwise(s["now"]), piece["text"]))
        rounds = F.when(F.char_length(piece["text"]) <= width, 1).otherwise(F.char_length(piece["text"]) + 1 if lines is None else F.lit(lines + 2))
        return F.aggregate(F.sequence(F.lit(1), rounds), begin, lambda a, _: F.when(a["rest"] == "", a).otherwise(step(a)))

    out = F.aggregate(pieces, state(none, blank, blank), add, lambda s: closed(s["done"], s["now"]))
    return out if lines is None else F.slice(out, 1, lines)


def confidence(text: Column) -> Column:
    """Stated confidence 0 to 100: the first pattern whose first match is in range, else null."""
    def number(pattern: str) -> Column:  # array functions read the match once; a condition and its value would each match the text
        found = F.filter(F.array(F.regexp_extract(text, CASELESS + pattern, 1)), lambda v: v != "")
        return F.get(F.filter(F.transform(found, lambda v: v.try_cast("int")), lambda n: n.between(0, 100)), F.lit(0))

    return F.coalesce(*[number(p) for p in C.CONFIDENCE_PATTERNS])


def abstains(text: Column) -> Column:
    """Whether any abstention pattern occurs."""
    return F.coalesce(text.rlike(CASELESS + "|".join(f"(?:{p})" for p in C.ABSTAIN_PATTERNS)), F.lit(False))


def findings(text: Column) -> Column:
    """Lexicon phrases in the text, lower-cased, first mention first, without those after a near negation.

    Matches are fenced with control characters and the text is split at them, so that each phrase comes with
    what stands before it.
    """
    phrases = CASELESS + r"\b(" + "|".join(re.escape(p).replace(r"\ ", " ").replace(r"\-", "-") for p in C.FINDING_PHRASES) + r")\b"
    text = F.when(text.contains("\x01") | text.contains("\x02"), F.translate(text, "\x01\x02", "")).otherwise(text)

    def listed(parts: Column) -> Column:
        before = lambda i: F.replace(F.array_join(F.slice(parts, F.lit(1), i), ""), F.lit("\x02"), F.lit(""))
        hits = F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.struct(F.lower(F.substring_index(F.get(parts, i), "\x02", 1)).alias("phrase"), F.lower(F.right(before(i), F.lit(C.NEGATION_REACH))).alias("context")),
        )
        kept = F.filter(hits, lambda h: ~h["context"].rlike(UNICODE + C.NEGATION))
        return F.when(F.size(parts) > 1, F.array_distinct(F.transform(kept, lambda h: h["phrase"]))).otherwise(F.array().cast("array<string>"))

    return let(F.split(F.regexp_replace(text, phrases, "\x01$1\x02"), "\x01"), listed)


def _cleaned(text: Column) -> Column:
    return strip(F.btrim(fold(text), F.lit("*")))


def let(value: Column, body) -> Column:
    """Bind ``value`` once, so that a lambda that uses it many times does not evaluate it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def to_answer(text: Column, space: Column) -> Column:
    """A label of ``space`` (an array column) that the text stands for, or null.

    In order: the label itself; an alias of one; the longest alias inside the text; the longest label inside.
    """
    table = C.alias_table()
    names = F.create_map(*[F.lit(x) for kv in table for x in kv])
    # by label, its aliases with their places in the table: only those of the space's labels are tried
    ranked = lambda label: F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(a).alias("alias"), F.lit(c).alias("label")) for i, (a, c) in enumerate(table) if c == label])
    of_label = F.create_map(*[x for label in dict(map(reversed, table)) for x in (F.lit(label), ranked(label))])

    def found(clean: Column) -> Column:
        exact = F.try_element_at(F.filter(space, lambda s: F.lower(s) == clean), F.lit(-1))
        named = F.get(F.filter(F.array(F.try_element_at(names, clean)), lambda c: F.array_contains(space, c)), F.lit(0))
        own = F.flatten(F.array_compact(F.transform(space, lambda s: F.try_element_at(of_label, s))))
        inside = F.array_min(F.filter(own, lambda a: clean.contains(a["alias"])))["label"]
        by_length = F.array_sort(F.transform(space, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
        label = F.try_element_at(F.filter(by_length, lambda s: clean.contains(F.lower(s["s"]))), F.lit(1))["s"]
        return F.coalesce(exact, named, inside, label)

    return F.when((F.coalesce(text, F.lit("")) != "") & (F.size(space) > 0), let(_cleaned(text), found))


def to_known_answer(text: Column, space: list[str]) -> Column:
    """``to_answer`` for a space known when the plan is made: only its own aliases are tried, whole texts by a
    map and inner phrases in order of precedence."""
    if not space:
        return F.lit(None).cast("string")
    table = [(a, c) for a, c in C.alias_table() if c in space]
    whole = dict(table) | {s.lower(): s for s in space}
    names = F.create_map(*[F.lit(x) for kv in whole.items() for x in kv])
    phrases = [*table, *((s.lower(), s) for s in sorted(space, key=len, reverse=True))]
    inner = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(c).alias("label")) for a, c in phrases])
    found = lambda clean: F.coalesce(F.try_element_at(names, clean), F.try_element_at(F.filter(inner, lambda a: clean.contains(a["alias"])), F.lit(1))["label"])
    return F.when(F.coalesce(text, F.lit("")) != "", let(_cleaned(text), found))


def option_answer(text: Column, options: Column, fallback: Column | None = None) -> Column:
    """The option that a multiple-choice answer picks: the letter after "answer", else a leading letter, else
    what ``to_answer`` finds among the options. Letters beyond the options are passed over."""
    clean = strip(text)

    def pick(pattern: str) -> Column:
        return F.get(options, F.ascii(F.upper(F.regexp_extract(clean, pattern, 1))) - 65)  # null beyond the options, and without a match

    found = F.coalesce(pick(CASELESS + C.ANSWER_LETTER), pick(UNICODE + C.LEADING_LETTER), to_answer(clean, options) if fallback is None else fallback)
    return F.when((F.coalesce(text, F.lit("")) != "") & (F.size(options) > 0), found)


def parse_responses(df: DataFrame, spaces: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` (task, format, response, mc_options) with pred_answer, confidence, asserted_findings, abstained,
    unparseable. Abstention overrules any answer; findings are read in open answers only."""
    spaces = C.ANSWER_SPACES if spaces is None else spaces
    text = F.coalesce("response", F.lit(""))
    df = df.withColumns({"confidence": confidence(text), "abstained": abstains(text)})
    known = F.lit(None).cast("string")
    for task, space in spaces.items():
        known = F.when(F.col("task") == task, to_known_answer(text, space)).otherwise(known)
    options = F.coalesce("mc_options", F.array().cast("array<string>"))
    chosen = F.when((F.coalesce("format", F.lit("OE")) == "MC") & (F.size(options) > 0), option_answer(text, options)).otherwise(known)
    df = df.withColumn("_pred", F.when(~F.col("abstained"), chosen))
    empty = F.array().cast("array<string>")
    return df.withColumns(
        {
            "pred_answer": F.when(F.col("abstained"), C.UNSURE).otherwise(F.coalesce("_pred", F.lit(C.UNPARSEABLE))),
            "asserted_findings": F.when(~F.col("abstained") & (F.coalesce("format", F.lit("OE")) == "OE"), findings(text)).otherwise(empty),
            "unparseable": ~F.col("abstained") & F.col("_pred").isNull(),
        }
    ).drop("_pred")


def labels_match(a: Column, b: Column) -> Column:
    """Equal but for case and outer white space; nothing equals an empty label."""
    return F.coalesce((fold(a) == fold(b)) & (a != "") & (b != ""), F.lit(False))


def short_name(model: Column, length: int | None = None, names: dict[str, str] | None = None) -> Column:
    """The part after the last slash without -Instruct and -it; cut to ``length``; or the name it is given."""
    base = F.element_at(F.split(model, "/"), -1)
    out = F.replace(F.replace(base, F.lit("-Instruct"), F.lit("")), F.lit("-it"), F.lit(""))
    if length:
        out = F.left(out, F.lit(length))
    if names:
        shown = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        out = F.coalesce(F.try_element_at(shown, out), out)
    return out


def model_tag(model: Column) -> Column:
    """A file-name tag: lower case, without the known endings in their order, other characters as hyphens."""
    out = F.lower(F.element_at(F.split(model, "/"), -1))
    for ending in C.MODEL_TAG_SUFFIXES:
        out = F.regexp_replace(out, re.escape(ending) + "$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)[^\p{IsAlphabetic}\p{IsDigit}.\-_]", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("model"))
