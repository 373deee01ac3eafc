"""Personal data: plain detectors, and an offset-preserving pass over disguised text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """(start, end, kind) of the plain detectors: leftmost, non-overlapping per kind, failing matches dropped.

    The work is linear in the text: an e-mail is found from its ``@`` outwards, digit runs are tried from
    their first digit only.
    """
    found: list[Span] = []
    at, past = text.find("@"), 0
    while at >= 0:
        head = text[past:at]
        start = past + len(head.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            past = m.end()
        at = text.find("@", max(at + 1, past))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


# --- the transducers -------------------------------------------------------------------------------------
#: Letters and digits that look like an ASCII character, one source character for one target.
LOOKALIKES = str.maketrans(
    {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    | {chr(0x1D7CE + i): str(i % 10) for i in range(50)}
    | {chr(0x660 + i): str(i) for i in range(10)}
    | {chr(0x6F0 + i): str(i) for i in range(10)}
    | dict(zip("аеорсухіјѕԁһԛԝМНКВТАЕОРСХ", "aeopcyxijsdhqwMHKBTAEOPCX", strict=True))
    | dict(zip("αεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeiknoptuxABEZHIKMNOPTYX", strict=True))
    | dict(zip("․‧∙•。．＠﹫﹒﹣‐‑‒–—−", "......" + "@@.-" + "------", strict=True))
)
HAS_LOOKALIKE = re.compile("[" + "".join(re.escape(chr(c)) for c in LOOKALIKES) + "]")
#: Characters that are not seen; they fall out of the normal form.
UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
#: Spelled digits of the four languages of the tables.
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_DIGIT = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_DOT = "(?:dot|punkt|point|punto)"
_UNIT = rf"(?:{_DIGIT}|[0-9]++|plus)"
_BETWEEN = rf"(?:[ \t]{{1,3}}{_DOT}[ \t]{{1,3}}|[ \t,./()-]{{1,3}})"
#: Runs of spelled digits, groups of digits, "plus" and dots may form a number; the detectors' checks decide.
SPELLED = re.compile(rf"(?i)(?<!\w){_UNIT}(?:{_BETWEEN}{_UNIT})+(?!\w)")
SPELLED_SIGN = re.compile(rf"(?i)(?<!\w){_DIGIT}{_BETWEEN}{_UNIT}(?!\w)|[0-9]{_BETWEEN}{_DIGIT}(?!\w)|(?<!\w)plus[ \t]")
_UNIT_TOKEN = re.compile(r"(?i)[^\W_]+")
#: A bracketed at or dot always stands for the sign; bare words only inside "name at host dot name" and "name at host.name".
BRACKETED = re.compile(r"(?i)[ \t]{0,3}[\[({<][ \t]{0,3}(?:(at|@|arroba|arobase|chez)|(dot|\.|punkt|point|punto))[ \t]{0,3}[\])}>][ \t]{0,3}")
BARE = re.compile(
    r"(?i)(?<![\w.%+-])(?P<name>[a-z0-9._%+-]{1,64}(?:[ \t]{1,3}(?:dot|punkt|point|punto)[ \t]{1,3}[a-z0-9._%+-]{1,64}){0,3}?)(?P<at>[ \t]{1,3}(?:at|arroba|arobase)[ \t]{1,3}|[ \t]{0,3}@[ \t]{0,3})(?P<host>[a-z0-9-]{1,63})"
    r"(?P<dots>(?:(?:[ \t]{1,3}(?:dot|punkt|point|punto)[ \t]{1,3}|\.)[a-z0-9-]{2,63}){1,6})(?![\w-])"
)
#: Words that follow "at" in prose and are no host.
NO_HOST = {"the", "a", "an", "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their"}
#: Words before "at" in prose that are no name where the host is written plainly.
NO_NAME = {"look", "looks", "looked", "looking", "available", "hosted", "found", "published", "posted", "sold", "visit", "see", "us", "me", "them", "is", "was", "are", "were", "be", "been", "online", "more", "live", "and", "or", "work", "works", "worked", "working"}
DOT_NAME = re.compile(rf"(?i){_DOT}")
DOT_WORD = re.compile(r"(?i)[ \t]{1,3}(?:dot|punkt|point|punto)[ \t]{1,3}")
AT_SIGN = re.compile(r"(?i)[\[({<][ \t]{0,3}(?:at|@|\.|dot|arroba|arobase|chez|punkt|point|punto)[ \t]{0,3}[\])}>]|[ \t](?:dot|punkt|point|punto)[ \t]|[ \t]@|@[ \t]|[ \t](?:at|arroba|arobase)[ \t]{1,3}[a-z0-9-]{1,63}\.[a-z0-9]")


class Tape:
    """A text with, for each character, the source span it stands for. Untouched texts carry no map."""

    def __init__(self, text: str) -> None:
        self.text, self.map = text, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ascending, non-overlapping [start, end) spans."""
        if not edits:
            return
        old = self.map or [(i, i + 1) for i in range(len(self.text))]
        text, spans, past = [], [], 0
        for start, end, new in edits:
            text += [self.text[past:start], new]
            spans += old[past:start]
            if new:
                spans += [(old[start][0], old[end - 1][1])] * len(new)
            past = end
        self.text, self.map = "".join([*text, self.text[past:]]), [*spans, *old[past:]]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.map is None else (self.map[start][0], self.map[end - 1][1])


def is_ip(text: str) -> bool:
    return any(kind == "ip" for *_, kind in detect(text))


def spelled_edits(text: str, dotted: bool = False) -> list[tuple[int, int, str]]:
    """Digits for spelled ones, with nothing between units; two groups of digits keep what stands between them.
    ``dotted`` reads dots as such and takes only the runs that hold an address then."""
    edits = []
    for m in SPELLED.finditer(text):
        units, dots = [], set()
        for u in _UNIT_TOKEN.finditer(text, m.start(), m.end()):
            if DOT_NAME.fullmatch(u[0]):
                dots.add(len(units))  # before the next unit
            else:
                units.append(u)
        words = [u[0].lower() for u in units]
        digits = ["+" if w == "plus" else str(DIGITS.get(w, w)) for w in words]
        spelled = sum(w in DIGITS for w in words)
        # one such word beside digits is mostly an article ("un", "one")
        if (not (spelled or dots)) if dotted else (spelled < 2 or sum(map(len, digits)) < 9):
            continue
        run, past = [], ""
        for k, u in enumerate(units):
            end = units[k + 1].start() if k + 1 < len(units) else u.end()
            between, after = text[u.end() : end], k + 1 < len(units)
            if dotted and after and (k + 1 in dots or "." in between):
                new = "."
            elif after and words[k].isdecimal() and words[k + 1].isdecimal() and len(words[k] + words[k + 1]) > 2 and k + 1 not in dots:
                new = between
            else:
                new = ""
            # what stands between two units goes with the first, so that digits meet
            run.append((u.start(), end if new != between else u.end(), digits[k] + (new if new != between else "")))
            past += digits[k] + new
        if not dotted or is_ip(past):
            edits += run
    return edits


def bare_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in BARE.finditer(text):
        if m["host"].lower() in NO_HOST:
            continue
        signs = [*((d.start(), d.end(), ".") for d in DOT_WORD.finditer(text, *m.span("name"))), (*m.span("at"), "@"), *((d.start(), d.end(), ".") for d in DOT_WORD.finditer(text, *m.span("dots")))]
        plain = len(signs) == 1 and "@" not in m["at"]
        if plain and (m["name"].lower() in NO_NAME or not m["dots"].rpartition(".")[2].isalpha()):
            continue
        if m["at"] != "@" or len(signs) > 1:
            edits += signs
    return edits


def normalise(text: str) -> list[Tape]:
    """Readings of the text without disguises, none where none is seen: one that joins the digits of runs, and one
    that keeps their dots where that gives an address."""
    seen = not text.isascii() and (HAS_LOOKALIKE.search(text) or UNSEEN.search(text))
    plain = text.translate(LOOKALIKES) if seen else text  # one for one: offsets stay
    if not (seen or AT_SIGN.search(text) or SPELLED_SIGN.search(text)):
        return []

    def read(dotted: bool) -> Tape:
        tape = Tape(plain)
        if seen:
            tape.rewrite([(m.start(), m.end(), "") for m in UNSEEN.finditer(tape.text)])
        tape.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(tape.text)])
        numbers = spelled_edits(tape.text, dotted)
        if dotted and not numbers:
            return Tape(text)
        tape.rewrite(numbers)
        tape.rewrite(bare_edits(tape.text))
        return tape

    return [tape for tape in (read(False), read(True)) if tape.map is not None or tape.text != text]


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans: a disguised one joins unless it lies within a base span of its kind."""
    base = detect(text)
    both = list(base)
    for tape in normalise(text):
        for start, end, kind in detect(tape.text):
            a, b = tape.source(start, end)
            if not any(k == kind and s <= a and b <= e for s, e, k in both):
                both.append((a, b, kind))
    return base, sorted(both, key=lambda s: (s[0], KINDS.index(s[2])))


def join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, past = [], 0
    for start, end, kind in spans:
        if start >= past:
            out += [text[past:start], f"[{kind.upper()}]"]
        past = max(past, end)
    return "".join([*out, text[past:]])


def scan(docs: DataFrame, text: str = "text", rewrite: bool = False) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256 and spans; with
    ``rewrite`` the text comes back redacted by all spans, else it is dropped.

    A null text counts as empty (and stays null when rewritten): no spans, the hash of nothing. Rows are
    independent, so repeats, ties and long texts need no shuffle; an empty table gives an empty result; other
    columns pass through and those named like the new ones are replaced.
    """
    new = ["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"]
    docs = docs.drop(*new)
    kept = [f for f in docs.schema.fields if rewrite or f.name != text]
    schema = StructType([*kept, *(StructField(c, LongType()) for c in new[:5]), StructField("base_sha256", StringType()), StructField("spans", StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            counts: list[list[int]] = [[] for _ in range(5)]
            hashes, spans, bodies = [], [], []
            for t in texts:
                base, both = find_spans(t or "")
                for i, k in enumerate(KINDS):
                    counts[i].append(sum(s[2] == k for s in base))
                counts[4].append(len(both) - len(base))
                hashes.append(hashlib.sha256(join(base).encode()).hexdigest())
                spans.append(join(both))
                if rewrite:
                    bodies.append(None if t is None else redact(t, both))
            columns = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in kept}
            if rewrite:
                columns[text] = pa.array(bodies, pa.string())
            columns |= {n: pa.array(c, pa.int64()) for n, c in zip(new, counts, strict=False)}
            columns |= {"base_sha256": pa.array(hashes, pa.string()), "spans": pa.array(spans, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(each, schema)
