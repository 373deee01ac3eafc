"""Identifiers, hashes and small renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_prefix(digest: Column, digits: int = 8) -> Column:
    """The first hex digits of a digest as a number."""
    return F.conv(F.left(digest, F.lit(digits)), 16, 10).cast("long")


def item_seed(image_id: Column, task: Column, phrasing: Column) -> Column:
    """The first four bytes of the item's sha256."""
    return hex_prefix(F.sha2(F.concat_ws("|", image_id, task, phrasing), 256))


def hash_order(seed: int, *keys: Column) -> Column:
    """A sort key for reproducible samples that any engine can recompute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def md5_modulo(key: Column, n: int) -> Column:
    """The 128-bit md5 of ``key`` modulo ``n``, digit by digit."""
    digits = F.filter(F.split(F.md5(key), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, c: (acc * 16 + F.conv(c, 16, 10).cast("long")) % n)


def shard_of(image_id: Column, prompt_id: Column, shards: int) -> Column:
    return md5_modulo(F.concat_ws("|", image_id, prompt_id), shards)


def image_id(dataset: Column, subject: Column, modality: Column, plane: Column, fraction: Column) -> Column:
    return F.concat_ws("__", dataset, subject, modality, plane, F.replace(F.format_string("%.2f", fraction), F.lit("."), F.lit("p")))


def image_file(image: Column) -> Column:
    return F.concat(image, F.lit(".png"))


def content_prefix(content: Column) -> Column:
    """16 hex digits of the sha256 of the first 64 KiB."""
    return F.left(F.sha2(F.substring(content, 1, 65536), 256), F.lit(16))


def cache_key(model: Column, path: Column, prompt: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", model, path, prompt), 256), F.lit(24))


def file_label(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("__"))


def utc_now_iso() -> Column:
    """Now in UTC as ISO 8601 text, whatever the session's time zone."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def option_line(options: Column) -> Column:
    """``A. x  B. y`` with two blanks between."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char((i + 65).cast("long")), F.lit(". "), o)), "  ")


def hashed_shuffle(options: Column, seed: Column) -> tuple[Column, Column]:
    """Options in an order given by each one's hash with the seed, and their original indices: uniform over
    permutations and made by built-in functions alone."""
    keyed = F.array_sort(F.transform(options, lambda o, i: F.struct(F.md5(F.concat_ws("|", seed.cast("string"), o)).alias("k"), i.alias("i"), o.alias("o"))))
    return F.transform(keyed, lambda x: x["o"]), F.transform(keyed, lambda x: x["i"].cast("int"))
