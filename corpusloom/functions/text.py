"""Text functions with the semantics of Python strings, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.isspace() holds for.
PY_WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]"
# The markers of a refusal.
REFUSAL_MARKERS = ("抱歉", "不好意思", "无法回答", "超出", "服务范围", "咨询")
FULL_WIDTH_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def strip(c: Column) -> Column:
    """str.strip(): Unicode blanks go at both ends."""
    return F.regexp_replace(c, f"^{PY_WS}+|{PY_WS}+$", "")


def normalize(c: Column, *, fold_width: bool = False) -> Column:
    """All blanks removed; with fold_width, the full-width question mark becomes an ASCII one."""
    out = F.regexp_replace(c, PY_WS, "")
    return F.translate(out, "？", "?") if fold_width else out


def contains_any(text: Column, keywords: Column) -> Column:
    """Whether any keyword is a substring: an empty list never, an empty string always."""
    return F.exists(keywords, lambda k: F.contains(text, k))


def is_refusal(text: Column, markers: tuple[str, ...] = REFUSAL_MARKERS) -> Column:
    return contains_any(text, F.array(*map(F.lit, markers)))


def last_integer(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0)), F.lit(-1)).try_cast("bigint")


def first_integer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).try_cast("bigint")


def has_whole_number(text: Column, number: Column) -> Column:
    """Whether number stands in text without a digit beside it."""
    return F.rlike(text, F.concat(F.lit(r"(?<!\d)"), number, F.lit(r"(?!\d)")))


def has_digit(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{Nd}"))


def fill(template: Column, name: str, value: Column) -> Column:
    """template with {name} replaced."""
    return F.replace(template, F.lit("{" + name + "}"), value)


def json_items(text: Column, schema: str = "array<struct<question:string,answer:string>>") -> Column:
    """The JSON list between the first [ and the last ] of text; null where there is none or it doesn't parse."""
    return F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), schema)


def base_name(path: Column, *, stem: bool = False) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "") if stem else name


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def folder_label(path: Column, prefix: str = "") -> Column:
    """prefix and the last folder's name of a path; slashes and backslashes at its end don't count."""
    return F.concat(F.lit(prefix), F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1))


def fixed(x: Column, digits: int = 1) -> Column:
    """x with that many decimals: its exact binary value is rounded, half to even, as C and Python do (`format_string` rounds the shortest decimal half up); null for null."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def points(x: Column, digits: int = 1) -> Column:
    """A difference of shares in points, with its sign."""
    out = fixed(x * 100, digits)
    return F.when(F.startswith(out, F.lit("-")), out).otherwise(F.concat(F.lit("+"), out))


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def hash_order(seed: str, *keys: Column) -> Column:
    """A shuffled but reproducible order: the MD5 of seed and a unique key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)))


def hash_int(seed: str, *keys: Column) -> Column:
    """A reproducible non-negative integer below 2**32."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint")


def hash_long(seed: str, *keys: Column) -> Column:
    """A reproducible non-negative integer below 2**60."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 15), 16, 10).cast("bigint")
