"""String helpers of the request and configuration side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop_suffix(value: Column, suffix: str) -> Column:
    """``value`` without one trailing ``suffix``."""
    return F.when(value.endswith(suffix), F.substring(value, F.lit(1), F.char_length(value) - len(suffix))).otherwise(value)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def split_list(value: Column, separator: str = ",") -> Column:
    """Trimmed parts without blank ones."""
    parts = F.transform(F.split(value, rf"\Q{separator}\E"), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", ""))
    return F.filter(parts, lambda x: x != "")


def parse_keys(value: Column) -> Column:
    """``key:scope|scope`` entries as an array of (key, scopes)."""
    entry = lambda e: F.struct(
        F.substring_index(e, ":", 1).alias("key"),
        F.when(F.instr(e, ":") > 0, split_list(F.substr(e, F.instr(e, ":") + 1), "|")).otherwise(F.array().cast("array<string>")).alias("scopes"),
    )
    return F.transform(split_list(value), entry)


def keys_problem(value: Column) -> Column:
    """What is wrong with a key list: an empty key, or one listed twice. The keys aren't named."""
    keys = F.transform(parse_keys(value), lambda e: e["key"])
    return F.when(F.exists(keys, lambda k: k == ""), F.lit("empty key")).when(F.size(F.array_distinct(keys)) < F.size(keys), F.lit("duplicate key"))


def media_type(content_type: Column) -> Column:
    """The type without its parameters, in lower case."""
    return F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))


#: What a quoted text shows as it is: letters, marks, numbers, punctuation, symbols and the space.
_PRINTABLE = r"[\p{L}\p{M}\p{N}\p{P}\p{S} ]"
_SHORT = {7: "a", 8: "b", 12: "f", 10: "n", 13: "r", 9: "t", 11: "v"}


def quoted(value: Column) -> Column:
    """A text in double quotes; backslashes, quotes and what cannot be printed are escaped."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def shown(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(c.rlike(rf"\A{_PRINTABLE}\z"), c)
        for number, letter in _SHORT.items():
            out = out.when(code == number, "\\" + letter)
        hex_ = lambda mark, n: F.concat(F.lit("\\" + mark), F.lpad(F.lower(F.hex(code)), n, "0"))
        return out.when(code < 0x80, hex_("x", 2)).when(code < 0x10000, hex_("u", 4)).otherwise(hex_("U", 8))

    odd = value.rlike(r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]")
    escaped = F.array_join(F.transform(F.split(plain, ""), shown), "")
    return F.concat(F.lit('"'), F.when(odd, escaped).otherwise(plain), F.lit('"'))


def time_ordered_uuid(at: Column) -> Column:
    """A version 7 UUID: milliseconds of ``at`` in front, the rest random."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    rest = F.uuid()
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(rest, 16, 3), F.substring(rest, 19, 18))
