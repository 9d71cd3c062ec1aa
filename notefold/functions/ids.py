"""Canonical forms of ids, paths, splits and terms as column expressions, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c\u00a0"
_SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def bound(c: Column, f) -> Column:
    """``f`` of ``c``, which is worked out once however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space at the ends; null when nothing is left."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def clip_id(c: Column) -> Column:
    """Lower case, no blanks around, no directory before and no ``.mid``/``.json``/``.wav`` after; null when blank."""
    name = F.element_at(F.split(F.replace(F.lower(stripped(c)), F.lit("\\"), F.lit("/")), "/"), -1)
    return stripped(F.regexp_replace(stripped(name), r"\.(mid|json|wav)$", ""))


def path_key(c: Column) -> Column:
    """Lower case, ``/`` for backslashes and repeated slashes, no leading ``/`` or ``./``; null when blank."""
    p = F.regexp_replace(F.replace(F.lower(stripped(c)), F.lit("\\"), F.lit("/")), "/+", "/")
    return stripped(F.regexp_replace(p, r"^(\./|/)+", ""))


def split_name(c: Column, of_id: Column | None = None) -> Column:
    """Lower-case split; where it is missing, the part of the id before its first ``_``."""
    s = F.lower(stripped(c))
    return s if of_id is None else F.coalesce(s, stripped(F.split_part(of_id, F.lit("_"), F.lit(1))))


def plain_number(text: Column) -> Column:
    """A text that reads as a decimal number, without needless zeros and sign; any other text as it is.

    Works on the digits, so numbers of any length keep them all."""
    t = F.regexp_replace(text, r"^\+?(-?)0*([0-9]*)(?:\.([0-9]*?)0*)?$", "$1$2.$3")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\.$", ""), r"^(-?)(\.|$)", "$10$2"), "^-0$", "0")
    return F.when(text.rlike(_NUMBER), t).otherwise(text)


def sql_stripped(x: str) -> str:
    return f"nullif(trim({x}, {_SQL_BLANKS}), '')"


def sql_clip_id(x: str) -> str:
    name = f"regexp_replace({sql_stripped(f'lower(replace({x}, chr(92), chr(47)))')}, '^.*/', '')"
    return sql_stripped(f"regexp_replace({sql_stripped(name)}, '\\.(mid|json|wav)$', '')")


def sql_path_key(x: str) -> str:
    p = f"regexp_replace({sql_stripped(f'lower(replace({x}, chr(92), chr(47)))')}, '/+', '/', 'g')"
    return sql_stripped(f"regexp_replace({p}, '^(\\./|/)+', '')")


def sql_split_name(x: str, of_id: str) -> str:
    return f"coalesce(lower({sql_stripped(x)}), {sql_stripped(f'''split_part({of_id}, '_', 1)''')})"


def sql_plain_number(x: str) -> str:
    t = f"regexp_replace({x}, '^\\+?(-?)0*([0-9]*)(?:\\.([0-9]*?)0*)?$', '\\1\\2.\\3')"
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, '\\.$', ''), '^(-?)(\\.|$)', '\\10\\2'), '^-0$', '0')"
    return f"case when regexp_matches({x}, '{_NUMBER}') then {t} else {x} end"
