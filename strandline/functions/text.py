"""Name and key normalisation, blocking keys and string similarity."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Titles and short given names.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir")
NICKNAMES = {"sam": "samuel", "sammy": "samuel", "soham": "samuel", "mike": "michael", "mikey": "michael", "bob": "robert", "rob": "robert", "bobby": "robert", "will": "william", "bill": "william", "billy": "william", "tom": "thomas", "tommy": "thomas", "chris": "christopher", "kate": "katherine", "katie": "katherine", "dave": "david", "danny": "daniel", "nick": "nicholas", "steve": "stephen", "jim": "james", "jimmy": "james"}
EMAIL = r"^[\w.+-]+@[\w-]+\.[\w.-]+$"


def _folds() -> tuple[str, str]:
    """Characters of one code unit whose compatibility form has exactly one ASCII character, and those characters."""
    pairs = [(chr(c), a) for c in range(0x80, 0xFFFF) if not 0xD800 <= c < 0xE000 and len(a := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folds()


def strip_accents(c: Column) -> Column:
    """ASCII form: accents dropped, then whatever has no ASCII base (compatibility forms of several letters too)."""
    return F.regexp_replace(F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, _FROM, _TO)).otherwise(c), r"[^\x00-\x7F]", "")


def norm(c: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(strip_accents(F.coalesce(c, F.lit(""))))), r"^@+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[._\-]+", " "), r"[^a-z0-9 ]+", " "), r" +", " "))


def slugify(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9]+", "-")), r"^-+|-+$", "")
    return F.when(t == "", "unknown").otherwise(t)


def is_email(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike(EMAIL)


def email_local(c: Column) -> Column:
    return F.lower(F.substring_index(F.coalesce(c, F.lit("")), "@", 1))


def is_handle(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t != "") & ~t.contains(" ") & ~is_email(c)


def tokens(c: Column) -> Column:
    """Normalised tokens without titles, short names made full."""
    nick = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
    words = F.filter(F.split(norm(c), " "), lambda t: (t != "") & ~t.isin(*TITLES))
    return F.transform(words, lambda t: F.coalesce(nick[t], t))


def surface_tokens(c: Column) -> Column:
    return tokens(F.when(is_email(c), email_local(c)).otherwise(c))


def blocking_keys(surface: Column, email: Column) -> Column:
    """Keys that put plausible matches into one bucket."""
    t, e = surface_tokens(surface), surface_tokens(email)
    has = F.coalesce(email, F.lit("")) != ""
    last = F.coalesce(F.element_at(F.when(F.size(t) > 0, t), -1), F.lit(""))
    none = F.array().cast("array<string>")
    parts = [
        F.when(has, F.array(F.concat(F.lit("email:"), F.lower(email)))).otherwise(none),
        F.when(has, F.transform(F.filter(e, lambda x: F.length(x) > 2), lambda x: F.concat(F.lit("tok:"), x))).otherwise(none),
        F.when(F.size(t) > 0, F.array(F.concat(F.lit("full:"), F.array_join(t, " ")))).otherwise(none),
        F.when(F.length(last) > 2, F.array(F.concat(F.lit("last:"), last), F.concat(F.lit("lastpre:"), F.substring(last, 1, 4)), F.concat(F.lit("li:"), F.substring(t[0], 1, 1), last))).otherwise(none),
        F.transform(F.filter(t, lambda x: F.length(x) > 2), lambda x: F.concat(F.lit("tok:"), x)),
    ]
    return F.array_distinct(F.concat(*parts))


# Words dropped from surfaces before matching.
DETERMINERS = ("the", "a", "an", "our", "this", "that", "these", "those", "my", "their", "its")


def strip_determiners(c: Column) -> Column:
    """Without determiners and 'piece of' fillers; the trimmed surface itself if nothing is left."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b(?:piece|part|portion|side|bit)\s+of\b", "")
    kept = F.array_join(F.filter(F.split(F.trim(t), r"\s+"), lambda w: ~norm(w).isin(*DETERMINERS)), " ")
    return F.when(F.trim(kept) != "", F.trim(kept)).otherwise(F.trim(F.coalesce(c, F.lit(""))))


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler similarity, prefix weight 0.1 up to 4 letters, boost only above Jaro 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, found = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                found.append(x)
                break
    m = len(found)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(found, (y for y, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _indel(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2.0 * _common(a, b) / (len(a) + len(b))


def token_set_ratio_of(a: str, b: str) -> float:
    """Best indel similarity (0-100) among shared tokens and shared tokens with either side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(r))))) for r in (x - y, y - x))
    if both and (left == both or right == both):
        return 100.0
    pairs = [(left, right)] + ([(both, left), (both, right)] if both else [])
    return 100.0 * max(_indel(p, q) for p, q in pairs)


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def norm_sql(x: str) -> str:
    """SQL of norm() for DuckDB."""
    ascii_ = f"regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')"
    t = f"regexp_replace(trim(lower({ascii_})), '^@+', '')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({t}, '[._\\-]+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def slug_sql(x: str) -> str:
    """SQL of slugify() for DuckDB."""
    ascii_ = f"regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')"
    return f"coalesce(nullif(regexp_replace(lower(regexp_replace({ascii_}, '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g'), ''), 'unknown')"


def tokens_sql(x: str) -> str:
    """SQL of tokens() for DuckDB."""
    nick = ", ".join(f"'{k}': '{v}'" for k, v in NICKNAMES.items())
    titles = ", ".join(f"'{t}'" for t in TITLES)
    return f"list_transform(list_filter(string_split({norm_sql(x)}, ' '), lambda t: t <> '' AND t NOT IN ({titles})), lambda t: coalesce(MAP {{{nick}}}[t], t))"


def norm_of(s: str | None) -> str:
    """norm() of one string, for driver-side planning."""
    t = unicodedata.normalize("NFKD", s or "").encode("ascii", "ignore").decode().lower().strip().lstrip("@")
    return re.sub(r" +", " ", re.sub(r"[^a-z0-9 ]+", " ", re.sub(r"[._\-]+", " ", t))).strip()


assert sys.maxunicode > 0xFFFF
