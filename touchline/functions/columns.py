"""Column helpers: missing numbers, clipping, logits, names, dates, seasons."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """``x`` as a double, null where it is NaN or infinite: the one notion of a missing number."""
    x = col(x).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(x: Column | str) -> Column:
    """A text as a finite double, null where it is none."""
    return finite(col(x).try_cast("double"))


def clip(x: Column | str, low: float, high: float) -> Column:
    """``x`` within bounds; null stays null."""
    x = col(x)
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def clip01(x: Column | str) -> Column:
    return clip(x, 0.0, 1.0)


def safe_logit(p: Column | str, eps: float = 1e-12) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (1.0 - q))


def sigmoid(z: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-col(z)))


def is_close(a: Column | str, b: Column | str, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """|a - b| <= atol + rtol * |b|; false where either is missing."""
    a, b = finite(a), finite(b)
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def first_max(*values: Column | str) -> Column:
    """Index of the greatest of ``values``; of equal ones the first."""
    cols = [col(v) for v in values]
    out = F.lit(len(cols) - 1)
    for k in reversed(range(len(cols) - 1)):
        out = F.when(all_of(*[cols[k] >= c for c in cols[k + 1 :]]), F.lit(k)).otherwise(out)
    return out


def squeeze(x: Column | str) -> Column:
    """Each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


@cache
def _bare_letters() -> dict[str, str]:
    """Letters that are another one with marks, by Unicode's decompositions, such as an s with a caron; not those with a stroke,
    which have none."""
    found = {}
    for c in map(chr, range(0xC0, 0x2000)):
        bare = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(bare) == 1 and bare[0] != c:
            found[c] = bare[0]
    return found


def without_marks(x: Column | str) -> Column:
    """Letters without their marks, whether the marks are part of them or follow them."""
    letters = _bare_letters()
    return F.translate(F.regexp_replace(col(x), r"\p{Mn}+", ""), "".join(letters), "".join(letters.values()))


#: Words that say what kind of club a name stands for.
CLUB_WORDS = ("fc", "cf", "afc", "ssc", "ac", "as", "sc", "sv", "vfb", "borussia")


def join_key(name: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """A club's name for joining: lower case, & as and, without club words and punctuation, by its alias where it
    has one; empty for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "&", "and")
    bare = F.regexp_replace(F.regexp_replace(plain, r"\b(" + "|".join(CLUB_WORDS) + r")\b", " "), r"[^a-z0-9]+", " ")
    return alias_of(squeeze(bare), aliases or {})


def alias_of(name: Column | str, aliases: dict[str, str]) -> Column:
    """``name`` by a small table of aliases; itself where it has none."""
    if not aliases:
        return col(name)
    table = F.create_map(*[F.lit(x) for item in aliases.items() for x in item])
    return F.coalesce(F.try_element_at(table, col(name)), col(name))


def parse_date(text: Column | str) -> Column:
    """A date written dd/MM/yy, dd/MM/yyyy, ISO or d-M-yyyy; null where it is none of these."""
    t = F.trim(col(text))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)).cast("date") for p in ("dd/MM/yy", "dd/MM/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "d/M/yyyy", "d-M-yyyy")])


def kickoff_hour(text: Column | str) -> Column:
    """Hour of "20:45" or "20"; 15 where there is none, within 0 to 23."""
    hour = F.regexp_extract(F.coalesce(col(text), F.lit("")), r"^\s*(\d{1,2})", 1).try_cast("int")
    return clip(F.coalesce(hour, F.lit(15)), 0, 23).cast("int")


def season_start(date: Column | str, first_month: int) -> Column:
    """Year in which the season of ``date`` began, if seasons begin in ``first_month``."""
    d = col(date)
    return F.year(d) - F.when(F.month(d) < first_month, 1).otherwise(0)


def season_label(date: Column | str, first_month: int = 8) -> Column:
    year = season_start(date, first_month)
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


#: Texts that say yes or no.
_YES = ("1", "true", "yes", "y", "available", "confirmed")
_NO = ("0", "false", "no", "n", "missing", "unavailable")


def flag(text: Column | str) -> Column:
    """A flag given as text, as 1 or 0; 0 where it is missing or another text."""
    return F.coalesce(F.lower(F.trim(col(text))).isin(*_YES).cast("double"), F.lit(0.0))


def flag_number(x: Column | str) -> Column:
    """A flag given as a number, within 0 and 1; 0 where it is missing."""
    return F.coalesce(clip01(finite(x)), F.lit(0.0))


def truthy(text: Column | str) -> Column:
    """Whether a text says yes; null where it says neither yes nor no."""
    t = F.lower(F.trim(col(text)))
    return F.when(t.isin(*_YES), True).when(t.isin(*_NO), False)


def bucket(x: Column | str, cuts: list[float]) -> Column:
    """Label of the interval (a, b] of ``cuts`` that holds ``x``; the first one also holds its lower end."""
    x = col(x)
    out = F.lit(None).cast("string")
    for k in reversed(range(len(cuts) - 1)):
        low, high = cuts[k], cuts[k + 1]
        inside = (x <= high) & ((x >= low) if k == 0 else (x > low))
        out = F.when(inside, F.lit(f"{low:g}-{high:g}")).otherwise(out)
    return out
