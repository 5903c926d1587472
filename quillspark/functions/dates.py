"""Multi-layout date parsing.

A cell is reduced to a signature of token kinds: ``E`` eight digits, ``Y`` four
digits, ``N`` one or two digits, ``M`` a month name, ``P`` am or pm, and its
separators as they stand; a weekday before and an ordinal ending are left out.
One grammar splits the signature into a date and a time of day, and the date's
signature gives the order of its numbers.  The numbers are put together by
``try_make_timestamp_ntz``, which answers NULL for an impossible date (a parser
would throw inside the JVM for every cell that is not a date).

Month-first beats day-first for ambiguous values, as with ``dateutil``'s default,
and both beat year-first where all numbers are short.  Two-digit years are 1969 to
2068.  A missing day is the first.  Digits beyond microseconds are cut off.  Results
are wall-clock times: a zone behind the time of day is dropped.

A value's layout is a number made of its date kind and time kind.  The same kinds
as DuckDB formats serve the SQL oracle.
"""

from __future__ import annotations

import functools
import re

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date kinds: signature, order of the numbers, DuckDB formats.  Kinds of one signature are tried in this order.
DATE_KINDS = [
    ("Y-N-N", "ymd", ["%Y-%m-%d"]), ("N/N/Y", "mdy", ["%m/%d/%Y"]), ("N/N/Y", "dmy", ["%d/%m/%Y"]), ("N-N-Y", "mdy", ["%m-%d-%Y"]),
    ("N-N-Y", "dmy", ["%d-%m-%Y"]), ("Y/N/N", "ymd", ["%Y/%m/%d"]), ("N M Y", "dmy", ["%d %b %Y", "%d %B %Y"]),
    ("M N, Y", "mdy", ["%b %d, %Y", "%B %d, %Y"]),
    ("N.N.Y", "mdy", ["%m.%d.%Y"]), ("N.N.Y", "dmy", ["%d.%m.%Y"]), ("Y.N.N", "ymd", ["%Y.%m.%d"]),
    ("N/N/N", "mdy", ["%m/%d/%y"]), ("N/N/N", "dmy", ["%d/%m/%y"]), ("N/N/N", "ymd", ["%y/%m/%d"]),
    ("N-N-N", "mdy", ["%m-%d-%y"]), ("N-N-N", "dmy", ["%d-%m-%y"]), ("N-N-N", "ymd", ["%y-%m-%d"]),
    ("N.N.N", "mdy", ["%m.%d.%y"]), ("N.N.N", "dmy", ["%d.%m.%y"]), ("N.N.N", "ymd", ["%y.%m.%d"]),
    ("M N Y", "mdy", ["%b %d %Y", "%B %d %Y"]), ("N-M-Y", "dmy", ["%d-%b-%Y", "%d-%B-%Y"]), ("NMY", "dmy", ["%d%b%Y", "%d%B%Y"]),
    ("N M N", "dmy", ["%d %b %y", "%d %B %y"]), ("N-M-N", "dmy", ["%d-%b-%y", "%d-%B-%y"]), ("Y-M-N", "ymd", ["%Y-%b-%d", "%Y-%B-%d"]),
    ("E", "ymd", ["%Y%m%d"]), ("Y-N", "ym", ["%Y-%m"]), ("Y/N", "ym", ["%Y/%m"]), ("N/Y", "my", ["%m/%Y"]), ("N-Y", "my", ["%m-%Y"]),
    ("M Y", "my", ["%b %Y", "%B %Y"]), ("M-Y", "my", ["%b-%Y", "%B-%Y"])]

# Time kinds after the date (none first): separator, clock signature (fractions count as seconds), am or pm, DuckDB formats.
TIME_KINDS = [("", "", False, []), (" ", "N:N", False, ["%H:%M"]), (" ", "N:N:N", False, ["%H:%M:%S.%f", "%H:%M:%S"]),
              ("t", "N:N", False, ["%H:%M", "%H:%M:%S.%f", "%H:%M:%S"]),
              (" ", "N:N", True, ["%I:%M %p"]), (" ", "N:N:N", True, ["%I:%M:%S.%f %p", "%I:%M:%S %p"]), (" ", "N", True, ["%I %p"])]
#: Time kind of fourteen digits in a row.
COMPACT = len(TIME_KINDS)

# English month names (in full or by their first three letters; also "sept") and weekdays.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def _names(words: list[str], extra: str = "") -> str:
    return "(?:" + "|".join(f"{w[:3]}(?:{w[3:]})?" if w[3:] else w for w in words) + extra + ")(?![a-z])"


_MONTH = _names(MONTHS, "|sept")
_WEEKDAY = "^(?:" + _names(WEEKDAYS) + r"|tues|thurs?)[.,]? +"
_HALF = r"(?<![a-z])([ap])\.?m\.?(?![a-z])"
_ORDINAL = r"(?<=9)(?:st|nd|rd|th)(?![a-z])"
_ZONE = r"(?: ?(?:z|utc|gmt|[+-](?:N:?N|Y)))?"
#: Date piece and clock of a signature.
GRAMMAR = ("^(" + "|".join(re.escape(s).replace(r"\ ", " ") for s in sorted({s for s, _, _ in DATE_KINDS} | {"EYN"}, key=len, reverse=True))
           + r")(?:(?:t| |, )(N(?::N(?::N(?:\.[EYN]+)?)?)?) ?P?" + _ZONE + ")?$")
#: What a text must look like to be read at all.
ANY_DATE = r"^(?=[^0-9]*[0-9])[0-9A-Za-z][0-9A-Za-z ,./:+-]{3,39}$"


# The grammar on the text itself, before tokens are marked: looser than it (ordinal endings may stand behind any digit),
# so that a cell without a date is told by one pattern.
_DIGIT = "(?:[0-9](?:st|nd|rd|th)?)"
_LOOSE = {"E": _DIGIT + "{8}", "Y": _DIGIT + "{4}", "N": _DIGIT + "{1,2}", "M": "(?:" + _MONTH.removesuffix("(?![a-z])") + ")", " ": " "}


def _loose(piece: str) -> str:
    return "".join(_LOOSE.get(ch) or re.escape(ch) for ch in piece)


def _loose_dates() -> str:
    """All date pieces, those with the same first token together: a cell is tried once per first token."""
    pieces = sorted({s for s, _, _ in DATE_KINDS} | {"EYN"})
    return "|".join(_loose(first) + "(?:" + "|".join(_loose(p[1:]) for p in pieces if p[0] == first) + ")"
                    for first in sorted({p[0] for p in pieces}))


CANDIDATE = ("(?i)^(?:" + _WEEKDAY.removeprefix("^") + ")?(?:" + _loose_dates() + ")(?:(?:t| |, )" + _loose("N") + "(?::" + _loose("N")
             + "(?::" + _loose("N") + r"(?:\." + _DIGIT + "+)?)?)?"
             + r" ?(?:[ap]\.?m\.?)?(?: ?(?:z|utc|gmt|[+-]" + _DIGIT + "{1,2}:?" + _DIGIT + "{1,2}))?)?$")
#: Whole dates of fixed places: pattern, where year and the two other numbers stand, the orders of these.
FIXED = [(r"^[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}\z", 5, (1, 6, 9), "Y{0}N{0}N", ["ymd"]),
         (r"^[0-9]{2}([-/.])[0-9]{2}\1[0-9]{4}\z", 3, (7, 1, 4), "N{0}N{0}Y", ["mdy", "dmy"])]


def _is_native(dtype) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _let(value: Column, of) -> Column:
    """``of`` a value that is computed once."""
    return F.transform(F.array(value), of)[0]


def signature(low: Column) -> Column:
    """Token kinds of a lower-case text."""
    digits = F.translate(low, "0123456789", "9" * 10)
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        digits, _WEEKDAY, ""), _MONTH, "M"), _HALF, "P"), _ORDINAL, "")
    out = F.when(digits.rlike("[a-z]"), words).otherwise(digits)
    for run, mark in (("9" * 8, "E"), ("9" * 4, "Y"), ("99", "N"), ("9", "N")):
        out = F.replace(out, F.lit(run), F.lit(mark))
    return out


def _month(low: Column) -> Column:
    number = F.create_map(*[x for k, m in enumerate(MONTHS) for x in (F.lit(m[:3]), F.lit(k + 1))])
    return number[F.substring(F.regexp_extract(low, "(?<![a-z])(" + _MONTH + ")", 1), 1, 3)]


def _read(low: Column, sig: Column) -> Column:
    """Struct of a cell's date piece, clock, numbers, month name, and whether its time stands behind a T or is am or pm."""
    return F.struct(
        F.regexp_extract(sig, GRAMMAR, 1).alias("date"), F.regexp_extract(sig, GRAMMAR, 2).alias("clock"), sig.alias("sig"),
        F.regexp_extract_all(low, F.lit("([0-9]+)"), 1).alias("n"), F.when(F.contains(sig, F.lit("M")), _month(low)).alias("month"),
        F.when(F.contains(sig, F.lit("P")), F.regexp_extract(low, r"[0-9] ?([ap])\.?m\.?(?![a-z])", 1)).alias("half"))


def _number(p: Column, k) -> Column:
    return F.get(p["n"], F.lit(k) if isinstance(k, int) else k).cast("int")


# Kinds of token that a date piece is made of (its signature without separators), and the orders of its numbers.
ORDERS: dict[str, list[str]] = {}
for _piece, _order, _ in DATE_KINDS:
    _known = ORDERS.setdefault(re.sub("[^EYNM]", "", _piece), [])
    if _order not in _known:
        _known.append(_order)


def _day_parts(p: Column, tokens: str, order: str) -> tuple[Column, Column, Column, int]:
    """Year, month and day of one order of the numbers, and how many numbers they take."""
    if tokens == "E":
        one = F.get(p["n"], F.lit(0))
        return tuple(F.substring(one, a, b).cast("int") for a, b in ((1, 4), (5, 2), (7, 2))) + (1,)
    found, k = {}, 0
    for token, part in zip(tokens, order):
        if token == "M":
            found[part] = p["month"]
            continue
        value = _number(p, k)
        if part == "y" and token == "N":  # two digits and no more
            value = F.when(F.length(F.get(p["n"], F.lit(k))) == 2, value + F.when(value <= 68, 2000).otherwise(1900))
        found[part], k = value, k + 1
    return found["y"], found["m"], found.get("d", F.lit(1)), k


def _days(p: Column) -> Column:
    """Struct of the dates that a cell's numbers may mean, in order (kind, y, m, d), and the place of the first number of its clock."""
    first = F.create_map(*[x for piece in dict.fromkeys(s for s, _, _ in DATE_KINDS)
                           for x in (F.lit(piece), F.lit([s for s, _, _ in DATE_KINDS].index(piece)))])
    kind, tokens, out = first[F.when(p["date"] == "EYN", "E").otherwise(p["date"])], F.translate(p["date"], "-/., ", ""), None
    for shape, orders in [*ORDERS.items(), ("EYN", ORDERS["E"])]:
        parts = [(k, *_day_parts(p, "E" if shape == "EYN" else shape, order)) for k, order in enumerate(orders)]
        made = F.struct(F.array(*[F.struct((kind + k).alias("kind"), y.alias("y"), m.alias("m"), d.alias("d")) for k, y, m, d, _ in parts]).alias("days"),
                        F.lit(parts[0][-1]).alias("used"))
        out = F.when(tokens == shape, made) if out is None else out.when(tokens == shape, made)
    return out


def _clock(p: Column, start: Column) -> Column:
    """Struct of hour, minute, second and time kind, from the number at ``start`` on; a null part where there is no such time."""
    one, hour, fraction = F.get(p["n"], F.lit(0)), _number(p, start), F.get(p["n"], start + 3)
    clock, compact = p["clock"], p["date"] == "EYN"
    minute = F.when(F.contains(clock, F.lit(":")), _number(p, start + 1)).otherwise(0)
    seconds, dotted = clock.startswith("N:N:N"), F.contains(clock, F.lit("."))
    micros = F.when(dotted & (F.length(fraction) <= 9), F.rpad(F.substring(fraction, 1, 6), 6, "0")).when(~dotted, "0")
    second = F.when(seconds, _number(p, start + 2) + (micros.cast("decimal(16,6)") / 1000000)).otherwise(0).cast("decimal(16,6)")
    half = p["half"]
    of_day = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    kind = (F.when(clock == "", 0).when(half.isNotNull(), F.when(clock == "N", 6).when(seconds, 5).otherwise(4))
            .when(clock != "N", F.when(F.contains(p["sig"], F.lit("t")), 3).when(seconds, 2).otherwise(1)))
    digits = lambda at: F.substring(one, at, 2).cast("int")
    return (F.when(compact & (F.length(one) == 14), F.struct(digits(9).alias("h"), digits(11).alias("mi"), digits(13).cast("decimal(16,6)").alias("s"),
                                                            F.lit(COMPACT).alias("kind")))
            .when(~compact & (clock == ""), F.struct(F.lit(0).alias("h"), F.lit(0).alias("mi"), F.lit(0).cast("decimal(16,6)").alias("s"), F.lit(0).alias("kind")))
            .when(~compact, F.struct(of_day.alias("h"), minute.alias("mi"), second.alias("s"), kind.alias("kind"))))


def _first_made(p: Column) -> Column:
    """Struct of the first date that its numbers make (at) and its layout number (NULL where none does)."""

    def with_clock(found, c):
        def made(day):
            fits = (day["y"].between(1, 9999) & day["m"].between(1, 12) & day["d"].between(1, 31) & (c["h"] < 24) & (c["mi"] < 60)
                    & (c["s"] < 60) & c["kind"].isNotNull())
            layout = F.when((day["kind"] < 8) & (c["kind"] < 4), 4 * day["kind"] + c["kind"]).otherwise(32 + 8 * day["kind"] + c["kind"])
            at = F.when(fits, F.try_make_timestamp_ntz(day["y"], day["m"], day["d"], c["h"], c["mi"], c["s"]))
            return F.struct(at.alias("at"), layout.alias("layout"))
        return F.get(F.filter(F.transform(found["days"], made), lambda x: x["at"].isNotNull()), F.lit(0))

    return _let(_days(p), lambda found: _let(_clock(p, found["used"]), lambda c: with_clock(found, c)))


def _fixed(s: Column, sign_at: int, places: tuple[int, int, int], piece: str, orders: list[str]) -> tuple[Column, Column]:
    """Date and layout number of a text that matches a pattern of ``FIXED``: plain substrings, without tokens."""
    year, *others = (F.substring(s, at, 4 if k == 0 else 2).try_cast("int") for k, at in enumerate(places))
    zero, made = F.lit(0), []
    for order in orders:
        month, day = others if order in ("ymd", "mdy") else reversed(others)
        fits = (year >= 1) & month.between(1, 12) & day.between(1, 31)
        made.append(F.when(fits, F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("decimal(16,6)"))))
    sign, layout = F.substring(s, sign_at, 1), None
    for at, order in zip(made, orders):
        numbers = F.create_map(*[x for c in "-/." for x in (F.lit(c), F.lit(layout_number(
            next(k for k, (p, o, _) in enumerate(DATE_KINDS) if (p, o) == (piece.format(c), order)), 0)))])
        layout = F.when(at.isNotNull(), numbers[sign]) if layout is None else layout.when(at.isNotNull(), numbers[sign])
    return F.coalesce(*made), layout


def _parsed(s: Column) -> tuple[Column, Column]:
    """Date and layout number of a text: fixed places first, then the grammar where the text may hold a date at all."""
    general = _let(F.lower(s), lambda low: _let(signature(low), lambda sig: _let(_read(low, sig), _first_made)))
    branches = [(s.rlike(pattern), *_fixed(s, *rest)) for pattern, *rest in FIXED]
    branches.append((s.rlike(ANY_DATE) & s.rlike(CANDIDATE), general["at"], general["layout"]))
    out = [functools.reduce(lambda seen, b: seen.when(b[0], b[k]), branches[1:], F.when(branches[0][0], branches[0][k])) for k in (1, 2)]
    return out[0], out[1]


@functools.lru_cache(maxsize=256)
def _parsed_column(name: str, gateway: int) -> tuple[Column, Column]:
    """The expressions of a named column, built once: they have some thousand nodes."""
    return _parsed(F.col(name).cast("string"))


def _parsed_of(c: Column | str) -> tuple[Column, Column]:
    return _parsed_column(c, id(SparkContext._gateway)) if isinstance(c, str) else _parsed(c.cast("string"))


def parse_date(c: Column | str, dtype=None) -> Column:
    """Wall-clock ``timestamp_ntz`` of a text cell by the first layout that fits; NULL when none does.

    Results are zone-free (naive, like pandas), whatever the session time zone.
    """
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and _is_native(dtype):
        return col.cast("timestamp_ntz")
    return _parsed_of(c)[0]


def epoch_micros(c: Column | str) -> Column:
    """Wall-clock microseconds since 1970-01-01 (zone-free)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", _epoch(), col.cast("timestamp_ntz"))


def from_epoch_micros(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add("MICROSECOND", col, _epoch())


def layout_number(kind: int, time: int) -> int:
    """Number of a date kind and a time kind: the eight oldest date kinds with the four oldest time kinds come first."""
    return 4 * kind + time if kind < 8 and time < 4 else 32 + 8 * kind + time


def format_index(c: Column | str, dtype=None) -> Column:
    """Number of the first layout that parses the value (NULL if none)."""
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and _is_native(dtype):
        return F.when(col.isNotNull(), F.lit(0))
    return _parsed_of(c)[1]


# ---------------------------------------------------------------- the same for DuckDB

_SQL_CLOCK = r"(?i)(?:T| |, )(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?[ap]\.?m\.?)?|\d{1,2} ?[ap]\.?m\.?)(?: ?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?$"
_SQL_WEEKDAY = "(?i)^(?:" + "|".join(f"{w}|{w[:3]}" for w in WEEKDAYS) + ")[.,]? +"


class _DuckDB:
    """Pieces of a cell in SQL: date text, clock text, and the formats that read them."""

    def __init__(self, col: str):
        self.col = col
        plain = f"regexp_replace({col}, '{_SQL_WEEKDAY}', '')"
        self.clock = f"regexp_extract({plain}, '{_SQL_CLOCK}', 1)"
        self.date = f"regexp_replace({plain}, '{_SQL_CLOCK}', '')"
        short = rf"regexp_matches({self.date}, '[-/. ]\d{{1,2}}$') AND NOT regexp_matches({self.date}, '\d{{3}}')"
        self.short = f"({short})"
        self.compact = rf"CASE WHEN regexp_matches({col}, '^\d{{14}}$') THEN try_strptime({col}, '%Y%m%d%H%M%S') END"

    def day(self, k: int) -> str:
        piece, _, formats = DATE_KINDS[k]
        two = any("%y" in f for f in formats)
        tries = ", ".join(f"try_strptime({self.date}, '{f}')" for f in formats)
        digits = r"^\d{8}$" if piece == "E" else r"[^0-9]"
        return f"CASE WHEN {'' if two else 'NOT '}{self.short} AND regexp_matches({self.date}, '{digits}') THEN coalesce({tries}) END"

    def time(self) -> str:
        tidy = f"regexp_replace(regexp_replace(upper(replace({self.clock}, '.M', 'M')), '(\\.\\d{{6}})\\d+', '\\1'), ' ?([AP])\\.?M\\.?$', ' \\1M')"
        formats = dict.fromkeys(f for _, _, _, fs in TIME_KINDS for f in fs)
        tries = ", ".join(f"try_strptime('2000-01-01 ' || {tidy}, '%Y-%m-%d {f}')" for f in formats)
        return f"CASE WHEN {self.clock} = '' THEN INTERVAL 0 SECOND ELSE coalesce({tries}) - TIMESTAMP '2000-01-01' END"

    def time_kind(self) -> str:
        c = self.clock
        half, seconds = f"regexp_matches({c}, '(?i)[ap]')", rf"regexp_matches({c}, '^\d+:\d+:\d+')"
        return (f"CASE WHEN {c} = '' THEN 0 WHEN {half} THEN (CASE WHEN NOT contains({c}, ':') THEN 6 WHEN {seconds} THEN 5 ELSE 4 END) "
                rf"WHEN regexp_matches({self.col}, '\dT\d') THEN 3 WHEN {seconds} THEN 2 ELSE 1 END")


def duckdb_parse(col_sql: str) -> str:
    d = _DuckDB(col_sql)
    days = ", ".join(d.day(k) for k in range(len(DATE_KINDS)))
    return f"coalesce({d.compact}, coalesce({days}) + ({d.time()}))"


def duckdb_format_index(col_sql: str) -> str:
    d = _DuckDB(col_sql)
    compact = layout_number([s for s, _, _ in DATE_KINDS].index("E"), COMPACT)
    kinds = " ".join(f"WHEN {d.day(k)} IS NOT NULL THEN {k}" for k in range(len(DATE_KINDS)))
    number = f"(CASE {kinds} END)"
    time = f"({d.time_kind()})"
    return (f"(CASE WHEN {d.compact} IS NOT NULL THEN {compact} WHEN ({d.time()}) IS NULL THEN NULL "
            f"WHEN {number} < 8 AND {time} < 4 THEN 4 * {number} + {time} ELSE 32 + 8 * {number} + {time} END)")
