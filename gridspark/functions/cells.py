"""Column expressions on cells: kind tests, strict getters, coercions and typed targets.

A cell is a set of flat columns (kind, i, f, s, b, is_1904). ``Cell()`` names those of the row at hand,
``Cell("c")`` those of a struct column. All results are plain expressions that stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model as M
from .refs import let

MAX_LONG, MIN_LONG = (1 << 63) - 1, -(1 << 63)
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$"
_TIME = r"^\d{2}:\d{2}:\d{2}(\.\d+)?$"
_SPAN = r"^PT(\d+)H(\d+)M(\d+)(\.\d+)?S$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"


def saturated(f: Column) -> Column:
    """Truncation to a long; beyond its range the nearest long, NaN as 0."""
    inside = (f > float(MIN_LONG)) & (f < float(MAX_LONG)) & ~F.isnan(f)
    return F.when(F.isnan(f), 0).when(f >= float(MAX_LONG), MAX_LONG).when(f <= float(MIN_LONG), MIN_LONG).otherwise(F.when(inside, f).cast("long"))


def _shortest(f: Column) -> Column:
    """A double's text with as few digits as tell it apart; the JVM may write one or two too many."""

    def fewer(text: Column) -> Column:
        short = [F.regexp_replace(F.format_string(f"%.{n}e", f), r"0*e\+?", "E") for n in (14, 15, 16)]
        one = F.regexp_replace(F.format_string("%.0e", f), r"e", "E")
        return F.when((F.abs(f) < 1e-300) & (f != 0) & (one.try_cast("double") == f), one).when(F.length(F.regexp_replace(text, "E.*|[^0-9]", "")) < 16, text).otherwise(F.coalesce(*(F.when(x.try_cast("double") == f, x) for x in short), text))

    return let(f.cast("string"), fewer)


def float_text(f: Column) -> Column:
    """Decimal digits of a double without exponent and without a trailing ``.0``."""
    cut = lambda text: F.struct(*(F.regexp_extract(text, r"^(-?)([0-9.]+?)(?:\.0)?(?:E(-?\d+))?$", k).alias(n) for k, n in ((1, "sign"), (2, "mantissa"), (3, "power"))))

    def spread(p: Column) -> Column:
        digits, n = F.replace(p.mantissa, F.lit("."), F.lit("")), F.when(p.power != "", p.power).otherwise("0").cast("int") + 1
        whole = F.concat(F.substring(F.rpad(digits, n, "0"), F.lit(1), n), F.when(F.length(digits) > n, F.concat(F.lit("."), F.substring(digits, n + 1, F.length(digits)))).otherwise(""))
        return F.concat(p.sign, F.when(n > 0, whole).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), digits)))

    plain = lambda p: F.when(p.power == "", F.concat(p.sign, p.mantissa)).otherwise(spread(p))
    return F.when(f.isNull(), None).when(F.isnan(f), "NaN").when(F.abs(f) == float("inf"), F.when(f > 0, "inf").otherwise("-inf")).otherwise(let(cut(_shortest(f)), plain))


def serial_ms(f: Column, is_1904: Column) -> Column:
    """Milliseconds since 1899-12-30 of a date serial; the fictitious 1900-02-29 does not exist here."""
    days = f + F.when(is_1904, 1462.0).otherwise(0.0)
    return F.round(F.when(days < 60, days + 1).otherwise(days) * 86_400_000.0).cast("long")


def serial_datetime(f: Column, is_1904: Column) -> Column:
    """Timestamp of a serial; null outside the years that timestamps have."""
    held = F.when((F.abs(f) < 9.0e7) & ~F.isnan(f), f)
    return F.timestamp_add("MILLISECOND", serial_ms(held, is_1904), F.expr("TIMESTAMP_NTZ '1899-12-30 00:00:00'"))


def serial_from_datetime(t: Column, is_1904: Column | bool = False) -> Column:
    """Serial of a timestamp from 1900-03-01 on (in the 1904 system: from 1904-01-01 on)."""
    flag = F.lit(is_1904) if isinstance(is_1904, bool) else is_1904
    ms = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1899-12-30 00:00:00'"), t)
    return ms / 86_400_000.0 - F.when(flag, 1462.0).otherwise(0.0)


def duration_ms(f: Column) -> Column:
    return F.round(F.when((F.abs(f) < 1.0e11) & ~F.isnan(f), f) * 86_400_000.0).cast("long")


def ymd_hms_milli(f: Column, is_1904: Column) -> Column:
    """Struct of year to milliseconds; serial 60 is the fictitious 1900-02-29, serial 0 is 1899-12-31."""
    days = f + F.when(is_1904, 1462.0).otherwise(0.0)
    ms = F.round(days * 86_400_000.0).cast("long")
    day, rest = F.floor(ms / 86_400_000.0).cast("int"), F.pmod(ms, F.lit(86_400_000))
    leap = ~is_1904 & (day == 60)
    shifted = F.when(is_1904 | (day > 60), day).otherwise(day + 1)
    date = F.date_add(F.lit("1899-12-30").cast("date"), F.when(leap, 61).otherwise(shifted))
    part = lambda n: F.floor(rest / n).cast("int")
    return F.struct(
        F.when(leap, 1900).otherwise(F.year(date)).alias("year"), F.when(leap, 2).otherwise(F.month(date)).alias("month"), F.when(leap, 29).otherwise(F.dayofmonth(date)).alias("day"),
        part(3_600_000).alias("hour"), (part(60_000) % 60).alias("minute"), (part(1_000) % 60).alias("second"), F.pmod(rest, F.lit(1000)).cast("int").alias("milli"),
    )


class Cell:
    def __init__(self, struct: str | None = None):
        at = (lambda c: F.col(c)) if struct is None else (lambda c: F.col(f"{struct}.{c}"))
        self.kind, self.i, self.f, self.s, self.b = (at(c) for c in ("kind", "i", "f", "s", "b"))
        self.is_1904 = F.coalesce(at("is_1904"), F.lit(False))

    # kind tests
    def is_kind(self, *kinds: str) -> Column:
        return self.kind.isin(*kinds)

    def is_empty(self) -> Column:
        return self.is_kind(M.EMPTY)

    def is_int(self) -> Column:
        return self.is_kind(M.INT)

    def is_float(self) -> Column:
        return self.is_kind(M.FLOAT)

    def is_bool(self) -> Column:
        return self.is_kind(M.BOOL)

    def is_string(self) -> Column:
        return self.is_kind(M.STRING)

    def is_datetime(self) -> Column:
        return self.is_kind(M.DATETIME, M.TIMEDELTA)

    def is_datetime_iso(self) -> Column:
        return self.is_kind(M.DATETIME_ISO)

    def is_duration_iso(self) -> Column:
        return self.is_kind(M.DURATION_ISO)

    def is_error(self) -> Column:
        return self.is_kind(M.ERROR)

    # strict getters: a value only where the kind is the asked one
    def get_int(self) -> Column:
        return F.when(self.is_int(), self.i)

    def get_float(self) -> Column:
        return F.when(self.is_float(), self.f)

    def get_bool(self) -> Column:
        return F.when(self.is_bool(), self.b)

    def get_string(self) -> Column:
        return F.when(self.is_string(), self.s)

    def get_datetime(self) -> Column:
        return F.when(self.is_datetime(), F.struct(self.f.alias("value"), (self.kind == M.TIMEDELTA).alias("is_duration"), self.is_1904.alias("is_1904")))

    def get_datetime_iso(self) -> Column:
        return F.when(self.is_datetime_iso(), self.s)

    def get_duration_iso(self) -> Column:
        return F.when(self.is_duration_iso(), self.s)

    def get_error(self) -> Column:
        return F.when(self.is_error(), self.s)

    def equals(self, value: str | float | bool | int) -> Column:
        """Typed equality: an int cell never equals a float."""
        if isinstance(value, bool):
            return F.coalesce(self.is_bool() & (self.b == value), F.lit(False))
        kind, held = {int: (M.INT, self.i), float: (M.FLOAT, self.f), str: (M.STRING, self.s)}[type(value)]
        return F.coalesce((self.kind == kind) & (held == value), F.lit(False))

    # coercions: null where the kind has none
    def as_string(self) -> Column:
        return F.when(self.is_int(), self.i.cast("string")).when(self.is_float(), float_text(self.f)).when(self.is_string(), self.s)

    def as_i64(self) -> Column:
        whole = F.when(self.s.rlike(r"^[+-]?\d+$"), self.s)
        return F.when(self.is_int(), self.i).when(self.is_float(), saturated(self.f)).when(self.is_bool(), self.b.cast("long")).when(self.is_string(), whole.try_cast("long"))

    def as_f64(self) -> Column:
        number = F.when(self.s.rlike(_FLOAT), self.s)
        return F.when(self.is_int(), self.i.cast("double")).when(self.is_float(), self.f).when(self.is_bool(), self.b.cast("double")).when(self.is_string(), number.try_cast("double"))

    def _iso_stamp(self) -> Column:
        return F.when(self.is_datetime_iso() & self.s.rlike(_STAMP), self.s).try_cast("timestamp_ntz")

    def as_datetime(self) -> Column:
        """Int and float cells count as serials of the 1900 system; a date alone is no datetime."""
        serial = F.when(self.is_int(), self.i.cast("double")).when(self.is_float() | self.is_datetime(), self.f)
        old = F.when(self.is_datetime(), self.is_1904).otherwise(False)
        return F.coalesce(serial_datetime(serial, old), self._iso_stamp())

    def as_date(self) -> Column:
        return F.coalesce(self.as_datetime().cast("date"), F.when(self.is_datetime_iso() & self.s.rlike(_DATE), self.s).try_cast("date"))

    def as_time(self) -> Column:
        """Time of day as text ``HH:mm:ss.SSSSSS``."""
        alone = F.when(self.is_datetime_iso() & self.s.rlike(_TIME), F.concat(F.lit("2000-01-01T"), self.s)).try_cast("timestamp_ntz")
        hours, minutes, seconds, parts = (F.regexp_extract(self.s, _SPAN, k) for k in (1, 2, 3, 4))
        span = F.when(self.is_duration_iso() & self.s.rlike(_SPAN), F.concat(F.lit("2000-01-01T"), F.lpad(hours, 2, "0"), F.lit(":"), F.lpad(minutes, 2, "0"), F.lit(":"), F.lpad(seconds, 2, "0"), parts)).try_cast("timestamp_ntz")
        return F.date_format(F.coalesce(self.as_datetime(), alone, span), "HH:mm:ss.SSSSSS")

    def as_duration_ms(self) -> Column:
        hours, minutes, seconds = (F.regexp_extract(self.s, _SPAN, k).cast("long") for k in (1, 2, 3))
        part = F.regexp_extract(self.s, _SPAN, 4)
        iso = F.when(self.is_duration_iso() & self.s.rlike(_SPAN), ((hours * 60 + minutes) * 60 + seconds) * 1000 + F.when(part != "", F.floor(part.cast("double") * 1000)).otherwise(0).cast("long"))
        return F.when(self.is_datetime(), duration_ms(self.f)).otherwise(F.when(self.is_duration_iso() & self.s.rlike(_SPAN), iso))

    def display(self) -> Column:
        """Text of any cell; empty cells give an empty string, dates their serial."""
        return (
            F.when(self.is_empty(), "").when(self.is_int(), self.i.cast("string")).when(self.is_kind(M.FLOAT, M.DATETIME, M.TIMEDELTA), float_text(self.f)).when(self.is_bool(), self.b.cast("string")).otherwise(self.s)
        )

    # typed targets of rows: null where the cell has no such value
    def to_bool(self) -> Column:
        return (
            F.when(self.is_bool(), self.b).when(self.is_empty(), False).when(self.is_int(), self.i != 0).when(self.is_float(), self.f != 0).when(self.is_datetime() | self.is_datetime_iso() | self.is_duration_iso(), True)
            .when(self.is_string() & self.s.isin("TRUE", "true", "True"), True).when(self.is_string() & self.s.isin("FALSE", "false", "False"), False)
        )

    def to_long(self) -> Column:
        return F.when(self.is_int(), self.i).when(self.is_float(), saturated(self.f)).when(self.is_string() & self.s.rlike(r"^[+-]?\d+$"), self.s.try_cast("long"))

    def to_double(self) -> Column:
        return F.when(self.is_int(), self.i.cast("double")).when(self.is_float(), self.f).when(self.is_string() & self.s.rlike(_FLOAT), self.s.try_cast("double"))

    def to_char(self) -> Column:
        return F.when(self.is_string() & (F.octet_length(self.s) == 1), self.s)

    def or_text(self, value: Column, errors: str = "raise") -> Column:
        """Struct of the value, or of the cell's text where there is none; an error cell raises, or gives its text if ``errors`` is "text"."""
        wrong = F.raise_error(F.concat(F.lit("error cell "), self.display())).cast("string")
        text = self.display() if errors == "text" else F.when(self.is_error(), wrong).otherwise(self.display())
        return F.struct(value.alias("ok"), F.when(value.isNull(), text).alias("err"))
