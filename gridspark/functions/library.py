"""The index of worksheet functions that formula tokens of binary workbooks name by number.

The default has the functions that formulas use most. A reader takes a wider one as an argument, as a dict or as
a relation (index, name, arguments), for instance made from the published list of the format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Number, name, and the count of arguments of those that always have the same one.
_COMMON = """
0 COUNT, 1 IF, 2 ISNA 1, 3 ISERROR 1, 4 SUM, 5 AVERAGE, 6 MIN, 7 MAX, 8 ROW, 9 COLUMN, 10 NA 0, 11 NPV, 12 STDEV, 13 DOLLAR, 14 FIXED, 15 SIN 1, 16 COS 1, 17 TAN 1, 18 ATAN 1, 19 PI 0,
20 SQRT 1, 21 EXP 1, 22 LN 1, 23 LOG10 1, 24 ABS 1, 25 INT 1, 26 SIGN 1, 27 ROUND 2, 28 LOOKUP, 29 INDEX, 30 REPT 2, 31 MID 3, 32 LEN 1, 33 VALUE 1, 34 TRUE 0, 35 FALSE 0, 36 AND, 37 OR, 38 NOT 1, 39 MOD 2,
40 DCOUNT 3, 41 DSUM 3, 42 DAVERAGE 3, 43 DMIN 3, 44 DMAX 3, 45 DSTDEV 3, 46 VAR, 47 DVAR 3, 48 TEXT 2, 49 LINEST, 50 TREND, 51 LOGEST, 52 GROWTH, 56 PV, 57 FV, 58 NPER, 59 PMT, 60 RATE, 61 MIRR 3, 62 IRR, 63 RAND 0, 64 MATCH,
65 DATE 3, 66 TIME 3, 67 DAY 1, 68 MONTH 1, 69 YEAR 1, 70 WEEKDAY, 71 HOUR 1, 72 MINUTE 1, 73 SECOND 1, 74 NOW 0, 75 AREAS 1, 76 ROWS 1, 77 COLUMNS 1, 78 OFFSET, 82 SEARCH, 83 TRANSPOSE 1, 86 TYPE 1, 97 ATAN2 2, 98 ASIN 1, 99 ACOS 1,
100 CHOOSE, 101 HLOOKUP, 102 VLOOKUP, 105 ISREF 1, 109 LOG, 111 CHAR 1, 112 LOWER 1, 113 UPPER 1, 114 PROPER 1, 115 LEFT, 116 RIGHT, 117 EXACT 2, 118 TRIM 1, 119 REPLACE 4, 120 SUBSTITUTE, 121 CODE 1, 124 FIND, 125 CELL, 126 ISERR 1, 127 ISTEXT 1, 128 ISNUMBER 1, 129 ISBLANK 1,
130 T 1, 131 N 1, 140 DATEVALUE 1, 141 TIMEVALUE 1, 142 SLN 3, 143 SYD 4, 144 DDB, 148 INDIRECT, 162 CLEAN 1, 163 MDETERM 1, 164 MINVERSE 1, 165 MMULT 2, 167 IPMT, 168 PPMT, 169 COUNTA, 183 PRODUCT, 184 FACT 1, 190 ISNONTEXT 1, 193 STDEVP, 194 VARP, 197 TRUNC, 198 ISLOGICAL 1,
212 ROUNDUP 2, 213 ROUNDDOWN 2, 216 RANK, 219 ADDRESS, 220 DAYS360, 221 TODAY 0, 222 VDB, 227 MEDIAN, 228 SUMPRODUCT, 229 SINH 1, 230 COSH 1, 231 TANH 1, 232 ASINH 1, 233 ACOSH 1, 234 ATANH 1, 244 INFO 1, 247 DB, 252 FREQUENCY 2, 255 User, 261 ERROR.TYPE 1, 269 AVEDEV,
271 GAMMALN 1, 273 BINOMDIST 4, 276 COMBIN 2, 279 EVEN 1, 285 FLOOR 2, 288 CEILING 2, 298 ODD 1, 299 PERMUT 2, 336 CONCATENATE, 337 POWER 2, 342 RADIANS 1, 343 DEGREES 1, 344 SUBTOTAL, 345 SUMIF, 346 COUNTIF 2, 347 COUNTBLANK 1, 351 DATEDIF 3, 354 ROMAN, 358 GETPIVOTDATA, 359 HYPERLINK,
361 AVERAGEA, 362 MAXA, 363 MINA, 480 IFERROR 2, 481 COUNTIFS, 482 SUMIFS, 483 AVERAGEIF, 484 AVERAGEIFS
"""


def _read(text: str) -> dict[int, tuple[str, int | None]]:
    rows = [entry.split() for entry in text.replace("\n", " ").split(",") if entry.strip()]
    return {int(r[0]): (r[1], int(r[2]) if len(r) > 2 else None) for r in rows}


#: number -> (name, arguments; None where they vary)
COMMON = _read(_COMMON)


def functions(given: dict | DataFrame | None) -> dict[int, tuple[str, int | None]]:
    """The index to use: the default, widened by what is given."""
    if isinstance(given, DataFrame):
        rows = given.select("index", "name", "arguments").limit(1 << 15).collect()  # numbers have 15 bits
        given = {r["index"]: (r["name"], r["arguments"]) for r in rows}
    return COMMON | (given or {})
