"""Cell algebra over the driver's tables, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, refs
from ..functions.cells import Cell, duration_ms, serial_datetime, serial_from_datetime, ymd_hms_milli
from ..operators import ranges
from ..operators.melt import melt
from ..operators.rows import as_map, select_headers, target

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return melt(read(spark, sf_dir, "supplier"), F.col("s_suppkey"), ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells of one sheet for each status."""
    orders = read(spark, sf_dir, "orders")
    cells = melt(orders, F.col("o_orderkey"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    return cells.join(orders.select(F.col("o_orderkey").cast("int").alias("row"), F.col("o_orderstatus").alias("sheet")), "row")


#: Orders melted in SQL: (sheet, row, col, kind).
_ORDER_CELLS = """(SELECT o_orderstatus AS sheet, o_orderkey AS row, unnest([0, 1, 2, 3, 4]) AS col,
  unnest(['int', 'int', 'float', 'datetime', 'string']) AS kind FROM orders)"""


@query(f"SELECT sheet, min(row)::INT AS r0, min(col)::INT AS c0, max(row)::INT AS r1, max(col)::INT AS c1 FROM {_ORDER_CELLS} GROUP BY sheet")
def cells_from_sparse_bounds(spark, sf_dir):
    return ranges.bounds(order_cells(spark, sf_dir), ["sheet"])


@query(f"SELECT sheet, max(row) - min(row) + 1 AS height, (max(col) - min(col) + 1)::BIGINT AS width, ((max(row) - min(row) + 1) * (max(col) - min(col) + 1))::BIGINT AS n_cells FROM {_ORDER_CELLS} GROUP BY sheet")
def range_size(spark, sf_dir):
    return ranges.size(order_cells(spark, sf_dir), ["sheet"])


@query("""WITH g AS (SELECT r::INT AS row, c::INT AS col FROM range(90, 121) a(r), range(0, 6) b(c))
SELECT row, col, CASE WHEN s_suppkey IS NULL THEN 'empty' ELSE CASE col WHEN 0 THEN 'int' WHEN 1 THEN 'string' WHEN 2 THEN 'int' WHEN 3 THEN 'float' ELSE 'empty' END END AS kind,
  CASE col WHEN 1 THEN s_name END AS s FROM g LEFT JOIN supplier ON s_suppkey = row""")
def range_slice_padded(spark, sf_dir):
    cells = supplier_cells(spark, sf_dir)
    rectangle = spark.createDataFrame([(90, 0, 120, 5)], "r0 int, c0 int, r1 int, c1 int")
    return ranges.dense(ranges.between(cells, 90, 0, 120, 5), [], rectangle).select("row", "col", "kind", "s")


@query(f"WITH c AS (SELECT * FROM {_ORDER_CELLS}), b AS (SELECT sheet, min(row) AS r0, min(col) AS c0 FROM c GROUP BY sheet) SELECT sheet, sum(row - r0)::BIGINT AS rows_sum, sum(col - c0)::BIGINT AS cols_sum, count(*) AS n FROM c JOIN b USING (sheet) GROUP BY sheet")
def range_used_cells(spark, sf_dir):
    return ranges.relative(order_cells(spark, sf_dir), ["sheet"]).groupBy("sheet").agg(F.sum("row").alias("rows_sum"), F.sum("col").alias("cols_sum"), F.count("*").alias("n"))


@query("SELECT s_suppkey::INT AS row, s_suppkey::VARCHAR || '|' || s_name || '|' || s_nationkey::VARCHAR AS line FROM supplier")
def range_rows(spark, sf_dir):
    made = ranges.rows(ranges.between(supplier_cells(spark, sf_dir), 0, 0, 1 << 20, 2), [], Cell().display())
    return made.select("row", F.array_join("values", "|").alias("line"))


@query("SELECT c_mktsegment AS sheet, min(c_custkey) AS first_key, arg_min(c_name, c_custkey) AS name FROM customer GROUP BY c_mktsegment")
def range_headers(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    cells = melt(customer, F.col("c_custkey"), ["c_custkey", "c_name"]).join(customer.select(F.col("c_custkey").cast("int").alias("row"), F.col("c_mktsegment").alias("sheet")), "row")
    found = ranges.headers(cells, ["sheet"], Cell().display())
    return found.select("sheet", F.col("headers")[0].cast("long").alias("first_key"), F.col("headers")[1].alias("name"))


@query("SELECT c_mktsegment AS sheet, min(c_custkey) AS first_key, arg_min(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, c_custkey) AS name, arg_min(c_nationkey, c_custkey)::VARCHAR AS nation FROM customer GROUP BY c_mktsegment")
def range_headers_with_gaps(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    places = customer.select(F.col("c_custkey").cast("int").alias("row"), F.col("c_mktsegment").alias("sheet"))
    cells = melt(customer, F.col("c_custkey"), ["c_custkey", "c_name", "c_nationkey"]).where("col <> 1 OR row % 2 = 0").join(places, "row")
    found = ranges.headers(cells, ["sheet"], Cell().display())
    return found.select("sheet", F.col("headers")[0].cast("long").alias("first_key"), F.col("headers")[1].alias("name"), F.col("headers")[2].alias("nation"))


@query("SELECT s_name AS s FROM supplier WHERE s_suppkey = 7")
def range_get_value(spark, sf_dir):
    return supplier_cells(spark, sf_dir).where("row = 7 AND col = 1").select("s")


@query("SELECT s_suppkey::INT AS row, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS s FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier)::INT + 5, 'new'")
def range_set_value_last_wins(spark, sf_dir):
    cells = supplier_cells(spark, sf_dir).where("col = 1").select("row", "col", "kind", "s")
    top = cells.agg((F.max("row") + 5).alias("row"))
    new = cells.where("row % 3 = 0").select("row").unionByName(top).select("row", F.lit(1).alias("col"), F.lit("string").alias("kind"), F.lit("new").alias("s"))
    return ranges.set_values(cells, new, []).select("row", "s")


@query("SELECT o_orderstatus AS sheet, 500 AS first_row, count(*) * 5 + (min(o_orderkey) > 500)::INT AS n FROM orders WHERE o_orderkey >= 500 GROUP BY 1")
def header_row_filter(spark, sf_dir):
    kept = ranges.header_row(order_cells(spark, sf_dir), 500, ["sheet"])
    return kept.groupBy("sheet").agg(F.min("row").alias("first_row"), F.count("*").alias("n"))


@query(f"SELECT sheet, kind, count(*) AS n FROM {_ORDER_CELLS} GROUP BY ALL")
def cell_kind_counts(spark, sf_dir):
    return order_cells(spark, sf_dir).groupBy("sheet", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(sheet, '(all)') AS sheet, coalesce(kind, '(all)') AS kind, count(*) AS n FROM {_ORDER_CELLS} GROUP BY CUBE (sheet, kind)")
def cells_cube_by_sheet_kind(spark, sf_dir):
    made = order_cells(spark, sf_dir).cube("sheet", "kind").agg(F.count("*").alias("n"))
    return made.select(F.coalesce("sheet", F.lit("(all)")).alias("sheet"), F.coalesce("kind", F.lit("(all)")).alias("kind"), "n")


@query("""SELECT (5 * count(*))::BIGINT AS n, (2 * count(*))::BIGINT AS ints, count(*) AS floats, count(*) AS strings, count(*) AS datetimes, 0::BIGINT AS errors, 0::BIGINT AS others FROM orders""")
def cell_kind_tests(spark, sf_dir):
    c, n = Cell(), lambda p: F.sum(p.cast("long"))
    return order_cells(spark, sf_dir).agg(
        F.count("*").alias("n"), n(c.is_int()).alias("ints"), n(c.is_float()).alias("floats"), n(c.is_string()).alias("strings"), n(c.is_datetime()).alias("datetimes"), n(c.is_error()).alias("errors"),
        n(c.is_empty() | c.is_bool() | c.is_datetime_iso() | c.is_duration_iso()).alias("others"),
    )


@query("SELECT s_suppkey::INT AS row, s_nationkey::BIGINT AS get_int, s_acctbal AS get_float, s_name AS get_string, NULL::BOOLEAN AS get_bool FROM supplier")
def cell_strict_get(spark, sf_dir):
    c = Cell()
    return supplier_cells(spark, sf_dir).where("col > 0").groupBy("row").agg(*(F.max(v).alias(k) for k, v in (("get_int", c.get_int()), ("get_float", c.get_float()), ("get_string", c.get_string()), ("get_bool", c.get_bool()))))


def _events(spark, sf_dir) -> DataFrame:
    """Cells of mixed kinds made from events."""
    e = read(spark, sf_dir, "events")
    pick = F.col("event_id") % 5
    return e.select(
        "event_id", F.when(pick == 0, "int").when(pick == 1, "float").when(pick == 2, "string").when(pick == 3, "bool").otherwise("error").alias("kind"),
        F.when(pick == 0, F.col("user_id")).alias("i"), F.when(pick == 1, F.col("value") * F.when(F.col("event_id") % 2 == 0, 1e18).otherwise(-3.0)).alias("f"),
        F.when(pick == 2, F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type"))).when(pick == 4, "#N/A").alias("s"), F.when(pick == 3, F.col("user_id") % 2 == 0).alias("b"), F.lit(False).alias("is_1904"),
    )


_EVENTS = """(SELECT *, event_id % 5 AS p, value * CASE WHEN event_id % 2 = 0 THEN 1e18 ELSE -3.0 END AS f,
 CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE event_type END AS s FROM events)"""


@query(f"""SELECT event_id, CASE p WHEN 0 THEN user_id WHEN 1 THEN CASE WHEN f >= 9223372036854775807 THEN 9223372036854775807 WHEN f <= -9223372036854775808 THEN -9223372036854775808 ELSE trunc(f)::BIGINT END
 WHEN 2 THEN CASE WHEN regexp_full_match(s, '[+-]?\\d+') THEN s::BIGINT END WHEN 3 THEN (user_id % 2 = 0)::BIGINT END AS v FROM {_EVENTS}""")
def as_i64_saturating(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", Cell().as_i64().alias("v"))


@query(f"SELECT event_id, CASE p WHEN 0 THEN user_id::DOUBLE WHEN 1 THEN f WHEN 2 THEN CASE WHEN regexp_full_match(s, '[+-]?\\d+') THEN s::DOUBLE END WHEN 3 THEN (user_id % 2 = 0)::INT::DOUBLE END AS v FROM {_EVENTS}")
def as_f64_mixed(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", Cell().as_f64().alias("v"))


#: A number's shortest digits, written out without an exponent.
_DIGITS = """CASE WHEN contains(f::VARCHAR, 'e+') THEN CASE WHEN f < 0 THEN '-' ELSE '' END || rpad(replace(replace(split_part(f::VARCHAR, 'e+', 1), '-', ''), '.', ''), split_part(f::VARCHAR, 'e+', 2)::INT + 1, '0')
 ELSE regexp_replace(f::VARCHAR, '\\.0$', '') END"""


@query(f"SELECT event_id, CASE p WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN {_DIGITS} WHEN 2 THEN s END AS v FROM {_EVENTS}")
def as_string_display(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", Cell().as_string().alias("v"))


@query(f"SELECT event_id, CASE p WHEN 0 THEN user_id <> 0 WHEN 1 THEN f <> 0 WHEN 3 THEN user_id % 2 = 0 END AS v FROM {_EVENTS}")
def as_bool_target(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", Cell().to_bool().alias("v"))


@query(f"""SELECT event_id, CASE p WHEN 0 THEN user_id WHEN 1 THEN CASE WHEN f >= 9223372036854775807 THEN 9223372036854775807 WHEN f <= -9223372036854775808 THEN -9223372036854775808 ELSE trunc(f)::BIGINT END
 WHEN 3 THEN (user_id % 2 = 0)::BIGINT WHEN 2 THEN CASE WHEN regexp_full_match(s, '[+-]?\\d+') THEN s::BIGINT END END AS ok,
 CASE p WHEN 4 THEN '#N/A' WHEN 2 THEN CASE WHEN NOT regexp_full_match(s, '[+-]?\\d+') THEN s END END AS err FROM {_EVENTS}""")
def deserialize_or_string(spark, sf_dir):
    c = Cell()
    return _events(spark, sf_dir).select("event_id", c.or_text(c.as_i64(), errors="text").alias("r")).select("event_id", "r.ok", "r.err")


@query(f"SELECT event_id, CASE p WHEN 0 THEN user_id::DOUBLE WHEN 1 THEN f WHEN 2 THEN CASE WHEN regexp_full_match(s, '[+-]?\\d+') THEN s::DOUBLE END END AS v FROM {_EVENTS}")
def deserialize_or_none(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", target(Cell(), "double").alias("v"))


@query(f"SELECT s AS error, count(*) AS n FROM (SELECT '#N/A' AS s FROM {_EVENTS} WHERE p = 4) GROUP BY 1")
def error_count_by_type(spark, sf_dir):
    return _events(spark, sf_dir).where(Cell().is_error()).groupBy(F.col("s").alias("error")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, date_diff('millisecond', TIMESTAMP '1899-12-30', o_orderdate) / 86400000.0::DOUBLE AS serial FROM orders")
def serial_from_date(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", serial_from_datetime(F.col("o_orderdate").cast("timestamp_ntz")).alias("serial"))


@query("SELECT p_partkey, TIMESTAMP '1899-12-30' + to_milliseconds(round(CASE WHEN p_retailprice < 60 THEN p_retailprice + 1 ELSE p_retailprice END * 86400000)::BIGINT) AS at FROM part")
def date_from_serial(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", serial_datetime(F.col("p_retailprice"), F.lit(False)).alias("at"))


@query("SELECT p_partkey, TIMESTAMP '1899-12-30' + to_milliseconds(round((p_retailprice + 1462) * 86400000)::BIGINT) AS at FROM part")
def serial_1904_shift(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", serial_datetime(F.col("p_retailprice"), F.lit(True)).alias("at"))


@query("""WITH t AS (SELECT p_partkey, round((p_retailprice + 61) * 86400000)::BIGINT AS ms FROM part), d AS (SELECT *, DATE '1899-12-30' + (ms // 86400000)::INT AS day, ms % 86400000 AS r FROM t)
SELECT p_partkey, year(day)::INT AS year, month(day)::INT AS month, day(day)::INT AS day, (r // 3600000)::INT AS hour, (r // 60000 % 60)::INT AS minute, (r // 1000 % 60)::INT AS second, (r % 1000)::INT AS milli FROM d""")
def ymd_hms_milli_parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", ymd_hms_milli(F.col("p_retailprice") + 61, F.lit(False)).alias("t")).select("p_partkey", "t.*")


@query("SELECT event_id, round(value * 86400000)::BIGINT AS ms FROM events")
def duration_milliseconds(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", duration_ms(F.col("value")).alias("ms"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('second', o_orderdate) END AS at, CAST(o_orderdate AS DATE) AS day FROM orders")
def iso_date_parse(spark, sf_dir):
    c = Cell()
    stamp = F.col("o_orderdate").cast("timestamp_ntz")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(stamp, "yyyy-MM-dd"))
    none = F.lit(None)
    made = read(spark, sf_dir, "orders").select("o_orderkey", F.lit("datetime_iso").alias("kind"), none.cast("bigint").alias("i"), none.cast("double").alias("f"), text.alias("s"), none.cast("boolean").alias("b"), F.lit(False).alias("is_1904"))
    return made.select("o_orderkey", c.as_datetime().alias("at"), c.as_date().alias("day"))


_NAME = """CASE WHEN n < 26 THEN chr((65 + n)::INT) WHEN n < 702 THEN chr((65 + (n - 26) // 26)::INT) || chr((65 + (n - 26) % 26)::INT)
 ELSE chr((65 + (n - 702) // 676)::INT) || chr((65 + (n - 702) // 26 % 26)::INT) || chr((65 + (n - 702) % 26)::INT) END"""


@query(f"SELECT n, {_NAME} AS name FROM (SELECT o_orderkey % 16384 AS n, o_orderkey FROM orders)")
def column_name_encode(spark, sf_dir):
    n = F.col("o_orderkey") % 16384
    return read(spark, sf_dir, "orders").select(n.alias("n"), refs.column_name(n).alias("name"))


@query(f"SELECT o_orderkey, o_custkey, {_NAME} || (o_custkey + 1)::VARCHAR AS ref FROM (SELECT *, o_orderkey % 16384 AS n FROM orders)")
def a1_encode(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", refs.a1(F.col("o_custkey"), F.col("o_orderkey") % 16384).alias("ref"))


@query("SELECT o_orderkey, o_custkey AS row, (o_orderkey % 16384)::INT AS col FROM orders")
def a1_decode(spark, sf_dir):
    ref = F.lower(refs.a1(F.col("o_custkey"), F.col("o_orderkey") % 16384))
    return read(spark, sf_dir, "orders").select("o_orderkey", refs.a1_row(ref).alias("row"), refs.a1_col(ref).alias("col"))


@query("SELECT o_orderkey, (o_custkey + 1) * 3 AS area FROM orders")
def dimension_parse_area(spark, sf_dir):
    d = refs.dimension(F.concat(F.lit("B1:D"), (F.col("o_custkey") + 1).cast("string")))
    return read(spark, sf_dir, "orders").select("o_orderkey", d.alias("d")).select("o_orderkey", refs.area(F.col("d.r0"), F.col("d.c0"), F.col("d.r1"), F.col("d.c1")).alias("area"))


@query("SELECT p_size AS id, CASE WHEN p_size BETWEEN 14 AND 22 OR p_size IN (45, 47) THEN 'datetime' WHEN p_size = 46 THEN 'timedelta' ELSE 'other' END AS class, count(*) AS n FROM part GROUP BY ALL")
def numfmt_builtin_class(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("id"), formats.builtin_class(F.col("p_size")).alias("class")).agg(F.count("*").alias("n"))


#: format code -> class, as the format rules say
_CODES = {"General": "other", "0.00": "other", "yyyy-mm-dd": "datetime", "[h]:mm:ss": "timedelta", "#,##0*y": "other", '"day" 0': "other", "[Red]0;yyyy": "other", "h:mm AM/PM": "datetime", "\\d0": "other", "[$-409]d-mmm": "datetime", "[mm]:ss": "timedelta"}


@query("SELECT n_nationkey, code, class FROM nation, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _CODES.items()) + ") t(code, class)")
def numfmt_custom_class(spark, sf_dir):
    codes = F.array(*(F.lit(k) for k in _CODES))
    made = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(codes).alias("code"))
    return made.select("n_nationkey", "code", formats.custom_class(F.col("code")).alias("class"))


@query("SELECT s_suppkey, 'SUM(A' || s_suppkey + 1 || ':$B$2)*C' || s_suppkey + 1 || '+LOG10(A1:A2)&\"A1\"' AS formula FROM supplier" .replace("LOG10(A1:A2)", "LOG10(A' || s_suppkey + 1 || ':A' || s_suppkey + 2 || ')"))
def shared_formula_expand(spark, sf_dir):
    text = refs.expand_formula(F.lit('SUM(A1:$B$2)*C1+LOG10(A1:A2)&"A1"'), F.col("s_suppkey").cast("int"), F.lit(0))
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("formula"))


@query("""WITH r AS (SELECT n_nationkey, n_nationkey * 4 AS r0, n_nationkey * 4 + 2 AS r1 FROM nation)
SELECT n_nationkey, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier JOIN r ON s_suppkey BETWEEN r0 AND r1 GROUP BY n_nationkey""")
def hyperlink_contains(spark, sf_dir):
    k = F.col("n_nationkey")
    rectangles = read(spark, sf_dir, "nation").select("n_nationkey", (k * 4).alias("r0"), F.lit(0).alias("c0"), (k * 4 + 2).alias("r1"), F.lit(0).alias("c1"))
    found = ranges.in_rectangles(supplier_cells(spark, sf_dir), rectangles, [])
    return found.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.sum("i").alias("keys"))


@query("SELECT o_orderkey, n_name AS s FROM orders JOIN nation ON n_nationkey = o_custkey % 25")
def sst_dictionary_join(spark, sf_dir):
    strings = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("s"))
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("index")).join(strings, "index").select("o_orderkey", "s")


@query("SELECT p_partkey, CASE WHEN p_size % 60 >= 25 THEN 'other' WHEN n_regionkey = 1 THEN 'datetime' ELSE 'other' END AS class FROM part LEFT JOIN nation ON n_nationkey = p_size % 60")
def style_left_join(spark, sf_dir):
    styles = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("xf"), formats.builtin_class(F.when(F.col("n_regionkey") == 1, 14).otherwise(0)).alias("class"))
    return read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 60).alias("xf")).join(styles, "xf", "left").select("p_partkey", F.coalesce("class", F.lit("other")).alias("class"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS anchor FROM events")
def anchor_asof_join(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id")
    return ranges.previous_anchor(events, ["user_id"], "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id")))


@query("SELECT n_regionkey AS group_key, n_nationkey AS row, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation")
def merge_fill_down(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("group_key"), F.col("n_nationkey").alias("row"), F.col("n_name").alias("s"))
    first = nation.groupBy("group_key").agg(F.min_by("s", "row").alias("s"))
    return nation.select("group_key", "row").join(first, "group_key").select("group_key", "row", "s")


@query("SELECT s_suppkey::INT AS row, 4 AS n, s_name AS name FROM supplier")
def flatten_to_map_size(spark, sf_dir):
    made = as_map(supplier_cells(spark, sf_dir), {"key": 0, "name": 1, "nation": 2, "balance": 3}, [], Cell().display())
    return made.select("row", F.size("values").alias("n"), F.col("values")["name"].alias("name"))


@query("SELECT s_name AS name, s_suppkey AS key FROM supplier")
def select_headers_trimmed(spark, sf_dir):
    return select_headers(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(" key"), F.col("s_name").alias("name ")), ["name", "key"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20)")
def unanchored_left_anti(spark, sf_dir):
    anchored = read(spark, sf_dir, "supplier").where("s_suppkey < 20").select(F.col("s_nationkey").alias("n_nationkey"))
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(anchored, "n_nationkey", "left_anti")


@query("SELECT s_suppkey::INT AS row, 2 AS col, s_nationkey::BIGINT AS i FROM supplier WHERE s_suppkey % 7 = 0")
def workbook_diff_except(spark, sf_dir):
    cells = supplier_cells(spark, sf_dir).select("row", "col", "i")
    other = cells.withColumn("i", F.when((F.col("col") == 2) & (F.col("row") % 7 == 0), F.col("i") + 1).otherwise(F.col("i")))
    return cells.exceptAll(other)


@query("SELECT s_suppkey::INT AS row, s_acctbal AS f FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def topk_cells(spark, sf_dir):
    return supplier_cells(spark, sf_dir).where("kind = 'float'").orderBy(F.desc("f"), "row").limit(10).select("row", "f")


_DATED = """(SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 1000 + 100.25 AS serial, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso,
 lpad((o_orderkey % 24)::VARCHAR, 2, '0') AS hh, lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS mm, o_orderdate FROM orders)"""


@query(f"""SELECT o_orderkey, CASE WHEN k < 2 THEN serial::DOUBLE END AS serial, CASE WHEN k < 2 THEN k = 1 END AS is_duration, CASE k WHEN 2 THEN iso END AS iso, CASE k WHEN 3 THEN 'PT' || hh || 'H' || mm || 'M' || mm || 'S' END AS span, CASE k WHEN 4 THEN '#REF!' END AS error,
 CASE WHEN k < 2 THEN round(serial * 86400000)::BIGINT WHEN k = 3 THEN (hh::BIGINT * 3600 + mm::BIGINT * 61) * 1000 END AS ms,
 CASE WHEN k < 2 THEN '06:00:00.000000' WHEN k = 2 THEN iso[12:19] || '.000000' WHEN k = 3 THEN hh || ':' || mm || ':' || mm || '.000000' END AS time FROM {_DATED}""")
def typed_accessors_of_dates(spark, sf_dir):
    """Strict accessors, times and durations over cells of five kinds."""
    k, none = F.col("o_orderkey") % 5, F.lit(None)
    hh, mm = (F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0") for n in (24, 60))
    text = F.when(k == 2, F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.concat(F.lit("PT"), hh, F.lit("H"), mm, F.lit("M"), mm, F.lit("S"))).when(k == 4, "#REF!")
    kind = F.element_at(F.array(*map(F.lit, ("datetime", "timedelta", "datetime_iso", "duration_iso", "error"))), (k + 1).cast("int"))
    cells = read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), none.cast("bigint").alias("i"), F.when(k < 2, F.col("o_orderkey") % 1000 + 100.25).cast("double").alias("f"), text.alias("s"), none.cast("boolean").alias("b"), F.lit(False).alias("is_1904"))
    c = Cell()
    return cells.select("o_orderkey", c.get_datetime().value.alias("serial"), c.get_datetime().is_duration.alias("is_duration"), c.get_datetime_iso().alias("iso"), c.get_duration_iso().alias("span"), c.get_error().alias("error"), c.as_duration_ms().alias("ms"), c.as_time().alias("time"))


_AT = """CASE WHEN abs(x) < 1e6 THEN TIMESTAMP '1899-12-30' + to_milliseconds(round(CASE WHEN x < 60 THEN x + 1 ELSE x END * 86400000)::BIGINT) END"""
_SERIALS = f"(SELECT *, CASE p WHEN 0 THEN user_id::DOUBLE WHEN 1 THEN f END AS x FROM {_EVENTS})"


@query(f"SELECT event_id, stamp, stamp::DATE AS day, strftime(stamp, '%H:%M:%S.%f') AS time, NULL::BIGINT AS ms FROM (SELECT event_id, {_AT} AS stamp FROM {_SERIALS})")
def deserialize_dates_or_none(spark, sf_dir):
    c = Cell()
    return _events(spark, sf_dir).select("event_id", c.as_datetime().alias("stamp"), c.as_date().alias("day"), c.as_time().alias("time"), c.as_duration_ms().alias("ms"))


@query(f"""SELECT event_id, stamp, CASE WHEN stamp IS NULL THEN shown END AS not_stamp, number, CASE WHEN number IS NULL THEN shown END AS not_number
 FROM (SELECT event_id, {_AT} AS stamp, CASE p WHEN 2 THEN CASE WHEN regexp_full_match(s, '[+-]?\\d+') THEN s::DOUBLE END WHEN 3 THEN (user_id % 2 = 0)::INT::DOUBLE ELSE x END AS number,
  CASE p WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN {_DIGITS} WHEN 2 THEN s WHEN 3 THEN (user_id % 2 = 0)::VARCHAR ELSE '#N/A' END AS shown FROM {_SERIALS})""")
def deserialize_dates_or_string(spark, sf_dir):
    c = Cell()
    made = _events(spark, sf_dir).select("event_id", c.or_text(c.as_datetime(), errors="text").alias("d"), c.or_text(c.as_f64(), errors="text").alias("n"))
    return made.select("event_id", F.col("d.ok").alias("stamp"), F.col("d.err").alias("not_stamp"), F.col("n.ok").alias("number"), F.col("n.err").alias("not_number"))


@query(f"SELECT event_id, p = 0 AND user_id = 7 AS is_7, p = 1 AND f = 7.0 AS is_7_0, p = 2 AND s = '8' AS is_text, p = 3 AND user_id % 2 = 0 AS is_true FROM {_EVENTS}")
def typed_equality(spark, sf_dir):
    c = Cell()
    return _events(spark, sf_dir).select("event_id", c.equals(7).alias("is_7"), c.equals(7.0).alias("is_7_0"), c.equals("8").alias("is_text"), c.equals(True).alias("is_true"))


@query(f"""SELECT o_orderkey, day, CASE WHEN day IS NULL THEN shown END AS not_day, time, NULL::VARCHAR AS not_time, ms, CASE WHEN ms IS NULL THEN shown END AS not_ms FROM (SELECT o_orderkey,
 CASE WHEN k < 2 THEN DATE '1899-12-30' + (o_orderkey % 1000 + 100)::INT WHEN k = 2 THEN o_orderdate::DATE END AS day,
 CASE WHEN k < 2 THEN '06:00:00.000000' WHEN k = 2 THEN iso[12:19] || '.000000' ELSE hh || ':' || mm || ':' || mm || '.000000' END AS time,
 CASE WHEN k < 2 THEN round(serial * 86400000)::BIGINT WHEN k = 3 THEN (hh::BIGINT * 3600 + mm::BIGINT * 61) * 1000 END AS ms,
 CASE WHEN k < 2 THEN serial::DOUBLE::VARCHAR WHEN k = 2 THEN iso ELSE 'PT' || hh || 'H' || mm || 'M' || mm || 'S' END AS shown FROM {_DATED} WHERE k < 4)""")
def deserialize_date_time_duration_or_text(spark, sf_dir):
    """A date, a time and a duration of each cell, or its text; error cells would raise, so they are left out before."""
    k = F.col("o_orderkey") % 5
    hh, mm = (F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0") for n in (24, 60))
    text = F.when(k == 2, F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.concat(F.lit("PT"), hh, F.lit("H"), mm, F.lit("M"), mm, F.lit("S"))).when(k == 4, "#REF!")
    kind = F.element_at(F.array(*map(F.lit, ("datetime", "timedelta", "datetime_iso", "duration_iso", "error"))), (k + 1).cast("int"))
    cells = read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), F.lit(None).cast("bigint").alias("i"), F.when(k < 2, F.col("o_orderkey") % 1000 + 100.25).cast("double").alias("f"), text.alias("s"), F.lit(None).cast("boolean").alias("b"), F.lit(False).alias("is_1904"))
    c = Cell()
    made = cells.where(~c.is_error()).select("o_orderkey", c.or_text(c.as_date()).alias("d"), c.or_text(c.as_time()).alias("t"), c.or_text(c.as_duration_ms()).alias("u"))
    return made.select("o_orderkey", F.col("d.ok").alias("day"), F.col("d.err").alias("not_day"), F.col("t.ok").alias("time"), F.col("t.err").alias("not_time"), F.col("u.ok").alias("ms"), F.col("u.err").alias("not_ms"))
