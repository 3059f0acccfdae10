"""Layout queries over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestitch.functions import text as X
from lodestitch.operators import layout as L
from lodestitch.sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _fit_sql(high: str, low: str, least: str, most: str) -> str:
    return f"""CASE WHEN r IS NULL OR (r >= {low} AND r <= {high}) THEN s WHEN r > {high} THEN floor(greatest(s * {least}::DOUBLE, s / r))
      ELSE floor(least(s * {most}::DOUBLE, s / r)) END"""


@query(
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, (l_quantity::INT) / nullif(l_partkey % 50, 0)::DOUBLE AS r, (l_suppkey % 30 + 6)::DOUBLE AS s,
    l_quantity::INT AS n, l_partkey % 50 AS m FROM lineitem)
    SELECT l_orderkey, l_linenumber, {_fit_sql('1.2', '0.8', '0.7', '1.2')} AS word_font, {_fit_sql('1.3', '0.7', '0.5', '1.3')} AS slide_font,
    round(CASE WHEN r > 1.5 THEN greatest(0.5, 2 / (3 * r)) WHEN r > 1 THEN greatest(0.5, 1 / r) ELSE 1.0 END, 6) AS slide_scale FROM t"""
)
def font_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 50).cast("int")
    target, source, size = F.repeat(F.lit("x"), n), F.repeat(F.lit("x"), m), (F.col("l_suppkey") % 30 + 6).cast("double")
    return T.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        L.word_font(source, target, size).alias("word_font"),
        L.slide_font(source, target, size).alias("slide_font"),
        F.round(L.slide_scale(m, n), 6).alias("slide_scale"),
    )


@query(
    """WITH t AS (SELECT p_partkey, p_partkey % 4 AS m, p_size * 10.0::DOUBLE AS w, p_retailprice AS h FROM part), s AS (SELECT *, least((595 - 20) / w, (842 - 20) / h) AS k FROM t),
    b AS (SELECT p_partkey, CASE m WHEN 0 THEN 10 + (575 - w * k) / 2 WHEN 1 THEN 10 WHEN 2 THEN (595 - w) / 2 ELSE 1 END AS x0,
      CASE m WHEN 0 THEN 10 + (822 - h * k) / 2 WHEN 1 THEN 10 WHEN 2 THEN (842 - h) / 2 ELSE 2 END AS y0,
      CASE m WHEN 0 THEN 10 + (575 - w * k) / 2 + w * k WHEN 1 THEN 585 WHEN 2 THEN (595 - w) / 2 + w ELSE w END AS x1,
      CASE m WHEN 0 THEN 10 + (822 - h * k) / 2 + h * k WHEN 1 THEN 832 WHEN 2 THEN (842 - h) / 2 + h ELSE h END AS y1 FROM s)
    SELECT p_partkey, round(x0::DOUBLE, 4) AS x0, round(y0::DOUBLE, 4) AS y0, round(x1::DOUBLE, 4) AS x1, round(y1::DOUBLE, 4) AS y1 FROM b"""
)
def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the images in each mode."""
    w, h, page = F.col("p_size") * 10.0, F.col("p_retailprice"), (F.lit(595.0), F.lit(842.0))
    own = F.struct(F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), w.alias("x1"), h.alias("y1"))
    boxes = [L.image_box(mode, w, h, *page, 10.0, own) for mode in ("fit", "stretch", "center", "custom")]
    out = T.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*boxes), (F.col("p_partkey") % 4 + 1).cast("int")).alias("b"))
    return out.select("p_partkey", *[F.round(f"b.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a place of their own in their order (line numbers repeat)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return T.table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(order).cast("bigint"))


LINES_SQL = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place FROM lineitem)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as the runs of a paragraph, ship mode flags as style."""
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("para_id"),
        F.col("place").alias("run_idx"),
        F.when(F.col("l_quantity") < 3, "").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("text"),
        F.concat("l_returnflag", "l_linestatus").alias("hash"),
        (F.col("l_tax") > 0.07).alias("bounded"),
    )


RUNS_SQL = f"""WITH r AS (SELECT l_orderkey AS para_id, place AS run_idx, CASE WHEN l_quantity < 3 THEN '' ELSE (l_quantity::INT)::VARCHAR END AS text,
    l_returnflag || l_linestatus AS hash, l_tax > 0.07 AS bounded FROM {LINES_SQL})"""


@query(
    RUNS_SQL
    + """, f AS (SELECT *, text <> '' AND NOT bounded AS fit FROM r),
    s AS (SELECT *, CASE WHEN fit AND coalesce(lag(fit) OVER w, false) AND hash = lag(hash) OVER w THEN 0 ELSE 1 END AS st FROM f WINDOW w AS (PARTITION BY para_id ORDER BY run_idx)),
    g AS (SELECT *, sum(st) OVER (PARTITION BY para_id ORDER BY run_idx ROWS UNBOUNDED PRECEDING) AS grp FROM s)
    SELECT para_id, min(run_idx) AS first_run, count(*) AS runs, string_agg(text, '' ORDER BY run_idx) AS text FROM g GROUP BY para_id, grp"""
)
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_groups(_runs(spark, sf_dir)).drop("group")


@query(
    RUNS_SQL
    + """, p AS (SELECT para_id, count(*) AS n, sum(length(text)) AS c FROM r GROUP BY 1),
    t AS (SELECT count(DISTINCT para_id) AS paragraphs, count(*) AS runs, round(count(*) / count(DISTINCT para_id)::DOUBLE, 4) AS runs_per_paragraph,
      count(*) FILTER (length(text) = 0) AS len_0, count(*) FILTER (length(text) = 1) AS len_1, count(*) FILTER (length(text) BETWEEN 2 AND 5) AS len_2_5,
      count(*) FILTER (length(text) BETWEEN 6 AND 20) AS len_6_20, count(*) FILTER (length(text) BETWEEN 21 AND 50) AS len_21_50, count(*) FILTER (length(text) > 50) AS over_50,
      count(*) FILTER (bounded) AS bounded, count(DISTINCT hash) AS styles FROM r),
    q AS (SELECT t.*, (SELECT count(*) FROM p WHERE n > 10 AND c < 100) AS problems, (SELECT count(*) FROM p WHERE n > 20 AND c < 100) AS severe FROM t),
    s AS (SELECT *, CASE WHEN runs > 5 * paragraphs THEN 30 ELSE 0 END + CASE WHEN len_1 > 0.1 * runs THEN 20 ELSE 0 END + CASE WHEN len_0 > 0.05 * runs THEN 10 ELSE 0 END
      + CASE WHEN problems > 0.1 * paragraphs THEN 20 ELSE 0 END + CASE WHEN styles < 0.5 * runs THEN 20 ELSE 0 END AS score FROM q)
    SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM s"""
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_report(_runs(spark, sf_dir))


@query(
    f"""WITH b AS (SELECT l_orderkey AS page, place AS id, (l_partkey % 500)::DOUBLE AS x0, (l_suppkey % 300)::DOUBLE AS y0,
      (l_partkey % 500)::DOUBLE + l_quantity * 4 AS x1, (l_suppkey % 300)::DOUBLE + l_quantity * 4 AS y1 FROM {LINES_SQL})
    SELECT a.page, a.id AS a, b.id AS b FROM b a JOIN b ON a.page = b.page AND a.id < b.id
    AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 2 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 2"""
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0, side = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 300).cast("double"), F.col("l_quantity") * 4
    boxes = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), F.col("place").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + side).alias("x1"), (y0 + side).alias("y1")
    )
    return L.overlapping(boxes)


@query(
    """WITH c AS (SELECT l_orderkey AS table_id, l_linenumber % 3 AS col, max(l_quantity::INT) * max(greatest(l_suppkey % 20, 10))::DOUBLE * 0.8 / 72 AS width FROM lineitem GROUP BY 1, 2),
    t AS (SELECT table_id, sum(width) + 0.1 * count(*) + 0.1 * (count(*) - 1) AS total FROM c GROUP BY 1)
    SELECT table_id, round(CASE WHEN total > 3.7731 * 1.2 - 0.3 THEN (3.7731 * 1.2 - 0.3) / total * 0.95 ELSE 1.0 END, 4) AS scale FROM t"""
)
def text_box_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("table_id"),
        (F.col("l_linenumber") % 3).alias("col"),
        F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"),
        (F.col("l_suppkey") % 20).cast("double").alias("font_size"),
    )
    return L.table_scale(cells, 3.7731).withColumn("scale", F.round("scale", 4))


_JOINED_SQL = "array_to_string(runs, '')"


@query(
    f"""WITH RECURSIVE r AS (SELECT conv_id, list(text ORDER BY turn) AS runs FROM conversations GROUP BY 1),
    w AS (SELECT *, list_transform(runs, lambda x: length(x)) AS lens, len(runs) AS n, length(whole) AS size, list_filter(string_split_regex(whole, '[{X.SPACE}]+'), lambda x: x <> '') AS ws FROM
      (SELECT *, CASE conv_id % 3 WHEN 0 THEN translate({_JOINED_SQL}, 'aeiou', 'AEIOU') WHEN 1 THEN {_JOINED_SQL} || ' and some more words at the end' ELSE substr({_JOINED_SQL}, 1, 7) END AS whole FROM r)),
    t AS (SELECT *, list_sum(lens)::BIGINT AS total FROM w),
    e AS (SELECT conv_id, 0 AS i, 0::BIGINT AS used, []::VARCHAR[] AS parts FROM t UNION ALL
      SELECT conv_id, i + 1, used + take, parts || [substr(whole, used + 1, take)] FROM (SELECT e.*, t.whole, CASE WHEN lens[i + 1] = 0 THEN 0 WHEN i = n - 1 THEN size - used
        ELSE least(greatest(1, floor(size * lens[i + 1] / nullif(total, 0)::DOUBLE)::BIGINT), size - used) END AS take FROM e JOIN t ON t.conv_id = e.conv_id WHERE i < n)),
    c AS (SELECT *, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(list_transform(lens[:i], lambda x: floor(size * x / nullif(total, 0)::DOUBLE)::BIGINT)), 0)::BIGINT) AS cuts FROM t)
    SELECT c.conv_id, c.whole, e.parts, CASE WHEN n = 1 THEN [whole]
      WHEN total > 0 AND abs(size - total) <= 2 THEN list_transform(range(0, n), lambda i: substr(whole, cuts[i + 1] + 1, CASE WHEN i = n - 1 THEN size ELSE cuts[i + 2] - cuts[i + 1] END))
      WHEN len(ws) >= n THEN list_transform(range(0, n), lambda i: CASE WHEN i = n - 1 THEN array_to_string(ws[i + 1:], ' ') ELSE ws[i + 1] END)
      ELSE list_transform(range(0, n), lambda i: substr(whole, i * (size // n) + 1, CASE WHEN i = n - 1 THEN size ELSE size // n END)) END AS words
    FROM c JOIN e ON e.conv_id = c.conv_id AND e.i = c.n"""
)
def run_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as runs, their text, as long as it was, longer or shorter, spread over them again."""
    runs = T.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    runs = runs.select("conv_id", F.transform("t", lambda x: x["text"]).alias("runs"))
    joined, third = F.array_join("runs", ""), F.col("conv_id") % 3
    whole = F.when(third == 0, F.translate(joined, "aeiou", "AEIOU")).when(third == 1, F.concat(joined, F.lit(" and some more words at the end"))).otherwise(F.substring(joined, 1, 7))
    lengths = F.transform("runs", lambda x: F.length(x))
    return runs.select("conv_id", whole.alias("whole"), L.distribute_even_tail(lengths, whole).alias("parts"), L.distribute_words(F.col("runs"), whole).alias("words"))


def _merge_sql(longest: int, total: int) -> str:
    return RUNS_SQL.replace("WITH r", "WITH RECURSIVE r", 1) + f""", k AS (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY run_idx) AS k FROM r
      WHERE bounded OR text <> '-'),
    step AS (SELECT para_id, 0::BIGINT AS k, 0 AS part, false AS held, 0 AS size, NULL::VARCHAR AS style, NULL::BIGINT AS run_idx, '' AS text, false AS shown FROM k GROUP BY para_id UNION ALL
      SELECT s.para_id, k.k, s.part + CASE WHEN NOT k.bounded AND (NOT s.held OR NOT joins) THEN 1 ELSE 0 END, NOT k.bounded AND joins,
        CASE WHEN k.bounded OR NOT joins THEN 0 ELSE s.size + length(k.text) END, k.hash, k.run_idx, k.text, NOT k.bounded
      FROM (SELECT s.*, k.k AS kk, length(k.text) <= {longest} AND (NOT s.held OR k.hash = s.style) AND s.size + length(k.text) <= {total} AS joins
        FROM step s JOIN k ON k.para_id = s.para_id AND k.k = s.k + 1) s JOIN k ON k.para_id = s.para_id AND k.k = s.kk)
    SELECT para_id, min(run_idx) AS first_run, count(*)::INTEGER AS runs, string_agg(text, '' ORDER BY run_idx) AS text FROM step WHERE shown GROUP BY para_id, part"""


def _named_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).withColumn("text", F.when(F.col("text") == "", "-").otherwise(F.concat(F.lit("n"), "text")))


NAMED = "CASE WHEN l_quantity < 3 THEN '-' ELSE 'n' || (l_quantity::INT)::VARCHAR END AS text"


def _named(sql: str) -> str:
    return sql.replace("CASE WHEN l_quantity < 3 THEN '' ELSE (l_quantity::INT)::VARCHAR END AS text", NAMED)


@query(_named(_merge_sql(20, 1000)))
def conservative_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_short(_named_runs(spark, sf_dir)).drop("part")


@query(_named(_merge_sql(5, 10)))
def strict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_short(_named_runs(spark, sf_dir), 5, 10).drop("part")


@query(
    """SELECT conv_id AS slide_id, sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')))::BIGINT AS source_chars, sum(length(upper(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) || '..'))::BIGINT AS target_chars
    FROM conversations GROUP BY 1"""
)
def slide_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = T.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("slide_id"), F.col("text").alias("source"), F.concat("text", F.lit("..")).alias("target"))
    return L.slide_totals(texts).drop("scale")


@query(
    """SELECT l_orderkey AS table_id, l_linenumber % 3 AS col, greatest(0.5, least(2.0, max(l_quantity::INT) * 0.1::DOUBLE)) AS inches FROM lineitem GROUP BY 1, 2"""
)
def page_column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") % 3).alias("col"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text")
    )
    return L.column_widths(cells)


@query(
    """WITH c AS (SELECT l_orderkey AS para_id, count(*) AS runs, count(*) FILTER (l_quantity > 25) AS merged FROM lineitem GROUP BY 1)
    SELECT para_id, printf('%d.%d%%', tenths // 10, tenths % 10) AS rate FROM (SELECT para_id, (2000 * merged + runs) // (2 * runs) AS tenths FROM c)"""
)
def merge_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("para_id")).agg(F.count("*").alias("runs"), F.count_if(F.col("l_quantity") > 25).alias("merged"))
    return runs.select("para_id", L.optimisation_rate(F.col("merged"), F.col("runs")).alias("rate"))


@query(
    """WITH b AS (SELECT l_orderkey AS page, place AS id, (l_partkey % 500)::DOUBLE AS x0, (l_suppkey % 300)::DOUBLE AS y0, (l_partkey % 500)::DOUBLE + 120 AS x1, (l_suppkey % 300)::DOUBLE + 30 AS y1,
      (l_linenumber + 8)::DOUBLE AS size, l_quantity::INT AS n, (l_partkey % 90)::INT AS chars, count(*) OVER (PARTITION BY l_orderkey) = 1 AS alone,
      CASE WHEN l_quantity::INT > 0 THEN (l_partkey % 90)::DOUBLE / l_quantity::INT END AS r FROM placed),
    s AS (SELECT *, floor(greatest(size * 0.6::DOUBLE, size / r)) AS small FROM b WHERE r > 1.2),
    l AS (SELECT *, greatest(floor(chars / greatest(floor(120 / (small * 0.6::DOUBLE)), 1)) + 1, 1) AS lines FROM s WHERE small > 0),
    t AS (SELECT *, lines * small * 1.2::DOUBLE AS needed, y0 + least(lines * small * 1.2::DOUBLE, 30 * CASE WHEN alone THEN 1.3 ELSE 1.5 END::DOUBLE) AS test FROM l),
    h AS (SELECT *, NOT alone AND needed > 30 AND EXISTS (SELECT 1 FROM b o WHERE o.page = t.page AND o.id <> t.id AND least(t.x1, o.x1) - greatest(t.x0, o.x0) > 2 AND least(t.test, o.y1) - greatest(t.y0, o.y0) > 2) AS tight,
      coalesce((SELECT min(least(30, 30 + o.y0 - t.y1 - 2)) FROM b o WHERE o.page = t.page AND o.id <> t.id AND o.y0 > t.y0 AND o.y0 > t.y1), 30) AS safe FROM t),
    f AS (SELECT *, greatest(floor(safe / (small * 1.2::DOUBLE)), 1) AS safe_lines FROM h),
    g AS (SELECT *, CASE WHEN tight AND safe_lines < lines THEN floor(greatest(size * 0.5::DOUBLE, small * (safe_lines / lines))) ELSE small END AS fitted,
      CASE WHEN needed <= 30 THEN y0 + needed WHEN tight THEN y0 + safe ELSE test END AS bottom FROM f),
    c AS (SELECT *, NOT alone AND EXISTS (SELECT 1 FROM b o WHERE o.page = g.page AND o.id <> g.id AND least(g.x1, o.x1) - greatest(g.x0, o.x0) > 2 AND least(g.bottom, o.y1) - greatest(g.y0, o.y0) > 2) AS still FROM g)
    SELECT page, id, CASE WHEN still THEN floor(greatest(size * 0.5::DOUBLE, size / r)) ELSE fitted END AS font, CASE WHEN still THEN y1 ELSE bottom END AS y1 FROM c
    UNION ALL SELECT page, id, CASE WHEN r > 0 AND r < 0.8 THEN floor(least(size * 1.2::DOUBLE, size / r)) ELSE size END, y1 FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.page = b.page AND l.id = b.id)"""
    .replace("FROM placed", f"FROM {LINES_SQL}")
)
def box_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as the text boxes of a page, their new texts longer or shorter."""
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 300).cast("double")
    boxes = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), F.col("place").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 120).alias("x1"), (y0 + 30).alias("y1"),
        (F.col("l_linenumber") + 8).alias("font"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("source"),
        F.repeat(F.lit("y"), (F.col("l_partkey") % 90).cast("int")).alias("target"),
    )
    return L.fit_boxes(boxes)
