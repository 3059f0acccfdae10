"""Queries of text, layout and file rules that the others do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestitch.functions import text as X
from lodestitch.operators import jobs as J
from lodestitch.operators import layout as L
from lodestitch.operators import segmenting as S
from lodestitch.plans.text_queries import PUNCT, _strip
from lodestitch.sources import files
from lodestitch.sources import tables as T
from lodestitch.sources.shared import shared_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "conversations")


@query(
    f"""WITH t AS (SELECT conv_id AS doc_id, turn, {_strip("replace(text, 'en', '工')")} AS b FROM conversations), s AS (SELECT doc_id, b FROM t WHERE turn < 5 UNION ALL SELECT doc_id, b FROM t WHERE turn % 4 < 2 AND turn % 5 < 3 AND turn // 2 < 3)
    SELECT doc_id, sum(length(b))::BIGINT AS chars, sum(len(regexp_extract_all(b, '[\\x{{4e00}}-\\x{{9fff}}]')))::BIGINT AS cjk,
      coalesce(sum(len(regexp_extract_all(b, '[\\x{{4e00}}-\\x{{9fff}}]'))) / nullif(sum(length(b)), 0)::DOUBLE, 0.0) AS ratio FROM s GROUP BY doc_id"""
)
def sampled_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as paragraphs and as cells of tables; a syllable stands for a sign."""
    t = _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), "turn", F.replace("text", F.lit("en"), F.lit("工")).alias("text"))
    cells = t.select("doc_id", (F.col("turn") % 4).alias("tbl"), (F.col("turn") % 5).alias("row"), F.floor(F.col("turn") / 2).alias("col"), "text")
    return S.sampled_cjk_ratio(t.select("doc_id", F.col("turn").alias("para"), "text"), cells)


@query(
    f"""WITH w AS (SELECT DISTINCT unnest([text, regexp_replace(text, '[A-Za-zÀ-ɏ]', '', 'g'), chr(10), '']) AS t FROM conversations)
    SELECT t AS text, t <> '' AND NOT regexp_full_match(t, '{PUNCT}') AS plain, t <> '' AND t <> chr(10) AND NOT regexp_full_match(t, '{PUNCT}') AS markdown, NOT regexp_full_match(t, '{PUNCT}') AS cell FROM w"""
)
def format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text needs translation, by format."""
    forms = F.array("text", F.regexp_replace("text", "[A-Za-zÀ-ɏ]", ""), F.lit("\n"), F.lit(""))
    t = F.col("text")
    words = _turns(spark, sf_dir).select(F.explode(forms).alias("text")).distinct()
    return words.select("text", X.needs_translation(t).alias("plain"), X.md_needs_translation(t).alias("markdown"), X.cell_needs_translation(t).alias("cell"))


@query(
    f"""SELECT conv_id, turn, replace(replace('Into {{target_lang}}, as {{role}}.' || CASE WHEN turn % 2 = 0 THEN '{X.MARKDOWN_RULE}' ELSE '' END || CASE WHEN turn % 3 = 0 THEN '{X.CONTEXT_RULE}' ELSE '' END,
      '{{role}}', role), '{{target_lang}}', CASE WHEN turn % 5 = 0 THEN 'fr' ELSE 'de' END) AS prompt FROM conversations"""
)
def prompts_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with the markdown and context rules, a slot and the language."""
    turn = F.col("turn")
    text = F.when(turn % 3 == 0, F.concat(F.lit("[前文: x] "), "text")).otherwise(F.regexp_replace("text", r"\[", "("))
    language = F.when(turn % 5 == 0, "fr").otherwise("de")
    prompt = X.build_prompt(F.lit("Into {target_lang}, as {role}."), language, text, turn % 2 == 0, {"role": F.col("role")})
    return _turns(spark, sf_dir).select("conv_id", "turn", prompt.alias("prompt"))


@query(
    """WITH j AS (SELECT DISTINCT o_custkey, o_orderpriority, o_orderkey % 5 AS lang FROM orders WHERE o_orderstatus <> 'F')
    SELECT o_orderkey AS id, EXISTS (SELECT 1 FROM j WHERE j.o_custkey = o.o_custkey AND j.o_orderpriority = o.o_orderpriority AND j.lang IN (o.o_orderkey % 5, (o.o_orderkey + 2) % 5)) AS duplicate
    FROM orders o WHERE o_orderstatus = 'F'"""
)
def requests_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a live job of the same owner answers already, in one of their two languages."""
    o = T.table(spark, sf_dir, "orders")
    key = [F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("url"), F.lit("en").alias("source_lang")]
    lang = lambda n: ((F.col("o_orderkey") + n) % 5).cast("string")
    requests = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), *key, F.array(lang(0), lang(2)).alias("languages"))
    return J.duplicate_requests(requests, o.where("o_orderstatus <> 'F'").select(*key, lang(0).alias("language"))).select("id", "duplicate")


@query(
    f"""WITH s AS (SELECT conv_id AS slide_id, sum(length({_strip("text")})) AS a FROM conversations WHERE conv_id % 7 <> 0 GROUP BY 1), t AS (SELECT conv_id AS slide_id, sum(length({_strip("text || CASE WHEN conv_id % 3 = 0 THEN text ELSE '!' END")})) AS b FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1)
    SELECT coalesce(s.slide_id, t.slide_id) AS slide_id, coalesce(a, 0)::BIGINT AS source_chars, coalesce(b, 0)::BIGINT AS target_chars FROM s FULL JOIN t ON t.slide_id = s.slide_id"""
)
def slides_of_two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of a source and a translated file, some in one of them only."""
    t = _turns(spark, sf_dir).withColumnRenamed("conv_id", "slide_id")
    longer = F.concat("text", F.when(F.col("slide_id") % 3 == 0, F.col("text")).otherwise("!"))
    return L.slide_scales(t.where("slide_id % 7 <> 0"), t.where("slide_id % 5 <> 0").withColumn("text", longer)).drop("scale")


@query(
    """WITH c AS (SELECT conv_id AS doc_id, turn AS "row", list_filter(string_split_regex(text, '[""" + X.SPACE + """]+'), lambda w: w <> '') AS ws FROM conversations),
    p AS (SELECT doc_id, "row", unnest(ws) AS w FROM c) SELECT doc_id, "row", count(*) AS words, sum(length(w))::BIGINT AS chars FROM p GROUP BY ALL"""
)
def cell_words_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells packed to 40 characters: no word is lost or changed, and no part is longer unless one word is."""
    parts = _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("row"), F.explode(X.pack_cell_words(F.col("text"), 40)).alias("part"))
    words = parts.select("doc_id", "row", "part", F.explode(F.split("part", " ")).alias("w")).where("w != ''")
    fits = words.where((F.length("part") <= 40) | ~F.contains("part", F.lit(" ")))
    return fits.groupBy("doc_id", "row").agg(F.count("*").alias("words"), F.sum(F.length("w")).cast("bigint").alias("chars"))


@query(
    f"""SELECT conv_id AS doc_id, turn AS "row", CASE WHEN NOT regexp_full_match(text, '{PUNCT}') THEN '<' || text || '>' ELSE text END AS cell FROM conversations"""
)
def cells_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated items back in the cells that took part, in order."""
    cells = _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("sheet"), F.col("turn").alias("row"), F.lit(0).alias("col"), F.col("text").alias("cell"))
    needed = X.cell_needs_translation(F.col("cell"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet", "row", "col")) - 1
    items = cells.where(needed).select("doc_id", nth.alias("nth"), F.concat(F.lit("<"), "cell", F.lit(">")).alias("text"))
    return files.fill_cells(cells, items, needed).select("doc_id", "row", "cell")


@query("""SELECT conv_id::VARCHAR AS path, turn::VARCHAR AS unit_id, CASE WHEN turn % 2 = 0 THEN text || '*' ELSE text END AS target FROM conversations""")
def units_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with the targets that there are, by unit id."""
    units = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("string").alias("unit_id"), F.col("text").alias("source"), (F.col("turn") % 2 == 0).alias("done"))
    targets = units.where("done").select("path", "unit_id", F.concat("source", F.lit("*")).alias("target"))
    return files.join_units(units.drop("done"), targets).select("path", "unit_id", "target")


@query("""SELECT source AS category, count(*) AS rows_in, 1::BIGINT AS expired FROM documents WHERE source IS NOT NULL GROUP BY source""")
def expired_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a store that have run out two days on; none has by now."""
    path = shared_path(spark, "aging")
    docs = T.table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    docs.select("source", F.col("n").cast("string").alias("value")).repartition("source").write.partitionBy("source").text(path)
    listed = files.read_bytes(spark, path, "part-*")
    category = F.regexp_extract("path", "source=([^/]*)/", 1).alias("category")
    late = files.expired_files(listed, F.current_timestamp() + F.expr("INTERVAL 48 HOURS")).groupBy(category).agg(F.count("*").alias("expired"))
    early = files.expired_files(listed, F.current_timestamp()).groupBy(category).agg(F.count("*").alias("gone"))
    return docs.select(F.col("source").alias("category"), F.col("n").alias("rows_in")).join(late, "category", "left").join(early, "category", "left_anti")


_MARKUP = """'<w:rFonts w:font-family="Arial" size="3"/> in Simsun or 宋体 ' || CASE WHEN turn % 4 = 0 THEN chr(61700) ELSE '' END || text"""


@query(
    f"""WITH m AS (SELECT conv_id, turn, {_MARKUP} AS c, CASE WHEN turn % 3 = 0 THEN 'EN' WHEN turn % 3 = 1 THEN 'English' ELSE 'de' END AS lang FROM conversations)
    SELECT conv_id, turn, CASE WHEN lang <> 'de' AND NOT regexp_matches(c, '[{X.ICONS}]') THEN
      regexp_replace(regexp_replace(c, '(?i){X.FONT_ATTRIBUTE}', '\\1{X.LATIN_FONT}\\2', 'g'), '(?i)(?:{"|".join(X.FONT_NAMES)})', '{X.LATIN_FONT}', 'g') ELSE c END AS content FROM m"""
)
def fonts_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup with fonts in attributes and by name, some of it with icons, for several targets."""
    icon = F.when(F.col("turn") % 4 == 0, chr(61700)).otherwise("")
    content = F.concat(F.lit('<w:rFonts w:font-family="Arial" size="3"/> in Simsun or 宋体 '), icon, F.col("text"))
    language = F.when(F.col("turn") % 3 == 0, "EN").when(F.col("turn") % 3 == 1, "English").otherwise("de")
    return _turns(spark, sf_dir).select("conv_id", "turn", X.english_fonts(content, language).alias("content"))


@query(
    """SELECT l_orderkey AS para_id, count(*) AS runs, count(*) FILTER (l_linenumber % 4 = 1 OR l_linenumber % 5 = 2) AS bounded FROM lineitem GROUP BY 1"""
)
def bounded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a boundary of any kind; a flag of another name is none."""
    n = F.col("l_linenumber")
    flags = F.map_from_arrays(F.array(F.lit("has_tab"), F.lit("has_math"), F.lit("is_bold")), F.array(n % 4 == 1, F.when(n % 5 == 2, True), n % 2 == 0))
    return T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("para_id")).agg(F.count("*").alias("runs"), F.count_if(L.is_bounded(flags)).alias("bounded"))


@query(
    """SELECT p_brand AS base, 'source,target' || chr(10) || string_agg(p_name || ',' || p_type, chr(10) ORDER BY p_partkey DESC) || chr(10) AS text FROM part GROUP BY 1"""
)
def glossary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A csv file for each term base, written and read back."""
    path = shared_path(spark, "glossaries")
    terms = T.terms(spark, sf_dir)
    files.write_glossaries(files.export_glossary(terms.select("base").distinct(), terms), path)
    read = files.read_bytes(spark, path, "part-*")
    return read.select(F.regexp_replace(F.regexp_extract("path", "base=([^/]*)/", 1), "%23", "#").alias("base"), F.col("content").cast("string").alias("text"))
