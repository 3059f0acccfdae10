"""Scalars, filters and assembly that the other modules' queries do not reach, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.functions import labels, times
from lodestitch.functions import text as X
from lodestitch.operators import glossary as G
from lodestitch.operators import jobs as J
from lodestitch.operators import layout as L
from lodestitch.operators import segmenting as S
from lodestitch.operators import translation as R
from lodestitch.plans.text_queries import MD_SQL, PUNCT, TOPK_SQL, _sentences
from lodestitch.sources import files
from lodestitch.sources import tables as T
from lodestitch.sources.shared import shared_path
from lodestitch.streaming import jobs as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _q(text: str) -> str:
    return text.replace("'", "''")


def _case(value: str, table: dict[str, str], other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{X.SPACE}]+', ''), '[{X.SPACE}]+$', '')"


LANGS_SQL = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 7 = 0 THEN '德文' WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS code FROM documents)"


@query(
    f"""SELECT doc_id, {_case("lower(code)", labels.LANGUAGE_NAMES, "code")} AS name, {_case(_case("lower(code)", labels.LANGUAGE_NAMES, "code"), labels.LANGUAGE_CODES, "'en'")} AS code,
    CASE WHEN code = '德文' THEN 'de' END AS own FROM {LANGS_SQL}"""
)
def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of language codes, codes of names."""
    n, lang = F.col("doc_id"), F.col("lang")
    code = F.when(n % 3 == 0, F.upper(lang)).when(n % 7 == 0, "德文").when(n % 11 == 0, "xx").otherwise(lang)
    docs = T.table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))
    name = labels.language_name(F.col("code"))
    own = F.when(F.col("code") == "德文", labels.language_code(F.col("code")))
    return docs.select("doc_id", name.alias("name"), labels.language_code(name).alias("code"), own.alias("own"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderstatus = 'O' THEN 'enabled' ELSE 'disabled' END AS status,
    CASE WHEN o_orderkey % 4 = 0 THEN '--' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS seen, date_diff('second', o_orderdate::TIMESTAMP, TIMESTAMP '2002-01-01 05:00:00') // 86400 AS days,
    date_diff('second', o_orderdate::TIMESTAMP, TIMESTAMP '2002-01-01 05:00:00') % 86400 // 3600 AS hours, strftime(o_orderdate::TIMESTAMP + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') AS shanghai FROM orders"""
)
def status_and_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective status, dates or dashes, uptime, local time."""
    at = F.col("o_orderdate").cast("timestamp_ntz")
    deleted = F.when(F.col("o_orderkey") % 5 == 0, "Y").otherwise("N")
    status = F.when(F.col("o_orderstatus") == "O", "enabled").otherwise("disabled")
    up = times.uptime(at, F.lit("2002-01-01 05:00:00").cast("timestamp_ntz"))
    return T.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), labels.effective_status(deleted, status).alias("status"), times.date_or_dashes(F.when(F.col("o_orderkey") % 4 != 0, at)).alias("seen"),
        up["days"].cast("long").alias("days"), up["hours"].cast("long").alias("hours"), times.to_shanghai(at).alias("shanghai"),
    )


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'process' ELSE 'queued' END AS status, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1 HAVING status <> 'changing'")
def live_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status without the soft-deleted ones."""
    jobs = T.jobs(spark, sf_dir).withColumn("deleted_flag", F.when(F.col("id") % 7 == 0, "Y").otherwise("N"))
    return J.live(jobs).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'Re') OR contains(p_type, 'BRASS') UNION SELECT p_partkey FROM part WHERE contains(p_name, 're') AND p_partkey % 2 = 0")
def case_sensitive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search that minds the case, over several columns."""
    part = T.table(spark, sf_dir, "part")
    by_type = J.matching(part, ["p_name", "p_type"], "BRASS", case=True).unionByName(J.matching(part, ["p_name"], "Re", case=True))
    return by_type.unionByName(J.matching(part.where("p_partkey % 2 = 0"), ["p_name"], "re", case=True)).select("p_partkey").distinct()


@query(
    """WITH w AS (SELECT user_id AS owner, event_type AS source, ts::DATE AS url, hour(ts) % 3 AS target FROM events)
    SELECT owner, url, source, count(*) AS n FROM w WHERE target IN (0, 1) GROUP BY ALL HAVING count(*) > 1"""
)
def repeated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of one owner, file and source language whose target is one of those asked for."""
    jobs = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("source"), F.to_date("ts").alias("url"), (F.hour("ts") % 3).alias("target"))
    return J.duplicate_groups(jobs.where(F.col("target").isin(0, 1)), ["owner", "url", "source"])


@query("SELECT o_orderkey AS id, o_totalprice AS size FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, appended to and read back."""
    path, jobs = shared_path(spark, "rows"), T.jobs(spark, sf_dir).select("id", "size")
    files.write_rows(jobs.where("id % 2 = 0"), path, "overwrite")
    files.write_rows(jobs.where("id % 2 = 1"), path)
    return spark.read.schema(jobs.schema).parquet(path)


EDGES_SQL = "(SELECT conv_id, turn, repeat(' ', (turn % 3)::INTEGER) || substr(text, 1, 30) || repeat(' ', (turn % 2)::INTEGER) AS s, ' ' || text AS t, text FROM conversations)"


@query(
    f"""WITH e AS (SELECT *, length(s) - length(ltrim(s, ' ')) AS sl, length(s) - length(rtrim(s, ' ')) AS sr, length(t) - length(ltrim(t, ' ')) AS tl, length(t) - length(rtrim(t, ' ')) AS tr FROM {EDGES_SQL})
    SELECT conv_id, turn, repeat(' ', greatest(sl - tl, 0)::INTEGER) || t || repeat(' ', greatest(sr - tr, 0)::INTEGER) AS padded,
    '  ' || regexp_replace(regexp_replace(t, '^[ \\t\\x{{a0}}]+', ''), '[ \\t\\x{{a0}}]+$', '') || chr(9) AS restored,
    regexp_replace('♂ ' || substr(text, 1, 12) || ' ♂ z', '♂ (.+?) ♂', '♂\\1 ♂', 'g') AS cleaned, turn % 5 = 0 AS private FROM e"""
)
def edge_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks at the ends padded or put back, blanks at placeholders, private-use characters."""
    t, turn = F.col("text"), F.col("turn")
    source = F.concat(F.repeat(F.lit(" "), (turn % 3).cast("int")), F.substring(t, 1, 30), F.repeat(F.lit(" "), (turn % 2).cast("int")))
    target = F.concat(F.lit(" "), t)
    marked = F.concat(F.lit("♂ "), F.substring(t, 1, 12), F.lit(" ♂ z"))
    icon = F.concat(t, F.when(turn % 5 == 0, F.lit("")).otherwise(F.lit("")))
    return T.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.pad_edges(source, target).alias("padded"), X.restore_edges(target, F.lit("  "), F.lit("\t")).alias("restored"),
        X.clean_placeholder_spaces(marked).alias("cleaned"), X.has_private_use(icon).alias("private"),
    )


@query(
    f"""WITH l AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' --- ' || p_size WHEN p_partkey % 3 = 1 THEN ' ' || p_size ELSE '' END AS x FROM part)
    SELECT p_partkey, regexp_extract(x, '[{X.SPACE}\\-—_]+\\p{{Nd}}+$', 0) AS page, substr(x, 1, length(x) - length(regexp_extract(x, '[{X.SPACE}\\-—_]+\\p{{Nd}}+$', 0))) AS main FROM l"""
)
def contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a table of contents as entry and page."""
    third = F.col("p_partkey") % 3
    line = F.concat("p_name", F.when(third == 0, F.concat(F.lit(" --- "), "p_size")).when(third == 1, F.concat(F.lit(" "), "p_size")).otherwise(F.lit("")))
    return T.table(spark, sf_dir, "part").select("p_partkey", X.toc_parts(line).alias("c")).select("p_partkey", "c.page", "c.main")


@query(
    """SELECT conv_id, turn, 'Translate to ' || role || ': ' || substr(text, 1, 20) AS prompt,
    CASE WHEN turn % 3 = 0 THEN 'http://h/v1/x' WHEN turn % 3 = 1 THEN 'http://h/v1/' ELSE 'http://h' || '/v1/' END AS url FROM conversations"""
)
def prompt_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled prompts and API addresses."""
    url = F.when(F.col("turn") % 3 == 0, "http://h/v1/x").when(F.col("turn") % 3 == 1, "http://h/").otherwise("http://h")
    template = F.concat(F.lit("Translate to {target_lang}: "), F.substring("text", 1, 20))
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.fill_prompt(template, F.col("role")).alias("prompt"), X.normal_api_url(url).alias("url"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, md5('[{"key":"bold","value":"' || l_returnflag || '"},{"key":"size","value":"' || l_linenumber || '"}]') AS style FROM lineitem"""
)
def style_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("size"), F.col("l_linenumber").cast("string"), F.lit("bold"), F.col("l_returnflag"))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", L.style_hash(props).alias("style"))


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity::INT % 7 + 1) / (l_linenumber)::DOUBLE AS r, l_suppkey % 3 + 1.0::DOUBLE AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN r > 1.1 THEN least(s * 1.5::DOUBLE, s * r) WHEN r < 0.9 THEN greatest(s * 0.8::DOUBLE, s * r) ELSE s END, 6) AS spacing FROM t"""
)
def line_spacings(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = F.repeat(F.lit("\n"), F.col("l_quantity").cast("int") % 7), F.repeat(F.lit("\n"), F.col("l_linenumber").cast("int") - 1)
    spacing = L.line_spacing(source, target, (F.col("l_suppkey") % 3 + 1).cast("double"))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(spacing, 6).alias("spacing"))


WORDS_SQL = f"(SELECT DISTINCT unnest(string_split_regex(text, '[{X.SPACE}]+')) AS w FROM documents)"
#: Of the sign list only what the documents can hold matters to these; the list itself is tested by hand.
_SIGNS = "★☆♥♦♣♠♀♂✓✔✕✖∞∑∏πΠ±×÷√"
_SHORT = "(regexp_full_match(w, '[一-鿿]*') OR regexp_full_match(w, '\\p{Nd}+') OR regexp_full_match(w, '[•℃VAhH]*') OR (length(w) = 2 AND regexp_matches(w, '[一-鿿]')))"
_NUMBERS = "regexp_matches(w, '" + _q(X.NUMBERS) + "')"
_PUNCT = "regexp_full_match(w, '" + _q(X.PUNCTUATION_ONLY) + "')"
_TITLE = "regexp_matches(w, '^\\p{Nd}+(?:\\.\\p{Nd}+)*\\.?$')"


@query(
    f"""SELECT w AS word, w <> '' AND ({_TITLE} OR NOT {_NUMBERS} AND NOT regexp_full_match(w, '[{_SIGNS}]+')) AS run,
    w <> '' AND ({_TITLE} OR regexp_matches(w, '^[\\p{{L}}\\p{{N}}]') OR NOT (length(w) <= 3 AND NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}]')) AND NOT {_NUMBERS} AND NOT {_PUNCT}
      AND NOT regexp_full_match(w, '[{_SIGNS}]+')) AS paragraph,
    CASE WHEN w = '' THEN 'empty' WHEN length(w) <= 2 THEN CASE WHEN {_SHORT} THEN 'short, allowed' ELSE 'short' END WHEN regexp_full_match(w, '[{_SIGNS}]+') THEN 'symbols' WHEN {_NUMBERS} THEN 'numbers'
      WHEN {_PUNCT} THEN 'punctuation' ELSE 'other' END AS reason FROM {WORDS_SQL}"""
)
def word_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What document filters say of each word, and why spans are left alone."""
    words = T.table(spark, sf_dir, "documents").select(F.explode(F.split("text", f"[{X.SPACE}]+")).alias("word")).distinct()
    w = F.col("word")
    return words.select("word", X.word_should_translate(w).alias("run"), X.word_check_text(w).alias("paragraph"), X.pdf_skip_reason(w).alias("reason"))


def _hints_sql(text: str) -> str:
    for p in X.HINTS:
        text = f"regexp_replace({text}, '(?is){_q(p)}', '', 'g')"
    text = f"regexp_replace({text}, '(?i)^(领域提示|Domain Hint|领域说明|Domain Description)[:：][{X.SPACE}]*', '')"
    text = f"regexp_replace({text}, '\\n[{X.SPACE}]*\\n', chr(10), 'g')"
    return _strip(f"replace(regexp_replace({text}, '(?m)^[{X.SPACE}]+|[{X.SPACE}]+$', '', 'g'), '♦', '')")


HINTED_SQL = """CASE WHEN turn % 3 = 0 THEN 'Domain Hint: ' || text WHEN turn % 3 = 1 THEN text || chr(10) || '  ' || chr(10) || 'heavy machinery and construction equipment' || chr(10) || 'end ♦ ' ELSE '政府の公文書' || text END"""


@query(f"SELECT conv_id, turn, {_hints_sql(HINTED_SQL)} AS text FROM conversations")
def hints_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that repeat the prompt's hints, without them."""
    third, t = F.col("turn") % 3, F.col("text")
    hinted = F.when(third == 0, F.concat(F.lit("Domain Hint: "), t)).when(third == 1, F.concat(t, F.lit("\n  \nheavy machinery and construction equipment\nend ♦ "))).otherwise(F.concat(F.lit("政府の公文書"), t))
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.remove_hints(hinted).alias("text"))


@query(
    """SELECT conv_id, turn, CASE WHEN text = '' THEN '' WHEN turn % 3 = 0 THEN '12. ' || ltrim(text, ' ') WHEN turn % 3 = 1 THEN chr(61623) || 'a ' || ltrim(text, ' ') ELSE text END AS text FROM conversations
    WHERE regexp_matches(text, '^[A-Za-z]')"""
)
def leading_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and icons that an answer lost, put back."""
    third, t = F.col("turn") % 3, F.col("text")
    source = F.when(third == 0, F.concat(F.lit("12. "), t)).when(third == 1, F.lit(" x")).otherwise(t)
    target = F.when(third == 1, F.concat(F.lit("a "), t)).otherwise(t)
    return T.table(spark, sf_dir, "conversations").where(t.rlike("^[A-Za-z]")).select("conv_id", "turn", X.restore_numbering(source, target).alias("text"))


MD_PARTS_SQL = MD_SQL.replace("WITH l", "WITH RECURSIVE l", 1) + f""", e AS (SELECT doc_id, line AS para, c AS body, type IN ('text', 'table_row') AND c <> '' AND NOT regexp_full_match(c, '{PUNCT}') AND length(c) > 1000 AS long FROM t),
    packed_from AS (SELECT doc_id, para, {_sentences("body")} AS ss FROM e WHERE long),
    step AS (SELECT doc_id, para, ss, 0 AS i, 0 AS part, 0 AS open_part, 0 AS size, false AS held FROM packed_from UNION ALL
      SELECT doc_id, para, ss, i + 1, CASE WHEN size + n <= 1000 OR NOT held THEN open_part ELSE open_part + 1 END, CASE WHEN size + n <= 1000 THEN open_part ELSE open_part + 1 END,
        CASE WHEN size + n <= 1000 THEN size + n WHEN held THEN n ELSE 0 END, size + n <= 1000 OR held FROM (SELECT *, length(ss[i + 1]) AS n FROM step WHERE i < len(ss))),
    parts AS (SELECT doc_id, para, part, string_agg(ss[i], ' ' ORDER BY i) AS text FROM step WHERE i > 0 GROUP BY doc_id, para, part UNION ALL SELECT doc_id, para, 0, body FROM e WHERE NOT long)"""


@query(MD_PARTS_SQL + " SELECT doc_id, string_agg(text, chr(10) ORDER BY para, part) AS text FROM parts GROUP BY doc_id")
def markdown_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown segments, long lines in parts, put together again (no document here has a code block of several lines)."""
    return S.assemble_md(S.md_segments(T.table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(
    TOPK_SQL
    + """ SELECT doc_id, seg_idx, string_agg(source || ': ' || target, chr(10) ORDER BY rank) AS terms, count(*) AS pairs, max(CASE WHEN rank = 1 THEN target END) AS first
    FROM r WHERE rank <= 10 GROUP BY 1, 2"""
)
def term_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms as lines of a prompt, and parsed again."""
    lists = G.term_list(G.relevant_terms(T.segments(spark, sf_dir), G.merge_bases(T.terms(spark, sf_dir)), fuzzy=False))
    parsed = G.parse_term_list(F.col("terms"))
    return lists.select("doc_id", "seg_idx", "terms", F.size(parsed).cast("long").alias("pairs"), parsed[0]["target"].alias("first"))


@query(
    """SELECT o_orderkey AS id, [o_custkey::BIGINT, o_orderkey::BIGINT] AS ids, o_orderstatus AS source, o_orderpriority AS target FROM orders"""
)
def parsed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id lists and the older term form, parsed."""
    ids = G.parse_ids(F.concat_ws(", ", "o_custkey", F.lit("x1"), "o_orderkey", F.lit("")))
    content = G.parse_content(F.concat(F.lit("none; "), "o_orderstatus", F.lit(": "), "o_orderpriority", F.lit(" ;")))
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ids.alias("ids"), content[0]["source"].alias("source"), content[0]["target"].alias("target"))


@query("SELECT conv_id AS doc_id, turn AS seg_idx, CASE WHEN turn % 4 = 0 THEN text ELSE 't:' || text END AS text FROM conversations")
def missing_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a translation is missing or empty the original stays."""
    segments = T.segments(spark, sf_dir)
    done = segments.select("doc_id", "seg_idx", F.when(F.col("seg_idx") % 8 == 0, "").when(F.col("seg_idx") % 4 != 0, F.concat(F.lit("t:"), "text")).alias("translated"))
    return R.with_originals(segments, done)


@query("SELECT conv_id AS doc_id, turn AS seg_idx, text AS translated FROM conversations")
def stream_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments translated in micro-batches, each written once."""
    source, out = shared_path(spark, "segments"), shared_path(spark, "translated")
    segments = T.segments(spark, sf_dir).select("doc_id", "seg_idx", "text")
    segments.write.parquet(source)
    stream = spark.readStream.schema(segments.schema).parquet(source)
    work = lambda batch: batch.select("doc_id", "seg_idx", F.col("text").alias("translated"))
    streams.translate_stream(stream, out, shared_path(spark, "translated-state"), work).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "seg_idx", "translated")
