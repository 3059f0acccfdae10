"""Further queries: states, quotas, uploads, masks, chunks and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.functions import labels, times
from lodestitch.functions import text as X
from lodestitch.operators import jobs as J
from lodestitch.operators import queueing as Q
from lodestitch.operators import segmenting as S
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


@query(
    """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'submitted' END AS state,
    CASE WHEN event_type = 'error' THEN 'E' || (user_id % 3) || ': ' || event_type WHEN event_type = 'click' THEN event_type ELSE NULL END AS error FROM events"""
)
def media_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote image states and their error texts."""
    kind = F.col("event_type")
    remote = F.when(kind == "purchase", "SUCCEEDED").when(kind == "error", "FAILED").otherwise("RUNNING")
    code = F.when(kind == "error", F.concat(F.lit("E"), (F.col("user_id") % 3).cast("string"))).otherwise("")
    message = F.when(kind.isin("error", "click"), kind)
    return T.table(spark, sf_dir, "events").select("event_id", Q.image_state(remote, F.lit("submitted")).alias("state"), Q.image_error(code, message).alias("error"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN max(l_linenumber) % 3 = 0 THEN 'completed' WHEN max(l_linenumber) % 3 = 1 THEN 'failed' ELSE 'process' END AS status,
    CASE WHEN max(l_linenumber) % 3 = 0 THEN max(l_shipdate) + INTERVAL 7 DAY END AS expires_at
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def video_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callbacks that name a job by id and remote id."""
    jobs = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7).alias("remote_id"), F.lit("process").alias("status"))
    calls = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linenumber").alias("n"), F.max("l_shipdate").alias("called_at"))
    remote = F.element_at(F.array(F.lit(3), F.lit(4), F.lit(2)), F.col("n") % 3 + 1)
    calls = calls.select("id", (F.col("id") * 7).alias("remote_id"), remote.alias("remote_status"), "called_at")
    return Q.video_callback(jobs, calls).select("id", "status", "expires_at")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 40.0 END::DOUBLE AS progress,
    (CASE o_orderkey % 5 WHEN 0 THEN least(90, floor((o_orderkey % 70) / 60.0::DOUBLE * 90)) WHEN 1 THEN 95 WHEN 2 THEN 98 WHEN 3 THEN 100 ELSE 0 END)::INTEGER AS conversion FROM orders"""
)
def job_end_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late failure does not overwrite a finished job; progress of conversions by phase."""
    jobs = T.jobs(spark, sf_dir)
    state = Q.final_state(F.col("status"), F.lit("failed"))
    phase = F.element_at(F.array(*[F.lit(p) for p in ("parse", "export", "download", "converted", "translate")]), (F.col("id") % 5 + 1).cast("int"))
    return jobs.select(
        "id", state.alias("status"), Q.final_progress(F.lit(40.0), state).alias("progress"), Q.conversion_progress(phase, F.col("id") % 70).alias("conversion")
    )


@query(
    """SELECT c_custkey AS customer_id, c_acctbal + 500 > 8000 AS exceeded,
    CASE WHEN c_acctbal + 500 > 8000 THEN printf('%.2f', (c_acctbal + 500) / 1073741824.0::DOUBLE) || ' > ' || printf('%.2f', 8000 / 1073741824.0::DOUBLE) END AS message FROM customer"""
)
def quota_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = J.quota_exceeded(F.col("storage"), F.lit(500.0), F.lit(8000.0))
    return T.memberships(spark, sf_dir).select("customer_id", check.alias("q")).select("customer_id", "q.exceeded", "q.message")


@query(
    """SELECT p_partkey, round((p_partkey * 977 >> 16 & 255) / 255.0::DOUBLE, 6) AS r, round((p_partkey * 977 >> 8 & 255) / 255.0::DOUBLE, 6) AS g,
    round((p_partkey * 977 & 255) / 255.0::DOUBLE, 6) AS b FROM part"""
)
def font_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = times.font_rgb(F.col("p_partkey") * 977)
    return T.table(spark, sf_dir, "part").select("p_partkey", rgb.alias("c")).select("p_partkey", *[F.round(f"c.{x}", 6).alias(x) for x in "rgb"])


@query(
    """WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.exe' WHEN 2 THEN '' ELSE '.pdf' END AS name FROM part)
    SELECT p_partkey, p_partkey % 4 IN (0, 3) AS allowed, CASE WHEN p_partkey % 4 = 3 THEN regexp_replace(name, '\\.pdf$', '.docx') ELSE name END AS shown,
    CASE WHEN p_partkey % 4 = 2 THEN name || '_' || p_partkey ELSE regexp_replace(name, '(\\.[^.]*)$', '_' || p_partkey || '\\1') END AS stored FROM n"""
)
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed uploads, the name shown for a converted PDF, and the name stored on collision."""
    suffix = F.element_at(F.array(F.lit(".DOCX"), F.lit(".exe"), F.lit(""), F.lit(".pdf")), (F.col("p_partkey") % 4 + 1).cast("int"))
    named = T.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", suffix).alias("name"))
    name = F.col("name")
    return named.select(
        "p_partkey", labels.may_upload(name).alias("allowed"), labels.converted_name(name, F.lit(True)).alias("shown"), labels.unique_name(name, F.col("p_partkey")).alias("stored")
    )


@query(
    """SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    GROUP BY 1, 2"""
)
def duplicate_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose (source, target) pair was asked for before."""
    lines = T.table(spark, sf_dir, "lineitem")
    twice = J.duplicate_groups(lines, ["l_partkey", "l_suppkey"])
    return lines.join(twice.drop("n"), ["l_partkey", "l_suppkey"], "left_semi").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))


@query(
    """WITH w AS (SELECT conv_id, turn, text, trunc(0.5::DOUBLE * (length(text) - (length(text) - length(replace(text, ' ', '')))))::INTEGER AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 7 ELSE t END AS input_tokens, t AS output_tokens, CASE WHEN turn % 2 = 0 THEN 7 + t ELSE t + t END AS total_tokens FROM w"""
)
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported tokens where a call has them, else estimates."""
    t = F.col("text")
    usage = X.token_usage(F.when(F.col("turn") % 2 == 0, F.lit(7)), F.lit(None).cast("int"), F.lit(None).cast("int"), t, t, F.lit(None).cast("string"))
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", usage.alias("u")).select("conv_id", "turn", "u.*")


@query(
    """SELECT doc_id, line // 10 AS chunk, count(*) AS lines, sum(length(c))::BIGINT AS chars FROM
    (SELECT doc_id, i - 1 AS line, l[i] AS c FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) GROUP BY 1, 2"""
)
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return S.line_chunks(lines, 10).groupBy("doc_id", "chunk").agg(F.count("*").alias("lines"), F.sum(F.length("content")).alias("chars"))


@query(
    """SELECT conv_id AS doc_id, turn AS seg_idx, coalesce(string_agg(substr(p, 1, 50), '' ORDER BY d), '') AS before FROM
    (SELECT a.conv_id, a.turn, b.turn AS d, CASE WHEN length(b.text) > 3 THEN b.text END AS p FROM conversations a LEFT JOIN conversations b
      ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn - 1) GROUP BY 1, 2"""
)
def wide_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two segments before each, put together."""
    return S.with_context(T.segments(spark, sf_dir), chars=50, k=2).select("doc_id", "seg_idx", "before")


FORMAT_TAG = "<run\\d+>|</run\\d+>|<tags\\d+/>|<lendof\\d+\\|>|<[a-z]+\\d*[^>]*/>"


@query(f"SELECT page_id, len(regexp_extract_all(html, '{FORMAT_TAG}')) AS tags, html AS restored FROM (SELECT page_id, replace(html, '<br>', '<br/>') AS html FROM pages)")
def tag_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format tags masked by numbered tokens, counted and put back."""
    pages = T.table(spark, sf_dir, "pages").select("page_id", X.mask_format_tags(F.replace("html", F.lit("<br>"), F.lit("<br/>"))).alias("m"))
    return pages.select("page_id", F.size("m.tags").cast("bigint").alias("tags"), X.unmask_format_tags(F.col("m.text"), F.col("m.tags")).alias("restored"))


@query(
    """WITH m AS (SELECT conv_id, turn, replace(text, 'e', '♂') AS t FROM conversations), c AS (SELECT *, replace(t, ' ', '') AS c, len(t) - len(replace(t, '♂', '')) AS n FROM m)
    SELECT conv_id, turn, n > 0 AND (regexp_full_match(c, '(?:[^♂]♂)+[^♂]?') OR contains(t, '♂♂') OR n / greatest(len(c), 1)::DOUBLE >= 0.3) AS dense FROM c"""
)
def placeholder_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.replace("text", F.lit("e"), F.lit("♂"))
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.placeholders_too_dense(marked).alias("dense"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'), ' ') AS text FROM conversations")
def cleaned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with reasoning and introductions, cleaned."""
    noisy = F.concat(F.lit("<think>let me\nsee</think>结果是：\n"), F.col("text"), F.lit(" [后文: next]"))
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.clean_result(X.strip_reasoning(noisy)).alias("text"))


def _share_sql(text: str, chars: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, '[{chars}]')) / nullif(len(regexp_extract_all({text}, '[^{X.LANGUAGE_IGNORED.replace(chr(39), chr(39) * 2)}]')), 0)::DOUBLE, 0)"


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '工业车辆' || text WHEN turn % 3 = 1 THEN '工' || substr(text, 1, 4) ELSE text END AS s,
      CASE WHEN turn % 2 = 0 THEN text ELSE '叉车操作手册说明' || substr(text, 1, 6) END AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN {_share_sql("s", X.CJK)} > 0.5 AND {_share_sql("t", "A-Za-z")} > 0.7 THEN 'chinese_to_english'
      WHEN {_share_sql("t", X.CJK)} > 0.5 AND NOT {_share_sql("s", X.CJK)} > 0.5 THEN 'english_to_chinese' ELSE 'preserve_original' END AS need FROM t"""
)
def spacing_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing between sources and answers that are Chinese, mixed or neither."""
    third, text = F.col("turn") % 3, F.col("text")
    source = F.when(third == 0, F.concat(F.lit("工业车辆"), text)).when(third == 1, F.concat(F.lit("工"), F.substring(text, 1, 4))).otherwise(text)
    target = F.when(F.col("turn") % 2 == 0, text).otherwise(F.concat(F.lit("叉车操作手册说明"), F.substring(text, 1, 6)))
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.spacing_need(source, target).alias("need"))


@query(
    f"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[{X.SPACE}]+')) AS w FROM documents)
    SELECT w AS word, CASE WHEN length(w) <= 2 THEN w <> '' AND (regexp_full_match(w, '[{X.CJK}]*') OR regexp_full_match(w, '[\\p{{Nd}}{X.OTHER_DIGITS}]+')
      OR regexp_full_match(w, '[{X.UNIT_SIGNS}]*') OR (length(w) = 2 AND regexp_matches(w, '[{X.CJK}]')))
      ELSE NOT (regexp_full_match(w, '[{X.SYMBOLS}]+') OR regexp_matches(w, '{X.NUMBERS}') OR regexp_full_match(w, '{X.PUNCTUATION_ONLY}')) END AS translate FROM w"""
)
def pdf_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.table(spark, sf_dir, "documents").select(F.explode(F.split("text", f"[{X.SPACE}]+")).alias("word")).distinct()
    return words.select("word", X.pdf_should_translate(F.col("word")).alias("translate"))


@query(
    """SELECT s.s_suppkey AS base, n.n_name AS owner, coalesce(p.n, 0)::BIGINT AS favourites, p.n IS NOT NULL AS any FROM supplier s JOIN nation n ON n_nationkey = s_nationkey
    LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) p ON p.l_suppkey = s.s_suppkey"""
)
def shared_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases with owner and favourite count, counted before they are joined."""
    counts = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("base")).agg(F.count_distinct("l_partkey").alias("n"))
    bases = T.table(spark, sf_dir, "supplier").join(T.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = bases.select(F.col("s_suppkey").alias("base"), F.col("n_name").alias("owner")).join(counts, "base", "left")
    return out.select("base", "owner", F.coalesce("n", F.lit(0)).alias("favourites"), F.col("n").isNotNull().alias("any"))
