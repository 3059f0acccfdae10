"""Text, segment, glossary and translation queries, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestitch.functions import text as X
from lodestitch.operators import glossary as G
from lodestitch.operators import segmenting as S
from lodestitch.operators import translation as R
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


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", "text")


def _q(text: str) -> str:
    return text.replace("'", "''")


PUNCT = _q(X.PUNCTUATION_ONLY.replace(r"`", "`"))
def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{X.SPACE}]+', ''), '[{X.SPACE}]+$', '')"


WORDS_SQL = f"(SELECT DISTINCT unnest(string_split_regex(text, '[{X.SPACE}]+')) AS w FROM documents)"
CJK_COUNT = "len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'))"
WEIGHT_SQL = f"({CJK_COUNT} + 0.5::DOUBLE * (length(text) - {CJK_COUNT} - (length(text) - length(replace(text, ' ', '')))))"


_MARK, _BLANKS = "chr(1)", "chr(2)"


def _sentences(text: str) -> str:
    """Sentences as a list: after marks that blanks follow, and after CJK marks with any white space."""
    spaced = f"regexp_replace({text}, '([.!?。！？;；:：…—]) +', '\\1' || {_BLANKS}, 'g')"
    wide = f"regexp_replace({spaced}, '([。！？；：…—])[{X.SPACE}]*', '\\1' || {_MARK}, 'g')"
    return f"string_split(replace(replace({wide}, {_MARK} || {_BLANKS}, {_MARK}), {_BLANKS}, {_MARK}), {_MARK})"


def _parts_sql(limit: int) -> str:
    """Paragraphs packed sentence by sentence: a running state per paragraph, one step a sentence."""
    return f"""WITH RECURSIVE para AS (SELECT doc_id, i - 1 AS para, ps[i] AS body FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM
      (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents)) WHERE ps[i] <> '' AND NOT regexp_full_match(ps[i], '{PUNCT}')),
    long AS (SELECT doc_id, para, {_sentences('body')} AS ss FROM para WHERE length(body) > {limit}),
    step AS (SELECT doc_id, para, ss, 0 AS i, 0 AS part, 0 AS open_part, 0 AS size, false AS held FROM long UNION ALL
      SELECT doc_id, para, ss, i + 1, CASE WHEN size + n <= {limit} OR NOT held THEN open_part ELSE open_part + 1 END,
        CASE WHEN size + n <= {limit} THEN open_part ELSE open_part + 1 END,
        CASE WHEN size + n <= {limit} THEN size + n WHEN held THEN n ELSE 0 END, size + n <= {limit} OR held
      FROM (SELECT *, length(ss[i + 1]) AS n FROM step WHERE i < len(ss))),
    packed AS (SELECT doc_id, para, part, true AS sub, string_agg(ss[i], ' ' ORDER BY i) AS text FROM step WHERE i > 0 GROUP BY doc_id, para, part
      UNION ALL SELECT doc_id, para, 0, false, body FROM para WHERE length(body) <= {limit}),
    parts AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY para, part) - 1)::INTEGER AS seg_idx, para::INTEGER AS para, sub, text FROM packed)"""


@query(
    _parts_sql(1000)
    + f" SELECT doc_id, count(*) AS segments, sum({WEIGHT_SQL}) AS weighted, max(length(text))::BIGINT AS longest FROM parts GROUP BY doc_id"
)
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: paragraphs to packed parts, with weighted counts per document."""
    parts = S.txt_segments(_documents(spark, sf_dir))
    return parts.groupBy("doc_id").agg(
        F.count("*").alias("segments"), F.sum(X.weighted_count(F.col("text"))).alias("weighted"), F.max(F.length("text")).cast("bigint").alias("longest")
    )


@query(f"SELECT doc_id, {WEIGHT_SQL} AS weighted, (CASE WHEN {_strip('text')} = '' THEN 0 ELSE trunc({WEIGHT_SQL}) END)::INTEGER AS tokens FROM documents")
def weighted_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", X.weighted_count(F.col("text")).alias("weighted"), X.token_estimate(F.col("text")).alias("tokens"))


@query(
    f"""SELECT w AS word, regexp_full_match(w, '{PUNCT}') AS punctuation,
    {_strip('w')} = '' OR (length({_strip('w')}) <= 3 AND NOT regexp_matches({_strip('w')}, '[\\p{{L}}\\p{{N}}_]')) AS symbol,
    regexp_matches(replace({_strip('w')}, ',', ''), '^[+-]?(?:\\p{{Nd}}+\\.?\\p{{Nd}}*|\\.\\p{{Nd}}+)(?:[eE][+-]?\\p{{Nd}}+)?$')
      AND (NOT contains(w, ',') OR regexp_matches({_strip('w')}, '^[+-]?\\p{{Nd}}{{1,3}}(?:,\\p{{Nd}}{{3}})*(?:\\.\\p{{Nd}}+)?(?:[eE][+-]?\\p{{Nd}}+)?$')) AS number,
    regexp_matches({_strip('w')}, '{_q(X.TITLE_NUMBER)}') AS title_number,
    regexp_matches(w, '{_q(X.NUMBERS)}') AS numbers_only FROM {WORDS_SQL}"""
)
def word_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    words = _documents(spark, sf_dir).select(F.explode(F.split("text", f"[{X.SPACE}]+")).alias("word")).distinct()
    return words.select(
        "word",
        X.is_punctuation_only(w).alias("punctuation"),
        X.is_pure_symbol(w).alias("symbol"),
        X.is_pure_number(w).alias("number"),
        X.is_title_number(w).alias("title_number"),
        X.is_numbers_only(w).alias("numbers_only"),
    )


@query(
    f"""WITH c AS (SELECT conv_id, turn, text, len(regexp_extract_all(text, '[^{_q(X.LANGUAGE_IGNORED)}]')) AS n,
    len(regexp_extract_all(text, '[A-Za-z]')) AS a, {CJK_COUNT} AS z FROM conversations)
    SELECT conv_id, turn, n > 0 AND z / nullif(n, 0)::DOUBLE > 0.5 AS chinese, n > 0 AND a / nullif(n, 0)::DOUBLE > 0.7 AS english,
    {" OR ".join(f"starts_with(text, '{_q(opening)}')" for opening in X.REFUSALS)} AS refusal FROM c"""
)
def language_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    turns = T.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", X.is_chinese_text(t).alias("chinese"), X.is_english_text(t).alias("english"), X.is_refusal(t).alias("refusal"))


@query(
    f"""SELECT doc_id, i AS part, parts[i] AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM
    (SELECT doc_id, {_sentences("text")} AS parts FROM documents))"""
)
def sentence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _documents(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("p", "sentence"))
    return parts.select("doc_id", (F.col("p") + 1).cast("bigint").alias("part"), "sentence")


@query(_parts_sql(400) + " SELECT * FROM parts")
def packed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.txt_segments(_documents(spark, sf_dir), limit=400)


MD_SQL = f"""WITH l AS (SELECT doc_id, i - 1 AS line, lines[i] AS c FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM
      (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
    s AS (SELECT *, {_strip('c')} AS b, len(c) - len(replace(c, '|', '')) AS pipes FROM l),
    f AS (SELECT *, coalesce(sum(regexp_matches(b, '^(?:```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS code FROM s),
    t AS (SELECT *, CASE WHEN code OR regexp_matches(b, '^(?:```|~~~)') THEN 'code_block' WHEN b = '' THEN 'empty' WHEN regexp_matches(b, '^#{{1,6}}\\s') THEN 'heading'
      WHEN regexp_matches(b, '^[*\\-+]\\s') THEN 'list_item' WHEN regexp_matches(b, '^\\p{{Nd}}+\\.\\s') THEN 'ordered_item' WHEN starts_with(b, '>') THEN 'quote'
      WHEN regexp_matches(b, '^[-*_]{{3,}}$') THEN 'horizontal_rule'
      WHEN pipes >= 2 THEN CASE WHEN regexp_matches(b, '^\\|[\\s|:\\-]+\\|$') AND len(b) - len(replace(b, '|', '')) = 5 THEN 'table_separator' ELSE 'table_row' END
      WHEN regexp_matches(c, '\\[.*?\\]\\(.*?\\)') THEN 'link_image' ELSE 'text' END AS type FROM f)"""


@query(MD_SQL + " SELECT doc_id, type, count(*) AS lines, sum(length(c))::BIGINT AS chars FROM t GROUP BY 1, 2")
def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.md_lines(_documents(spark, sf_dir))
    return lines.groupBy("doc_id", "type").agg(F.count("*").alias("lines"), F.sum(F.length("content")).alias("chars"))


@query(
    MD_SQL
    + f""" SELECT doc_id, round(count(*) FILTER (type NOT IN ('text', 'table_row') OR regexp_full_match(c, '{PUNCT}')) / count(*)::DOUBLE, 4) AS preserved
    FROM t GROUP BY 1"""
)
def md_preserve_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ~F.col("type").isin("text", "table_row") | ~X.needs_translation(F.col("content"))
    return S.md_lines(_documents(spark, sf_dir)).groupBy("doc_id").agg(F.round(F.count_if(kept) / F.count("*"), 4).alias("preserved"))


def _symbol(x: str) -> str:
    return f"({_strip(x)} = '' OR (length({_strip(x)}) <= 3 AND NOT regexp_matches({_strip(x)}, '[\\p{{L}}\\p{{N}}_]')))"



@query(
    f"""WITH n AS (SELECT conv_id, turn, lag(text) OVER w AS b, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id AS doc_id, turn AS seg_idx, CASE WHEN NOT {_symbol('b')} THEN substr(b, 1, 200) END AS before,
    CASE WHEN NOT {_symbol('a')} THEN substr(a, 1, 200) END AS after FROM n"""
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_context(T.segments(spark, sf_dir)).select("doc_id", "seg_idx", "before", "after")


@query(
    """SELECT text, uses, doc_id, seg_idx FROM (SELECT text, count(*) OVER (PARTITION BY text) AS uses, conv_id AS doc_id, turn AS seg_idx,
    row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS r FROM conversations) WHERE r = 1"""
)
def distinct_texts_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distinct_texts(T.segments(spark, sf_dir)).select("text", "uses", "first.doc_id", "first.seg_idx")


TERMS_SQL = "(SELECT row_number() OVER (ORDER BY p_brand, p_partkey) AS place, p_brand AS base, p_partkey AS term_id, p_name AS source, p_type AS target FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) r FROM part) WHERE r = 1)"


@query(f"SELECT base AS base_place, term_id, source, target FROM {TERMS_SQL}")
def first_wins_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_bases(T.terms(spark, sf_dir))


TOPK_SQL = f"""WITH terms AS (SELECT place, source, target, lower(source) AS low, list_distinct(string_split(lower(source), '')) AS tc FROM {TERMS_SQL}),
    seg AS (SELECT conv_id AS doc_id, turn AS seg_idx, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2) AS ws FROM conversations),
    pos AS (SELECT doc_id, seg_idx, ws[i] AS word, min(i) - 1 AS posn FROM (SELECT doc_id, seg_idx, ws, unnest(range(1, len(ws) + 1)) AS i FROM seg) GROUP BY 1, 2, 3),
    dw AS (SELECT word, list_distinct(string_split(word, '')) AS wc FROM (SELECT DISTINCT word FROM pos)),
    sc AS (SELECT word, place, source, target, CASE WHEN word = low THEN 100.0 WHEN contains(low, word) THEN 90.0 WHEN contains(word, low) THEN 85.0
      WHEN len(list_intersect(wc, tc)) / greatest(len(wc), len(tc))::DOUBLE > 0.5 THEN len(list_intersect(wc, tc)) / greatest(len(wc), len(tc))::DOUBLE * 70.0 ELSE 0.0 END::DOUBLE AS score FROM dw, terms),
    best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, place) AS in_word FROM sc WHERE score > 0),
    m AS (SELECT doc_id, seg_idx, source, target, max(score) AS score, min(posn * 10 + in_word) AS o FROM pos JOIN best USING (word) WHERE in_word <= 5 GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY score DESC, o) AS rank FROM m)"""


LARGE_SQL = """WITH base AS (SELECT w AS source, min(item_id) AS term_id, 't:' || w AS target FROM
      (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2)) AS w FROM benchmark) GROUP BY w),
    terms AS (SELECT source, target, row_number() OVER (ORDER BY term_id, source) AS place FROM base),
    seg AS (SELECT conv_id AS doc_id, turn AS seg_idx, text, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM conversations),
    phrase AS (SELECT doc_id, seg_idx, n, i, array_to_string(w[i : i + n - 1], ' ') AS p FROM
      (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest(CASE WHEN length(text) < 200 THEN [1, 2, 3, 4, 5] ELSE [1] END) AS n FROM seg) WHERE len(w) >= n)),
    exact AS (SELECT doc_id, seg_idx, source, target, CASE WHEN p = source THEN 100.0 ELSE 95.0 END AS score,
        [CASE WHEN p = source THEN 0 ELSE 1 END + CASE WHEN n > 1 THEN 2 ELSE 0 END, n, i, place] AS o FROM phrase JOIN terms ON lower(p) = lower(source)
      UNION ALL SELECT doc_id, seg_idx, source, target, 95.0, [1 + CASE WHEN n > 1 THEN 2 ELSE 0 END, n, i, place] FROM phrase JOIN terms ON p = source),
    pos AS (SELECT doc_id, seg_idx, word, min(i) AS posn FROM (SELECT doc_id, seg_idx, ws[i] AS word, i FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM
      (SELECT conv_id AS doc_id, turn AS seg_idx, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2) AS ws FROM conversations))) GROUP BY ALL),
    post AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(source), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2)) AS word, source, target, place FROM terms),
    scored AS (SELECT doc_id, seg_idx, source, target, CASE WHEN word = lower(source) THEN 100.0 WHEN contains(lower(source), word) THEN 90.0 ELSE 0.0 END AS score, [4, 1, posn, place] AS o
      FROM pos JOIN post USING (word)),
    merged AS (SELECT doc_id, seg_idx, source, target, max(score) AS score, min(o) AS o FROM (SELECT * FROM exact UNION ALL SELECT * FROM scored WHERE score > 0) GROUP BY ALL),
    whole AS (SELECT doc_id, seg_idx, count(DISTINCT source) >= 10 AS whole FROM exact GROUP BY ALL),
    r AS (SELECT m.*, row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY CASE WHEN coalesce(whole, false) THEN CASE WHEN o[1] < 4 THEN 1000.0 ELSE 0.0 END ELSE score END DESC, o) AS rank
      FROM merged m LEFT JOIN whole USING (doc_id, seg_idx))
    SELECT doc_id, seg_idx, rank::INTEGER AS rank, source, target, score::DOUBLE AS score FROM r WHERE rank <= 10"""


@query(TOPK_SQL + " SELECT doc_id, seg_idx, rank::INTEGER AS rank, source, target, round(score, 6) AS score FROM r WHERE rank <= 10")
def glossary_topk_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers that need no sequence similarity."""
    out = G.relevant_terms(T.segments(spark, sf_dir), G.merge_bases(T.terms(spark, sf_dir)), fuzzy=False)
    return out.withColumn("score", F.round("score", 6))


@query(
    TOPK_SQL
    + """, b AS (SELECT *, sum(length(source) + length(target)) OVER (PARTITION BY doc_id, seg_idx ORDER BY rank) AS used FROM r WHERE rank <= 10)
    SELECT doc_id, seg_idx, rank::INTEGER AS rank, source, target, round(score, 6) AS score, used::BIGINT AS used FROM b WHERE used <= 60"""
)
def glossary_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.relevant_terms(T.segments(spark, sf_dir), G.merge_bases(T.terms(spark, sf_dir)), fuzzy=False)
    return G.within_budget(out, most_chars=60).withColumn("score", F.round("score", 6))


@query(
    f"""WITH terms AS (SELECT place, source, target, list_distinct(list_filter(string_split_regex(lower(source), '[{X.SPACE}]+'), lambda w: w <> '')) AS tw FROM {TERMS_SQL}),
    seg AS (SELECT conv_id AS doc_id, turn AS seg_idx, text, list_distinct(list_filter(string_split_regex(lower(text), '[{X.SPACE}]+'), lambda w: w <> '')) AS sw FROM conversations),
    sc AS (SELECT doc_id, seg_idx, place, source, target, CASE WHEN contains(text, source) THEN 100.0 WHEN contains(lower(text), lower(source)) THEN 95.0
      ELSE len(list_intersect(sw, tw)) / len(tw)::DOUBLE * 70.0 END::DOUBLE AS score FROM seg, terms),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY score DESC, place) AS rank FROM sc WHERE score > 0)
    SELECT doc_id, seg_idx, rank::INTEGER AS rank, source, target, round(score, 6) AS score FROM r WHERE rank <= 10"""
)
def glossary_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against all terms in one pass of an automaton."""
    return G.text_scores(T.segments(spark, sf_dir), G.merge_bases(T.terms(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query(
    TOPK_SQL.split("seg AS")[0].replace("FROM " + TERMS_SQL, "FROM (SELECT source, target, row_number() OVER (ORDER BY term_id, source) AS place FROM base)").replace(
        "WITH terms", LARGE_SQL.split("terms AS")[0].rstrip().rstrip(",") + ", terms"
    )
    + "seg AS"
    + TOPK_SQL.split("seg AS")[1]
    + " SELECT doc_id, seg_idx, rank::INTEGER AS rank, source, target, round(score, 6) AS score FROM r WHERE rank <= 10"
)
def glossary_similar_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large base by similarity of every word and term, without a product of both."""
    return G.relevant_terms(T.segments(spark, sf_dir), G.merge_bases(_word_base(spark, sf_dir)), fuzzy=False, small=None).withColumn("score", F.round("score", 6))


@query()
def glossary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers, sequence similarity included."""
    return G.relevant_terms(T.segments(spark, sf_dir), G.merge_bases(T.terms(spark, sf_dir)))


@query(LARGE_SQL)
def glossary_large_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact finds and posting lists: the words of the benchmark as a base of their own."""
    return G.relevant_terms(T.segments(spark, sf_dir), G.merge_bases(_word_base(spark, sf_dir)), fuzzy=False, small=0)


def _word_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.tokens(F.col("text"))).alias("source"))
    base = words.groupBy("source").agg(F.min("item_id").alias("term_id"))
    return base.select(F.lit("b").alias("base"), "term_id", "source", F.concat(F.lit("t:"), "source").alias("target"))


@query(
    TOPK_SQL
    + """, b AS (SELECT *, sum(length(source) + length(target)) OVER (PARTITION BY doc_id, seg_idx ORDER BY rank) AS used FROM r WHERE rank <= 10)
    SELECT doc_id, seg_idx, rank::INTEGER AS rank, source, target, round(score, 6) AS score, used::BIGINT AS used FROM b WHERE used <= 90"""
)
def glossary_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgeted terms of every segment, searched once for equal texts."""
    out = G.batch_terms(T.segments(spark, sf_dir), G.merge_bases(T.terms(spark, sf_dir)), most_chars=90, fuzzy=False)
    return out.withColumn("score", F.round("score", 6))


def _needed(x: str) -> str:
    return f"{x} <> '' AND NOT regexp_full_match({x}, '{PUNCT}')"


@query(
    f"""WITH RECURSIVE l AS (SELECT doc_id, i, ls[i] AS c FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, length(c) > 1000 AS long FROM l WHERE ({_needed("c")}) OR {_strip("c")} = ''),
    s AS (SELECT doc_id, 0::BIGINT AS k, 0 AS gid, 0::BIGINT AS size, true AS fresh FROM documents UNION ALL
      SELECT s.doc_id, n.k, CASE WHEN long OR fresh OR size + length(c) > 1000 THEN gid + 1 ELSE gid END, CASE WHEN long THEN 0 WHEN fresh OR size + length(c) > 1000 THEN length(c) + 1 ELSE size + length(c) + 1 END, long
      FROM s JOIN kept n ON n.doc_id = s.doc_id AND n.k = s.k + 1),
    placed AS (SELECT kept.*, s.gid FROM kept JOIN s ON s.doc_id = kept.doc_id AND s.k = kept.k),
    cut AS (SELECT doc_id, gid, {_sentences("c")} AS ss FROM placed WHERE long),
    step AS (SELECT doc_id, gid, ss, 0 AS i, 0 AS part, 0 AS open_part, 0 AS size, false AS held FROM cut UNION ALL
      SELECT doc_id, gid, ss, i + 1, CASE WHEN size + n <= 1000 OR NOT held THEN open_part ELSE open_part + 1 END, CASE WHEN size + n <= 1000 THEN open_part ELSE open_part + 1 END,
        CASE WHEN size + n <= 1000 THEN size + n WHEN held THEN n ELSE 0 END, size + n <= 1000 OR held FROM (SELECT *, length(ss[i + 1]) AS n FROM step WHERE i < len(ss))),
    p AS (SELECT doc_id, gid, part, string_agg(ss[i], ' ' ORDER BY i) AS t, true AS sub FROM step WHERE i > 0 GROUP BY ALL
      UNION ALL SELECT doc_id, gid, 0, string_agg(c || chr(10), '' ORDER BY k), false FROM placed WHERE NOT long GROUP BY doc_id, gid)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY gid, part) - 1)::INTEGER AS part, CASE WHEN {_needed("t")} THEN t ELSE '' END AS text, sub FROM p"""
)
def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed line by line (the older markdown way)."""
    parts = _documents(spark, sf_dir).select("doc_id", F.posexplode(X.pack_lines(F.col("text"))).alias("part", "p"))
    return parts.select("doc_id", "part", "p.text", "p.sub")


@query(
    f"""SELECT word, count(*) AS terms, min(place) AS first FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}_]+')) AS word, place FROM {TERMS_SQL})
    WHERE length(word) >= 2 GROUP BY 1"""
)
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = G.inverted_index(G.numbered(G.merge_bases(T.terms(spark, sf_dir))))
    return index.groupBy("word").agg(F.count("*").alias("terms"), F.min("place").cast("bigint").alias("first"))


@query(
    _parts_sql(1000)
    + """, blocks AS (SELECT doc_id, para, sub, string_agg(text, '' ORDER BY seg_idx) AS block, max(para) OVER (PARTITION BY doc_id) AS last FROM parts GROUP BY doc_id, para, sub)
    SELECT doc_id, string_agg(block || CASE WHEN sub AND para = last THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY para) AS text FROM blocks GROUP BY doc_id"""
)
def identity_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through segmentation, with long paragraphs in parts, identity translation and assembly."""
    done = R.translate_segments(S.txt_segments(_documents(spark, sf_dir)), [R.identity])
    return S.assemble_txt(done.withColumn("text", F.col("translated")))


@query(
    f"""SELECT conv_id AS doc_id, turn AS seg_idx, CASE WHEN need THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') ELSE text END AS translated, CASE WHEN need THEN 'done' ELSE 'skipped' END AS status,
    CASE WHEN need THEN CASE WHEN ('0x' || substr(md5(text), 1, 8))::BIGINT / 4294967295::DOUBLE < 0.3 THEN 2 ELSE 1 END END AS attempts
    FROM (SELECT *, text <> '' AND NOT regexp_full_match(text, '{PUNCT}') AS need FROM conversations)"""
)
def translate_with_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translator that fails at times, then another; attempts and outcome per segment."""
    done = R.translate_segments(T.segments(spark, sf_dir), [R.flaky(0.3, R.reverse_words), R.identity], retries=2)
    return done.select("doc_id", "seg_idx", "translated", "status", "attempts")


@query(
    """SELECT count(*) AS segments, count(DISTINCT text) AS distinct_texts, round(1 - count(DISTINCT text) / count(*)::DOUBLE, 4) AS saved
    FROM conversations WHERE NOT regexp_full_match(text, '"""
    + PUNCT
    + "')"
)
def dedup_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = T.segments(spark, sf_dir).where(X.needs_translation(F.col("text")))
    return needed.agg(
        F.count("*").alias("segments"), F.count_distinct("text").alias("distinct_texts"), F.round(1 - F.count_distinct("text") / F.count("*"), 4).alias("saved")
    )


@query(
    """SELECT conv_id, role, min(turn) AS first_turn, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM
    (SELECT *, sum(CASE WHEN role IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM
      (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)) GROUP BY conv_id, role, g"""
)
def turn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of one role as runs (islands)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = T.table(spark, sf_dir, "conversations")
    start = (~F.lag("role").over(order).eqNullSafe(F.col("role"))).cast("int")
    runs = turns.withColumn("start", start).withColumn("g", F.sum("start").over(order))
    return runs.groupBy("conv_id", "role", "g").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars")).drop("g")


@query(
    f"""SELECT doc_id, md5(concat(doc_id::VARCHAR, coalesce(lang, ''), text)) AS fingerprint, substr(text, 1, 500) AS preview,
    CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short FROM documents"""
)
def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", X.fingerprint(F.col("doc_id"), F.col("lang"), t).alias("fingerprint"), X.preview(t).alias("preview"), X.ellipsis(t, 100).alias("short")
    )
