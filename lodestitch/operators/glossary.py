"""Glossary retrieval: merge term bases, score terms against texts, keep the best.

Words are scored once each, however often they occur, and no word meets all terms: pairs are
found by equi-joins (``similar_terms``) that lose none. What contains the other shares its rarest
gram; what has enough characters in common shares one of the rarest ones of both (a prefix-filtered
set join). So a base may have any size, and its size changes no result: all terms are scored. The surveyed system searches
a base of over 1,000 terms by its exact finds and whole words only; that is left to callers who ask for it (``small``). Whole
texts meet all terms that they contain in one pass of an automaton (``contained_terms``). Ties go by place in
the text, then by the base's order, which is (base, term id, source) and needs no numbering.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestitch.functions import text as X
from lodestitch.sources.shared import shared_path

PER_WORD = 5
MOST_TERMS = 10
MOST_CHARS = 1000


def merge_bases(terms: DataFrame, bases: list | None = None, newest_first: bool = False, trim: bool = False) -> DataFrame:
    """place, source, target: the first target of each source, by base order (``bases``, else by
    name), then term id (descending with ``newest_first``)."""
    if trim:
        terms = terms.withColumn("source", X.stripped(F.col("source"))).withColumn("target", X.stripped(F.col("target"))).where("source != '' AND target != ''")
    rank = F.col("base")
    if bases is not None:
        terms = terms.where(F.col("base").isin(*bases))
        rank = F.array_position(F.array(*[F.lit(b) for b in bases]), F.col("base"))
    by_id = F.desc("term_id") if newest_first else F.asc("term_id")
    first = Window.partitionBy("source").orderBy(rank, by_id)
    kept = terms.withColumn("turn", F.row_number().over(first)).where("turn = 1")
    return kept.select(rank.alias("base_place"), "term_id", "source", "target")


def numbered(terms: DataFrame) -> DataFrame:
    """Terms with ``place``, a dense order over the merged base (one small table)."""
    return terms.withColumn("place", F.row_number().over(Window.orderBy("base_place", "term_id", "source"))).select("place", "source", "target")


def _chars(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))


def _tiers(word: Column, term: Column, common: Column, most: Column) -> Column:
    """100 equal, 90 word in term, 85 term in word, else 70 times the share of common
    characters if that is over one half; 0 otherwise."""
    share = common / most
    return (
        F.when(word == term, 100.0)
        .when(F.contains(term, word), 90.0)
        .when(F.contains(word, term), 85.0)
        .when(share > 0.5, share * 70.0)
        .otherwise(0.0)
    )


def tier_score(word: Column, word_chars: Column, term: Column, term_chars: Column) -> Column:
    """The tiers of lower-case texts with their distinct characters."""
    return _tiers(word, term, F.size(F.array_intersect(word_chars, term_chars)), F.greatest(F.size(word_chars), F.size(term_chars)))


#: Least sequence similarity that scores.
LEAST_RATIO = 0.6


@F.pandas_udf(T.DoubleType())
def fuzzy_score(word: pd.Series, term: pd.Series) -> pd.Series:
    """60 times the sequence similarity of two texts if that is over 0.6, else 0."""
    ratio = [SequenceMatcher(None, a, b).ratio() for a, b in zip(word, term)]
    return pd.Series([r * 60.0 if r > LEAST_RATIO else 0.0 for r in ratio])


def text_term_score(text: Column, term: Column) -> Column:
    """Whole-text score: contained 100, case-blind 95, else 70 times the share of the term's
    words that the text has, else 50 times a sequence similarity over 0.3."""
    split = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), f"[{X.SPACE}]+"), lambda w: w != ""))
    share = F.size(F.array_intersect(split(text), split(term))) / F.greatest(F.size(split(term)), F.lit(1))
    return (
        F.when((text == "") | (term == ""), 0.0)
        .when(F.contains(text, term), 100.0)
        .when(F.contains(F.lower(text), F.lower(term)), 95.0)
        .when(share > 0, share * 70.0)
        .otherwise(sequence_score(F.lower(text), F.lower(term)))
    )


@F.pandas_udf(T.DoubleType())
def sequence_score(text: pd.Series, term: pd.Series) -> pd.Series:
    """50 times the sequence similarity of two texts if that is over 0.3, else 0."""
    ratio = [SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else 0.0 for a, b in zip(text, term)]
    return pd.Series([r * 50.0 if r > 0.3 else 0.0 for r in ratio])


def inverted_index(terms: DataFrame) -> DataFrame:
    """word, place, source, target: every term under each of its words."""
    return terms.select(F.explode(F.array_distinct(X.tokens(F.col("source")))).alias("word"), "place", "source", "target")


def _words(segments: DataFrame) -> DataFrame:
    """doc_id, seg_idx, word, at: distinct words of each segment with their first position."""
    spread = segments.select("doc_id", "seg_idx", F.posexplode(X.tokens(F.col("text"))).alias("at", "word"))
    return spread.groupBy("doc_id", "seg_idx", "word").agg(F.min("at").alias("at"))


#: Tokens that a mask of bits holds, and masks of a row; a base with more distinct tokens compares arrays.
MASK_BITS, MOST_MASKS = 62, 4


def _ranks(tokens: DataFrame) -> DataFrame:
    """token, rank: the rarest of ``tokens`` (token) first. Their number is that of characters in use, not of rows."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).collect()
    ordered = [(r["token"], i) for i, r in enumerate(sorted(counts, key=lambda r: (r["df"], r["token"])))]
    return tokens.sparkSession.createDataFrame(ordered, "token string, rank int")


def _rare_first(rows: DataFrame, key: str, tokens: Column, ranks: DataFrame, masks: int) -> DataFrame:
    """``rows`` (key) with tokens, the ranks of their tokens in order and -1 for unknown ones in front, n, their number,
    and ``masks`` columns of bits by rank."""
    spread = rows.select(key, F.explode(tokens).alias("token")).join(F.broadcast(ranks), "token", "left")
    out = spread.groupBy(key).agg(F.array_sort(F.collect_list(F.coalesce("rank", F.lit(-1)))).alias("tokens")).withColumn("n", F.size("tokens"))
    bits = lambda k: f"aggregate(tokens, 0L, (m, t) -> m | CASE WHEN t BETWEEN {k * MASK_BITS} AND {(k + 1) * MASK_BITS - 1} THEN shiftleft(1L, t - {k * MASK_BITS}) ELSE 0L END)"
    return out.withColumns({f"m{k}": F.expr(bits(k)) for k in range(masks)})


def overlap_join(left: DataFrame, right: DataFrame, need, reach, masks: int, own=None) -> DataFrame:
    """Pairs of rows of ``_rare_first`` whose token sets have at least ``need(n, n)`` tokens in common, with
    ``common``; ``reach(n)`` is the least and the greatest size of a partner. ``own(n, n)``, of further columns of the
    left side too, asks for no fewer than ``need`` where a row wants more.

    Two such sets share a token among the first ``n - need + 1`` of each. The right side is posted under
    these with its size, the left one asks for every size in reach; a pair is taken at its rarest common
    token, so it comes once, and only where the tokens behind it can still be enough."""
    own = own or need
    lo, hi = reach(F.col("r_n"))
    posts = right.withColumnsRenamed({"tokens": "r_tokens", "n": "r_n", **{f"m{k}": f"r_m{k}" for k in range(masks)}})
    posts = posts.select("*", F.posexplode(F.slice("r_tokens", F.lit(1), F.greatest(F.col("r_n") - need(lo, F.col("r_n")) + 1, F.lit(0)))).alias("j", "token"))
    below = lambda k: f"CASE WHEN token >= {(k + 1) * MASK_BITS} THEN {(1 << MASK_BITS) - 1}L WHEN token < {k * MASK_BITS} THEN 0L ELSE shiftleft(1L, token - {k * MASK_BITS}) - 1L END"
    posts = posts.withColumns({f"below{k}": F.expr(below(k)) for k in range(masks)})
    lo, hi = reach(F.col("n"))
    asks = left.where(lo <= hi).withColumn("m", F.explode(F.sequence(lo, hi)))
    asks = asks.select("*", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(F.col("n") - own(F.col("n"), F.col("m")) + 1, F.lit(0)))).alias("i", "ask")).where("ask >= 0")
    enough = own(F.col("n"), F.col("r_n"))
    met = (F.col("ask") == F.col("token")) & (F.col("m") == F.col("r_n")) & (F.least(F.col("n") - F.col("i"), F.col("r_n") - F.col("j")) >= enough)
    helpers = ["tokens", "r_tokens", "i", "j", "ask", "token", "m", *[f"{x}{k}" for x in ("m", "r_m", "below") for k in range(masks)]]
    if masks:
        both = [F.col(f"m{k}").bitwiseAND(F.col(f"r_m{k}")) for k in range(masks)]
        common = sum((F.bit_count(x) for x in both[1:]), F.bit_count(both[0]))
        for k, x in enumerate(both):
            met = met & (x.bitwiseAND(F.col(f"below{k}")) == 0)
        return asks.drop("tokens").join(posts.drop("r_tokens"), met & (common >= enough)).withColumn("common", common.cast("int")).drop(*helpers)
    pairs = asks.join(posts, met).withColumn("both", F.array_intersect("tokens", "r_tokens"))
    return pairs.where((F.get("both", F.lit(0)) == F.col("token")) & (F.size("both") >= enough)).withColumn("common", F.size("both")).drop("both", *helpers)


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))


def _own_size(text: Column) -> Column:
    return F.least(F.length(text), F.lit(3))


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs of texts (one distinct column each) where that of ``inner`` is part of that of ``outer``: all its grams are
    among the outer ones, and they meet on the rarest. What is asked for is a written table, so a small one goes to
    where the outer texts are, and their grams stay there."""
    inner_text, outer_text = inner.columns[0], outer.columns[0]
    of = lambda c: F.when(_own_size(F.col(c)) == 3, _grams(F.col(c), 3)).when(_own_size(F.col(c)) == 2, _grams(F.col(c), 2)).when(_own_size(F.col(c)) == 1, F.array(c))
    sizes = [F.when(F.length(outer_text) >= n, _grams(F.col(outer_text), n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]
    posts = outer.select(outer_text, F.explode(F.concat(*sizes)).alias("gram"))
    counts = posts.groupBy("gram").agg(F.count("*").alias("df"))
    asks = inner.withColumn("grams", of(inner_text))
    asks = asks.select(inner_text, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(counts, "gram")
    asks = asks.groupBy(inner_text, "n").agg(F.count("*").alias("found"), F.min_by("gram", F.struct("df", "gram")).alias("gram")).where("found = n").select(inner_text, "gram")
    return _written(asks, "asks").join(posts, "gram").where(F.contains(outer_text, inner_text)).select(inner_text, outer_text)


def _char_set(s: Column) -> Column:
    """The distinct characters of a text in order: the share of common ones depends on these alone."""
    return F.array_join(F.array_sort(_chars(s)), "")


def similar_terms(words: DataFrame, terms: DataFrame, fuzzy: bool, best: int | None = None) -> DataFrame:
    """word, place, source, target, score: every pair of a word (column word, distinct, lower case) and a term
    that scores, by the tiers of ``tier_score`` and, with ``fuzzy``, the sequence similarity.

    Shares of common characters are found once for each set of characters, of which there are far fewer than words.
    With ``best`` these come only for the best so many terms of a set, by share and place. The best terms
    of a word, that many, are still all there: a term that contains the word or is part of it scores more than any share, so what
    stands before a term by share stands before it by score too."""
    known = terms.where("source != ''").select("place", "source", "target", F.lower("source").alias("low"))
    words = words.select("word").where("word != ''")
    lows = known.select("low").distinct()
    out = ["word", "place", "source", "target", "score"]
    inside = _within(words, lows).withColumn("score", F.when(F.col("word") == F.col("low"), 100.0).otherwise(90.0))
    around = _within(lows, words).where("word != low").withColumn("score", F.lit(85.0))
    apart = ~F.contains("low", "word") & ~F.contains("word", "low")

    def met(left: DataFrame, right: DataFrame, tokens, need, reach, own=None, wants: DataFrame | None = None) -> DataFrame:
        ranks = _ranks(right.select(F.explode(tokens(F.col(right.columns[0]))).alias("token")))
        masks = -(-max(1, ranks.count()) // MASK_BITS)
        masks = masks if masks <= MOST_MASKS else 0
        mine, its = (_rare_first(x, x.columns[0], tokens(F.col(x.columns[0])), ranks, masks) for x in (left, right))
        mine = mine if wants is None else mine.join(wants, left.columns[0], "left")
        return overlap_join(mine, its, need, reach, masks, own)

    half = lambda a, b: F.floor(F.greatest(a, b) / 2).cast("int") + 1
    spelt, listed = words.withColumn("word_set", _char_set(F.col("word"))), known.withColumn("low_set", _char_set(F.col("low")))
    # Few sets meet many: they are dealt out by number, which is not merged to a few tasks for its few bytes.
    sets = spelt.select("word_set").distinct().repartition(4 * words.sparkSession.sparkContext.defaultParallelism, "word_set")
    share = met(sets, listed.select("low_set").distinct(), _chars, half, lambda n: (F.floor(n / 2).cast("int") + 1, 2 * n - 1))
    share = share.select("word_set", "low_set", (F.col("common") / F.greatest("n", "r_n") * 70.0).alias("score"))
    turn = lambda of, *order: F.row_number().over(Window.partitionBy(of).orderBy(*order)) <= best
    top = lambda rows, of, *order: rows.withColumn("kept", turn(of, *order)).where("kept").drop("kept")
    if best is not None:
        listed = top(listed, "low_set", "place")
        share = top(share.join(listed.groupBy("low_set").agg(F.min("place").alias("first")), "low_set"), "word_set", F.desc("score"), "first").drop("first")
        share = top(share.join(listed, "low_set"), "word_set", F.desc("score"), "place")
    else:
        share = share.join(listed, "low_set")
    found = inside.unionByName(around).join(known, "low").select(*out)
    found = found.unionByName(spelt.join(share, "word_set").where(apart).select(*out))
    if not fuzzy:
        return found
    # A matcher pairs at most the characters that both have, repeats counted: over 0.3 of all.
    least = lambda a, b: F.floor((a + b) * (LEAST_RATIO / 2)).cast("int") + 1
    wants, own = None, None
    if best is not None:
        # What is below a word's last place even if all common characters are paired need not be met.
        found = _written(top(found, "word", F.desc("score"), "place"), "found")
        wants = found.groupBy("word").agg(F.count("*").alias("held"), F.min("score").alias("last")).where(F.col("held") == best).select("word", "last")
        own = lambda a, b: F.greatest(least(a, b), F.ceil(F.coalesce("last", F.lit(0.0)) * (a + b) / 120.0 - 1e-6).cast("int"))
    near = met(words, lows, _numbered_chars, least, lambda n: (F.floor(n * 3 / 7).cast("int") + 1, F.ceil(n * 7 / 3).cast("int") - 1), own, wants).where(apart)
    fewer = F.size(F.array_intersect(_chars(F.col("word")), _chars(F.col("low")))) / F.greatest(F.size(_chars(F.col("word"))), F.size(_chars(F.col("low")))) <= 0.5
    near = near.where(fewer).withColumn("score", fuzzy_score(F.col("word"), F.col("low"))).where("score > 0")
    return found.unionByName(near.join(known, "low").select(*out))


def _numbered_chars(s: Column) -> Column:
    """Characters with the number of their occurrence, so that repeats are tokens of their own."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: what several joins read is computed once."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _best_of_word(words: DataFrame, terms: DataFrame, fuzzy: bool) -> DataFrame:
    """Per distinct word its best terms, by score and place."""
    best = Window.partitionBy("word").orderBy(F.desc("score"), "place")
    distinct = _written(words.select("word").distinct(), "words")
    return similar_terms(distinct, _written(terms, "terms"), fuzzy, PER_WORD).withColumn("in_word", F.row_number().over(best)).where(F.col("in_word") <= PER_WORD)


def _sharing_words(words: DataFrame, terms: DataFrame, fuzzy: bool) -> DataFrame:
    """Scores of words and the terms that have them as a word."""
    pairs = words.select("word").distinct().join(inverted_index(terms), "word")
    low = F.lower("source")
    pairs = pairs.withColumn("score", tier_score(F.col("word"), _chars(F.col("word")), low, _chars(low)))
    sure = pairs.where("score > 0")
    return sure.unionByName(pairs.where("score = 0").withColumn("score", fuzzy_score(F.col("word"), low)).where("score > 0")) if fuzzy else sure


#: Bytes of term texts that one automaton may hold; more terms are dealt to several, which pass over the texts in turn.
AUTOMATON_BYTES = 16 << 20


def _scanned(texts: DataFrame, terms: DataFrame, find, schema: str, most_bytes: int) -> DataFrame:
    """What ``find(automaton, row)`` yields for every row of ``texts``. The automaton holds the terms' forms
    (term_form); its values are lists of the sources (source) of a form. It reaches the tasks as its bounded list of terms
    and is built once for each batch of work."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("source") + 16), F.lit(0))).first()[0]
    parts, out = max(1, -(-size // most_bytes)), None
    for part in range(parts):
        own = terms.where(F.pmod(F.xxhash64("term_form"), F.lit(parts)) == part) if parts > 1 else terms
        forms = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in own.select("term_form", "source").collect()])

        def run(batches: Iterator[pd.DataFrame], forms=forms) -> Iterator[pd.DataFrame]:
            automaton = ahocorasick.Automaton()
            for form, source in forms.value:
                if form in automaton:
                    automaton.get(form).append(source)
                else:
                    automaton.add_word(form, [source])
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                yield pd.DataFrame([x for row in batch.to_dict("records") for x in find(automaton, row)], columns=columns)

        columns = [f.name for f in T._parse_datatype_string(schema)]
        found = texts.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def contained_terms(segments: DataFrame, merged: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, seg_idx, source, target, place and score of every term that a text contains: 100 as it
    stands, 95 in another case. One pass over a text finds all terms, however many and long."""
    terms = merged.where("source != ''").select(F.lower("source").alias("term_form"), "source")

    def find(automaton, row: dict) -> Iterator[tuple]:
        text = row["text"] or ""
        low, best = text.lower(), {}
        even = len(low) == len(text)
        for end, sources in automaton.iter(low):
            for source in sources:
                if best.get(source) != 100.0:
                    same = text[end + 1 - len(source) : end + 1] == source if even else source in text
                    best[source] = 100.0 if same else 95.0
        for source, score in best.items():
            yield row["doc_id"], row["seg_idx"], source, score

    kept = segments.select("doc_id", "seg_idx", "text")
    types = [kept.schema[c].dataType.simpleString() for c in ("doc_id", "seg_idx")]
    found = _scanned(kept, terms, find, f"doc_id {types[0]}, seg_idx {types[1]}, source string, score double", most_bytes)
    named = merged.select(F.struct("base_place", "term_id", "source").alias("place"), "source", "target")
    return found.join(named, "source").select("doc_id", "seg_idx", "source", "target", "place", "score")


def text_scores(segments: DataFrame, merged: DataFrame, k: int = MOST_TERMS) -> DataFrame:
    """doc_id, seg_idx, rank, source, target, score: the best k terms of each whole text, by
    ``text_term_score`` without its last tier: terms that it contains, then the share of a term's words that it has."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), f"[{X.SPACE}]+"), lambda w: w != ""))
    named = merged.where("source != ''").select(F.struct("base_place", "term_id", "source").alias("place"), "source", "target", split("source").alias("words"))
    posts = named.select("place", "source", "target", F.size("words").alias("of"), F.explode("words").alias("word"))
    has = segments.select("doc_id", "seg_idx", F.explode(split("text")).alias("word")).join(posts, "word")
    shared = has.groupBy("doc_id", "seg_idx", "source", "target", "place", "of").agg((F.count("*") / F.col("of") * 70.0).alias("score")).drop("of")
    scored = contained_terms(segments, merged).unionByName(shared).groupBy("doc_id", "seg_idx", "source", "target", "place").agg(F.max("score").alias("score"))
    best = Window.partitionBy("doc_id", "seg_idx").orderBy(F.desc("score"), "place")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("doc_id", "seg_idx", "rank", "source", "target", "score")


#: Most words of a term that is found as a phrase.
PHRASE = 5


def _exact(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """Exact finds in text order: single words, then case-blind ones, then (texts under 200
    characters) phrases of two to five words. ``stage`` and ``at`` keep the order. Words and phrases are rows that
    meet the terms by an equi-join on lower case, so neither terms nor texts are held by the driver or by a Python worker."""
    raw = F.regexp_extract_all(F.col("text"), F.lit(f"[{X.WORD}]+"), 0)
    words = segments.select("doc_id", "seg_idx", raw.alias("raw"), (F.length("text") < 200).alias("short"))
    forms = terms.select("source", "place", "target", F.lower("source").alias("form"))
    n = F.size(F.split("source", " ", -1))
    singles = words.select("doc_id", "seg_idx", F.posexplode("raw").alias("i", "phrase")).withColumn("n", F.lit(1))
    sizes = words.where("short").withColumn("n", F.explode(F.sequence(F.lit(2), F.lit(PHRASE)))).where("size(raw) >= n")
    phrases = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("raw") - F.col("n") + 1)))
    phrases = phrases.select("doc_id", "seg_idx", "i", F.array_join(F.expr("slice(raw, i, n)"), " ").alias("phrase"), "n")
    asked = singles.unionByName(phrases).withColumn("form", F.lower("phrase"))
    same = F.when(F.col("phrase") == F.col("source"), 0).otherwise(1)
    first = F.min(F.struct((same + F.when(F.col("n") > 1, 2).otherwise(0)).alias("stage"), "n", "i")).alias("f")
    found = asked.join(forms, "form").where(F.col("n") == n).groupBy("doc_id", "seg_idx", "source", "target", "place").agg(first)
    order = F.struct("f.stage", F.struct("f.n", "f.i").alias("at"), "place").alias("o")
    return found.select("doc_id", "seg_idx", "source", "target", "place", order, F.when(F.col("f.stage") % 2 == 1, 95.0).otherwise(100.0).alias("score"))


def relevant_terms(segments: DataFrame, merged: DataFrame, k: int = MOST_TERMS, fuzzy: bool = True, small: int | None = None) -> DataFrame:
    """doc_id, seg_idx, rank, source, target, score: the best k terms of each segment. Every term is scored, whatever the size
    of the base; only where a caller names ``small`` are bases of more terms searched by exact finds and whole words."""
    k = min(MOST_TERMS, k)
    terms = merged.select(F.struct("base_place", "term_id", "source").alias("place"), "source", "target")
    words = _words(segments)
    order = lambda place: F.min(F.struct(F.lit(4).alias("stage"), F.struct(F.lit(1).alias("n"), F.col("at").alias("i")).alias("at"), place.alias("place"))).alias("o")
    if small is None or terms.count() <= small:
        found = words.join(_best_of_word(segments.select(F.explode(X.tokens(F.col("text"))).alias("word")), terms, fuzzy), "word")
        # Place of the word, then that of the term, in one number: it is summed up by hash, and a segment's rows meet once.
        found = found.select("doc_id", "seg_idx", "source", "target", "score", (F.col("at").cast("long") * (PER_WORD + 1) + F.col("in_word")).alias("o"))
        scored = found.repartition("doc_id", "seg_idx").groupBy("doc_id", "seg_idx", "source", "target").agg(F.max("score").alias("score"), F.min("o").alias("o"))
        exact = None
    else:
        exact = _exact(segments, terms)
        found = words.join(_sharing_words(words, terms, fuzzy), "word")
        scored = found.groupBy("doc_id", "seg_idx", "source", "target").agg(F.max("score").alias("score"), order(F.col("place")))
        both = scored.unionByName(exact.select("doc_id", "seg_idx", "source", "target", "score", "o"))
        scored = both.groupBy("doc_id", "seg_idx", "source", "target").agg(F.max("score").alias("score"), F.min("o").alias("o"))
        # k exact finds end the search: then text order decides among them.
        full = exact.groupBy("doc_id", "seg_idx").agg((F.count("*") >= k).alias("full"))
        scored = scored.join(full, ["doc_id", "seg_idx"], "left").withColumn(
            "score_key", F.when(F.coalesce("full", F.lit(False)), F.when(F.col("o.stage") < 4, 1000.0).otherwise(0.0)).otherwise(F.col("score"))
        )
    key = F.col("score_key") if exact is not None else F.col("score")
    best = Window.partitionBy("doc_id", "seg_idx").orderBy(key.desc(), "o")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("doc_id", "seg_idx", "rank", "source", "target", "score")


def batch_terms(segments: DataFrame, merged: DataFrame, most_terms: int = MOST_TERMS, most_chars: int = MOST_CHARS, **options) -> DataFrame:
    """doc_id, seg_idx and the budgeted terms of every segment; equal texts are searched once."""
    keyed = segments.withColumn("text_key", F.struct(F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b")))
    once = keyed.groupBy("text_key").agg(F.first("text").alias("text")).select(F.col("text_key").alias("doc_id"), F.lit(0).alias("seg_idx"), "text")
    found = within_budget(relevant_terms(once, merged, k=most_terms, **options), most_terms, most_chars)
    return keyed.select("doc_id", "seg_idx", "text_key").join(found.drop("seg_idx").withColumnRenamed("doc_id", "text_key"), "text_key").drop("text_key")


def within_budget(ranked: DataFrame, most_terms: int = MOST_TERMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """The prefix by rank that keeps to the count and character budgets; the first term that
    does not fit ends it."""
    upto = Window.partitionBy("doc_id", "seg_idx").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.length("source") + F.length("target")).over(upto)
    return ranked.withColumn("used", used).where((F.col("used") <= most_chars) & (F.col("rank") <= most_terms))


def term_list(ranked: DataFrame) -> DataFrame:
    """doc_id, seg_idx, terms: "source: target" lines in rank order."""
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(": ", "source", "target").alias("line"))))
    return ranked.groupBy("doc_id", "seg_idx").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("terms"))


def parse_term_list(terms: Column) -> Column:
    """Pairs of a term list; a line is cut at its first colon."""
    pair = lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]).alias("source"), F.trim(F.split(x, ":", 2)[1]).alias("target"))
    return F.transform(F.filter(F.split(terms, "\n"), lambda x: F.contains(x, F.lit(":"))), pair)


def parse_content(content: Column) -> Column:
    """Pairs of the older "a: b; c: d" form."""
    pair = lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]).alias("source"), F.trim(F.split(x, ":", 2)[1]).alias("target"))
    return F.transform(F.filter(F.split(content, ";"), lambda x: F.contains(x, F.lit(":"))), pair)


def parse_ids(ids: Column) -> Column:
    """Whole numbers of a comma list; anything else is left out."""
    return F.transform(F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("bigint"))
