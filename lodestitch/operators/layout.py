"""Layout arithmetic: fonts, line spacing, image boxes, run merging, text distribution, overlaps.

Native expressions over plain columns, arrays and structs; no document format is touched here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.functions import text as X


def length_ratio(source: Column, target: Column) -> Column:
    """Stripped target length over stripped source length; null for an empty source."""
    return F.length(X.stripped(target)) / F.nullif(F.length(X.stripped(source)), F.lit(0))


def word_font(source: Column, target: Column, size: Column) -> Column:
    """Smaller (70 % at least) for texts a fifth longer, larger (120 % at most) for shorter ones."""
    r = length_ratio(source, target)
    fit = F.when(r > 1.2, F.greatest(size * 0.7, size / r)).when(r < 0.8, F.least(size * 1.2, size / F.nullif(r, F.lit(0.0))))
    return F.when(r.isNull() | ((r >= 0.8) & (r <= 1.2)), size.cast("double")).otherwise(F.floor(fit).cast("double"))


def slide_font(source: Column, target: Column, size: Column) -> Column:
    """As :func:`word_font` with the bounds of slides: 1.3 and 0.7, down to 50 %, up to 130 %."""
    r = length_ratio(source, target)
    fit = F.when(r > 1.3, F.greatest(size * 0.5, size / r)).when(r < 0.7, F.least(size * 1.3, size / F.nullif(r, F.lit(0.0))))
    return F.when(r.isNull() | ((r >= 0.7) & (r <= 1.3)), size.cast("double")).otherwise(F.floor(fit).cast("double"))


def slide_scale(source_chars: Column, target_chars: Column) -> Column:
    """Scale of a slide whose text grew: ``max(0.5, 2 / 3r)`` above 1.5, ``max(0.5, 1 / r)`` above 1."""
    r = target_chars / F.nullif(source_chars, F.lit(0))
    return F.when(r > 1.5, F.greatest(F.lit(0.5), 2 / (3 * r))).when(r > 1, F.greatest(F.lit(0.5), 1 / r)).otherwise(F.lit(1.0))


def line_spacing(source: Column, target: Column, spacing: Column) -> Column:
    """Up to 150 % where lines were added, down to 80 % where they went."""
    lines = lambda t: F.size(F.split(t, "\n"))
    r = lines(target) / lines(source)
    return F.when(r > 1.1, F.least(spacing * 1.5, spacing * r)).when(r < 0.9, F.greatest(spacing * 0.8, spacing * r)).otherwise(spacing.cast("double"))


def image_box(mode: str, width: Column, height: Column, page_width: Column, page_height: Column, margin: float = 0.0, custom: Column | None = None) -> Column:
    """struct(x0, y0, x1, y1) of an image on its page: fit, stretch, center or custom."""
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    free_w, free_h = page_width - 2 * margin, page_height - 2 * margin
    if mode == "fit":
        scale = F.least(free_w / width, free_h / height)
        x0, y0 = margin + (free_w - width * scale) / 2, margin + (free_h - height * scale) / 2
        return box(x0, y0, x0 + width * scale, y0 + height * scale)
    if mode == "stretch":
        return box(F.lit(margin), F.lit(margin), page_width - margin, page_height - margin)
    if mode == "center":
        x0, y0 = (page_width - width) / 2, (page_height - height) / 2
        return box(x0, y0, x0 + width, y0 + height)
    if mode == "custom" and custom is not None:
        return custom
    raise ValueError(f"unknown mode {mode!r}, or custom without a box")


def distribute_even_tail(lengths: Column, target: Column) -> Column:
    """``target`` cut over runs in proportion to their lengths, one character at least for each
    run with text, the rest to the last; runs without text get none."""
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    last = F.size(lengths) - 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("i"))

    def step(acc: Column, n: Column) -> Column:
        share = F.greatest(F.lit(1), F.floor(F.length(target) * n / F.nullif(total, F.lit(0))).cast("int"))
        left = F.length(target) - acc["at"]
        take = F.when(n == 0, 0).when(acc["i"] == last, left).otherwise(F.least(share, left))
        return F.struct(
            (acc["at"] + take).alias("at"), F.array_append(acc["out"], F.substring(target, acc["at"] + 1, take)).alias("out"), (acc["i"] + 1).alias("i")
        )

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def distribute_words(runs: Column, target: Column, parity: bool = False) -> Column:
    """``target`` over runs (array of texts): by proportion if its length changed by at most 2,
    else a word each, else equal slices. The last run takes what is left; with ``parity`` it
    does not, as in the surveyed system, which can lose the tail."""
    n = F.size(runs)
    total = F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x))
    words = F.filter(F.split(target, f"[{X.SPACE}]+"), lambda w: w != "")
    cuts = lambda i: F.aggregate(F.slice(runs, 1, i), F.lit(0), lambda a, x: a + F.floor(F.length(target) * F.length(x) / F.nullif(total, F.lit(0))).cast("int"))
    tail = F.lit(not parity)
    indices = F.sequence(F.lit(0), n - 1)
    near = F.transform(
        indices,
        lambda i: F.substring(target, cuts(i) + 1, F.when(tail & (i == n - 1), F.length(target)).otherwise(cuts(i + 1) - cuts(i))),
    )
    rest = lambda i: F.array_join(F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))), " ")
    each = F.transform(indices, lambda i: F.when(tail & (i == n - 1), rest(i)).otherwise(F.coalesce(F.get(words, i), F.lit(""))))
    width = F.floor(F.length(target) / n).cast("int")
    slices = F.transform(indices, lambda i: F.substring(target, i * width + 1, F.when(i == n - 1, F.length(target)).otherwise(width)))
    return (
        F.when(n == 1, F.array(target))
        .when((total > 0) & (F.abs(F.length(target) - total) <= 2), near)
        .when(F.size(words) >= n, each)
        .otherwise(slices)
    )


def style_hash(props: Column) -> Column:
    """md5 of a property map in key order."""
    return F.md5(F.to_json(F.array_sort(F.map_entries(props))))


def merge_groups(runs: DataFrame, longest: int | None = None) -> DataFrame:
    """Neighbouring runs (para_id, run_idx, text, hash, bounded) of one style as groups: an empty
    or bounded run, or one over ``longest``, stands alone. para_id, group, first_run, runs, text."""
    order = Window.partitionBy("para_id").orderBy("run_idx")
    fit = (F.col("text") != "") & ~F.col("bounded")
    if longest is not None:
        fit = fit & (F.length("text") <= longest)
    marked = runs.withColumn("fit", fit)
    joined = F.col("fit") & F.lag("fit", 1, False).over(order) & F.col("hash").eqNullSafe(F.lag("hash").over(order))
    grouped = marked.withColumn("start", (~joined).cast("int")).withColumn("group", F.sum("start").over(order))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("run_idx", "text"))), lambda x: x["text"])
    return grouped.groupBy("para_id", "group").agg(F.min("run_idx").alias("first_run"), F.count("*").alias("runs"), F.array_join(texts, "").alias("text"))


def merge_short(runs: DataFrame, longest: int = 20, total: int = 1000) -> DataFrame:
    """Short neighbouring runs (para_id, run_idx, text, hash, bounded) of one style in groups of at
    most ``total`` characters, greedily: a run of at most ``longest`` joins the open group or opens
    one; any other stands alone and closes it. Bounded runs close a group and are left out; runs
    of nothing but signs are passed over. para_id, part, first_run, runs, text.
    Conservative: 20 and 1000; strict: 5 and 10."""
    shown = runs.where(F.col("bounded") | X.needs_translation(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("run_idx", "text", "hash", "bounded")))
    group = "struct<first_run:bigint,runs:int,text:string>"
    start = F.struct(
        F.lit(None).cast(f"array<{group}>").alias("done"), F.lit(0).cast("long").alias("first_run"), F.lit(0).alias("runs"), F.lit("").alias("text"), F.lit(None).cast("string").alias("hash")
    ).withField("done", F.array().cast(f"array<{group}>"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["runs"] > 0
        fits = (F.length(x["text"]) <= longest) & (~held | x["hash"].eqNullSafe(acc["hash"])) & (F.length(acc["text"]) + F.length(x["text"]) <= total)
        joins = ~x["bounded"] & fits
        whole = lambda first, n, text: F.struct(first.cast("long").alias("first_run"), n.alias("runs"), text.alias("text"))
        closed = F.when(held, F.array_append(acc["done"], whole(acc["first_run"], acc["runs"], acc["text"]))).otherwise(acc["done"])
        alone = F.when(x["bounded"], closed).otherwise(F.array_append(closed, whole(x["run_idx"], F.lit(1), x["text"])))
        return F.struct(
            F.when(joins, acc["done"]).otherwise(alone).alias("done"),
            F.when(joins & held, acc["first_run"]).otherwise(x["run_idx"].cast("long")).alias("first_run"),
            F.when(joins, acc["runs"] + 1).otherwise(F.lit(0)).alias("runs"),
            F.when(joins, F.concat(acc["text"], x["text"])).otherwise(F.lit("")).alias("text"),
            F.when(joins, x["hash"]).alias("hash"),
        )

    def finish(acc: Column) -> Column:
        last = F.struct(acc["first_run"].alias("first_run"), acc["runs"].alias("runs"), acc["text"].alias("text"))
        return F.when(acc["runs"] > 0, F.array_append(acc["done"], last)).otherwise(acc["done"])

    packed = shown.groupBy("para_id").agg(F.aggregate(ordered, start, step, finish).alias("g"))
    return packed.select("para_id", F.posexplode("g").alias("part", "x")).select("para_id", "part", "x.*")


#: Kinds of boundaries that keep a run apart.
BOUNDARIES = "field bookmark hyperlink comment revision footnote endnote break tab drawing inline_shape math".split()


def is_bounded(flags: Column) -> Column:
    """Whether any kind of boundary is set in a map of flags (``has_`` and the kind); other flags do not count."""
    kinds = F.array(*[F.lit(f"has_{kind}") for kind in BOUNDARIES])
    return F.exists(kinds, lambda kind: F.coalesce(F.try_element_at(flags, kind), F.lit(False)))


def optimisation_rate(merged: Column, total: Column) -> Column:
    """Share of runs that were merged (counts), as text with one decimal, half up."""
    tenths = F.floor((merged.cast("long") * 2000 + total) / F.nullif(total.cast("long") * 2, F.lit(0)))
    return F.when(total > 0, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%"))).otherwise(F.lit("0%"))


def run_report(runs: DataFrame) -> DataFrame:
    """One row: paragraphs, runs, runs by length, styles, bounded runs, problem paragraphs (many
    runs, little text), and what merging promises as score and level."""
    n = F.length("text")
    per = runs.groupBy("para_id").agg(
        F.count("*").alias("n"),
        F.sum(n).alias("chars"),
        F.count_if(n == 0).alias("len_0"),
        F.count_if(n == 1).alias("len_1"),
        F.count_if(n.between(2, 5)).alias("len_2_5"),
        F.count_if(n.between(6, 20)).alias("len_6_20"),
        F.count_if(n.between(21, 50)).alias("len_21_50"),
        F.count_if(n > 50).alias("over_50"),
        F.count_if(F.col("bounded")).alias("bounded"),
    )
    styles = runs.agg(F.count_distinct("hash").alias("styles"))
    problem = (F.col("n") > 10) & (F.col("chars") < 100)
    lengths = ["len_0", "len_1", "len_2_5", "len_6_20", "len_21_50", "over_50", "bounded"]
    stats = per.agg(
        F.count("*").alias("paragraphs"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("runs"),
        F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 4).alias("runs_per_paragraph"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in lengths],
        F.count_if(problem).alias("problems"),
        F.count_if(problem & (F.col("n") > 20)).alias("severe"),
    ).join(styles, F.lit(True))
    points = [
        (F.col("runs") > 5 * F.col("paragraphs"), 30),
        (F.col("len_1") > 0.1 * F.col("runs"), 20),
        (F.col("len_0") > 0.05 * F.col("runs"), 10),
        (F.col("problems") > 0.1 * F.col("paragraphs"), 20),
        (F.col("styles") < 0.5 * F.col("runs"), 20),
    ]
    score = sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0))
    return stats.withColumn("score", score).withColumn("level", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "medium").otherwise("low"))


def slide_totals(texts: DataFrame) -> DataFrame:
    """slide_id, source_chars, target_chars (trimmed) and scale of every slide of ``texts``
    (slide_id, source, target)."""
    chars = lambda c: F.sum(F.length(X.stripped(F.coalesce(c, F.lit("")))))
    totals = texts.groupBy("slide_id").agg(chars(F.col("source")).alias("source_chars"), chars(F.col("target")).alias("target_chars"))
    return totals.withColumn("scale", slide_scale(F.col("source_chars"), F.col("target_chars")))


def slide_scales(source: DataFrame, target: DataFrame) -> DataFrame:
    """As ``slide_totals``, of the texts (slide_id, text) of two files; a slide that one of them lacks has 0 characters there."""
    chars = lambda df, name: df.groupBy("slide_id").agg(F.sum(F.length(X.stripped(F.coalesce("text", F.lit(""))))).alias(name))
    both = chars(source, "source_chars").join(chars(target, "target_chars"), "slide_id", "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("source_chars", "target_chars")})
    return both.withColumn("scale", slide_scale(F.col("source_chars"), F.col("target_chars")))


def distribute_near_spaces(runs: Column, target: Column) -> Column:
    """``target`` over runs: by proportion if its length changed by at most 2; else whole words,
    as many for each run, the first ones one more; with fewer words than runs, slices that end
    at the blank before (or else after) an even cut. Slices follow each other and the last run
    takes what is left; in the surveyed system they overlap where a cut moves."""
    n, size = F.size(runs), F.length(target)
    words = F.filter(F.split(target, f"[{X.SPACE}]+"), lambda w: w != "")
    each, more = F.floor(F.size(words) / n).cast("int"), F.size(words) % n
    first = lambda i: i * each + F.least(i, more)
    by_words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, first(i) + 1, first(i + 1) - first(i)), " "))
    width = F.floor(size / n).cast("int")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, i: Column) -> Column:
        even = F.greatest((i + 1) * width, acc["at"])
        before = F.length(F.regexp_extract(F.substring(target, acc["at"] + 2, even - acc["at"] - 1), r"(?s)^.* ", 0))
        after = F.instr(F.substring(target, even + 1, size), " ")
        cut = F.when((i == n - 1) | (even >= size), size).when(before > 0, acc["at"] + 1 + before).when(after > 0, even + after).otherwise(even)
        return F.struct(F.array_append(acc["out"], F.substring(target, acc["at"] + 1, cut - acc["at"])).alias("out"), cut.alias("at"))

    slices = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["out"])
    total = F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x))
    near = (total > 0) & (F.abs(size - total) <= 2)
    return F.when(near, distribute_words(runs, target)).when(F.size(words) >= n, by_words).otherwise(slices)


#: Marks beside which runs are joined without a blank.
JOIN_MARKS = ".,;:!?"


def join_spaced(parts: Column) -> Column:
    """Trimmed parts in a row, a blank between two unless a mark ends the one or begins the other."""
    shown = F.filter(F.transform(parts, lambda p: X.stripped(F.coalesce(p, F.lit("")))), lambda p: p != "")
    mark = lambda c: F.instr(F.lit(JOIN_MARKS), c) > 0

    def step(acc: Column, part: Column) -> Column:
        close = (acc == "") | mark(F.right(acc, F.lit(1))) | mark(F.left(part, F.lit(1)))
        return F.concat(acc, F.when(close, F.lit("")).otherwise(F.lit(" ")), part)

    return F.aggregate(shown, F.lit(""), step)


#: Side of the grid cells in which boxes meet.
CELL = 64.0


def _spread(boxes: DataFrame, bottom: str = "y1") -> DataFrame:
    """A row (cx, cy) for each grid cell that a box covers."""
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.greatest(lo, hi) / CELL))
    return boxes.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", bottom)))


def _reaching(boxes: DataFrame, bottom: str, others: DataFrame, gap: float) -> DataFrame:
    """page, id of the boxes that, with that lower edge, overlap another one by more than ``gap`` both
    ways. Boxes meet in grid cells, so a page is not gathered anywhere."""
    mine = _spread(boxes, bottom).select("page", "cx", "cy", "id", "x0", "y0", "x1", F.col(bottom).alias("end"))
    posted = _spread(others).select(*[F.col(c).alias(f"o_{c}") for c in ("page", "cx", "cy", "id", "x0", "y0", "x1", "y1")])
    same = (F.col("page") == F.col("o_page")) & (F.col("cx") == F.col("o_cx")) & (F.col("cy") == F.col("o_cy")) & (F.col("id") != F.col("o_id"))
    wide = F.least("x1", "o_x1") - F.greatest("x0", "o_x0") > gap
    high = F.least("end", "o_y1") - F.greatest("y0", "o_y0") > gap
    return mine.join(posted, same & wide & high, "left_semi").select("page", "id").distinct()


#: Boxes of a page that meet within one row; those of fuller pages meet in grid cells.
PAGE_BOXES = 64


def fit_boxes(boxes: DataFrame, gap: float = 2.0, most: int = PAGE_BOXES) -> DataFrame:
    """page, id, font, y1: fonts and lower edges of text boxes (page, id, x0, y0, x1, y1, font, source,
    target) for their new texts. A text a fifth longer gets a smaller font (60 % at least). A box that is
    then too high for its text shrinks; one that is too low grows by half (by 0.3 where it is alone on its page) at
    most; where that would overlap another box it keeps its height, less what is missing to a gap of 2 to
    the box below, and the font falls to 50 % at least. If it overlaps even so, the edge stays and the font is fitted by
    length alone. A text a fifth shorter gets a larger font (120 % at most). An empty source or target and a font
    that would vanish change nothing. (page, id) is a key; null coordinates meet no box.

    Pages of at most ``most`` boxes are gathered, a row each, and shuffled once; of fuller ones no page is gathered
    anywhere. Both give the same."""
    full = boxes.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("page").alias("full_page"))
    if full.isEmpty():
        return _fit_small(boxes, gap)
    is_full = F.col("page").eqNullSafe(F.col("full_page"))
    return _fit_small(boxes.join(full, is_full, "left_anti"), gap).unionByName(_fit_large(boxes.join(full, is_full, "left_semi"), gap))


def _measured(boxes: DataFrame) -> DataFrame:
    """What a box's fitting needs of the box alone: small, lines, needed and low, beside its place."""
    size, height, r = F.col("font").cast("double"), F.col("y1") - F.col("y0"), length_ratio(F.col("source"), F.col("target"))
    longer = F.coalesce(F.col("r") > 1.2, F.lit(False))
    step = boxes.select("page", "id", "x0", "y0", "x1", "y1", size.alias("size"), r.alias("r"), height.alias("h"), F.length(X.stripped(F.col("target"))).alias("chars"))
    step = step.withColumn("small", _whole(F.greatest(F.col("size") * 0.6, F.col("size") / F.nullif("r", F.lit(0.0)))))
    step = step.withColumn("small", F.when(longer & (F.col("small") > 0), F.col("small")))
    per_line = F.greatest(F.floor((F.col("x1") - F.col("x0")) / (F.col("small") * 0.6)), F.lit(1))
    step = step.withColumn("lines", F.greatest(F.floor(F.col("chars") / per_line) + 1, F.lit(1)))
    return step.withColumn("needed", F.col("lines") * F.col("small") * 1.2).withColumn("low", F.coalesce(F.col("needed") > F.col("h"), F.lit(False)))


def _whole(c: Column) -> Column:
    return F.floor(c).cast("double")


def _test(alone: Column) -> Column:
    return F.col("y0") + F.least("needed", F.col("h") * F.when(alone, 1.3).otherwise(1.5))


def _fitted(step: DataFrame) -> DataFrame:
    """``step`` (_measured, with test, hit and missing, which may be null) with new_font and bottom."""
    tight, safe = F.coalesce("hit", F.lit(False)), F.col("h") + F.coalesce("missing", F.lit(0.0))
    safe_lines = F.greatest(F.floor(safe / (F.col("small") * 1.2)), F.lit(1))
    less = _whole(F.greatest(F.col("size") * 0.5, F.col("small") * (safe_lines / F.col("lines"))))
    tall = F.when(~F.col("low"), F.col("needed")).when(tight, safe).otherwise(F.col("test") - F.col("y0"))
    larger = _whole(F.least(F.col("size") * 1.2, F.col("size") / F.nullif("r", F.lit(0.0))))
    fitted = F.when(F.col("small").isNotNull(), F.when(tight & (safe_lines < F.col("lines")), less).otherwise(F.col("small"))).when((F.col("r") > 0) & (F.col("r") < 0.8), larger)
    return step.withColumn("new_font", F.coalesce(fitted, F.col("size"))).withColumn("bottom", F.when(F.col("small").isNotNull(), F.col("y0") + tall).otherwise(F.col("y1")))


def _final(step: DataFrame) -> DataFrame:
    """page, id, font and y1 of ``_fitted`` boxes with still, which may be null."""
    least_font = _whole(F.greatest(F.col("size") * 0.5, F.col("size") / F.nullif("r", F.lit(0.0))))
    font = F.when(F.col("still"), least_font).otherwise(F.col("new_font"))
    return step.select("page", "id", font.alias("font"), F.when(F.col("still"), F.col("y1")).otherwise(F.col("bottom")).alias("y1"))


def _fit_small(boxes: DataFrame, gap: float) -> DataFrame:
    """``fit_boxes`` where the boxes of a page fit into a row."""
    step = _measured(boxes)
    place = F.struct(*[c for c in step.columns if c != "page"]).alias("box")
    pages = step.groupBy("page").agg(F.collect_list(place).alias("boxes"))
    edges = F.transform("boxes", lambda b: F.struct(*[b[c].alias(c) for c in ("id", "x0", "y0", "x1", "y1")]))
    step = pages.select("page", edges.alias("others"), F.explode("boxes").alias("box")).select("page", "others", "box.*")
    alone = F.size("others") == 1
    meets = F.col("page").isNotNull() & ~alone
    below = F.transform("others", lambda o: F.when((o["y0"] > F.col("y0")) & (o["y0"] > F.col("y1")) & (o["y0"] < F.col("y1") + gap), o["y0"] - F.col("y1")))

    def reaches(end: str) -> Column:
        placed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col(end).isNotNull()
        over = lambda o: (F.least("x1", o["x1"]) - F.greatest("x0", o["x0"]) > gap) & (F.least(end, o["y1"]) - F.greatest("y0", o["y0"]) > gap)
        known = lambda o: o["x0"].isNotNull() & o["y0"].isNotNull() & o["x1"].isNotNull() & o["y1"].isNotNull()
        return placed & F.exists("others", lambda o: F.coalesce((o["id"] != F.col("id")) & over(o) & known(o), F.lit(False)))

    step = step.withColumn("test", _test(alone))
    step = step.withColumns({"missing": F.when(meets & F.col("low"), F.array_min(below) - gap), "hit": F.when(meets & F.col("low"), reaches("test"))})
    return _final(_fitted(step).withColumn("still", F.when(meets & F.col("small").isNotNull(), reaches("bottom"))))


def _fit_large(boxes: DataFrame, gap: float) -> DataFrame:
    """``fit_boxes`` where pages may have any number of boxes."""
    step = _measured(boxes)
    pages = boxes.groupBy("page").agg((F.count("*") == 1).alias("alone"))
    step = step.join(pages, step["page"].eqNullSafe(pages["page"])).drop(pages["page"])
    step = step.withColumn("test", _test(F.col("alone")))

    # Only a box below that is nearer than the gap takes anything off the height.
    strip = lambda c: F.floor(F.col(c) / gap)
    edges = boxes.select(F.col("page").alias("e_page"), F.col("y0").alias("e_y0"), strip("y0").alias("strip")).distinct()
    near = step.where("low and not alone").select("page", "id", "y0", "y1", F.explode(F.array(strip("y1"), strip("y1") + 1)).alias("strip"))
    close = (F.col("page") == F.col("e_page")) & (near["strip"] == edges["strip"]) & (F.col("e_y0") > F.col("y0")) & (F.col("e_y0") > F.col("y1")) & (F.col("e_y0") < F.col("y1") + gap)
    missing = near.join(edges, close).groupBy("page", "id").agg((F.min(F.col("e_y0") - F.col("y1")) - gap).alias("missing"))
    hits = _reaching(step.where("low and not alone"), "test", boxes, gap).withColumn("hit", F.lit(True))
    step = _fitted(step.join(missing, ["page", "id"], "left").join(hits, ["page", "id"], "left"))
    still = _reaching(step.where("small IS NOT NULL and not alone"), "bottom", boxes, gap).withColumn("still", F.lit(True))
    return _final(step.join(still, ["page", "id"], "left"))


def column_widths(cells: DataFrame) -> DataFrame:
    """table_id, col, inches: a tenth of an inch for each character of a column's longest text, from
    half an inch to two."""
    return cells.groupBy("table_id", "col").agg(F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.max(F.length(F.coalesce("text", F.lit("")))) * 0.1)).alias("inches"))


def overlapping(boxes: DataFrame, gap: float = 2.0) -> DataFrame:
    """Pairs (page, a, b) of boxes of a page that overlap by more than ``gap`` both ways.

    Boxes are posted to the grid cells they cover, so only neighbours meet; a pair is
    reported in the one cell that holds the corner of its intersection."""
    posted = _spread(boxes)
    a, b = posted.alias("a"), posted.alias("b")
    x0, y0 = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    x1, y1 = F.least("a.x1", "b.x1"), F.least("a.y1", "b.y1")
    same = (F.col("a.page") == F.col("b.page")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    home = (F.floor(x0 / CELL) == F.col("a.cx")) & (F.floor(y0 / CELL) == F.col("a.cy"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id")) & (x1 - x0 > gap) & (y1 - y0 > gap) & home).select(
        F.col("a.page").alias("page"), F.col("a.id").alias("a"), F.col("b.id").alias("b")
    )


def table_scale(cells: DataFrame, box_width: float = 3.5) -> DataFrame:
    """table_id, scale: fonts of a text-box table shrink where its columns do not fit.

    A column is as wide as its longest text at its font (10 points at least)."""
    size = F.greatest(F.coalesce("font_size", F.lit(10.0)), F.lit(10.0))
    columns = cells.groupBy("table_id", "col").agg((F.max(F.length("text")) * F.max(size) * 0.8 / 72).alias("width"))
    total = columns.groupBy("table_id").agg((F.sum("width") + 0.1 * F.count("*") + 0.1 * (F.count("*") - 1)).alias("total"))
    usable = max(2.0, (box_width * 1.2 if box_width < 4 else box_width) - 0.3)
    return total.select("table_id", F.when(F.col("total") > usable, usable / F.col("total") * 0.95).otherwise(F.lit(1.0)).alias("scale"))


def box_width_inches(value: Column, unit: Column) -> Column:
    """Widths in pt, px, cm or EMU as inches; 3.5 where nothing is given."""
    by = {"pt": 72.0, "px": 96.0, "cm": 2.54, "emu": 914400.0}
    out = F.when(unit == "in", value)
    for name, n in by.items():
        out = out.when(unit == name, value / n)
    return F.coalesce(out, F.lit(3.5))
