"""Text predicates and scalars as Column functions.

Every character class is spelled out, so that Spark's regular expressions and the SQL
oracles' agree with what Python's string methods decide. Null texts give null unless a
function's docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------------------
#: Characters that str.isspace accepts.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
ASCII_PUNCTUATION = r"!-/:-@\[-`{-~"
CJK_PUNCTUATION = "：【】，。、？」「；！@￥（）"
#: Digits outside category Nd that str.isdigit accepts.
OTHER_DIGITS = "²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒፩-፱᧚"
CJK = r"\x{4e00}-\x{9fff}"
WORD = r"\p{L}\p{N}_"
SENTENCE_END = r"(?<=[.!?。！？;；:：…—]) +|(?<=[。！？；：…—])[" + SPACE + "]*"
REFUSALS = (
    "Sorry, I cannot",
    "I am sorry,",
    "I'm sorry,",
    "Sorry, I can't",
    "Sorry, I need more",
    "抱歉，无法",
    "错误：提供的文本",
    "无法翻译",
    "抱歉，我无法",
    "对不起，我无法",
    "ご指示の内容は",
    "申し訳ございません",
    "Простите，",
    "Извините,",
    "Lo siento,",
)
UNIT_SIGNS = "•℃VAhH"
#: Signs that make a span a symbol, as the filter lists them.
SYMBOLS = (
    "★☆♥♦♣♠♀♂☼☾☽♪♫♬☑☒✓✔✕✖✗✘⊕⊗∞∑∏πΠ±×÷√∛∜∫∮∇∂∆∏∑√∝∞∟∠∡∢∣∤∥∦∧∨∩∪∫∬∭∮∯∰∱∲∳∴∵∶∷∸∹∺∻∼∽∾∿"
    "≀≁≂≃≄≅≆≇≈≉≊≋≌≍≎≏≐≑≒≓≔≕≖≗≘≙≚≛≜≝≞≟≠≡≢≣≤≥≦≧≨≩≪≫≬≭≮≯≰≱≲≳≴≵≶≷≸≹≺≻≼≽≾≿"
    "⊀⊁⊂⊃⊄⊅⊆⊇⊈⊉⊊⊋⊌⊍⊎⊏⊐⊑⊒⊓⊔⊕⊖⊗⊘⊙⊚⊛⊜⊝⊞⊟⊠⊡⊢⊣⊤⊥⊦⊧⊨⊩⊪⊫⊬⊭⊮⊯⊰⊱⊲⊳⊴⊵⊶⊷⊸⊹⊺⊻⊼⊽⊾⊿"
    "⋀⋁⋂⋃⋄⋅⋆⋇⋈⋉⋊⋋⋌⋍⋎⋏⋐⋑⋒⋓⋔⋕⋖⋗⋘⋙⋚⋛⋜⋝⋞⋟⋠⋡⋢⋣⋤⋥⋦⋧⋨⋩⋪⋫⋬⋭⋮⋯⋰⋱⋲⋳⋴⋵⋶⋷⋸⋹⋺⋻⋼⋽⋾⋿"
)
NUMBERS = r"^[\p{Nd}" + SPACE + r".,\-+*/()\[\]{}]+$"
TITLE_NUMBER = r"^\p{Nd}+(?:\.\p{Nd}+)*\.?[" + SPACE + "]*$"
EXPLANATIONS = ("翻译", "根据上下文", "答案是", "结果", "应该是", "输出", "输入", "让我分析", "根据", "记住")
ABNORMAL_SIGNS = "♂☼⚡"
ABNORMAL_PUNCTUATION = "，。！？、；：\"（）【】"
#: Prompt hints that models repeat, as patterns over lines, case-blind.
HINTS = (
    r"The text originates from the domains of.*?document fields\.",
    r"This text is from the engineering vehicle.*?administrative documents\.",
    r"This text is from the automotive and governmental domains.*?Certificate domains\.",
    r"engineering vehicles.*?administrative documents",
    r"heavy machinery.*?construction equipment",
    r"professional terminologies.*?administrative processes",
    r"technical accuracy.*?industry-specific jargon",
    r"formal and precise technical description.*?engineering documents",
    r"rigorous.*?formal.*?official style.*?government communication",
    r"automotive and governmental domains.*?Agreement & Certificate domains",
    r"このテキストは自動車および政府関連の分野に属します.*?整合させるようにしてください[。.]",
    r"自動車および政府関連の分野",
    r"技術仕様.*?安全指示.*?メンテナンス手順",
    r"車両のユーザーマニュアル",
    r"公式かつ正確で標準化された表現",
    r"政府の公文書",
    r"「機械」と「契約・証明書」の分野",
    r"用語は.*?整合させる",
    r"O texto se origina dos domínios de.*?campos de documentos[.]",
    r"Os domínios de.*?documentos oficiais",
    r"máquinas pesadas.*?equipamentos de construção",
    r"terminologias profissionais.*?processos administrativos",
)
#: Private-use characters that stand for icons.
ICONS = r"\x{f000}-\x{f8ff}"
LANGUAGE_IGNORED = SPACE + r"\p{Nd}.,;:!?()\[\]{}\"'\-"
# -------------------------------------------------------------------------------------

PUNCTUATION_ONLY = f"^[{ASCII_PUNCTUATION}\\p{{Nd}}{SPACE}{CJK_PUNCTUATION}{OTHER_DIGITS}]*$"


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_punctuation_only(text: Column) -> Column:
    """Only punctuation, digits and white space; the empty text counts."""
    return text.rlike(PUNCTUATION_ONLY)


def needs_translation(text: Column) -> Column:
    """Plain-text, csv and markdown segments: not empty and more than punctuation."""
    return F.coalesce((text != "") & ~is_punctuation_only(text), F.lit(False))


def md_needs_translation(text: Column) -> Column:
    """As ``needs_translation``; a lone line end is nothing either."""
    return needs_translation(text) & F.coalesce(text != "\n", F.lit(False))


def cell_needs_translation(value: Column) -> Column:
    """Workbook values: there, and more than punctuation."""
    return F.coalesce(~is_punctuation_only(value.cast("string")), F.lit(False))


def cjk_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{CJK}]"))


def weighted_count(text: Column) -> Column:
    """CJK characters count 1, spaces 0, all others one half."""
    cjk, spaces = cjk_chars(text), F.regexp_count(text, F.lit(" "))
    return cjk + 0.5 * (F.length(text) - cjk - spaces)


def token_estimate(text: Column) -> Column:
    """Whole part of the weighted count; 0 for null and blank texts."""
    blank = F.coalesce(stripped(text) == "", F.lit(True))
    return F.when(blank, F.lit(0)).otherwise(weighted_count(text).cast("int"))


def token_usage(reported_in: Column, reported_out: Column, reported_total: Column, source: Column, target: Column, terms: Column) -> Column:
    """Tokens of a call: the report where there is one, else estimates; terms add to the input."""
    into = F.coalesce(reported_in, token_estimate(source) + token_estimate(F.coalesce(terms, F.lit(""))))
    out = F.coalesce(reported_out, token_estimate(target))
    return F.struct(into.alias("input_tokens"), out.alias("output_tokens"), F.coalesce(reported_total, into + out).alias("total_tokens"))


def sentences(text: Column) -> Column:
    """Split after sentence marks that spaces follow, and anywhere after CJK ones."""
    return F.split(text, SENTENCE_END)


def pack_parts(pieces: Column, limit: int) -> Column:
    """Greedy parts of at most ``limit`` characters (joining spaces not counted); a longer
    piece that opens a part stands alone."""
    start = F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("cuts"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("size"))

    def step(acc: Column, piece: Column) -> Column:
        """``at`` and ``n`` delimit the open part among the pieces; only places are kept."""
        size = F.length(piece)
        fits, held = acc["size"] + size <= limit, acc["n"] > 0
        end = acc["at"] + acc["n"]
        cut = F.struct(acc["at"].alias("at"), F.when(held, acc["n"]).otherwise(F.lit(1)).alias("n"))
        return F.struct(
            F.when(fits, acc["cuts"]).otherwise(F.array_append(acc["cuts"], cut)).alias("cuts"),
            F.when(fits, acc["at"]).when(held, end).otherwise(end + 1).alias("at"),
            F.when(fits, acc["n"] + 1).when(held, F.lit(1)).otherwise(F.lit(0)).alias("n"),
            F.when(fits, acc["size"] + size).when(held, size).otherwise(F.lit(0)).alias("size"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.array_append(acc["cuts"], F.struct(acc["at"].alias("at"), acc["n"].alias("n")))).otherwise(acc["cuts"])

    # Places are looked up one by one: ``slice`` would go over all pieces for every part.
    joined = lambda p: lambda c: F.array_join(F.transform(F.sequence(c["at"], c["at"] + c["n"] - 1), lambda i: F.get(p, i)), " ")
    # The pieces are bound to a variable: named inside the lambda, they would be computed again for every part.
    parts = lambda p: F.transform(F.aggregate(p, start, step, finish), joined(p))
    return F.get(F.transform(F.array(pieces), parts), F.lit(0))


def pack_lines(text: Column, limit: int = 1000) -> Column:
    """Lines of a text in parts of at most ``limit`` characters, each line with its end: lines of
    nothing but signs are left out, blank ones stay; a longer line closes the open part and is
    packed by sentences. Array of struct(text, sub): ``sub`` marks parts of a longer line; the text
    of a part that needs no translation is empty."""
    lines = F.filter(F.split(text, "\n"), lambda x: needs_translation(x) | (stripped(x) == ""))
    start = F.struct(F.array().cast("array<struct<text:string,sub:boolean>>").alias("done"), F.lit("").alias("open"))
    part = lambda c, sub: F.struct(c.alias("text"), F.lit(sub).alias("sub"))

    def step(acc: Column, line: Column) -> Column:
        closed = F.when(acc["open"] != "", F.array_append(acc["done"], part(acc["open"], False))).otherwise(acc["done"])
        long = F.length(line) > limit
        over = F.length(acc["open"]) + F.length(line) > limit
        whole = F.concat(line, F.lit("\n"))
        return F.struct(
            F.when(long, F.concat(closed, F.transform(pack_sentences(line, limit), lambda s: part(s, True)))).when(over, closed).otherwise(acc["done"]).alias("done"),
            F.when(long, F.lit("")).when(over, whole).otherwise(F.concat(acc["open"], whole)).alias("open"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.array_append(acc["done"], part(acc["open"], False))).otherwise(acc["done"])

    shown = lambda x: F.struct(F.when(needs_translation(x["text"]), x["text"]).otherwise(F.lit("")).alias("text"), x["sub"].alias("sub"))
    return F.transform(F.aggregate(lines, start, step, finish), shown)


def pack_sentences(text: Column, limit: int = 1000) -> Column:
    return pack_parts(sentences(text), limit)


def pack_cell_words(cell: Column, limit: int = 1000) -> Column:
    """Words of a csv cell packed to ``limit`` characters, a space counted with each word;
    a first word over the limit leaves an empty first part before it."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, word: Column) -> Column:
        over = F.length(acc["open"]) + F.length(word) + 1 > limit
        joined = F.when(acc["open"] != "", F.concat(acc["open"], F.lit(" "), word)).otherwise(word)
        return F.struct(
            F.when(over, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(over, word).otherwise(joined).alias("open")
        )

    words = F.filter(F.split(cell, f"[{SPACE}]+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def tokens(text: Column) -> Column:
    """Lower-case word tokens of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), 0), lambda w: F.length(w) >= 2)


def is_pure_symbol(text: Column) -> Column:
    """Null, blank, up to three characters without word characters."""
    bare = stripped(text)
    short = (F.length(bare) <= 3) & ~bare.rlike(f"[{WORD}]")
    return F.coalesce((bare == "") | short, F.lit(True))


def is_pure_number(text: Column) -> Column:
    """Signed integers, decimals and exponents; commas only as thousands separators."""
    bare = stripped(text)
    number = F.replace(bare, F.lit(","), F.lit("")).rlike(r"^[+-]?(?:\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)(?:[eE][+-]?\p{Nd}+)?$")
    grouped = bare.rlike(r"^[+-]?\p{Nd}{1,3}(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?(?:[eE][+-]?\p{Nd}+)?$")
    return F.coalesce(number & (~F.contains(bare, F.lit(",")) | grouped), F.lit(False))


def is_refusal(text: Column) -> Column:
    """Starts with one of the refusal openings."""
    out = F.startswith(text, F.lit(REFUSALS[0]))
    for opening in REFUSALS[1:]:
        out = out | F.startswith(text, F.lit(opening))
    return F.coalesce(out, F.lit(False))


def is_symbols_only(text: Column) -> Column:
    return text.rlike(f"^[{SYMBOLS}]+$")


def is_numbers_only(text: Column) -> Column:
    return text.rlike(NUMBERS)


def is_title_number(text: Column) -> Column:
    return stripped(text).rlike(TITLE_NUMBER)


def word_should_translate(text: Column) -> Column:
    """Document runs: heading numbers pass, numbers and symbols do not."""
    bare = stripped(text)
    rest = ~is_numbers_only(bare) & ~is_symbols_only(bare)
    return F.coalesce((bare != "") & (is_title_number(text) | rest), F.lit(False))


def word_check_text(text: Column) -> Column:
    """Document paragraphs: heading numbers and whatever starts with a letter or digit pass."""
    first_alnum = text.rlike(r"^[\p{L}\p{N}]")
    bare = stripped(text) == ""
    short = (F.length(text) <= 3) & ~text.rlike(r"[\p{L}\p{N}]")
    rest = ~bare & ~short & ~is_symbols_only(text) & ~is_numbers_only(text) & ~is_punctuation_only(text)
    return F.coalesce((text != "") & (is_title_number(text) | first_alnum | rest), F.lit(False))


def pdf_should_translate(text: Column) -> Column:
    """Spans of at most two characters pass if CJK, digits or unit signs; longer ones unless
    symbols, numbers or punctuation."""
    bare = stripped(text)
    short = bare.rlike(f"^[{CJK}]*$") | bare.rlike(f"^[\\p{{Nd}}{OTHER_DIGITS}]+$") | bare.rlike(f"^[{UNIT_SIGNS}]*$")
    short = short | ((F.length(bare) == 2) & bare.rlike(f"[{CJK}]"))
    long = ~is_symbols_only(text) & ~is_numbers_only(text) & ~is_punctuation_only(text)
    return F.coalesce((text != "") & F.when(F.length(bare) <= 2, short).otherwise(long), F.lit(False))


def pdf_skip_reason(text: Column) -> Column:
    """Why a span is left alone: empty, short, symbols, numbers, punctuation or other."""
    return (
        F.when(F.coalesce(text == "", F.lit(True)), "empty")
        .when(F.length(stripped(text)) <= 2, F.when(pdf_should_translate(text), "short, allowed").otherwise("short"))
        .when(is_symbols_only(text), "symbols")
        .when(is_numbers_only(text), "numbers")
        .when(is_punctuation_only(text), "punctuation")
        .otherwise("other")
    )


def toc_parts(text: Column) -> Column:
    """A contents line as struct(main, page): page is the trailing separator and number."""
    page = F.regexp_extract(text, r"[" + SPACE + r"\-—_]+\p{Nd}+$", 0)
    return F.struct(F.substring(text, F.lit(1), F.length(text) - F.length(page)).alias("main"), page.alias("page"))


def edge_spaces(text: Column) -> Column:
    """struct(leading, trailing): numbers of blanks at both ends."""
    text = F.coalesce(text, F.lit(""))
    return F.struct((F.length(text) - F.length(F.ltrim(text))).alias("leading"), (F.length(text) - F.length(F.rtrim(text))).alias("trailing"))


def pad_edges(source: Column, target: Column) -> Column:
    """``target`` with at least as many blanks at its ends as ``source``; never trims."""
    want, have = edge_spaces(source), edge_spaces(target)
    missing = lambda side: F.repeat(F.lit(" "), F.greatest(want[side] - have[side], F.lit(0)))
    return F.concat(missing("leading"), target, missing("trailing"))


def restore_edges(text: Column, leading: Column, trailing: Column) -> Column:
    """Blanks, tabs and no-break spaces at the ends replaced by the given ones."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\x{a0}]+|[ \t\x{a0}]+$", "")
    return F.concat(F.coalesce(leading, F.lit("")), bare, F.coalesce(trailing, F.lit("")))


def restore_numbering(source: Column, target: Column) -> Column:
    """What ``target`` lost of the source's beginning is put back: a leading number (with point,
    blanks and signs); without a number, icons that begin within the first 20 characters, with
    what stands before them."""
    prefix = F.regexp_extract(source, r"^[" + SPACE + r"]*\p{Nd}+\.?[" + SPACE + r"]*[^" + WORD + "]*", 0)
    bare = F.regexp_replace(target, f"^[{SPACE}]+", "")
    missing = F.filter(F.regexp_extract_all(source, F.lit(f"[{ICONS}]"), 0), lambda icon: ~F.contains(target, icon))
    at = F.instr(source, F.get(missing, F.lit(0))) - 1
    icons = F.concat(F.substring(source, F.lit(1), at), F.array_join(missing, ""))
    lost_icons = (F.size(missing) > 0) & (at < 20) & ~F.startswith(target, icons)
    return (
        F.when(F.coalesce((source == "") | (target == ""), F.lit(True)), target)
        .when(prefix != "", F.when(F.startswith(target, prefix), target).otherwise(F.concat(prefix, bare)))
        .when(lost_icons, F.concat(icons, bare))
        .otherwise(target)
    )


def placeholders_too_dense(text: Column, mark: str = "♂") -> Column:
    """Marks are 3 in 10 characters, alternate with characters, or follow each other."""
    compact = F.replace(text, F.lit(" "), F.lit(""))
    count = F.regexp_count(text, F.lit(mark))
    size = F.greatest(F.when(F.length(compact) > 0, F.length(compact)).otherwise(F.length(text)), F.lit(1))
    alternating = compact.rlike(f"^(?:[^{mark}]{mark})+[^{mark}]?$")
    return (count > 0) & (alternating | F.contains(text, F.lit(mark * 2)) | (count / size >= 0.3))


def clean_placeholder_spaces(text: Column, mark: str = "♂") -> Column:
    """The blank after an opening mark goes where its pair is set off by blanks."""
    return F.regexp_replace(text, f"{mark} (.+?) {mark}", f"{mark}$1 {mark}")


FORMAT_TAG = r"<run\d+>|</run\d+>|<tags\d+/>|<lendof\d+\|>|<[a-z]+\d*[^>]*/>"


def mask_format_tags(text: Column) -> Column:
    """struct(text, tags): format tags replaced by numbered tokens, and the tags in order."""
    tags = F.regexp_extract_all(text, F.lit(FORMAT_TAG), 0)
    pieces = F.split(text, FORMAT_TAG, -1)
    masked = F.array_join(F.transform(pieces, lambda p, i: F.when(i > 0, F.concat(F.lit("__FORMAT_TAG_"), (i - 1).cast("string"), F.lit("__"), p)).otherwise(p)), "")
    return F.struct(masked.alias("text"), tags.alias("tags"))


def unmask_format_tags(text: Column, tags: Column) -> Column:
    numbered = F.transform(tags, lambda t, i: F.struct(F.concat(F.lit("__FORMAT_TAG_"), i.cast("string"), F.lit("__")).alias("token"), t.alias("tag")))
    return F.aggregate(numbered, text, lambda acc, x: F.replace(acc, x["token"], x["tag"]))


def has_private_use(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\x{e000}-\x{f8ff}]"), F.lit(False))


def strip_reasoning(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def clean_result(text: Column) -> Column:
    """Context marks and introductions removed, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(text, r"\[前文:.*?\]", ""), r"\[后文:.*?\]", "")
    for word in EXPLANATIONS:
        out = F.regexp_replace(out, f"{word}.*?[:：][{SPACE}]*", "")
    return stripped(F.regexp_replace(out, f"[{SPACE}]+", " "))


def remove_hints(text: Column, patterns: tuple[str, ...] = HINTS) -> Column:
    """Leaked prompt hints removed by case-blind patterns over lines; blank lines and the ends of
    lines trimmed."""
    out = text
    for p in patterns:
        out = F.regexp_replace(out, f"(?isu){p}", "")
    out = F.regexp_replace(out, f"(?i)^(领域提示|Domain Hint|领域说明|Domain Description)[:：][{SPACE}]*", "")
    out = F.regexp_replace(out, f"\n[{SPACE}]*\n", "\n")
    out = F.regexp_replace(out, f"(?md)^[{SPACE}]+|[{SPACE}]+$", "")
    return stripped(F.replace(out, F.lit("♦"), F.lit("")))


#: Targets that get the Latin font, font names that it replaces, and the font.
ENGLISH_NAMES = ("english", "en", "eng")
FONT_NAMES = ("arial", "simsun", "simhei", "microsoft", "calibri", "verdana", "tahoma", "宋体", "黑体", "微软雅黑", "新宋体", "仿宋", "楷体")
LATIN_FONT = "Times New Roman"
FONT_ATTRIBUTE = r'([A-Za-z:\-]*(?:font|family|typeface)[A-Za-z\-]*=")[^"]*(")'


def english_fonts(content: Column, language: Column) -> Column:
    """Markup whose fonts, in attributes and by name, are the Latin one, for English targets; content with
    private-use characters keeps its fonts, as they may be icons. (In the surveyed system attributes stay by a slip.)"""
    named = F.regexp_replace(F.regexp_replace(content, "(?i)" + FONT_ATTRIBUTE, f"$1{LATIN_FONT}$2"), f"(?i)(?:{'|'.join(FONT_NAMES)})", LATIN_FONT)
    english = F.coalesce(F.lower(language).isin(*ENGLISH_NAMES), F.lit(False))
    return F.when(english & ~has_private_use(content), named).otherwise(content)


def is_abnormal(text: Column) -> Column:
    """Empty, a unit of up to ten characters four times on end, a tenth special signs, or only
    punctuation."""
    repeated = text.rlike(r"(.{1,10})\1{3,}")
    special = F.regexp_count(text, F.lit(f"[{ABNORMAL_SIGNS}]")) > 0.1 * F.length(text)
    return F.coalesce((text == "") | repeated | special | stripped(text).rlike(f"^[{ABNORMAL_PUNCTUATION}]+$"), F.lit(True))


def fingerprint(*fields: Column) -> Column:
    """md5 of the fields put together, nulls as empty."""
    return F.md5(F.concat(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def _share(text: Column, chars: str) -> Column:
    counted = F.regexp_count(text, F.lit(f"[^{LANGUAGE_IGNORED}]"))
    return F.when(counted > 0, F.regexp_count(text, F.lit(f"[{chars}]")) / counted).otherwise(F.lit(0.0))


def is_chinese_text(text: Column) -> Column:
    return F.coalesce(_share(text, CJK) > 0.5, F.lit(False))


def is_english_text(text: Column) -> Column:
    return F.coalesce(_share(text, "A-Za-z") > 0.7, F.lit(False))


def spacing_need(source: Column, target: Column) -> Column:
    """chinese_to_english (spaces are added), english_to_chinese or preserve_original."""
    zh, en = is_chinese_text(source), is_english_text(target)
    return F.when(zh & en, "chinese_to_english").when(is_chinese_text(target) & ~zh, "english_to_chinese").otherwise("preserve_original")


def fill_prompt(template: Column, language: Column) -> Column:
    return F.replace(template, F.lit("{target_lang}"), language)


#: Default wordings; callers give their own where a model needs another.
MARKDOWN_RULE = " Translate only the text of this Markdown; headings, lists, code, links and all other marks stay as they are."
CONTEXT_RULE = " Text in square brackets is context: use it to understand the rest, but neither translate nor repeat it. Answer in {target_lang} with the translation alone."
#: Openings of neighbours' context in a segment (fixed values).
CONTEXT_MARKS = ("[前文:", "[后文:")


def build_prompt(template: Column, language: Column, text: Column, markdown: Column, slots: dict[str, Column] | None = None, markdown_rule: str = MARKDOWN_RULE, context_rule: str = CONTEXT_RULE) -> Column:
    """A template for one segment: the markdown rule behind it for markdown, the context rule where the text
    carries its neighbours, then named slots ({name}) and the language filled in; a null slot is empty."""
    has_context = F.contains(text, F.lit(CONTEXT_MARKS[0])) | F.contains(text, F.lit(CONTEXT_MARKS[1]))
    out = F.concat(template, F.when(markdown, markdown_rule).otherwise(""), F.when(has_context, context_rule).otherwise(""))
    for name, value in (slots or {}).items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return fill_prompt(out, language)


def normal_api_url(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("v1")), url).when(F.endswith(url, F.lit("/")), F.concat(url, F.lit("v1/"))).otherwise(F.concat(url, F.lit("/v1/")))


def preview(text: Column, n: int = 500) -> Column:
    return F.substring(text, 1, n)


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
