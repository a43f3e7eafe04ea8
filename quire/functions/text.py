"""Text rules as Column functions. Lengths are code points; white space is Unicode's, NBSP and BOM included."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quire.functions.numbers import half_up

#: The intersection rules letters out by one comparison, where the list alone takes ten for each letter.
WS = r"[\x{0}-\x20\x7F-\x{10FFFF}&&[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
_WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Word boundaries over ASCII letters, digits and underscore only, which Java's \b is not.
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Texts and tables that results depend on.
BOILERPLATE_START = r"\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK[^\n]*\*\*\*"
BOILERPLATE_END = r"\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK[^\n]*\*\*\*"
BLOCK_OPEN = r"<\s*(h[1-6]|p|div|section|article|li|br)\b[^>]*>"
BLOCK_CLOSE = r"<\s*/\s*(h[1-6]|p|div|section|article|li)\s*>"
ENTITIES = (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"))
CAPTION_REWRITES = (("explained that", "shared"), ("watched the", "watched"), ("with the confidence of", "like"))
OCR_REPAIRS = (("用米传达", "用来传达"), ("纽织", "组织"), ("介紹辞[.．·。]颁奖辞", "介绍辞、颁奖辞"), ("介绍辞[.．·。]颁奖辞", "介绍辞、颁奖辞"), ("淡话", "谈话"), ("活爽活现", "活灵活现"))
LANGUAGE_CODES = {"zh": ("ch", "cn", "zh-cn", "zh-hans", "chinese", "中文", "zh"), "ja": ("jp", "ja-jp", "japanese", "日本語", "日文", "ja"), "en": ("en-us", "en-gb", "english", "英文", "en"), "auto": ("auto",)}
LANGUAGE_NAMES = {"zh": "中文", "ja": "日本語", "en": "English", "auto": "Auto"}
COMMON_ENGLISH = (
    "the of and to in a is that it for on with as was at by be this from or are an have not but can you we they he she his her their into about more one all if when "
    "which what there so do does did has had will would could should may might our your than then its were been who how why"
).split()
ACTION_VERBS = "ran jumped opened found fell climbed followed placed picked looked said".split()
EMOTION_WORDS = "afraid happy sad promised wondered laughed smiled cried curious".split()
KNOWN_LOOKS = {
    "mira": (
        "Mira is a young child with dark bobbed hair, a small red hair clip, a yellow raincoat, a teal striped shirt, red rain boots, and a warm curious expression.",
        ("dark bobbed hair", "red hair clip", "yellow raincoat", "teal striped shirt", "red rain boots"),
    ),
    "grandpa": (
        "Grandpa is a kind elderly figure with soft white hair, round glasses, a gentle moustache, a deep teal cardigan, and a red umbrella.",
        ("white hair", "round glasses", "deep teal cardigan", "red umbrella", "kind smile"),
    ),
    "niko": (
        "Niko is a friendly small green frog with a bottle-cap hat, bright eyes, and a serious but gentle expression.",
        ("small green frog", "bottle-cap hat", "bright eyes", "serious gentle expression"),
    ),
}
ACCENTS = ("coral red", "deep teal", "warm gold", "soft blue-green", "moss green", "paper cream")


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often ``use`` needs it."""
    return F.get(F.transform(F.array(value), use), 0)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS_CHARS))


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{WS}+", " "))


def strip_boilerplate(c: Column) -> Column:
    """Drop a byte order mark, all up to a start marker and all from the first end marker after it."""
    whole = text(c)
    plain = F.when(F.startswith(whole, F.lit("\ufeff")), F.substring(whole, 2, 0x7FFFFFFF)).otherwise(whole)
    cut = lambda t: F.regexp_replace(F.regexp_replace(t, f"(?is)^.*?{BOILERPLATE_START}", ""), f"(?is){BOILERPLATE_END}.*$", "")
    return F.when(F.contains(whole, F.lit("***")), cut(plain)).otherwise(plain)


def normalize(c: Column) -> Column:
    """Boilerplate off, one kind of line end, no blanks before it, at most three line ends in a row, trimmed."""
    out = F.replace(F.replace(strip_boilerplate(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+\n", "\n"), "\n{4,}", "\n\n\n"))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(text(c), "<[^>]+>", " ")


def _numeric(c: Column, pattern: str, base: int) -> Column:
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    value = lambda e: F.conv(F.regexp_extract(e, "([0-9A-Fa-f]+);", 1), base, 16)
    letter = lambda e: F.decode(F.unhex(F.lpad(value(e), 8, "0")), "UTF-32")
    known = F.filter(codes, lambda e: (F.length(value(e)) <= 6) & ((F.length(value(e)) < 6) | value(e).startswith("10")))
    return F.when(F.instr(c, "&#") > 0, F.aggregate(known, c, lambda out, e: F.replace(out, e, letter(e)))).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Numeric entities, then the named ones in order, so that a doubly escaped mark is undone. Codes beyond Unicode stay."""
    out = _numeric(_numeric(text(c), "&#[0-9]+;", 10), "(?i)&#x[0-9a-f]+;", 16)
    for name, mark in ENTITIES:
        out = F.regexp_replace(out, f"(?i)&{name};", mark)
    return out


def html_to_text(c: Column) -> Column:
    out = text(c)
    for pattern, mark in ((r"<script[\s\S]*?</script>", " "), (r"<style[\s\S]*?</style>", " "), (BLOCK_OPEN, "\n"), (BLOCK_CLOSE, "\n")):
        out = F.regexp_replace(out, f"(?i){pattern}", mark)
    return normalize(decode_entities(strip_tags(out)))


def html_title(c: Column) -> Column:
    heading = F.nullif(F.regexp_extract(text(c), r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1), F.lit(""))
    found = F.coalesce(heading, F.regexp_extract(text(c), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.substring(trim(decode_entities(strip_tags(found))), 1, 120)


def _normal_form(form: str):
    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return run


def compatible(c: Column) -> Column:
    """Unicode's NFKC. Spark has no function for normal forms, so this is one over Arrow batches; plain ASCII goes through as it is."""
    return _normal_form("NFKC")(text(c))


def decomposed(c: Column) -> Column:
    """Unicode's NFKD: marks stand behind their letters."""
    return _normal_form("NFKD")(text(c))


def slug(c: Column, fallback: Column | str = "item", most: int = 80, fold: bool = False) -> Column:
    """Lower-case letters and digits joined by hyphens. fold: of the text's NFKC, so that full-width letters and ligatures are plain ones."""
    out = F.regexp_replace(F.lower(trim(compatible(c) if fold else text(c))), r"[^\p{L}\p{N}]+", "-")
    out = F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, most)
    return F.when(out == "", fallback if isinstance(fallback, Column) else F.lit(fallback)).otherwise(out)


def clip(c: Column, limit: int, mark: str = "...") -> Column:
    """Collapsed text; beyond the limit the first limit - 1 letters, trimmed, and the mark."""
    return let(collapse(text(c)), lambda whole: F.when(F.length(whole) <= limit, whole).otherwise(F.concat(trim(F.substring(whole, 1, limit - 1)), F.lit(mark))))


def clip_polished(c: Column, limit: int) -> Column:
    return clip(F.regexp_replace(collapse(text(c)), "^[\"'“”‘’]+|[\"'“”‘’]+$", ""), limit, "…")


def review_key(c: Column) -> Column:
    return trim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}]+", " "))


def source_excerpt(c: Column, number: Column | int = 1, limit: int = 118) -> Column:
    """The first sentence."""
    parts = F.filter(F.split(F.regexp_replace(text(c), f"{WS}+", " "), r"(?<=[.!?。！？]) +", 2), lambda x: x != "")
    quiet = F.concat(F.lit("A quiet story moment "), (number if isinstance(number, Column) else F.lit(number)).cast("string"), F.lit("."))
    return clip(F.coalesce(F.get(parts, 0), quiet), limit)


def source_passage(c: Column) -> Column:
    return clip(c, 1200)


def reader_caption(c: Column, number: Column | int = 1) -> Column:
    """A short caption: the excerpt reworded, or its first fragment of 22 to 86 letters, or clipped."""
    return caption_of(source_excerpt(c, number))


def caption_of(excerpt: Column) -> Column:
    """The short caption of a source excerpt."""
    out = excerpt
    for old, new in CAPTION_REWRITES:
        out = F.regexp_replace(out, f"(?i){B0}{old}{B1}", new)

    def shorter(c: Column) -> Column:
        fragment = F.get(F.filter(F.split(c, r"(?i), +|; +| +and +"), lambda x: F.length(x).between(22, 86)), 0)
        return F.when(F.length(c) <= 86, c).otherwise(F.coalesce(fragment, clip(c, 86)))

    return let(collapse(out), shorter)


def detect_language(c: Column) -> Column:
    return F.when(text(c).rlike(r"[\x{3040}-\x{30ff}]"), "ja").when(text(c).rlike(r"[\x{3400}-\x{9fff}]"), "zh").otherwise("en")


def language_code(c: Column) -> Column:
    word = F.lower(trim(text(c)))
    out = F.lit("")
    for code, words in LANGUAGE_CODES.items():
        out = F.when(word.isin(*words), code).otherwise(out)
    return out


def language_name(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.nullif(code, F.lit("")), F.lit("Auto"))


def language_profile(value: Column, source: Column) -> Column:
    """struct(mode, primary, secondary, bilingual, label) of an option such as ``zh-en``."""
    raw = F.lower(trim(text(value)))
    raw = F.when(raw == "", "auto").otherwise(raw)
    parts = F.filter(F.transform(F.split(raw, "[-+,/]"), language_code), lambda p: ~p.isin("", "auto"))
    auto = raw == "auto"
    primary = F.when(auto, source).otherwise(F.coalesce(F.get(parts, 0), source))
    secondary = F.when(~auto, F.get(F.filter(parts, lambda p: p != F.coalesce(F.get(parts, 0), source)), 0))
    label = F.when(auto, F.concat(F.lit("Auto ("), language_name(source), F.lit(")"))).when(secondary.isNotNull(), F.concat(language_name(primary), F.lit(" + "), language_name(secondary))).otherwise(language_name(primary))
    return F.struct(F.when(auto, "auto").when(secondary.isNotNull(), "bilingual").otherwise("single").alias("mode"), primary.alias("primary"), secondary.alias("secondary"), secondary.isNotNull().alias("bilingual"), label.alias("label"))


def repair_ocr(c: Column) -> Column:
    out = text(c)
    for old, new in OCR_REPAIRS:
        out = F.regexp_replace(out, old, new)
    return trim(out)


def clean_heading(c: Column) -> Column:
    """Without leading hashes; ``12 Title`` becomes ``Chapter 12: Title``."""
    out = repair_ocr(trim(F.regexp_replace(c, f"^#{{1,3}}{WS}+", "")))
    number = F.regexp_extract(out, f"^([0-9]{{1,2}}){WS}+.+$", 1)
    return F.when(number != "", F.concat(F.lit("Chapter "), number, F.lit(": "), trim(F.regexp_extract(out, f"^[0-9]{{1,2}}{WS}+(.+)$", 1)))).otherwise(out)


def chinese_numeral(n: Column) -> Column:
    """1 to 99 in Chinese; others in digits."""
    digit = lambda i: F.element_at(F.split(F.lit("零一二三四五六七八九"), ""), i.cast("int") + 1)
    tens, ones = F.floor(n / 10), n % 10
    small = F.when(n < 10, digit(n)).otherwise(F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.lit("十"), F.when(ones > 0, digit(ones)).otherwise("")))
    return F.when((n > 0) & (n < 100), small).otherwise(n.cast("string"))


def chinese_ordinal(c: Column) -> Column:
    """The number in ``第…章``, in digits or as a numeral from 1 to 99; null if there is none."""
    raw = F.regexp_extract(text(c), "^第(.{1,6})章", 1)
    plain = F.translate(raw, "〇○壹贰貳两俩叁參肆伍陆陸柒捌玖拾佰", "零零一二二二二三三四五六六七八九十百")
    value = lambda s: F.instr(F.lit("一二三四五六七八九"), s)
    before, after = F.substring_index(plain, "十", 1), F.substring_index(plain, "十", -1)
    numeral = F.when(plain.rlike("^[一二三四五六七八九]$"), value(plain)).when(plain.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), F.when(before == "", 1).otherwise(value(before)) * 10 + F.when(after == "", 0).otherwise(value(after)))
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("long")).otherwise(numeral.cast("long"))


def title_from_path(c: Column) -> Column:
    name = F.regexp_replace(F.substring_index(c, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(name, "[-_]+", " ")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]*)$", 1))


def wrap(c: Column, width: int) -> Column:
    """Lines of whole words, as many to a line as fit."""
    words = F.filter(F.split(collapse(text(c)), " "), lambda w: w != "")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("line"))

    def step(a: Column, w: Column) -> Column:
        longer = F.when(a["line"] == "", w).otherwise(F.concat(a["line"], F.lit(" "), w))
        full = (a["line"] != "") & (F.length(longer) > width)
        return F.struct(F.when(full, F.array_append(a["out"], a["line"])).otherwise(a["out"]).alias("out"), F.when(full, w).otherwise(longer).alias("line"))

    return F.aggregate(words, start, step, lambda a: F.when(a["line"] == "", a["out"]).otherwise(F.array_append(a["out"], a["line"])))


def escape_xml(c: Column) -> Column:
    out = text(c)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def safe_name(c: Column, fallback: str = "item") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(out == "", fallback).otherwise(out)


def scene_text(prompt: Column) -> Column:
    return trim(F.regexp_extract(text(prompt), r"(?is)Scene:\s*(.*?)(?:\n(?:Characters|Composition|Continuity|Avoid):|$)", 1))


def expects_cjk(language: Column) -> Column:
    return F.lower(text(language)).rlike("zh|ch|cn|ja|jp")


def visual_intent(c: Column, index: Column, count: Column) -> Column:
    """establishing first, resolution last, else by the words: action, emotion or story-beat."""
    low = F.lower(text(c))
    words = lambda w: low.rlike(f"{B0}(?:{'|'.join(w)}){B1}")
    return F.when(index == 0, "establishing").when(index == count - 1, "resolution").when(words(ACTION_VERBS), "action").when(words(EMOTION_WORDS), "emotion").otherwise("story-beat")


def _accent(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ACCENTS)), (rank % len(ACCENTS) + 1).cast("int"))


def description(name: Column, rank: Column) -> Column:
    """What a character looks like: as told for the known ones, else a general sentence with an accent colour by rank."""
    told = F.create_map(*[F.lit(x) for n, (said, _) in KNOWN_LOOKS.items() for x in (n, said)])
    general = F.concat(name, F.lit(" as a recurring picture-book character with a stable outfit, "), _accent(rank), F.lit(" accent color, readable silhouette, and clear facial expression."))
    return F.coalesce(F.try_element_at(told, F.lower(name)), general)


def visual_anchors(name: Column, rank: Column) -> Column:
    """What stays the same in every picture of a character: an array."""
    told = F.create_map(*[x for n, (_, anchors) in KNOWN_LOOKS.items() for x in (F.lit(n), F.array(*map(F.lit, anchors)))])
    return F.coalesce(F.try_element_at(told, F.lower(name)), F.array(F.lit("stable silhouette"), F.concat(_accent(rank), F.lit(" color accent")), F.lit("clear facial expression")))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), "\n{2,}"), trim), lambda p: p != "")


def paragraph_count(c: Column) -> Column:
    """Parts between blank lines that are not empty; white space alone counts."""
    return F.size(F.filter(F.split(text(c), "\n{2,}"), lambda p: p != "")).cast("long")


def quality(c: Column, expected: Column | None = None) -> Column:
    """struct of character ratios, flags and whether the text looks garbled."""
    # what is left without some letters is cheaper to tell than how many of them there are
    without = lambda t, letters: F.length(F.translate(t, letters, ""))
    beyond = let(F.regexp_replace(text(c), r"[\x{0}-\x{02FF}]+", ""), lambda t: F.length(t) - F.length(F.regexp_replace(t, r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+", "")))
    words = "|".join(w for w in COMMON_ENGLISH if len(w) > 1)
    value, low = text(c), F.lower(text(c))
    counted = F.struct(
        F.length(value).alias("n"), F.greatest(without(value, _WS_CHARS), F.lit(1)).alias("solid"), beyond.alias("cjk"), (F.length(value) - without(value, _LETTERS)).alias("latin"), (F.length(value) - without(value, "\ufffd")).alias("broken"),
        (F.length(value) - without(value, "\\|")).alias("slashes"), F.regexp_count(low, F.lit("[a-z]{2,}")).alias("words"), F.regexp_count(low, F.lit(f"(?<![a-z])(?:{words})(?![a-z])")).alias("common"),
    )
    wants = expects_cjk(expected) if expected is not None else F.lit(False)
    return let(counted, lambda k: _quality(k, wants))


def _quality(k: Column, wants: Column) -> Column:
    ratio = lambda n: half_up(k[n] / k["solid"], 4)
    cjk, latin, broken, slashes = map(ratio, ("cjk", "latin", "broken", "slashes"))
    common = half_up(k["common"] / F.greatest(k["words"], F.lit(1)), 4)
    flags = F.array_compact(
        F.array(
            F.when(broken > 0.01, "many_replacement_chars"),
            F.when(slashes > 0.02, "many_pdf_escape_chars"),
            F.when(wants & (k["n"] > 500) & (cjk < 0.02) & (latin > 0.35) & (common < 0.12), "cjk_expected_but_native_text_looks_latin_garbled"),
        )
    )
    return F.struct(k["n"].cast("long").alias("char_count"), cjk.alias("cjk_ratio"), latin.alias("latin_ratio"), broken.alias("replacement_ratio"), slashes.alias("slash_ratio"), common.alias("common_word_ratio"), wants.alias("expected_cjk"), (F.size(flags) > 0).alias("garbled_likely"), flags.alias("flags"))
