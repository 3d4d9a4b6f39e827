"""Column functions over texts: clean-up, parsing of model answers, tokens, pieces. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() has it; \s alone is ASCII in Java.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NO_ANSWER = "无答案"
OPEN, CLOSE = "【", "】"
CJK = "[一-鿿]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def content_id(c: Column) -> Column:
    """Content-addressed identity of a text."""
    return F.md5(c)


def non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits; the tokenizer of search and of set metrics."""
    return non_empty(F.split(F.lower(c), r"[^\p{L}\p{N}]+"))


def tokens_kept_case(c: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Search tokens as they are written, stopwords left out."""
    found = non_empty(F.split(c, r"[^\p{L}\p{N}]+"))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def all_tokens(c: Column) -> Column:
    """Letters, digits and any other single character each as tokens, case kept, spaces included; for overlap metrics."""
    return F.regexp_extract_all(c, F.lit(r"(?s)(\p{L}+|\p{N}+|.)"), 1)


def switched_tokens(c: Column) -> Column:
    """Characters where over 30 % are CJK, else lower-cased words between white space."""
    return F.when(cjk_ratio(c) > 0.3, F.filter(F.split(F.regexp_replace(c, r"\s", ""), ""), lambda x: x != "")).otherwise(words(F.lower(c)))


def words(c: Column) -> Column:
    return non_empty(F.split(c, r"\s+"))


def n_words(c: Column) -> Column:
    return F.size(words(c))


def n_lines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of an array that is computed once, although f's own lambdas look into it for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def bigrams(items: Column) -> Column:
    """Adjacent pairs, joined by a space; none for fewer than two items."""
    pairs = lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.concat_ws(" ", F.element_at(s, i), F.element_at(s, i + 1)))
    return once(items, lambda s: F.when(F.size(s) < 2, F.array().cast("array<string>")).otherwise(pairs(s)))


def cjk_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^一-鿿]", ""))


def cjk_ratio(c: Column) -> Column:
    return F.coalesce(F.try_divide(cjk_count(c), F.length(c)), F.lit(0.0))


def token_estimate(c: Column) -> Column:
    """Model tokens a text is expected to take: 1.5 a CJK character, a quarter for any other."""
    return F.floor(cjk_count(c) * 1.5 + (F.length(c) - cjk_count(c)) / 4).cast("long")


def preview(c: Column, length: int = 100) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


# --- citations in answers ---


def citations(c: Column) -> Column:
    """All numbers between 【 and 】, in order of first occurrence; either comma parts them, other parts are dropped."""
    groups = F.regexp_extract_all(c, F.lit(r"(?d)[【](.*?)[】]"), 1)
    parts = F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(F.regexp_replace(g, r"[{} 【】]", ""), ",", "，"), "，")))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p.rlike(r"^[0-9]+$") & (F.length(p) < 10)), lambda p: p.cast("int")))


def strict_citations(c: Column) -> Column:
    """The numbers of the first well-formed 【1, 2】 only; empty without one."""
    inner = F.regexp_extract(c, r"【([0-9]+(?:,[ \t\n]*[0-9]+)*)】", 1)
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(inner, r",[ \t\n]*"), lambda p: p.cast("int")))


def strip_citations(c: Column) -> Column:
    """The answer alone: citation groups go, then stray brackets, then white space at both ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?d)【.*?】", ""), r"[{}【】]", ""))


def clean_response(c: Column) -> Column:
    """A model's response without its thoughts, labels and placeholders; nothing but citations means no answer."""
    c = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    c = F.regexp_replace(c, rf"(?m)^答案内容[：:]{SPACE}*", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\{答案\}", ""), r"(?d)\{从[^}]*\}", "")
    c = strip(F.regexp_replace(c, rf"\n{SPACE}*\n", "\n"))
    return F.when(c.rlike(rf"^[{SPACE[1:-1]}【】0-9,，]*\z"), F.lit(NO_ANSWER)).otherwise(c)


def format_answer(answer: Column, cites: Column) -> Column:
    """The answer followed by 【1,2】, or no answer where nothing is cited."""
    return F.when(F.size(cites) > 0, F.concat(answer, F.lit(OPEN), F.array_join(cites.cast("array<string>"), ","), F.lit(CLOSE))).otherwise(F.lit(NO_ANSWER))


# --- what models return as text ---


def unfenced(c: Column) -> Column:
    """Without a leading and a trailing code fence."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?", ""), r"```\z", ""))


def qa_pairs(c: Column) -> Column:
    """Objects with a question and an answer, from JSON or from the outermost brackets in prose; else none.

    Elements are read as texts one by one, so that a bad one doesn't take the others with it.
    """
    text = unfenced(c)
    items = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<string>")
    kept = F.filter(items, lambda x: x.startswith("{") & F.get_json_object(x, "$.question").isNotNull() & F.get_json_object(x, "$.answer").isNotNull())
    pairs = F.transform(kept, lambda x: F.struct(strip(F.get_json_object(x, "$.question")).alias("question"), strip(F.get_json_object(x, "$.answer")).alias("answer")))
    return F.when(text.startswith("{") | pairs.isNull(), F.array().cast("array<struct<question:string,answer:string>>")).otherwise(pairs)


def quality_score(c: Column) -> Column:
    """The integer score of the first flat object in a response; null if there is none."""
    inner = F.regexp_extract(c, r"(?s)\{[^}]+\}", 0)
    return F.get_json_object(F.when(inner == "", c).otherwise(inner), "$.score").try_cast("int")


def numbered_list(c: Column) -> Column:
    """Lines without their numbers (1. 2) 3), trimmed; empty ones go."""
    return non_empty(F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[0-9]+[.)\s]+\s*", ""))))


def keyword_list(c: Column, dropped: tuple[str, ...] = ("无", "Model 3")) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: (x != "") & ~x.isin(*dropped))


def fill_template(template: str, **values: Column) -> Column:
    """template with {{name}} replaced by the value of that name."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


# --- contexts ---


def numbered_context(texts: Column, between: str = "\n") -> Column:
    """【1】first text, then 【2】second, and so on."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit(OPEN), (i + 1).cast("string"), F.lit(CLOSE), x)), between)


def training_context(texts: Column, most: int = 4096) -> Column:
    """1.first, 2.second, a line each, cut at so many characters."""
    return F.substring(F.array_join(F.transform(texts, lambda x, i: F.concat((i + 1).cast("string"), F.lit("."), x)), "\n"), 1, most)


def split_context(c: Column) -> Column:
    """The texts of a numbered context; the whole of it if it has no numbers."""
    parts = non_empty(F.transform(F.split(c, "【[0-9]+】"), strip))
    return F.when(F.size(parts) == 0, F.array(c)).otherwise(parts)


# --- pieces ---


def header_pieces(c: Column, header: str = "###") -> Column:
    """Sections that begin with the header, behind a preamble if there is one; the whole text if it has one piece."""
    parts = F.split(c, header)
    first = F.element_at(parts, 1)
    rest = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: ~is_blank(x)), lambda x: F.concat(F.lit(header), x))
    pieces = F.when(is_blank(first), rest).otherwise(F.concat(F.array(first), rest))
    return F.when(F.size(pieces) > 1, pieces).otherwise(F.array(c))


def paragraphs(c: Column, between: str = "\n\n") -> Column:
    return F.split(c, between, -1)


# --- others ---


def hash_bucket(key: Column, buckets: int = 1000, seed: str = "") -> Column:
    """A bucket that depends on the key alone, for splits that don't change with partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long") % buckets


def normal_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[。，、；：！？\s]", "")


def normal_answer(c: Column) -> Column:
    """Lower-cased, without citations and spaces: what exact matches compare."""
    return F.regexp_replace(F.lower(strip_citations(c)), r"\s", "")


def duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(F.format_string("%.2f", seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(F.format_string("%.2f", seconds / 60), F.lit("m")))
        .otherwise(F.concat(F.format_string("%.2f", seconds / 3600), F.lit("h")))
    )
