"""Text cleaning and tokenising as column expressions.

Patterns carry (?iU): Java's classes and case folding are ASCII-only without it.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

WHITE = " \t\n\r\x0b\x0c\x85\xa0"


def strip(c: Column, chars: str = WHITE) -> Column:
    return F.btrim(c, F.lit(chars))


def blank(c: Column) -> Column:
    """Null, empty and white space are all missing."""
    return c.isNull() | (strip(c) == "")


def present(c: Column) -> Column:
    """The column with blanks as null."""
    return F.when(~blank(c), c)


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def drop(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, f"(?iU){pattern}", by)


def contains_any(c: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def _accent_table() -> tuple[str, str]:
    """Every precomposed lower-case Latin letter and its base letter, by decomposition; đ is d."""
    pairs = {"đ": "d"}
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and plain != c and len(plain) == 1 and plain.isascii():
            pairs[c] = plain
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    """Lower case without diacritics, đ as d; decomposed input too."""
    return F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _PLAIN), r"\p{Mn}", "")


# Legal forms around company names.
LEGAL_PREFIX = r"^(?:công ty|cty)?\s*(?:tnhh mtv|tnhh|cổ phần|cp|tập đoàn)\s*"
LEGAL_SUFFIX = r"[\s,\-]+(?:tnhh|cổ phần|jsc|llc|inc|corp|co\.,?\s*ltd\.?|ltd\.?)$"
BRANCH_SUFFIX = r"[\s,\-]+(?:chi nhánh|vietnam|việt nam)$"
STAR_PREFIXES = (r"^công ty tnhh mtv\s+", r"^công ty tnhh\s+", r"^công ty cổ phần\s+", r"^tập đoàn\s+", r"^tổng công ty\s+", r"^chi nhánh\s+")
STAR_SUFFIXES = (r"\s+-\s+chi nhánh.*$", r"\s+-\s+cn.*$", r"\s+jsc$", r"\s+co\.,\s*ltd\.?$")
LEGAL_TOKENS = (
    "cong ty cty tnhh mtv co phan cp jsc llc inc corp ltd company limited joint stock group tap doan ngan hang tmcp "
    "chi nhanh vietnam viet nam the and va mot thanh vien"
).split()


def clean_company_name(c: Column) -> Column:
    """The flat path's rule: one legal prefix, one legal and one branch suffix go; blank is "Không rõ"."""
    name = strip(c)
    for pattern in (LEGAL_PREFIX, LEGAL_SUFFIX, BRANCH_SUFFIX):
        name = drop(name, pattern)
    name = strip(squeeze(name), " -,/:;")
    return F.when(c.isNull() | (c == ""), "Không rõ").when(name != "", name).otherwise(strip(c))


def clean_company_name_star(c: Column) -> Column:
    """The star path's rule: prefixes and suffixes go one after the other; blank is "Unknown Company"."""
    name = strip(c)
    for pattern in (*STAR_PREFIXES, *STAR_SUFFIXES):
        name = drop(name, pattern)
    return F.when(c.isNull() | (c == ""), "Unknown Company").otherwise(strip(squeeze(name), " -|/,"))


# What is cut from titles, here and in both clean_job_title functions.
_TITLE_MONEY = r"(?:-|\|)?\s*(?:thu nhập|lương|up to|upto|lên đến|tới)\s*.*$"
_TITLE_TEASER = r"(?:-|\|)?\s*(?:hấp dẫn|deal|thỏa thuận|cạnh tranh)\s*$"
_TITLE_URGENT = r"^\s*(?:tuyển gấp|tuyển dụng|gấp:?)\s*"


def clean_job_title(c: Column) -> Column:
    title = strip(F.coalesce(c, F.lit("")))
    for pattern in (r"\[.*?\]", r"\((?:hà nội|hcm|đà nẵng|hồ chí minh|toàn quốc)\)", _TITLE_URGENT, _TITLE_MONEY, _TITLE_TEASER):
        title = drop(title, pattern)
    return strip(squeeze(title), " -|/,:;")


def clean_job_title_star(c: Column) -> Column:
    title = strip(F.coalesce(c, F.lit("")))
    for pattern in (r"\[.*?\]", _TITLE_MONEY, _TITLE_TEASER, r"(?:-|\|)?\s*(?:tại|ở)\s+(?:hà nội|hcm|đà nẵng|hồ chí minh).*$", _TITLE_URGENT, r"\(hà nội\)|\(hcm\)|\(hồ chí minh\)|\(đà nẵng\)"):
        title = drop(title, pattern)
    title = strip(squeeze(title), " -|/,:;")
    return F.when(F.length(title) <= 4, F.initcap(title)).otherwise(title)


def clean_html(c: Column) -> Column:
    """Five entities decoded, block ends as lines, other tags as blanks, bullets as "- ", no empty lines."""
    text = F.coalesce(c, F.lit(""))
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/li|/div|/h\d)[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = F.regexp_replace(text, r"(?m)^[ \t]*[-*+–•][ \t]*", "- ")
    lines = F.transform(F.split(text, "\n"), lambda line: strip(F.regexp_replace(line, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def fix_encoding(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+", " "))


def match_key(c: Column) -> Column:
    """For comparing names across portals: lower case, no punctuation, single blanks."""
    return strip(squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", "")))


def company_tokens(c: Column) -> Column:
    """Sorted distinct words of a company name without legal forms; all words if none are left."""
    words = F.regexp_extract_all(strip_accents(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    core = F.array_except(words, F.array(*map(F.lit, LEGAL_TOKENS)))
    return F.array_sort(F.array_distinct(F.when(F.size(core) > 0, core).otherwise(words)))


def company_key(c: Column) -> Column:
    return F.array_join(company_tokens(c), " ")


def companies_compatible(a: Column, b: Column) -> Column:
    """Whether one of two token arrays lies within the other, neither being empty."""
    within = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return (F.size(a) > 0) & (F.size(b) > 0) & within


def title_key(c: Column) -> Column:
    """Accent-free words of a title; brackets that hold a digit go."""
    text = F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), r"\([^)]*\d[^)]*\)", " ")
    return F.array_join(F.regexp_extract_all(text, F.lit(r"[a-z0-9+#.]+"), F.lit(0)), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


# Spellings of technology names that a word tokenizer would lose, in order.
TECH_NAMES = (
    (r"(?<![\w+])c\+\+(?![\w+])", " cpp "),
    (r"(?<![\w#])c#(?![\w#])", " csharp "),
    (r"(?<![\w])(?:asp)?\.net(?:\s*core)?(?![\w])", " dotnet "),
    (r"(?<![\w])node\.?js(?![\w])", " nodejs "),
    (r"(?<![\w])react\.?js(?![\w])", " reactjs "),
    (r"(?<![\w])vue\.?js(?![\w])", " vuejs "),
    (r"(?<![\w])next\.?js(?![\w])", " nextjs "),
    (r"(?<![\w])ci\s*/\s*cd(?![\w])", " cicd "),
    (r"(?<![\w])a\s*/\s*b\s+test", " abtest"),
    (r"(?<![\w])pl\s*/\s*sql(?![\w])", " plsql "),
    (r"(?<![\w])ui\s*/\s*ux(?![\w])|(?<![\w])ux\s*/\s*ui(?![\w])", " uiux "),
    (r"(?<![\w])front[\s-]?end(?![\w])", " frontend "),
    (r"(?<![\w])back[\s-]?end(?![\w])", " backend "),
    (r"(?<![\w])full[\s-]?stack(?![\w])", " fullstack "),
)


def normalize_tech(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    for pattern, token in TECH_NAMES:
        text = F.regexp_replace(text, f"(?U){pattern}", token)
    return text


def tokens(c: Column) -> Column:
    """Words of two letters or digits and more, after normalize_tech."""
    return F.regexp_extract_all(normalize_tech(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def ngrams(words: Column) -> Column:
    """The words and, after them, the pairs of neighbours."""
    pairs = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))
    return F.concat(words, pairs)


def content_soup(title: Column, skills: Column, tags: Column, description: Column) -> Column:
    """Title three times, skills four times, tags and description once."""
    parts = [F.repeat(F.concat(F.coalesce(c, F.lit("")), F.lit(" ")), n) for c, n in ((title, 3), (skills, 4), (tags, 1), (description, 1))]
    return strip(F.concat(*parts))


def profile_soup(title: Column, skills: Column, cv: Column) -> Column:
    """A profile's title three times, its skills four times and its text once, blank-joined; empty parts are left out."""
    joined = F.array_join(F.coalesce(skills, F.array().cast("array<string>")), " ")
    parts = F.concat(F.array_repeat(title, 3), F.array_repeat(joined, 4), F.array(cv))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def description(*sections: Column) -> Column:
    """The sections that aren't blank, a blank line between them."""
    return F.concat_ws("\n\n", *[strip(present(s)) for s in sections])


def first_present(*sections: Column) -> Column:
    return F.coalesce(*[present(s) for s in sections], F.lit(""))


def snippet(c: Column, length: int = 220) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"))


def content_hash(*sections: Column) -> Column:
    return F.sha2(strip(F.concat_ws("\n", *[F.coalesce(s, F.lit("")) for s in sections])), 256)


def unwrap_logo(c: Column) -> Column:
    """A logo's address without the resizing proxy before it."""
    return F.regexp_replace(c, r"^https?://[^/]+/(?:[^/]+/)*(?=https?://)", "")
