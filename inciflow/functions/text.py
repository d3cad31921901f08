"""Text standardisation as Column expressions (JVM side, whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .regex import SPACE_CHARS, SPACES, UNTIDY_SPACES, accent_table, java, ligatures, literal_guard


# ------------------------------------------------------------------ primitives
def sub_all(c: Column, pattern: str, repl: str = " ", ignore_case: bool = True) -> Column:
    return F.regexp_replace(c, java(pattern, ignore_case), repl)


def sub_first(c: Column, pattern: str, repl: str = " ") -> Column:
    """Replace the leftmost hit only: the anchor lets the pattern apply once."""
    return F.regexp_replace(c, r"(?is)\A(.*?)(?:" + java(pattern, False) + ")", "$1" + repl)


def has(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return c.rlike(java(pattern, ignore_case))


def get(c: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    return F.regexp_extract(c, java(pattern, ignore_case), group)


def get_all(c: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern, ignore_case)), F.lit(group))


def cut(c: Column, pattern: str) -> Column:
    """Text in front of the first hit."""
    return F.split(c, java(pattern), 2).getItem(0)


def guarded(words: str) -> str:
    """A pattern of plain words (`a|b|c`), tried only where two characters may be the first ones of a word."""
    first, second = ("".join(sorted({w[i] for w in words.split("|")})) for i in (0, 1))
    return f"(?=[{first}][{second}])(?:{words})"


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c evaluated once however often `use` names it: filters and conditions would repeat its patterns."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def ws(c: Column) -> Column:
    """White space collapsed to single blanks, none at the ends. Single blanks stay as they are, as nearly all are."""
    return F.trim(F.regexp_replace(c, UNTIDY_SPACES, " "))


def squeeze(c: Column) -> Column:
    """ws() for text whose only white space is already plain spaces."""
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def strip(c: Column) -> Column:
    """No pattern: one would be tried at every character."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def tidy_commas(c: Column) -> Column:
    """Every comma with no blank before and one behind it, in text that `ws` returned."""
    for old, new in ((" ,", ","), (", ", ","), (",", ", ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.trim(c)


def blank(c: Column) -> Column:
    """Empty text as NULL, so that coalesce follows truthiness."""
    return F.nullif(c, F.lit(""))


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def join_words(*cols: Column) -> Column:
    return F.concat_ws(" ", *[blank(c) for c in cols])


def let(value: Column, body) -> Column:
    """Name a value used several times in one expression: it is worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(c: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def str_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


# ------------------------------------------------------------------ key flavours
def compact_key(c: Column) -> Column:
    x = F.regexp_replace(F.lower(c), "[™®©]", "")
    x = F.regexp_replace(x, r"\([^)]*\)", " ")
    x = sub_all(x, r"\b\d+(?:\.\d+)?%\b", " ", False)
    return F.regexp_replace(x, "[^a-z0-9]+", "")


def spaced_key(c: Column) -> Column:
    x = F.regexp_replace(F.lower(strip(c)), "[™®©]", "")
    x = F.regexp_replace(x, r"\([^)]*\)", " ")
    x = sub_all(x, r"\b\d+(?:\.\d+)?%\b", " ", False)
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def alias_key(c: Column) -> Column:
    x = F.regexp_replace(F.lower(c), "[™®©]", "")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def brand_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def brand_compact(c: Column) -> Column:
    return F.replace(brand_key(c), F.lit(" "), F.lit(""))


def evidence_key(c: Column) -> Column:
    source, target = accent_table()
    x = F.translate(F.lower(c), source, target)
    odd = "[" + "".join(ch for ch, _ in ligatures()) + "]"
    expanded = x
    for ch, base in ligatures():
        expanded = F.replace(expanded, F.lit(ch), F.lit(base))
    x = F.when(x.rlike(odd), expanded).otherwise(x)
    x = F.regexp_replace(x, r"[\x{300}-\x{36F}]", "")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def ocr_key(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), "01", "oi"), "[^a-z]+", "")


def code_key(c: Column) -> Column:
    x = F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_")
    return F.regexp_replace(x, r"\A_+|_+\z", "")


def dom_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


KEY_FLAVOURS = {
    "compact": compact_key,
    "spaced": spaced_key,
    "alias": alias_key,
    "brand": brand_key,
    "evidence": evidence_key,
    "ocr": ocr_key,
    "code": code_key,
    "dom": dom_key,
}


def lower_text(c: Column) -> Column:
    return F.lower(ws(c))


# ------------------------------------------------------------------ ingredient lists
def list_separators(c: Column) -> Column:
    """Markup, conjunctions, line breaks and bullets become comma separators."""
    x = sub_all(c, r"<br\s*/?>", ", ")
    x = sub_all(x, r"</(?:li|p|div|dd|tr)>", ", ")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    x = sub_all(x, "&nbsp;", " ")
    x = sub_all(x, "&amp;", "&")
    x = sub_all(x, r"\s+(?:&|\(and\)|and)\s+", ", ")
    x = F.regexp_replace(x, "[\r\n|•·▪◦]+", ", ")
    x = sub_all(x, r"(?:,\s*){2,}", ", ")
    return ws(x)


def split_list(c: Column) -> Column:
    parts = F.transform(F.split(c, "[,;]"), lambda p: strip(F.regexp_replace(strip(p), r"\.\z", "")))
    return F.filter(parts, lambda p: p != "")


def raw_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,;]+"), strip), lambda p: p != "")


def label_list(c: Column) -> Column:
    """First `ingredients:`, `full ingredients:` and `inci:` label dropped, commas normalised."""
    x = sub_first(c, r"ingredients?\s*:", "")
    x = sub_first(x, r"full ingredients?\s*:", "")
    x = sub_first(x, r"inci\s*:", "")
    return tidy_commas(ws(x))


def page_section(c: Column) -> Column:
    return label_list(strip(cut(c, guarded(K.PAGE_SECTION_STOP))))


def label_section(c: Column) -> Column:
    """Section of a label or community text after its ingredient heading."""
    x = F.replace(F.replace(c, F.lit("\r"), F.lit("\n")), F.lit("|"), F.lit("\n"))
    x = F.regexp_replace(x, K.OCR_BULLETS, ", ")
    x = strip(F.regexp_replace(x, r"\n{2,}", "\n"))

    def below(whole: Column) -> Column:
        found = F.regexp_extract(whole, r"(?is)ingredients?" + SPACES + r"*:?(.{20,4000})", 1)
        return F.coalesce(blank(found), whole)

    x = cut(bound(x, below), guarded(K.OCR_SECTION_STOP))
    return tidy_commas(ws(F.regexp_replace(x, K.OCR_BULLETS, ", ")))


def dom_text(c: Column) -> Column:
    """White space collapsed first (no-break spaces and tabs among it): separators then have one blank at most on a side."""
    return F.trim(F.regexp_replace(ws(c), r" ?([,;|\x{2022}\x{B7}]) ?", "$1 "))


def dom_section(c: Column) -> Column:
    return dom_trimmed(dom_text(c))


def dom_trimmed(c: Column) -> Column:
    """Section of what `dom_text` returned."""
    x = cut(c, K.DOM_TRIM_STOP)
    x = sub_all(x, K.DOM_TRIM_LABEL, "")
    return strip(F.rtrim(x, F.lit("," + SPACE_CHARS)))


SECTION_PROFILES = {"page": page_section, "ocr": label_section, "dom": dom_section}


def split_label(c: Column) -> Column:
    """Items of a label text, 2 to 90 characters long."""
    parts = F.transform(F.split(label_section(c), "[,;\n]+"), strip)
    return F.filter(parts, lambda p: (F.length(p) >= 2) & (F.length(p) <= 90))


# ------------------------------------------------------------------ titles
def _steps(patterns: Sequence[str], first_only: bool) -> list[Column]:
    out = []
    for p in patterns:
        regex = r"(?is)\A(.*?)(?:" + java(p, False) + ")" if first_only else java(p)
        out.append(F.struct(F.lit(literal_guard(p)).alias("word"), F.lit(regex).alias("regex"), F.lit("$1 " if first_only else " ").alias("repl")))
    return out


def apply_steps(c: Column, steps: list[Column], tidy) -> Column:
    """Replacements one after another; a step whose literal word is absent costs a substring test only."""

    def step(acc, s):
        return F.when(F.lower(acc).contains(s["word"]), tidy(F.regexp_replace(acc, s["regex"], s["repl"]))).otherwise(acc)

    return F.aggregate(F.array(*steps), c, step)


def clean_title(c: Column) -> Column:
    """Noise removed everywhere, then the first hit of each marketing phrase, then pipes and colons."""
    x = apply_steps(ws(c), _steps(K.TITLE_NOISE, False) + _steps(K.TITLE_MARKETING, True), squeeze)
    return squeeze(F.regexp_replace(x, "[|:]+", " "))


def last_size(cleaned: Column) -> Column:
    hits = get_all(cleaned, K.SIZE_PATTERN)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)).otherwise(F.lit(""))


def drop_prefix(c: Column, prefix: Column) -> Column:
    hit = (prefix != "") & F.startswith(F.lower(c), F.lower(prefix))
    rest = F.regexp_replace(F.substr(c, F.length(prefix) + F.lit(1)), rf"\A{SPACES}+", "")
    return F.when(hit, rest).otherwise(c)


def drop_first(c: Column, needle: Column, repl: str = " ") -> Column:
    at = F.position(F.lower(needle), F.lower(c))
    cutout = F.concat(
        F.substr(c, F.lit(1), at - 1), F.lit(repl), F.substr(c, at + F.length(needle))
    )
    return F.when((needle != "") & (at > 0), cutout).otherwise(c)


def drop_size(c: Column, size: Column) -> Column:
    """First whole-word occurrence of the size removed."""
    edge = java(r"\b", False)
    pattern = F.concat(F.lit(r"(?is)\A(.*?)" + edge), F.replace(size, F.lit("."), F.lit(r"\.")), F.lit(edge))
    return F.when(size != "", F.regexp_replace(c, pattern, F.lit("$1 "))).otherwise(c)


def lower_keywords(c: Column, category: Column) -> Column:
    """First hit of each keyword of the product's category written in lower case."""
    table = F.create_map(*[x for name, words in K.CATEGORY_RULES for x in (F.lit(name), str_array(words))])
    words = F.coalesce(F.try_element_at(table, category), F.array().cast("array<string>"))
    present = F.filter(words, lambda w: F.lower(c).contains(w))
    edge = java(r"\b", False)

    def lowered(acc, w):
        return F.regexp_replace(acc, F.concat(F.lit(r"(?is)\A(.*?)" + edge), w, F.lit(edge)), F.concat(F.lit("$1"), w))

    return F.aggregate(present, c, lowered)


def variant_in(work: Column) -> Column:
    """First variant phrase of a title whose brand and size are gone."""
    found = F.coalesce(*[blank(get(work, p, 1)) for p in K.VARIANT_PATTERNS], F.lit(""))
    return ws(F.regexp_replace(found, r"\A\(|\)\z", ""))


def core_name_in(work: Column, variant: Column, fallback: Column) -> Column:
    x = drop_first(work, variant)
    x = F.regexp_replace(x, "[|:]+", " ")
    x = sub_all(x, r"\(\s*\)", " ")
    x = sub_first(x, K.CORE_VERB_TAIL)
    x = sub_all(x, K.CORE_FOR_PHRASE)
    return F.coalesce(blank(ws(x)), fallback)


def sku_of(*cols: Column) -> Column:
    """First column that carries a labelled or bare stock code."""

    def code(value):
        labelled = [blank(F.upper(get(value, p, 1))) for p in K.SKU_PATTERNS]
        return F.coalesce(*labelled, F.when(has(value, K.BARE_SKU_PATTERN), F.upper(value)))

    return F.coalesce(*[let(ws(text(c)), code) for c in cols], F.lit(""))


def _category_in(combined: Column) -> Column:
    out = F.lit(K.DEFAULT_CATEGORY)
    for name, words in reversed(K.CATEGORY_RULES):
        out = F.when(any_of(combined, words), F.lit(name)).otherwise(out)
    return out


def category_of(*cols: Column) -> Column:
    return let(F.lower(F.concat_ws(" ", *[text(c) for c in cols])), _category_in)


def product_type_of(value: Column, fallback: Column) -> Column:
    exact = F.create_map(*[F.lit(x) for pair in K.CATEGORY_SYNONYMS for x in pair])

    def loose(combined):
        out = F.lit("")
        for phrase, name in reversed(K.CATEGORY_SYNONYMS):
            out = F.when(combined.contains(phrase), F.lit(name)).otherwise(out)
        detected = _category_in(combined)
        return F.when(detected != K.DEFAULT_CATEGORY, detected).otherwise(out)

    return F.coalesce(F.try_element_at(exact, F.lower(value)), let(F.lower(F.concat_ws(" ", value, fallback)), loose))


# ------------------------------------------------------------------ brands
def format_brand(c: Column) -> Column:
    words = F.filter(F.split(ws(c), " "), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))),
        " ",
    )


def brand_text(c: Column) -> Column:
    x = F.replace(ws(text(c)), F.lit("&"), F.lit(" & "))
    x = F.regexp_replace(x, "[_/.-]+", " ")
    return ws(sub_all(x, r"[^a-z0-9&%+\s]"))


def host_brand(c: Column) -> Column:
    """Words of a host name that are not noise; empty when the text is no host."""

    def words(x):
        parts = F.split(F.regexp_replace(x, r"\Awww\.", ""), r"[._-]")
        kept = F.filter(parts, lambda p: (p != "") & ~p.isin(K.HOST_NOISE_WORDS))
        return F.when(x.contains("."), F.array_join(kept, " ")).otherwise(F.lit(""))

    return let(F.split(F.regexp_replace(F.lower(text(c)), r"\Ahttps?://", ""), "[/?#]", 2).getItem(0), words)


def explicit_brand(c: Column) -> Column:
    def usable(brand):
        return F.when((brand != "") & (F.size(F.split(brand, " ")) <= 6), format_brand(brand))

    def found(value):
        return F.coalesce(*[let(cut(brand_text(get(value, p, 1)), K.BRAND_CUT), usable) for p in K.EXPLICIT_BRAND_PATTERNS], F.lit(""))

    return let(ws(text(c)), found)


def leading_brand(c: Column) -> Column:
    x = brand_text(c)
    for word in ("buy", "shop", "online"):
        x = sub_all(x, rf"^{word}\s+", "")

    def named(words):
        taken = F.size(words)
        brand = F.array_join(words, " ")
        return F.when((taken > 0) & (taken <= 4) & ~F.lower(brand).isin(K.STOP_WORDS), format_brand(brand)).otherwise(F.lit(""))

    def leading(tokens):
        stop = F.transform(tokens, lambda t: t.rlike(r"\A[0-9]") | F.lower(t).isin(K.BRAND_BOUNDARY_WORDS))
        ahead = let(F.array_position(stop, True), lambda first: F.when(first > 0, first - 1).otherwise(F.size(tokens)))
        return let(F.slice(tokens, F.lit(1), F.least(ahead, F.lit(5)).cast("int")), named)

    def brand(value):
        tokens = F.filter(F.split(value, " "), lambda t: t != "")
        return F.when(F.lower(value) == "linked product", F.lit("")).otherwise(let(tokens, leading))

    return let(x, brand)


def detect_brand(*cols: Column) -> Column:
    """Explicit brand or leading title words of the texts in order, else a host name."""
    hosts = F.array(*[host_brand(c) for c in cols])

    def pick(h):
        found = []
        for i, c in enumerate(cols):
            found.append(blank(explicit_brand(c)))
            found.append(F.when(F.get(h, F.lit(i)) == "", blank(leading_brand(c))))
        named = F.filter(h, lambda x: x != "")
        found.append(F.when(F.size(named) > 0, format_brand(F.get(named, F.lit(0)))))
        return F.coalesce(*found, F.lit(""))

    return let(hosts, pick)


def slug_title(c: Column) -> Column:
    x = sub_all(c, r"\.[a-z0-9]+$", "")
    x = F.regexp_replace(x, "[_-]+", " ")
    x = ws(F.regexp_replace(x, "[|/]", " "))
    words = F.filter(F.split(x, " "), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), " "
    )


def percent_decode(c: Column) -> Column:
    """URI component decode; text that is not valid stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def title_token_array(cleaned: Column) -> Column:
    parts = F.split(F.lower(cleaned), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(K.STOP_WORDS))


# ------------------------------------------------------------------ tags
_ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">")]


def match_text(c: Column) -> Column:
    """Title text reduced to what product matching compares."""
    x = clean_title(c)
    for entity, value in _ENTITIES:
        x = sub_all(x, entity, value)
    x = sub_all(x, K.PACK_PATTERN)
    x = F.regexp_replace(x, r"[|_/,:;()\[\]{}]+", " ")
    x = F.regexp_replace(x, r"[+]+", " + ")
    x = sub_all(x, r"[^A-Za-z0-9_\s%&.+-]+")
    return ws(apply_steps(x, _steps(K.MATCH_NOISE, False), lambda y: y))


def tags_of(lowered: Column, rules) -> Column:
    marks = [F.when(has(lowered, "|".join(patterns)), F.lit(name)) for name, patterns in rules]
    return F.array_compact(F.array(*marks))


# ------------------------------------------------------------------ sentences
def or_list(arr: Column, empty: str) -> Column:
    """`a`, `a and b`, or `a, b, and c`."""
    n = F.size(arr)
    return (
        F.when(n == 0, F.lit(empty))
        .when(n == 1, F.element_at(arr, 1))
        .when(n == 2, F.array_join(arr, " and "))
        .otherwise(
            F.concat(
                F.array_join(F.slice(arr, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(arr, -1)
            )
        )
    )


# ------------------------------------------------------------------ markup
def visible_text(html: Column) -> Column:
    x = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style.*?</style>", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    return decode_entities(x)


def decode_entities(c: Column) -> Column:
    x = sub_all(c, "&nbsp;", " ")
    x = sub_all(x, "&amp;", "&")
    x = sub_all(x, "&quot;", '"')
    x = sub_all(x, "&#39;", "'")
    return ws(x)


def plain_text(html: Column) -> Column:
    """Tags dropped, entities kept."""
    x = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style.*?</style>", " ")
    return ws(F.regexp_replace(x, r"<[^>]+>", " "))


# ------------------------------------------------------------------ numbers
def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def two_decimals(c: Column) -> Column:
    return F.floor(c * 100 + F.lit(0.5)) / 100
