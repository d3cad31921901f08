"""SQL text builders for the DuckDB side of the correctness gate."""

from __future__ import annotations

from ..functions import constants as K
from ..functions.regex import SPACES, accent_table, ligatures, re2


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]" if values else "[]::VARCHAR[]"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def sub_all(x, p, r=" ", i=True):
    return f"regexp_replace({x}, {q(re2(p))}, {q(r)}, '{'gi' if i else 'g'}')"


def sub_first(x, p, r=" "):
    return f"regexp_replace({x}, {q(re2(p))}, {q(r)}, 'i')"


def has(x, p, i=True):
    return f"regexp_matches({x}, {q(re2(p))}, '{'i' if i else 'c'}')"


def get(x, p, g=1, i=True):
    return f"regexp_extract({x}, {q(re2(p))}, {g}, '{'i' if i else 'c'}')"


def get_all(x, p, g=0, i=True):
    return f"regexp_extract_all({x}, {q(re2(p))}, {g}, '{'i' if i else 'c'}')"


def cut(x, p):
    return f"string_split_regex({x}, {q('(?i)' + re2(p))})[1]"


def ws(x):
    return f"trim(regexp_replace({x}, {q(SPACES + '+')}, ' ', 'g'))"


def strip(x):
    return f"regexp_replace({x}, {q(rf'^{SPACES}+|{SPACES}+$')}, '', 'g')"


def blank(x):
    return f"nullif({x}, '')"


def text(x):
    return f"coalesce({x}, '')"


def words(*xs):
    return "concat_ws(' ', " + ", ".join(blank(x) for x in xs) + ")"


def any_of(x, ws_):
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in ws_) + ")"


# keys
TM = "[™®©]"


def compact_key(x):
    y = f"regexp_replace(lower({x}), {q(TM)}, '', 'g')"
    y = f"regexp_replace({y}, '\\([^)]*\\)', ' ', 'g')"
    y = sub_all(y, r"\b\d+(?:\.\d+)?%\b", " ", False)
    return f"regexp_replace({y}, '[^a-z0-9]+', '', 'g')"


def spaced_key(x):
    y = f"regexp_replace(lower({strip(x)}), {q(TM)}, '', 'g')"
    y = f"regexp_replace({y}, '\\([^)]*\\)', ' ', 'g')"
    y = sub_all(y, r"\b\d+(?:\.\d+)?%\b", " ", False)
    return f"trim(regexp_replace({y}, '[^a-z0-9]+', ' ', 'g'))"


def alias_key(x):
    return f"trim(regexp_replace(regexp_replace(lower({x}), {q(TM)}, '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def brand_key(x):
    return f"trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def brand_compact(x):
    return f"replace({brand_key(x)}, ' ', '')"


def evidence_key(x):
    s, t = accent_table()
    y = f"translate(lower({x}), {q(s)}, {q(t)})"
    for ch, base in ligatures():
        y = f"replace({y}, {q(ch)}, {q(base)})"
    y = f"regexp_replace({y}, '[\\x{{300}}-\\x{{36F}}]', '', 'g')"
    return f"trim(regexp_replace({y}, '[^a-z0-9]+', ' ', 'g'))"


def ocr_key(x):
    return f"regexp_replace(translate(lower({x}), '01', 'oi'), '[^a-z]+', '', 'g')"


def code_key(x):
    return f"regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def dom_key(x):
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


KEYS = {
    "compact": compact_key, "spaced": spaced_key, "alias": alias_key, "brand": brand_key,
    "evidence": evidence_key, "ocr": ocr_key, "code": code_key, "dom": dom_key,
}


def lower_text(x):
    return f"lower({ws(x)})"


# lists
def list_separators(x):
    y = sub_all(x, r"<br\s*/?>", ", ")
    y = sub_all(y, r"</(?:li|p|div|dd|tr)>", ", ")
    y = sub_all(y, "<[^>]+>", " ")
    y = sub_all(y, "&nbsp;", " ")
    y = sub_all(y, "&amp;", "&")
    y = sub_all(y, r"\s+(?:&|\(and\)|and)\s+", ", ")
    y = sub_all(y, "[\\r\\n|•·▪◦]+", ", ")
    y = sub_all(y, r"(?:,\s*){2,}", ", ")
    return ws(y)


def split_list(x):
    part = strip(f"regexp_replace({strip('p')}, '\\.$', '')")
    return f"list_filter(list_transform(string_split_regex({x}, '[,;]'), lambda p: {part}), lambda p: p <> '')"


def raw_tokens(x):
    return f"list_filter(list_transform(string_split_regex({x}, '[,;]+'), lambda p: {strip('p')}), lambda p: p <> '')"


def label_list(x):
    y = sub_first(x, r"ingredients?\s*:", "")
    y = sub_first(y, r"full ingredients?\s*:", "")
    y = sub_first(y, r"inci\s*:", "")
    return ws(sub_all(y, r"\s*,\s*", ", "))


def page_section(x):
    return label_list(strip(cut(x, "(?:" + K.PAGE_SECTION_STOP + ")")))


def label_section(x):
    y = f"regexp_replace({x}, '\\r', chr(10), 'g')"
    y = f"replace({y}, '|', chr(10))"
    y = f"regexp_replace({y}, {q(K.OCR_BULLETS)}, ', ', 'g')"
    y = strip(f"regexp_replace({y}, '\\n{{2,}}', chr(10), 'g')")
    # The repetition limit of RE2 is 1000, so the 20..4000 window is cut by position.
    at = f"regexp_extract({y}, {q('(?is)ingredients?' + SPACES + '*:?(.{20})')}, 0)"
    tail = f"regexp_extract({y}, {q('(?is)ingredients?' + SPACES + '*:?(.{20}.*)')}, 1)"
    y = f"CASE WHEN {at} <> '' THEN left({tail}, 4000) ELSE {y} END"
    y = cut(y, "(?:" + K.OCR_SECTION_STOP + ")")
    y = ws(f"regexp_replace({y}, {q(K.OCR_BULLETS)}, ', ', 'g')")
    return ws(sub_all(y, r"\s*,\s*", ", "))


def dom_text(x):
    y = f"replace({x}, chr(160), ' ')"
    y = f"regexp_replace({y}, '[ \\t]+', ' ', 'g')"
    y = sub_all(y, r"\s*([,;|\x{2022}\x{B7}])\s*", "\\1 ")
    return ws(y)


def dom_section(x):
    y = cut(dom_text(x), K.DOM_TRIM_STOP)
    y = sub_all(y, K.DOM_TRIM_LABEL, "")
    return strip(sub_all(y, r"[,\s]+$", ""))


SECTIONS = {"page": page_section, "ocr": label_section, "dom": dom_section}


def split_label(x):
    return (
        f"list_filter(list_transform(string_split_regex({x}, '[,;\\n]+'), lambda p: {strip('p')}), "
        "lambda p: length(p) BETWEEN 2 AND 90)"
    )


# titles
def clean_title(x):
    y = ws(x)
    for p in K.TITLE_NOISE:
        y = ws(sub_all(y, p))
    for p in K.TITLE_MARKETING:
        y = ws(sub_first(y, p))
    return ws(f"regexp_replace({y}, '[|:]+', ' ', 'g')")


def last_size(x):
    return f"coalesce({get_all(x, K.SIZE_PATTERN)}[-1], '')"


def drop_prefix(x, b):
    return (
        f"CASE WHEN {b} <> '' AND starts_with(lower({x}), lower({b})) "
        f"THEN regexp_replace(substr({x}, length({b}) + 1), {q('^' + SPACES + '+')}, '') ELSE {x} END"
    )


def drop_first(x, n):
    return (
        f"CASE WHEN {n} <> '' AND strpos(lower({x}), lower({n})) > 0 THEN left({x}, strpos(lower({x}), lower({n})) - 1) "
        f"|| ' ' || substr({x}, strpos(lower({x}), lower({n})) + length({n})) ELSE {x} END"
    )


def drop_size(x, s):
    return (
        f"CASE WHEN {s} <> '' THEN regexp_replace({x}, '\\b' || replace({s}, '.', '\\.') || '\\b', ' ', 'i') ELSE {x} END"
    )


def lower_keywords(x, category):
    arms = []
    for name, kws in K.CATEGORY_RULES:
        y = x
        for w in kws:
            y = sub_first(y, rf"\b{w}\b", w)
        arms.append(f"WHEN {category} = {q(name)} THEN {y}")
    return f"CASE {' '.join(arms)} ELSE {x} END"


def variant_from(work):
    found = "coalesce(" + ", ".join(blank(get(work, p, 1)) for p in K.VARIANT_PATTERNS) + ", '')"
    return ws(f"regexp_replace({found}, '^\\(|\\)$', '', 'g')")


def core_tail(x, fallback):
    y = f"regexp_replace({x}, '[|:]+', ' ', 'g')"
    y = sub_all(y, r"\(\s*\)", " ")
    y = sub_first(y, K.CORE_VERB_TAIL)
    y = sub_all(y, K.CORE_FOR_PHRASE)
    return f"coalesce({blank(ws(y))}, {fallback})"


def sku_of(*xs):
    found = []
    for x in xs:
        v = ws(text(x))
        found += [blank(f"upper({get(v, p, 1)})") for p in K.SKU_PATTERNS]
        found.append(f"CASE WHEN {has(v, K.BARE_SKU_PATTERN)} THEN upper({v}) END")
    return "coalesce(" + ", ".join(found) + ", '')"


def category_of(*xs):
    c = "lower(concat_ws(' ', " + ", ".join(text(x) for x in xs) + "))"
    arms = " ".join(f"WHEN {any_of(c, kws)} THEN {q(n)}" for n, kws in K.CATEGORY_RULES)
    return f"CASE {arms} ELSE {q(K.DEFAULT_CATEGORY)} END"


def product_type_of(v, fb):
    both = f"lower({v} || ' ' || {fb})"
    exact = " ".join(f"WHEN lower({v}) = {q(p)} THEN {q(n)}" for p, n in K.CATEGORY_SYNONYMS)
    loose = " ".join(f"WHEN contains({both}, {q(p)}) THEN {q(n)}" for p, n in K.CATEGORY_SYNONYMS)
    cat = category_of(v, fb)
    return f"CASE {exact} ELSE CASE WHEN ({cat}) <> 'Product' THEN ({cat}) ELSE CASE {loose} ELSE '' END END END"


# brands
def format_brand(x):
    return (
        f"array_to_string(list_transform(list_filter(string_split({ws(x)}, ' '), lambda w: w <> ''), "
        "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    )


def brand_text(x):
    y = f"replace({ws(text(x))}, '&', ' & ')"
    y = f"regexp_replace({y}, '[_/.-]+', ' ', 'g')"
    return ws(sub_all(y, r"[^a-z0-9&%+\s]"))


def host_brand(x):
    y = f"regexp_replace(lower({text(x)}), '^https?://', '')"
    y = f"string_split_regex({y}, '[/?#]')[1]"
    return (
        f"CASE WHEN contains({y}, '.') THEN array_to_string(list_filter(string_split_regex("
        f"regexp_replace({y}, '^www\\.', ''), '[._-]'), lambda p: p <> '' AND p NOT IN {inlist(K.HOST_NOISE_WORDS)}), ' ') ELSE '' END"
    )


def explicit_brand(x):
    found = []
    for p in K.EXPLICIT_BRAND_PATTERNS:
        b = cut(brand_text(get(ws(text(x)), p, 1)), K.BRAND_CUT)
        found.append(f"CASE WHEN {b} <> '' AND len(string_split({b}, ' ')) <= 6 THEN {format_brand(b)} END")
    return "coalesce(" + ", ".join(found) + ", '')"


def leading_brand(x):
    y = brand_text(x)
    for w in ("buy", "shop", "online"):
        y = sub_all(y, rf"^{w}\s+", "")
    tokens = f"list_filter(string_split({y}, ' '), lambda t: t <> '')"
    stop = f"list_transform({tokens}, lambda t: regexp_matches(t, '^[0-9]') OR lower(t) IN {inlist(K.BRAND_BOUNDARY_WORDS)})"
    first = f"coalesce(list_position({stop}, true), 0)"
    taken = f"least(CASE WHEN {first} > 0 THEN {first} - 1 ELSE len({tokens}) END, 5)"
    brand = f"array_to_string({tokens}[1:{taken}], ' ')"
    return (
        f"CASE WHEN {taken} BETWEEN 1 AND 4 AND lower({brand}) NOT IN {inlist(K.STOP_WORDS)} "
        f"AND lower({y}) <> 'linked product' THEN {format_brand(brand)} ELSE '' END"
    )


def detect_brand(*xs):
    found = []
    for x in xs:
        found.append(blank(explicit_brand(x)))
        found.append(f"CASE WHEN ({host_brand(x)}) = '' THEN {blank(leading_brand(x))} END")
    for x in xs:
        found.append(blank(format_brand(f"({host_brand(x)})")))
    return "coalesce(" + ", ".join(found) + ", '')"


def slug_title(x):
    y = sub_all(x, r"\.[a-z0-9]+$", "")
    y = f"regexp_replace({y}, '[_-]+', ' ', 'g')"
    y = ws(f"regexp_replace({y}, '[|/]', ' ', 'g')")
    return (
        f"array_to_string(list_transform(list_filter(string_split({y}, ' '), lambda w: w <> ''), "
        "lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
    )


def title_tokens(cleaned):
    return (
        f"list_filter(string_split_regex(lower({cleaned}), '[^a-z0-9]+'), "
        f"lambda t: length(t) > 1 AND t NOT IN {inlist(K.STOP_WORDS)})"
    )


ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">")]


def match_text(x):
    y = clean_title(x)
    for e, v in ENTITIES:
        y = sub_all(y, e, v)
    y = sub_all(y, K.PACK_PATTERN)
    y = f"regexp_replace({y}, '[|_/,:;()\\[\\]{{}}]+', ' ', 'g')"
    y = f"regexp_replace({y}, '[+]+', ' + ', 'g')"
    y = sub_all(y, r"[^A-Za-z0-9_\s%&.+-]+")
    for p in K.MATCH_NOISE:
        y = sub_all(y, p)
    return ws(y)


def tags_of(x, rules):
    marks = ", ".join(f"CASE WHEN {has(x, '|'.join(ps))} THEN {q(n)} END" for n, ps in rules)
    return f"list_filter([{marks}], lambda t: t IS NOT NULL)"


def or_list(a, empty):
    return (
        f"CASE len({a}) WHEN 0 THEN {q(empty)} WHEN 1 THEN {a}[1] WHEN 2 THEN array_to_string({a}, ' and ') "
        f"ELSE array_to_string({a}[1:len({a}) - 1], ', ') || ', and ' || {a}[-1] END"
    )


def decode_entities(x):
    y = sub_all(x, "&nbsp;", " ")
    y = sub_all(y, "&amp;", "&")
    y = sub_all(y, "&quot;", '"')
    y = sub_all(y, "&#39;", "'")
    return ws(y)


def plain_tags(x):
    y = f"regexp_replace({x}, '<script.*?</script>', ' ', 'gis')"
    y = f"regexp_replace({y}, '<style.*?</style>', ' ', 'gis')"
    return f"regexp_replace({y}, '<[^>]+>', ' ', 'g')"


def visible_text(x):
    return decode_entities(plain_tags(x))


def plain_text(x):
    return ws(plain_tags(x))


def half_up(x):
    return f"floor({x} + 0.5)"
