"""String functions (Column -> Column): style codes, file names, tags, tokens, URLs.

Python's ``\\b``, ``\\s`` and ``strip`` know Unicode, Java's do not by default. White space is therefore
written ``[\\s\\p{Z}]`` here, and code extraction turns every non-ASCII word character into a lower-case
placeholder first, so the ASCII ``\\b`` sees the same word borders.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
TAG_KINDS = ("year", "category", "subcategory")
DEFAULT_CATEGORIES = ("单品", "罗纹", "毛织配件", "布匹")
DEFAULT_SUBCATEGORIES = ("暂无",)
KNOWN_LIBRARIES = {
    "彩龙丝光棉（2024）": "cailong_2024",
    "东莞国彩丝光棉": "dongguan_guocai",
    "恩盛纺织（新色卡）丝光棉": "ensheng_new",
}
VENDOR_PREFIXES = ("彩龙", "国彩", "恩盛")
METER_WORDS = "color|colour|meter|spectro|colormeter|色差|测色|颜色"
PHONE_WORDS = "iphone|ipad|macbook|watch|airpods"
BRIDGE_MODEL_WORDS = "pt|rm|cr|wr|ys|nh|3nh|fru|bn|cm"
MIN_YEAR = 2000

EFFECTIVE = r"^([A-Z][A-Z0-9_-]{2,}|\d{3,4}(-\d{1,2})?)$"
WS = r"[\s\p{Z}]"
LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once (a lambda variable), however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(c: Column) -> Column:
    """Trim any white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}++|(?<!{WS}){WS}++$", "")


def lines_of(text: Column) -> Column:
    """Trimmed non-blank lines of a text."""
    return F.filter(F.transform(F.split(text, LINE_BREAKS), strip), lambda s: s != "")


def stem_of(name: Column) -> Column:
    """File name without directory and last suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"^(?s).*/", ""), r"(?s)^(.+)\.[^.]+$", "$1")


def suffix_of(name: Column) -> Column:
    """Lower-case last suffix with its dot, or ''."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"^(?s).*/", ""), r"(?s)^.+(\.[^.]+)$", 1))


def _cut_last(c: Column) -> Column:
    return F.regexp_replace(c, r"_[^_]*$", "")


def style_code_catalog(name: Column) -> Column:
    """Catalog flavour: every trailing ``_ddd`` goes, then one more ``_part``."""
    return _cut_last(F.regexp_replace(stem_of(name), r"(?:_\d{3})++$", ""))


def style_code_search(name: Column) -> Column:
    """Search flavour: view marker ``@..`` goes, then exactly one ``_part``."""
    return _cut_last(stem_of(F.substring_index(name, "@", 1)))


def normalize_code(code: Column) -> Column:
    """Comparison key of a code: upper case, one trailing ``#`` off, foreign characters deleted."""
    return F.regexp_replace(F.regexp_replace(F.upper(strip(code)), "#$", ""), "[^A-Za-z0-9_-]+", "")


def _safe(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_"), "^_++|(?<!_)_++$", "")


def clean_code(code: Column, mode: str = "trailing") -> Column:
    """``trailing`` drops closing hash signs, ``first`` cuts at the first one; both then make the code safe."""
    tail = {"trailing": "[#＃]+$", "first": "(?s)[#＃].*$"}[mode]
    up = F.regexp_replace(F.upper(strip(code)), tail, "")
    return _safe(F.regexp_replace(up, "[*+]+", "-"))


def is_alpha_code(code: Column, mode: str = "trailing") -> Column:
    return clean_code(code, mode).rlike("^[A-Z][A-Z0-9_-]{2,}$")


def is_numeric_hash_code(code: Column, mode: str = "trailing") -> Column:
    return clean_code(code, mode).rlike(r"^\d{3,4}(-\d{1,2})?$")


def is_effective_code(code: Column, mode: str = "trailing") -> Column:
    return clean_code(code, mode).rlike(EFFECTIVE)


def is_any_code(code: Column) -> Column:
    """Importer rule: a leading digit is fine too."""
    return clean_code(code, "first").rlike("^[A-Z0-9][A-Z0-9_-]{2,}$")


def extract_hash_code(text: Column) -> Column:
    """First code ending in ``#``: line by line, then over the text without white space. Null if none."""
    # A run is only tried from its start: if no hash sign follows it, none follows its tail either.
    token = r"(?<![A-Za-z0-9_+*\-])[A-Za-z0-9_+*\-]++#"
    full = r"^[A-Z0-9_-]+#$"
    per_line = F.transform(lines_of(text), lambda s: F.upper(F.regexp_extract(s, token, 0)))
    joined = F.upper(F.regexp_extract(F.regexp_replace(text, rf"{WS}+", ""), token, 0))
    found = F.coalesce(
        F.get(F.filter(per_line, lambda s: s.rlike(full)), F.lit(0)),
        F.when(joined.rlike(full), joined),
    )
    return F.when(F.contains(text, F.lit("#")), found)


# ---- fixed values: the forms of a code, step by step (what counts as a code) ------------------------------
# The cascade of extract_style_code: (pattern that finds, pattern the normalised find must match entirely).
# Texts are searched whole and without their white space, so runs get long. Every repeated group is possessive:
# it neither backtracks nor recurses. A find is a row of words joined by single dashes or blanks; a word that
# runs on into other letters ends the row before it.
_VENDOR_FIND = (
    r"\bK[FEP8][A-Z]?\d{2}[-_ ]?\d{3,4}(?:[-_ ]?\d{1,2}[A-Z]?)?\b",
    r"\bJ[C0][A-Z]?\d{2}[-_ ]?\d{3,4}(?:[-_ ]?\d{1,2}[A-Z]?)?\b",
)
_VENDOR_FULL = r"^(KF|JC)[A-Z]?\d{2}-?\d{3,4}(?:-?\d{1,2}[A-Z]?)?$"
_DIGITS = r"[- ]\d(?:_?\d)*+(?!\w)"
_DIGITS_LETTER = r"[- ]\d(?:_?\d)*+[A-Z](?!\w)"
_MIXED = r"[- ]\d[A-Z]?(?:_?\d[A-Z]?)*+(?!\w)"
_LATER_STEPS = (
    # two-letter prefix, 2-4 digits, then digit groups, the last of which may end in a letter
    (r"\b[A-Z][A-Z0-9]?\d{2,4}"
     rf"(?:(?:_?\d)++(?!\w)(?:{_DIGITS})*+(?:{_DIGITS_LETTER})?|(?!\w)(?:{_DIGITS})++(?:{_DIGITS_LETTER})?"
     r"|(?!\w)[- ]\d(?:_?\d)++[A-Z](?!\w)|(?:_?\d){2,}+[A-Z](?!\w))",
     r"^[A-Z][A-Z0-9]?\d{2,4}(?:-\d{1,4}(?![A-Z0-9]))++(?:-\d{1,2}[A-Z])?$"),
    # 1-4 letters, then digit groups with optional letters
    (rf"\b[A-Z]{{1,4}}(?:(?:_?\d[A-Z]?)++(?!\w)(?:{_MIXED})*+|(?:{_MIXED})++)",
     r"^[A-Z]{1,4}(?:-\d{1,4}[A-Z]?)++$"),
    # 1-5 letters and a digit, then anything alphanumeric
    (r"\b[A-Z]{1,5}\d{1,4}(?:_?[A-Z0-9])*+(?!\w)(?:[- ][A-Z0-9](?:_?[A-Z0-9])*+(?!\w))*+",
     r"^[A-Z]{1,5}\d{1,4}(?:-[A-Z0-9]{1,4})*+$"),
)
_NUMBER_FULL = r"^\d{3,4}(?:-\d{1,2})?$"
_WORD_FIND = r"\b[A-Z]{3,6}\b"
# ---- end of fixed values ------------------------------------------------------------------------------------


def _dashed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Z0-9]+", "-"), "^-++|(?<!-)-++$", "")


def _swap(c: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _expand(text: Column) -> Column:
    def placeholders(up: Column) -> Column:
        # Plain ASCII texts, told by their byte length, skip the slow class.
        return F.when(F.length(up) == F.octet_length(up), up).otherwise(
            F.regexp_replace(up, r"[[^\x00-\x7F]&&[\p{L}\p{N}]]", "q")
        )

    up = let(_swap(F.upper(text), {"Ｋ": "K", "Ｆ": "F", "Ｊ": "J", "Ｃ": "C"}), placeholders)
    up = F.regexp_replace(up, rf"\bK{WS}+F\b", "KF")
    up = F.regexp_replace(up, rf"\bJ{WS}+C\b", "JC")
    return F.regexp_replace(_swap(up, {"O": "0", "＃": "#"}), "[*+]+", "-")


def extract_style_code(text: Column, hash_suffix: bool = True) -> Column:
    """Ordered cascade of code shapes over three spellings of the text; '' when nothing fits."""
    def spell(raw: Column) -> Column:
        return F.array(raw, F.regexp_replace(raw, rf"{WS}+", ""), F.regexp_replace(raw, "[^A-Z0-9]+", "-"))

    code = let(let(_expand(F.coalesce(text, F.lit(""))), spell), _cascade)
    if hash_suffix:
        code = F.concat(code, F.lit("#"))
    return F.coalesce(code, F.lit(""))


def _cascade(forms: Column) -> Column:
    """First code in the three spellings, or null."""
    spellings = [F.get(forms, F.lit(i)) for i in range(3)]

    def found(pattern: str, forms: list[Column]) -> Column:
        return F.concat(*[F.regexp_extract_all(s, F.lit(pattern), F.lit(0)) for s in forms])

    def first_full(codes: Column, full: str) -> Column:
        return F.get(F.filter(codes, lambda c: c.rlike(full)), F.lit(0))

    vendor = F.concat(*[
        F.regexp_extract_all(s, F.lit(p), F.lit(0)) for s in spellings for p in _VENDOR_FIND
    ])
    vendor = F.transform(
        vendor,
        lambda c: F.regexp_replace(F.regexp_replace(_dashed(c), "^K[EP8]", "KF"), "^J0", "JC"),
    )
    steps = [first_full(vendor, _VENDOR_FULL)]
    for find, full in _LATER_STEPS:
        steps.append(first_full(F.transform(found(find, spellings), _dashed), full))
    for s in spellings[:2]:
        number = _dashed(strip(F.substring_index(s, "#", 1)))
        steps.append(F.when(F.contains(s, F.lit("#")) & number.rlike(_NUMBER_FULL), number))
    steps.append(F.get(found(_WORD_FIND, spellings[:2]), F.lit(0)))
    return F.coalesce(*steps)


def _if_effective(text: Column, mode: str) -> Column:
    """The cleaned text when it is a usable code, else ''."""
    return let(clean_code(text, mode), lambda c: F.when(c.rlike(EFFECTIVE), c).otherwise(F.lit("")))


def code_before_hash(text: Column, mode: str = "trailing") -> Column:
    """Last non-blank line before the first hash sign, if it is a usable code; else ''."""
    def last_line(before: Column) -> Column:
        return let(lines_of(before), lambda ls: F.when(F.size(ls) > 0, F.element_at(ls, -1)).otherwise(before))

    last = let(F.regexp_extract(text, "(?s)^([^#＃]*)[#＃]", 1), last_line)
    return F.when(text.rlike("[#＃]"), _if_effective(last, mode)).otherwise(F.lit(""))


def _without_copy_mark(name: Column) -> Column:
    return strip(F.regexp_replace(strip(stem_of(name)), rf"{WS}*\(\d+\){WS}*$", ""))


def code_from_filename(name: Column, variant: str = "standard") -> Column:
    """struct<code, source>; ``variant`` is ``standard`` or ``nas``."""
    stem = _without_copy_mark(name)
    if variant == "standard":
        mode = "trailing"
        bare = strip(F.regexp_replace(stem, r"_\d+$", ""))
        hashed = code_before_hash(bare, mode)
    else:
        mode = "first"
        hashed = code_before_hash(stem, mode)
        bare = strip(F.regexp_replace(stem, r"(?:_\d{3})++$", ""))
    both = F.struct(hashed.alias("hashed"), _if_effective(bare, mode).alias("plain"))

    def choose(t: Column) -> Column:
        code = F.when(t["hashed"] != "", t["hashed"]).otherwise(t["plain"])
        source = F.when(t["hashed"] != "", F.lit("filename_hash")).when(t["plain"] != "", F.lit("filename"))
        return F.struct(code.alias("code"), F.coalesce(source, F.lit("")).alias("source"))

    return let(both, choose)


def code_from_label_lines(text: Column) -> Column:
    """First line that cleans to a code, else the whole text if it does, else ''."""
    cleaned = F.transform(F.concat(F.split(text, LINE_BREAKS), F.array(text)), lambda t: clean_code(t, "first"))
    return F.coalesce(F.get(F.filter(cleaned, lambda c: c.rlike("^[A-Z0-9][A-Z0-9_-]{2,}$")), F.lit(0)), F.lit(""))


def filename_prefix(code: Column, variant: str = "standard") -> Column:
    if variant == "standard":
        core = F.regexp_replace(code, "#$", "")
    else:
        core = F.regexp_replace(F.regexp_replace(code, "(?s)[#＃].*$", ""), "[*+]+", "-")
    core = _safe(core)
    return F.when(core == "", F.lit("UNKNOWN")).otherwise(core)


def image_suffix(name: Column, fallback: str = ".jpg") -> Column:
    suffix = suffix_of(name)
    return F.when(suffix.isin(*IMAGE_SUFFIXES), suffix).otherwise(F.lit(fallback))


def sanitize_filename(name: Column, fallback: str = ".jpg") -> Column:
    flat = F.translate(name, "\\", "/")
    stem = _safe(stem_of(flat))
    return F.concat(F.when(stem == "", F.lit("UNKNOWN")).otherwise(stem), image_suffix(flat, fallback))


def sort_order_of(name: Column) -> Column:
    """Number after the last ``_`` of the stem, else 0."""
    digits = F.regexp_extract(stem_of(name), r"_(\d+)$", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def is_already_renamed(name: Column) -> Column:
    stem = strip(stem_of(name))
    code = code_from_filename(name, "standard")["code"]
    return stem.rlike(r"_\d+$") & (code != "") & (strip(F.regexp_replace(stem, r"_\d+$", "")) == code)


def typed_tag(kind: Column, name: Column) -> Column:
    k, n = strip(kind), strip(name)
    return F.when(k.isin(*TAG_KINDS) & (n != ""), F.concat(k, F.lit(":"), n)).otherwise(F.lit(""))


def parse_tag(tag: Column) -> Column:
    """struct<type, name, raw>; a bare ``20dd`` is a year, unknown forms are ``other``."""
    raw = strip(F.coalesce(tag, F.lit("")))
    kind = F.regexp_extract(raw, "^(" + "|".join(TAG_KINDS) + "):", 1)
    typ = F.when(kind != "", kind).when(raw.rlike(r"^20\d{2}$"), F.lit("year")).otherwise(F.lit("other"))
    name = F.when(kind != "", strip(F.regexp_replace(raw, "^[a-z]+:", ""))).otherwise(raw)
    return F.struct(typ.alias("type"), name.alias("name"), raw.alias("raw"))


def year_from_code(code: Column, max_year: int) -> Column:
    """``20dd`` from the two digits that close the part before the first dash; '' outside 2000..max_year."""
    digits = F.regexp_extract(strip(F.substring_index(strip(code), "-", 1)), r"(\d{2})$", 1)
    year = F.concat(F.lit("20"), digits)
    return F.when((digits != "") & year.try_cast("int").between(MIN_YEAR, max_year), year).otherwise(F.lit(""))


def library_id(value: Column) -> Column:
    low = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.substring(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}]+", "_"), "^_++|(?<!_)_++$", ""), 1, 80)


def library_slug(value: Column) -> Column:
    """Known vendor name, else ASCII slug, else ``library_id``, else ``library``."""
    raw = strip(F.coalesce(value, F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in KNOWN_LIBRARIES.items() for x in pair])
    ascii_slug = F.regexp_replace(F.lower(strip(F.regexp_replace(raw, r"\.[^.]+$", ""))), "[^a-z0-9]+", "_")
    ascii_slug = F.regexp_replace(ascii_slug, "^_++|(?<!_)_++$", "")
    return F.coalesce(
        F.try_element_at(known, raw),
        F.when(ascii_slug != "", ascii_slug),
        F.when(library_id(raw) != "", library_id(raw)),
        F.lit("library"),
    )


def distinct_folded(items: Column) -> Column:
    """Case-insensitive dedup of an array; the first spelling stays, in place. Sort based, so long arrays are fine."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("f"), i.alias("i"), x.alias("x"))))
    firsts = let(keyed, lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["f"] != e["f"])))
    in_place = F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(in_place, lambda e: e["x"])


def split_tags(value: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), r"[、,，\s\p{Z}]+"), lambda x: x != "")
    return distinct_folded(parts)


def _path_parts(root: Column, path: Column) -> Column:
    rel = F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(F.lit(""))
    folders = F.split(F.regexp_replace(rel, "/?[^/]*$", ""), "/")
    folders = F.filter(F.transform(folders, strip), lambda p: p != "")
    name = strip(F.substring_index(root, "/", -1))
    return F.when(name.rlike(r"^\d{4}$"), F.concat(F.array(name), folders)).otherwise(folders)


def _fine_tags(parts: Column) -> Column:
    deep = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.flatten(F.transform(deep, split_tags))


def tags_from_path(root: Column, path: Column) -> Column:
    """Folder levels below ``root`` as typed tags: year, category, then any number of subcategories."""
    parts = _path_parts(root, path)
    head = F.array(
        F.concat(F.lit("year:"), F.get(parts, F.lit(0))), F.concat(F.lit("category:"), F.get(parts, F.lit(1)))
    )
    fine = F.transform(_fine_tags(parts), lambda t: F.concat(F.lit("subcategory:"), t))
    return F.filter(F.concat(head, fine), lambda t: t.isNotNull())


def tag_display_from_path(root: Column, path: Column) -> Column:
    parts = _path_parts(root, path)
    fine = _fine_tags(parts)
    return F.concat_ws(
        "；",
        F.concat(F.lit("年份："), F.get(parts, F.lit(0))),
        F.concat(F.lit("类别："), F.get(parts, F.lit(1))),
        F.when(F.size(fine) > 0, F.concat(F.lit("细类："), F.array_join(fine, " / "))),
    )


def text_tokens(text: Column, min_len: int = 4) -> Column:
    """Upper-case alphanumeric runs of 4+, edge digits off, with a letter, each once in order."""
    runs = F.regexp_extract_all(F.upper(text), F.lit("[A-Z0-9]{4,}"), F.lit(0))
    bare = F.transform(runs, lambda t: F.regexp_replace(t, "^[0-9]+|[0-9]+$", ""))
    keep = F.filter(bare, lambda t: (F.length(t) >= max(2, int(min_len))) & t.rlike("[A-Z]"))
    return F.array_distinct(keep)


def _kept_params(url: Column) -> Column:
    params = F.split(F.coalesce(F.get(F.split(url, r"\?"), F.lit(1)), F.lit("")), "&")
    return F.filter(params, lambda p: (p != "") & ~p.rlike("(?i)^(max_edge|q)="))


def set_thumb_params(url: Column, max_edge: int = 180, quality: int = 68) -> Column:
    new = F.array(F.lit(f"max_edge={max_edge}"), F.lit(f"q={quality}"))
    out = F.concat(F.substring_index(url, "?", 1), F.lit("?"), F.array_join(F.concat(new, _kept_params(url)), "&"))
    return F.when(url == "", F.lit("")).otherwise(out)


def strip_thumb_params(url: Column) -> Column:
    kept = _kept_params(url)
    base = F.substring_index(url, "?", 1)
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def _joined_tags(tags: Column) -> Column:
    clean = F.filter(F.transform(tags, strip), lambda t: t != "")
    return F.coalesce(F.array_join(F.array_sort(clean), "|"), F.lit(""))


def filter_key(query: Column, tags: Column, year: Column, category: Column, subcategory: Column) -> Column:
    return F.concat_ws(
        "::", strip(F.coalesce(query, F.lit(""))), *[_joined_tags(c) for c in (tags, year, category, subcategory)]
    )


def next_card_number(text: Column) -> Column:
    """Digits plus one with the zero padding kept; '' for blank, null when not a number."""
    raw = strip(text)
    nxt = (raw.try_cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string")
    return F.when(raw == "", F.lit("")).otherwise(
        F.when(raw.rlike(r"^\d+$"), F.lpad(nxt, F.greatest(F.length(raw), F.length(nxt)), F.lit("0")))
    )


def known_prefix(name: Column) -> Column:
    out = F.lit("")
    for vendor in reversed(VENDOR_PREFIXES):
        out = F.when(F.contains(name, F.lit(vendor)), F.lit(vendor)).otherwise(out)
    return out


def device_score(name: Column, rssi: Column | None = None, variant: str = "card") -> Column:
    """How likely a nearby device is a colour meter; ``bridge`` ignores signal strength."""
    low = F.lower(F.coalesce(name, F.lit("")))
    meter = F.when(low.rlike(METER_WORDS), F.lit(100.0)).otherwise(F.lit(0.0))
    if variant == "bridge":
        return meter + F.when(low.rlike(BRIDGE_MODEL_WORDS), F.lit(20.0)).otherwise(F.lit(0.0)) + F.length(low)
    phone = F.when(low.rlike(PHONE_WORDS), F.lit(-50.0)).otherwise(F.lit(0.0))
    signal = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.floor((rssi + 80) / 2 + 0.5).cast("double")))
    return meter + phone + F.coalesce(signal, F.lit(0.0))
