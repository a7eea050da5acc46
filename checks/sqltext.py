"""SQL snippets for the string functions, written from their definitions for DuckDB (RE2)."""

WS = r"[\s\v\pZ]"
BREAK = r"\r\n|[\n\r\v\f\x1c-\x1e\x85\x{2028}\x{2029}]"


def rep(c, pattern, to="", flags="g"):
    p = pattern.replace("'", "''")
    return f"regexp_replace({c}, '{p}', '{to}', '{flags}')"


def strip(c):
    return rep(c, rf"^{WS}+|{WS}+$")


def upper(c):
    return f"upper(replace({c}, 'ß', 'ss'))"


def lines(c):
    return f"list_filter(list_transform(regexp_split_to_array({c}, '{BREAK}'), lambda s: {strip('s')}), lambda s: s <> '')"


def stem(c):
    return rep(rep(c, r"^(?s:.*)/"), r"(?s)^(.+)\.[^.]+$", r"\1")


def safe(c):
    return rep(rep(c, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$")


def clean(c, mode="trailing"):
    tail = {"trailing": "[#＃]+$", "first": "(?s)[#＃].*$"}[mode]
    return safe(rep(rep(upper(strip(c)), tail), "[*+]+", "-"))


# fixed values: what counts as a code; the patterns in the SQL below say the same as the engine's, written for RE2
EFFECTIVE = r"^([A-Z][A-Z0-9_-]{2,}|[0-9]{3,4}(-[0-9]{1,2})?)$"


def matches(c, pattern):
    return f"regexp_matches({c}, '{pattern}')"


def effective(c, mode="trailing"):
    return matches(clean(c, mode), EFFECTIVE)


def hash_code(c):
    token, full = r"[A-Za-z0-9_+*\-]+#", "^[A-Z0-9_-]+#$"
    per_line = f"list_filter(list_transform({lines(c)}, lambda s: upper(regexp_extract(s, '{token}'))), lambda s: {matches('s', full)})"
    joined = f"upper(regexp_extract({rep(c, WS + '+')}, '{token}'))"
    return f"coalesce(({per_line})[1], CASE WHEN {matches(joined, full)} THEN {joined} END)"


def before_hash(c, mode="trailing"):
    before = f"regexp_extract({c}, '(?s)^([^#＃]*)[#＃]', 1)"
    last = f"coalesce(({lines(before)})[-1], {before})"
    return f"CASE WHEN {matches(c, '[#＃]')} AND {effective(last, mode)} THEN {clean(last, mode)} ELSE '' END"


def dashed(c):
    return rep(rep(c, "[^A-Z0-9]+", "-"), "^-+|-+$")


def style_code_cte(source: str, key: str, text: str = "text") -> str:
    """CTEs ending in ``coded(key, code)``: the code cascade, written with the original bounded repetitions."""
    # RE2 has no class intersection: mark every letter or digit outside ASCII by hand.
    e = rep(f"translate({upper(text)}, 'ＫＦＪＣ', 'KFJC')", r"[^\x00-\x7F\pZ\pP\pS\pM\pC]", "q")
    e = rep(rep(e, rf"\bK{WS}+F\b", "KF"), rf"\bJ{WS}+C\b", "JC")
    e = rep(f"translate({e}, 'O＃', '0#')", "[*+]+", "-")
    forms = f"SELECT {key}, {e} AS s1 FROM {source}"
    three = f"SELECT {key}, s1, {rep('s1', WS + '+')} AS s2, {rep('s1', '[^A-Z0-9]+', '-')} AS s3 FROM forms"
    kf = r"\bK[FEP8][A-Z]?\d{2}[-_ ]?\d{3,4}(?:[-_ ]?\d{1,2}[A-Z]?)?\b"
    jc = r"\bJ[C0][A-Z]?\d{2}[-_ ]?\d{3,4}(?:[-_ ]?\d{1,2}[A-Z]?)?\b"
    steps = [
        (r"\b[A-Z][A-Z0-9]?\d{2,4}(?:[-_ ]?\d{1,4})+(?:[-_ ]?\d{1,2}[A-Z]?)?\b", r"^[A-Z][A-Z0-9]?\d{2,4}(?:-\d{1,4})+(?:-\d{1,2}[A-Z]?)?$"),
        (r"\b[A-Z]{1,4}(?:[-_ ]?\d{1,4}[A-Z]?)+(?:[-_ ]?\d{1,2}[A-Z]?)?\b", r"^[A-Z]{1,4}(?:-\d{1,4}[A-Z]?)+(?:-\d{1,2}[A-Z]?)?$"),
        (r"\b[A-Z]{1,5}\d{1,4}(?:[-_ ]?[A-Z0-9]{1,4})*\b", r"^[A-Z]{1,5}\d{1,4}(?:-[A-Z0-9]{1,4})*$"),
    ]

    def found(pattern, cols):
        return "list_concat(" + ", ".join(f"regexp_extract_all({c}, '{pattern}')" for c in cols) + ")"

    vendor = "flatten([" + ", ".join(f"regexp_extract_all({c}, '{p}')" for c in ("s1", "s2", "s3") for p in (kf, jc)) + "])"
    vendor = f"list_transform({vendor}, lambda c: {rep(rep(dashed('c'), '^K[EP8]', 'KF'), '^J0', 'JC')})"
    full = r"^(KF|JC)[A-Z]?\d{2}-?\d{3,4}(?:-?\d{1,2}[A-Z]?)?$"
    out = [f"list_filter({vendor}, lambda c: {matches('c', full)})[1]"]
    for find, whole in steps:
        flat = "flatten([" + ", ".join(f"regexp_extract_all({c}, '{find}')" for c in ("s1", "s2", "s3")) + "])"
        out.append(f"list_filter(list_transform({flat}, lambda c: {dashed('c')}), lambda c: {matches('c', whole)})[1]")
    for c in ("s1", "s2"):
        number = dashed(strip(f"split_part({c}, '#', 1)"))
        out.append(f"CASE WHEN contains({c}, '#') AND {matches(number, r'^[0-9]{3,4}(?:-[0-9]{1,2})?$')} THEN {number} END")
    word = r"\b[A-Z]{3,6}\b"
    out.append(f"(flatten([regexp_extract_all(s1, '{word}'), regexp_extract_all(s2, '{word}')]))[1]")
    return (
        f"forms AS ({forms}), spelled AS ({three}), "
        f"coded AS (SELECT {key}, coalesce({', '.join(out)}) AS code FROM spelled)"
    )


def filename_parts(name):
    """(standard hash code, standard plain, nas hash, nas plain) expressions of a file name."""
    base = strip(rep(strip(stem(name)), rf"{WS}*\([0-9]+\){WS}*$"))
    bare_standard = strip(rep(base, "_[0-9]+$"))
    bare_nas = strip(rep(base, "(?:_[0-9]{3})+$"))
    return base, bare_standard, bare_nas


def plain(c, mode):
    return f"CASE WHEN {effective(c, mode)} THEN {clean(c, mode)} ELSE '' END"
