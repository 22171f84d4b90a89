"""White space, booleans, injection sanitising and attack labels.

All functions map a string Column to a Column of built-in expressions, so a
chain of them stays one projection. Null input stays null unless said
otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The four separators that only script-level stripping treats as blank.
SEPARATORS = "\x1c\x1d\x1e\x1f"
# Character class of the same blanks for use inside patterns.
BLANK_CLASS = (
    r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Word characters: letters and numbers of every script, and the underscore.
WORD_CLASS = r"\p{L}\p{N}_"

# Boolean spellings, after strip and lower-casing.
TRUE_SPELLINGS = ("1", "true", "yes", "sí", "si", "verdadero", "t", "y")
FALSE_SPELLINGS = ("0", "false", "no", "falso", "f", "n")
# Exact spellings of the two-valued form.
TRUE_EXACT = ("true", "True", "TRUE", "si", "Si", "SI", "sí", "Sí", "1", "verdadero", "Verdadero")

# Injection patterns, applied in this order.
INJECTION_PATTERNS = (
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    rf"on[{WORD_CLASS}]+[{BLANK_CLASS}]*=",
    r"<iframe[^>]*>",
    r"<embed[^>]*>",
    r"<object[^>]*>",
    r"vbscript:",
    r"data:text/html",
    rf"<svg[^>]*on[{WORD_CLASS}]+",
    r"&#[0-9]+;",
    r"&#x[0-9a-fA-F]+;",
)
# The shorter list of the comment sanitiser (no dot-all).
COMMENT_PATTERNS = (
    r"<script[^>]*>.*?</script>",
    r"<iframe[^>]*>.*?</iframe>",
    r"javascript:",
    r"onerror=",
    r"onload=",
)
# Characters that start a spreadsheet formula.
FORMULA_STARTS = ("=", "+", "-", "@")
# Any character but those that no step of sanitising changes: ASCII without controls,
# the signs that markup escapes, and colon and equals sign, which the patterns need.
_TOUCHED = r"""[^\t\n\r\x20-\x7e]|["&'<>:=]"""
# Functions that make a formula dangerous.
DANGEROUS_FUNCTIONS = ("cmd", "system", "exec", "dde", "hyperlink", "importdata", "webservice")

# Attack classes and the pattern that shows each one in raw text.
ATTACK_CLASSES = {
    "script": r"(?is)<script[^>]*>",
    "event_handler": rf"(?i)on[{WORD_CLASS}]+[{BLANK_CLASS}]*=",
    "protocol": r"(?i)javascript:|vbscript:|data:text/html",
    "frame": r"(?i)<(?:iframe|embed|object)[^>]*>",
    "svg": rf"(?i)<svg[^>]*on[{WORD_CLASS}]+",
    "entity": r"(?i)&#(?:[0-9]+|x[0-9a-f]+);",
    "formula": rf"^[{BLANK_CLASS}]*[=+\-@]",
}

# Complaint categories of the survey and a keyword for each.
PAIN_POINT_KEYWORDS = {
    "Facturación": "facturacion",
    "Router": "router",
    "WiFi": "wifi",
    "Cortes": "corte",
    "Soporte": "soporte",
    "App": "app",
    "Portabilidad": "portabilidad",
    "Cancelación": "cancelacion",
    "Velocidad": "velocidad",
    "Instalación": "instalacion",
    "Promoción": "promocion",
    "Atención": "atencion",
}


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """``of(c)``, for which ``c`` is computed once however often ``of`` names it.

    It also stays out of the one method Spark writes for a stage. The JVM compiles no
    method of more than 8,000 bytes, and the cleaning of two columns can exceed that.
    """
    return F.get(F.transform(F.array(c), lambda x: of(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends (plain ``trim`` drops only blanks)."""
    return F.trim(c, F.lit(WHITE_SPACE))


def script_strip(c: Column) -> Column:
    """Like :func:`strip`, also removing the four information separators."""
    return F.trim(c, F.lit(WHITE_SPACE + SEPARATORS))


def is_padded(c: Column) -> Column:
    """Whether the value changes when stripped; null stays null."""
    return F.length(c) != F.length(strip(c))


def strip_or_blank(c: Column) -> Column:
    """Strip; null becomes the empty string."""
    return F.coalesce(strip(c), F.lit(""))


def normalize_boolean(c: Column, data_type: T.DataType | None = None, stripped: bool = False) -> Column:
    """Boolean for the known spellings, null for anything else.

    Booleans pass through and numbers are true unless zero; give
    ``data_type`` for columns that are not strings. ``stripped`` says that the
    text has no blanks at its ends already.
    """
    if isinstance(data_type, T.BooleanType):
        return c
    if isinstance(data_type, T.NumericType):
        return c != 0
    if data_type is not None and not isinstance(data_type, T.StringType):
        return F.lit(None).cast("boolean")
    word = F.lower(c if stripped else script_strip(c))
    return (
        F.when(word.isin(*TRUE_SPELLINGS), F.lit(True))
        .when(word.isin(*FALSE_SPELLINGS), F.lit(False))
    )


def two_valued_boolean(c: Column, data_type: T.DataType | None = None) -> Column:
    """True for the listed spellings, false for everything else including null."""
    if isinstance(data_type, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(data_type, T.NumericType):
        return F.coalesce(c == 1, F.lit(False))
    return F.coalesce(script_strip(c).isin(*TRUE_EXACT), F.lit(False))


def _replace_all(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


# HTML entities, ampersand first.
_MARKUP_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def html_escape(c: Column) -> Column:
    """Entities for the five HTML-special characters."""
    return _replace_all(c, (*_MARKUP_ENTITIES, ("'", "&#x27;")))


def strip_tags(c: Column) -> Column:
    """Remove every ``<...>`` tag, keeping the text between tags."""
    return F.regexp_replace(c, r"<[^>]*>", "")


def _drop_pattern(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, "(?isu)" + pattern, "")


def drop_injection_patterns(c: Column) -> Column:
    """Remove the eleven injection patterns, one after the other."""
    for pattern in INJECTION_PATTERNS:
        c = _drop_pattern(c, pattern)
    return c


def _drop_plain_patterns(c: Column) -> Column:
    """Remove the patterns that hold no escapable character.

    Each of them needs a colon or an equals sign, and removing text adds none,
    so text without such a sign skips the patterns that need it.
    """
    plain = [p for p in INJECTION_PATTERNS if "<" not in p and "&" not in p]

    def chain(patterns: Sequence[str]) -> Column:
        out = c
        for pattern in patterns:
            out = _drop_pattern(out, pattern)
        return out

    colon, equals = c.contains(":"), c.contains("=")
    return (
        F.when(colon & equals, chain(plain))
        .when(colon, chain([p for p in plain if ":" in p]))
        .when(equals, chain([p for p in plain if ":" not in p]))
        .otherwise(c)
    )


def drop_unsafe_characters(c: Column, keep_unicode: bool = False) -> Column:
    """Remove control characters (not tab or line ends) and, by default, non-ASCII."""
    unsafe = r"[\x00-\x08\x0b\x0c\x0e-\x1f]+" if keep_unicode else r"[^\t\n\r\x20-\x7f]+"
    return F.regexp_replace(c, unsafe, "")


def sanitize_markup(c: Column, mode: str = "strict", max_length: int | None = None) -> Column:
    """Escape, remove injection patterns and unsafe characters, strip; cut to ``max_length`` if given.

    The result equals escaping first and then removing all eleven patterns.
    Escaped text holds no ``<`` and no numeric entity but the apostrophe's, so
    the tag and entity patterns reduce to dropping apostrophes, and the other
    patterns contain no escapable character, so they may run on the shorter
    raw text. ``mode="keep_unicode"`` keeps non-ASCII letters. Text without a
    character that a step looks for skips them.
    """
    if mode not in ("strict", "keep_unicode"):
        raise ValueError(f"unknown mode: {mode}")
    safe = _drop_plain_patterns(c)
    safe = drop_unsafe_characters(safe, keep_unicode=mode == "keep_unicode")
    safe = _replace_all(safe, (("'", ""), *_MARKUP_ENTITIES))
    c = F.when(c.rlike(_TOUCHED), safe).otherwise(c)
    if max_length is not None:
        c = F.substring(c, 1, max_length)
    # of the blanks, only these are no unsafe characters
    return F.trim(c, F.lit("\t\n\r ")) if mode == "strict" else script_strip(c)


def starts_formula(c: Column) -> Column:
    """Whether the stripped text begins like a spreadsheet formula."""
    return F.substring(script_strip(c), 1, 1).isin(*FORMULA_STARTS)


def escape_formula(c: Column) -> Column:
    """Strip, and put an apostrophe before text a spreadsheet would evaluate.

    Names its input once, so a long chain of expressions below it is not repeated.
    """
    return _quote_formula(script_strip(c))


def _quote_formula(c: Column) -> Column:
    """An apostrophe before stripped text a spreadsheet would evaluate."""
    return F.regexp_replace(c, r"^(?=[=+\-@])", "'")


def has_dangerous_formula(c: Column) -> Column:
    """Formula that also names one of the dangerous functions."""
    return starts_formula(c) & c.rlike("(?i)" + "|".join(DANGEROUS_FUNCTIONS))


def sanitize_text(c: Column, excel_safe: bool = False, mode: str = "strict",
                  max_length: int | None = None) -> Column:
    """Markup sanitising, then formula escaping when ``excel_safe``."""
    clean = sanitize_markup(c, mode, max_length)
    return _quote_formula(clean) if excel_safe else clean


def clean_comment(c: Column) -> Column:
    """Short sanitiser: script blocks and a leading ``=@FN(...)`` are removed."""
    c = F.regexp_replace(c, r"(?iud)<script.*?>.*?</script>", "")
    c = F.regexp_replace(c, rf"(?d)^=@[A-Z]+\(.*?\)[{BLANK_CLASS}]*", "")
    return script_strip(c)


def guard_comment(c: Column) -> Column:
    """Alternative sanitiser: five patterns removed, then a formula apostrophe."""
    for pattern in COMMENT_PATTERNS:
        c = F.regexp_replace(c, "(?iud)" + pattern, "")
    return script_strip(F.regexp_replace(c, r"^(?=[=+\-@])", "'"))


def attack_flag(c: Column, name: str) -> Column:
    """Whether raw text shows the attack class ``name``."""
    return c.rlike(ATTACK_CLASSES[name])


def attack_classes(c: Column) -> Column:
    """Array of the attack classes seen in raw text."""
    labels = [F.when(attack_flag(c, name), F.lit(name)) for name in ATTACK_CLASSES]
    return F.array_compact(F.array(*labels))


def still_suspicious(c: Column) -> Column:
    """Sanitised text that still shows traces of an attack."""
    return c.rlike("&lt;script|&lt;iframe|&#")


def extract_pain_points(c: Column, keywords: Mapping[str, str] | None = None) -> Column:
    """Array of complaint categories whose keyword occurs in the text.

    Letter case and Spanish accents are ignored.
    """
    folded = F.translate(F.lower(c), "áéíóúüñ", "aeiouun")
    found = [
        F.when(folded.contains(keyword), F.lit(name))
        for name, keyword in (keywords or PAIN_POINT_KEYWORDS).items()
    ]
    return F.array_compact(F.array(*found))


def fill_pain_point(existing: Column, comment: Column,
                    keywords: Mapping[str, str] | None = None) -> Column:
    """Existing category, else the first one found in the comment, else ``unspecified``."""
    found = F.try_element_at(extract_pain_points(comment, keywords), F.lit(1))
    return F.coalesce(existing, found, F.lit("unspecified"))


# Longest file name accepted, in characters.
MAX_FILE_NAME = 255


def file_name_problems(c: Column) -> Column:
    """Array of reasons why a file name is not acceptable; empty when it is."""
    reasons = [
        F.when(c.contains("..") | c.contains("/") | c.contains("\\"), F.lit("path traversal")),
        F.when(c.contains("\x00"), F.lit("null byte")),
        F.when(F.length(c) > MAX_FILE_NAME, F.lit("too long")),
        F.when(c.isNull() | (script_strip(c) == ""), F.lit("empty")),
    ]
    return F.array_compact(F.array(*reasons))


def safe_file_name(c: Column) -> Column:
    """Base name with every character but letters, numbers and ``._-`` replaced."""
    base = F.element_at(F.split(c, "/"), -1)
    return F.regexp_replace(base, r"[^\p{L}\p{N}._\-]", "_")


def header_name(c: Column) -> Column:
    """Lower-case, strip and join words with an underscore."""
    return F.regexp_replace(script_strip(F.lower(c)), rf"[{BLANK_CLASS}]+", "_")


def header_fallback(c: Column) -> Column:
    """Name of a header that maps to nothing: runs of non-word characters to ``_``."""
    return F.regexp_replace(c, rf"[^{WORD_CLASS}]+", "_")


def normalize_value(c: Column) -> Column:
    """Value form of the header rule: blank runs to ``_``, lower-case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(c, r"\s+", "_")))
