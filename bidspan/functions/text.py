"""String cleaning, comparison forms and Brazilian number formats."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a JavaScript-style trim or \\s treats as blank.
_BLANK_CODES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
BLANKS = "".join(map(chr, _BLANK_CODES))
BLANK_CLASS = "[" + "".join(f"\\u{code:04x}" for code in _BLANK_CODES) + "]"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Lower-case letters with marks -> base letters, then bare marks -> nothing.

    Built from the Unicode decomposition of the Latin blocks, so it stays one
    ``translate`` call inside whole-stage codegen.
    """
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not 0x300 <= ord(c) <= 0x36F)
        if base != letter and len(base) == 1:
            source.append(letter)
            target.append(base)
    marks = "".join(chr(c) for c in range(0x0300, 0x0370))
    return "".join(source) + marks, "".join(target)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Rules that test one cleaned text many times would otherwise repeat the
    cleaning in every branch and outgrow what code generation accepts.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


#: Letters with marks that Portuguese uses; replacing these few is cheaper than looking every character up.
_USUAL = dict(zip("áàâãéêíóôõúüç", "aaaaeeiooouuc"))


def fold(text: Column) -> Column:
    """Lower case without accents.

    The full table is a lookup a character, so it is left to texts that still
    hold other than ASCII characters once the usual letters are replaced.
    """
    source, target = _fold_table()

    def usual(t: Column) -> Column:
        for letter, base in _USUAL.items():
            t = F.replace(t, F.lit(letter), F.lit(base))
        return let(t, lambda r: F.when(_ascii(r), r).otherwise(F.translate(r, source, target)))

    return let(F.lower(text), lambda t: F.when(_ascii(t), t).otherwise(usual(t)))


def strip_accents(text: Column) -> Column:
    source, target = _fold_table()
    return F.translate(text, source, target)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def trim_null(text: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    return F.nullif(strip(text), F.lit(""))


def squash_space(text: Column) -> Column:
    """Drop NUL characters and collapse runs of blanks.

    Every kind of blank becomes a space in one ``translate`` pass; the pattern
    that remains is plain spaces, which is several times cheaper to match. Texts
    without other blanks or double spaces skip either step.
    """
    other = "[" + BLANK_CLASS[1:-1].replace("\\u0020", "") + "\\u0000]"
    spaced = let(text, lambda t: F.when(t.rlike(other), F.translate(t, BLANKS + "\x00", " " * len(BLANKS))).otherwise(t))
    return let(spaced, lambda t: F.trim(F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, "  +", " ")).otherwise(t)))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-z0-9]", "")


def compare_form(text: Column) -> Column:
    """Form in which a quotation is compared with extracted text."""
    def unbroken(t: Column) -> Column:  # a search that begins at every letter, so texts without a hyphen are spared it
        return F.when(F.contains(t, F.lit("-")), F.regexp_replace(t, r"(\w)-" + BLANK_CLASS + r"+(\w)", "$1$2")).otherwise(t)

    return F.trim(F.regexp_replace(let(fold(text), unbroken), "[^a-z0-9%$]+", " "))


def fix_mojibake(text: Column) -> Column:
    """Undo UTF-8 read as Latin-1, only where the result is valid UTF-8."""
    suspicious = ~_ascii(text) & text.rlike(r"[\u00c2-\u00c3][\u0080-\u00bf]") & text.rlike(r"(?s)^[\u0000-\u00ff]*$")
    repaired = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    return F.when(suspicious, F.coalesce(repaired, text)).otherwise(text)


def _peel_quotes(body: Column) -> Column:
    """Drop as many leading as trailing quotes; a lone quote stays."""
    def quotes(part: Column) -> Column:
        return F.length(part) - F.length(F.replace(part, F.lit('"'), F.lit("")))

    lead = quotes(F.regexp_extract(body, r'^((?:"\s*)*)', 1))
    tail = quotes(F.regexp_extract(body, r'((?:\s*")*)$', 1))
    pairs = F.when(body.rlike(r'^[\s"]*$'), F.floor(quotes(body) / 2)).otherwise(F.least(lead, tail)).cast("string")
    edges = F.concat(F.lit('^(?:"\\s*){'), pairs, F.lit('}|(?:\\s*"){'), pairs, F.lit("}$"))
    wrapped = body.startswith('"') & body.endswith('"') & (pairs != "0")
    return F.when(wrapped, F.regexp_replace(body, edges, F.lit(""))).otherwise(body)


def clean_title(text: Column) -> Column:
    """Display title: repaired, unwrapped from literal quotes, single spaces."""
    body = strip(let(text, fix_mojibake))
    return F.coalesce(squash_space(let(body, _peel_quotes)), F.lit(""))


def strip_port(url: Column) -> Column:
    """The source publishes an internal port that does not answer from outside."""
    return F.regexp_replace(url, r":1401(?=/|$)", "")


def filename_from_header(header: Column) -> Column:
    """File name of a Content-Disposition header, extended form first."""
    extended = F.nullif(strip(F.regexp_extract(header, r"(?i)filename\*\s*=\s*UTF-8''([^;]+)", 1)), F.lit(""))
    decoded = F.try_url_decode(F.replace(extended, F.lit("+"), F.lit("%2B")))
    plain = F.nullif(strip(F.regexp_extract(header, r'(?i)filename\s*=\s*"?([^";]+)"?', 1)), F.lit(""))
    return F.coalesce(decoded, extended, F.replace(plain, F.lit("+"), F.lit(" ")))


def extension(name: Column) -> Column:
    last = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(F.contains(name, F.lit(".")), F.nullif(last, F.lit("")))


def null_words(text: Column) -> Column:
    """Placeholders people type for "nothing" become NULL."""
    trimmed = strip(text)
    empty = trimmed.rlike("(?iu)^(-+|n/?a|null|não informado)$")
    return F.when((trimmed != "") & ~empty, trimmed)


def money_parse(text: Column) -> Column:
    """Brazilian or plain money text to a number; unreadable text is NULL."""
    kept = F.regexp_replace(strip(text), "[^0-9.,]", "")
    no_dots = F.replace(kept, F.lit("."), F.lit(""))
    comma_form = F.regexp_replace(no_dots, "^([^,]*),", "$1.")
    parts = F.split(kept, r"\.")
    thousands = (F.size(parts) > 2) | ((F.size(parts) == 2) & (F.length(F.element_at(parts, -1)) == 3))
    number = F.when(F.contains(kept, F.lit(",")), comma_form).when(thousands, no_dots).otherwise(kept)
    return F.when(number != "", number.try_cast("double"))


def _swap_separators(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def money_format(value: Column, missing: str = "Não informado") -> Column:
    cents = F.round(value.cast("decimal(38,6)"), 2)
    body = _swap_separators(F.format_number(F.abs(cents), 2))
    shown = F.concat(F.when(cents < 0, F.lit("-R$ ")).otherwise(F.lit("R$ ")), body)
    return F.when(value.isNull(), F.lit(missing)).otherwise(shown)


def distance_format(km: Column) -> Column:
    body = _swap_separators(F.format_number(F.round(km.cast("decimal(20,6)"), 1), 1))
    return F.when(km.isNull() | F.isnan(km.cast("double")), F.lit("—")).otherwise(F.concat(body, F.lit(" km")))


def duration(ms: Column) -> Column:
    seconds = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    minutes = F.floor(seconds / 60).cast("long")
    rest = F.concat((seconds % 60).cast("string"), F.lit("s"))
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), rest)).otherwise(rest)


def escape_markup(json: Column) -> Column:
    """Text inside JSON can no longer close a surrounding tag; the value is unchanged."""
    return F.replace(F.replace(json, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


def split_ellipsis(quote: Column) -> Column:
    """Comparable fragments of a quotation, around [..], (...), ... and the ellipsis sign."""
    parts = F.split(quote, r"\[[^\]]*\]|\(\.\.\.\)|\.{3}|…")
    return F.filter(F.transform(parts, compare_form), lambda p: F.length(p) > 0)


PORTAL_URL = "https://pncp.gov.br/app/editais/"  # fixed value: public page of one purchase


def portal_url(cnpj: Column, year: Column, seq: Column) -> Column:
    known = (F.coalesce(cnpj, F.lit("")) != "") & year.isNotNull() & seq.isNotNull()
    return F.when(known, F.concat(F.lit(PORTAL_URL), F.concat_ws("/", cnpj, year.cast("string"), seq.cast("string"))))


def search_text(agency: Column, object_: Column, city: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws(" ", F.coalesce(agency, empty), F.coalesce(object_, empty), F.coalesce(city, empty))


def embed_text(object_: Column, agency: Column, city: Column) -> Column:
    return F.trim(search_text(object_, agency, city))


def card_title(modality: Column, process: Column, unit: Column, agency: Column) -> Column:
    def shown(c: Column) -> Column:
        t = trim_null(c)
        return F.when(F.lower(t) != "null", t)

    joined = F.concat_ws(" · ", shown(modality), shown(process), shown(unit))
    return F.when(joined != "", joined).otherwise(agency)


def contains_ci(text: Column, term: str) -> Column:
    """Case-insensitive literal substring; % and _ have no special meaning."""
    return F.contains(F.lower(text), F.lit(term.lower()))


def any_contains(text: Column, terms: Sequence[str]) -> Column:
    """True when the text holds one of a short list of literal terms."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(text, F.lit(term))
    return hit
