"""Cleaning of position texts for the export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.functions.keys import unit_key
from offerlake.functions.numbers import lenient_decimal

# Patterns and line starts of the export cleaning.
SUM = r"\d{1,3}(?:[ .]\d{3})*,\d{2}"
PRICE_LABEL = rf"(?i)(?=[EGV])\b(?:EP|GP|EK|VK)\s*:\s*(?:€\s*)?{SUM}(?:\s*€)?"
PRICE_AMOUNT = rf"(?:€\s*{SUM}|{SUM}\s*€)"
UNIT = r"(?:St[üu]ck|Stueck|Stuck|Stck|Stk\.?|St\.?|St|LFM|lfm|lfdm|m²|m2|m|Pauschale|Psch|Set|Paar)"
ALTERNATIVE_LINE = r"(?iu)^\s*Alternativ(?:e|position)?\s*:\s*(.+?)\s*$"
EMPTY_ALTERNATIVE = r"(?iu)^\s*Alternativ(?:e|position)?\s*:?\s*$"
UNIT_PRICE = rf"(?i)\bEP\s*:\s*(?:€\s*)?({SUM})(?:\s*€)?"
CUSTOMER_POSITION = r"(?iu)^\s*Ku\.?\s*Pos\.?\s*:\s*.*$"
HEAD_PRICE_PAIR = rf"(?iuU)^(\s*(?:\d+[A-Za-z]?\s+)?\d+(?:[.,]\d{{1,4}})?\s*{UNIT}\b(?:\s+|$).+?)\s+{SUM}\s+{SUM}\s*$"
UNIT_ONLY = rf"(?iu)^\s*(?:\d+[A-Za-z]?\s+)?\d+(?:[.,]\d+)?\s*{UNIT}\.?\s*$"
TABLE_PRICE_PAIR = rf"(?iu)^\s*\d+[A-Za-z]?\s+(?=.+[A-Za-zÄÖÜäöüß])(?=.+\s{SUM}\s+{SUM}\s*$).*$"
QUANTITY_PREFIX = rf"(?iu)^\s*(?:\d+[A-Za-z]?\s+)?([0-9]+(?:[.,][0-9]+)?)\s*({UNIT})(?:\s+|$)(.*)$"
REFERENCE_ONLY = r"(?i)^(?:\d{2}\.){3}[A-Z]:?$"
# what price tokens, uneven blanks and blanks beside signs have in common; a line without any stays as it is
PRICE_SIGNS = r"€|,\d\d|\s\s|\s[,:;]"
LOOSE_BLANKS = r"[ \t]{2}|\s[,:;)\]]|[(\[]\s"
# no text of its own: one pass over a line instead of one a pattern
LAYOUT_LINE = "(?iu)^(?:" + "|".join(p.removeprefix("(?iu)^") for p in (UNIT_ONLY, TABLE_PRICE_PAIR, ALTERNATIVE_LINE)) + ")"
MARKER_LINE = "(?iu)^(?:" + "|".join(p.removeprefix("(?iu)^") for p in (EMPTY_ALTERNATIVE, CUSTOMER_POSITION)) + ")"
NUMERIC_LAYOUT = r"^[0-9.,/\sxX*+-]+$"
NOISE_STARTS = (
    "geschäftsführung:", "geschaeftsfuehrung:", "di peter gubisch", "wolfgang neutatz", "angebot:",
    "auftragsbestätigung:", "auftragsbestaetigung:", "auftragsnummer:", "pos-nr.", "zahlungskonditionen:",
    "gesamtpreis positionen", "gesamt nettosumme", "rabatte:", "zwischensumme", "mwst", "gesamtsumme", "summe:",
)
NOISE_WORDS = (
    "wert/stück", "wert gesamt", "landesgericht", "fn212294", "uid-nr", "www.schlotterer",
    "office@schlotterer", "schlotterer sonnenschutz systeme gmbh", "5421 adnet, seefeldmühle",
    "5421 adnet, seefeldmuehle",
)
# on a lower-cased line with its outer blanks
NOISE = (
    f"^[{X.BLANKS}]*(?:\\z|" + "|".join(f"\\Q{start}\\E" for start in NOISE_STARTS) + ")"
    f"|(?=[{''.join(sorted({word[0] for word in NOISE_WORDS}))}])(?:" + "|".join(f"\\Q{word}\\E" for word in NOISE_WORDS) + ")"
)


def tighten(text: Column) -> Column:
    """Single blanks, none before closing or after opening signs."""
    def compact(loose: Column) -> Column:
        even = F.regexp_replace(loose, "[ \t]{2,}", " ")
        even = F.regexp_replace(even, r"\s+([,:;)\]])", "$1")
        return F.regexp_replace(even, r"([(\[])\s+", "$1")

    return X.let(text, lambda bound: F.btrim(
        F.when(F.regexp_like(bound, F.lit(LOOSE_BLANKS)), compact(bound)).otherwise(bound), F.lit(" -,\t")))


def strip_price_tokens(text: Column) -> Column:
    """Short text without labelled or marked prices; null when nothing is left."""
    return X.let(X.strip(text), _without_prices)


def _without_prices(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(line, PRICE_LABEL, ""), PRICE_AMOUNT, "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s*€\s*", " "), r"\s{2,}", " ")
    bare = F.regexp_replace(bare, r"\s+([,:;])", "$1")
    bare = F.when(F.regexp_like(line, F.lit(PRICE_SIGNS)), bare).otherwise(line)
    return X.blank_to_null(F.btrim(bare, F.lit(" -,\t")))


def strip_head_price_pair(text: Column) -> Column:
    """Quantity head without its two unlabelled prices."""
    def cut(raw: Column) -> Column:
        head = X.blank_to_null(F.btrim(tighten(F.regexp_extract(raw, HEAD_PRICE_PAIR, 1)), F.lit(" :,-\t")))
        # both prices hold a comma
        return F.when(raw.contains(",") & F.regexp_like(raw, F.lit(HEAD_PRICE_PAIR)), head).otherwise(raw)

    return X.let(X.clean_optional(text), cut)


def is_noise(line: Column) -> Column:
    return F.regexp_like(F.lower(line), F.lit(NOISE))


def is_number_row(line: Column) -> Column:
    return F.regexp_like(line, F.lit(NUMERIC_LAYOUT))


def without_quantity(lines: Column, quantity: Column, unit: Column) -> Column:
    """Drops a leading quantity from the first line when it repeats the position's own."""
    return X.let(lines, lambda bound: X.let(F.get(bound, F.lit(0)), lambda head: _drop_quantity(bound, head, quantity, unit)))


def _drop_quantity(lines: Column, head: Column, quantity: Column, unit: Column) -> Column:
    tail = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))

    def cut(found: Column) -> Column:
        printed = lenient_decimal(found["printed"], "export")
        same_quantity = quantity.isNull() | printed.isNull() | (F.abs(quantity - printed) <= F.lit(0.001))
        same_unit = X.let(unit_key(unit), lambda expected: expected.isNull() | F.coalesce(unit_key(found["unit"]) == expected, F.lit(False)))
        dropped = lambda rest: (rest == "") | F.regexp_like(rest, F.lit(REFERENCE_ONLY))
        without = X.let(tighten(found["rest"]), lambda rest: F.when(dropped(rest), tail).otherwise(F.concat(F.array(rest), tail)))
        return F.when(same_quantity & same_unit, without).otherwise(lines)

    found = F.struct(*[F.regexp_extract(head, QUANTITY_PREFIX, i + 1).alias(name) for i, name in enumerate(("printed", "unit", "rest"))])
    return F.when(F.regexp_like(head, F.lit(QUANTITY_PREFIX)), X.let(found, cut)).otherwise(lines)


def clean_long_text(text: Column, quantity: Column | None = None, unit: Column | None = None) -> Column:
    """Long text without prices, layout numbers, page noise and alternative lines."""
    none = F.lit(None).cast("string")
    quantity = F.lit(None).cast("decimal(14,4)") if quantity is None else quantity
    lines = F.transform(X.split_lines(X.strip(text)), X.strip)
    open_lines = F.filter(
        lines,
        lambda line: ~(
            (line == "")
            | F.regexp_like(line, F.lit(LAYOUT_LINE))
            | (is_number_row(line) & (F.regexp_count(line, F.lit(SUM)) >= 2))
            | is_noise(line)
        ),
    )
    clean = F.transform(open_lines, lambda line: tighten(strip_head_price_pair(_without_prices(line))))
    kept = F.filter(
        clean,
        lambda line: line.isNotNull()
        & ~(
            is_number_row(line) | is_noise(line)
            | F.regexp_like(line, F.lit(MARKER_LINE))
        ),
    )
    return X.blank_to_null(X.join_lines(without_quantity(kept, quantity, none if unit is None else unit)))


def embedded_alternatives(text: Column) -> Column:
    """Texts of the alternative lines of a long text; lines that hold only a price do not count."""
    lines = F.filter(X.split_lines(X.strip(text)), lambda line: F.regexp_like(line, F.lit(ALTERNATIVE_LINE)))
    texts = F.transform(lines, lambda line: X.strip(F.regexp_extract(line, ALTERNATIVE_LINE, 1)))
    return F.filter(texts, lambda t: strip_price_tokens(t).isNotNull())


def without_alternatives(text: Column) -> Column:
    lines = F.filter(X.split_lines(X.strip(text)), lambda line: ~F.regexp_like(line, F.lit(ALTERNATIVE_LINE)))
    return X.clean_optional(X.join_lines(lines))


RTF_HEAD = "{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Calibri;}}\\viewkind4\\uc1\\pard\\f0\\fs18 "
RTF_TAIL = "\\par}"
ODD_SIGN = r"[^ -~\r\n]"


def rich_text(text: Column) -> Column:
    """Rich-text form: escapes, line marks, other characters as numbered code units.

    Characters outside the basic plane keep the code they have above 32767 minus
    65536, as the receiving system reads it.
    """
    def encoded(char: Column) -> Column:
        code = F.ascii(char)
        return F.concat(F.lit("\\u"), F.when(code > 32767, code - 65536).otherwise(code).cast("string"), F.lit("?"))

    def body(plain: Column) -> Column:
        escaped = F.regexp_replace(plain, r"([\\{}])", r"\\$1")
        escaped = F.replace(F.replace(escaped, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\line "))
        # what an odd sign becomes holds none itself, so they are replaced one after the other
        odd = F.array_distinct(F.regexp_extract_all(plain, F.lit(ODD_SIGN), F.lit(0)))
        return F.aggregate(odd, escaped, lambda done, char: F.replace(done, char, encoded(char)))

    return F.concat(F.lit(RTF_HEAD), X.let(X.strip(F.coalesce(text, F.lit(""))), body), F.lit(RTF_TAIL))
