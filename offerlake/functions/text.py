"""Text and line functions over string columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The money and currency spellings that occur in the documents.
CURRENCY = "(?:EUR|€)"
MONEY = r"(?:[0-9]{1,3}(?:[ .][0-9]{3})*,[0-9]{2}|[0-9]+,[0-9]{2})"
GROUPED_MONEY = r"[0-9]{1,3}(?:[ .][0-9]{3})*,[0-9]{2}"
# looks at the first sign, so that most places are left at once
AMOUNT_TOKEN = rf"(?=[-\s€E0-9])-?\s*{CURRENCY}?\s*(?:[0-9]{{1,3}}(?:[ .][0-9]{{3}})*,[0-9]{{2}}|[0-9]+,[0-9]{{2}})"
TWO_AMOUNTS = rf"({GROUPED_MONEY})\s+{CURRENCY}?\s*({GROUPED_MONEY})"
LETTER = "[A-Za-zÄÖÜäöüß]"

# The characters at which a text is cut into lines, and the ones a trim removes.
OTHER_BREAK = "\r\n|[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
BLANKS = (
    " \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``.

    Expressions that use an expensive value several times would otherwise carry one
    copy per use; a lambda variable is computed once per row.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


HARD_BLANKS = "\u00a0\u2007\u202f"
# blanks that differ from one plain blank
UNEVEN_BLANKS = f" [ \t{HARD_BLANKS}]+|[\t{HARD_BLANKS}][ \t{HARD_BLANKS}]*"


def normalize_text(text: Column) -> Column:
    """Non-breaking blanks become plain blanks, carriage returns go."""
    # a pattern, as translate looks up every sign of the text
    return F.regexp_replace(F.replace(text, F.lit("\r")), f"[{HARD_BLANKS}]", " ")


def normalize_line(text: Column) -> Column:
    """``normalize_text`` plus collapsed blanks and no outer blanks."""
    return strip(F.regexp_replace(F.replace(text, F.lit("\r")), UNEVEN_BLANKS, " "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean_optional(text: Column) -> Column:
    return blank_to_null(strip(text))


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def is_filled(text: Column) -> Column:
    """Whether ``normalize_line`` or ``strip`` leave anything; a filter on theirs would run them twice."""
    return F.regexp_like(text, F.lit(f"[^{BLANKS}]"))


def comparison_text(text: Column) -> Column:
    """Trimmed, lower-cased, single blanks; null becomes the empty text."""
    return F.coalesce(F.lower(collapse(text)), F.lit(""))


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break opens no further line."""
    return let(
        # every break as the one sign, as split compiles a pattern again for each text
        F.split(F.regexp_replace(text, OTHER_BREAK, "\n"), "\n", -1),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts),
    )


def split_pages(text: Column) -> Column:
    return F.split(text, "\f", -1)


def normal_lines(text: Column) -> Column:
    """Normalised lines, blank ones kept."""
    # blanks are folded once a text instead of once a line: they are no breaks, and no carriage return stays in a line
    return F.transform(split_lines(F.regexp_replace(text, UNEVEN_BLANKS, " ")), strip)


def filled_lines(text: Column) -> Column:
    """Normalised lines without the blank ones."""
    return F.filter(normal_lines(text), lambda line: line != "")


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _any_of(words: Iterable[str]) -> str:
    return "(?:" + "|".join(f"\\Q{word}\\E" for word in words) + ")"


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """One alternation instead of a tree of tests: smaller plans, one pass over the text."""
    return F.regexp_like(text, F.lit(_any_of(words)))


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    return F.regexp_like(text, F.lit("^" + _any_of(prefixes)))


def matches(text: Column, pattern: str) -> Column:
    """Search: true where the pattern occurs anywhere."""
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match, null where nothing matches."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, index))


def first_match(text: Column, patterns: Iterable[str]) -> Column:
    """First group of the first pattern, in list order, that occurs at all."""
    return F.coalesce(*[strip(group(text, pattern)) for pattern in patterns])


def amount_tokens(text: Column) -> Column:
    """All money tokens of a text in reading order, sign and currency kept."""
    found = F.regexp_extract_all(normalize_text(text), F.lit(AMOUNT_TOKEN), F.lit(0))
    tokens = F.transform(found, lambda token: strip(F.regexp_replace(token, "[ \t]+", " ")))
    return F.when(~text.contains(","), F.array().cast("array<string>")).otherwise(tokens)


def last_of(values: Column, back: int = 1) -> Column:
    """The entry so many places from the end, null where there is none; ``values`` is computed once."""
    return F.try_element_at(values, F.lit(-back))


def first_true(flags: Column) -> Column:
    """1-based place of the first true entry, 0 where there is none."""
    return F.coalesce(F.array_position(flags, F.lit(True)), F.lit(0)).cast("int")


def lines_before(lines: Column, stop: Callable[[Column], Column]) -> Column:
    """The leading lines up to, not including, the first one that stops."""
    def cut(bound: Column) -> Column:
        return let(
            first_true(F.transform(bound, stop)),
            lambda at: F.when(at > 0, F.slice(bound, F.lit(1), at - 1)).otherwise(bound),
        )

    return let(lines, cut)


def drop_repeats(lines: Column) -> Column:
    """Removes a line that equals, ignoring case, the line right before it."""
    return let(
        lines,
        lambda bound: F.filter(
            bound, lambda line, i: (i == 0) | (F.lower(line) != F.lower(F.get(bound, i - 1)))
        ),
    )


def offer_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


# Line starts of page furniture.
FOOTER_EXACT = ("ansicht von außen", "ansicht von innen")
FOOTER_STARTS = (
    "lupre ai solutions", "webseite:", "e-mail:", "telefon:",
    "alu-one metallbaupartner gmbh", "heroalstraße", "office@alu-one.at", "tel 07682",
    "rekord vomp gmbh", "au 48, 6134 vomp", "vomp@rekord-fenster.com", "fn 623494d", "kto-nr.",
    "bankverbindung", "geschaeftsfuehrer:", "geschäftsführer:", "firmenbuchnr:", "firmengericht:",
    "uid-nr:", "wolfgang neumeyer", "michael frauscher", "salzburger sparkasse",
    "iban:", "bic:", "blz:", "konto:", "bank:", "kontoinhaber:", "oberbank", "raiba",
)
FOOTER_WITH_PAGE = ("angebotsnummer:", "angebot n", "angebot :", "angebot")


# one pattern over the lower-cased line, as every further search reads the line anew
FURNITURE = (
    r"^(?:\z|[-_= ]+$|" + _any_of(FOOTER_EXACT) + r"\z|" + _any_of(FOOTER_STARTS) + r"|pos\.(?=(?s:.*)anzahl)(?s:.*)einzelpreis|"
    + _any_of(FOOTER_WITH_PAGE) + r"(?s:.*)seite|(?U:angebot [^\n]*\d)|seite(?= )(?s:.*) von )"
)


def is_page_furniture(line: Column) -> Column:
    """Rules, footers, bank lines and repeated page heads."""
    return F.regexp_like(strip(F.lower(line)), F.lit(FURNITURE))


def _without_furniture(lines: Column) -> Column:
    """Of normalised lines."""
    return F.filter(lines, lambda line: ~F.regexp_like(F.lower(line), F.lit(FURNITURE)))


def trim_block(lines: Column, stop_words: Iterable[str]) -> Column:
    """Normalised, filled lines of a block up to the first stop word, without page furniture."""
    stop_words = tuple(stop_words)
    filled = F.filter(F.transform(lines, normalize_line), lambda line: line != "")
    return _without_furniture(lines_before(filled, lambda line: contains_any(F.lower(line), stop_words)))


def trim_text(text: Column, stop_words: Iterable[str]) -> Column:
    """``trim_block`` of the lines of a text."""
    stop_words = tuple(stop_words)

    def trimmed(folded: Column) -> Column:
        filled = F.filter(F.transform(split_lines(folded), strip), lambda line: line != "")
        # most blocks hold no stop word, so their lines need not be searched one by one
        open_lines = F.when(
            contains_any(F.lower(folded), stop_words), lines_before(filled, lambda line: contains_any(F.lower(line), stop_words))
        ).otherwise(filled)
        return _without_furniture(open_lines)

    return let(F.regexp_replace(text, UNEVEN_BLANKS, " "), trimmed)


def first_description(
    lines: Column, skip_starts: Iterable[str], preferred: Iterable[str] = (), normal: bool = False
) -> Column:
    """First descriptive line of a block; a line with a preferred word wins over earlier ones. ``normal``: the lines are normalised already."""
    preferred = tuple(preferred)
    skipped = rf"^{_any_of(skip_starts)}|b/h:|flgnr|^(?U:[0-9]+(?:[.,][0-9]+)?\s*(?:stk|st[eü]ck|lfm)\b)"

    def usable(line: Column) -> Column:
        return (
            (line != "") & ~F.regexp_like(F.lower(line), F.lit(skipped))
            & ~(line.contains(",") & F.regexp_like(line, F.lit(TWO_AMOUNTS)))
        )

    def without_price(line: Column) -> Column:
        lead = rf"(?i)^{CURRENCY}?\s*[0-9][0-9 .]*,[0-9]{{2}}\s*{CURRENCY}?\s*"
        tail = rf"(?i)\s+{CURRENCY}?\s*[0-9][0-9 .]*,[0-9]{{2}}\s*{CURRENCY}?$"
        # a price has a comma
        return strip(F.when(line.contains(","), F.regexp_replace(strip(F.regexp_replace(line, lead, "")), tail, "")).otherwise(line))

    candidates = F.filter(
        F.transform(F.filter(lines if normal else F.transform(lines, normalize_line), usable), without_price),
        lambda line: F.regexp_like(line, F.lit("[A-Za-zÄÖÜäöü]")),
    )
    if not preferred:
        return F.get(candidates, F.lit(0))
    return let(
        candidates,
        lambda found: F.coalesce(
            F.get(F.filter(found, lambda line: contains_any(F.lower(line), preferred)), F.lit(0)),
            F.get(found, F.lit(0)),
        ),
    )


def structure_code(text: Column) -> Column:
    """Bill-of-quantities code such as 57.05.21.A."""
    return group(text, r"([0-9]{2}\.[0-9]{2}\.[0-9]{2}\.[A-Z])")


def dimensions(text: Column, *patterns: str) -> Column:
    """Width and height of the first pattern that occurs, as a struct of texts."""
    width = F.coalesce(*[group(text, p, 1) for p in patterns])
    height = F.coalesce(*[group(text, p, 2) for p in patterns])
    return F.struct(width.alias("width"), height.alias("height"))


BOX_DIMENSION = r"B/H:\s*([0-9.,]+)\s*x\s*([0-9.,]+)"
ELEMENT_DIMENSION = r"Elementbreite:\s*([0-9]+)\s*mm,\s*Elementh[oö]he:\s*([0-9]+)\s*mm"
