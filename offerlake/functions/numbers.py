"""Decimal and date parsing and formatting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.text import group, normalize_line, strip

MONEY_TYPE = "decimal(14,2)"
CHAIN_TYPE = "decimal(38,16)"


def _european_to_plain(text: Column) -> Column:
    """Comma is the decimal sign; without a comma only the last of several dots is."""
    return (
        F.when(text.contains(","), F.replace(F.replace(text, F.lit(".")), F.lit(","), F.lit(".")))
        .otherwise(F.regexp_replace(text, r"\.(?=.*\.)", ""))
    )


def _unify(text: Column) -> Column:
    bare = F.replace(F.replace(F.upper(text), F.lit("EUR")), F.lit("€"))
    return F.replace(F.replace(bare, F.lit("−"), F.lit("-")), F.lit("–"), F.lit("-"))


def eu_decimal(text: Column, target: str = "decimal(18,4)") -> Column:
    """`1.234,56 EUR` to 1234.56; anything unreadable is null."""
    bare = F.regexp_replace(_unify(text), r"[^0-9,.\-]", "")
    return F.nullif(_european_to_plain(bare), F.lit("")).try_cast(target)


def lenient_decimal(value: Column, mode: str, target: str = "decimal(18,4)") -> Column:
    """The coercions of three places that read numbers typed by people.

    ``check`` reads European text, ``store`` only plain text, ``export`` European
    text with optional inner blanks but no currency.
    """
    text = value.cast("string")
    if mode == "store":
        return F.nullif(text, F.lit("")).try_cast(target)
    if mode == "check":
        bare = F.replace(_unify(strip(text)), F.lit(" "))
        return F.nullif(_european_to_plain(bare), F.lit("")).try_cast(target)
    if mode == "export":
        bare = F.replace(strip(text), F.lit(" "))
        plain = F.when(
            bare.contains(","), F.replace(F.replace(bare, F.lit(".")), F.lit(","), F.lit("."))
        ).otherwise(bare)
        return F.nullif(plain, F.lit("")).try_cast(target)
    raise ValueError(f"unknown mode {mode}")


def eu_format(amount: Column) -> Column:
    """1234.5 to `1.234,50`."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def money(amount: Column) -> Column:
    """Half up, two places: pricing."""
    return F.round(amount, 2).cast(MONEY_TYPE)


def check_money(amount: Column) -> Column:
    """Half even, two places: validation."""
    return F.bround(amount, 2).cast(MONEY_TYPE)


def unit_from_total(total: Column, quantity: Column) -> Column:
    """Price of one unit; the total itself without a usable quantity."""
    return F.coalesce(money(total / F.nullif(quantity, F.lit(0).cast("decimal(14,4)"))), total.cast(MONEY_TYPE))


def currency_prefix(values: Iterable[Column]) -> Column:
    """Currency sign of the first value that carries one, with a blank after it."""
    signs = []
    for value in values:
        clean = strip(value)
        signs.append(F.when(clean.startswith("€"), "€ ").when(F.upper(clean).startswith("EUR"), "EUR "))
    return F.coalesce(*signs, F.lit(""))


def currency_code(text: Column) -> Column:
    return F.when(text.contains("€") | F.upper(text).contains("EUR"), "EUR")


def german_date(text: Column) -> Column:
    """dd.mm.yyyy to a date, null where it is none."""
    return F.when(
        F.regexp_like(text, F.lit(r"^\d{1,2}\.\d{1,2}\.\d{4}$")), F.try_to_date(text, "d.M.yyyy")
    )


# German month names.
MONTHS = {
    "januar": 1, "februar": 2, "maerz": 3, "märz": 3, "april": 4, "mai": 5, "juni": 6,
    "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12,
}


def textual_date(text: Column) -> Column:
    """`3. März 2026` and `03.03.2026` to `03.03.2026`; anything else null."""
    line = normalize_line(text)
    pattern = r"^([0-9]{1,2})\.\s*([A-Za-zÄÖÜäöüß]+)\s*([0-9]{4})$"
    names = F.create_map(*[F.lit(part) for pair in MONTHS.items() for part in pair])
    month = F.try_element_at(names, F.lower(group(line, pattern, 2)))
    spelled = F.format_string(
        "%02d.%02d.%s", group(line, pattern, 1).try_cast("int"), month, group(line, pattern, 3)
    )
    numeric = F.regexp_like(line, F.lit(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"))
    return F.when(numeric, line).when(month.isNotNull(), spelled)


def export_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def export_timestamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
