"""Rule sets of the suppliers whose positions begin with one table row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.operators.items import block_top_ratio
from offerlake.rules.base import RuleSet
from offerlake.rules.suppliers import SUPPLIER_NAMES

POINT_MONEY = r"(?:[0-9]{1,3}(?:[. ][0-9]{3})*,[0-9]{2}|[0-9]+,[0-9]{2})"


def like(pattern: str):
    return lambda line, following: F.regexp_like(line, F.lit(pattern))


def kept_with(rows: DataFrame, name: str, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Adds ``value`` as ``name`` and leaves out the rows where ``keep`` of it does not hold.

    A filter would be pushed below the column and compute it a second time; nothing is pushed into an explode.
    """
    return rows.select("*", F.explode(F.filter(F.array(value), keep)).alias(name))


def lines_of(blocks: DataFrame, stop_words: tuple[str, ...], text: Column | None = None) -> DataFrame:
    """Adds ``lines``: the trimmed block; blocks without any line are no position."""
    block = F.col("block") if text is None else text
    return kept_with(blocks, "lines", X.trim_text(block, stop_words), lambda lines: F.size(lines) > 0)


def head(pattern: str, index: int) -> Column:
    """Group of the position row, read from the first line of the block."""
    return F.regexp_extract(F.regexp_extract("block", r"^[\s]*([^\n]*)", 1), pattern, index)


def description(lines: Column, keep, clean=None) -> Column:
    """Kept lines, cleaned, without direct repeats, as one text."""
    cleaned = lines if clean is None else F.transform(lines, lambda line: clean(line))
    return X.join_lines(X.drop_repeats(F.filter(cleaned, keep)))


def rest(lines: Column) -> Column:
    return F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))


# --- muigg: one row with both prices, parentheses mark alternatives -----------------------------

MUIGG_ROW = (
    r"^\s*([0-9]{3}(?:\.[0-9]+)?|[A-Za-z]{1,3}[0-9]{2}(?:\.[0-9]+)?)\s+([0-9]+,[0-9]{2})\s+(Stk\.)\s+(.+?)\s+"
    rf"({POINT_MONEY})\s+(\(?{POINT_MONEY}\)?)\s*$"
)
MUIGG_SIZE = r"(?<![0-9])([0-9]{3,4})\s*x\s*([0-9]{3,4})(?![0-9])"


def _muigg(blocks: DataFrame) -> DataFrame:
    stops = ("zwischensumme:", "gesamtbetrag netto", "zzgl.", "gesamtbetrag", "zahlbar innerhalb", "unsere angebotenen preise")
    rows = lines_of(blocks, stops).withColumns({
        "position_no": F.upper(head(MUIGG_ROW, 1)), "short": X.normalize_line(head(MUIGG_ROW, 4)), "total": head(MUIGG_ROW, 6),
    })
    joined = X.join_lines(F.col("lines"))
    width, height = X.group(F.col("short"), MUIGG_SIZE, 1), X.group(F.col("short"), MUIGG_SIZE, 2)
    low = F.lower("short")
    required = ~(
        F.lower("position_no").startswith("z")
        | X.starts_with_any(low, ("az ", "az-", "lieferung", "montage", "fracht", "transport"))
        | (F.col("position_no").contains(".") & width.isNull())
    )
    return rows.select(
        "document_id", "block_no", "page_ref", "page_end_ref", "position_no",
        X.normalize_line(X.first_match(joined, (r"(?i)LV-Pos:\s*([^\n]+)", r"(?i)Plan:\s*([^\n]+)"))).alias("lv_pos"),
        F.regexp_like("total", F.lit(r"\(.*\)")).alias("is_alternative"),
        head(MUIGG_ROW, 2).alias("quantity_raw"), head(MUIGG_ROW, 3).alias("unit"), width.alias("width_raw"), height.alias("height_raw"),
        F.col("short").alias("description_short"),
        description(rest(F.col("lines")), lambda line: ~F.regexp_like(line, F.lit(MUIGG_ROW))).alias("description_long"),
        F.btrim(head(MUIGG_ROW, 5), F.lit("() ")).alias("unit_price_raw"), F.btrim("total", F.lit("() ")).alias("line_total_raw"),
        block_top_ratio().alias("item_top_ratio"), required.alias("image_required"),
    )


MUIGG = RuleSet(
    "muigg", SUPPLIER_NAMES["muigg"],
    lambda low: low.contains("muigg.at") & (low.contains("angebot nr.") | low.contains("auftragsbestätigung")),
    like(MUIGG_ROW), _muigg,
)

# --- koch: wide door row, prices in a sum row ---------------------------------------------------

KOCH_ROW = r"^\s*(\d+)\s+(\d+)Stk\.\s+(\S+)\s+([0-9]+)mm\s+([0-9]+)mm\s+([0-9]+)mm\s+(\S+)\s+(.+?)\s*$"
KOCH_PRICE = rf"^\s*([0-9]+)\s+(.+?)\s+{X.CURRENCY}\s*({X.MONEY})\s+{X.CURRENCY}\s*({X.MONEY})\s*$"
KOCH_SUM = rf"(?i)^\s*Summe\s+{X.CURRENCY}\s*({X.MONEY})\s+{X.CURRENCY}\s*({X.MONEY})\s*$"
KOCH_END = r"^(?:summe |abzüglich |gesamtpreis ohne|gesamtpreis incl|gesamtpreis inkl)"


def _koch(blocks: DataFrame) -> DataFrame:
    stops = ("angebotsnummer:", "gesamtpreis ohne mwst", "gesamtpreis incl. mwst", "gesamtpreis inkl. mwst",
             "preisliste transportkosten", "zahlungskonditionen", "mit freundlichen grüßen")
    rows = lines_of(blocks, stops)
    lines = F.col("lines")

    def first_hit(pattern: str, latest: bool = False, sign: str = "") -> Column:
        # ``sign`` is in every line that fits
        hits = F.filter(lines, lambda line: line.contains(sign) & F.regexp_like(line, F.lit(pattern)))
        return X.last_of(hits) if latest else F.get(hits, F.lit(0))

    def first_group(pattern: str, index: int, sign: str = "") -> Column:
        return X.normalize_line(F.regexp_extract(first_hit(pattern, sign=sign), pattern, index))

    place = first_group(r"(?i)Objektposition:\s*(.+)", 1)
    # the description ends at the sum row; a price table inside it is skipped
    body = X.lines_before(rest(lines), lambda line: F.regexp_like(F.lower(line), F.lit(KOCH_END)))
    body = X.lines_before(body, lambda line: F.lower(line).startswith("anzahl preiselement"))
    keep = lambda line: ~(
        F.regexp_like(line, F.lit(KOCH_ROW)) | F.regexp_like(line, F.lit(KOCH_PRICE)) | F.regexp_like(line, F.lit(KOCH_SUM))
        | X.starts_with_any(F.lower(line), ("position stück", "position stuck", "auftragsnummer:", "angebotsnummer:"))
    )
    rows = rows.withColumn("sum_row", first_hit(KOCH_SUM, True, ","))
    return rows.select(
        "document_id", "block_no", "page_ref", head(KOCH_ROW, 1).alias("position_no"), place.alias("lv_pos"),
        F.lit(False).alias("is_alternative"), head(KOCH_ROW, 2).alias("quantity_raw"), F.lit("Stk.").alias("unit"),
        head(KOCH_ROW, 5).alias("width_raw"), head(KOCH_ROW, 6).alias("height_raw"),
        F.coalesce(first_group(KOCH_PRICE, 2, ","), place, X.normalize_line(head(KOCH_ROW, 8))).alias("description_short"),
        description(body, keep).alias("description_long"),
        *[X.normalize_line(F.regexp_extract("sum_row", KOCH_SUM, i)).alias(c) for i, c in ((1, "unit_price_raw"), (2, "line_total_raw"))],
    )


def _koch_notes(text: Column) -> Column:
    from offerlake.operators.headers import document_notes

    return document_notes(text)


KOCH = RuleSet(
    "koch", SUPPLIER_NAMES["koch"],
    lambda low: low.contains("koch türen gmbh") & low.contains("objekt:") & (
        (low.contains("angebotsnummer:") & low.contains("angebotsdatum:"))
        | (low.contains("auftragsnummer:") & low.contains("auftragsdatum:"))
    ),
    like(KOCH_ROW), _koch, notes=_koch_notes,
)

KOCH_DETAIL = RuleSet(
    "koch_detail", SUPPLIER_NAMES["koch_detail"],
    lambda low: low.contains("auftrag:") & (low.contains("position:") | low.contains("position(en):")) & X.contains_any(
        low, ("visualisierung", "systemdetails", "system ", "mit stockmaßen", "türdesign", "m=1:2")
    ),
    count=lambda text: F.lit(0),
)

# --- schachermayer: article rows under running section labels -----------------------------------

SCHACHERMAYER_ROW = (
    rf"^\s*([0-9]{{2,3}})\s+([0-9]+,[0-9]{{2}})\s+([A-Z]{{2}})\s+(\*?\S+)\s+({POINT_MONEY})\s+([0-9]+)\s+({POINT_MONEY})\s+([0-9]+)\s*$"
)
SCHACHERMAYER_NOISE_STARTS = (
    "schachermayer gmbh", "4020 linz", "t. +43", "f. +43", "e. ", "www.schachermayer.at", "sch linz", "auftraggeber", "angebot",
    "angebots-nr.", "auftragsnummer", "ihr zuständiger sachbearbeiter", "tel.:", "fax.:", "herr ", "frau ", "sr. schauraum",
    "archeneo park", "pass-thurn-str.", "6372 ", "6233 ", "österreich", "warenempfänger", "bestellangaben-kunde", "kundennummer",
    "datum", "seite",
)
SCHACHERMAYER_NOISE_WORDS = (
    "ara-ln:", "uid-nr.", "landesgericht", "dvr ", "eori:", "steuernummer deutschland", "weee-reg.", "währung eur",
)
PAIR_AT_END = rf"(?i)(?:^|\s)(?:€\s*)?{POINT_MONEY}(?:\s*€)?\s+(?:€\s*)?{POINT_MONEY}(?:\s*€)?\s*$"


def _schachermayer_noise(line: Column) -> Column:
    return X.let(F.lower(line), lambda low: (
        (low == "bezeichnung") | X.starts_with_any(low, SCHACHERMAYER_NOISE_STARTS) | X.contains_any(low, SCHACHERMAYER_NOISE_WORDS)
        | low.endswith("@schachermayer.at") | (low.startswith("_") & low.contains("bezeichnung"))
        | (low.contains("angebots-nr.") & low.contains("datum") & low.contains("seite"))
        | (low.contains("preis/me") & low.contains("nettobetrag")) | low.startswith("kommission:")
    ))


def _schachermayer(blocks: DataFrame) -> DataFrame:
    # the section of a position is the last label printed before its row
    label = r"(?m)^\s*(?:Kom\.|[Kk]ommission:)\s*([^\n]+?)\s*$"
    labels = F.regexp_extract_all("before", F.lit(label), F.lit(1))
    own = X.normalize_line(F.get(F.reverse(labels), F.lit(0)))
    earlier = Window.partitionBy("document_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.withColumn("lv_pos", F.last(own, ignorenulls=True).over(earlier))
    rows = lines_of(rows, ("summe positionen", "mehrwertsteuer", "endbetrag", "zahlungsbedingungen"))
    kept = F.filter(F.col("lines"), lambda line: ~_schachermayer_noise(line))
    rows = rows.withColumn("kept", kept)
    body = X.lines_before(
        F.filter(rest(F.col("lines")), lambda line: ~_schachermayer_noise(line)),
        lambda line: F.regexp_like(line, F.lit(r"^[0-9]{2}\b.+[0-9]{1,3}(?:[. ][0-9]{3})*,[0-9]{2}$")),
    )
    discount = r"(?i)^(.+?)\s+[0-9]+(?:[.,][0-9]+)?-\s*%\s*Rabatt\s*$"
    keep = lambda line: ~(
        F.regexp_like(line, F.lit(SCHACHERMAYER_ROW)) | F.regexp_like(line, F.lit(discount)) | F.regexp_like(line, F.lit(PAIR_AT_END))
    )
    short = X.first_description(
        rest(F.col("kept")), ("rabatt",), ("solido", "kunex", "rosettenlochbohrung", "türschließer", "blindzylinder"), normal=True
    )
    return rows.select(
        "document_id", "block_no", "page_ref", head(SCHACHERMAYER_ROW, 1).alias("position_no"), "lv_pos",
        F.lit(False).alias("is_alternative"), head(SCHACHERMAYER_ROW, 2).alias("quantity_raw"), head(SCHACHERMAYER_ROW, 3).alias("unit"),
        X.normalize_line(F.regexp_replace(short, r"(?i)\s+[0-9]+(?:[.,][0-9]+)?-\s*%\s+Rabatt$", "")).alias("description_short"),
        description(body, keep).alias("description_long"),
        head(SCHACHERMAYER_ROW, 5).alias("unit_price_raw"), head(SCHACHERMAYER_ROW, 7).alias("line_total_raw"),
        F.lit(False).alias("image_required"), F.lit(False).alias("image_auto_match_allowed"),
    )


SCHACHERMAYER = RuleSet(
    "schachermayer", SUPPLIER_NAMES["schachermayer"],
    lambda low: low.contains("schachermayer gmbh") & (low.contains("angebots-nr.") | low.contains("auftragsnummer")),
    like(SCHACHERMAYER_ROW), _schachermayer, headings=True, pricing="line",
)

# --- alu_one: one header row, alternative heading before it -------------------------------------

ALU_PRICE = rf"(?:{X.CURRENCY}\s*{X.MONEY}|{X.MONEY}\s*{X.CURRENCY})"
ALU_ROW = (
    r"^\s*(\d{3}[A-Za-z]?(?:-\d+)?)\s+([0-9]+(?:[.,][0-9]+)?)\s+(Stk|Stück|LFM|lfm)\s+(.+?)"
    rf"(?:\s+({ALU_PRICE}))?(?:\s+({ALU_PRICE}))?\s*$"
)
ALU_SIZE = r"(?i)\b([0-9]{3,4})\s*mm\s*x\s*([0-9]{3,4})\s*mm\b"
ALU_CODE = r"\b([0-9]{2}\.[0-9]{2}\.[0-9]{2}\s*[A-Za-z])\b"
ALU_SKIPPED = (
    "alternativ:", "pos ", "system:", "wärmedurchgangskoeffizient", "oberflächen:", "profile:", "rahmen:", "sprosse:", "türflügel:",
    "türbeschreibung:", "bodenabschluss:", "zusatzteile pro element:", "zusatzbeschläge pro element:", "füllung:", "angebot ",
)
ALU_PREFERRED = (
    "türelement", "türelemente", "einflg. tür", "zweiflg. tür", "aufpreis", "aufzahlung", "vorbemerkungen", "info ",
)
ALU_FOOTERS = ("gerichtsstand vöcklabruck", "unsere allgemeinen verkaufs- und lieferbedingungen", "verzugszinsen verrechnet")


def _alu_prepare(text: Column) -> Column:
    quantity = r"([0-9]+(?:[.,][0-9]+)?\s+(?:Stk|Stück|LFM|lfm)\b)"
    joined = F.regexp_replace(text, rf"(?m)^(\s*\d{{3}}[A-Za-z]-\d{{3}})\d-\d{{2}}{quantity}", "$1 $2")
    return F.regexp_replace(joined, rf"(?m)^(\s*\d{{3}}-\d{{4}})-\d{{2}}\s+{quantity}", "$1 $2")


def _alu(blocks: DataFrame) -> DataFrame:
    stops = ("alternativ:", "nettowert", "bruttobetrag", "nach erhalt der rechnung", "mit freundlichen grüßen")
    rows = blocks.withColumns({
        "label": X.normalize_line(head(ALU_ROW, 4)),
        "first_price": X.blank_to_null(F.regexp_extract(head(ALU_ROW, 5), X.MONEY, 0)),
        "second_price": X.blank_to_null(F.regexp_extract(head(ALU_ROW, 6), X.MONEY, 0)),
        "body": X.trim_block(rest(X.split_lines(F.col("block"))), stops),
    })
    label = F.col("label")
    vague = (
        (label == "") | F.regexp_like(label, F.lit(rf"(?i)^{X.CURRENCY}?\s*{X.MONEY}\s*{X.CURRENCY}?$"))
        | F.regexp_like(label, F.lit(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{2}\s*[A-Za-z]$")) | (F.length(label) < 8)
    )
    own = F.filter("body", lambda line: ~(
        F.regexp_like(line, F.lit(r"(?i)^Pos\s+\d{3}[A-Za-z]?(?:-\d+)?$")) | X.starts_with_any(F.lower(line), ALU_FOOTERS)
        | F.lower(line).contains("die ware bleibt bis zur vollständigen bezahlung")
    ))
    lead = F.when(vague, F.array().cast("array<string>")).otherwise(F.array(label))
    rows = rows.withColumns({"vague": vague, "described": X.drop_repeats(F.concat(lead, own))})
    detail = r"(?i)^[0-9]+(?:[.,][0-9]+)?\s*(?:Stk\.?|Stück|LFM|lfm)\s+(.+)$"
    details = F.filter("described", lambda line: F.regexp_like(line, F.lit(detail)))
    short = F.when(~F.col("vague"), label).otherwise(F.coalesce(
        X.normalize_line(F.regexp_extract(F.get(details, F.lit(0)), detail, 1)),
        X.first_description(F.col("described"), ALU_SKIPPED, ALU_PREFERRED, normal=True), X.blank_to_null(label),
    ))
    rows = rows.withColumn("short", short)
    near = X.join_lines(F.slice("described", F.lit(1), F.lit(8)))
    code_text = X.join_lines(F.slice("described", F.lit(1), F.lit(6)))
    width = F.coalesce(X.group(label, ALU_SIZE, 1), X.group(near, ALU_SIZE, 1))
    height = F.coalesce(X.group(label, ALU_SIZE, 2), X.group(near, ALU_SIZE, 2))
    # the nearest of the last four lines that is no table head decides
    recent = F.filter(
        F.reverse(F.slice(F.reverse(X.filled_lines(F.expr("right(before, 300)"))), F.lit(1), F.lit(4))),
        lambda line: ~(F.lower(line).startswith("pos.") & F.lower(line).contains("anzahl")),
    )
    alternative = F.coalesce(F.lower(F.get(F.reverse(recent), F.lit(0))).startswith("alternativ:"), F.lit(False))
    one = F.replace(F.replace(head(ALU_ROW, 2), F.lit(".")), F.lit(","), F.lit(".")) == "1.00"
    repeats_short = F.lower(X.strip(F.get("described", F.lit(0)))) == F.lower(X.strip(F.col("short")))
    long_lines = F.when(F.coalesce(repeats_short, F.lit(False)), rest(F.col("described"))).otherwise(F.col("described"))
    return rows.select(
        "document_id", "block_no", "page_ref", head(ALU_ROW, 1).alias("position_no"),
        X.collapse(F.coalesce(X.group(label, ALU_CODE), X.group(code_text, ALU_CODE))).alias("lv_pos"), alternative.alias("is_alternative"),
        head(ALU_ROW, 2).alias("quantity_raw"), head(ALU_ROW, 3).alias("unit"), width.alias("width_raw"), height.alias("height_raw"),
        F.col("short").alias("description_short"), X.join_lines(long_lines).alias("description_long"),
        F.col("first_price").alias("unit_price_raw"),
        F.coalesce("second_price", F.when(one, F.col("first_price"))).alias("line_total_raw"),
    )


ALU_ONE = RuleSet(
    "alu_one", SUPPLIER_NAMES["alu_one"],
    lambda low: low.contains("alu-one metallbaupartner gmbh") & low.contains("angebot") & low.contains("nummer:") & low.contains("kommission:"),
    like(ALU_ROW), _alu, prepare=_alu_prepare, headings=True,
)

# --- newo: rows per page, price pair in the row or below ----------------------------------------

NEWO_HEAD = r"^(\d{3})\s+([0-9]+,[0-9]{2,4})\s+([A-Za-z]+)\s+(.+)$"
NEWO_DISCOUNT_PAIR = rf"({X.GROUPED_MONEY})\s+[0-9]{{1,2}},[0-9]{{2}}\s*%\s+({X.GROUPED_MONEY})"
NEWO_CODE_ONLY = r"(?i)^[0-9]{2}\.[0-9]{2}\.[0-9]{2}\.[A-Z]:?$"


def _pair(line: Column) -> Column:
    """Unit and total of a line, with or without a discount column between them."""
    pattern = lambda i: F.coalesce(X.group(line, NEWO_DISCOUNT_PAIR, i), X.group(line, X.TWO_AMOUNTS, i))
    return F.when(line.contains(",") & pattern(1).isNotNull(), F.struct(pattern(1).alias("unit"), pattern(2).alias("total")))


def _newo(blocks: DataFrame) -> DataFrame:
    stops = ("zwischensumme", "gesamtsumme", "angebotssumme", "lieferkondition:", "zahlungskondition:", "mit sonnigen gru")
    rows = lines_of(blocks.where("line_index is not null"), stops)
    rows = kept_with(rows, "row", F.get("lines", F.lit(0)), lambda row: F.regexp_like(row, F.lit(NEWO_HEAD)))
    own = _pair(F.col("row"))
    below = F.filter(F.transform(F.slice("lines", F.lit(2), F.lit(15)), _pair), lambda p: p.isNotNull())
    rows = rows.withColumn("own_pair", own).withColumn("pair", F.coalesce("own_pair", F.get(below, F.lit(0))))
    tail = X.strip(F.regexp_extract("row", NEWO_HEAD, 4))
    with_discount = F.regexp_like("row", F.lit(NEWO_DISCOUNT_PAIR))
    bare = F.btrim(F.when(with_discount, F.regexp_replace(tail, NEWO_DISCOUNT_PAIR, "")).otherwise(F.regexp_replace(tail, X.TWO_AMOUNTS, "")), F.lit(" :"))
    rows = rows.withColumns({"tail": F.when(F.col("own_pair").isNotNull(), bare).otherwise(tail), "full": X.join_lines(F.col("lines"))})
    clean = X.strip(F.regexp_replace(X.normalize_line(F.col("tail")), r"\s+[0-9]{1,2}\s*%\s*$", ""))
    at = F.locate("NeWo ", clean)
    title = F.when(at > 1, F.substr(clean, at)).otherwise(clean)
    rows = rows.withColumn("title", title)
    usable = F.col("title").startswith("NeWo") & ~F.col("title").endswith(":") & (F.length("title") >= 5)
    fallback = X.first_description(
        F.slice("lines", F.lit(2), F.lit(23)),
        ("elementbreite:", "modell:", "lamellentyp:", "lamellenfarbe:", "teilung:", "teilbreite", "teilh", "angebotnummer:", "angebotsnummer:"),
        ("raffstore", "insektenschutz", "schiebeplissee", "putzkasten"), normal=True,
    )
    rows = rows.withColumn("short", F.when(usable, F.col("title")).otherwise(fallback))
    is_note = F.coalesce(F.lower(X.normalize_line(F.col("short"))).startswith("diese position"), F.lit(False))
    referenced = X.group(F.col("full"), r"(?i)\bzu\s+Pos\.\s*([0-9]{2}\.[0-9]{2}\.[0-9]{2}\.[A-Z])")
    head_text = X.strip(F.regexp_replace(F.btrim(X.normalize_line(F.col("tail")), F.lit(" :")), r"(?i)^(?:[0-9]{2}\.){3}[A-Z]:\s*", ""))
    lead = F.when((head_text == "") | F.regexp_like(head_text, F.lit(NEWO_CODE_ONLY)), F.array().cast("array<string>")).otherwise(F.array(head_text))
    long_lines = X.drop_repeats(F.concat(lead, F.filter(rest(F.col("lines")), lambda line: ~F.regexp_like(line, F.lit(NEWO_CODE_ONLY)))))
    size = X.dimensions(F.col("full"), X.BOX_DIMENSION, X.ELEMENT_DIMENSION)
    return rows.select(
        "document_id", "block_no", "page_ref", F.regexp_extract("row", NEWO_HEAD, 1).alias("position_no"),
        F.coalesce(X.structure_code(F.col("tail")), X.structure_code(F.col("full"))).alias("lv_pos"),
        F.lower("full").contains("alternativ").alias("is_alternative"),
        F.regexp_extract("row", NEWO_HEAD, 2).alias("quantity_raw"), F.regexp_extract("row", NEWO_HEAD, 3).alias("unit"),
        size["width"].alias("width_raw"), size["height"].alias("height_raw"),
        F.when(is_note, "").otherwise(F.col("short")).alias("description_short"), X.blank_to_null(X.join_lines(long_lines)).alias("description_long"),
        F.col("pair")["unit"].alias("unit_price_raw"), F.col("pair")["total"].alias("line_total_raw"), referenced.alias("referenced_lv_pos"),
        (referenced.isNull() & ~is_note).alias("image_required"), block_top_ratio().alias("item_top_ratio"),
    )


NEWO = RuleSet(
    "newo", SUPPLIER_NAMES["newo"],
    lambda low: low.contains("newo-sachbearbeiter") | (low.contains("newo") & (
        low.contains("angebotsnummer:") | (low.contains("auftrag nr.") & low.contains("belegdatum:"))
    )),
    like(r"(?U)^\d{3}\s+[0-9]+,[0-9]{2,4}\s+\w+"), _newo, per_page=True, filled_only=True,
)
