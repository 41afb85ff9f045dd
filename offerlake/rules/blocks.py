"""Rule sets of the suppliers whose positions are text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.functions.keys import customer_position_key
from offerlake.functions.numbers import eu_decimal, eu_format
from offerlake.operators.items import block_top_ratio
from offerlake.operators.windows import per_document
from offerlake.rules.base import RuleSet
from offerlake.rules.rows import description, head, kept_with, like, lines_of, rest
from offerlake.rules.suppliers import SUPPLIER_NAMES
from offerlake.session import cut_lineage

NO_TEXTS = "array<string>"


# --- rieder: blocks after "Position: n", prices around EP/GP ------------------------------------

RIEDER_START = r"^Position:\s*(\d+)"
CUSTOMER_LINE = r"(?i)^\s*Ku\.?\s*Pos\.?\s*:\s*.*$"
INLINE_PRICE = r"(?:€\s*)?\d{1,3}(?:[ .]\d{3})*,\d{2}(?:\s*€)?|(?:€\s*)?\d+,\d{2}(?:\s*€)?"
EMBEDDED = ("alternativ:", "alternative:", "alternativ ", "alternative ")
PIECES = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(St[ueü]ck|Stk\.?|Stk)\b"
RIEDER_WORDS = ("fenster", "tuer", "türe", "fixfenster", "brandschutz", "schema", "dreh", "kipp")


def _is_embedded(line: Column) -> Column:
    return X.starts_with_any(F.lower(line), EMBEDDED)


def _rieder_long(lines: Column) -> Column:
    bare = lambda line: F.btrim(F.regexp_replace(F.regexp_replace(line, INLINE_PRICE, ""), r"\s{2,}", " "), F.lit(" .,-_\t"))
    kept = F.filter(lines, lambda line: ~F.regexp_like(line, F.lit(CUSTOMER_LINE)) & (
        _is_embedded(line) | ~F.regexp_like(line, F.lit(r"(?i)\b(?:EP|GP)\s*:"))
    ))
    cleaned = F.filter(F.transform(kept, lambda line: F.when(_is_embedded(line), line).otherwise(bare(line))), lambda line: line != "")
    # only plain lines are checked against the line before them
    return X.join_lines(X.let(cleaned, lambda bound: F.filter(
        bound, lambda line, i: (i == 0) | _is_embedded(line) | (F.lower(line) != F.lower(F.get(bound, i - 1)))
    )))


def _labelled_tokens(lines: Column) -> Column:
    """Tokens of the first line with a price label, read together with its neighbours."""
    def around(line: Column, i: Column) -> Column:
        labelled = X.contains_any(F.lower(line), ("ep:", "gp:", "alternative:"))
        window = F.slice(lines, F.greatest(i, F.lit(1)), F.when(i > 0, 3).otherwise(2))
        return F.when(labelled, X.amount_tokens(F.array_join(window, " ")))

    return F.get(F.filter(F.transform(lines, around), lambda t: F.coalesce(F.size(t) >= 2, F.lit(False))), F.lit(0))


def _rieder(blocks: DataFrame) -> DataFrame:
    body = F.regexp_replace("block", RIEDER_START, "")
    rows = lines_of(blocks.where(X.strip(body) != ""), ("summe ", "zwischensumme", "nettosumme", "angebotssumme", "gesamtsumme"), body)
    lines = F.col("lines")
    own = F.filter(lines, lambda line: ~F.regexp_like(line, F.lit(CUSTOMER_LINE)))
    opening = F.transform(F.slice(lines, F.lit(1), F.lit(3)), F.lower)
    alternative = X.let(opening, lambda low: (
        F.exists(low, lambda line: line.contains("alternativ für pos") | line.contains("ku.pos.: variante"))
        | F.get(low, F.lit(0)).startswith("alternativ")
    ))
    rows = rows.withColumns({"own": X.let(own, lambda found: F.when(F.size(found) > 0, found).otherwise(lines)), "alternative": alternative})
    before_embedded = X.let(X.lines_before(lines, _is_embedded), lambda before: F.when(F.size(before) == 0, lines).otherwise(before))
    rows = rows.withColumn("priced", F.when(F.col("alternative"), lines).otherwise(before_embedded))
    rows = rows.withColumns({"tokens": X.let(F.col("priced"), _labelled_tokens), "own_text": X.join_lines(F.col("own"))})
    labelled = F.col("tokens").isNotNull()
    # all amounts are read only where none stands at a label
    rows = rows.withColumn("all_tokens", F.when(~labelled, X.amount_tokens(X.join_lines(F.col("priced")))))
    size = X.dimensions(F.col("own_text"), X.BOX_DIMENSION, X.ELEMENT_DIMENSION)
    return rows.select(
        "document_id", "block_no", "page_ref", F.regexp_extract("block", RIEDER_START, 1).alias("position_no"),
        F.col("alternative").alias("is_alternative"), X.group(F.col("own_text"), PIECES, 1).alias("quantity_raw"),
        F.replace(X.group(F.col("own_text"), PIECES, 2), F.lit(".")).alias("unit"), size["width"].alias("width_raw"), size["height"].alias("height_raw"),
        X.first_description(F.col("own"), ("ku.pos", "ep:", "gp:", "flgnr", "summe", "zwischensumme"), RIEDER_WORDS, normal=True).alias("description_short"),
        _rieder_long(F.col("own")).alias("description_long"),
        F.when(labelled, F.get("tokens", F.lit(0))).when(F.size("all_tokens") >= 2, X.last_of(F.col("all_tokens"), 2)).otherwise(F.get("all_tokens", F.lit(0))).alias("unit_price_raw"),
        F.when(labelled, X.last_of(F.col("tokens"))).otherwise(X.last_of(F.col("all_tokens"))).alias("line_total_raw"),
    )


RIEDER = RuleSet(
    "rieder", SUPPLIER_NAMES["rieder"],
    lambda low: low.contains("rieder-zillertal.at") | low.contains("ku.pos.:")
    | (low.contains("rieder") & low.contains("angebot:") & low.contains("kommission")),
    like(RIEDER_START), _rieder, delivery=lambda texts, rows: delivery_items(texts, rows),
    count=lambda text: F.regexp_count(text, F.lit(r"(?m)^Position:\s*\d+")),
)


def delivery_items(doc_text: DataFrame, items: DataFrame) -> DataFrame:
    """One freight position per text with freight lines, 200.00 by default.

    The printed total is the first amount within two cents of the sum of the lines'
    first amounts, else that sum. Its number follows the highest numeric one.
    """
    from offerlake.operators.validate import FREIGHT_WORDS

    lines = F.filter(X.normal_lines(F.col("text")), lambda line: X.contains_any(F.lower(line), FREIGHT_WORDS))
    found = kept_with(doc_text, "lines", lines, lambda found: F.size(found) > 0).select("document_id", X.normalize_text(F.col("text")).alias("text"), "lines")
    amount = "decimal(14,2)"
    values = F.transform("lines", lambda line: F.transform(X.amount_tokens(line), lambda t: eu_decimal(t, amount)))
    found = found.withColumn("values", F.filter(values, lambda v: F.size(v) > 0))
    first_sum = F.aggregate("values", F.lit(0).cast(amount), lambda s, v: (s + F.get(v, F.lit(0))).cast(amount))
    found = found.withColumn("first_sum", first_sum)
    near = F.filter(F.flatten("values"), lambda v: F.abs(v - F.col("first_sum")) <= F.lit("0.02").cast(amount))
    printed = F.when(F.col("first_sum") > 0, F.coalesce(F.get(near, F.lit(0)), F.col("first_sum")))
    head_text = F.expr("substring_index(text, lines[0], 1)")
    numbers = items.groupBy("document_id").agg(
        F.max(F.when(F.regexp_like("position_no", F.lit("^[0-9]+$")), F.col("position_no").try_cast("int"))).alias("top"),
        F.count("*").alias("items"), F.max("block_no").alias("last_block"),
    )
    number = F.when(F.coalesce("top", F.lit(0)) > 0, F.col("top") + 1).otherwise(F.coalesce("items", F.lit(0)) + 1)
    return found.join(numbers, "document_id", "left").select(
        "document_id", (F.coalesce("last_block", F.lit(0)) + 1).alias("block_no"), number.cast("string").alias("position_no"),
        F.lit(False).alias("is_alternative"), F.lit("1").alias("quantity_raw"), F.lit("Pauschale").alias("unit"),
        F.lit("Baustellenanlieferung / Frachtkosten").alias("description_short"), X.join_lines(F.col("lines")).alias("description_long"),
        F.lit("200,00").alias("unit_price_raw"), F.lit("200,00").alias("line_total_raw"),
        (F.regexp_count(head_text, F.lit("\f")) + 1).alias("page_ref"), F.lit("delivery_block").alias("pricing_source"),
        F.lit(False).alias("image_required"), printed.alias("printed_total"),
    )


# --- entholzer: blocks after "Pos.: n" ----------------------------------------------------------

ENTHOLZER_START = r"^Pos\.:\s*(\d+)"
ENTHOLZER_PAIR = rf"({X.MONEY})\s*{X.CURRENCY}?\s+({X.MONEY})\s*{X.CURRENCY}?"


def _entholzer_clean(line: Column) -> Column:
    """Drops drawing numbers in front; lines that hold only prices become empty."""
    bare = X.strip(F.regexp_replace(F.regexp_replace(line, r"^(?:\d{3,}\s+)+", ""), r"(?i)\s*\bEP\s*:\s*GP\s*:\s*$", ""))
    remainder = lambda text: F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ENTHOLZER_PAIR, ""), r"(?i)\b(?:EP|GP)\s*:", ""), r"(?i)(?:EUR|€)", "")
    # a sign that is in no price, label or currency stays
    return X.let(bare, lambda text: F.when(F.regexp_like(text, F.lit(r"[^0-9\s.,:\-EPGURepgur€]")), text).when(F.btrim(remainder(text), F.lit(" :,-")) == "", "").otherwise(text))


def _entholzer(blocks: DataFrame) -> DataFrame:
    body = F.regexp_replace("block", ENTHOLZER_START, "")
    stops = ("summe ohne montagekosten", "zwischensumme", "nettosumme", "angebotssumme", "zahlungsbedingungen:")
    rows = lines_of(blocks.where(X.strip(body) != ""), stops, body)
    clean = F.filter(F.transform("lines", lambda line: F.when(F.lower(line) == "(symbolfoto)", "").otherwise(_entholzer_clean(line))), lambda line: line != "")
    rows = kept_with(rows, "clean", clean, lambda found: F.size(found) > 0).withColumn("full", X.join_lines(F.col("clean")))
    pairs = F.filter("lines", lambda line: line.contains(",") & F.regexp_like(line, F.lit(ENTHOLZER_PAIR)))
    # all amounts are read only where no line has a pair
    rows = rows.withColumn("pair", X.last_of(pairs)).withColumn("tokens", F.when(F.col("pair").isNull(), X.amount_tokens(X.join_lines(F.col("lines")))))
    pieces = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(Stk\.?|Stk|St[ueü]ck|LFM|lfm)\b"
    enough = F.size("tokens") >= 2
    size = X.dimensions(F.col("full"), X.BOX_DIMENSION, X.ELEMENT_DIMENSION)
    return rows.select(
        "document_id", "block_no", "page_ref", F.regexp_extract("block", ENTHOLZER_START, 1).alias("position_no"),
        X.strip(X.group(F.col("full"), r"(?i)LV-Pos:\s*([0-9A-Za-z .\-/]+)")).alias("lv_pos"),
        F.lower("full").contains("alternativ").alias("is_alternative"), X.group(F.col("full"), pieces, 1).alias("quantity_raw"),
        F.replace(X.group(F.col("full"), pieces, 2), F.lit(".")).alias("unit"), size["width"].alias("width_raw"), size["height"].alias("height_raw"),
        X.first_description(F.col("clean"), ("lv-pos:", "ep:", "gp:", "(innenansicht)", "angebot n"),
                            ("aluclip", "festverglasung", "balkont", "dreh-kipp", "kopplungselement"), normal=True).alias("description_short"),
        F.col("full").alias("description_long"),
        F.coalesce(X.group(F.col("pair"), ENTHOLZER_PAIR, 1), F.when(enough, X.last_of(F.col("tokens"), 2))).alias("unit_price_raw"),
        F.coalesce(X.group(F.col("pair"), ENTHOLZER_PAIR, 2), F.when(enough, X.last_of(F.col("tokens")))).alias("line_total_raw"),
        block_top_ratio().alias("item_top_ratio"),
    )


ENTHOLZER = RuleSet(
    "entholzer", SUPPLIER_NAMES["entholzer"], lambda low: low.contains("entholzer") | low.contains("angebot n"),
    like(ENTHOLZER_START), _entholzer, count=lambda text: F.regexp_count(text, F.lit(r"(?m)^Pos\.:")),
)

# --- rekord_vomp: re-lined text, totals per block, heading before the block ---------------------

REKORD_START = r"^Pos\.\s*([0-9]+(?:\.[0-9]+)?)\s+([0-9]+(?:[.,][0-9]+)?)\s+St[üu]ck(?:\b|(?=[A-ZÄÖÜ]))"
REKORD_TOTAL = rf"(?i)Gesamt\s+[0-9]+(?:[.,][0-9]+)?\s*(?:St[üu]ck|PA|lfm|m²)?\s*:?\s+\(?({X.MONEY})\)?"
REKORD_SIZES = (
    r"(?i)RAM:\s*([0-9.,]+)\s*mm\s*x\s*([0-9.,]+)\s*mm",
    r"(?i)RAM:\s*(?:Element)?\s*([0-9]{3,5}(?:,[0-9]+)?)(?:\s*mm)?[^0-9\n]{0,80}?x\s*([0-9]{3,5}(?:,[0-9]+)?)(?:\s*mm|[^0-9\n]{0,60}?mm)",
)
REKORD_SWAPPED = r"(?i)([0-9]{3,5}(?:,[0-9]+)?)\s+Stocklichte\s*RAM:\s*([0-9]{3,5}(?:,[0-9]+)?)"
REKORD_OPENER = r"(?i)\b(?:\d+tlg\.|kunststoff|element|fenster|balkontüre|hebeschiebetür|nebentüre|türe|serie:|beschlag:|ram:|xx-|summ-)"
REKORD_STOPS = ("summe der positionen", "summe netto", "summe brutto", "zahlbetrag", "hinweise zu unseren preisen", "bankverbindung",
                "technische hinweise", "20 jahre hersteller-garantie")
REKORD_SKIPPED = ("serie:", "beschlag:", "ram:", "element ", "entwässerung:", "rahmenbreite:", "montagebohrung:", "2xspacer", "übertrag",
                  "gesamt", "skizze", "bezeichnung", "position", "alternative:", "arch.-pos.:")
REKORD_PREFERRED = ("hebeschiebetür", "kunststoff", "fenster", "balkontüre", "nebentüre", "element", "lieferung", "umfang")
REKORD_CODE = r"^\s*([A-Z0-9]{2,}(?:-[A-Z0-9]+)+)\s{3,}(\S.*?)\s*$"


def _rekord_prepare(text: Column) -> Column:
    marker = (r"(?i)(?<!\n)(Alternative:|Arch\.-Pos\.:|Pos\.\s*[0-9]+(?:\.[0-9]+)?\s+[0-9]+(?:[.,][0-9]+)?\s+St[üu]ck|Summe der Positionen)")
    lined = F.regexp_replace(text, marker, "\n$1")
    # possessive, so that the blank never splits the digits of a quantity
    spaced = F.regexp_replace(lined, r"(Gesamt\s+[0-9]++(?:[.,][0-9]++)?+\s*(?:St[üu]ck|PA|lfm|m²)?)(?=[0-9(])", "$1 ")
    return F.regexp_replace(spaced, r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})Seite", "$1\nSeite")


def _without_diagram(line: Column) -> Column:
    """Cuts numbers of the sketch in front of the first describing word."""
    lead = rf"^[\d\s.,/]+(?={REKORD_OPENER[4:]})"
    return X.strip(F.regexp_replace(line, "(?i)" + lead, ""))


def _rekord_clean(line: Column) -> Column:
    low = F.lower(line)
    dropped = (
        F.regexp_like(line, F.lit(REKORD_START)) | X.starts_with_any(low, ("arch.-pos.:", "alternative:", "übertrag", "(zu pos"))
        | (low == "position stück menge preis") | (low.contains("skizze") & low.contains("bezeichnung")) | low.startswith("gesamt ")
        | F.regexp_like(line, F.lit(REKORD_TOTAL))
    )
    bare = F.regexp_replace(_without_diagram(line), r"^(?:[0-9]{3,}(?:[.,][0-9]+)?\s+)+", "")
    bare = F.regexp_replace(bare, rf"(?i)\s+\(?{X.CURRENCY}?\s*{X.MONEY}\s*{X.CURRENCY}?\)?$", "")
    bare = X.strip(F.regexp_replace(bare, r"(?:\s+[0-9]{3,4}){2,}$", ""))
    only_quantity = r"(?i)^[0-9]+(?:[.,][0-9]+)?\s*(?:St[üu]ck|Stk\.?|PA|lfm|m²|m)?$"
    named = lambda text: F.when(F.regexp_like(text, F.lit(only_quantity)) | ~F.regexp_like(text, F.lit(X.LETTER)), "").otherwise(text)
    return F.when(dropped, "").otherwise(X.let(bare, named))


def _rekord(blocks: DataFrame) -> DataFrame:
    recent = F.reverse(F.slice(F.reverse(X.filled_lines(F.expr("right(before, 800)"))), F.lit(1), F.lit(6)))
    rows = lines_of(blocks.withColumn("recent", recent), REKORD_STOPS)
    arch = r"(?i)Arch\.-Pos\.:\s*(.+)"
    places = F.filter("recent", lambda line: F.regexp_like(line, F.lit(arch)) & ~F.lower(line).startswith("alternative:"))
    place = X.strip(X.group(X.last_of(places), arch))
    marked = F.exists("recent", lambda line: F.lower(line).startswith("alternative:"))
    rows = rows.withColumns({"place": place, "full": X.join_lines(F.col("lines"))}).withColumn(
        "alternative", marked | F.coalesce(F.lower("place").contains("alternativ"), F.lit(False))
    )
    totals = F.regexp_extract_all("full", F.lit(REKORD_TOTAL), F.lit(1))
    clean = X.drop_repeats(F.filter(F.transform("lines", _rekord_clean), lambda line: line != ""))
    rows = rows.withColumns({"total": X.last_of(totals), "clean": clean, "quantity": F.regexp_extract("block", REKORD_START, 2)})
    money = "decimal(14,4)"
    unit = eu_format(F.bround(eu_decimal(F.col("total"), money) / F.nullif(eu_decimal(F.col("quantity"), money), F.lit(0)), 2))
    # two-column service rows: article code, wide gap, description
    raw = X.split_lines(F.col("block"))
    at = X.first_true(F.transform(raw, lambda line: F.regexp_like(line, F.lit(REKORD_CODE))))
    rows = rows.withColumns({"raw": raw, "code_at": F.when(F.col("place").isNotNull() & ~F.col("alternative"), at).otherwise(0)})
    code_line = F.get("raw", F.col("code_at") - 1)
    details = F.filter(
        F.transform(F.slice("raw", F.col("code_at") + 1, F.size("raw")), X.normalize_line),
        lambda line: (F.lower(line).startswith("(zu pos") & F.regexp_like(line, F.lit(r"\d")))
        | F.regexp_like(line, F.lit(r"(?i)^[0-9][0-9.,]*\s*(?:lfm|m²|m2|m)$")),
    )
    service = F.col("code_at") > 0
    service_text = F.concat_ws("\n", X.normalize_line(F.regexp_extract(code_line, REKORD_CODE, 2)),
                               F.when(F.size(details) > 0, F.concat(F.lit("\n"), X.join_lines(details))))
    short = X.first_description(F.col("clean"), REKORD_SKIPPED, REKORD_PREFERRED, normal=True)
    width = F.coalesce(*[X.group(F.col("full"), p, 1) for p in REKORD_SIZES], X.group(F.col("full"), REKORD_SWAPPED, 2))
    height = F.coalesce(*[X.group(F.col("full"), p, 2) for p in REKORD_SIZES], X.group(F.col("full"), REKORD_SWAPPED, 1))
    return rows.select(
        "document_id", "block_no", "page_ref", "page_end_ref", F.regexp_extract("block", REKORD_START, 1).alias("position_no"),
        F.col("place").alias("lv_pos"), F.col("alternative").alias("is_alternative"), F.col("quantity").alias("quantity_raw"),
        F.lit("Stück").alias("unit"), width.alias("width_raw"), height.alias("height_raw"),
        F.when(service, F.regexp_extract(code_line, REKORD_CODE, 1)).otherwise(F.coalesce(X.blank_to_null(_without_diagram(short)), "place")).alias("description_short"),
        F.when(service, service_text).otherwise(X.join_lines(F.col("clean"))).alias("description_long"),
        unit.alias("unit_price_raw"), F.col("total").alias("line_total_raw"), block_top_ratio().alias("item_top_ratio"),
    )


REKORD = RuleSet(
    "rekord_vomp", SUPPLIER_NAMES["rekord_vomp"],
    lambda low: low.contains("rekord vomp gmbh") & (low.contains("angebot :") | low.contains("angebot:"))
    & low.contains("belegdatum") & low.contains("bauvorhaben"),
    like(REKORD_START), _rekord, prepare=_rekord_prepare, headings=True, count=lambda text: F.regexp_count(text, F.lit("(?m)" + REKORD_START)),
)

# --- sr_schauraum: label rows per page, amount from the bottom ----------------------------------

ROOM_UNIT = r"([0-9]+(?:[.,][0-9]+)?)\s+([A-Za-zÄÖÜäöü()]+)\s+"
ROOM_PRICES = rf"({X.MONEY})\s*{X.CURRENCY}?\s+({X.MONEY})\s*{X.CURRENCY}?\s*$"
ROOM_ROW = rf"^\s*(.+?)\s+{ROOM_UNIT}{ROOM_PRICES}"
ROOM_AMOUNT = rf"^\s*{ROOM_UNIT}{ROOM_PRICES}"
ROOM_LABEL = r"(?i)^\s*(MODUL\s+\d+.*|OPTIONAL:.*)\s*$"


def _room(blocks: DataFrame) -> DataFrame:
    stops = ("zwischensumme", "gesamt eur", "datenschutz", "projektabgrenzung", "zahlungsbedingungen", "sollte im zuge der umsetzung")
    rows = lines_of(blocks.where("line_index is not null"), stops).withColumn("row", F.get("lines", F.lit(0)))
    priced = F.col("row").contains(",") & F.regexp_like("row", F.lit(ROOM_ROW))
    amounts = F.filter(rest(F.col("lines")), lambda line: line.contains(",") & F.regexp_like(line, F.lit(ROOM_AMOUNT)))
    rows = kept_with(rows, "found", F.struct(priced.alias("priced"), X.last_of(amounts).alias("amount")), lambda found: (
        found["priced"] | (F.regexp_like("row", F.lit(ROOM_LABEL)) & found["amount"].isNotNull())
    )).select("*", "found.*").drop("found")
    value = lambda i: F.when(F.col("priced"), F.regexp_extract("row", ROOM_ROW, i + 1)).otherwise(F.regexp_extract("amount", ROOM_AMOUNT, i))
    label = X.strip(F.when(F.col("priced"), F.regexp_extract("row", ROOM_ROW, 1)).otherwise(F.regexp_extract("row", ROOM_LABEL, 1)))
    rows = rows.withColumn("label", label)

    def continues(line: Column) -> Column:
        letters = F.regexp_replace(line, "[^A-Za-zÄÖÜ]", "")
        return (F.length(line) <= 40) & ~line.startswith("-") & ~line.contains(":") & (F.size(X.amount_tokens(line)) == 0) & (
            letters != "") & (letters == F.upper(letters))

    more = X.lines_before(rest(F.col("lines")), lambda line: ~continues(line))
    return rows.select(
        "document_id", "block_no", "page_ref", F.row_number().over(per_document("block_no")).cast("string").alias("position_no"),
        F.lower("label").startswith("optional:").alias("is_alternative"), value(1).alias("quantity_raw"), value(2).alias("unit"),
        F.array_join(F.concat(F.array("label"), more), " ").alias("description_short"), X.join_lines(F.col("lines")).alias("description_long"),
        value(3).alias("unit_price_raw"), value(4).alias("line_total_raw"),
    )


SR_SCHAURAUM = RuleSet(
    "sr_schauraum", SUPPLIER_NAMES["sr_schauraum"],
    lambda low: low.contains("sr. schauraum gmbh") & low.contains("projekt ki-pdf-reader") & low.contains("beschreibung")
    & low.contains("menge") & low.contains("betrag"),
    lambda line, following: X.let(X.normalize_line(line), lambda normal: (
        (normal.contains(",") & F.regexp_like(normal, F.lit(ROOM_ROW))) | F.regexp_like(normal, F.lit(ROOM_LABEL)))),
    _room, per_page=True, count=lambda text: F.regexp_count(text, F.lit(r"(?mi)^\s*(?:MODUL\s+\d+|OPTIONAL:)")),
)

# --- schuchter: "Pos." on its own line, then the row; prices from the bottom --------------------

SCHUCHTER_ROW = r"(?iu)^(\d+[A-Za-z]?)\s+(\d+(?:[,.]\d+)?)\s+(Stck|Stk\.?|PA|Pauschale|Psch)(?:\s+(.+))?$"
POINTED = r"([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})"
SCHUCHTER_PAIR = rf"\(?\s*{POINTED}\s*\)?\s*\(?\s*{POINTED}\s*\)?$"
SCHUCHTER_TOKEN = rf"\(?\s*{POINTED}\s*\)?"
SCHUCHTER_NOISE = ("übertrag:", "angebot ", "auftragsbestätigung ", "auftragsbestaetigung ", "pos. menge", "summe positionen",
                   "summe netto", "mwst", "summe brutto")


def _schuchter_pair(line: Column) -> Column:
    tokens = F.regexp_extract_all(line, F.lit(SCHUCHTER_TOKEN), F.lit(1))
    bracketed = line.contains("(") & line.contains(")")
    direct = F.regexp_like(line, F.lit(SCHUCHTER_PAIR))
    return F.when(line.contains(","), X.let(tokens, lambda found: F.when(direct | (F.size(found) >= 2), F.struct(
        F.when(direct, F.regexp_extract(line, SCHUCHTER_PAIR, 1)).otherwise(X.last_of(found, 2)).alias("unit"),
        F.when(direct, F.regexp_extract(line, SCHUCHTER_PAIR, 2)).otherwise(X.last_of(found)).alias("total"),
        bracketed.alias("alternative"),
    ))))


def without_drawing_tail(text: Column) -> Column:
    """Cuts trailing drawing numbers: runs of two or more, glued ones of six digits, one digit."""
    cut = F.regexp_replace(text, r"(?:\s+\d+(?:[.,]\d+)?){2,}\s*[.\-]*\s*$", "")
    cut = F.regexp_replace(F.regexp_replace(cut, r"\s+\d{6,}\s*[.\-]*\s*$", ""), r"\s+\d\s*[.\-]*\s*$", "")
    return F.when(cut == text, X.strip(text)).otherwise(F.coalesce(X.blank_to_null(X.strip(F.rtrim(F.regexp_replace(cut, r"[ .\-]+$", "")))), text))


def _schuchter_noise(line: Column) -> Column:
    return (
        line.isin("", ".", "-") | F.regexp_like(line, F.lit(r"(?i)^\d+[A-Za-z]?\s+\d+(?:[,.]\d+)?\s+(?:Stck\.?|Stk\.?|PA|Pauschale|Psch)$"))
        | F.regexp_like(line, F.lit(r"^[0-9.,/\sxX*+-]+$")) | F.regexp_like(line, F.lit("^[-_—=]{4,}$"))
        | X.starts_with_any(F.lower(line), SCHUCHTER_NOISE)
    )


def _schuchter_clean(line: Column) -> Column:
    pair_gone = F.regexp_replace(line, SCHUCHTER_PAIR, "")
    pair_gone = F.regexp_replace(pair_gone, rf"{SCHUCHTER_TOKEN}(?=(?:(?!{POINTED}).)*{SCHUCHTER_TOKEN}(?:(?!{POINTED}).)*$).*{SCHUCHTER_TOKEN}", " ")
    # an amount has a comma
    pair_gone = F.when(line.contains(","), pair_gone).otherwise(line)
    bare = F.btrim(F.regexp_replace(pair_gone, r"\s{2,}", " "), F.lit(" .-_\t"))
    led = X.let(bare, lambda text: X.let(F.regexp_replace(text, r"^(?:\d[\d.,:]*\s+)+", ""), lambda cut: F.when(cut != "", cut).otherwise(text)))
    boxed = F.regexp_replace(led, r"(?i)^(.*?)\s*(B/H:\s*\d+\s*x\s*\d+)[0-9.,/\sxX*+\-]*$", "$1 $2")
    return X.let(X.strip(boxed), without_drawing_tail)


def _schuchter(blocks: DataFrame) -> DataFrame:
    lines = X.lines_before(rest(X.filled_lines(F.col("block"))), lambda line: X.starts_with_any(line, ("Summe Positionen", "Summe Netto", "MwSt", "Summe Brutto")))
    rows = blocks.withColumn("lines", lines).withColumns({"row": F.get("lines", F.lit(0)), "full": X.join_lines(F.col("lines"))})
    pairs = F.filter(F.transform("lines", _schuchter_pair), lambda p: p.isNotNull())
    rows = rows.withColumns({"pair": X.last_of(pairs), "low": F.lower(X.collapse(F.col("full")))})
    tokens = X.amount_tokens(X.join_lines(F.filter("lines", lambda line: ~X.starts_with_any(F.lower(line), ("übertrag:", "summe positionen")))))
    size = r"(?i)B/H:\s*([0-9]+)\s*x\s*([0-9]+)"
    rows = rows.withColumns({
        "tokens": tokens, "room": X.normalize_line(F.coalesce(F.regexp_extract("row", SCHUCHTER_ROW, 4), F.lit(""))),
        "width": X.group(F.col("full"), size, 1), "height": X.group(F.col("full"), size, 2),
    })
    words = ("fenster", "tür", "fixteil", "fixelement", "portaltür", "schiebetür")
    named = F.filter(
        F.transform(
            F.filter(rest(F.col("lines")), lambda line: ~line.isin(".", "-") & ~X.starts_with_any(
                F.lower(line), ("b/h:", "übertrag:", "summe netto", "mwst", "summe brutto")) & ~F.regexp_like(line, F.lit(r"^[0-9 .]+$"))),
            lambda line: X.strip(F.regexp_replace(line, r"^(?:\d+(?:[.,]\d+)?\s+){1,4}", "")),
        ),
        lambda line: X.contains_any(F.lower(line), words),
    )
    short = F.coalesce(without_drawing_tail(F.get(named, F.lit(0))), F.col("room"))
    required = ~(
        F.col("low").contains("az auf pos.") | F.col("low").contains("transportkosten")
        | (F.col("width").isNull() & F.col("low").contains("bestehend aus") & (
            F.col("low").contains("kopplungselement") | F.regexp_like("low", F.lit(r"\belement\s+bestehend\s+aus\b"))))
    )
    body = F.filter(F.transform(F.filter(rest(F.col("lines")), lambda line: ~_schuchter_noise(line)), _schuchter_clean), lambda line: ~_schuchter_noise(line))
    rows = rows.withColumn("short", short)
    return rows.select(
        "document_id", "block_no", "page_ref", F.regexp_extract("row", SCHUCHTER_ROW, 1).alias("position_no"), F.col("room").alias("lv_pos"),
        F.coalesce(F.col("pair")["alternative"], F.lit(False)).alias("is_alternative"), F.regexp_extract("row", SCHUCHTER_ROW, 2).alias("quantity_raw"),
        F.regexp_extract("row", SCHUCHTER_ROW, 3).alias("unit"), F.col("width").alias("width_raw"), F.col("height").alias("height_raw"),
        F.when(F.lower("short").contains("bestehend aus"), "").otherwise(F.col("short")).alias("description_short"),
        X.join_lines(X.drop_repeats(body)).alias("description_long"),
        F.coalesce(F.col("pair")["unit"], X.last_of(F.col("tokens"), 2)).alias("unit_price_raw"),
        F.coalesce(F.col("pair")["total"], X.last_of(F.col("tokens"))).alias("line_total_raw"), required.alias("image_required"),
    )


SCHUCHTER = RuleSet(
    "schuchter", SUPPLIER_NAMES["schuchter"],
    lambda low: low.contains("schuchter fenster gmbh") & X.contains_any(low, ("auftragsbestätigung", "angebot", "angebotsnummer", "pos.")),
    lambda line, following: (line == "Pos.") & F.regexp_like(following, F.lit(SCHUCHTER_ROW)), _schuchter, filled_only=True, room_labels=True,
)

# --- schlotterer: three row shapes, components, page carry, parents of alternatives -------------

SLAT_PRICED = rf"^(\d+)\s+(.+?)\s+({X.MONEY})\s+({X.MONEY})$"
SLAT_TOTAL = rf"^(\d+)\s+(.+?)\s+({X.MONEY})$"
SLAT_BARE = r"^(\d+)\s+(.+)$"
# what stands between the number and up to two closing prices: the text of the first of the three shapes that fits
SLAT_TEXT = rf"^\d+\s+(.+?)(?:\s+{X.MONEY}\s+{X.MONEY}|\s+{X.MONEY})?$"
SLAT_BODY = r"^(?:(.+?)\s+)?(\d+)\s+([A-Za-zÄÖÜäöüß].+)$"
SLAT_STOPS = ("Gesamtpreis Positionen", "Rabatte:", "Gesamt Nettosumme", "Zwischensumme", "MwSt", "Gesamtsumme", "Zahlungskonditionen:")
SLAT_COMPONENT = rf"^(.+?)\s+({X.MONEY})$"
COMPONENTS = "array<struct<label:string,amount_raw:string>>"


def _slat_body(line: Column) -> Column:
    return X.normalize_line(X.blank_to_null(F.regexp_extract(line, SLAT_TEXT, 1)))


def is_slat_row(line: Column) -> Column:
    row = X.let(X.normalize_line(F.regexp_extract(line, SLAT_TEXT, 1)), lambda body: F.coalesce(
        F.regexp_like(body, F.lit(SLAT_BODY)) & ~F.regexp_extract(body, SLAT_BODY, 1).contains(","), F.lit(False)
    ))
    # a row begins with its number
    return F.when(F.substring(line, 1, 1).between("0", "9"), row).otherwise(False)


def _slat_noise(line: Column) -> Column:
    from offerlake.functions.export_text import is_noise

    return is_noise(line)


def slat_components(lines: Column) -> Column:
    """Label and amount of every component line of a block."""
    usable = F.filter(lines, lambda line: line.contains(",") & F.regexp_like(line, F.lit(SLAT_COMPONENT)) & ~_slat_noise(line) & ~is_slat_row(line))
    found = F.transform(usable, lambda line: F.struct(
        X.strip(F.regexp_replace(X.normalize_line(F.regexp_extract(line, SLAT_COMPONENT, 1)), r"^-\s*", "")).alias("label"),
        X.normalize_line(F.regexp_extract(line, SLAT_COMPONENT, 2)).alias("amount_raw"),
    ))
    return F.filter(found, lambda c: F.regexp_like(c["label"], F.lit(X.LETTER)))


def _slat_description(lines: Column) -> Column:
    """Describing lines up to the price breakdown."""
    body = F.filter(lines, lambda line: ~_slat_noise(line) & ~is_slat_row(line))
    body = X.lines_before(body, lambda line: F.lower(line).startswith("grundpreis:"))
    bare = F.transform(body, lambda line: X.normalize_line(F.regexp_replace(line, r"(?i)^Alternative\s*", "")))
    keep = lambda line: (line != "") & (line != "-") & ~(line.startswith("-") & F.regexp_like(line, F.lit(rf"(?:^|\s)(?:EUR\s*)?{X.MONEY}\s*$")))
    return X.join_lines(X.drop_repeats(F.filter(bare, keep)))


def _slats(blocks: DataFrame) -> DataFrame:
    """A page head belongs to the last position before it: its components always, its text only if that has none."""
    open_lines = X.lines_before(X.filled_lines(F.col("block")), lambda line: X.starts_with_any(line, SLAT_STOPS))
    rows = blocks.withColumn("lines", open_lines).withColumns({
        "row": F.get("lines", F.lit(0)), "own_lines": rest(F.col("lines")), "heads": F.transform("carried", X.filled_lines),
    })
    texts = F.transform("heads", _slat_description)
    rows = rows.withColumns({
        "components": F.concat(slat_components(F.col("own_lines")), F.flatten(F.transform("heads", slat_components))),
        "described": F.coalesce(X.blank_to_null(_slat_description(F.col("own_lines"))), F.get(F.filter(texts, lambda text: text != ""), F.lit(0))),
    })
    rows = rows.withColumns({"body": _slat_body(F.col("row")), "full": X.join_lines(F.col("lines"))})
    rows = rows.withColumn("tokens", X.amount_tokens(F.col("full")))
    unit = F.coalesce(X.group(F.col("row"), SLAT_PRICED, 3), X.group(F.col("row"), SLAT_TOTAL, 3))
    total = F.coalesce(X.group(F.col("row"), SLAT_PRICED, 4), X.group(F.col("row"), SLAT_TOTAL, 3))
    enough = F.size("tokens") >= 2
    both_texts = F.concat_ws("\n", "full", "described")
    width = X.first_match(both_texts, (r"(?i)Breite(?: Panzer)?:\s*([0-9]+)mm",))
    height = X.first_match(both_texts, (r"(?i)Höhe(?: Panzer)?:\s*([0-9]+)mm",))
    return rows.select(
        "document_id", "block_no", "page_ref", F.regexp_extract("row", SLAT_BARE, 1).alias("position_no"),
        X.blank_to_null(X.normalize_line(F.regexp_extract("body", SLAT_BODY, 1))).alias("lv_pos"),
        F.exists(rest(F.col("lines")), lambda line: F.lower(line).startswith("alternative")).alias("is_alternative"),
        F.regexp_extract("body", SLAT_BODY, 2).alias("quantity_raw"), F.lit("Stk").alias("unit"), width.alias("width_raw"), height.alias("height_raw"),
        X.normalize_line(F.regexp_extract("body", SLAT_BODY, 3)).alias("description_short"), F.coalesce("described", F.lit("")).alias("description_long"),
        F.coalesce(X.normalize_line(unit), F.when(enough, X.last_of(F.col("tokens"), 2))).alias("unit_price_raw"),
        F.coalesce(X.normalize_line(total), F.when(enough, X.last_of(F.col("tokens")))).alias("line_total_raw"),
        F.lit(False).alias("image_required"), F.lit(False).alias("image_auto_match_allowed"), F.lit(True).alias("sequential_alternative"), "components",
    )


#: Keys up to this length may differ in two places, longer ones in one.
SHORT_KEY = 6


def slip_marks(key: Column) -> Column:
    """(mark, role) of a key: two different keys that a typing slip parts share a mark with fitting roles, no others do.

    A slip is another sign in one place (in two of a short key; role 0 on both sides), or one sign more or less:
    the longer key has the shorter one among itself without a sign (roles 1 and 2).
    """
    size = F.length(key)
    places = F.sequence(F.lit(1), size)
    without = lambda text, i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, F.length(text)))
    name = lambda *parts: F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    mark = lambda text, role: F.struct(text.alias("mark"), F.lit(role).alias("role"))
    one = F.transform(places, lambda i: mark(name("s", size.cast("string"), i.cast("string"), without(key, i)), 0))
    two = F.flatten(F.transform(F.filter(places, lambda j: j > 1), lambda j: F.transform(
        F.sequence(F.lit(1), j - 1), lambda i: mark(name("p", size.cast("string"), i.cast("string"), j.cast("string"), without(without(key, j), i)), 0))))
    shorter = F.transform(places, lambda i: mark(name("d", without(key, i)), 1))
    same = F.when(size > SHORT_KEY, one).when(size <= 2, F.array(mark(name("l", size.cast("string")), 0))).otherwise(two)
    return F.when(size > 0, F.array_distinct(F.concat(same, shorter, F.array(mark(name("d", key), 2)))))


def near_keys(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(document_id, key, target) where exactly one known key of the document is a slip away; both hold distinct (document_id, key).

    An equality join over marks, whose number grows with the keys and their length.
    """
    left = wanted.select("document_id", "key", F.inline(slip_marks(F.col("key"))))
    right = known.select("document_id", F.col("key").alias("other"), F.inline(slip_marks(F.col("key"))).alias("mark", "other_role"))
    pairs = left.join(right, ["document_id", "mark"]).where((F.col("role") + F.col("other_role") == 3) | ((F.col("role") == 0) & (F.col("other_role") == 0)))
    return pairs.groupBy("document_id", "key").agg(F.min("other").alias("target"), F.max("other").alias("_last")).where("target = _last").drop("_last")


def pair_alternatives(rows: DataFrame) -> DataFrame:
    """k-th alternative of a customer position to the k-th main of the same or the one near position.

    Keys and numbers alone are paired, by joins on equality; the texts meet their parent at the end. The rows are
    written first, as they are read several times and reading them out of the texts is the dear part.
    """
    rows = cut_lineage(rows)
    keyed = rows.select("document_id", "block_no", "is_alternative", "position_no", customer_position_key(F.col("lv_pos")).alias("key")).where("key <> ''")
    of_key = Window.partitionBy("document_id", "key").orderBy("block_no")
    mains = keyed.where(~F.col("is_alternative")).withColumn("place", F.row_number().over(of_key)).select(
        "document_id", F.col("key").alias("target"), "place", X.clean_optional(F.col("position_no")).alias("parent"))
    known = mains.select("document_id", F.col("target").alias("key")).distinct()
    alternatives = keyed.where("is_alternative").select("document_id", "block_no", "key")
    same = alternatives.join(known, ["document_id", "key"], "left_semi").withColumn("target", F.col("key"))
    odd = alternatives.join(known, ["document_id", "key"], "left_anti")
    near = odd.join(near_keys(odd.select("document_id", "key").distinct(), known), ["document_id", "key"])
    placed = same.unionByName(near).withColumn("place", F.row_number().over(Window.partitionBy("document_id", "target").orderBy("block_no")))
    parents = placed.join(mains, ["document_id", "target", "place"]).select("document_id", "block_no", "parent")
    joined = rows.join(parents, ["document_id", "block_no"], "left")
    return joined.withColumn("alternative_parent_position_no", F.coalesce("parent", "alternative_parent_position_no")).select(*rows.columns)


SCHLOTTERER = RuleSet(
    "schlotterer", SUPPLIER_NAMES["schlotterer"],
    lambda low: low.contains("schlotterer sonnenschutz systeme gmbh") & X.contains_any(
        low, ("auftragsbestätigung:", "angebot:", "angebotsnummer", "gesamt nettosumme")),
    lambda line, following: is_slat_row(line), _slats, per_page=True, carry=True, filled_only=True, after=pair_alternatives, pricing="groups",
)
