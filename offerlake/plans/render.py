"""Orders written as supplier texts: the inputs of the round-trip queries.

Every order becomes one text in the layout of a supplier, with page heads, page
breaks, alternatives and printed totals, so that extraction must give the order
lines back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.functions.numbers import eu_format
from offerlake.plans.views import Tables


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])




def _cells() -> dict[str, Column]:
    return {
        "n": F.col("item_seq").cast("string"), "nn": F.lpad(F.col("item_seq").cast("string"), 2, "0"),
        "nnn": F.lpad(F.col("item_seq").cast("string"), 3, "0"), "q": F.col("quantity").cast("int").cast("string"),
        "unit": eu_format(F.col("unit_price")), "total": eu_format(F.col("line_total")), "code": F.concat(F.lit("K"), F.col("part_key").cast("string")),
        "alt": F.col("is_alternative"),
    }


def _if(condition: Column, text) -> Column:
    return F.when(condition, text if isinstance(text, Column) else F.lit(text)).otherwise("")


# head of page one (carries what detection looks for), head of later pages
HEADS = {
    "rieder": "www.rieder-zillertal.at\nAngebot: 20260001\nKommission: Haus am Hang",
    "muigg": "Schlosserei www.muigg.at\nANGEBOT Nr. 26 0001\nDatum: 3. März 2026\nBV Haus am Hang",
    "entholzer": "Entholzer Fenster\nAngebot: 26.0001\nKommission: Haus am Hang",
    "koch": "Koch Türen GmbH\nObjekt: Haus am Hang\nAngebotsnummer: 260001\nAngebotsdatum: 03.03.2026",
    "schachermayer": "Schachermayer GmbH\nAngebots-Nr. 26000123\nKommission: Top 7",
    "alu_one": "alu-one Metallbaupartner GmbH\nAngebot\nNummer:\n260001\nDruckdatum: 03.03.2026\nKommission:\nHaus am Hang",
    "newo": "NEWO-Sachbearbeiter: Huber\nAngebotsnummer: 26000001\nBelegdatum: 03.03.2026",
    "sr_schauraum": "SR. Schauraum GmbH\nProjekt KI-PDF-Reader\nBeschreibung Menge Betrag",
    "rekord_vomp": "Rekord Vomp GmbH\nAngebot : AB260001\nBelegdatum: 03.03.2026\nBauvorhaben: Haus am Hang",
    "schuchter": "SCHUCHTER Fenster GmbH\nANGEBOT A260001\nBauvorhaben: Haus am Hang",
    "schlotterer": "Schlotterer Sonnenschutz Systeme GmbH\nAngebot: 260001\nKommission: Haus am Hang",
}


def _block(key: str) -> Column:
    c = _cells()
    if key == "rieder":
        return _text("Position: ", c["n"], _if(c["alt"], "\nAlternativ für Pos. 1"), "\nKu.Pos.: 7\nFenster ", c["code"], " Dreh\n", c["q"],
                     " Stk\nB/H: 900 x 1200\nEP: € ", c["unit"], " GP: € ", c["total"], "\nUw 0,9")
    if key == "muigg":
        total = F.when(c["alt"], F.concat(F.lit("("), c["total"], F.lit(")"))).otherwise(c["total"])
        return _text(c["nnn"], " ", c["q"], ",00 Stk. Element ", c["code"], " 900 x 1200 ", c["unit"], " ", total, "\nLV-Pos: 01.02\nRahmen verzinkt")
    if key == "entholzer":
        return _text("Pos.: ", c["n"], "\n1750 875 Aluclip ", c["code"], "\nMenge: ", c["q"], " Stk. Element", _if(c["alt"], "\nAlternativ zur Vorposition"),
                     "\nB/H: 900 x 1200\n", c["unit"], " ", c["total"])
    if key == "koch":
        return _text(c["n"], " ", c["q"], "Stk. DIN-L 100mm 900mm 1200mm PZ Zimmertür\nObjektposition: Top 7\n1 Türblatt ", c["code"],
                     " EUR 10,00 EUR 10,00\nSumme EUR ", c["unit"], " EUR ", c["total"])
    if key == "schachermayer":
        return _text(c["nn"], " ", c["q"], ",00 ST *4711 ", c["unit"], " 1 ", c["total"], " 20\nSolido ", c["code"], "\nweiß beschichtet")
    if key == "alu_one":
        return _text(_if(c["alt"], "Alternativ:\n"), c["nnn"], " ", c["q"], " Stk Türelement ", c["code"], " ", c["unit"], " EUR ", c["total"],
                     " EUR\n900 mm x 1200 mm\nRahmen: pulverbeschichtet")
    if key == "newo":
        return _text(c["nnn"], " ", c["q"], ",00 Stk NeWo Raffstore ", c["code"], " weiß ", c["unit"], " ", c["total"], _if(c["alt"], "\nAlternativ"),
                     "\nElementbreite: 900 mm, Elementhöhe: 1200 mm")
    if key == "sr_schauraum":
        return _text(F.when(c["alt"], "OPTIONAL: Paket ").otherwise(F.concat(F.lit("MODUL "), c["n"], F.lit(" Paket "))), c["code"], "\n- mit Einschulung\n",
                     c["q"], " Stk ", c["unit"], " EUR ", c["total"], " EUR")
    if key == "rekord_vomp":
        return _text(_if(c["alt"], "Alternative:\n"), "Arch.-Pos.: F", c["code"], "\nPos. ", c["n"], " ", c["q"], " Stück\n88 2500 Kunststoff ", c["code"],
                     "\nRAM: 900 mm x 1200 mm\nGesamt ", c["q"], " Stück: ", c["total"])
    if key == "schuchter":
        prices = F.when(c["alt"], F.concat(F.lit("("), c["unit"], F.lit(") ("), c["total"], F.lit(")"))).otherwise(F.concat_ws(" ", c["unit"], c["total"]))
        return _text("Pos.\n", c["n"], " ", c["q"], " Stk EG: Bad\nFenster ", c["code"], "-flg 965 1000\nB/H: 900 x 1200\n", prices)
    if key == "schlotterer":
        return _text(c["n"], " W", c["n"], "a ", c["q"], " Raffstore ", c["code"], " ", c["unit"], " ", c["total"],
                     _if(c["alt"], "\nAlternative"), "\nBreite: 900mm\nHöhe: 1200mm\nFunkmotor 10,00")
    raise ValueError(key)


def _assembled(t: Tables, block: Column, head: DataFrame | str) -> DataFrame:
    """doc_text of every order with positions; ``head`` is a text or a frame (document_id, head)."""
    rows = t.line_items.select(
        "document_id", F.struct("item_seq", "page_ref", block.alias("block")).alias("row")
    )
    # the texts are small but costly to read: without a rule of their own, adaptive merging by size would put them
    # all into one task (session.DEFAULTS keeps small partitions apart); the grouping reuses this exchange
    spread = rows.repartition("document_id")
    listed = spread.groupBy("document_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def place(bound: Column) -> Column:
        def with_break(row: Column, i: Column) -> Column:
            turned = (i > 0) & (row["page_ref"] != F.get(bound, i - 1)["page_ref"])
            # pages without positions still count
            gap = row["page_ref"] - F.when(i > 0, F.get(bound, i - 1)["page_ref"]).otherwise(F.lit(1))
            turn = F.concat(F.repeat(F.lit("\f"), gap), F.lit("\nSeite 2 von 3\n"))
            return F.concat(F.when(turned | ((i == 0) & (gap > 0)), turn).otherwise(""), row["block"])

        return F.array_join(F.transform(bound, with_break), "\n")

    body = X.let(F.col("rows"), place)
    sums = t.order_sums.select("document_id", "net_total", "vat_total", "gross_total")
    tail = F.concat(
        F.lit("\nGesamt Nettosumme EUR "), eu_format("net_total"), F.lit("\nMwSt 20 % EUR "), eu_format("vat_total"),
        F.lit("\nAngebotssumme EUR "), eu_format("gross_total"), F.lit("\n"),
    )
    joined = listed.select("document_id", body.alias("body")).join(sums, "document_id")
    joined = joined.withColumn("head", F.lit(head)) if isinstance(head, str) else joined.join(head, "document_id")
    return joined.select("document_id", F.concat("head", F.lit("\n"), "body", tail).alias("text"))


def rendered(t: Tables, key: str) -> DataFrame:
    """doc_text of every order with positions in the layout of one supplier."""
    return _assembled(t, _block(key), HEADS[key])


# --- a mixed corpus -----------------------------------------------------------------------------

MIXED = tuple(HEADS)
#: Suppliers whose every second document is a confirmation of the offer before it.
CONFIRMING = ("muigg", "entholzer", "schuchter")
#: First lines per supplier around the document number, as offer and as confirmation.
FIRST_LINES = {
    "rieder": "www.rieder-zillertal.at\nAngebot: {0}", "muigg": "Schlosserei www.muigg.at\nANGEBOT Nr. {0}", "entholzer": "Entholzer Fenster\nAngebot: {0}",
    "koch": "Koch Türen GmbH\nObjekt: Haus\nAngebotsnummer: {0}\nAngebotsdatum: {1}", "schachermayer": "Schachermayer GmbH\nAngebots-Nr. {0}",
    "alu_one": "alu-one Metallbaupartner GmbH\nAngebot\nNummer: {0}", "newo": "NEWO-Sachbearbeiter: Huber\nAngebotsnummer: {0}",
    "sr_schauraum": "SR. Schauraum GmbH\nProjekt KI-PDF-Reader\nBeschreibung Menge Betrag\nAngebot: {0}", "rekord_vomp": "Rekord Vomp GmbH\nAngebot : {0}\nBelegdatum: {1}\nBauvorhaben: Haus",
    "schuchter": "SCHUCHTER Fenster GmbH\nANGEBOT {0}", "schlotterer": "Schlotterer Sonnenschutz Systeme GmbH\nAngebot: {0}",
}
CONFIRMED_LINES = {
    "muigg": "Schlosserei www.muigg.at\nAUFTRAGSBESTÄTIGUNG {0}", "entholzer": "Entholzer Fenster\nAuftragsbestätigung: {0}", "schuchter": "SCHUCHTER Fenster GmbH\nAUFTRAGSBESTÄTIGUNG {0}",
}


def mixed_number(document_id: Column) -> Column:
    return F.concat(F.lit("2"), F.lpad(document_id.cast("string"), 7, "0"))


def _filled(template: str, number: Column, day: Column) -> Column:
    parts = []
    for at, piece in enumerate(template.replace("{0}", "\0n\0").replace("{1}", "\0d\0").split("\0")):
        parts.append(F.lit(piece) if at % 2 == 0 else number if piece == "n" else day)
    return F.concat(*parts)


def rendered_mixed(t: Tables) -> DataFrame:
    """doc_text of every order, each in the layout of its supplier (by id), confirmations among them.

    One pass: the layout is chosen per row, so the order lines are read once for all suppliers.
    """
    turn = F.col("document_id") % len(MIXED)
    block = F.coalesce(*[F.when(turn == i, _block(key)) for i, key in enumerate(MIXED)])
    number, day = mixed_number(F.col("document_id")), F.date_format("document_date", "dd.MM.yyyy")
    confirms = (F.col("document_id") / len(MIXED)).cast("long") % 2 == 1
    lines = []
    for i, key in enumerate(MIXED):
        offer = _filled(FIRST_LINES[key], number, day)
        if key in CONFIRMING:
            before = mixed_number(F.col("document_id") - len(MIXED))
            offer = F.when(confirms, F.concat(_filled(CONFIRMED_LINES[key], number, day), F.lit("\nzu Angebot: "), before)).otherwise(offer)
        lines.append(F.when(turn == i, offer))
    head = F.concat(F.coalesce(*lines), F.lit("\nKommission: Haus "), F.col("document_id").cast("string"), F.lit("\nDatum: "), day)
    return _assembled(t, block, t.documents.select("document_id", head.alias("head")))
