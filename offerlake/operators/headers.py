"""Document classification and header fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.functions.keys import position_numbers
from offerlake.functions.numbers import currency_code, eu_decimal, textual_date
from offerlake.rules.base import Registry, RuleSet
from offerlake.rules.suppliers import SUPPLIER_NAMES


def provider_key(supplier_name: Column) -> Column:
    """Rule key of a printed supplier name; unknown names are their own key."""
    name = X.comparison_text(supplier_name)
    known = None
    for key, printed in SUPPLIER_NAMES.items():
        if key == "koch_detail":
            continue
        hit = name == printed.lower()
        known = F.when(hit, key) if known is None else known.when(hit, key)
    return known.when(name == "", "generic").otherwise(name)


# --- classification -----------------------------------------------------------------------------

def _rules(registry: Registry | None) -> list[RuleSet]:
    from offerlake.rules.registry import REGISTRY

    return (registry or REGISTRY).rules


def detect_template(text: Column, registry: Registry | None = None) -> Column:
    """Key of the first rule set of ``registry`` (the package's own by default) whose predicate holds, else generic."""
    rules = _rules(registry)

    def pick(low: Column) -> Column:
        key = None
        for rule in rules:
            hit = rule.detect(low)
            key = F.when(hit, rule.key) if key is None else key.when(hit, rule.key)
        return F.lit("generic") if key is None else key.otherwise("generic")

    return X.let(F.lower(X.normalize_text(text)), pick)


# Headings that tell the document type.
ORDER_HEADS = (
    r"(?miu)^\s*auftragsbest[aä]tigung\b", r"(?mi)^\s*auftragsnummer\s*:", r"(?mi)^\s*auftrag\s+nr\.\s*[A-Za-z0-9.-]+\b",
    r"(?mi)^\s*auftrag\b(?:\s*:)?\s*[A-Za-z0-9.-]+\b",
)
OFFER_HEAD = r"(?mi)^\s*angebot(?:\s*:|\b)"


def document_type(text: Column, template: Column) -> Column:
    """Confirmation, offer or drawing: the first 80 lines of page one, then the whole text."""
    head = X.join_lines(F.slice(X.split_lines(F.get(X.split_pages(text), F.lit(0))), F.lit(1), F.lit(80)))

    def decide(top: Column) -> Column:
        order = F.lit(False)
        for pattern in ORDER_HEADS:
            order = order | F.regexp_like(top, F.lit(pattern))
        offer = F.regexp_like(top, F.lit(OFFER_HEAD)) | F.lower(top).contains("angebotsnummer")
        late_order = F.regexp_like(text, F.lit(r"(?miu)\bauftragsbest[aä]tigung\s*:"))
        return (
            F.when(template == "koch_detail", "detailzeichnung").when(order, "auftragsbestaetigung").when(offer, "angebot")
            .when(late_order, "auftragsbestaetigung").otherwise("angebot")
        )

    return X.let(head, decide)


# --- header fields ------------------------------------------------------------------------------

# Ordered patterns of the generic header fields.
NUMBER_PATTERNS = (
    r"(?mi)^\s*Angebot\s*:\s*([A-Za-z0-9.-]+)\s*$", r"(?m)^\s*Nummer:\s*([A-Za-z0-9.-]+)\s*$",
    r"(?mi)^\s*Angebotsnummer\s*:?\s*([A-Za-z0-9.-]*\d[A-Za-z0-9.-]*)\s*$", r"(?mi)^\s*Angebot:\s*([0-9]+)\s*$",
    r"(?mi)^\s*Angebot\s+([0-9]+\.[0-9]+)\s*$", r"(?mi)^\s*Angebot N[^:]*:\s*([0-9]+\.[0-9]+)\s*$",
    r"(?mi)^\s*Angebotsnummer:\s*([0-9]+)\s*$",
)
DATE_PATTERNS = (
    r"(?m)^\s*Druckdatum:\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})", r"Belegdatum:\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})",
    r"Datum\s*:\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})", r"Ried,\s+am\s+([0-9]{2}\.[0-9]{2}\.[0-9]{4})",
    r"\b([0-9]{2}\.[0-9]{2}\.[0-9]{4})\b",
)
PROJECT_PATTERNS = (
    r"Kommission:\s*([^\n]+)", r"Kommission\s*:\s*([^\n]+)", r'Bauvorhaben\s*"([^"]+)"', r"(?m)^Projekt\s+(.+)$",
)
REFERENCE_PATTERNS = (
    r"(?mi)^\s*Kommission:\s*[^\n]*?\bzu\s+([A-Za-z0-9.+/\- ]+?)\s*$", r"(?mi)^\s*Projekt:\s*[^\n]*?\bzu\s+([A-Za-z0-9.+/\- ]+?)\s*$",
    r"(?mi)\bzu\s+Angebot(?:snummer)?\s*:?\s*([A-Za-z0-9.+/\- ]+)\b", r"(?mi)\bAngebotsreferenz\s*:?\s*([A-Za-z0-9.+/\- ]+)\b",
    r"(?mi)\bReferenzangebot\s*:?\s*([A-Za-z0-9.+/\- ]+)\b", r"(?mi)\bbezugnehmend auf Angebot\s*:?\s*([A-Za-z0-9.+/\- ]+)\b",
    r"(?mi)^\s*Auftragsnummer aus moveIT:\s*([A-Za-z0-9.+/\-]+)\b",
)
CONFIRMATION_PATTERNS = (
    r"(?miu)^\s*Auftragsbest[aä]tigung(?:\s*N[°o])?\s*:\s*([A-Za-z0-9.-]+)\b", r"(?miu)^\s*Auftragsbest[aä]tigung\s+([A-Za-z0-9.-]+)\b",
)
# Further ordered patterns per supplier, (number, date, project), used where the generic field is empty.
SUPPLIER_PATTERNS = {
    "muigg": ((r"(?i)ANGEBOT\s+Nr\.\s*([0-9 .]+)", r"(?iu)AUFTRAGSBESTÄTIGUNG\s+([0-9 .]+)"),
              (r"(?i)Datum:\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})", r"(?iu)Datum:\s*([0-9]{1,2}\.\s*[A-Za-zÄÖÜäöüß]+\s*[0-9]{4})"),
              (r"(?m)^\s*(BV[^\n]+)\s*$",)),
    "newo": ((r"(?i)Angebotsnummer:\s*([A-Za-z0-9.-]+)", r"(?i)AUFTRAG\s+Nr\.\s*([A-Za-z0-9.-]+)"),
             (r"(?i)Belegdatum:\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})",), (r"(?i)Kommission:\s*([^\n]+)",)),
    "koch": ((r"Angebotsnummer:\s*([A-Za-z0-9.-]+)", r"Auftragsnummer:\s*([A-Za-z0-9.-]+)"),
             (r"Angebotsdatum:\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})", r"Auftragsdatum:\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})"), (r"Objekt:\s*([^\n]+)",)),
    "schachermayer": ((r"(?is)\b([0-9]{8,9})\b\s+[0-9]{2}\.[0-9]{2}\.[0-9]{4}\b", r"(?i)Angebots-Nr\.\s*([0-9]+)",
                       r"(?is)Auftragsnummer\s+Datum\s+Seite\s+.*?\b([0-9]{8,9})\b"), (),
                      (r"(?i)Kom\.\s*([^\n]+)", r"(?mi)^\s*Kommission:\s*([^\n]+)\s*$")),
    "schuchter": ((r"(?i)ANGEBOT\s+([A-Za-z0-9./-]+)", r"(?i)Angebotsnummer\s*:?\s*([A-Za-z0-9./-]+)",
                   r"(?iu)AUFTRAGSBESTÄTIGUNG\s+([0-9]+)", r"(?i)Auftrag\s+([0-9]+)\s+vom"),
                  (r"(?i)Angebot\s+[A-Za-z0-9./-]+\s+vom\s+([0-9]{2}\.[0-9]{2}\.[0-9]{4})", r"(?i)Datum:\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})",
                   r"(?i)vom\s+([0-9]{2}\.[0-9]{2}\.[0-9]{4})"), (r"(?i)Bauvorhaben:\s*([^\n]+)",)),
    "schlotterer": ((r"(?i)Angebot:\s*([A-Za-z0-9./-]+)", r"(?i)Angebotsnummer:\s*([A-Za-z0-9./-]+)",
                     r"(?iu)Auftragsbestätigung:\s*([0-9]+)", r"(?i)Auftragsnummer:\s*([0-9]+)"),
                    (r"(?i)Angebot:\s*[A-Za-z0-9./-]+\s+vom:?\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})", r"(?i)vom:\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})",
                     r"(?i)vom\s+([0-9]{2}\.[0-9]{2}\.[0-9]{4})"), (r"(?i)Kommission:\s*([^\n]+)",)),
}
DAY = r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"
PHONE = r"^\+?[0-9][0-9 /().-]{6,}$"
LABEL_ONLY = r"^[A-Za-zÄÖÜäöüß .()/+-]+:\s*$"
LABEL_AND_VALUE = r"^[A-Za-zÄÖÜäöüß .()/+-]+:\s*.+$"
PROJECT_STOPS = ("nummer", "druckdatum", "anfrage", "kommission", "bearbeiter", "fax", "tel", "frau ", "herr ")
PART_STOPS = ("belegdatum", "seite", "angebot", "vorgang", "bearbeiter", "kundenkontakt", "name :", "tel. :", "mail :", "sehr geehrte")


def looks_like_number(value: Column) -> Column:
    clean = X.strip(value)
    shaped = (
        F.regexp_like(clean, F.lit("^[A-Z][0-9]{7}[A-Z]{2}$")) | F.regexp_like(clean, F.lit("^[0-9]{5,}(?:[.-][0-9]+)?$"))
        | (F.regexp_like(clean, F.lit(r"^[A-Za-z0-9.-]*\d[A-Za-z0-9.-]*$")) & F.regexp_like(clean, F.lit("[A-Za-z]")))
    )
    return F.coalesce(shaped & ~clean.contains(" ") & ~X.contains_any(F.lower(clean), ("vorgang", "belegdatum", "seite")), F.lit(False))


def _names_something(value: Column, stops: tuple[str, ...]) -> Column:
    clean = X.strip(value)
    return F.coalesce(
        (clean != "") & ~clean.endswith(":") & ~F.regexp_like(clean, F.lit(DAY)) & ~F.regexp_like(clean, F.lit(PHONE))
        & ~X.starts_with_any(F.lower(clean), stops) & F.regexp_like(clean, F.lit(X.LETTER)), F.lit(False),
    )


def looks_like_project(value: Column) -> Column:
    return _names_something(value, PROJECT_STOPS)


def looks_like_project_part(value: Column) -> Column:
    return _names_something(value, PART_STOPS)


def looks_like_date(value: Column) -> Column:
    return F.coalesce(F.regexp_like(X.strip(value), F.lit(DAY)), F.lit(False))


def nearby_value(lines: Column, label: str, valid, after: int = 6, before: int = 6) -> Column:
    """Value beside a line that is only the label: first valid one below it, else above it."""
    def search(bound: Column) -> Column:
        def around(line: Column, i: Column) -> Column:
            usable = lambda probe: ~F.regexp_like(probe, F.lit(LABEL_ONLY)) & valid(probe)
            below = F.filter(F.slice(bound, i + 2, F.lit(after)), usable)
            reach = F.least(i, F.lit(before))
            above = F.filter(F.reverse(F.slice(bound, F.greatest(i - reach + 1, F.lit(1)), reach)), usable)
            return F.when(F.lower(line) == label.lower(), F.coalesce(F.get(below, F.lit(0)), F.get(above, F.lit(0))))

        return F.get(F.filter(F.transform(bound, around), lambda v: v.isNotNull()), F.lit(0))

    return X.let(lines, search)


def multiline_value(lines: Column, label: str, max_lines: int = 2, separator: str = " ") -> Column:
    """Value after a label plus up to two continuation lines."""
    pattern = rf"(?i)^{label}\s*:\s*(.*)$"

    def search(bound: Column) -> Column:
        def collect(line: Column, i: Column) -> Column:
            stops = lambda probe: (
                F.regexp_like(probe, F.lit(LABEL_ONLY)) | F.regexp_like(probe, F.lit(LABEL_AND_VALUE)) | F.regexp_like(probe, F.lit(DAY))
                | F.regexp_like(probe, F.lit(PHONE)) | (probe == "")
            )
            more = X.lines_before(F.slice(bound, i + 2, F.lit(max_lines)), stops)
            parts = F.filter(F.transform(F.concat(F.array(X.group(line, pattern)), more), X.collapse), lambda p: p != "")
            return F.when(F.regexp_like(line, F.lit(pattern)), X.blank_to_null(F.array_join(parts, separator)))

        return F.get(F.filter(F.transform(bound, collect), lambda v: v.isNotNull()), F.lit(0))

    return X.let(lines, search)


def building_site(lines: Column) -> Column:
    """Building site named on its label line, else by up to four lines below it."""
    def search(bound: Column) -> Column:
        def named(line: Column, i: Column) -> Column:
            own = X.strip(F.regexp_replace(line, "^[^:]*:", ""))
            more = X.lines_before(F.slice(bound, i + 2, F.lit(4)), lambda probe: ~looks_like_project_part(probe))
            below = X.blank_to_null(F.array_join(more, " "))
            return F.when(F.lower(line).contains("bauvorhaben:"), F.when(looks_like_project(own), own).otherwise(below))

        return F.get(F.filter(F.transform(bound, named), lambda v: v.isNotNull()), F.lit(0))

    return X.let(lines, search)


def _tidy_reference(value: Column) -> Column:
    return X.blank_to_null(F.btrim(X.collapse(value), F.lit(" \t\r\n,;:.")))


def offer_reference(text: Column, kind: Column, project: Column) -> Column:
    """Offer a confirmation refers to, from the text or else from the project name."""
    printed = F.when(kind == "auftragsbestaetigung", _tidy_reference(X.first_match(text, REFERENCE_PATTERNS)))
    named = _tidy_reference(X.group(project, r"(?i)\bzu\s+([A-Za-z0-9.+/\-]+(?:\s*\+\s*[A-Za-z0-9.+/\-]+)*)\b"))
    return F.coalesce(printed, named)


def overlay_free(value: Column) -> Column:
    """Header value without the watermark fragments of one supplier."""
    return X.blank_to_null(F.regexp_replace(X.normalize_line(value), r"(?i)\s+(?:Pla|Bit|lös)(?:\s+(?:Pla|Bit|lös))*\s*$", ""))


def document_headers(doc_text: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Template, type, number, date, project, reference and notes per document text.

    A known template is taken as it is. Rule sets of ``registry`` with hooks have the last word on their documents.
    """
    rules = _rules(registry)
    text = X.normalize_text(F.col("text"))
    template = F.col("template") if "template" in doc_text.columns else detect_template(F.col("text"), registry)
    base = doc_text.select("document_id", text.alias("text"), template.alias("template"))
    base = base.withColumns({
        "document_type": document_type(F.col("text"), F.col("template")),
        "lines": X.filled_lines(F.col("text")),
        "number0": X.collapse(X.first_match(F.col("text"), NUMBER_PATTERNS)),
        "date0": X.first_match(F.col("text"), DATE_PATTERNS),
        "project0": X.collapse(X.first_match(F.col("text"), PROJECT_PATTERNS)),
    })
    refined = _refined(base)
    fields = {c: F.col(c) for c in ("document_number", "document_date", "project_ref")}
    notes = F.lit(None).cast("string")
    for rule in rules:
        own = F.col("template") == rule.key
        if rule.refine is not None:
            better = rule.refine(fields, F.col("text"))
            fields = {c: F.when(own, better.get(c, old)).otherwise(old) for c, old in fields.items()}
        if rule.notes is not None:
            notes = F.when(own, rule.notes(F.col("text"))).otherwise(notes)
    refined = refined.withColumns(fields | {"document_notes": notes})
    return refined.select(
        "document_id", "template", "document_type", "document_number", "document_date", "project_ref", "document_notes",
        offer_reference(F.col("text"), F.col("document_type"), F.col("project_ref")).alias("offer_reference"),
        currency_code(F.col("text")).alias("currency"),
    )


def _refined(base: DataFrame) -> DataFrame:
    """Supplier-specific second looks, only evaluated for their own documents."""
    text, lines, template = F.col("text"), F.col("lines"), F.col("template")
    number, day, project = F.col("number0"), F.col("date0"), F.col("project0")
    confirmation = X.first_match(text, CONFIRMATION_PATTERNS)
    numbers, days, projects = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, (number_patterns, date_patterns, project_patterns) in SUPPLIER_PATTERNS.items():
        place = F.get(X.split_pages(text), F.lit(0)) if key == "schachermayer" else text
        numbers = F.when(template == key, X.first_match(place, number_patterns)).otherwise(numbers)
        if date_patterns:
            days = F.when(template == key, X.first_match(text, date_patterns)).otherwise(days)
        projects = F.when(template == key, X.normalize_line(X.first_match(text, project_patterns))).otherwise(projects)
    numbers = F.when(template == "muigg", X.blank_to_null(F.regexp_replace(numbers, r"\D", ""))).otherwise(X.normalize_line(numbers))
    days = F.when(template == "muigg", textual_date(days)).otherwise(X.normalize_line(days))
    number_ok, project_ok = looks_like_number(number), looks_like_project(project)
    rekord = X.first_match(text, (r"Angebot\s*:\s*([A-Z]{2,6}[0-9]{4,}(?:[A-Z]{1,3}(?![a-z]))?)", r"(?mi)^\s*Angebot\s*:\s*([A-Za-z0-9.-]+)\s*$",
                                  r"Angebot\s*:\s*([A-Za-z0-9.-]+)"))
    many = multiline_value(lines, "Kommission", separator="\n")
    many_wins = many.isNotNull() & (~project_ok | (many == project) | many.startswith(F.concat(project, F.lit("\n"))) | project.endswith("+"))
    order = X.group(text, r"(?i)\bAuftrag\s*:\s*([A-Za-z0-9.-]+)")
    title = X.group(text, r"(?im)^\s*(Visualisierung[^\n]*|Systemdetails[^\n]*|SYSTEM\s+[^\n]*)\s*$")
    building = building_site(lines)
    return base.withColumns({
        "document_number":
            F.when(template == "alu_one", F.when(number_ok, number).otherwise(nearby_value(lines, "Nummer:", looks_like_number)))
            .when(template.isin("entholzer", "rieder"), F.when(number_ok, number).otherwise(confirmation))
            .when(template == "rekord_vomp", F.when(number_ok, number).otherwise(rekord))
            .when(template == "koch_detail", F.coalesce(X.normalize_line(order), number))
            .when(template == "newo", overlay_free(F.coalesce(number, numbers)))
            .otherwise(F.coalesce(number, numbers)),
        "document_date":
            F.when(template == "alu_one", F.when(looks_like_date(day), day).otherwise(nearby_value(lines, "Druckdatum:", looks_like_date)))
            .otherwise(F.coalesce(day, days)),
        "project_ref":
            F.when(template == "alu_one", F.when(project_ok, project).otherwise(nearby_value(lines, "Kommission:", looks_like_project)))
            .when(template == "entholzer", F.when(project_ok, project).otherwise(multiline_value(lines, "Kommission")))
            .when(template == "rieder", F.when(many_wins, many).when(project_ok, project).otherwise(
                F.coalesce(many, nearby_value(lines, "Kommission:", looks_like_project, 6, 2), project)))
            .when(template == "rekord_vomp", F.when(project_ok, project).otherwise(F.coalesce(building, project)))
            .when(template == "koch_detail", F.coalesce(X.normalize_line(title), project))
            .when(template == "newo", overlay_free(F.coalesce(project, projects)))
            .otherwise(F.coalesce(project, projects)),
    })


# --- totals -------------------------------------------------------------------------------------

AMOUNT = f"({X.MONEY})"
# Printed forms of the three totals, in order, and the labels searched after them.
NET_FORMS = (rf"(?i)Gesamtbetrag\s*\(\s*Netto\s*\)\s*:\s*{AMOUNT}", rf"(?i)Gesamtbetrag netto\s*{X.CURRENCY}?\s*{AMOUNT}",
             rf"(?i)Gesamt Nettosumme\s*{X.CURRENCY}?\s*{AMOUNT}", rf"(?i)Summe Netto\s*{AMOUNT}", rf"(?i)Nettosumme\s*{AMOUNT}")
VAT_WORD = r"(?:MwSt|Mwst|Mehrwertsteuer|USt\.)"
VAT_FORMS = (rf"(?iu)zuzüglich\s*[0-9., ]*%\s*(?:MwSt|Mwst|Mehrwertsteuer|USt\.?)\s*{X.GROUPED_MONEY}\s+{AMOUNT}\s*{X.CURRENCY}",
             rf"(?iu)zuzüglich\s*[0-9., ]*%\s*{VAT_WORD}\s*{X.CURRENCY}?\s*{AMOUNT}", rf"(?i)(?:MwSt|Mehrwertsteuer|USt\.)\s*[0-9., ]*%\s*{AMOUNT}",
             rf"(?i){VAT_WORD}\s*[0-9., ]*%\s*{X.CURRENCY}?\s*[+-]?\s*{AMOUNT}")
GROSS_FORMS = (rf"(?i)Endbetrag\s*:?\s*{X.CURRENCY}?\s*{AMOUNT}", rf"(?i)Gesamtbetrag(?!\s*(?:\(\s*Netto\s*\)|netto))\s*{X.CURRENCY}?\s*{AMOUNT}",
               rf"(?i)Gesamtpreis incl\. Mwst\.\s*{X.CURRENCY}?\s*{AMOUNT}", rf"(?i)Gesamtpreis inkl\. Mwst\.\s*{X.CURRENCY}?\s*{AMOUNT}",
               rf"(?i)Summe Brutto\s*{AMOUNT}", rf"(?i)Gesamt EUR\s*{AMOUNT}", rf"(?i)Bruttobetrag\s*{AMOUNT}")
NET_LABELS = ((("gesamt nettosumme", "gesamtbetrag netto", "nettosumme"), "first"),
              (("zwischensumme ohne ust", "zwischensumme", "nettowert", "summe netto"), "last"),
              (("summe positionen", "gesamtpreis positionen", "gesamtpreis ohne mwst"), "first"))
VAT_LABELS = ("zuzüglich", "mwst", "mehrwertsteuer", "ust.", "ust")
GROSS_LABELS = ("endbetrag", "gesamtbetrag", "gesamtpreis incl. mwst", "gesamtpreis inkl. mwst", "angebotssumme", "gesamtsumme",
                "gesamt eur", "bruttobetrag", "summe brutto")


def labelled_amount(lines: Column, labels: tuple[str, ...], pick: str) -> Column:
    """Amount of the first line with a label: its own last token, else one of the next seven lines."""
    def search(bound: Column) -> Column:
        def amount(line: Column, i: Column) -> Column:
            window = F.slice(bound, i + 2, F.lit(7))
            # once tokens were seen a further labelled line ends the search
            start = F.struct(F.array().cast("array<string>").alias("tokens"), F.lit(0).alias("step"), F.lit(False).alias("done"))

            def step(state: Column, probe: Column) -> Column:
                done = state["done"] | ((state["step"] > 0) & X.contains_any(F.lower(probe), labels) & (F.size(state["tokens"]) > 0))
                return F.struct(
                    F.when(done, state["tokens"]).otherwise(F.concat(state["tokens"], X.amount_tokens(probe))).alias("tokens"),
                    (state["step"] + 1).alias("step"), done.alias("done"),
                )

            later = F.aggregate(window, start, step, lambda s: F.get(s["tokens"], F.size(s["tokens"]) - 1) if pick == "last" else F.get(s["tokens"], F.lit(0)))
            own = X.amount_tokens(line)
            return F.when(X.contains_any(F.lower(line), labels), F.coalesce(F.get(own, F.size(own) - 1), later))

        return F.get(F.filter(F.transform(bound, amount), lambda v: v.isNotNull()), F.lit(0))

    return X.let(lines, search)


def document_totals(doc_text: DataFrame) -> DataFrame:
    """Net, VAT and gross: printed form, labelled amount, then arithmetic from the other two.

    A printed VAT that is off by more than five cents gives way to gross minus net.
    """
    text = F.col("text")
    base = doc_text.select("document_id", X.normalize_text(text).alias("text")).withColumn("lines", X.normal_lines(text))
    taxable = F.filter("lines", lambda line: ~X.contains_any(F.lower(line), ("ohne mwst", "ohne ust", "ohne mehrwertsteuer")))
    net = F.coalesce(X.first_match(text, NET_FORMS), *[labelled_amount(F.col("lines"), labels, pick) for labels, pick in NET_LABELS])
    vat = F.coalesce(X.first_match(text, VAT_FORMS), labelled_amount(taxable, VAT_LABELS, "first"))
    gross = F.coalesce(X.first_match(text, GROSS_FORMS), labelled_amount(F.col("lines"), GROSS_LABELS, "last"))
    money = "decimal(14,2)"
    found = base.select("document_id", eu_decimal(net, money).alias("net"), eu_decimal(vat, money).alias("vat"), eu_decimal(gross, money).alias("gross"))
    implied = (F.col("gross") - F.col("net")).cast(money)
    off = F.col("vat").isNull() | (F.abs(F.col("vat") - implied) > F.lit("0.05").cast(money))
    return found.select(
        "document_id",
        F.coalesce("net", (F.col("gross") - F.col("vat")).cast(money)).alias("net_total"),
        F.when(implied.isNotNull() & off, implied).otherwise(F.col("vat")).alias("vat_total"),
        F.coalesce("gross", (F.col("net") + F.col("vat")).cast(money)).alias("gross_total"),
    )


# --- notes, counts, confidence, drawings --------------------------------------------------------

NOTE_START = r"(?miu)^\s*Allgemeine Ausf[üu]hrung\s*:\s*$"
NOTE_END = r"(?iu)^\s*(?:Position\s+St[üu]ck|Angebotsnummer\s*:|Gesamtpreis|Zahlungskonditionen|Mit freundlichen Gr[üu][ßs]en)\b"


def document_notes(text: Column) -> Column:
    """Lines from the notes heading up to the next known heading."""
    def cut(bound: Column) -> Column:
        start = X.first_true(F.transform(bound, lambda line: F.regexp_like(line, F.lit(NOTE_START))))
        tail = F.when(start > 0, F.slice(bound, start, F.size(bound)))
        kept = X.lines_before(tail, lambda line: F.regexp_like(line, F.lit(NOTE_END)))
        notes = F.filter(kept, lambda line: (line != "") & ~X.starts_with_any(F.lower(line), ("tel ", "uid-nr.", "angebotsnummer:")))
        return X.blank_to_null(X.join_lines(notes))

    return X.let(X.normal_lines(text), cut)


def parse_confidence(template: Column, positions: Column, has_totals: Column) -> Column:
    part = lambda hit, value: F.when(hit, F.lit(value)).otherwise("0.00").cast("decimal(5,4)")
    total = F.lit("0.60").cast("decimal(5,4)") + part(template != "generic", "0.20") + part(positions > 0, "0.10") + part(has_totals, "0.10")
    return F.least(total, F.lit("0.99").cast("decimal(5,4)")).cast("decimal(5,4)")


def generic_position_count(text: Column) -> Column:
    return F.regexp_count(X.normalize_text(text), F.lit("(?m)^Pos"))


def position_count(text: Column, template: Column, registry: Registry | None = None) -> Column:
    """Positions that a text announces: by the count of its rule set; of an unknown layout, by its position lines."""
    clean = X.normalize_text(text)
    found = F.when(template == "generic", F.regexp_count(clean, F.lit("(?m)^Pos")))
    for rule in _rules(registry):
        if rule.count is not None:
            found = found.when(template == rule.key, rule.count(clean))
    return found.otherwise(0).cast("long")


def page_details(doc_text: DataFrame) -> DataFrame:
    """Order, positions and title printed on every page of a drawing document."""
    pages = doc_text.select("document_id", F.posexplode(X.split_pages(X.normalize_text(F.col("text")))).alias("page0", "page"))
    order = X.normalize_line(X.group(F.col("page"), r"(?i)\bAuftrag\s*:\s*([A-Za-z0-9.-]+)"))
    raw = X.group(F.col("page"), r"(?i)\bPosition(?:\(en\))?\s*:\s*([0-9][0-9,\s./-]*)")
    title = X.normalize_line(X.group(F.col("page"), r"(?im)^\s*(Visualisierung[^\n]*|Systemdetails[^\n]*|SYSTEM\s+[^\n]*)\s*$"))
    rows = pages.select(
        "document_id", (F.col("page0") + 1).alias("page_ref"), order.alias("source_order_number"),
        position_numbers(raw).alias("source_position_numbers"), title.alias("source_detail_type"), raw.isNotNull().alias("_named"),
    ).where("source_order_number is not null or _named or source_detail_type is not null")
    sure = F.col("source_order_number").isNotNull() & (F.size("source_position_numbers") > 0)
    return rows.withColumn("source_mapping_confidence", F.when(sure, "high").otherwise("medium")).drop("_named")
