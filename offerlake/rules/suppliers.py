"""The supplier dimension: key, printed name, order of detection. Fixed values."""

from __future__ import annotations

SUPPLIER_NAMES = {
    "alu_one": "alu-one Metallbaupartner GmbH",
    "sr_schauraum": "Lupre AI Solutions",
    "rekord_vomp": "Rekord Vomp GmbH",
    "newo": "NeWo",
    "muigg": "Muigg",
    "entholzer": "Entholzer",
    "koch": "Koch Türen GmbH",
    "koch_detail": "Koch Türen GmbH",
    "schachermayer": "Schachermayer GmbH",
    "rieder": "Rieder",
    "schuchter": "SCHUCHTER Fenster GmbH",
    "schlotterer": "Schlotterer Sonnenschutz Systeme GmbH",
}

# Customer-system supplier ids by name spelling, in lookup order.
SUPPLIER_IDS = (
    ("rieder", "300774"),
    ("rieder gmbh co kg fenster turen", "300774"),
    ("newo", "300877"),
    ("newo sonnen insektenschutz gmbh", "300877"),
    ("entholzer", "301370"),
    ("entholzer fenster und turen ges m b h", "301370"),
    ("schachermayer", "300492"),
    ("schachermayer gmbh beschlage befestigungstechnik", "300492"),
    ("rekord vomp", "300798"),
    ("rekord vomp gmbh kunststoff fenster u turen", "300798"),
    ("schlotterer", "301347"),
    ("schlotterer sonnenschutz systeme gmbh", "301347"),
    ("schuchter", "301595"),
    ("schuchter fenster gmbh fenster turen sonnenschutz", "301595"),
    ("koch", "300735"),
    ("koch turen gmbh", "300735"),
    ("koch johann tischlerei", "300735"),
    ("muigg", "300929"),
    ("muigg schlosserei metallbau gmbh schlosserei metallbau gmbh", "300929"),
    ("alu one", "301418"),
    ("alu one metallbaupartner gmbh", "301418"),
    ("aluone metallbaupartner gmbh", "301418"),
)

# Suppliers whose documents carry percent conditions for all positions.
CHAIN_SUPPLIERS = ("rieder", "entholzer", "rekord_vomp", "koch", "schuchter")
