"""The supplier rule sets in order of detection. The order is part of the rules."""

from __future__ import annotations

from offerlake.rules import blocks, rows
from offerlake.rules.base import Registry

REGISTRY = Registry([
    rows.ALU_ONE, blocks.SR_SCHAURAUM, blocks.REKORD, rows.NEWO, rows.MUIGG, blocks.ENTHOLZER, rows.KOCH, rows.KOCH_DETAIL,
    rows.SCHACHERMAYER, blocks.RIEDER, blocks.SCHUCHTER, blocks.SCHLOTTERER,
])
