"""Thresholds of the engine. Fixed values where results must agree with published behaviour."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    window_hours: int = 24
    archive_days: int = 14
    reuse_hours: int = 192
    retention_hours: int = 360
    journal_days: int = 30
    shortest_text: int = 300
    accepted_above: int = 5
    same_title: float = 0.95
    same_body: float = 0.91
    similar: float = 0.90
    similar_most: int = 4
    largest_gap: int = 400
    least_share: float = 0.30
    half_life_days: float = 4.0
    age_floor: float = 0.35
    damping: float = 0.85
    lex_weight: float = 0.50
    coverage_weight: float = 0.35
    entity_weight: float = 0.15
    full_coverage: int = 12
    prominent_at: int = 3
    top: int = 100
    batch: int = 20


DEFAULT = Settings()

#: Outlets of the test tables that readers of the site may not open; a parameter, since the list is a publisher's own.
RESTRICTED = ["seget-review.invalid", "bukisk-tribune.example", "gadim-wire.invalid"]
#: Steps of the importance scale.
TIERS = (30, 50, 70, 85)
#: Words cut from either end of an entity name.
EDGE_WORDS = "a an the of on in at to for and or by with from is was as that".split()
#: Names that are page furniture.
JUNK_NAMES = (
    "whatsapp linkedin", "terms of service", "privacy policy", "cookie policy", "all rights reserved", "wikimedia commons",
    "getty images", "read more", "sdn bhd", "co ltd", "pvt ltd", "information technology", "company intelligence",
)
#: Theme codes of the filter on the test tables' own vocabulary.
THEMES = ("SCI_GRID", "TECH_ROBOTS", "TECH_GENOME", "SCI_SATELLITE", "SCI_VACCINE", "TECH_VACCINE", "TAX_SATELLITE", "ENV_WAFER", "TECH_MALWARE")
