"""Thresholds and coefficients of the valuation, in one place; every operator takes them from here."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

# The method's published coefficients and thresholds.
CONDITION = {"a_estrenar": 1.15, "excelente": 1.08, "muy_bueno": 1.00, "bueno": 0.94, "a_refaccionar": 0.82}
AGE_YEARS = [(5, 1.06), (15, 1.00), (30, 0.96), (50, 0.92), (999, 0.90)]
ORIENTATION = {"frente": 1.03, "lateral": 1.00, "contrafrente": 0.98, "interno": 0.93}
LISTING_AGE = [(90, 1.00), (999, 0.97)]
AMENITIES = ["gimnasio", "pileta", "seguridad", "sum"]
WEIGHTS = {"count": 0.35, "dispersion": 0.30, "freshness": 0.15, "relaxation": 0.10, "completeness": 0.10}
#: (surface share, days, scope, rooms delta, full detail only), each step relaxing the one before.
RUNGS = [(0.30, 120, "near", 1, True), (0.40, 120, "near", 1, True), (0.40, 180, "near", 1, True), (0.40, 180, "wide", 1, True), (0.40, 180, "wide", 2, False)]


@dataclass(frozen=True)
class Config:
    version: str = "1"
    condition: dict = field(default_factory=lambda: dict(CONDITION))
    orientation: dict = field(default_factory=lambda: dict(ORIENTATION))
    age_years: tuple = tuple(AGE_YEARS)
    listing_age: tuple = tuple(LISTING_AGE)
    high_floor: int = 3
    no_elevator: float = 0.88
    view_floor: int = 8
    view: float = 1.04
    full_amenities: float = 1.05
    parking: float = 12000.0
    least_adjustment: float = 0.75
    most_adjustment: float = 1.25
    closing: tuple = (0.85, 0.95)
    trim: float = 0.05
    winsor: tuple = (0.10, 0.90)
    band: tuple = (0.25, 0.75)
    least_width: float = 0.08
    half_width: float = 0.20
    unit_price: tuple = (300.0, 12000.0)
    surface: tuple = (15.0, 2000.0)
    most_days: int = 180
    least_comparables: int = 5
    trim_from: int = 8
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    high: float = 0.75
    medium: float = 0.50

    def method_version(self) -> str:
        """The version with twelve digits of the settings' SHA-256."""
        return f"{self.version}+{hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]}"


DEFAULT = Config()
