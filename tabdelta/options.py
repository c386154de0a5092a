"""Options of comparisons, checks and merges."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CompareOptions:
    """How values are held equal, and overrides of what is inferred."""

    ignore_case: bool = False
    ignore_spaces: bool = False
    numeric_tolerance: float = 0.01
    text_dates_equal: bool = True
    date_order: str = "DMY"  # or MDY; YMD reads day first
    compare_number_formats: bool = False
    date1904: bool = False
    keys: dict[str, list[str]] = field(default_factory=dict)
    sheet_pairs: list[tuple[str, str]] = field(default_factory=list)
    header_row: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class CheckOptions:
    """``india_pack`` adds the checks of GSTIN and PAN numbers."""

    india_pack: bool = True
