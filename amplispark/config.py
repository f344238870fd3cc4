"""Settings of a PCR run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class MatchConfig:
    """max_errors: edits allowed in a primer's match. min_identity: 1 - edits / primer length must reach it."""

    max_errors: int = 2
    min_identity: float = 0.0
    search_rc: bool = False
    #: Which end of a run of equally good ends is reported: rightmost, leftmost or all (every end within max_errors).
    report: str = "rightmost"
    #: overlap: an ambiguous letter of the text matches if it may be the primer's letter; subset: if it must be.
    text_ambiguity: str = "overlap"

    def __post_init__(self) -> None:
        if self.max_errors < 0:
            raise ValueError("max_errors must not be negative")
        if self.min_identity > 1:
            raise ValueError("min_identity must be at most 1")
        if self.report not in ("rightmost", "leftmost", "all") or self.text_ambiguity not in ("overlap", "subset"):
            raise ValueError("unknown report or text_ambiguity")


@dataclass(frozen=True)
class PcrConfig:
    """What makes two matches a product. search_rc in `match` adds a pass over the reverse strand."""

    match: MatchConfig = field(default_factory=MatchConfig)
    min_len: int = 50
    max_len: int = 5000
    circular: bool = False
    trim_primers: bool = False
    max_n_fraction: float = 1.0

    def __post_init__(self) -> None:
        if not 0 <= self.max_n_fraction <= 1:
            raise ValueError("max_n_fraction must be between 0 and 1")
        if self.min_len > self.max_len:
            raise ValueError("min_len must not exceed max_len")
