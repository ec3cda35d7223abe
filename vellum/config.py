"""Policy constants of the engine; fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Repetition:
    min_chars: int = 80
    min_tokens: int = 8
    min_blocks: int = 20
    min_excess: int = 8
    min_ppm: int = 300_000
    shingle_tokens: int = 12
    shingle_chars: int = 48


@dataclass(frozen=True)
class Baseline:
    min_words: int = 40
    min_units: int = 3
    min_bytes: int = 200
    relative_percent: int = 60
    quarantine_percent: int = 35


@dataclass(frozen=True)
class Alignment:
    window: int = 48
    max_exact: int = 8
    rare_votes: int = 64
    rare_frequency: int = 8
    max_chars: int = 20_000
    bonus: int = 35_000
    ambiguity: float = 3.0


REPETITION, BASELINE, ALIGNMENT = Repetition(), Baseline(), Alignment()
#: Similarity floors by unit type.
FLOORS = {"heading": 62, "table": 38, "table_cell": 45, "fenced_block": 65, "equation": 38, "figure_caption": 48, "reference": 45, "list": 45, "paragraph": 42}
#: Tie-break of sources, best first.
SOURCE_RANK = {"grobid": 3, "docling": 2, "marker": 1}
#: Limits of a selection batch.
BATCH_REGIONS, BATCH_CANDIDATES, BATCH_BYTES = 8, 128, 131_072
#: USD per million tokens by model: input, output, cached input.
PRICES = {"large": (5.0, 30.0, 0.5), "medium": (2.5, 15.0, 0.25), "small": (1.0, 6.0, 0.1)}
COST_ALERT = 2.0
TERMINAL = ("succeeded", "failed", "cancelled")
#: Event types of the sample event table as run states.
EVENT_STATUS = {"signup": "queued", "view": "running", "click": "progress", "purchase": "succeeded", "error": "failed"}
