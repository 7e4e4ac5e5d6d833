"""Parameters of an analysis run, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Params:
    """All thresholds and weights. Scores are held in tenths, so every sum is an exact integer."""

    # The limits and weights the results depend on.
    max_urls: int = 0  # 0 = all
    min_content_chars: int = 100
    min_main_chars: int = 200
    max_keywords: int = 50
    min_word_length: int = 3
    bigram_min_freq: int = 2
    trigram_min_freq: int = 2
    base_tenths: int = 10
    length_tenths: int = 3
    length_cap_tenths: int = 30
    early_position: int = 150
    early_tenths: int = 30
    intro_position: int = 50
    intro_tenths: int = 50
    noun_tenths: int = 80
    bigram_tenths: int = 60
    trigram_tenths: int = 90
    common_ratio: float = 0.5
    common_floor: int = 2
    prompt_keywords: int = 30
    gap_items: int = 15
    # A prompt shows at most this many pages; a larger group gets several prompts, and no page is lost.
    pages_per_prompt: int = 1_000
    # The pages of a prompt have at most this many characters, unless one page alone has more; None: no limit.
    prompt_chars: int | None = None

    # Physical choices: they steer the plan and never change a result.
    # Larger pages are cut into chunks and scored as rows; None scores all pages in their row.
    in_row_max_chars: int | None = 4_000_000
    chunk_chars: int = 1_000_000

    def __post_init__(self) -> None:
        if self.max_urls < 0:
            raise ValueError("max_urls must be 0 (all) or positive")
        if not 0 < self.common_ratio <= 1:
            raise ValueError("common_ratio must lie in (0, 1]")
        for name in ("max_keywords", "bigram_min_freq", "trigram_min_freq", "pages_per_prompt", "chunk_chars"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

        if self.prompt_chars is not None and self.prompt_chars < 1:
            raise ValueError("prompt_chars must be at least 1, or None")

    @property
    def ratio(self) -> Decimal:
        """The common ratio as an exact decimal, so that ceil() never sees a binary fraction."""
        return Decimal(str(self.common_ratio))


DEFAULT_PARAMS = Params()
