"""Frozen option records; every one checks itself on creation."""

from __future__ import annotations

from dataclasses import dataclass


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class ChunkOptions:
    size: int = 512
    overlap: int = 50
    oversized_factor: float = 1.5

    def __post_init__(self) -> None:
        _require(self.size > 0, "size must be positive")
        _require(0 <= self.overlap < self.size, "overlap must be in [0, size)")
        _require(self.oversized_factor >= 1.0, "oversized_factor must be at least 1")

    @property
    def max_tokens(self) -> int:
        """Chunks above this many tokens are split again."""
        return int(self.size * self.oversized_factor)


@dataclass(frozen=True)
class FusionOptions:
    alpha: float = 0.5
    rrf_k: int = 60
    top_k: int = 10

    def __post_init__(self) -> None:
        _require(0.0 <= self.alpha <= 1.0, "alpha must be in [0, 1]")
        _require(self.rrf_k > 0 and self.top_k > 0, "rrf_k and top_k must be positive")


@dataclass(frozen=True)
class Bm25Options:
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self) -> None:
        _require(self.k1 >= 0 and 0 <= self.b <= 1, "k1 >= 0 and b in [0, 1]")


@dataclass(frozen=True)
class CorrectiveOptions:
    relevance_threshold: float = 0.5
    rewrite: bool = True
    max_document_chars: int = 2000
    min_rewrite_chars: int = 5

    def __post_init__(self) -> None:
        _require(0.0 <= self.relevance_threshold <= 1.0, "relevance_threshold must be in [0, 1]")
        _require(self.max_document_chars > 0, "max_document_chars must be positive")


@dataclass(frozen=True)
class PrefilterOptions:
    threshold: float = 0.65
    substring_base: float = 1.5
    min_fuzzy_length: int = 4
    window_slack: int = 5
    single_overlap_damping: float = 0.7
    boost_factor: float = 1.5

    def __post_init__(self) -> None:
        _require(0.0 <= self.threshold <= 1.0, "threshold must be in [0, 1]")


@dataclass(frozen=True)
class RouterOptions:
    enabled: bool = True
    sql_enabled: bool = True
    default_source: str = "unstructured"
    keyword_threshold: float = 0.8
    confidence_threshold: float = 0.7
    structured_keywords: tuple[str, ...] = ()
    unstructured_keywords: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _require(
            self.default_source in ("unstructured", "structured", "hybrid"),
            "default_source must be unstructured, structured or hybrid",
        )
        _require(0.0 <= self.keyword_threshold <= 1.0, "keyword_threshold must be in [0, 1]")
        _require(0.0 <= self.confidence_threshold <= 1.0, "confidence_threshold must be in [0, 1]")


@dataclass(frozen=True)
class ContextOptions:
    max_chars: int = 6000
    database_share: float = 0.6
    margin: int = 20
    min_document_room: int = 200
    min_other_room: int = 100
    separator: str = "\n\n"

    def __post_init__(self) -> None:
        _require(self.max_chars > 0, "max_chars must be positive")
        _require(0.0 < self.database_share <= 1.0, "database_share must be in (0, 1]")
