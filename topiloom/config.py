"""Parameters of the topic operators, in one place; the defaults are the production values."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass(frozen=True)
class TfIdf:
    min_df: int = 2
    max_df: float = 0.9
    max_features: int = 5000
    ngrams: tuple[int, int] = (1, 2)
    stop_words: bool = True
    sublinear: bool = False


@dataclasses.dataclass(frozen=True)
class CatalogConfig:
    max_rounds: int = 3
    max_topic_share: float = 0.15
    max_binned_share: float = 0.10
    min_size: int = 30
    min_shallow: int = 15
    mixed_domains: int = 4
    spread_factor: float = 1.5
    enable_r5: bool = False
    domain_match: str = "substring"  # or "token"
    keywords: int = 10
    top_samples: int = 5
    boundary_samples: int = 3
    group_ratio: float = 0.35
    group_similarity: float = 0.55
    auto_accept_depth: int = 2
    split_neighbours: int = 15
    split_min_size: int = 5
    split_least: int = 10
    ladder: str = "code"  # or "paper"
    seed: int = 42
    root_tfidf: TfIdf = TfIdf()
    split_tfidf: TfIdf = TfIdf(min_df=1, max_df=0.95, max_features=2000)


ROOT_NEIGHBOURS = 20
ROOT_RESOLUTION = 1.0
RESOLUTIONS = (0.1, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0)
REASSIGN_THRESHOLDS = (0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85)
TINY = 5
