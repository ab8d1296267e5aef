"""Every tunable of the linkage pipeline, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    top_k: int = 10
    ngrams: tuple[int, int] = (3, 5)
    min_df: int = 5
    max_df: float = 0.02
    max_features: int = 15_000
    sim_floor: float = 0.25
    token_min_len: int = 3
    token_min_df: int = 2
    token_max_df: int = 3000
    token_min_shared: int = 2
    anchor: bool = True
    addr_tfidf: bool = False
    prune_top_k: int = 12
    prune_min_score: float = 0.40
    prune_hard_cap: int = 25
    addr_ngrams: tuple[int, int] = (2, 4)
    addr_min_df: int = 3
    addr_max_df: float = 0.10
    addr_max_features: int = 20_000
    mismatch_name: float = 0.92
    mismatch_addr: float = 0.30
    n_folds: int = 5
    hard_neg_weight: float = 2.5
    trees: int = 600
    learning_rate: float = 0.03
    max_depth: int = 5
    min_child: int = 20
    threshold_low: int = 30
    threshold_high: int = 95
    train_cap: int = 75_000
    seed: int = 42


#: Small tables have too few entities in a block for the production document-frequency bounds.
FIXTURE = Config(min_df=2, max_df=0.5, addr_min_df=2, addr_max_df=0.5)

#: The model's features in its order.
FEATURE_COLS = [
    "name_exact", "name_jw", "name_lev", "name_token_set", "name_token_sort", "suffix_match", "first_token_match", "acronym_match",
    "name_common_tokens", "name_common_ratio", "name_token_count_diff", "addr_jw", "addr_lev", "addr_tfidf_cos", "pin_match",
    "street_num_match", "country_match", "name_match_addr_mismatch", "pin_conflict", "street_num_conflict", "blend_score", "name_rank",
    "addr_rank", "candidate_count", "is_reciprocal_nn",
]
