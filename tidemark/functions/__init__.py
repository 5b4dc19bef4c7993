"""Column expressions (JVM-side, codegen friendly)."""

from tidemark.functions.hashing import hash_key, uniform, hash_order
from tidemark.functions.vectors import (
    dot, sq_norm, l2_normalize, l2_distance, sq_l2_distance, cosine_distance,
    half_cosine_distance, hamming_fraction,
)
from tidemark.functions.scalars import (
    kernel_weight, dependence_weight, sample_size, chained_fraction, n_clean,
    pvalue_stars, logit, logistic, erf, normal_cdf, pair_from_index, pair_to_index,
)

__all__ = [
    "hash_key", "uniform", "hash_order", "dot", "sq_norm", "l2_normalize",
    "l2_distance", "sq_l2_distance", "cosine_distance", "half_cosine_distance",
    "hamming_fraction", "kernel_weight", "dependence_weight", "sample_size",
    "chained_fraction", "n_clean", "pvalue_stars", "logit", "logistic", "erf",
    "normal_cdf", "pair_from_index", "pair_to_index",
]
