"""The frozen evaluation protocol."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Protocol:
    # fixed values of the evaluation protocol, but for the seed
    dev_quantile: float = 0.8
    final_quantile: float = 0.9
    ks: tuple[int, ...] = (5, 10, 20, 50)
    seed: int = 20260813
    min_df: int = 2
    fusion_weights: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)
    gate_shares: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
    negatives: int = 5
    calibration_below: int = 26
    # published late-fusion weights: text, visual, product
    learned: tuple[float, float, float] = field(default=(0.77085, 0.21695, 0.01219))
    near_duplicate: float = 0.8
    # a confident miss has its best rank beyond this
    miss_beyond: int = 50


PROTOCOL = Protocol()
