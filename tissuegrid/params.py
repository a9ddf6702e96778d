"""Parameter sets with the shipped defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ForegroundParams:
    thumb_size: int = 800
    sampling_fraction: float = 0.25
    bandwidth: int = 2
    min_tissue_prob: float = 0.05
    min_foreground_ratio: float = 0.15


@dataclass(frozen=True)
class CleanParams:
    opening_kernel: int = 3
    square_fill_kernel: int = 25
    square_dilation_kernel: int = 1
    edge_margin: int = 50
    max_width_ratio: float = 0.8
    max_height_ratio: float = 0.8


@dataclass(frozen=True)
class TilingParams:
    tile_size: int = 224
    tile_overlap: float = 0.0
    patch_foreground_ratio: float = 0.25
    reference_mag: float = 20.0


@dataclass(frozen=True)
class PatchParams:
    max_dim: int = 32
    overlap: float = 0.1


@dataclass(frozen=True)
class SplitParams:
    val_split: float = 0.2
    test_split: float = 0.1
    seed: int = 42
