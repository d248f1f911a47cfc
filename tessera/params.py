"""Parameters of the clustering pipeline and of its stages."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from enum import IntEnum

log = logging.getLogger("tessera")


class Verbosity(IntEnum):
    QUIET = 0
    NORMAL = 1
    DETAILED = 2

    @property
    def normal(self) -> bool:
        return self >= Verbosity.NORMAL

    @property
    def detailed(self) -> bool:
        return self >= Verbosity.DETAILED


def parse_verbosity(level: int) -> Verbosity:
    """0 quiet, 1 normal, 2 detailed; any other number is quiet."""
    return Verbosity(level) if level in (1, 2) else Verbosity.QUIET


@dataclass(frozen=True)
class NearestNeighbourParams:
    """Settings of all search methods; each method reads its own."""

    metric: str = "euclidean"
    n_tree: int = 50
    search_budget: int | None = None
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 100
    diversify_prob: float = 0.0
    delta: float = 0.001
    ef_budget: int | None = None
    bt_budget: float = 0.1
    n_list: int | None = None
    n_probes: int | None = None
    #: approximate methods raise what is not given until a sample of the rows finds this share of its neighbours; 0: never
    least_recall: float = 0.9
    # settings of the accelerator variants, which run on the same Spark operators
    k: int | None = None
    k_build: int | None = None
    rho: float | None = None
    beam_width: int | None = None
    max_beam_iters: int | None = None
    n_entry_points: int | None = None

    def filled(self, n_neighbours: int) -> NearestNeighbourParams:
        """k and k_build as the accelerator variants default them; the beam follows from both."""
        k = self.k or n_neighbours
        k_build = self.k_build or 2 * k
        beam = self.beam_width or 2 * max(k + 1, k_build, 16)
        return replace(self, k=k, k_build=k_build, beam_width=beam, max_beam_iters=self.max_beam_iters or 3 * beam)


@dataclass(frozen=True)
class EmbeddingParams:
    """Settings of the node layout and of its initialisation."""

    n_label_prop_iter: int = 20
    base_init_threshold: int = 64
    scaling: float = 0.1
    n_epochs: int = 50
    noise_level: float = 0.5
    negative_sample_rate: float = 1.0
    initial_alpha: float = 0.1
    beta1: float = 0.5
    beta2: float = 0.9
    eps: float = 1e-7


@dataclass(frozen=True)
class ClusterParams:
    """Settings of the whole pipeline."""

    n_neighbours: int = 15
    noise_level: float = 0.5
    n_epochs: int = 50
    embedding_dim: int | None = None
    neighbour_scale: float = 1.0
    symmetrise: bool = True
    min_samples: int = 5
    base_min_cluster_size: int = 5
    approx_n_clusters: int | None = None
    min_similarity_threshold: float = 0.2
    max_layers: int = 10

    @property
    def dim(self) -> int:
        """Dimensions of the layout: a quarter of the neighbours, 4 to 16, unless given."""
        return self.embedding_dim or min(max(self.n_neighbours // 4, 4), 16)

    @property
    def effective_k(self) -> int:
        return int(self.neighbour_scale * self.n_neighbours)


#: Names of search methods and what each runs.
METHODS = ("kmknn", "exhaustive", "ivf", "annoy", "hnsw", "nndescent", "balltree")
DEFAULT_METHOD, DEFAULT_GPU_METHOD = "kmknn", "ivf"
GPU_METHODS = ("exhaustive", "ivf", "nndescent")


def parse_method(name: str) -> str | None:
    """The search method of a name in any case, or None."""
    return name.lower() if name.lower() in METHODS else None


def parse_gpu_method(name: str) -> str | None:
    """The method that an accelerator name stands for, with or without its suffix, or None."""
    plain = name.lower().removesuffix("_gpu")
    return plain if plain in GPU_METHODS else None


def resolve_method(name: str) -> str:
    """The method to run; an unknown name warns and falls back to the default of its family."""
    found = parse_gpu_method(name) if name.lower().endswith("_gpu") else parse_method(name)
    if found is None:
        found = DEFAULT_GPU_METHOD if name.lower().endswith("_gpu") else DEFAULT_METHOD
        log.warning("unknown search method %r, using %s", name, found)
    return found
