"""Collection settings: defaults, dotted overrides, YAML-like scalars."""

from __future__ import annotations

import copy
import json
import math
import warnings
from typing import Any

from nearfield.errors import InvalidArgument

METRICS = ("l2", "cosine")
INDEXES = ("flat", "hnsw", "hnsw_pq")

#: The names and defaults that clients of this kind of engine send.
DEFAULTS: dict[str, Any] = {
    "metric": "l2",
    "index": "hnsw",
    "initial_capacity": 1024,
    "hnsw": {"M": 16, "ef_construction": 200, "ef_search": 64, "max_level": 12, "seed": 42, "serial_warmup": 1024, "batch_fraction": 0.02, "max_batch": 8192},
    "pq": {"m": 16, "ksub": 256, "train_size": 65536, "kmeans_iters": 20, "seed": 42, "rerank_factor": 2, "rerank_max": 3000, "device": "cpu"},
    "planner": {"brute_force_max_selectivity": 0.02, "post_filter_min_selectivity": 0.1, "post_filter_max_ef": 1024, "mask_cache_size": 64, "exact_selectivity_below": 50000, "stats_refresh_fraction": 0.1},
    "early_stop": {"model": None, "multiplier": 1.0},
    "durability": {"fsync": True, "snapshot_every": 200000},
}

#: Accepted so that clients need no change, but without effect: there is no graph to build and nothing to allocate.
IGNORED = ("initial_capacity", "hnsw.M", "hnsw.ef_construction", "hnsw.max_level", "hnsw.serial_warmup", "hnsw.batch_fraction", "hnsw.max_batch")


def value_at(config: dict, name: str) -> Any:
    """The setting of a dotted name."""
    for part in name.split("."):
        config = config[part]
    return config


def scalar(text: Any) -> Any:
    """A string read as a YAML scalar; anything else as it is."""
    if not isinstance(text, str):
        return text
    low = text.strip().lower()
    if low in ("", "~", "null"):
        return None
    if low in ("true", "yes", "on"):
        return True
    if low in ("false", "no", "off"):
        return False
    for kind in (int, float):
        try:
            value = kind(low)
        except ValueError:
            continue
        if math.isfinite(value):
            return value
    return text.strip().strip("'\"")


def merged(base: dict, over: dict) -> dict:
    """base with the values of over, section by section; an unknown key is an error."""
    found = copy.deepcopy(base)
    for key, value in over.items():
        if key not in found:
            raise InvalidArgument(f"unknown option {key!r}")
        if isinstance(found[key], dict):
            if not isinstance(value, dict):
                raise InvalidArgument(f"{key!r} is a section")
            found[key] = merged(found[key], value)
        else:
            found[key] = value
    return found


def with_options(base: dict, options: dict[str, Any]) -> dict:
    """base with dotted options such as {"hnsw.M": "32"}; `hnsw__M` means the same."""
    found = base
    for name, value in options.items():
        over: Any = scalar(value)
        for part in reversed(name.replace("__", ".").split(".")):
            over = {part: over}
        found = merged(found, over)
    return found


def check(config: dict, dim: int) -> None:
    """InvalidArgument unless a collection can work with these settings; nothing is written before."""
    if not isinstance(dim, int) or isinstance(dim, bool) or dim <= 0:
        raise InvalidArgument(f"dim must be a positive integer, not {dim!r}")
    if config["metric"] not in METRICS:
        raise InvalidArgument(f"unknown metric {config['metric']!r}")
    if config["index"] not in INDEXES:
        raise InvalidArgument(f"unknown index {config['index']!r}")
    if config["pq"]["ksub"] != 256:
        raise InvalidArgument("pq.ksub is 256: one byte a subspace")
    if config["pq"]["device"] != "cpu":
        raise InvalidArgument("pq.device is cpu")
    if config["early_stop"]["model"] and config["index"] != "hnsw":
        raise InvalidArgument("early_stop.model works with hnsw only")
    if changed := [name for name in IGNORED if value_at(config, name) != value_at(DEFAULTS, name)]:
        warnings.warn(f"{', '.join(changed)}: without effect, vectors are indexed by cells", stacklevel=3)
    if config["index"] == "hnsw_pq" and (config["pq"]["m"] <= 0 or dim % config["pq"]["m"]):
        raise InvalidArgument(f"{dim} dimensions do not split into {config['pq']['m']} subspaces")


def dumps(config: dict) -> str:
    return json.dumps(config, indent=1, sort_keys=True)
