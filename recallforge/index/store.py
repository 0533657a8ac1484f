"""Index models as JSON: arrays, grains and shared models, without code that loading could run."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

import numpy as np

from ..routers import lattice
from .grain import Grain
from .shared_pq import SharedGrain, SharedPQ

TYPES = {t.__name__: t for t in (Grain, SharedGrain, SharedPQ)}
ROUTERS = {t.__name__: t for t in (lattice.Lattice, lattice.HierarchicalLattice)}


def plain(v):
    if isinstance(v, np.ndarray):
        return {"array": v.tolist(), "shape": list(v.shape), "dtype": str(v.dtype)}
    if is_dataclass(v):
        return {"type": type(v).__name__, "fields": {f.name: plain(getattr(v, f.name)) for f in fields(v)}}
    if isinstance(v, dict):
        return {"map": [[plain(k), plain(x)] for k, x in v.items()]}
    if isinstance(v, (list, tuple)):
        return {"list": [plain(x) for x in v]}
    return v.item() if isinstance(v, np.generic) else v


def real(v):
    if not isinstance(v, dict):
        return v
    if "array" in v:
        return np.array(v["array"], dtype=v["dtype"]).reshape(v["shape"])
    if "type" in v:
        return TYPES[v["type"]](**{k: real(x) for k, x in v["fields"].items()})
    if "map" in v:
        return {real(k): real(x) for k, x in v["map"]}
    return [real(x) for x in v["list"]]


def dump(**parts) -> bytes:
    return json.dumps({k: plain(v) for k, v in parts.items()}).encode()


def load(data: bytes) -> dict:
    return {k: real(v) for k, v in json.loads(data).items()}


def router_parts(router) -> dict | None:
    return None if router is None else {"name": type(router).__name__, **router.settings}


def router_from(parts: dict | None, centroids: np.ndarray):
    if parts is None:
        return None
    settings = {k: tuple(v) if isinstance(v, list) else v for k, v in parts.items() if k != "name"}
    return ROUTERS[parts["name"]](centroids, **settings)
