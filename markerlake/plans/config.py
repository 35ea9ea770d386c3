"""Driver-side algebra of nested settings: merging, presets, dotted updates, migrations."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any


def _strings(x: Any) -> bool:
    return isinstance(x, list) and bool(x) and all(isinstance(v, str) for v in x)


def deep_merge(below: dict, above: dict) -> dict:
    """Nested dicts merge, lists of strings unite in order, all else is replaced. The inputs stay as they are."""
    out = copy.deepcopy(below)
    for key, value in above.items():
        old = out.get(key)
        if isinstance(old, dict) and isinstance(value, dict):
            out[key] = deep_merge(old, value)
        elif _strings(old) and _strings(value):
            out[key] = list(dict.fromkeys([*old, *value]))
        else:
            out[key] = copy.deepcopy(value)
    return out


def merge_all(layers: Iterable[dict]) -> dict:
    return reduce(deep_merge, layers, {})


class Presets:
    """Named functions that give override dicts."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[[], dict]] = {}

    def register(self, name: str) -> Callable[[Callable[[], dict]], Callable[[], dict]]:
        if name.count(".") != 1 or name in self._known:
            raise ValueError(f"preset names are category.name, once each: {name}")

        def keep(make: Callable[[], dict]) -> Callable[[], dict]:
            self._known[name] = make
            return make

        return keep

    def names(self) -> list[str]:
        return sorted(self._known)

    def expand(self, settings: dict) -> dict:
        """Presets named in `presets`, left to right, under the settings themselves."""
        own = {k: v for k, v in settings.items() if k != "presets"}
        return merge_all([*(self._known[n]() for n in settings.get("presets", [])), own])


def set_dotted(settings: dict, path: str, value: Any) -> dict:
    """A copy in which the place a.b.0.c holds the value; numbers are places in lists."""
    out = copy.deepcopy(settings)
    at: Any = out
    *way, last = path.split(".")
    for part in way:
        if isinstance(at, list):
            at = at[int(part)]
        else:
            at = at.setdefault(part, {})
    if isinstance(at, list):
        at[int(last)] = value
    else:
        at[last] = value
    return out


def migrate(settings: dict, steps: dict[str, tuple[str, Callable[[dict], dict]]], target: str, key: str = "version") -> dict:
    """Apply version steps {from: (to, change)} until the target; a newer or unknown version is an error."""
    out = copy.deepcopy(settings)
    version = str(out.get(key, "0.0"))
    while version != target:
        if version not in steps or float(version) > float(target):
            raise ValueError(f"no way from version {version} to {target}")
        version, change = steps[version]
        out = change(out) | {key: version}
    return out


def flat_to_nested(flat: dict, places: dict[str, str]) -> dict:
    """Old flat keys moved to dotted places."""
    out: dict = {}
    for key, value in flat.items():
        out = set_dotted(out, places.get(key, key), value)
    return out
