"""Style allow-lists: defaults, merging and filtering, without shared state."""

from __future__ import annotations

import copy
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import STYLE_CONFIG

KEYS = ("allowed_styles", "allowed_classes")
CONFIG_TYPE = "map<string,struct<allowed_styles:array<string>,allowed_classes:array<string>>>"


def default_config() -> dict[str, dict[str, list[str]]]:
    return copy.deepcopy(STYLE_CONFIG)


def merged_config(custom: dict | None) -> dict[str, dict[str, list[str]]]:
    """Defaults, each list followed by the custom entries it lacks; formats that are unknown are ignored.

    Every call starts from fresh defaults, so one request never changes another.
    """
    out = default_config()
    for fmt, lists in (custom or {}).items():
        if fmt in out:
            for key in KEYS:
                out[fmt][key] += [x for x in lists.get(key, []) if x not in out[fmt][key]]
    return out


def config_from_request(body: str | dict | None) -> dict[str, dict[str, list[str]]]:
    """Merged config of a request's ``style_config``; anything that can't be parsed counts as none."""
    try:
        data = json.loads(body) if isinstance(body, str) else (body or {})
        custom = data.get("style_config", {}) if isinstance(data, dict) else {}
        return merged_config({f: v for f, v in custom.items() if isinstance(v, dict)})
    except (ValueError, AttributeError, TypeError):
        return default_config()


def parse_config(body: Column) -> Column:
    """JSON text -> config map, empty where it can't be parsed."""
    return F.coalesce(F.from_json(body, CONFIG_TYPE), F.from_json(F.lit("{}"), CONFIG_TYPE))


def merge_lists(base: Column, custom: Column) -> Column:
    """``base`` followed by what ``custom`` adds, in order."""
    extra = F.coalesce(custom, F.array().cast("array<string>"))
    return F.concat(base, F.filter(extra, lambda x: ~F.array_contains(base, x)))


def _allowed(fmt: Column, key: str, config: dict | None) -> Column:
    table = config or STYLE_CONFIG
    out = F.array().cast("array<string>")
    for name, lists in table.items():
        out = F.when(fmt == name, F.array(*[F.lit(x) for x in lists[key]])).otherwise(out)
    return out


def filter_styles(fmt: Column, styles: Column, config: dict | None = None) -> Column:
    return F.map_filter(styles, lambda k, v: F.array_contains(_allowed(fmt, "allowed_styles", config), k))


def filter_classes(fmt: Column, classes: Column, config: dict | None = None) -> Column:
    return F.filter(classes, lambda c: F.array_contains(_allowed(fmt, "allowed_classes", config), c))


def is_style_allowed(fmt: Column, name: Column, config: dict | None = None) -> Column:
    return F.array_contains(_allowed(fmt, "allowed_styles", config), name)


def is_class_allowed(fmt: Column, name: Column, config: dict | None = None) -> Column:
    return F.array_contains(_allowed(fmt, "allowed_classes", config), name)
