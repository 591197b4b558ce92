"""Settings of a run: a mapping from a JSON (or, where a parser is installed, YAML) file, checked against what a run knows."""

from __future__ import annotations

import json
from dataclasses import fields, replace
from pathlib import Path

from meridax.operators.backtest import Rules

#: Settings by section; a value of None must be given.
DEFAULTS: dict[str, dict] = {
    "data": {"path": None, "start": None, "end": None},
    "universe": {"top_n": 20, "adv_min": 0.0, "price_min": 0.0, "age_min": 20, "hysteresis": 2},
    "rules": {},
    "output": {"path": "out", "kind": "parquet"},
}


def load(path: str) -> dict:
    """The settings of a file over the defaults."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML parser is installed: write the settings as JSON") from e
        given = yaml.safe_load(text)
    else:
        given = json.loads(text)
    return checked(given or {})


def checked(given: dict) -> dict:
    """Defaults with the given values, each of its default's type; unknown names and wrong values raise ValueError."""
    if not isinstance(given, dict):
        raise ValueError("settings must be a mapping")
    out = {section: dict(values) for section, values in DEFAULTS.items()}
    for section, values in given.items():
        if section not in out or not isinstance(values, dict):
            raise ValueError(f"unknown section: {section}")
        for name, value in values.items():
            if section != "rules" and name not in out[section]:
                raise ValueError(f"unknown setting: {section}.{name}")
            default = out[section].get(name)
            out[section][name] = type(default)(value) if default is not None and value is not None else value
    rules_of(out)
    if out["output"]["kind"] not in ("parquet", "csv", "json"):
        raise ValueError("output.kind must be parquet, csv or json")
    return out


def rules_of(settings: dict) -> Rules:
    kinds = {f.name: type(f.default) for f in fields(Rules)}
    given = settings["rules"]
    if unknown := set(given) - set(kinds):
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    rules = replace(Rules(), **{k: kinds[k](v) for k, v in given.items()})
    if rules.method not in ("hrp", "hrp_only", "tda_only"):
        raise ValueError(f"unknown method: {rules.method}")
    if rules.target_vol <= 0 or rules.asset_cap <= 0 or rules.turnover_cap <= 0 or rules.cluster_cap <= 0 or rules.lookback < 2:
        raise ValueError("caps and target volatility must be positive, the lookback two rows or more")
    return rules


def put(settings: dict, path: str, value) -> dict:
    """A copy with the value at a dotted path, such as ``rules.target_vol``."""
    section, _, name = path.partition(".")
    out = {k: dict(v) for k, v in settings.items()}
    if section not in out or not name:
        raise ValueError(f"no such setting: {path}")
    out[section][name] = value
    return checked(out)
