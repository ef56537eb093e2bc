"""Workspace settings: TOML text to one checked value. Driver code; nothing here touches data."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

DEFAULT = """
[workspace]
seed = 42

[providers.openai]
api_key_env = "OPENAI_API_KEY"

[providers.anthropic]
api_key_env = "ANTHROPIC_API_KEY"
base_url = "https://api.anthropic.com/v1/"

[filter]
provider = "anthropic"
model = "claude-haiku-4-5-20251001"

[judges]
scoring_aggregate = "mean"
exclude_candidate_provider = false

[judges.default]
provider = "anthropic"
model = "claude-opus-4-8"

[[judges.checklist_panel]]
provider = "anthropic"
model = "claude-opus-4-8"

[[judges.checklist_panel]]
provider = "openai"
model = "gpt-5.5"

[embeddings]
provider = "openai"
model = "text-embedding-3-small"

[sample]
target_n = 100
max_family_tasks = 5
near_duplicate_threshold = 0.90
long_tail_fraction = 0.20
"""

#: Filter models where [filter] is absent: the first of these providers that is declared.
FILTER_MODELS = {"anthropic": "claude-haiku-4-5-20251001", "openai": "gpt-4o-mini"}
#: Forms of price catalog files.
CATALOGS = ("openrouter", "litellm")
KEYLESS_TIMEOUT = 3600.0


class SettingsError(ValueError):
    """The settings file is malformed or names a provider that it doesn't declare."""


@dataclass(frozen=True)
class Model:
    provider: str
    model: str
    base_url: str | None = None

    @property
    def label(self) -> str:
        return f"{self.provider}:{self.model}"


@dataclass(frozen=True)
class Provider:
    name: str
    key_env: str | None = None
    keyring: str | None = None
    base_url: str | None = None
    timeout: float | None = None

    @property
    def keyless(self) -> bool:
        """No key is declared: a local server, which costs nothing and may be slow."""
        return not self.key_env and not self.keyring

    @property
    def seconds(self) -> float | None:
        return self.timeout if self.timeout is not None else KEYLESS_TIMEOUT if self.keyless else None

    def key(self) -> str | None:
        return os.environ.get(self.key_env) or None if self.key_env else None


@dataclass(frozen=True)
class Price:
    """USD per million tokens; of one provider's model, or of the model anywhere."""

    model: str
    input_per_1m: float
    output_per_1m: float
    provider: str | None = None


@dataclass(frozen=True)
class Sample:
    target_n: int = 100
    max_family_tasks: int = 5
    near_duplicate_threshold: float = 0.90
    long_tail_fraction: float = 0.20


@dataclass(frozen=True)
class Settings:
    providers: dict[str, Provider]
    filter_model: Model
    judge: Model
    seed: int = 42
    checklist_panel: tuple[Model, ...] = ()
    scoring_panel: tuple[Model, ...] = ()
    scoring_aggregate: str = "mean"
    exclude_candidate_provider: bool = False
    embeddings: Model = field(default_factory=lambda: Model("openai", "text-embedding-3-small"))
    prices: tuple[Price, ...] = ()
    fetch_prices: bool = True
    price_files: tuple[tuple[str, str], ...] = ()
    sample: Sample = Sample()

    def provider(self, name: str) -> Provider:
        if name not in self.providers:
            raise SettingsError(f"unknown provider '{name}': declare [providers.{name}]")
        return self.providers[name]

    @property
    def judges(self) -> tuple[Model, ...]:
        """Who scores answers: the panel, or else the default judge alone."""
        return self.scoring_panel or (self.judge,)


class _Section:
    """A table of the file with its name, so every complaint says where."""

    def __init__(self, value: Any, where: str):
        if not isinstance(value, dict):
            raise SettingsError(f"[{where}] must be a table, not {type(value).__name__}")
        self.value, self.where = value, where

    def fail(self, what: str) -> SettingsError:
        return SettingsError(f"[{self.where}] {what}")

    def refuse(self, key: str, why: str) -> None:
        if key in self.value:
            raise self.fail(f"{key} is no longer supported: {why}")

    def flag(self, key: str, default: bool) -> bool:
        got = self.value.get(key, default)
        if not isinstance(got, bool):
            raise self.fail(f"{key} must be true or false")
        return got

    def tables(self, key: str) -> list[_Section]:
        got = self.value.get(key, [])
        if not isinstance(got, list):
            raise self.fail(f"{key} must be an array of tables")
        return [_Section(x, f"{self.where}.{key}][{i}") for i, x in enumerate(got)]

    def number(self, key: str) -> float | None:
        if self.value.get(key) is None:
            return None
        try:
            return float(self.value[key])
        except (TypeError, ValueError) as e:
            raise self.fail(f"{key} must be a number") from e

    def positive(self, key: str) -> float | None:
        got = self.number(key)
        if got is not None and got <= 0:
            raise self.fail(f"{key} must be over 0")
        return got

    def model(self, providers: dict[str, Provider]) -> Model:
        p, m = self.value.get("provider"), self.value.get("model")
        if not p or not m:
            raise self.fail("requires both `provider` and `model`")
        if str(p) not in providers:
            raise self.fail(f"provider '{p}' is not declared under [providers.{p}]")
        return Model(str(p), str(m), self.value.get("base_url"))

    def per_million(self, side: str) -> float:
        for unit, factor in (("1m", 1.0), ("1k", 1000.0)):
            got = self.number(f"{side}_per_{unit}")
            if got is not None:
                if got < 0:
                    raise self.fail(f"{side}_per_{unit} must be non-negative")
                return got * factor
        raise self.fail(f"requires `{side}_per_1m` or `{side}_per_1k`")


def _provider(name: str, raw: Any) -> Provider:
    s = _Section(raw, f"providers.{name}")
    s.refuse("kind", "every provider speaks chat completions; give a base_url")
    env = str(s.value.get("api_key_env") or "").strip()
    return Provider(name, env or None, s.value.get("api_key_keyring"), s.value.get("base_url"), s.positive("timeout_seconds"))


def _filter(raw: Any, providers: dict[str, Provider]) -> Model:
    if raw is not None:
        return _Section(raw, "filter").model(providers)
    for name, model in FILTER_MODELS.items():
        if name in providers:
            return Model(name, model)
    return Model(next(iter(providers), "anthropic"), FILTER_MODELS["anthropic"])


def _price(s: _Section, providers: dict[str, Provider]) -> Price:
    model, of = str(s.value.get("model") or "").strip(), str(s.value.get("provider") or "").strip() or None
    if not model:
        raise s.fail("requires `model`")
    if of is not None and of not in providers:
        raise s.fail(f"provider '{of}' is not declared under [providers.{of}]")
    return Price(model, s.per_million("input"), s.per_million("output"), of)


def _price_file(s: _Section) -> tuple[str, str]:
    form, path = s.value.get("form"), s.value.get("path")
    if form not in CATALOGS or not path:
        raise s.fail(f"requires `path`, and `form`, one of {', '.join(CATALOGS)}")
    return str(form), str(path)


def parse(raw: dict[str, Any]) -> Settings:
    """Checked settings of a parsed file. Numbers out of range are held to it; anything else wrong is an error."""
    providers = {name: _provider(name, x) for name, x in _Section(raw.get("providers", {}), "providers").value.items()}
    if "judges" not in raw:
        raise SettingsError("missing [judges] section")
    judges = _Section(raw["judges"], "judges")
    aggregate = str(judges.value.get("scoring_aggregate", "mean")).strip().lower()
    if aggregate not in ("mean", "median"):
        raise judges.fail('scoring_aggregate must be "mean" or "median"')
    out = Settings(
        providers, _filter(raw.get("filter"), providers), _Section(judges.value.get("default"), "judges.default").model(providers),
        int(raw.get("workspace", {}).get("seed", 42)), tuple(s.model(providers) for s in judges.tables("checklist_panel")),
        tuple(s.model(providers) for s in judges.tables("scoring_panel")), aggregate, judges.flag("exclude_candidate_provider", False),
    )
    if raw.get("embeddings") is not None:
        s = _Section(raw["embeddings"], "embeddings")
        s.refuse("backend", "name a provider")
        s.refuse("local", "name a provider with a base_url")
        out = replace(out, embeddings=_Section({"provider": "openai", "model": out.embeddings.model} | s.value, "embeddings").model(providers))
    if raw.get("pricing") is not None:
        s = _Section(raw["pricing"], "pricing")
        out = replace(out, prices=tuple(_price(x, providers) for x in s.tables("models")), fetch_prices=s.flag("fetch_external", True), price_files=tuple(_price_file(x) for x in s.tables("catalogs")))
    given = {k: v for k, v in raw.get("sample", {}).items() if k in Sample.__dataclass_fields__}
    held = lambda v: min(1.0, max(0.0, float(v)))
    rules = {"target_n": lambda v: max(1, min(200, int(v))), "max_family_tasks": lambda v: max(1, int(v)), "near_duplicate_threshold": held, "long_tail_fraction": held}
    return replace(out, sample=Sample(**{k: rules[k](v) for k, v in given.items()}))


def load(path: str | Path) -> Settings:
    """The file's settings; the built-in ones where there is no file."""
    file = Path(path)
    return parse(tomllib.loads(file.read_text(encoding="utf-8") if file.exists() else DEFAULT))


def distinct(models: Iterable[Model]) -> list[Model]:
    """Each (provider, model) once, as it first comes, in that order."""
    out: dict[tuple[str, str], Model] = {}
    for m in models:
        out.setdefault((m.provider, m.model), m)
    return list(out.values())


def model_of(spec: str, providers: dict[str, Provider], option: str = "--model") -> Model:
    """`provider/model-id`; the id may have further slashes."""
    p, slash, m = (x.strip() for x in spec.partition("/"))
    if not (slash and p and m):
        raise SettingsError(f"{option} '{spec}' must be provider/model-id, such as openai/gpt-5")
    if p not in providers:
        raise SettingsError(f"unknown provider '{p}' in {option} '{spec}': add [providers.{p}]")
    return Model(p, m)


def scoring_judges(settings: Settings, candidate: Model, specs: Iterable[str] = ()) -> list[Model]:
    """Judges of a candidate: the ones asked for, as they are; else the configured ones, without the candidate's provider
    where the settings say so."""
    asked = [model_of(s, settings.providers, "--judge") for s in specs]
    if asked:
        return distinct(asked)
    barred = {candidate.provider} if settings.exclude_candidate_provider else set()
    left = [m for m in settings.judges if m.provider not in barred]
    if not left:
        raise SettingsError(f"no judge is left without the candidate's provider '{candidate.provider}': add a scoring panel judge of another, or name one")
    return distinct(left)


def build_identity(settings: Settings) -> dict[str, Any]:
    """What a build depends on, for hashes and caches. Scoring panel, its aggregate and prices are not in it."""
    pair = lambda m: {"provider": m.provider, "model": m.model}
    used = sorted({m.provider for m in (settings.filter_model, settings.embeddings, settings.judge, *settings.checklist_panel)})
    s = settings.sample
    return {
        "workspace": {"seed": settings.seed}, "providers": {n: {"base_url": settings.provider(n).base_url, "timeout_seconds": settings.provider(n).seconds} for n in used},
        "filter": pair(settings.filter_model), "judges": {"default": pair(settings.judge), "checklist_panel": [pair(m) for m in settings.checklist_panel]},
        "embeddings": pair(settings.embeddings), "sample": {k: getattr(s, k) for k in Sample.__dataclass_fields__},
    }
