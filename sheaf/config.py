"""Typed settings with their legal ranges; unknown keys and values out of range are refused."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field, fields
from typing import Any


class ConfigurationError(ValueError):
    """A setting is unknown, of a wrong type or out of range."""


def ranged(default, low, high, open_low: bool = False):
    """A number in [low, high], or (low, high]."""
    return field(default=default, metadata={"range": (low, high, open_low)})


class Checked:
    """Base of all settings: validates ranges after construction."""

    def __post_init__(self) -> None:
        for f in fields(self):
            value, limits = getattr(self, f.name), f.metadata.get("range")
            if limits is None:
                continue
            low, high, open_low = limits
            if isinstance(value, bool) or not isinstance(value, (int, float)) or isinstance(f.default, int) and not isinstance(value, int):
                raise ConfigurationError(f"{type(self).__name__}.{f.name} is no valid number: {value!r}")
            if not (low < value if open_low else low <= value) or value > high:
                raise ConfigurationError(f"{type(self).__name__}.{f.name} = {value} is outside {'(' if open_low else '['}{low}, {high}]")


@dataclass(frozen=True)
class Chunking(Checked):
    max_tokens: int = ranged(512, 64, 8192)
    metadata_reserve: int = ranged(64, 16, 512)
    #: A tokenizer's JSON file; without one words are counted.
    tokenizer: str = ""
    merge_peers: bool = True
    repeat_table_header: bool = True

    @property
    def budget(self) -> int:
        return self.max_tokens - self.metadata_reserve


@dataclass(frozen=True)
class QueryRewrite(Checked):
    enabled: bool = True
    max_keywords: int = ranged(3, 1, 5)
    max_context_turns: int = ranged(4, 0, 16)
    bibliography_top_k: int = ranged(5, 1, 20)


@dataclass(frozen=True)
class Retrieval(Checked):
    dense_top_k: int = ranged(20, 1, 200)
    bm25_original_top_k: int = ranged(10, 1, 200)
    bm25_rewrite_top_k: int = ranged(20, 1, 200)
    fused_top_k: int = ranged(50, 1, 500)
    rrf_k: int = ranged(60, 1, 1000)
    dense_original_weight: float = ranged(0.8, 0, 10, True)
    dense_rewrite_weight: float = ranged(1.2, 0, 10, True)
    bm25_original_weight: float = ranged(0.6, 0, 10, True)
    bm25_rewrite_weight: float = ranged(1.2, 0, 10, True)
    rewrite: QueryRewrite = QueryRewrite()


@dataclass(frozen=True)
class Bm25(Checked):
    """Weights of title, section and text.

    An inverted index whose first, unindexed column takes part in positional weights gives the
    title 0.8 and the section 1.0; these effective weights are the defaults.
    """

    title_weight: float = ranged(0.8, 0, 10, True)
    section_weight: float = ranged(1.0, 0, 10, True)
    text_weight: float = ranged(1.0, 0, 10, True)
    k1: float = ranged(1.2, 0, 10, True)
    b: float = ranged(0.75, 0.0, 1.0)


@dataclass(frozen=True)
class Reranking(Checked):
    enabled: bool = True
    candidate_top_k: int = ranged(40, 1, 200)
    final_top_k: int = ranged(5, 1, 50)


@dataclass(frozen=True)
class ContextExpansion(Checked):
    enabled: bool = True
    neighbor_window: int = ranged(1, 0, 8)
    max_total_tokens: int = ranged(6000, 256, 32000)


@dataclass(frozen=True)
class AnswerGeneration(Checked):
    enabled: bool = True
    max_evidence_units: int = ranged(8, 1, 30)


@dataclass(frozen=True)
class Overview(Checked):
    max_abstract_chunks: int = ranged(2, 0, 20)
    research_problem: int = ranged(3, 1, 20)
    contributions: int = ranged(3, 1, 20)
    main_method: int = ranged(4, 1, 20)
    datasets: int = ranged(2, 1, 20)
    experimental_setup: int = ranged(3, 1, 20)
    main_results: int = ranged(4, 1, 20)
    limitations: int = ranged(3, 1, 20)
    max_tokens_per_chunk: int = ranged(480, 64, 4096)
    max_total_context_tokens: int = ranged(4800, 256, 32000)
    max_fallback_chunks: int = ranged(2, 0, 20)
    max_output_tokens: int = ranged(1600, 256, 8192)


@dataclass(frozen=True)
class Storage(Checked):
    """Folders; relative ones count from the settings file's folder."""

    store: str = "store"
    artifacts: str = "artifacts"
    workspaces: str = "workspaces"


@dataclass(frozen=True)
class Parsing(Checked):
    front_matter_max_pages: int = ranged(2, 1, 10)
    list_heading_min_chars: int = ranged(80, 1, 1000)


@dataclass(frozen=True)
class Embedding(Checked):
    dimension: int = ranged(64, 1, 65536)
    instruction: str = ""


@dataclass(frozen=True)
class Settings(Checked):
    storage: Storage = Storage()
    parsing: Parsing = Parsing()
    embedding: Embedding = Embedding()
    chunking: Chunking = Chunking()
    retrieval: Retrieval = Retrieval()
    bm25: Bm25 = Bm25()
    reranking: Reranking = Reranking()
    context: ContextExpansion = ContextExpansion()
    answer: AnswerGeneration = AnswerGeneration()
    overview: Overview = Overview()


def build(kind: type, values: dict[str, Any]):
    """Settings of a kind from nested mappings; unknown keys are refused."""
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ConfigurationError(f"{kind.__name__}: unknown {', '.join(sorted(extra))}")
    out = {}
    for name, value in values.items():
        default = known[name].default
        out[name] = build(type(default), value) if dataclasses.is_dataclass(default) and isinstance(value, dict) else value
    return kind(**out)


def load(path: str) -> Settings:
    """Settings from a JSON file, or a YAML one where a YAML library is installed."""
    import json

    with open(path, encoding="utf-8") as source:
        text = source.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise ConfigurationError("reading YAML needs a YAML library; use JSON") from error
        values = yaml.safe_load(text)
    else:
        values = json.loads(text)
    if not isinstance(values, dict):
        raise ConfigurationError("the settings file must hold one mapping")
    settings, base = build(Settings, values), os.path.dirname(os.path.abspath(path))
    folders = {f.name: resolve_path(base, getattr(settings.storage, f.name)) for f in fields(Storage)}
    chunking = settings.chunking
    if chunking.tokenizer:
        chunking = dataclasses.replace(chunking, tokenizer=resolve_path(base, chunking.tokenizer))
    return dataclasses.replace(settings, storage=Storage(**folders), chunking=chunking)


def resolve_path(base: str, path: str) -> str:
    """A path relative to the settings file's folder; absolute ones and URIs stay."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(base, path)


@dataclass(frozen=True)
class ModelRuntime(Checked):
    """How to reach a chat model; read from the environment of the driver alone."""

    base_url: str = ""
    model: str = ""
    timeout_seconds: float = ranged(60.0, 1.0, 600.0)
    max_output_tokens: int = ranged(1024, 1, 32768)
    temperature: float = ranged(0.0, 0.0, 2.0)


def load_runtime(env: dict[str, str] | None = None, prefix: str = "SHEAF_LLM_") -> ModelRuntime:
    """Runtime settings from environment variables; numbers are range-checked."""
    env = dict(os.environ) if env is None else env
    values: dict[str, Any] = {}
    for f in fields(ModelRuntime):
        if (raw := env.get(prefix + f.name.upper())) is not None:
            try:
                values[f.name] = raw if isinstance(f.default, str) else type(f.default)(raw)
            except ValueError as error:
                raise ConfigurationError(f"{prefix}{f.name.upper()} is no number: {raw!r}") from error
    runtime = ModelRuntime(**values)
    if not runtime.base_url or not runtime.model:
        raise ConfigurationError(f"{prefix}BASE_URL and {prefix}MODEL must be set")
    return runtime
