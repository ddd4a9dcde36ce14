"""Configuration: TOML on the driver, checked against dataclasses, with overrides."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import get_args, get_type_hints


class ConfigError(ValueError):
    pass


# The sections, keys and defaults of configuration files.
@dataclass(frozen=True)
class Model:
    asr_model: str = "Qwen/Qwen3-ASR-1.7B-hf"
    low_vram_asr_model: str = "Qwen/Qwen3-ASR-0.6B-hf"
    aligner_model: str = "Qwen/Qwen3-ForcedAligner-0.6B-hf"
    device_map: str = "auto"
    dtype: str = "auto"
    language: str | None = None


@dataclass(frozen=True)
class Speech:
    enabled: bool = True
    backend: str = "silero"
    short_audio_threshold: float = 180.0
    min_speech_duration: float = 0.25
    min_silence_duration: float = 0.6
    speech_padding: float = 0.25
    max_chunk_duration: float = 120.0
    hard_max_chunk_duration: float = 240.0
    skip_silence_longer_than: float = 8.0


@dataclass(frozen=True)
class Segments:
    mode: str = "blingfire"
    min_duration: float = 0.833
    max_duration: float = 7.0
    max_lines: int = 2
    max_chars_en: int = 42
    max_chars_zh: int = 16
    max_chars_ja: int = 13
    max_cps_en: float = 20.0
    max_cps_zh: float = 9.0
    max_cps_ja: float = 4.0
    pause_threshold: float = 0.65


@dataclass(frozen=True)
class Store:
    enabled: bool = True
    cleanup_enabled: bool = True
    max_media_entries: int = 12


@dataclass(frozen=True)
class Performance:
    compile_aligner: bool = True
    compile_asr: bool = False


@dataclass(frozen=True)
class Chat:
    base_url: str = "http://localhost:8000/v1"
    api_key: str = ""
    model: str | None = None
    timeout: float = 60.0
    max_retries: int = 2
    temperature: float = 0.0
    thinking: bool = False
    thinking_effort: str | None = None
    batch_size: int = 40
    concurrency: int = 2


@dataclass(frozen=True)
class Output:
    default_formats: tuple[str, ...] = ("srt",)
    bilingual_separator: str = "\n"
    strip_punctuation: bool = False


@dataclass(frozen=True)
class Config:
    """``segmentation`` is [llm.segmentation] over [llm], or None."""

    model: Model = Model()
    vad: Speech = Speech()
    segment: Segments = Segments()
    cache: Store = Store()
    performance: Performance = Performance()
    llm: Chat = Chat()
    output: Output = Output()
    cache_dir: str = ".cueloom-cache"
    segmentation: Chat | None = None


MODES = ("none", "blingfire", "local", "hybrid", "llm")
EFFORTS = ("low", "medium", "high", "xhigh", "max")
#: key -> (test, what it must be).
RULES = {
    "segment.mode": (lambda v: v in MODES, f"one of {', '.join(MODES)}"),
    "llm.timeout": (lambda v: v > 0, "greater than 0"),
    "llm.max_retries": (lambda v: v >= 0, "0 or more"),
    "llm.batch_size": (lambda v: v > 0, "greater than 0"),
    "llm.concurrency": (lambda v: v > 0, "greater than 0"),
    "llm.temperature": (lambda v: 0 <= v <= 2, "between 0 and 2"),
    "llm.thinking_effort": (lambda v: v is None or v in EFFORTS, f"one of {', '.join(EFFORTS)}"),
}
MODEL_NAME, API_KEY = "CUELOOM_MODEL", "CUELOOM_API_KEY"


def _typed(value, kind, path: str):
    """``value`` as the field's type: whole numbers do for others, lists for tuples; anything else is an error."""
    allowed = get_args(kind) if type(None) in get_args(kind) else (kind,)
    if tuple[str, ...] in allowed:
        if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
            raise ConfigError(f"{path} must be a list of texts")
        return tuple(value)
    if type(value) is int and float in allowed:
        return float(value)
    if type(value) not in allowed:
        raise ConfigError(f"{path} must be {' or '.join(k.__name__ for k in allowed if k is not type(None))}")
    return value


def _merged(base, values, where: str = "", path: str = ""):
    """``base`` with ``values``; ``path`` names it in errors, ``where`` in RULES."""
    if not isinstance(values, dict):
        raise ConfigError(f"[{path}] must be a table")
    kinds = get_type_hints(type(base))
    known = [f.name for f in fields(base) if not (not where and f.name == "segmentation")]
    if unknown := sorted(set(values) - set(known)):
        raise ConfigError(f"unknown {f'key in [{path}]' if where else 'section'}: {', '.join(unknown)}")
    out = {}
    for name, value in values.items():
        if is_dataclass(getattr(base, name)):
            out[name] = _merged(getattr(base, name), value, name, name)
            continue
        out[name] = _typed(value, kinds[name], f"{path}.{name}".lstrip("."))
        test, must = RULES.get(f"{where}.{name}", (None, ""))
        if test and not test(out[name]):
            raise ConfigError(f"{path}.{name} must be {must}: {value}")
    return replace(base, **out)


def load_config(text: str = "", overrides: dict | None = None, low_vram: bool = False, environment: dict | None = None) -> Config:
    """Defaults, then the TOML text, then overrides (section -> key -> value, or key -> value; None is not set).

    The environment gives the chat model's name and key where nothing else does.
    """
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    chat = data.get("llm")
    own = chat.pop("segmentation", None) if isinstance(chat, dict) else None
    config = _merged(Config(), data)
    if own is not None:
        config = replace(config, segmentation=_merged(config.llm, own, "llm", "llm.segmentation"))
    given = {}
    for name, value in (overrides or {}).items():
        if isinstance(value, dict):
            given[name] = {k: v for k, v in value.items() if v is not None}
        elif value is not None:
            given[name] = value
    config = _merged(config, given)
    if low_vram:
        config = replace(config, model=replace(config.model, asr_model=config.model.low_vram_asr_model))
    env = os.environ if environment is None else environment
    named = lambda c: c and replace(c, model=c.model or env.get(MODEL_NAME), api_key=c.api_key or env.get(API_KEY, ""))
    return replace(config, llm=named(config.llm), segmentation=named(config.segmentation))
