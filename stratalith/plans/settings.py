"""Settings of a project: defaults, a text of JSON sections, the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

from ..sources.files import EXCLUDED_DIRS, EXCLUDED_FILES, MAX_FILE_BYTES


@dataclass(frozen=True)
class Scanner:
    exclude_dirs: list[str] = field(default_factory=lambda: list(EXCLUDED_DIRS))
    exclude_files: list[str] = field(default_factory=lambda: list(EXCLUDED_FILES))
    max_file_size: int = MAX_FILE_BYTES


@dataclass(frozen=True)
class Model:
    """How the caller's completer is to be set up; nothing here calls a service."""

    api_key: str = ""
    base_url: str = ""
    model: str = ""
    temperature: float = 0.3
    max_tokens: int = 4096


@dataclass(frozen=True)
class Settings:
    scanner: Scanner = field(default_factory=Scanner)
    llm: Model = field(default_factory=Model)


def loaded(text: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Settings of a JSON text of sections; what it leaves out comes from the environment (``LLM_API_KEY``, ``LLM_BASE_URL``,
    ``LLM_MODEL``) or is the default. Unknown names are left out."""
    env = os.environ if environment is None else environment
    base = Settings(llm=Model(env.get("LLM_API_KEY", ""), env.get("LLM_BASE_URL", ""), env.get("LLM_MODEL", "")))
    data = json.loads(text) if text else {}

    def section(default, values: dict):
        known = {f.name for f in fields(default)}
        return replace(default, **{k: v for k, v in values.items() if k in known})

    return Settings(section(base.scanner, data.get("scanner") or {}), section(base.llm, data.get("llm") or {}))
