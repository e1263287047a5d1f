"""Settings with offline defaults; environment variables and an .env file may override them."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    artifact_version: str = "v1"
    index_version: str = "v1"
    embedding_model: str = "text-embedding-3-large"
    chat_model: str = "gpt-4.1-mini"
    api_key: str = field(default="", repr=False)
    base_url: str = ""
    collection_name: str = "functional_specs"
    vector_size: int = 3072
    retrieval_min_top_score: float = 0.30
    input_cost_per_1k_tokens: float = 0.0
    output_cost_per_1k_tokens: float = 0.0
    log_level: str = "INFO"


#: Prefix of the environment's variables, which these settings need and others may have.
PREFIX, OWN = "stratalens_", ("api_key", "base_url")


def shown(settings: Settings) -> str:
    """The settings as text; of the key only whether there is one."""
    return f"{settings} api_key={'(set)' if settings.api_key else '(not set)'}"


def load_settings(env_file: str | Path = ".env") -> Settings:
    """Settings from defaults, then ``env_file``, then the environment; unknown keys are ignored.

    The service's key and address are taken from the environment under PREFIX only, so that a key meant for
    another program is never sent; the file may name them either way.
    """
    given: dict[str, str] = {}
    if Path(env_file).is_file():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.partition("=")
            if eq and not key.lstrip().startswith("#"):
                given[key.strip().lower()] = value.strip().strip("\"'")
    given |= {k.lower(): v for k, v in os.environ.items() if k.lower() not in OWN}
    given |= {k.removeprefix(PREFIX): v for k, v in [*given.items()] if k.startswith(PREFIX)}
    kinds = {"int": int, "float": float, "str": str}
    return Settings(**{f.name: kinds[f.type](given[f.name]) for f in fields(Settings) if f.name in given})


# Fixed value: the format of log lines.
LOG_FORMAT = "%(asctime)s | %(levelname)s | %(name)s | %(message)s"


def configure_logging(level: str = "INFO") -> None:
    """One format for all loggers; an unknown level is INFO."""
    logging.basicConfig(level=getattr(logging, level.upper(), logging.INFO), format=LOG_FORMAT)


def get_logger(name: str | None = None) -> logging.Logger:
    return logging.getLogger(name or "stratalens")
