"""Settings of the engine, passed explicitly so that every executor sees the same values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # chunking; 0 for ``overlap_chars`` leaves the choice to the language
    max_chars: int = 1200
    min_chunk_chars: int = 200
    min_chunk_chars_no_space: int = 120
    hard_min_chars: int = 40
    overlap_chars: int = 0
    overlap_chars_latin: int = 80
    overlap_chars_cjk: int = 60
    # search
    rrf_k: int = 60
    min_return_chars: int = 200
    # PDF noise
    drop_repeated_lines: bool = True
    strip_repeated_prefix: bool = True
    repeated_ratio: float = 0.25
    block_gap: float = 12.0
    # sources
    max_html_bytes: int = 10_000_000
    api_page_size: int = 200
    api_base: str = "http://127.0.0.1:23119/api"
    api_prefix: str = "users/0"
    api_headers: tuple[tuple[str, str], ...] = ()
    http_timeout: float = 30.0
    download_timeout: float = 120.0
    page_timeout: float = 30.0
    # embedder; a model given by name or path goes before the profile
    embed_profile: str = "hashing"
    embed_model: str = ""
    embed_device: str = "cpu"
    embed_offline: bool = False
    models_dir: str = "data/models"
    # index
    collection: str = "paragraphs"
    index_dir: str = "data/index"
    cache_dir: str = "data/cache"
    manifest_dir: str = "data/manifest"


DEFAULT = EngineConfig()
