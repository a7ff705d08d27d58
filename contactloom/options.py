"""Settings of a scan, in one frozen record."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

_TRUE = {"1", "t", "T", "TRUE", "true", "True"}
_FALSE = {"0", "f", "F", "FALSE", "false", "False"}


@dataclass(frozen=True)
class ScanOptions:
    max_depth: int = 3
    deduplicate: bool = True
    cache_enabled: bool = True
    ttl_days: int = 360
    async_enabled: bool = True
    async_workers: int = 3
    job_timeout_s: int = 300
    webhook_timeout_s: int = 10
    webhook_retries: int = 3

    @classmethod
    def from_mapping(cls, settings: Mapping[str, str]) -> ScanOptions:
        """Read text settings; anything missing or unreadable keeps its default."""
        chosen = {}
        for field in fields(cls):
            text = settings.get(field.name, "")
            if field.type == "bool":
                if text in _TRUE or text in _FALSE:
                    chosen[field.name] = text in _TRUE
            elif text.lstrip("+-").isdecimal() and text.isascii():
                try:
                    chosen[field.name] = int(text)
                except ValueError:
                    pass
        return cls(**chosen)
