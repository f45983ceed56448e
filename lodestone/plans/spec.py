"""Requests of crawls, scans and matches, with their bounds and defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from lodestone.functions.urls import canonical_seed


class ValidationError(ValueError):
    """Holds a message for each field that is out of bounds."""

    def __init__(self, fields: dict[str, str]):
        self.fields = fields
        super().__init__("; ".join(f"{k} {v}" for k, v in fields.items()))


class NotFound(LookupError):
    """No crawl or scan has this id."""


def _bounds(**checks: tuple[bool, str]) -> None:
    wrong = {k: message for k, (ok, message) in checks.items() if not ok}
    if wrong:
        raise ValidationError(wrong)


@dataclass(frozen=True)
class CrawlSpec:
    seed_url: str
    max_pages: int = 25
    max_depth: int = 2
    same_host_only: bool = True
    respect_robots: bool = True
    requests_per_second: float = 1.0
    career: bool = field(default=False, init=False)

    def __post_init__(self) -> None:
        _bounds(
            seed_url=(bool(self.seed_url and self.seed_url.strip()) and len(self.seed_url) <= 2048, "must have 1 to 2048 characters"),
            max_pages=(1 <= self.max_pages <= 500, "must be from 1 to 500"),
            max_depth=(0 <= self.max_depth <= 10, "must be from 0 to 10"),
            requests_per_second=(0.1 <= self.requests_per_second <= 10, "must be from 0.1 to 10"),
        )
        object.__setattr__(self, "seed_url", canonical_seed(self.seed_url))


@dataclass(frozen=True)
class CareerSpec(CrawlSpec):
    max_pages: int = 50
    max_depth: int = 3
    same_host_only: bool = field(default=False, init=False)
    respect_robots: bool = field(default=True, init=False)

    def __post_init__(self) -> None:
        _bounds(
            max_pages=(1 <= self.max_pages <= 200, "must be from 1 to 200"),
            max_depth=(0 <= self.max_depth <= 5, "must be from 0 to 5"),
            requests_per_second=(0.1 <= self.requests_per_second <= 5, "must be from 0.1 to 5"),
        )
        super().__post_init__()
        object.__setattr__(self, "career", True)


@dataclass(frozen=True)
class MatchSpec:
    resume: str
    use_ai: bool = False

    def __post_init__(self) -> None:
        _bounds(resume=(bool(self.resume.strip()) and 80 <= len(self.resume) <= 30_000, "must have 80 to 30,000 characters"))


def capabilities(api_key: str | None = None, model: str = "") -> dict:
    """Whether the external matcher can be used."""
    return {"aiConfigured": bool(api_key and api_key.strip()), "model": model}
