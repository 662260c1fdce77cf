"""Settings of a run: given values before the environment before defaults, checked against their bounds; and the exit codes of failures."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any

#: Prefix of the environment variables that settings are read from.
ENVIRONMENT = "VELLUM_"


class RunError(Exception):
    """A failure with an exit code of its own."""

    exit_code = 1


class InvalidSetting(RunError):
    exit_code = 2


class UnreadableSource(RunError):
    exit_code = 3


class ChooserUnavailable(RunError):
    exit_code = 4


class NameTaken(RunError):
    """A name exists with other content; it is left as it is."""

    exit_code = 5


class ReviewNeeded(RunError):
    """Open items, missing authorization, or a failed verification: ``state`` says which."""

    exit_code = 6

    def __init__(self, message: str = "", state: str | None = None) -> None:
        super().__init__(message or state or "a person has to review this")
        self.state = state


class Exhausted(RunError):
    exit_code = 7


class OcrUnavailable(RunError):
    exit_code = 8


def exit_code(failure: BaseException | None) -> int:
    """0 without a failure, a known failure's own code, 1 for any other."""
    return 0 if failure is None else getattr(type(failure), "exit_code", 1) if isinstance(failure, RunError) else 1


def whole(low: int, high: int):  # noqa: ANN201
    return lambda name, value: _within(name, _number(name, value, int), low, high)


def share(name: str, value: Any) -> float:
    return _within(name, _number(name, value, float), 0.0, 1.0)


def codes(name: str, value: Any) -> tuple[str, ...] | None:
    """Language codes, from a list or a text with commas; lower case, blank ones left out; none: no override."""
    parts = value.split(",") if isinstance(value, str) else list(value or ())
    return tuple(p for p in (str(x).strip().lower() for x in parts) if p) or None


def _number(name: str, value: Any, kind: type) -> Any:
    try:
        return kind(value)
    except (TypeError, ValueError):
        raise InvalidSetting(f"{name}: {value!r} is no {'whole ' if kind is int else ''}number") from None


def _within(name: str, value: Any, low: Any, high: Any) -> Any:
    if not low <= value <= high:
        raise InvalidSetting(f"{name}: {value} is not from {low} to {high}")
    return value


def text(name: str, value: Any) -> str:
    return str(value)


@dataclass(frozen=True)
class Settings:
    """Names, defaults and bounds."""

    llm_base_url: str = "http://127.0.0.1:8000/v1"
    llm_model: str | None = None
    llm_seed: int | None = None
    llm_retries: int = 2
    ocr_engine: str = "tesseract"
    ocr_lang: tuple[str, ...] | None = None
    ocr_confidence_threshold: int = 70
    reconcile_confidence_threshold: float = 0.75
    gross_divergence_threshold: float = 0.5
    language_detector: str = "frequent_words"
    enabled_extraction_paths: tuple[str, ...] = ("docling", "pdfplumber", "ocr")
    native_reliability: tuple[tuple[str, float], ...] = ()
    output_dir: str = "./out"
    resolution_store: str | None = None

    @property
    def intermediates(self) -> Path:
        return Path(self.output_dir) / "intermediates"

    @property
    def store(self) -> Path:
        return Path(self.resolution_store or Path(self.output_dir) / "resolutions.jsonl")

    def authorizations(self, base: str) -> Path:
        return Path(self.output_dir) / f"{base}.review-authorizations.jsonl"

    def with_reliability(self, knobs: Mapping[str, float]) -> Settings:
        return replace(self, native_reliability=tuple(sorted(knobs.items())))

    def affecting(self, stage: str, *, chooser_reachable: bool = False) -> dict[str, Any]:
        """What changes the bytes that a stage (``extract`` or ``validate``) writes: no places, retries or addresses."""
        if stage not in ("extract", "validate"):
            raise InvalidSetting(f"no such stage: {stage}")
        names = ["ocr_engine", "ocr_confidence_threshold", "reconcile_confidence_threshold"] + ["gross_divergence_threshold"] * (stage == "validate")
        out: dict[str, Any] = {n: getattr(self, n) for n in names}
        out["ocr_languages_override"] = None if self.ocr_lang is None else list(self.ocr_lang)
        out["enabled_extraction_paths"] = list(self.enabled_extraction_paths)
        if stage == "validate" or chooser_reachable:
            out |= {"llm_model": self.llm_model, "llm_decode": {"temperature": 0, "seed": self.llm_seed}}
        return out


#: How a value that is given is read; others are taken as they are. Only these names and plain texts may come from the environment.
READ = {"llm_retries": whole(0, 100), "llm_seed": lambda name, value: _number(name, value, int), "ocr_confidence_threshold": whole(0, 100), "reconcile_confidence_threshold": share, "gross_divergence_threshold": share, "ocr_lang": codes, "llm_base_url": text, "llm_model": text, "ocr_engine": text, "language_detector": text, "output_dir": text}


def resolve(given: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Null given values and empty variables don't count."""
    out: dict[str, Any] = {}
    known = {f.name for f in fields(Settings)}
    for name, value in (given or {}).items():
        if name not in known:
            raise InvalidSetting(f"no such setting: {name}")
        if value is not None:
            out[name] = value
    for name in READ:
        if name not in out and (value := (environment or {}).get(ENVIRONMENT + name.upper(), "")) != "":
            out[name] = value
    return Settings(**{name: READ[name](name, value) if name in READ else tuple(value) if isinstance(value, list) else value for name, value in out.items()})


def is_local(host: str | None) -> bool:
    """Whether a host name is this machine's without asking a name server: localhost, 127.0.0.0/8 or ::1."""
    import ipaddress

    if not host:
        return False
    if host.lower().rstrip(".") == "localhost":
        return True
    try:
        return ipaddress.ip_address(host.strip("[]")).is_loopback
    except ValueError:
        return False
