"""Settings with the usual values, from a mapping or a properties file."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    acl_writer_size: int = 1000
    expectation_write_size: int = 100
    like_sync_size: int = 500
    buffer_limit: int = 10_000
    saturation_threshold: int = 5000
    outbox_stale_minutes: int = 5
    outbox_max_retries: int = 3
    throttle_seconds: int = 60
    daily_quota: int = 100
    retry_budget: int = 100
    retry_window_seconds: int = 60
    lenient_mass: bool = False

    def updated(self, values: dict[str, str | int | bool]) -> Settings:
        """With other values; unknown names and texts that don't fit raise ``ValueError``."""
        kinds = {f.name: f.type for f in fields(self)}
        found = {}
        for name, value in values.items():
            key = name.replace("-", "_").replace(".", "_").lower()
            if key not in kinds:
                raise ValueError(f"unknown setting {name}")
            if kinds[key] == "bool":
                text = str(value).strip().lower()
                if text not in ("true", "false"):
                    raise ValueError(f"{name} must be true or false")
                found[key] = text == "true"
            else:
                found[key] = int(value)
        return replace(self, **found)

    @classmethod
    def from_properties(cls, text: str) -> Settings:
        """``name=value`` or ``name: value`` lines; ``#`` begins a comment."""
        pairs = {}
        for line in text.splitlines():
            line = line.split("#", 1)[0].strip()
            if line:
                at = min(i for i in (line.find("="), line.find(":"), len(line)) if i >= 0)
                pairs[line[:at].strip()] = line[at + 1 :].strip()
        return cls().updated(pairs)

    @classmethod
    def from_yaml(cls, text: str) -> Settings:
        """Scalars of a mapping, nested by indentation: ``like: {newline} sync-size: 500`` is ``like_sync_size``."""
        pairs: dict[str, str] = {}
        path: list[tuple[int, str]] = []
        for line in text.splitlines():
            line = line.split(" #", 1)[0].rstrip()
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            name, colon, value = line.strip().partition(":")
            if not colon:
                raise ValueError(f"no mapping: {line.strip()}")
            depth = len(line) - len(line.lstrip())
            path = [p for p in path if p[0] < depth]
            if value.strip():
                pairs["_".join([*(n for _, n in path), name.strip()])] = value.strip().strip("'\"")
            else:
                path.append((depth, name.strip()))
        return cls().updated(pairs)
