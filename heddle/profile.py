"""What a matcher looks for. Lists are lower-cased when the profile is made."""

from __future__ import annotations

from dataclasses import dataclass, field


def _lower(values) -> tuple[str, ...]:
    return tuple(str(v).lower() for v in values or ())


@dataclass(frozen=True)
class Profile:
    """Role and exclude keywords and preferred places; work_types is kept but no rule reads it."""

    role_keywords: tuple[str, ...] = ()
    exclude_keywords: tuple[str, ...] = ()
    location_pref: tuple[str, ...] = ()
    work_types: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for name in ("role_keywords", "exclude_keywords", "location_pref", "work_types"):
            object.__setattr__(self, name, _lower(getattr(self, name)))

    @classmethod
    def from_yaml(cls, content: str) -> Profile:
        """The ``target`` section of a YAML file; needs a YAML library, which is optional."""
        import yaml

        target = (yaml.safe_load(content) or {}).get("target") or {}
        return cls(**{k: tuple(target.get(k) or ()) for k in ("role_keywords", "exclude_keywords", "location_pref", "work_types")})
