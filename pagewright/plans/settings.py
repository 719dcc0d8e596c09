"""Settings as text: what is allowed, and what a value means."""

from __future__ import annotations

from dataclasses import dataclass

TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


@dataclass(frozen=True)
class Setting:
    kind: str  # int, bool, list or text
    default: str
    least: int | None = None
    most: int | None = None
    choices: tuple[str, ...] = ()


SETTINGS = {
    "search.limit": Setting("int", "50", 1, 500), "search.fuzzy": Setting("text", "auto", choices=("off", "auto", "on")), "search.diversity": Setting("bool", "true"),
    "search.quorum": Setting("bool", "true"), "search.toc": Setting("bool", "true"), "search.morphology": Setting("bool", "true"),
    "index.page_chars": Setting("int", "4000", 200, 40_000), "index.exts": Setting("list", ""), "agent.poll_seconds": Setting("int", "60", 1, 3600),
}


def normalised(name: str, value: str) -> str:
    """The value as it is stored; one that isn't allowed is refused."""
    setting = SETTINGS.get(name)
    if setting is None:
        raise KeyError(f"unknown setting {name}")
    text = value.strip()
    if setting.kind == "bool":
        if text.lower() in TRUE | FALSE:
            return "true" if text.lower() in TRUE else "false"
        raise ValueError(f"{name} is true or false")
    if setting.kind == "int":
        if not text.lstrip("-").isdigit() or not setting.least <= int(text) <= setting.most:
            raise ValueError(f"{name} is a number from {setting.least} to {setting.most}")
        return str(int(text))
    if setting.kind == "list":
        return ",".join(dict.fromkeys(x.strip().lower().strip(".") for x in text.split(",") if x.strip()))
    if setting.choices and text not in setting.choices:
        raise ValueError(f"{name} is one of {', '.join(setting.choices)}")
    return text


def value_of(name: str, stored: dict[str, str]) -> object:
    setting = SETTINGS[name]
    text = stored.get(name, setting.default)
    return {"int": int, "bool": lambda x: x == "true", "list": lambda x: [y for y in x.split(",") if y], "text": str}[setting.kind](text)


def is_stale(updated_at: float, now: float, after: float = 300.0) -> bool:
    """Whether a status of the agent is too old to be believed."""
    return now - updated_at > after
