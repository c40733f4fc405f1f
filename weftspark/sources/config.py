"""Small configurations, read on the driver: tsconfig files with comments, the authorship section, and rules about changes."""

from __future__ import annotations

import json
import os
import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass

_JSONC = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.DOTALL)
_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])')


def plain_json(text: str) -> str:
    """JSON with comments and last commas taken out, strings untouched."""
    return _COMMA.sub(lambda m: m[1] or "", _JSONC.sub(lambda m: m[1] or "", text))


def tsconfig_aliases(read: Callable[[str], str | None], path: str = "tsconfig.json") -> list[tuple[str, str, bool, str, str]]:
    """(prefix, suffix, wildcard, target, base_url) of a tsconfig and those that it extends.

    A child's ``baseUrl`` goes before its parent's; its ``paths`` replace them,
    and are relative to where they were told.
    """
    base, paths, paths_base, seen = None, None, "", set()
    while path and path not in seen and (text := read(path)) is not None:
        seen.add(path)
        config = json.loads(plain_json(text))
        options, folder = config.get("compilerOptions", {}), posixpath.dirname(path)
        own = posixpath.normpath(posixpath.join(folder, options["baseUrl"])) if "baseUrl" in options else None
        if paths is None and "paths" in options:
            paths, paths_base = options["paths"], own if own is not None else folder
        base = own if base is None else base
        parent = config.get("extends", "")
        path = posixpath.normpath(posixpath.join(folder, parent)) if parent.startswith(".") else ""
        if path and not path.endswith(".json"):
            path += ".json"
    out = []
    for pattern, targets in (paths or {}).items():
        prefix, star, suffix = pattern.partition("*")
        out += [(prefix, suffix, bool(star), t, paths_base.removeprefix(".")) for t in targets]
    if base is not None:
        out.append(("", "", True, "*", base.removeprefix(".")))
    return out


def yaml_section(text: str, section: str) -> dict[str, str | bool | int]:
    """Scalars right under a section of a YAML text: what configurations here hold, no more of the language."""
    out: dict[str, str | bool | int] = {}
    inside, indent = False, None
    for line in text.split("\n"):
        bare = re.sub(r"(^|\s)#.*$", "", line) if "'" not in line and '"' not in line else line
        if not bare.strip():
            continue
        depth = len(bare) - len(bare.lstrip())
        key, colon, value = bare.strip().partition(":")
        if not colon:
            raise ValueError(f"no key in {line!r}")
        if depth == 0:
            inside, indent = key == section and not value.strip(), None
        elif inside and (indent is None or depth == indent):
            indent, value = depth, value.strip()
            quoted = re.match(r"""(['"])(.*?)\1\s*(?:#.*)?$""", value)
            out[key] = quoted[2] if quoted else {"true": True, "false": False}.get(value.lower(), int(value) if re.fullmatch(r"-?\d+", value) else value)
    return out


def load_authorship(path: str | None, **flags) -> Authorship:
    """The section ``authorship`` of a YAML file, overridden by flags; a file that is not there has none."""
    section = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            section = yaml_section(f.read(), "authorship")
    return Authorship.of(section, **flags)


@dataclass(frozen=True)
class Authorship:
    enabled: bool = False
    store_email: str = "plain"
    commits_limit: int = 0
    commits_range: str = ""

    @classmethod
    def of(cls, section: dict | None, **flags) -> Authorship:
        """A section of a configuration file, overridden by flags that are given; bad values are errors."""
        known = {k: v for k, v in (section or {}).items() if k in cls.__dataclass_fields__}
        out = cls(**(known | {k: v for k, v in flags.items() if v is not None}))
        if out.store_email not in ("plain", "hash", "none"):
            raise ValueError(f"store_email {out.store_email!r}")
        if out.commits_limit < 0:
            raise ValueError(f"commits_limit {out.commits_limit}")
        return out


def glob_pattern(glob: str) -> tuple[str, str]:
    """Folders before a glob's first wild card, and a pattern for the whole text: ``*`` within a folder, ``**`` across, ``?`` one character."""
    plain = re.match(r"[^*?]*", glob)[0]
    out = []
    for part in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out.append({"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.sub(r"([^\w/ -])", r"\\\1", part))
    return plain[: plain.rfind("/") + 1], f"(?s)^{''.join(out)}$"


@dataclass(frozen=True)
class Gates:
    """Rules about changes, as a configuration holds them."""

    enforce: bool = False
    rules: tuple[tuple[str, str, int, str], ...] = ()
    critical: tuple[tuple[str, tuple[str, ...], int], ...] = ()
    stop_nodes: tuple[str, ...] = ()

    @classmethod
    def of(cls, config: dict, known: tuple[tuple[str, str, int], ...]) -> Gates:
        """``known`` (rule, level, most) with what ``config`` says instead; unknown rules, levels and modes are errors."""
        mode, told, rules = config.get("mode", "advisory"), dict(config.get("rules") or {}), []
        if mode not in ("advisory", "enforce"):
            raise ValueError(f"mode {mode!r}")
        for rule, level, most in known:
            own = told.pop(rule, None) or {}
            level = own.get("level", level)
            if level not in ("off", "warning", "error"):
                raise ValueError(f"level {level!r} of {rule}")
            limits = [int(v) for k, v in own.items() if k.startswith("max_")]
            rules.append((rule, level, limits[0] if limits else most, own.get("allow_label", "")))
        if told:
            raise ValueError(f"unknown rules {sorted(told)}")
        critical = tuple((a["name"], tuple(a.get("match") or ()), int(a.get("require_reviewers", 0))) for a in config.get("critical") or ())
        return cls(mode == "enforce", tuple(rules), critical, tuple(config.get("stop_nodes") or ()))

    def active(self, labels: tuple[str, ...] = ()) -> tuple[tuple[str, str, int], ...]:
        """(rule, level, most) of rules that are on and that no label of the change allows to be broken."""
        return tuple((r, level, most) for r, level, most, label in self.rules if level != "off" and (not label or label not in labels))

    def patterns(self) -> list[tuple[str, str, str, str]]:
        """(area, kind, prefix, pattern) of the critical areas."""
        return [(name, *_kind(glob)) for name, globs, _ in self.critical for glob in globs]

    def stops(self) -> list[tuple[str, str, str, str]]:
        """The same of the nodes that impact doesn't go beyond."""
        return [("stop", *_kind(glob)) for glob in self.stop_nodes]


def _kind(glob: str) -> tuple[str, str, str]:
    if glob.startswith("endpoint:"):
        return "endpoint", *glob_pattern(glob.removeprefix("endpoint:"))
    return "node" if "#" in glob else "path", *glob_pattern(glob)


def load_gates(path: str | None, known: tuple[tuple[str, str, int], ...]) -> Gates:
    """Rules of a JSON or, where PyYAML is there, YAML file; without a file the known ones."""
    if not path or not os.path.exists(path):
        return Gates.of({}, known)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return Gates.of(json.loads(plain_json(text)), known)
    import yaml

    return Gates.of(yaml.safe_load(text) or {}, known)
