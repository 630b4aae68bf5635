"""Rule packs: what a regime's documents look like and how its results are worded.

A pack is plain data read once on the driver.  Operators turn it into Column expressions and
small rule tables; no task ever opens a pack.  A new regime is a new module here, or a folder
of JSON (or YAML, where a reader is installed) files given to ``load``.
"""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: The installed packs, in the order ties are settled.
INSTALLED = ("cnesst", "ivac", "saaq")

_SECTIONS = ("pack", "classes", "dates", "filters", "fields", "output", "abbreviations")
#: A house style may restate wording and switches, never the regime's own rules.
_STYLE_SECTIONS = ("output", "pack")


@dataclass(frozen=True)
class Pack:
    id: str
    version: str
    sections: dict[str, dict[str, Any]]
    templates: list[dict[str, Any]] = field(default_factory=list)
    firm: str | None = None

    @property
    def classes(self) -> list[dict[str, Any]]:
        return self.sections["classes"].get("classes", [])

    def _default(self, name: str, value: Any) -> Any:
        return self.sections["classes"].get("defaults", {}).get(name, value)

    @property
    def min_confidence(self) -> float:
        return self._default("min_confidence", 0.7)

    @property
    def unknown_class(self) -> str:
        return self._default("unknown_class", "unknown")

    @property
    def class_labels(self) -> dict[str, str]:
        labels = {self.unknown_class: self._default("unknown_label", "Document non classé")}
        return labels | {c["id"]: c["label"] for c in self.classes}

    @property
    def class_codes(self) -> dict[str, str]:
        return {c["id"]: c["short"] for c in self.classes if c.get("short")}

    @property
    def studies(self) -> list[str]:
        return [c["id"] for c in self.classes if c.get("is_diagnostic_study")]

    @property
    def admin_classes(self) -> list[str]:
        return [c["id"] for c in self.classes if c.get("is_admin")]

    @property
    def switched_off(self) -> list[str]:
        toggles = self.sections["pack"].get("unit_toggles", {})
        return [name for name, on in toggles.items() if not on]

    @property
    def identity(self) -> dict[str, list[str]]:
        return self.sections["pack"].get("identity", {})

    @property
    def known_gaps(self) -> dict[str, str]:
        return self.sections["pack"].get("known_gaps", {})

    @property
    def role_cues(self) -> dict[str, list[str]]:
        roles = self.sections["dates"].get("roles", {})
        return {name: spec.get("cues", []) for name, spec in roles.items()}

    @property
    def priorities(self) -> dict[str, list[str]]:
        table = self.sections["dates"].get("rule_table", {})
        return {name: spec.get("priority", []) for name, spec in table.items()}

    @property
    def text_filters(self) -> list[dict[str, Any]]:
        return self.sections["filters"].get("unconditional") or []

    @property
    def fact_filters(self) -> list[dict[str, Any]]:
        return self.sections["filters"].get("conditional") or []

    @property
    def cue_fields(self) -> list[dict[str, Any]]:
        return self.sections["fields"].get("fields", [])

    @property
    def evidence_weight(self) -> dict[str, str]:
        return self.sections["fields"].get("evidence_weight", {})

    @property
    def abbreviations(self) -> list[dict[str, Any]]:
        return self.sections["abbreviations"].get("ambiguous", [])

    @property
    def output(self) -> dict[str, Any]:
        return self.sections["output"]

    @property
    def row_content(self) -> dict[str, Any]:
        return self.output.get("row_content", {})

    @property
    def first_class_values(self) -> dict[str, Any]:
        return self.sections["pack"].get("first_class_values", {})

    @property
    def relapse_cues(self) -> list[str]:
        cues = list(self.sections["pack"].get("relapse_cues", []))
        for rule in self.sections["pack"].get("screening", []):
            cues.extend(rule.get("when_text_matches", []))
        return cues


def overlay(base: dict[str, Any], layer: dict[str, Any]) -> dict[str, Any]:
    """``layer`` over ``base``: nested mappings merge, any other value is replaced."""
    merged = {**base, **layer}
    for name in base.keys() & layer.keys():
        if isinstance(base[name], dict) and isinstance(layer[name], dict):
            merged[name] = overlay(base[name], layer[name])
    return merged


def _read_file(folder: Path, name: str) -> dict[str, Any]:
    as_json = folder / f"{name}.json"
    if as_json.exists():
        return json.loads(as_json.read_text(encoding="utf-8"))
    as_yaml = folder / f"{name}.yaml"
    if as_yaml.exists():
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError(f"{as_yaml} needs a YAML reader; convert it to JSON") from missing
        return yaml.safe_load(as_yaml.read_text(encoding="utf-8")) or {}
    return {}


def _from_folder(folder: Path, firm: str | None) -> tuple[dict, list, dict]:
    sections = {name: _read_file(folder, name) for name in _SECTIONS}
    stems = sorted({p.stem for p in (folder / "templates").glob("*")})
    templates = [_read_file(folder / "templates", stem) for stem in stems]
    style = {}
    if firm:
        if not (folder / "firms" / firm).is_dir():
            raise KeyError(f"unknown firm layer: {firm}")
        style = {name: _read_file(folder / "firms" / firm, name) for name in _STYLE_SECTIONS}
    return sections, templates, style


def _from_module(pack_id: str, firm: str | None) -> tuple[dict, list, dict]:
    module = importlib.import_module(f"{__name__}.{pack_id}")
    sections = {name: getattr(module, name.upper(), {}) for name in _SECTIONS}
    firms = getattr(module, "FIRMS", {})
    if firm and firm not in firms:
        raise KeyError(f"unknown firm layer: {firm}")
    return sections, getattr(module, "TEMPLATES", []), firms.get(firm, {})


def load(pack_id: str, *, folder: str | None = None, firm: str | None = None) -> Pack:
    """A pack by id, from ``folder/<id>/`` or from the installed ones, with a house style."""
    if folder is not None:
        root = Path(folder) / pack_id
        if not root.is_dir():
            raise KeyError(f"unknown pack: {pack_id}")
        sections, templates, style = _from_folder(root, firm)
    elif pack_id in INSTALLED:
        sections, templates, style = _from_module(pack_id, firm)
    else:
        raise KeyError(f"unknown pack: {pack_id}")
    for name in _STYLE_SECTIONS:
        if style.get(name):
            sections[name] = overlay(sections[name], style[name])
    meta = sections["pack"]
    return Pack(
        meta.get("id", pack_id), str(meta.get("version", "0")), sections, templates, firm
    )


def versions() -> dict[str, str]:
    return {pack_id: load(pack_id).version for pack_id in INSTALLED}


def lint(pack: Pack) -> list[str]:
    """Declared but unreadable values, and classes without a date rule."""
    from_templates = {f["id"] for t in pack.templates for f in t["fields"]}
    readable = from_templates | {f["id"] for f in pack.cue_fields} | set(pack.known_gaps)
    problems = [f"value {v} has no reader" for v in pack.first_class_values if v not in readable]
    problems += [
        f"class {c['id']} has no date rule" for c in pack.classes
        if c["id"] not in pack.priorities
    ]
    return problems
