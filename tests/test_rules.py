"""Rule packs: complete, compilable, and restyled without touching their rules."""

import json
import re

import pytest

from chronoloom import rules


@pytest.mark.parametrize("pack_id", rules.INSTALLED)
def test_packs_are_sound(pack_id):
    pack = rules.load(pack_id)
    assert rules.lint(pack) == []
    for cls in pack.classes:
        for kind in ("headings", "body", "declares"):
            for pattern in cls.get(kind, []):
                re.compile(pattern, re.I)


def test_unknown_pack():
    with pytest.raises(KeyError):
        rules.load("none")
    with pytest.raises(KeyError):
        rules.load("cnesst", firm="none")


def test_firm_layer_restates_wording_only():
    base, styled = rules.load("cnesst"), rules.load("cnesst", firm="demo")
    assert styled.output["field_lines"]["consolidation"] == "Lésion consolidée : {value}"
    assert styled.output["field_lines"]["bareme"] == base.output["field_lines"]["bareme"]
    assert styled.classes == base.classes


def test_overlay_replaces_lists():
    assert rules.overlay({"a": {"x": [1, 2], "y": 1}}, {"a": {"x": [3]}}) == {"a": {"x": [3], "y": 1}}


def test_pack_from_folder(tmp_path):
    root = tmp_path / "mine"
    (root / "templates").mkdir(parents=True)
    (root / "pack.json").write_text(json.dumps({"id": "mine", "version": 3}), encoding="utf-8")
    (root / "classes.json").write_text(json.dumps({"classes": [{"id": "a", "label": "A"}]}), encoding="utf-8")
    pack = rules.load("mine", folder=str(tmp_path))
    assert (pack.id, pack.version, pack.class_labels["a"]) == ("mine", "3", "A")
