"""A rule pack for the test documents, whose words are invented.

The operators know no words of their own: with these rules they do on the documents what the
regime packs do on case files.
"""

from __future__ import annotations

from ...rules import Pack


def _pack(pack_id: str, strong: list[str], weak: list[str]) -> Pack:
    return Pack(pack_id, "1", {
        "pack": {"identity": {"serials": [], "strong": strong, "weak": weak}},
        "classes": {}, "dates": {}, "filters": {}, "fields": {}, "output": {}, "abbreviations": {},
    })


PROBE = Pack("probe", "1", {
    "pack": {"unit_toggles": {"listed": False}},
    "classes": {
        "defaults": {"min_confidence": 0.7, "unknown_class": "unknown", "unknown_label": "Other"},
        "classes": [
            {"id": "english", "label": "English", "headings": [r"\bthe\b"],
             "body": [r"\bwith\b", r"and\s*the"], "confidence": 0.9},
            {"id": "french", "label": "French", "declares": [r"\bavec le\b"],
             "headings": [r"\ble\b"], "body": [r"\bpour\b", r"de\s*la"], "confidence": 0.88},
            {"id": "german", "label": "German", "headings": [r"\bder\b"],
             "body": [r"\bnicht\b"], "confidence": 0.85},
            {"id": "spanish", "label": "Spanish", "headings": [r"\bque\b"],
             "body": [r"\bpara\b"], "confidence": 0.79, "is_diagnostic_study": True},
            {"id": "legal", "label": "Legal", "is_admin": True,
             "headings": ["license", "copyright"], "body": ["copyright", "license"],
             "confidence": 0.95},
        ],
    },
    "dates": {}, "filters": {
        "unconditional": [
            {"id": "probe.legal", "classes": ["legal"], "matches": ["copyright", "license"],
             "reason": "legal"},
            {"id": "probe.contact", "matches": [r"@", r"\bthe\b"], "reason": "contact"},
        ],
        "conditional": [
            {"id": "probe.unbuilt", "when": "a_condition_nobody_built", "reason": "none"},
            {"id": "probe.empty", "when": "unit_has_no_clinical_content_and_class_is_admin",
             "reason": "empty"},
        ],
    },
    "fields": {
        "fields": [
            {"id": "direction", "kind": "free_text_with_enum", "tag": "INF-H",
             "cues_from_enum": True,
             "enum": {"up": [r"\bthe\b", r"\bdie\b"], "down": [r"\bwith\b", r"\bavec\b"],
                      "flat": [r"\bsur\b"]}},
            {"id": "mention", "kind": "cue_span", "tag": "INF-H",
             "cues": [r"\bthis\b", r"\bpour\b", r"\bnicht\b"]},
            {"id": "origin", "kind": "classify", "tag": "INF-H",
             "values": {"north": [r"\band\b"], "south": [r"\bque\b", r"\bund\b"]}},
        ],
        "evidence_weight": {"north": "strong", "unknown": "none"},
    },
    "output": {
        "row_content": {
            "include_sections": [r"\bthe\b", r"\ble\b"], "exclude_sections": [r"\bder\b"],
            "suppress": [r"@", r"\bcopyright\b"], "repeat_is_furniture": 2,
        },
    },
    "abbreviations": {"ambiguous": [
        {"abbrev": "The", "tag": "GAP", "meanings": [
            {"text": "first", "hints": [r"\bwith\b"]},
            {"text": "second", "hints": [r"\band\b", r"\bof\b"]}]},
        {"abbrev": "Le", "tag": "GAP", "meanings": []},
    ]},
})

REGIMES = [
    _pack("east", [r"\bthe\b", r"\bof\b"], [r"\band\b", r"\bto\b"]),
    _pack("south", [r"\bque\b", r"\bpara\b"], [r"\bde\b"]),
    _pack("west", [r"\bavec\b", r"\bpour\b", r"de\s*la"], [r"\ble\b", r"\bnicht\b"]),
]
