"""Rules for road accidents (Quebec automobile insurance, SAAQ)."""

# Patterns, labels, priorities and wordings of the published rule set.

PACK = {
    "id": "saaq",
    "version": "0.1.0",
    "name": "Société de l'assurance automobile du Québec",
    "language": "fr-CA",
    "identity": {
        "serials": [],
        "strong": [
            r"soci[ée]t[ée]\s*de\s*l.assurance\s*automobile",
            r"\bSAAQ\b",
            r"loi\s*sur\s*l.assurance\s*automobile",
            r"accident\s*d.automobile",
            r"\bIPNP\b",
        ],
        "weak": [
            r"\bstabilisation\b",
            r"atteinte\s*permanente\s*[àa]\s*l.int[ée]grit[ée]\s*physique\s*ou\s*psychique",
            r"\bvictime\b",
        ],
    },
    "vocabulary": {
        "milestone": "stabilisation",
        "impairment": "IPNP",
        "impairment_long": "atteinte permanente à l'intégrité physique ou psychique",
        "limitations": "limitations fonctionnelles",
    },
    "known_gaps": {
        "stabilisation":
            "no SAAQ form catalogued; needs a real bundle to author a template from",
        "ipnp": "no SAAQ form catalogued; needs a real bundle to author a template from",
        "limitations_fonctionnelles": "no SAAQ form catalogued; needs a real bundle",
    },
    "first_class_values": {
        "stabilisation": {"tag": "KEY", "states": ["oui", "non", "trop_tot", "absent"]},
        "ipnp": {"tag": "KEY", "states": ["rated", "aucune", "trop_tot", "absent"]},
        "limitations_fonctionnelles": {
            "tag": "KEY", "states": ["rated", "aucune", "trop_tot", "absent"]},
    },
    "unit_toggles": {
        "rapport_medical": True, "note_consultation": True, "rapport_imagerie": True,
        "expertise": True, "administratif": True,
    },
}

CLASSES = {
    "defaults": {
        "min_confidence": 0.7, "unknown_class": "unknown",
        "unknown_label": "Document non classé",
    },
    "classes": [
        {"id": "rapport_medical", "label": "Rapport médical",
         "headings": [r"rapport\s*m[ée]dical"],
         "body": [r"\bstabilisation\b", r"\bdiagnostic\b"], "confidence": 0.85},
        {"id": "expertise", "label": "Expertise médicale",
         "headings": [r"expertise\s*m[ée]dicale",
                      r"[ée]valuation\s*m[ée]dicale\s*ind[ée]pendante"],
         "body": [r"\bIPNP\b", r"atteinte\s*permanente"], "confidence": 0.85},
        {"id": "note_consultation", "label": "Note de consultation",
         "headings": [r"note\s*de\s*consultation", r"note\s*d.[ée]volution"],
         "confidence": 0.8},
        {"id": "rapport_imagerie", "label": "Rapport d'imagerie",
         "is_diagnostic_study": True,
         "headings": [r"rapport\s*d.?\s*imagerie",
                      r"\b(?:IRM|TDM|radiographie|[ée]chographie)\b"],
         "confidence": 0.85},
        {"id": "administratif", "label": "Document administratif", "is_admin": True,
         "headings": ["facture", r"^\s*re[çc]u\b", r"formulaire\s*de\s*consentement"],
         "body": [r"\btotal\b", r"num[ée]ro\s*de\s*facturation"], "confidence": 0.85},
    ],
}

DATES = {
    "roles": {
        "exam": {"cues": [r"\bdate\s*de\s*l.?\s*examen", r"\bexamin[ée]e?\s+le\b"]},
        "visit": {"cues": [
            r"\bdate\s*de\s*la\s*visite", r"\bdate\s*de\s*(?:la\s*)?consultation"]},
        "session": {"cues": [r"\bdate\s*de\s*la\s*s[ée]ance"]},
        "surgery": {"cues": [r"\bdate\s*de\s*la\s*chirurgie", r"\bop[ée]r[ée]e?\s+le\b"]},
        "signature": {"cues": [r"\bsign[ée]e?\s*(?:[ée]lectroniquement\s*)?le\b"]},
        "report": {"cues": [r"\bdate\s*du\s*rapport"]},
        "event": {"cues": [
            r"\bdate\s*de\s*l.?\s*accident", r"\bdate\s*de\s*l.?\s*[ée]v[ée]nement"]},
        "received": {"cues": [r"\bre[çc]u\s+le\b"]},
        "fax": {"cues": [r"\btransmis\s+le\b"]},
        "birth": {"cues": [r"\bdate\s*de\s*naissance", r"\bn[ée]e?\s+le\b"]},
    },
    "rule_table": {
        "rapport_medical": {"priority": ["exam", "visit", "signature", "report"]},
        "expertise": {"priority": ["exam", "report", "signature"]},
        "note_consultation": {"priority": ["visit", "exam", "signature"]},
        "rapport_imagerie": {"priority": ["exam", "report"]},
        "administratif": {"priority": ["report", "signature", "received"]},
        "unknown": {
            "priority": ["exam", "visit", "session", "surgery", "report", "signature"]},
    },
}

FIELDS = {
    "fields": [
        {
            "id": "trajectory", "kind": "free_text_with_enum", "tag": "INF-H",
            "cues_from_enum": True,
            "enum": {
                "amelioration": [r"\bam[ée]lior", r"\bprogr[èe]s\b", r"\bgu[ée]rison\b"],
                "deterioration": [
                    r"\bd[ée]t[ée]rior", r"\baggrav", r"\br[ée]gression\b"],
                "stable": [
                    r"\bstatu\s*quo\b", r"\bstationnaire\b", r"\binchang[ée]",
                    r"\bplateau\b"],
            },
        },
        {
            "id": "confounder", "kind": "cue_span", "tag": "INF-H",
            "cues": [
                r"\bconfondu[e]?[s]?\s*par\b",
                r"\bcondition\s*personnelle\s*pr[ée]existante\b",
                r"\battribuable\s*[àa]\s*une\s*autre\s*cause\b"],
        },
        {
            "id": "intercurrent_event", "kind": "cue_span", "tag": "INF-H",
            "cues": [
                r"\bintercurrent", r"\brechute\b", r"\br[ée]cidive\b",
                r"\baggravation\b", r"\bchute\b", r"\bnouvel\s*accident\b"],
        },
        {
            "id": "procured_by", "kind": "classify", "tag": "INF-H",
            "values": {
                "insurer_expert": [
                    r"\b[àa]\s*la\s*demande\s*de\s*la\s*SAAQ\b",
                    r"\bexpertise\s*m[ée]dicale\b",
                    r"m[ée]decin\s*d[ée]sign[ée]\s*par\s*la\s*SAAQ"],
                "treating": [
                    r"\bm[ée]decin\s*traitant\b", r"\bm[ée]decin\s*de\s*famille\b"],
            },
        },
    ],
    "evidence_weight": {
        "treating": "contestable", "insurer_expert": "contestable", "unknown": "unweighted",
    },
}

FILTERS = {
    "unconditional": [
        {"id": "saaq.filter.billing", "classes": ["administratif"],
         "matches": ["facture", r"num[ée]ro\s*de\s*facturation"], "reason": "billing"},
        {"id": "saaq.filter.consent",
         "matches": [r"formulaire\s*de\s*consentement", r"autorisation\s*de\s*divulgation"],
         "reason": "consent"},
    ],
    "conditional": [
        {"id": "saaq.filter.zero_content_admin",
         "when": "unit_has_no_clinical_content_and_class_is_admin",
         "reason": "zero_content_admin"},
    ],
}

OUTPUT = {
    "columns": [{"header": "Date"}, {"header": "Document"}, {"header": "Contenu"}],
    "rows": {
        "undated_heading": "SANS DATE — {n} documents à dater",
        "removed_heading": "RETIRÉ PAR RÈGLE — {n} document(s), conservés au dossier",
    },
    "title_line": {"author_suffix": " — {author}"},
    "row_content": {
        "suppress": [r"^\s*confidentiel", r"t[ée]l[ée]phone\s*\+?\d"],
        "repeat_is_furniture": 2,
    },
    "field_lines": {
        "ipnp": "Atteinte permanente : {value}",
        "stabilisation": "Stabilisation : {value}",
        "limitations_fonctionnelles": "Limitations fonctionnelles : {value}",
        "diagnostic": "Diagnostic : {value}",
        "trajectory": "{value}",
        "confounder": "Facteur confondant : {value}",
        "intercurrent_event": "Événement intercurrent : {value}",
        "procured_by": "Rapport obtenu : {value}",
    },
    "continuation_line": "{value}",
    "index_fields": ["trajectory.enum", "evidence_weight"],
    "state_labels": {
        "ipnp": {
            "rated": "oui", "aucune": "aucune", "trop_tot": "trop tôt pour se prononcer",
            "absent": "non renseignée au rapport"},
        "stabilisation": {
            "oui": "oui", "non": "non", "trop_tot": "trop tôt pour se prononcer",
            "absent": "non renseignée au rapport"},
        "limitations_fonctionnelles": {
            "rated": "oui", "aucune": "aucune", "trop_tot": "trop tôt pour se prononcer",
            "absent": "non renseignées au rapport"},
        "procured_by": {
            "treating": "par le médecin traitant",
            "insurer_expert": "à la demande de la SAAQ"},
        "trajectory.enum": {
            "amelioration": "amélioration", "deterioration": "détérioration",
            "stable": "stationnaire", "unclassified": "évolution décrite, non classée"},
    },
}
