"""Rules for victims of crime (Quebec, IVAC)."""

# Patterns, labels, priorities and wordings of the published rule set.

PACK = {
    "id": "ivac",
    "version": "0.1.0",
    "name": "Indemnisation des victimes d'actes criminels",
    "language": "fr-CA",
    "identity": {
        "serials": [],
        "strong": [
            r"indemnisation\s*des\s*victimes\s*d.actes\s*criminels",
            r"\bIVAC\b",
            r"\bLAPVIC\b",
            r"\bLIVAC\b",
            r"personne\s*victime\s*d.infraction\s*criminelle",
            r"acte\s*criminel",
        ],
        "weak": [r"\bvictime\b", r"\bagression\b", r"r[ée]pertoire\s*des\s*cons[ée]quences"],
    },
    "vocabulary": {
        "milestone": "consolidation",
        "impairment": "séquelles permanentes",
        "impairment_long": "conséquences permanentes de l'infraction criminelle",
        "limitations": "limitations fonctionnelles",
    },
    "known_gaps": {
        "sequelles_permanentes": "the rating instrument that governs is not settled",
        "limitations_fonctionnelles": "same instrument question as sequelles_permanentes",
        "consolidation": "whether these files use the term at all is not settled",
    },
    "first_class_values": {
        "consolidation": {"tag": "KEY", "states": ["oui", "non", "trop_tot", "absent"]},
        "sequelles_permanentes": {
            "tag": "KEY", "states": ["rated", "aucune", "trop_tot", "absent"]},
        "limitations_fonctionnelles": {
            "tag": "KEY", "states": ["rated", "aucune", "trop_tot", "absent"]},
    },
    "unit_toggles": {
        "rapport_medical": True, "expertise": True, "note_consultation": True,
        "rapport_imagerie": True, "note_psychologie": True, "administratif": True,
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
         "body": [r"\bdiagnostic\b", r"cons[ée]quences?\s*permanentes?"],
         "confidence": 0.85},
        {"id": "expertise", "label": "Expertise médicale",
         "declares": [r"expertise\s*m[ée]dicale", r"expertise\s*psychiatrique"],
         "headings": [r"expertise\s*m[ée]dicale",
                      r"expertise\s*(?:psychiatrique|psychologique|orthop[ée]dique)"],
         "body": [r"s[ée]quelles?\s*permanentes?"], "confidence": 0.9},
        {"id": "note_psychologie", "label": "Note de psychologie",
         "declares": [r"note\s*de\s*psychologie", r"suivi\s*psychologique"],
         "headings": [r"note\s*de\s*psychologie", r"rapport\s*psychologique",
                      r"suivi\s*psychoth[ée]rapeutique"],
         "body": [r"\bTSPT\b", r"[ée]tat\s*de\s*stress\s*post-?traumatique",
                  r"\banxi[ée]t[ée]\b"], "confidence": 0.85},
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
        "session": {"cues": [r"\bdate\s*de\s*la\s*s[ée]ance", r"\bs[ée]ance\s*du\b"]},
        "surgery": {"cues": [r"\bdate\s*de\s*la\s*chirurgie", r"\bop[ée]r[ée]e?\s+le\b"]},
        "signature": {"cues": [r"\bsign[ée]e?\s*(?:[ée]lectroniquement\s*)?le\b"]},
        "report": {"cues": [r"\bdate\s*du\s*rapport"]},
        "event": {"cues": [
            r"\bdate\s*de\s*l.?\s*[ée]v[ée]nement", r"\bdate\s*de\s*l.?\s*infraction",
            r"\bdate\s*de\s*l.?\s*agression", r"\bfaits\s*survenus\s*le\b"]},
        "received": {"cues": [r"\bre[çc]u\s+le\b"]},
        "fax": {"cues": [r"\btransmis\s+le\b"]},
        "birth": {"cues": [r"\bdate\s*de\s*naissance", r"\bn[ée]e?\s+le\b"]},
        "death": {"cues": [r"\bdate\s*du\s*d[ée]c[èe]s", r"\bd[ée]c[ée]d[ée]e?\s+le\b"]},
    },
    "rule_table": {
        "rapport_medical": {"priority": ["exam", "visit", "signature", "report"]},
        "expertise": {"priority": ["exam", "report", "signature"]},
        "note_psychologie": {"priority": ["session", "visit", "exam", "signature"]},
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
                "amelioration": [
                    r"\bam[ée]lior", r"\bprogr[èe]s\b", r"\bgu[ée]rison\b",
                    r"\ben\s*r[ée]mission\b"],
                "deterioration": [
                    r"\bd[ée]t[ée]rior", r"\baggrav", r"\br[ée]gression\b",
                    r"\bd[ée]compensation\b"],
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
                r"\battribuable\s*[àa]\s*une\s*autre\s*cause\b",
                r"\bant[ée]c[ée]dents?\s*psychiatriques?\s*pr[ée]existants?\b"],
        },
        {
            "id": "intercurrent_event", "kind": "cue_span", "tag": "INF-H",
            "cues": [
                r"\bintercurrent", r"\brechute\b", r"\br[ée]cidive\b",
                r"\baggravation\b", r"\bnouvelle\s*agression\b",
                r"\bnouvel\s*[ée]v[ée]nement\s*traumatique\b"],
        },
        {
            "id": "preuve_de_survenance", "kind": "cue_span", "tag": "KEY",
            "cues": [
                r"\brapport\s*de\s*police\b", r"\bd[ée]claration\s*[àa]\s*la\s*police\b",
                r"\bplainte\s*d[ée]pos[ée]e\b",
                r"\bnum[ée]ro\s*d.[ée]v[ée]nement\s*policier\b", r"\bjugement\b"],
        },
        {
            "id": "lien", "kind": "cue_span", "tag": "KEY",
            "cues": [
                r"\blien\s*de\s*causalit[ée]\b",
                r"\ben\s*relation\s*avec\s*l.[ée]v[ée]nement\b",
                r"\bcons[ée]cutif\s*[àa]\s*l.agression\b",
                r"\battribuable\s*[àa]\s*l.infraction\b"],
        },
        {
            "id": "faute_lourde", "kind": "cue_span", "tag": "GAP",
            "cues": [r"\bfaute\s*lourde\b", r"\bcontribution\s*de\s*la\s*victime\b"],
        },
        {
            "id": "procured_by", "kind": "classify", "tag": "INF-H",
            "values": {
                "insurer_expert": [
                    r"\b[àa]\s*la\s*demande\s*de\s*(?:l.)?IVAC\b",
                    r"\bexpertise\s*m[ée]dicale\b", r"m[ée]decin\s*d[ée]sign[ée]"],
                "treating": [
                    r"\bm[ée]decin\s*traitant\b", r"\bm[ée]decin\s*de\s*famille\b",
                    r"\bpsychologue\s*traitant\b"],
            },
        },
    ],
    "evidence_weight": {
        "treating": "contestable", "insurer_expert": "contestable", "unknown": "unweighted",
    },
}

FILTERS = {
    "unconditional": [
        {"id": "ivac.filter.billing", "classes": ["administratif"],
         "matches": ["facture", r"num[ée]ro\s*de\s*facturation"], "reason": "billing"},
        {"id": "ivac.filter.consent",
         "matches": [r"formulaire\s*de\s*consentement", r"autorisation\s*de\s*divulgation"],
         "reason": "consent"},
    ],
    "conditional": [
        {"id": "ivac.filter.zero_content_admin",
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
        "sequelles_permanentes": "Séquelles permanentes : {value}",
        "consolidation": "Consolidation : {value}",
        "limitations_fonctionnelles": "Limitations fonctionnelles : {value}",
        "diagnostic": "Diagnostic : {value}",
        "trajectory": "{value}",
        "confounder": "Facteur confondant : {value}",
        "intercurrent_event": "Événement intercurrent : {value}",
        "procured_by": "Rapport obtenu : {value}",
        "preuve_de_survenance": "Preuve de survenance : {value}",
        "lien": "Lien de causalité : {value}",
        "faute_lourde": "Mention de faute lourde (à faire trancher) : {value}",
    },
    "continuation_line": "{value}",
    "index_fields": ["trajectory.enum", "evidence_weight"],
    "state_labels": {
        "sequelles_permanentes": {
            "rated": "oui", "aucune": "aucune", "trop_tot": "trop tôt pour se prononcer",
            "absent": "non renseignées au rapport"},
        "consolidation": {
            "oui": "oui", "non": "non", "trop_tot": "trop tôt pour se prononcer",
            "absent": "non renseignée au rapport"},
        "limitations_fonctionnelles": {
            "rated": "oui", "aucune": "aucune", "trop_tot": "trop tôt pour se prononcer",
            "absent": "non renseignées au rapport"},
        "procured_by": {
            "treating": "par le médecin traitant", "insurer_expert": "à la demande de l'IVAC"},
        "trajectory.enum": {
            "amelioration": "amélioration", "deterioration": "détérioration",
            "stable": "stationnaire", "unclassified": "évolution décrite, non classée"},
    },
}
