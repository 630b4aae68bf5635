"""Rules for work accidents (Quebec workers' compensation, CNESST)."""

# Patterns, labels, priorities and wordings of the published rule set.  Results
# depend on every one of them and on their order.

PACK = {
    "id": "cnesst",
    "version": "0.1.0",
    "name": "Commission des normes, de l'équité, de la santé et de la sécurité du travail",
    "language": "fr-CA",
    "identity": {
        "serials": ["1918", "2064", "2118", "2923"],
        "strong": [
            r"commission\s*des\s*normes,?\s*de\s*l.[ée]quit[ée]",
            r"\bCNESST\b",
            r"\bCSST\b",
            r"sant[ée]\s*et\s*(?:de\s*la\s*)?s[ée]curit[ée]\s*du\s*travail",
            r"l[ée]sion\s*professionnelle",
            r"\bLATMP\b",
        ],
        "weak": [
            r"\bconsolidation\b",
            r"\bAPIPP\b",
            r"atteinte\s*permanente\s*[àa]\s*l.int[ée]grit[ée]",
            r"\btravailleur\b",
        ],
    },
    "vocabulary": {
        "milestone": "consolidation",
        "impairment": "APIPP",
        "impairment_long": "atteinte permanente à l'intégrité physique ou psychique",
        "limitations": "limitations fonctionnelles",
    },
    "first_class_values": {
        "consolidation": {"tag": "KEY", "states": ["oui", "non", "trop_tot", "absent"]},
        "apipp": {"tag": "KEY", "states": ["rated", "aucune", "trop_tot", "absent"]},
        "limitations_fonctionnelles": {
            "tag": "KEY", "states": ["rated", "aucune", "trop_tot", "absent"]},
    },
    "unit_toggles": {
        "rapport_evaluation_medicale": True,
        "rapport_medical": True,
        "note_consultation": True,
        "rapport_imagerie": True,
        "rapport_physiotherapie": True,
        "rapport_ergotherapie": True,
        "rapport_operatoire": True,
        "certificat_medical": True,
        "resultat_laboratoire": True,
        "note_evolution": True,
        "correspondance": False,
        "administratif": False,
    },
    "known_gaps": {},
    "relapse_cues": ["récidive", "rechute", "aggravation", r"\bRRA\b"],
}

CLASSES = {
    "defaults": {
        "min_confidence": 0.7,
        "unknown_class": "unknown",
        "unknown_label": "Document non classé",
    },
    "classes": [
        {
            "id": "rapport_evaluation_medicale",
            "label": "Rapport d'évaluation médicale",
            "short": "REM",
            "serials": ["2064"],
            "headings": [
                r"rapport\s*d.?\s*[ée]valuation\s*m[ée]dicale",
                r"bilan\s*des\s*s[ée]quelles",
                r"rappor[a-z]?\s*m\s*al",
            ],
            "body": [r"bar[èe]me", r"atteinte\s*permanente", r"d[ée]ficit\s*anatomo"],
            "confidence": 0.95,
        },
        {
            "id": "rapport_medical",
            "label": "Rapport médical",
            "short": "RM",
            "serials": ["1918", "1919"],
            "headings": [r"rapport\s*m[ée]dical", r"attestation\s*m[ée]dicale"],
            "body": ["consolidation", "diagnostic"],
            "confidence": 0.9,
        },
        {
            "id": "rapport_imagerie",
            "label": "Rapport d'imagerie",
            "short": "IMG",
            "declares": [
                r"protocole\s*clinique\s*radiologique",
                r"compte\s*rendu\s*radiologique",
            ],
            "headings": [
                r"rapport\s*d.?\s*imagerie",
                r"compte\s*rendu\s*radiologique",
                r"\b(irm|tdm|[ée]chographie|radiographie|scintigraphie)\b",
            ],
            "body": ["conclusion", "radiologiste"],
            "confidence": 0.9,
            "is_diagnostic_study": True,
        },
        {
            "id": "rapport_physiotherapie",
            "label": "Rapport de physiothérapie",
            "short": "PHYSIO",
            "headings": [
                r"rapport\s*de\s*physioth[ée]rapie",
                r"[ée]volution\s*en\s*physioth[ée]rapie",
            ],
            "body": [r"\bpht\b", r"physioth[ée]rapeute"],
            "confidence": 0.88,
        },
        {
            "id": "rapport_ergotherapie",
            "label": "Rapport d'ergothérapie",
            "short": "ERGO",
            "headings": [r"rapport\s*d.?\s*ergoth[ée]rapie"],
            "body": [r"\berg\b", r"ergoth[ée]rapeute"],
            "confidence": 0.88,
        },
        {
            "id": "rapport_operatoire",
            "label": "Rapport opératoire",
            "short": "OP",
            "headings": [r"protocole\s*op[ée]ratoire", r"rapport\s*op[ée]ratoire"],
            "body": ["intervention", "chirurgien"],
            "confidence": 0.9,
        },
        {
            "id": "note_medecine_famille",
            "label": "Note de médecine familiale",
            "short": "MF",
            "declares": [r"note\s*[-–—]\s*m[ée]decine\s*(?:de\s*)?famille"],
            "headings": [r"note\s*[-–—]\s*m[ée]decine\s*(?:de\s*)?famille"],
            "confidence": 0.92,
        },
        {
            "id": "note_travail_social",
            "label": "Note de travail social",
            "short": "TS",
            "declares": [r"note\s*[-–—]\s*travail\s*social"],
            "headings": [
                r"note\s*[-–—]\s*travail\s*social",
                r"[ée]valuation\s*du\s*fonctionnement\s*social",
            ],
            "confidence": 0.92,
        },
        {
            "id": "note_soins_infirmiers",
            "label": "Note de soins infirmiers",
            "short": "SI",
            "declares": [r"note\s*[-–—]\s*soins\s*infirmiers"],
            "headings": [r"note\s*[-–—]\s*soins\s*infirmiers"],
            "confidence": 0.92,
        },
        {
            "id": "note_psychologie",
            "label": "Note de psychologie",
            "short": "PSY",
            "declares": [r"note\s*[-–—]\s*(?:psychologie|psychoth[ée]rapie)"],
            "confidence": 0.9,
        },
        {
            "id": "note_consultation",
            "label": "Note de consultation",
            "short": "CONS",
            "declares": [r"note\s*[-–—]\s*consultation"],
            "headings": [
                r"note\s*de\s*consultation",
                r"note\s*clinique",
                r"consultation\s*externe",
            ],
            "body": ["subjectif", "objectif"],
            "confidence": 0.85,
        },
        {
            "id": "note_evolution",
            "label": "Note d'évolution",
            "short": "EVOL",
            "headings": [r"note\s*d.?\s*[ée]volution", "suivi"],
            "confidence": 0.8,
        },
        {
            "id": "expertise",
            "label": "Expertise médicale",
            "short": "EXP",
            "declares": [
                r"expertise\s*m[ée]dicale",
                r"opinion\s*m[ée]dicale\s*sur\s*dossier",
                r"bureau\s*d.[ée]valuation\s*m[ée]dicale",
            ],
            "headings": [
                r"expertise\s*m[ée]dicale",
                r"expertise\s*(?:orthop[ée]dique|psychiatrique|neurologique)",
                r"opinion\s*m[ée]dicale",
            ],
            "body": [
                r"m[ée]decin\s*d[ée]sign[ée]",
                r"[àa]\s*la\s*demande\s*de\s*l.employeur",
                r"\bB\.?E\.?M\.?\b",
            ],
            "confidence": 0.9,
        },
        {
            "id": "certificat_medical",
            "label": "Certificat médical",
            "short": "CM",
            "headings": [r"certificat\s*m[ée]dical"],
            "confidence": 0.88,
        },
        {
            "id": "resultat_laboratoire",
            "label": "Résultat de laboratoire",
            "short": "LAB",
            "headings": [
                r"r[ée]sultat\s*de\s*laboratoire",
                r"h[ée]mogramme",
                r"bilan\s*sanguin",
            ],
            "confidence": 0.85,
            "is_diagnostic_study": True,
        },
        {
            "id": "correspondance",
            "label": "Correspondance",
            "short": "CORR",
            "headings": [r"\bobjet\s*:", r"madame,\s*monsieur"],
            "confidence": 0.7,
        },
        {
            "id": "administratif",
            "label": "Document administratif",
            "short": "ADM",
            "is_admin": True,
            "headings": [
                "facture",
                r"^\s*re[çc]u\b",
                r"formulaire\s*de\s*consentement",
                r"autorisation\s*de\s*divulgation",
            ],
            "body": [
                r"num[ée]ro\s*de\s*facturation",
                r"\btotal\b",
                r"autorise\s*la\s*transmission",
                r"pour\s*d[ée]p[ôo]t\s*au\s*dossier",
            ],
            "confidence": 0.85,
        },
    ],
}

DATES = {
    "roles": {
        "exam": {"cues": [
            r"\bdate\s*de\s*l.?\s*examen", r"\bdate\s*d.?\s*examen",
            r"\bexamin[ée]e?\s+le\b", r"\bexamen\s+du\b"]},
        "visit": {"cues": [
            r"\bdate\s*de\s*la\s*visite", r"\bdate\s*de\s*(?:la\s*)?consultation",
            r"\bvu\s+le\b", r"\bvisite\s+du\b"]},
        "session": {"cues": [
            r"\bdate\s*de\s*la\s*s[ée]ance", r"\bs[ée]ance\s+du\b",
            r"\btraitement\s+du\b"]},
        "surgery": {"cues": [
            r"\bdate\s*de\s*(?:la\s*)?chirurgie", r"\bdate\s*de\s*l.?\s*intervention",
            r"\bop[ée]r[ée]e?\s+le\b"]},
        "signature": {"cues": [
            r"\bsign[ée]e?\s+(?:[ée]lectroniquement\s+|num[ée]riquement\s+)?le\b",
            r"\bapprouv[ée]e?\s+(?:[ée]lectroniquement\s+)?le\b",
            r"\bdate\s*de\s*(?:la\s*)?signature"]},
        "report": {"cues": [
            r"\bdate\s*du\s*rapport", r"\brapport\s+du\b",
            r"\bdate\s*de\s*r[ée]daction", r"\bdict[ée]e?\s+le\b"]},
        "event": {"cues": [
            r"\bdate\s*de\s*l.?\s*[ée]v[ée]nement", r"\bdate\s*de\s*l.?\s*accident",
            r"\bdate\s*de\s*la\s*l[ée]sion", r"\b[ée]v[ée]nement\s+du\b"]},
        "received": {"cues": [r"\bre[çc]ue?\s+le\b", r"\bdate\s*de\s*r[ée]ception"]},
        "fax": {"cues": [
            r"\bt[ée]l[ée]copie", r"\bfax\b", r"^\s*de\s*:", r"\bp\.\s*\d{3}\b"]},
        "print": {"cues": [r"\bimprim[ée]e?\s+le\b", r"\bdate\s*d.?\s*impression"]},
        "birth": {"cues": [r"\bdate\s*de\s*naissance", r"\bn[ée]e?\s+le\b", r"\bddn\b"]},
        "death": {"cues": [r"\bdate\s*du\s*d[ée]c[èe]s", r"\bd[ée]c[ée]d[ée]e?\s+le\b"]},
    },
    "rule_table": {
        "rapport_evaluation_medicale": {"priority": ["exam"]},
        "rapport_medical": {"priority": ["exam", "visit", "signature", "report"]},
        "rapport_imagerie": {"priority": ["exam", "report"]},
        "rapport_physiotherapie": {"priority": ["session", "visit", "report"]},
        "rapport_ergotherapie": {"priority": ["session", "visit", "report"]},
        "rapport_operatoire": {"priority": ["surgery", "exam", "report"]},
        "note_consultation": {"priority": ["visit", "exam", "signature"]},
        "note_medecine_famille": {"priority": ["visit", "exam", "signature", "report"]},
        "note_travail_social": {"priority": ["session", "visit", "signature", "report"]},
        "note_soins_infirmiers": {"priority": ["visit", "session", "signature", "report"]},
        "note_psychologie": {"priority": ["session", "visit", "signature", "report"]},
        "note_evolution": {"priority": ["visit", "session", "exam", "signature"]},
        "expertise": {"priority": ["exam", "report", "signature"]},
        "certificat_medical": {"priority": ["exam", "visit", "signature"]},
        "resultat_laboratoire": {"priority": ["exam", "report"]},
        "correspondance": {"priority": ["signature", "report"]},
        "administratif": {"priority": ["report", "signature"]},
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
                    r"\bam[ée]lior", r"\bprogr[èe]s\b",
                    r"\ben\s*voie\s*de\s*r[ée]solution\b", r"\bgu[ée]rison\b"],
                "deterioration": [
                    r"\bd[ée]t[ée]rior", r"\baggrav", r"\bempire\b",
                    r"\br[ée]gression\b"],
                "stable": [
                    r"\bstatu\s*quo\b", r"\bstationnaire\b", r"\binchang[ée]",
                    r"\bplateau\b"],
            },
        },
        {
            "id": "confounder", "kind": "cue_span", "tag": "INF-H",
            "cues": [
                r"\bconfondu[e]?[s]?\s*par\b",
                r"\battribuable\s*[àa]\s*une\s*autre\s*cause\b",
                r"\ben\s*raison\s*d.une\s*condition\s*personnelle\b",
                r"\bcondition\s*personnelle\s*pr[ée]existante\b"],
        },
        {
            "id": "intercurrent_event", "kind": "cue_span", "tag": "INF-H",
            "cues": [
                r"\bintercurrent", r"\brechute\b", r"\br[ée]cidive\b",
                r"\baggravation\b", r"\bchute\b"],
        },
        {
            "id": "claimed_but_unrated", "kind": "derived_claimed_sequelae", "tag": "INF-L",
            "cues": [
                r"\bs[ée]quelle[s]?\b", r"\blimitation[s]?\s*fonctionnelle[s]?\b",
                r"\batteinte\b"],
        },
        {
            "id": "procured_by", "kind": "classify", "tag": "INF-H",
            "values": {
                "insurer_expert": [
                    r"\bexpertise\s*m[ée]dicale\b",
                    r"\b[àa]\s*la\s*demande\s*de\s*l.employeur\b",
                    r"\bbureau\s*d.[ée]valuation\s*m[ée]dicale\b",
                    r"\bexamen\s*par\s*le\s*m[ée]decin\s*d[ée]sign[ée]\b"],
                "treating": [
                    r"\bm[ée]decin\s*traitant\b", r"\bm[ée]decin\s*de\s*famille\b",
                    r"\bmédecin\s*qui\s*a\s*charge\b"],
            },
        },
    ],
    "evidence_weight": {
        "treating": "binding_unless_displaced",
        "insurer_expert": "contestable",
        "unknown": "unweighted",
    },
}

FILTERS = {
    "unconditional": [
        {"id": "cnesst.filter.billing", "classes": ["administratif"],
         "matches": ["facture", r"num[ée]ro\s*de\s*facturation", r"\bRAMQ\b\s*facturation"],
         "reason": "billing"},
        {"id": "cnesst.filter.consent",
         "matches": [r"formulaire\s*de\s*consentement", r"autorisation\s*de\s*divulgation",
                     r"consentement\s*[àa]\s*la\s*communication"],
         "reason": "consent"},
        {"id": "cnesst.filter.transmission_only",
         "matches": [r"^page\s*de\s*garde", r"bordereau\s*de\s*transmission"],
         "reason": "transmission_cover_sheet"},
    ],
    "conditional": [
        {"id": "cnesst.filter.duplicate_of_included",
         "when": "unit_has_identical_duplicate_already_included", "reason": "duplicate"},
        {"id": "cnesst.filter.zero_content_admin",
         "when": "unit_has_no_clinical_content_and_class_is_admin",
         "reason": "zero_content_admin"},
        {"id": "cnesst.filter.out_of_claim_scope",
         "when": "unit_date_precedes_earliest_claim_event_and_no_rra_reference",
         "reason": "out_of_claim_scope"},
    ],
}

ABBREVIATIONS = {
    "ambiguous": [
        {"abbrev": "TDM", "tag": "GAP", "meanings": [
            {"text": "tomodensitométrie", "hints": [
                r"\brachis\b", r"\bcolonne\b", r"\bcr[âa]ne\b", r"\bthorax\b",
                r"\babdomen\b", r"\bavec\s*contraste\b"]},
            {"text": "trouble dépressif majeur", "hints": [
                r"\bd[ée]pressi", r"\bpsychiatr", r"\bhumeur\b", r"\banxi[ée]t[ée]\b"]}]},
        {"abbrev": "RRA", "tag": "GAP", "meanings": [
            {"text": "rechute, récidive ou aggravation", "hints": [
                r"\brechute\b", r"\br[ée]cidive\b", r"\baggravation\b", r"\bCNESST\b"]},
            {"text": "réadaptation", "hints": [r"\br[ée]adaptation\b", r"\bprogramme\b"]}]},
        {"abbrev": "EMG", "tag": "INF-H", "meanings": [
            {"text": "électromyographie", "hints": [
                r"\bnerf\b", r"\bconduction\b", r"\bradiculopathie\b", r"\bneuro"]}]},
        {"abbrev": "MI", "tag": "GAP", "meanings": [
            {"text": "membre inférieur", "hints": [
                r"\bjambe\b", r"\bgenou\b", r"\bcheville\b", r"\bsciatique\b",
                r"\blombaire\b"]},
            {"text": "infarctus du myocarde", "hints": [
                r"\bcardia", r"\bcoronar", r"\bthoracique\b"]}]},
        {"abbrev": "TRP", "tag": "GAP", "meanings": []},
    ],
}

OUTPUT = {
    "columns": [
        {"id": "date", "header": "Date"},
        {"id": "locator", "header": "Document"},
        {"id": "content", "header": "Contenu"},
    ],
    "locator": {
        "separator": " / ", "line_break_before_page": True, "page_prefix": "p. ",
        "show_doctype_code": False,
    },
    "rows": {
        "undated_heading": "SANS DATE — {n} documents à dater",
        "removed_heading": "RETIRÉ PAR RÈGLE — {n} document(s), conservés au dossier",
        "illegible_label": "Illisible",
        "second_hand_marker": "(cité dans {locator})",
        "ambiguous_date_marker": " (?)",
    },
    "title_line": {
        "template": "{class_label}{author_suffix}",
        "author_suffix": " — {author}",
    },
    "row_content": {
        "include_sections": [
            r"raison\s*de\s*la\s*(?:visite|consultation)",
            r"histoire\s*de\s*la\s*maladie",
            r"motif\s*de\s*(?:la\s*)?consultation",
            "subjectif", "objectif", "examen", "impression", "conclusion", "diagnostic",
            r"\bplan\b", "prescription", "recommandations?", "[ée]volution",
            "observations?", "interventions?", r"bilan\s*des\s*s[ée]quelles",
            r"limitations?\s*fonctionnelles?", r"atteinte\s*permanente", "consolidation",
            r"renseignements\s*cliniques", "technique",
        ],
        "exclude_sections": [
            "confidentiel", r"avis\s*de\s*confidentialit[ée]",
            r"ant[ée]c[ée]dents\s*familiaux",
        ],
        "suppress": [
            r"^\s*nom\s*du\s*patient",
            r"\bnam\s*:?\s*[A-Za-z]{4}\d",
            r"\bnaissance\s*:?\s*\d{4}-",
            r"date\s*de\s*naissance",
            r"^\s*\d{3}\s*rue\b",
            r",\s*(QC|Qu[ée]bec)\s+[A-Z]\d[A-Z]",
            r"date\s*d.?\s*expiration",
            r"sexe\s*[àa]\s*la\s*naissance",
            r"^\s*t[ée]l\.?\s*:",
            r"^\s*fax\s*:",
            r"^\s*\d+\s*(boul|boulevard|rue|av|avenue|chemin|ch\.)\b",
            r"^\s*dossier\s*:",
            r"^\s*n[°o]\s*de\s*dossier",
            r"t[ée]l[ée]phone\s*\+?\d",
            r"^\s*note\s*[-–—]\s*",
        ],
        "repeat_is_furniture": 2,
    },
    "field_lines": {
        "apipp": "Atteinte permanente : {value}",
        "consolidation": "Consolidation : {value}",
        "limitations_fonctionnelles": "Limitations fonctionnelles : {value}",
        "diagnostic": "Diagnostic : {value}",
        "bareme": "Barème {code} — {pct} %",
        "bareme_with_prior": "Barème {code} — {pct} % ({prior_pct} % sur antérieur)",
        "trajectory": "{value}",
        "confounder": "Facteur confondant : {value}",
        "intercurrent_event": "Événement intercurrent : {value}",
        "claimed_but_unrated": "Séquelle alléguée non retenue au barème : {value}",
        "procured_by": "Rapport obtenu : {value}",
        "abbreviation": "{value}",
    },
    "continuation_line": "{value}",
    "index_fields": ["trajectory.enum", "evidence_weight"],
    "state_labels": {
        "apipp": {
            "rated": "oui", "aucune": "aucune", "trop_tot": "trop tôt pour se prononcer",
            "absent": "non renseignée au rapport"},
        "limitations_fonctionnelles": {
            "rated": "oui", "aucune": "aucune", "trop_tot": "trop tôt pour se prononcer",
            "absent": "non renseignées au rapport"},
        "consolidation": {
            "oui": "oui", "non": "non", "trop_tot": "trop tôt pour se prononcer",
            "absent": "non renseignée au rapport"},
        "procured_by": {
            "treating": "par le médecin traitant",
            "insurer_expert": "à la demande de la partie adverse"},
        "trajectory.enum": {
            "amelioration": "amélioration", "deterioration": "détérioration",
            "stable": "stationnaire", "unclassified": "évolution décrite, non classée"},
    },
}

_TICKED = r"\[\s*[xX✓]\s*\]\s*"

TEMPLATES = [
    {
        "form": "1918", "revision": "2011-11", "doc_class": "rapport_medical", "tag": "KEY",
        "fields": [
            {"id": "consolidation", "kind": "checkbox", "tag": "KEY",
             "anchor": "consolidation",
             "states": {"oui": _TICKED + "Oui", "non": _TICKED + "Non"},
             "blank_state": "trop_tot", "absent_state": "absent"},
            {"id": "diagnostic", "kind": "section", "tag": "KEY",
             "under_heading": "diagnostic", "max_lines": 4},
        ],
    },
    {
        "form": "2064", "revision": "2012-06", "doc_class": "rapport_evaluation_medicale",
        "tag": "KEY",
        "fields": [
            {"id": "apipp", "kind": "checkbox", "tag": "KEY",
             "anchor": r"atteinte\s*permanente",
             "states": {"rated": _TICKED + "Oui", "aucune": _TICKED + "Non"},
             "blank_state": "trop_tot", "absent_state": "absent"},
            {"id": "limitations_fonctionnelles", "kind": "checkbox", "tag": "KEY",
             "anchor": r"limitations?\s*fonctionnelles?",
             "states": {"rated": _TICKED + "Oui", "aucune": _TICKED + "Non"},
             "blank_state": "trop_tot", "absent_state": "absent"},
            {"id": "consolidation", "kind": "checkbox", "tag": "KEY",
             "anchor": "consolidation",
             "states": {"oui": _TICKED + "Oui", "non": _TICKED + "Non"},
             "blank_state": "trop_tot", "absent_state": "absent"},
            {"id": "bareme", "kind": "table_rows", "tag": "KEY",
             "under_heading": r"bilan\s*des\s*s[ée]quelles",
             "row": r"^Code\s+(?P<code>\d[\d\s]*?)\s+(?P<pct>[\d]+(?:[.,°]\d+)?)\s*%",
             "prior_pct": r"(?P<prior>[\d]+(?:[.,]\d+)?)\s*%\s*sur\s*ant[ée]rieur",
             "emit_expected_count": True},
        ],
    },
]

FIRMS = {
    "demo": {
        "output": {
            "rows": {"undated_heading": "À DATER — {n} document(s)"},
            "field_lines": {"consolidation": "Lésion consolidée : {value}"},
        },
    },
}
