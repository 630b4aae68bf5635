"""Written case files as line tables, with what the rules make of them.

A bundle is one string.  A line ``--- label`` opens a page and gives what is printed at its foot
(nothing: no label), ``^^^`` gives what a fax machine printed at the head; ``# `` and ``## `` mark
larger lines.  All people, places, findings and dates are invented; only the words that the rules
look for are given.
"""

from __future__ import annotations

import datetime as dt

TODAY = dt.date(2025, 6, 1)

BUNDLES = {
    # A form with a ticked box, a document of three labelled pages, a label that is no count.
    ("scierie", "Tome A"): """
--- 27
# CERTIFICAT MÉDICAL
Polyclinique des Érables
Date de l'examen: 2021-01-19
Diagnostic: Tendinite du poignet gauche
Signé: Dr Benoît Gauvreau
--- p. 1 de 3
# RAPPORT DE PHYSIOTHÉRAPIE
Centre Mobilis de Rimouski
Date de la séance: 2021-02-25
## ÉVALUATION
Force de préhension réduite de moitié.
--- p. 2 de 3
Extension passive complète, extension active à 35 degrés.
Test de Finkelstein douteux.
--- p. 3 de 3
## PLAN DE TRAITEMENT
Ultrasons et étirements, trois fois par semaine.
Signé: Karine Beaupré, pht
--- 1 de 1
# RAPPORT MÉDICAL
Commission des normes, de l'équité, de la santé et de la sécurité du travail
Formulaire 1918 (2011-11)
Nom du travailleur: OUELLET, Rachel
Date de naissance: 1969-11-03
Date de l'événement: 2021-01-08
Date de l'examen: 2021-03-30
## DIAGNOSTIC
Ténosynovite de De Quervain
## CONSOLIDATION
[x] Oui    [ ] Non
Signé: Dre Josée Pelchat, omnipraticienne
""",
    # Badly scanned pages: a broken heading and number, an interrupted document, a lost space, a
    # date with two readings, a document without a date and a page without text.
    ("archive", "Tome A"): """
---
# RÉSULTAT DE LABORATOIRE
Bilan lipidique
Glycémie à jeun normale.
--- p. 1 de 2
# NOTE DE CONSULTATION
Hôpital de la Baie
Date de la visite: 2019-10-21
## SUBJECTIF
Engourdissement des deux mains la nuit, depuis l'automne.
--- 1 de 2
# RAPPORTD'IMAGERIE
Examen: Échographie du coude
Date de l'examen: 2019-09-12
--- 2 de 2
## CONCLUSION
Épaississement du tendon commun des extenseurs.
Signé: Dre Noémie Larouche, radiologiste
--- p. 2 de 2
## PLAN
Orthèses nocturnes pour six semaines.
Signé: Dr Yvan Deschênes
---
--- 1 de 1
# RAPP0RI D EVAL
SANTÉ ET SÉCUR1TÉ DU TRAVAlL
Formulaire 2064 (2012-06)
Date de l'événement: 87-11-30
Date de l'examen: 89-02-27
## BILAN DES SÉQUELLES
Code 103 499    4 %
Code 210 087    3°1 %
[x] Oui   Atteinte permanente reconnue
Signé: Dre Odile Marchand, physiatre
--- 1 de 1
# CERTIFICAT MÉDICAL
Date de l'examen: 03-04-05
Diagnostic: Épicondylite latérale
Signé: Dr Yvan Deschênes
""",
    # Two folders that share documents: an equal one, one with a fax line, one that differs.
    ("deux_tomes", "Clinique"): """
--- 1 de 1
# RAPPORT D'IMAGERIE
Examen: Radiographie du genou
Date de l'examen: 2020-06-17
## CONCLUSION
Pincement du compartiment interne.
Signé: Dr Hubert Vaillancourt, radiologiste
--- 1 de 1
# NOTE DE CONSULTATION
Groupe médical du Fjord
Date de la visite: 2020-07-29
## SUBJECTIF
Marche possible sur trois cents mètres.
Signé: Dre Solange Morneau
--- 1 de 1
# NOTE DE CONSULTATION
Groupe médical du Fjord
Date de la visite: 2020-09-08
## SUBJECTIF
Genou stable, flexion à 110 degrés.
Signé: Dre Solange Morneau
""",
    ("deux_tomes", "Hôpital"): """
--- 1 de 1
# RAPPORT D'IMAGERIE
Examen: Radiographie du genou
Date de l'examen: 2020-06-17
## CONCLUSION
Pincement du compartiment interne.
Signé: Dr Hubert Vaillancourt, radiologiste
--- 1 de 1
^^^ DE: GROUPE DU FJORD   11/03/2021 08:05   P.004
# NOTE DE CONSULTATION
Groupe médical du Fjord
Date de la visite: 2020-07-29
## SUBJECTIF
Marche possible sur trois cents mètres.
Signé: Dre Solange Morneau
--- 1 de 1
# NOTE DE CONSULTATION
Groupe médical du Fjord
Date de la visite: 2020-12-14
## SUBJECTIF
Épanchement après une longue randonnée.
Signé: Dre Solange Morneau
""",
    # Papers that rules hold back, around one that stays.
    ("bureau", "Tome A"): """
--- 1
# REÇU
Reçu pour dépôt au dossier.
--- 2
# NOTE DE CONSULTATION
Hôpital de la Baie
Date de la visite: 2018-05-23
## SUBJECTIF
Raideur matinale de la nuque pendant une heure.
## OBJECTIF
Rotation droite limitée à 40 degrés.
Signé: Dr Yvan Deschênes
--- 3
# FORMULAIRE DE CONSENTEMENT
Autorisation de divulgation au comité de retour au travail
Date: 2018-05-24
Signé: Normand Picard
--- 4
# FACTURE
Numéro de facturation: 7731-B
Date: 2018-06-01
Orthèse cervicale ....... 140,50 $
Total ................... 140,50 $
""",
    # Statements that fields are read from, and a page that must give none.
    ("expertise", "Tome A"): """
--- 1
# NOTE DE CONSULTATION
Polyclinique des Érables
Date de la visite: 2017-03-15
## SUBJECTIF
Douleur à la hanche après deux heures debout.
## PLAN
Marche quotidienne de trente minutes.
Signé: Dr Benoît Gauvreau
--- 2
# EXPERTISE MÉDICALE
Examen par le médecin désigné, à la demande de l'employeur
Date de l'examen: 2017-08-02
## ÉVOLUTION
Nette amélioration du sommeil et de la marche depuis le printemps.
Les progrès restent confondus par une arthrose
ancienne de la hanche opposée.
## FAITS RÉCENTS
Le dossier mentionne une chute dans un escalier le 2017-06-11.
## SÉQUELLES
La travailleuse allègue des séquelles au genou gauche.
## BILAN DES SÉQUELLES
Code 103 499    4 %
Signé: Dr Rémi Talbot, orthopédiste
""",
    # Two regimes in one bundle.
    ("deux_regimes", "Tome A"): """
--- 1
# EXPERTISE MÉDICALE
Société de l'assurance automobile du Québec
Réclamation pour accident d'automobile
Date de l'examen: 2016-11-09
## CONCLUSION
Plateau atteint, IPNP estimée à 5 %.
Signé: Dr Rémi Talbot, orthopédiste
--- 2
# RAPPORT MÉDICAL
Commission des normes, de l'équité, de la santé et de la sécurité du travail
Formulaire 1918 (2011-11)
Date de l'événement: 2016-02-04
Date de l'examen: 2016-02-18
## DIAGNOSTIC
Contusion de l'avant-bras au poste d'emballage.
Signé: Dre Josée Pelchat, omnipraticienne
""",
}

# case -> {pages: (class, row date, date status, filter that holds it back)}, with re-join on.
UNITS = {
    "scierie": {
        (1,): ("certificat_medical", "2021-01-19", "resolved", None),
        (2, 3, 4): ("rapport_physiotherapie", "2021-02-25", "resolved", None),
        (5,): ("rapport_medical", "2021-03-30", "resolved", None)},
    "archive": {
        (1,): ("resultat_laboratoire", None, "undated", None),
        (2, 5): ("note_consultation", "2019-10-21", "resolved", None),
        (3, 4): ("rapport_imagerie", "2019-09-12", "resolved", None),
        (6,): ("unknown", None, "illegible", None),
        (7,): ("rapport_evaluation_medicale", "1989-02-27", "inferred", None),
        (8,): ("certificat_medical", "2003-04-05", "ambiguous", None)},
    "bureau": {
        (1,): ("administratif", None, None, "cnesst.filter.zero_content_admin"),
        (2,): ("note_consultation", "2018-05-23", "resolved", None),
        (3,): ("administratif", None, None, "cnesst.filter.consent"),
        (4,): ("administratif", None, None, "cnesst.filter.billing")},
    "deux_regimes": {
        (1,): ("expertise", "2016-11-09", "resolved", None),
        (2,): ("rapport_medical", "2016-02-18", "resolved", None)},
}

WIDTH, HEIGHT, EDGE = 612.0, 792.0, 60.0
#: Font size and distance to the next line, by mark.
SIZES = {"# ": (13.0, 21.0), "## ": (11.0, 18.0), "": (10.0, 16.0)}


def pages_of(text: str) -> list[dict]:
    out: list[dict] = []
    for line in text.strip("\n").split("\n"):
        if line.startswith("---"):
            out.append({"label": line[3:].strip(), "fax": "", "lines": []})
        elif line.startswith("^^^"):
            out[-1]["fax"] = line[3:].strip()
        else:
            mark = next(m for m in SIZES if line.startswith(m))
            out[-1]["lines"].append((line[len(mark):], *SIZES[mark]))
    return out


def placed(page: dict) -> list[tuple[str, float, float]]:
    """Text, font size and base line of everything printed on a page, from top to foot."""
    out, y = [], EDGE
    if page["fax"]:
        out.append((page["fax"], 8.0, 32.0))
    for text, size, step in page["lines"]:
        out.append((text, size, y))
        y += step
    if page["label"]:
        out.append((page["label"], 8.0, HEIGHT - 35.0))
    return out


def tables(spark):
    """(lines, pages) of all bundles; a bundle's id is ``case/folder``."""
    from chronoloom import schemas

    lines, pages = [], []
    for (case, folder), text in BUNDLES.items():
        bundle = f"{case}/{folder}"
        for number, page in enumerate(pages_of(text), 1):
            pages.append((case, bundle, number, WIDTH, HEIGHT))
            lines += [(case, bundle, number, i, t, size, 10.0, EDGE, y - size, WIDTH - EDGE, y,
                       HEIGHT) for i, (t, size, y) in enumerate(placed(page))]
    return (
        spark.createDataFrame(lines, schemas.LINES), spark.createDataFrame(pages, schemas.PAGES))
