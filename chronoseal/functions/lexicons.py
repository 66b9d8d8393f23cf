"""Lexicons. All pattern texts below are fixed values: results depend on them verbatim."""

from __future__ import annotations

# Post lexicon, matched without regard to case.
POST_LEXICON = {
    "fp": r"\b(eu|meu|minha|mim|comigo|me)\b",
    "neg": r"\b(triste|vazi[oa]|sozinh[oa]|solit[aá]ri[oa]|cansad[oa]|exaust[oa]|inutil|fracass|derrotad[oa]|desespero|sofrendo|doendo|machuca|arrepend|odei[oa]|horriv[eí]l|pior|terriv[eí]l|dific[ií]l|impossiv[eí]l|raiva|irritad[oa])\b",
    "active": r"(quero morrer|vou me matar|vontade de morrer|pensei em suic[ií]d|tentei suic[ií]d|queria me matar|acabar com minha vida|n[aã]o quero mais viver|quero sumir pra sempre)",
    "caregiver": r"(meu (pai|irm|primo|namorad|marido|amigo)|minha (m[aã]e|irm|prima|namorad|amiga|esposa|filh))[^.!?\n]{0,80}(depress|ansiedade|terapia|psic[oó]log|psiquiatr|rem[eé]dio|antidepressiv|suicid)",
    "third_party": r"((ele|ela|eles|elas|voc[eê]|algu[eé]m|pessoa|gente|amig[oa]|fam[ií]lia)[^.!?\n]{0,90}(depress|ansiedade|terapia|psic[oó]log|psiquiatr|rem[eé]dio|antidepressiv|suicid|morrer|morte|triste|ajuda)|(depress|ansiedade|terapia|psic[oó]log|psiquiatr|rem[eé]dio|antidepressiv|suicid|morrer|morte|triste|ajuda)[^.!?\n]{0,90}(ele|ela|eles|elas|voc[eê]|algu[eé]m|pessoa|gente|amig[oa]|fam[ií]lia))",
    "sleep": r"\b(ins[oô]nia|dormir|durmo|dormi|dormindo|sono|sem sono|acordad[oa]|virad[oa])\b",
    "fatigue": r"\b(cansad[oa]|exaust[oa]|esgotad[oa]|des[aâ]nimo|desanimad[oa]|sem energia|sem disposi[cç][aã]o|indispost[oa]|vontade de nada)\b",
    "cry_sad": r"\b(chor(ar|ei|o|ando)|triste|tristeza|bad|arrasad[oa]|p[eé]ssim[oa])\b",
    "anxiety": r"\b(ansiedade|ansios[oa]|p[aâ]nico|crise|surt(o|ei|ando)|nervos[oa])\b",
    "treatment": r"\b(terapia|psic[oó]log[ao]|psiquiatr[ao]|rem[eé]dio|medica[cç][aã]o|antidepressiv[oa]|fluoxetina|sertralina|rivotril)\b",
    "grief": r"\b(luto|falec(eu|er)|morreu|perdi|minha perda|meu luto|saudades?|enterro|vel[oó]rio)\b",
    "help_seeking": r"(preciso de ajuda|me ajuda|algu[eé]m me ajuda|socorro|n[aã]o sei o que fazer|n[aã]o aguento mais)",
    "support_outreach": r"(se precisar conversar|procure ajuda|busque ajuda|cvv|188|setembro amarelo|estou aqui|conte comigo|projeto|apoio psicol[oó]gico)",
}

# Lexical relevance patterns, matched on accent-folded text.
RELEVANCE_LEXICON = {
    "direct": r"\b(ansiedade|ansios[oa]s?|panico|sindrome do panico|ataque de panico|ataque de ansiedade|crise de ansiedade)\b",
    "self_token": r"\b(eu|me|mim|comigo|estou|to|tenho|tive|sinto|senti|minha ansiedade)\b",
    "acute": r"\b(falta de ar|coracao acelerado|taquicardia|palpitac(?:ao|oes)|tremor(?:es)?|hiperventil(?:acao|ando)|aperto no peito|suor frio|nausea|enjoo|desmai(?:o|ei)|formigamento)\b",
    "treatment": r"\b(terapia|psicolog[oa]|psiquiatr[oa]|remedio|medicacao|ansiolitic[oa]|rivotril|clonazepam|sertralina|fluoxetina|preciso de ajuda|me ajuda|socorro|nao sei o que fazer)\b",
    "recent": r"\b(agora|hoje|neste momento|nesse momento|acabei de|comecou|bateu|estou|to|tive)\b",
    "third_party": r"\b(meu pai|minha mae|meu irmao|minha irma|meu amigo|minha amiga|ele|ela|eles|elas|voce|alguem|procure ajuda|busque ajuda|conte comigo|apoio psicologico|projeto)\b",
}

# Points per lexical relevance signal.
RELEVANCE_POINTS = {
    "direct": 3,
    "self_experience": 2,
    "acute": 2,
    "treatment": 1,
    "recent": 1,
    "direct_and_acute": 1,
    "third_party": -4,
}

# Fixed value: keyword rule of the baseline override.
IDEATION_PATTERN = r"(me matar|suic[ií]d|quero morrer|vontade de morrer|não quero mais viver|nao quero mais viver)"

# Label vocabularies per lane (true side, false side).
LABEL_VOCABULARIES = {
    "corpus": (("1", "true", "yes", "y", "diagnosed", "d", "depressed"), ("0", "false", "no", "n", "control", "c", "not diagnosed")),
    "manifest": (("diagnosed", "yes"), ("control", "no")),
    "coded": (("1", "diagnosed"), ("0", "control")),
    "original": (("yes",), ("no",)),
    "specialist": (("signal",), ("no_signal",)),
}
