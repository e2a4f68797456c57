"""Language references of the divergence rules (fixed values, made by divergence.fit_shares)."""

from __future__ import annotations

#: Common words by language.
COMMON = {
    "en": "the of and a to in it is that was for on with as be at by this had not".split(),
    "de": "der die das und in den von zu mit ist ein im sich des auf für nicht eine dem auch".split(),
    "fr": "de la le et les des en un une du que pour est dans qui par sur au pas plus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: Parts in 10,000 of upper-case letters, digits, white space, stops, symbols, non-ASCII characters and the rest.
CLASS_SHARES = {
    "en": [138, 5, 1666, 237, 0, 0, 7953],
    "de": [122, 4, 1546, 217, 0, 381, 7730],
    "fr": [103, 7, 1668, 237, 0, 905, 7080],
    "es": [118, 7, 1618, 229, 0, 778, 7250],
    "-": [129, 6, 1641, 233, 0, 292, 7699],
}
#: Parts in 10,000 of other words, then of each common word.
WORD_SHARES = {
    "en": [7731, 550, 286, 232, 138, 168, 117, 78, 105, 92, 68, 78, 65, 57, 52, 48, 42, 48, 45, 0, 0],
    "de": [7685, 547, 285, 98, 233, 164, 143, 116, 98, 80, 53, 46, 49, 76, 67, 64, 59, 46, 46, 47, 1],
    "fr": [7668, 552, 303, 221, 169, 141, 120, 113, 95, 72, 77, 66, 63, 61, 51, 51, 47, 44, 43, 44, 0],
    "es": [7667, 560, 289, 218, 168, 142, 113, 0, 107, 90, 73, 88, 70, 67, 56, 55, 51, 48, 50, 44, 43],
}
