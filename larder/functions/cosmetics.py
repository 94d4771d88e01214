"""Regulated cosmetic substances and the fragrance allergens that must be declared."""

from __future__ import annotations

# Substance (INCI), annex of Regulation (EC) 1223/2009, short reason.
REGULATED = [
    ("butylphenyl methylpropional", "II", "toxic for reproduction, category 1B"),
    ("methylisothiazolinone", "III", "sensitiser, rinse-off products only"),
    ("methylchloroisothiazolinone", "V", "rinse-off products, 0.0015 % in a 3:1 mixture"),
    ("triclosan", "V", "0.3 % at most, listed product types only"),
    ("formaldehyde", "II", "prohibited as such"),
    ("dmdm hydantoin", "V", "formaldehyde releaser, warning above 0.05 %"),
    ("imidazolidinyl urea", "V", "formaldehyde releaser, 0.6 % at most"),
    ("diazolidinyl urea", "V", "formaldehyde releaser, 0.5 % at most"),
    ("butylparaben", "V", "0.14 % at most as single ester"),
    ("propylparaben", "V", "0.14 % at most as single ester"),
    ("benzophenone-3", "VI", "UV filter under review"),
    ("homosalate", "VI", "UV filter, 7.34 % in face products"),
    ("octocrylene", "VI", "UV filter, limits of 2021"),
    ("talc", "III", "not in powders for children under three"),
    ("aluminium chlorohydrate", "III", "antiperspirant, limits by product type"),
]
# The 26 fragrance allergens.
FRAGRANCE_ALLERGENS = [
    "amyl cinnamal", "amylcinnamyl alcohol", "anisyl alcohol", "benzyl alcohol", "benzyl benzoate",
    "benzyl cinnamate", "benzyl salicylate", "cinnamal", "cinnamyl alcohol", "citral", "citronellol",
    "coumarin", "eugenol", "farnesol", "geraniol", "hexyl cinnamal", "hydroxycitronellal", "isoeugenol",
    "limonene", "linalool", "methyl 2-octynoate", "alpha-isomethyl ionone", "evernia prunastri",
    "evernia furfuracea", "butylphenyl methylpropional", "hydroxyisohexyl 3-cyclohexene carboxaldehyde",
]
FULL_LIST = 3
SEVERITY_ORDER = ["prohibited", "restricted", "allergen", "info"]
