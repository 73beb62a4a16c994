"""Fixed values that results depend on: units, frequencies, patterns, splits. Stated plainly, in natural order."""

# Dose units as (dimension, factor to the dimension's base unit, spellings).
DOSE_UNITS = (
    ("mass_mg", 1e-9, ("PG", "PICOGRAM", "PICOGRAMS")),
    ("mass_mg", 1e-6, ("NG", "NANOGRAM", "NANOGRAMS")),
    ("mass_mg", 1e-3, ("UG", "MCG", "MICROGRAM", "MICROGRAMS")),
    ("mass_mg", 1.0, ("MG", "MILLIGRAM", "MILLIGRAMS")),
    ("mass_mg", 1e3, ("G", "GM", "GRAM", "GRAMS")),
    ("mass_mg", 1e6, ("KG", "KILOGRAM", "KILOGRAMS")),
    ("mass_mg_per_kg", 1e-3, ("UG/KG", "MCG/KG")),
    ("mass_mg_per_kg", 1.0, ("MG/KG",)),
    ("mass_mg_per_kg", 1e3, ("G/KG", "GM/KG")),
    ("mass_mg_per_m2", 1e-3, ("UG/M2", "MCG/M2")),
    ("mass_mg_per_m2", 1.0, ("MG/M2",)),
    ("mass_mg_per_m2", 1e3, ("G/M2", "GM/M2")),
    ("volume_ml", 1e-3, ("UL", "MICROLITER", "MICROLITERS")),
    ("volume_ml", 1.0, ("ML", "CC", "MILLILITER", "MILLILITERS")),
    ("volume_ml", 1e3, ("L", "LITER", "LITERS")),
    ("activity_iu", 1.0, ("IU",)),
    ("activity_iu", 1e3, ("KIU",)),
    ("activity_iu", 1e6, ("MIU",)),
    ("activity_iu_per_kg", 1.0, ("IU/KG",)),
    ("equivalent_meq", 1.0, ("MEQ",)),
    ("substance_mmol", 1e-3, ("UMOL",)),
    ("substance_mmol", 1.0, ("MMOL",)),
    ("substance_mmol", 1e3, ("MOL",)),
    ("radioactivity_mbq", 1e-6, ("BQ",)),
    ("radioactivity_mbq", 1e-3, ("KBQ",)),
    ("radioactivity_mbq", 1.0, ("MBQ",)),
    ("radioactivity_mbq", 1e3, ("GBQ",)),
    ("radioactivity_mbq", 37000.0, ("CI",)),
    ("radioactivity_mbq", 37.0, ("MCI",)),
    ("radioactivity_mbq", 0.037, ("UCI",)),
    ("radioactivity_mbq", 0.000037, ("NCI",)),
)
# Label of each dimension's base unit.
BASE_UNITS = {
    "mass_mg": "mg", "mass_mg_per_kg": "mg/kg", "mass_mg_per_m2": "mg/m2", "volume_ml": "mL", "activity_iu": "IU",
    "activity_iu_per_kg": "IU/kg", "equivalent_meq": "mEq", "substance_mmol": "mmol", "radioactivity_mbq": "MBq",
}
# Administrations a day of each frequency code.
PER_DAY = {
    "DAILY": 1.0, "QD": 1.0, "QAM": 1.0, "HS": 1.0, "BID": 2.0, "TID": 3.0, "QID": 4.0, "Q12H": 2.0, "Q8H": 3.0, "Q6H": 4.0,
    "Q5H": 4.8, "Q4H": 6.0, "Q3H": 8.0, "Q2H": 12.0, "QH": 24.0, "QOD": 0.5, "QW": 1 / 7, "/WK": 1 / 7, "TIW": 3 / 7,
    "Q3W": 1 / 21, "QOW": 1 / 14, "QM": 12 / 365.25, "/MONTH": 12 / 365.25, "/YR": 1 / 365.25, "1/YR": 1 / 365.25,
}
# Keywords of indication groups.
INDICATIONS = {
    "malignancy": r"MALIGN|CANCER|CARCINOMA|NEOPLASM|TUMOU?R|LEUKA?EMIA|LYMPHOMA|MYELOMA|SARCOMA|MELANOMA|METAST",
    "cardio": r"CARDI|HEART|HYPERTENS|CORONARY|ARRHYTH|ATRIAL|MYOCARD|ANGINA|STROKE|THROMB|EMBOL|HYPERLIP|DYSLIP",
    "infection": r"INFECT|PNEUMON|SEPSIS|SEPTIC|VIRAL|BACTERI|FUNG|COVID|INFLUENZA|HEPATITIS|\bHIV\b|TUBERCUL|ABSCESS",
}
# Words of routes and forms.
ROUTES = {
    "oral": r"ORAL|BY MOUTH|(^|[^A-Z])PO([^A-Z]|$)",
    "parenteral": r"INTRAVENOUS|INTRAMUSCULAR|SUBCUTANEOUS|INFUSION|PARENTERAL|(^|[^A-Z])(IV|IM|SC)([^A-Z]|$)",
    "topical": r"TOPICAL|DERMAL|CUTANEOUS|TRANSDERMAL",
}
FORMS = {"solid": r"TABLET|CAPSULE|CAPLET", "liquid": r"SOLUTION|SUSPENSION|SYRUP|LIQUID", "injectable": r"INJECT|INFUS|PARENTERAL"}
DOSE_ROUTES = {
    "iv": r"INTRAVENOUS|(^|[^A-Z])IV([^A-Z]|$)",
    "sc": r"SUBCUTANEOUS|SUBCUT|(^|[^A-Z])SC([^A-Z]|$)",
    "im": r"INTRAMUSCULAR|(^|[^A-Z])IM([^A-Z]|$)",
}
DOSE_PARENTERAL = r"INTRAVENOUS|INTRAMUSCULAR|SUBCUTANEOUS|SUBCUT|INFUSION|PARENTERAL|(^|[^A-Z])(IV|IM|SC)([^A-Z]|$)"
# ATC classes of high risk, by first letter and by prefix of four.
ATC_RISK_LETTERS, ATC_RISK_GROUPS = ("N", "B", "C", "M"), ("N02A", "B01A", "M01A", "A10A")
# Quarters of the splits.
SPLITS = {
    "gnn-small": {"train": [f"2023Q{q}" for q in range(1, 5)], "validation": ["2024Q1"], "test": ["2024Q2"]},
    "gnn-full": {"train": [f"{y}Q{q}" for y in range(2019, 2024) for q in range(1, 5)], "validation": ["2024Q1"], "test": ["2024Q2"]},
}
# Parts of drug names that say nothing of the ingredient.
NAME_MARKS = "[®™]"
NAME_BRACKETS = r"\[[^\]]*\]"
NAME_ORDINAL = r"^\s*\d{1,4}[.)]?\s+(?=[A-Z])"
NAME_DOSE = r"(?:\d+(?:\.\d+)?|\.\d+)\s*(?:MCG|UG|MG|G|KG|ML|L|IU|UNIT(?:S)?|MEQ|MMOL|%)"
NAME_FORM_TAIL = r"\s*[\[(](?:CAPSULES?|TABLETS?|INJECTIONS?|SOLUTIONS?|SUSPENSIONS?|CREAMS?|OINTMENTS?|PATCH(?:ES)?|SPRAYS?|SYRUPS?|POWDERS?|GELS?)[\])]\s*$"
NAME_RELEASE = r"\s+(?:ER|XR|CR|SR|DR|IR|XL|LA|SA|EXTENDED RELEASE|SUSTAINED RELEASE|CONTROLLED RELEASE|DELAYED RELEASE)\s*$"
NAME_SALTS = r"\b(?:HYDROCHLORIDE|HCL|SODIUM|POTASSIUM|SULFATE|SULPHATE|MALEATE|FUMARATE)\b"
NAME_FORMS = r"\b(?:CAPSULES?|TABLETS?|INJECTIONS?|INJECTABLE|SOLUTIONS?|SUSPENSIONS?|ORAL|TOPICAL|OPHTHALMIC|OTIC|NASAL|RECTAL|VAGINAL|SUBLINGUAL)\b"

#: Names of units of age.
AGE_UNITS = {
    "YR": ("YR", "YEAR", "YEARS"),
    "MON": ("MON", "MO", "MONTH", "MONTHS"),
    "WK": ("WK", "WEEK", "WEEKS"),
    "DY": ("DY", "DAY", "DAYS"),
    "HR": ("HR", "HOUR", "HOURS"),
    "DEC": ("DEC", "DECADE", "DECADES"),
}
