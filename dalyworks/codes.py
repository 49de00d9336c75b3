"""Codes, labels and coefficients.

Everything in this module is a fixed value: results are only right when these
equal the published ones.
"""

BOUNDS = ("val", "upper", "lower")

# Columns that slice a burden extract. They are carried through every group
# key, so a multi-year, age- and sex-specific extract runs in one pass.
SLICES = ("sex_id", "age_id", "year")

WORLD_LOCATION = 1
WORLD_ISO = "WLD"
WORLD_NAME = "Global"

DEATHS, DALYS, YLDS, YLLS, PREVALENCE = 1, 2, 3, 4, 5
MEASURE_NAMES = {
    DEATHS: "Deaths",
    DALYS: "DALYs (Disability-Adjusted Life Years)",
    YLDS: "YLDs (Years Lived with Disability)",
    YLLS: "YLLs (Years of Life Lost)",
    PREVALENCE: "Prevalence",
}

NUMBER, PERCENT, RATE = 1, 2, 3
METRIC_NAMES = {NUMBER: "Number", PERCENT: "Percent", RATE: "Rate"}

ALL_CAUSES = 294
NONCOMMUNICABLE = 409
INJURIES = 687
MENTAL = 558

# Causes counted in full as mental disorders by the 2016 reallocation:
# mental disorders, dementias, Parkinson's disease, epilepsy, migraine,
# tension-type headache, self-harm, alcohol use, drug use.
FULL_CAUSES = (558, 543, 544, 545, 547, 548, 718, 560, 561)
# Chronic pain: low back pain and neck pain; half of other musculoskeletal.
PAIN_CAUSES = (630, 631)
HALF_PAIN_CAUSES = (639,)
PAIN_SHARE = {"val": 2 / 6, "lower": 1 / 6, "upper": 3 / 6}

RELATIVE_RISK = {
    NONCOMMUNICABLE: {"val": 1.8, "lower": 1.71, "upper": 1.88},
    INJURIES: {"val": 7.22, "lower": 6.43, "upper": 8.12},
}

PAF_POPULATION = "paf2"
PAF_CASES = "paf4"
FORMULAS = (PAF_POPULATION, PAF_CASES)

GBD, REALLOCATION, PAF, COMPOSITE = 1, 2, 3, 4
ESTIMATES = {
    GBD: "GBD 2019",
    REALLOCATION: "2016 reallocation approach",
    PAF: "PAF method",
    COMPOSITE: "Composite method",
}
ESTIMATE_LABELS = {
    GBD: "Original approach",
    REALLOCATION: "Reallocation approach",
    PAF: "PAF method",
    COMPOSITE: "Composite approach",
}
# The PAF method feeds the composite and is left out of tables and charts.
SHOWN_ESTIMATES = (GBD, REALLOCATION, COMPOSITE)

COPENHAGEN_LOW = 1000.0
COPENHAGEN_FACTOR = 5.0
GDP_FACTOR = 3.0
COSTS = ("cost_cc1", "cost_cc2", "cost_who1", "cost_who2", "cost_who3", "cost_who4")
CHART_COSTS = ("cost_cc1", "cost_cc2", "cost_who1", "cost_who2")
APPENDIX_COSTS = ("cost_cc1", "cost_cc2", "cost_who3", "cost_who4")
METRICS = ("number", "rate_per_100k", "percent") + COSTS

INCOME_LEVELS = {
    "H": (1, "High income"),
    "UM": (2, "Upper-middle income"),
    "LM": (3, "Lower-middle income"),
    "L": (4, "Low income"),
}

SCHEMES = ("who_region", "ihme_region")
REGION_ORDER = {
    "who_region": (
        "African Region", "Eastern Mediterranean Region", "European Region",
        "Region of the Americas", "South-East Asia Region", "Western Pacific Region", "#NA",
    ),
    "ihme_region": (
        "East Asia", "Southeast Asia", "Oceania", "Central Asia", "Eastern Europe",
        "Central Europe", "Caribbean", "Central Latin America", "Tropical Latin America",
        "Andean Latin America", "North Africa and Middle East", "Southern Sub-Saharan Africa",
        "Western Sub-Saharan Africa", "Central Sub-Saharan Africa", "Eastern Sub-Saharan Africa",
        "South Asia", "Southern Latin America", "Western Europe", "High-income North America",
        "Australasia", "High-income Asia Pacific", "#NA",
    ),
}
NOT_A_REGION = ("Global", "Other/Duplicates")

# Lower bin edges of the regional rate maps; the largest rate closes the last
# bin. Deaths are binned per 100,000, the other measures in thousands of that.
RATE_BREAKS = {
    DEATHS: (0, 1, 20, 40, 60, 80, 100, 120, 130, 140),
    DALYS: (1, 1.5, 2, 2.5, 3, 4, 5, 6, 7, 7.5),
    YLDS: (1, 1.25, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5),
    YLLS: (0, 0.25, 0.5, 0.75, 1, 1.5, 2, 2.5, 3, 3.5),
}
RATE_SCALE = {DEATHS: 1.0, DALYS: 1000.0, YLDS: 1000.0, YLLS: 1000.0}
PCT_GDP_LIMITS = (0.0, 20.0)

# Sensitivity analysis: published means, 95% intervals and ranges.
DRAW_SEED = 82420212
CI_WIDTH = 3.92
PREVALENCE_CI = (0.1304, 0.1212, 0.1402)
RISK_CI = (2.22, 2.12, 2.33)
DEATHS_CI = (56526959.51, 53742682.45, 59205883.0)
PREVALENCE_RANGE = (0.01, 0.2)
RISK_GRID = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
WIDE_PREVALENCE = (0.261, 0.05)
RISK_RANGE = (2.22 - 0.5, 2.72)
FORMULA_NAMES = {PAF_POPULATION: "TotalPop", PAF_CASES: "Cases"}

# Reference point of the discussion: an earlier projection, trillion USD.
EARLIER_PROJECTION = 2.9
