"""Fixed values that results depend on.

Everything in this module is a constant of the analysis (taxonomies, bucket
midpoints, histogram edges, canonical names).  They are stated plainly, in
their natural order, and are turned into small DataFrames / map literals by
the helpers in ``snapdeck.functions``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the analysed hub's conventions for equal results.
# ---------------------------------------------------------------------------

# Canonical organisation types, in display order.
ORG_TYPES = ["company", "university", "non-profit", "community", "classroom", "government", "individual"]

# Licence slug -> (category, sub-category).  Unknown slugs fall back to Other.
LICENSE_TAXONOMY = {
    # Permissive
    "apache-2.0": ("Permissive", None), "mit": ("Permissive", None),
    "afl-3.0": ("Permissive", None), "artistic-2.0": ("Permissive", None),
    "bsl-1.0": ("Permissive", None), "bsd": ("Permissive", None),
    "bsd-2-clause": ("Permissive", None), "bsd-3-clause": ("Permissive", None),
    "bsd-3-clause-clear": ("Permissive", None), "ecl-2.0": ("Permissive", None),
    "isc": ("Permissive", None), "lppl-1.3c": ("Permissive", None),
    "ms-pl": ("Permissive", None), "mpl-2.0": ("Permissive", None),
    "ncsa": ("Permissive", None), "ofl-1.1": ("Permissive", None),
    "postgresql": ("Permissive", None), "unlicense": ("Permissive", None),
    "wtfpl": ("Permissive", None), "zlib": ("Permissive", None),
    "apple-ascl": ("Permissive", None), "openmdw-1.0": ("Permissive", None),
    "etalab-2.0": ("Permissive", None), "eupl-1.1": ("Permissive", None),
    "eupl-1.2": ("Permissive", None), "osl-3.0": ("Permissive", None),
    "agpl-3.0": ("Permissive", None), "gpl": ("Permissive", None),
    "gpl-2.0": ("Permissive", None), "gpl-3.0": ("Permissive", None),
    "lgpl": ("Permissive", None), "lgpl-2.1": ("Permissive", None),
    "lgpl-3.0": ("Permissive", None), "lgpl-lr": ("Permissive", None),
    "epl-1.0": ("Permissive", None), "epl-2.0": ("Permissive", None),
    "cc0-1.0": ("Permissive", None), "cc-by-2.0": ("Permissive", None),
    "cc-by-2.5": ("Permissive", None), "cc-by-3.0": ("Permissive", None),
    "cc-by-4.0": ("Permissive", None), "cc-by-sa-3.0": ("Permissive", None),
    "cc-by-sa-4.0": ("Permissive", None), "gfdl": ("Permissive", None),
    "pddl": ("Permissive", None), "odc-by": ("Permissive", None),
    "odbl": ("Permissive", None), "cdla-permissive-1.0": ("Permissive", None),
    "cdla-permissive-2.0": ("Permissive", None), "cdla-sharing-1.0": ("Permissive", None),
    "c-uda": ("Permissive", None),
    # AUP, BigTech
    "llama2": ("AUP", "BigTech"), "llama3": ("AUP", "BigTech"),
    "llama3.1": ("AUP", "BigTech"), "llama3.2": ("AUP", "BigTech"),
    "llama3.3": ("AUP", "BigTech"), "llama4": ("AUP", "BigTech"),
    "gemma": ("AUP", "BigTech"), "grok2-community": ("AUP", "BigTech"),
    # AUP, Community
    "openrail": ("AUP", "Community"), "openrail++": ("AUP", "Community"),
    "bigscience-openrail-m": ("AUP", "Community"),
    "creativeml-openrail-m": ("AUP", "Community"),
    "bigscience-bloom-rail-1.0": ("AUP", "Community"),
    "bigcode-openrail-m": ("AUP", "Community"),
    # Non-Commercial
    "cc-by-nc-2.0": ("Non-Commercial", None), "cc-by-nc-3.0": ("Non-Commercial", None),
    "cc-by-nc-4.0": ("Non-Commercial", None),
    "cc-by-nc-sa-2.0": ("Non-Commercial", None),
    "cc-by-nc-sa-3.0": ("Non-Commercial", None),
    "cc-by-nc-sa-4.0": ("Non-Commercial", None),
    "cc-by-nc-nd-3.0": ("Non-Commercial", None),
    "cc-by-nc-nd-4.0": ("Non-Commercial", None),
    "cc-by-nd-4.0": ("Non-Commercial", None),
    "apple-amlr": ("Non-Commercial", None),
    "deepfloyd-if-license": ("Non-Commercial", None),
    "fair-noncommercial-research-license": ("Non-Commercial", None),
    "h-research": ("Non-Commercial", None),
    "intel-research": ("Non-Commercial", None),
    # Other
    "cc": ("Other", None), "other": ("Other", None), "unknown": ("Other", None),
}

LICENSE_GROUPS = ["Permissive", "AUP (Community)", "AUP (BigTech)", "Non-Commercial", "Other", "unspecified"]

# Organisation groups of the licence breakdown (individuals are dropped there).
ORG_GROUPS = ["company", "public organisations"]

# size_categories bucket -> log10 midpoint of the row count.
SIZE_LOG10_MID = {
    "n<1K": 1.5, "1K<n<10K": 3.5, "10K<n<100K": 4.5, "100K<n<1M": 5.5,
    "1M<n<10M": 6.5, "10M<n<100M": 7.5, "100M<n<1B": 8.5, "1B<n<10B": 9.5,
    "10B<n<100B": 10.5, "100B<n<1T": 11.5, "n>1T": 12.5,
}

# Per-account histogram edges; bin = number of edges <= value.
HIST_EDGES = {
    "hs": [10.0 ** k for k in range(3, 13)],
    "hl": [1, 10, 100, 1_000, 10_000],
    "hd": [1, 10, 100, 1_000, 10_000, 100_000, 1_000_000],
}
HIST_COLS = {"hs": "mainSize", "hl": "likes", "hd": "downloadsAllTime"}

# Account-rank buckets of the size tile.
TOP_ACCOUNT_BUCKETS = [10, 100, 500, 1000, 2000]

# Pool sizes.
ORG_TREND_POOL = 2000
TOP_FREEFORM = 60

# Tag prefixes.
TASK_PREFIX = "task_categories:"
LICENSE_PREFIX = "license:"
ARXIV_PREFIX = "arxiv:"
SIZE_PREFIX = "size_categories:"
DATASET_PREFIX = "dataset:"

# Concentration cut points (top 1 %, 10 %, 50 % of items).
CONCENTRATION_PS = [0.01, 0.1, 0.5]

# Density smoothing.
DENSITY_BINS = 80
LOG_SIGMA = 0.12          # log10 units
RANK_SIGMA_BINS = 0.64    # bins

# Country (ISO-2 code) -> display region; unlisted codes are "Rest of World".
# CH, PL, FI and CZ are additions of this library, the other codes are the hub's.
COUNTRY_REGION = {
    "US": "United States", "CN": "China", "unknown": "Unknown",
    "ES": "Europe", "FR": "Europe", "GB": "Europe", "NL": "Europe", "DE": "Europe",
    "CH": "Europe", "PL": "Europe", "FI": "Europe", "CZ": "Europe",
}

# Snapshot dates of the dataset hub known to repeat the previous week.
KNOWN_FROZEN = ["2024-08-07", "2025-07-02", "2025-11-12", "2025-11-19", "2026-04-08", "2026-05-27", "2026-06-03"]
