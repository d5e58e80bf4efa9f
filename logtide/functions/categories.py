"""Fixed category lists and the Columns that apply them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed: world regions and their countries; any other country is "Other".
WORLD_REGIONS = {
    "Asia": ["China", "Japan", "South Korea", "India", "Taiwan", "Singapore", "Thailand",
             "Indonesia", "Malaysia", "Vietnam", "Philippines", "Bangladesh", "Pakistan",
             "Hong Kong", "Israel"],
    "Americas": ["United States", "Canada", "Brazil", "Mexico", "Argentina", "Chile", "Colombia",
                 "Peru"],
    "Europe": ["United Kingdom", "Germany", "France", "Spain", "Italy", "Netherlands",
               "Switzerland", "Sweden", "Denmark", "Belgium", "Finland", "Norway", "Austria",
               "Poland", "Czech Republic", "Portugal", "Ireland", "Greece", "Hungary", "Romania",
               "Russia", "Turkey", "Ukraine"],
    "Oceania": ["Australia", "New Zealand"],
    "Africa": ["South Africa", "Egypt", "Nigeria", "Kenya", "Morocco"],
    "Middle East": ["Saudi Arabia", "Iran", "UAE"],
}

# Fixed: regions of the reuse analysis, tried in this order; any other country is "Other".
REUSE_REGIONS = {
    "LMIC": ["Bangladesh", "Brazil", "China", "Colombia", "Ecuador", "Egypt", "India",
             "Indonesia", "Iran", "Iraq", "Kenya", "Malaysia", "Mexico", "Morocco", "Nigeria",
             "Pakistan", "Peru", "Philippines", "South Africa", "Thailand", "Turkey", "Ukraine",
             "Vietnam"],
    "East Asia": ["China", "Japan", "South Korea", "Taiwan", "Hong Kong", "Singapore"],
    "North America": ["United States", "Canada"],
    "Europe": ["United Kingdom", "Germany", "France", "Spain", "Italy", "Netherlands",
               "Switzerland", "Sweden", "Denmark", "Belgium", "Finland", "Norway", "Austria",
               "Poland", "Ireland", "Portugal", "Greece", "Hungary", "Czech Republic", "Czechia",
               "Romania"],
}

# Fixed: file types by suffix of the lower-cased name, tried in this order.
FILE_TYPES = {
    "raw": [".raw", ".d", ".wiff", ".baf", ".tdf"],
    "processed_spectra": [".mgf", ".mzml", ".mzxml", ".ms2", ".mzml.gz"],
    "result": [".mzid", ".mzid.gz", ".pep.xml", ".pepxml", ".prot.xml", ".protxml",
               ".mztab", ".mztab.gz"],
    "tabular": [".csv", ".tsv", ".txt", ".xlsx", ".xls"],
    "database": [".fasta", ".fasta.gz", ".fa", ".fa.gz"],
    "metadata": [".xml", ".sdrf.tsv", ".sdrf"],
    "compressed": [".zip", ".tar", ".gz", ".7z", ".rar"],
}

# Fixed: what a file type is reused for; anything else is archives_other.
REUSE_CLASSES = {
    "full_reanalysis": ["raw", "processed_spectra"],
    "lightweight_reuse": ["result", "tabular", "database", "metadata"],
}


def _lookup(key: Column, groups: dict[str, list[str]], otherwise: str) -> Column:
    out = None
    for name, members in groups.items():
        cond = key.isin(*members)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)


def world_region(country: Column) -> Column:
    return _lookup(country, WORLD_REGIONS, "Other")


def reuse_region(country: Column) -> Column:
    return _lookup(country, REUSE_REGIONS, "Other")


def file_type(filename: Column) -> Column:
    name, out = F.lower(filename), None
    for kind, suffixes in FILE_TYPES.items():
        cond = F.lit(False)
        for s in suffixes:
            cond = cond | F.endswith(name, F.lit(s))
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise("other")


def reuse_class(kind: Column) -> Column:
    return _lookup(kind, REUSE_CLASSES, "archives_other")
