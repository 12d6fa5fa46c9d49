"""Column builders for PFAS results: nanograms per litre, compound names, status against a limit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.measure import normalized

# What a compound's name looks like, and its short name; the first that fits counts.
COMPOUNDS = (
    (r"PERFLUOROOCTANOIC|\bPFOA\b|PERFLUOROOCTANOATE", "PFOA"),
    (r"PERFLUOROOCTANE ?SULFON|\bPFOS\b", "PFOS"),
    (r"PERFLUOROHEXANE ?SULFON|\bPFHXS\b", "PFHxS"),
    (r"PERFLUORONONANOIC|\bPFNA\b|PERFLUORONONANOATE", "PFNA"),
    (r"HEXAFLUOROPROPYLENE OXIDE|HFPO|\bGENX\b", "HFPO-DA"),
    (r"PERFLUOROBUTANE ?SULFON|\bPFBS\b", "PFBS"),
    (r"PERFLUOROBUTANOIC|PERFLUOROBUTYRATE|\bPFBA\b", "PFBA"),
    (r"PERFLUOROPENTANOIC|\bPFPEA\b", "PFPeA"),
    (r"PERFLUOROHEXANOIC|\bPFHXA\b", "PFHxA"),
    (r"PERFLUOROHEPTANOIC|\bPFHPA\b", "PFHpA"),
    (r"PERFLUORODECANOIC|\bPFDA\b", "PFDA"),
    (r"PERFLUOROUNDECANOIC|\bPFUNA\b|\bPFUNDA\b", "PFUnA"),
    (r"PERFLUORODODECANOIC|\bPFDOA\b|\bPFDODA\b", "PFDoA"),
    (r"PERFLUOROTRIDECANOIC|\bPFTRDA\b", "PFTrDA"),
    (r"PERFLUOROTETRADECANOIC|\bPFTA\b|\bPFTEDA\b", "PFTA"),
    (r"PERFLUOROHEPTANE ?SULFON|\bPFHPS\b", "PFHpS"),
    (r"PERFLUOROPENTANE ?SULFON|\bPFPES\b", "PFPeS"),
    (r"PERFLUORODECANE ?SULFON|\bPFDS\b", "PFDS"),
    (r"PERFLUORONONANE ?SULFON|\bPFNS\b", "PFNS"),
    (r"PERFLUORODODECANE ?SULFON|\bPFDOS\b", "PFDoS"),
    (r"4:2.*FLUOROTELOMER|\b4:2 ?FTS\b", "4:2 FTS"),
    (r"6:2.*FLUOROTELOMER|6:2.*PERFLUOROOCTANE|\b6:2 ?FTS\b", "6:2 FTS"),
    (r"8:2.*FLUOROTELOMER|\b8:2 ?FTS\b", "8:2 FTS"),
    (r"N-?METHYL.*PERFLUOROOCTANE|\bNMEFOSAA\b", "NMeFOSAA"),
    (r"N-?ETHYL.*PERFLUOROOCTANE|\bNETFOSAA\b", "NEtFOSAA"),
    (r"PERFLUORO.*4.*DIOXA|\bADONA\b", "ADONA"),
    (r"9.*CHLORO.*HEXADECAFLUORO|\b9CL-PF3ONS\b|F53B", "9Cl-PF3ONS"),
    (r"11.*CHLORO.*EICOSAFLUORO|\b11CL-PF3OUDS\b", "11Cl-PF3OUdS"),
)
ANY_PFAS = r"\bPF[A-Z]{1,5}\b|PERFLUORO|POLYFLUORO|FLUOROTELOMER"
#: A number and nothing else; a qualifier before it makes it missing.
ONLY_NUMBER = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s*$"


def plain_number(value: Column) -> Column:
    return F.regexp_extract(value.cast("string"), ONLY_NUMBER, 1).try_cast("double")


def to_ng_l(value: Column, unit: Column) -> Column:
    """Nanograms per litre; a missing or unknown unit counts as that already, a missing value stays missing."""
    n, u = plain_number(value), F.coalesce(F.translate(normalized(unit), "µμΜ", "UUU"), F.lit(""))
    factor = F.when(u.rlike("NG/?L|PPT|PARTS PER TRILLION") | (u == ""), 1.0).when(u.rlike("UG/?L|PPB|PARTS PER BILLION"), 1e3).when(u.rlike("MG/?L|PPM|PARTS PER MILLION"), 1e6)
    return n * F.coalesce(factor, F.lit(1.0))


def canonical_pfas(name: Column, levels: Mapping[str, float], synonyms: Mapping[str, Sequence[str]] | None = None) -> Column:
    """A compound's short name: a regulated key, a synonym in the name, a known pattern, or the name itself if it reads like PFAS."""
    n = normalized(name)
    rules = [(n == key.upper(), key) for key in levels]
    for key, words in (synonyms or {}).items():
        rules.append((F.exists(F.array(*[F.lit(w.strip().upper()) for w in (*words, key)]), lambda w: F.contains(n, w)), key))
    rules += [(n.rlike(pattern), short) for pattern, short in COMPOUNDS]
    return F.coalesce(*[F.when(test, F.lit(short)) for test, short in rules], F.when(n.rlike(ANY_PFAS), F.trim(name)))


def pfas_result(name: Column, value: Column, unit: Column, condition: Column, levels: Mapping[str, float], synonyms: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Struct of compound, ng/L, limit, status and above_benchmark.

    One sample at or above a limit is reported as such, never as a violation. Non-detects have no value, and without a
    limit or a value nothing is above it: null.
    """
    compound, ng = canonical_pfas(name, levels, synonyms), to_ng_l(value, unit)
    below = F.coalesce(F.trim(value.cast("string")).rlike("(?i)^(<|ND|NON[- ]?DETECT)"), F.lit(False)) | F.coalesce(normalized(condition).rlike("NON-DETECT|NOT DETECTED"), F.lit(False))
    level = F.try_element_at(F.create_map(*[F.lit(x) for pair in levels.items() for x in (pair[0], float(pair[1]))]), compound)
    status = F.when(below, "not-detected").when(ng > 0, "detected").otherwise("reported")
    return F.struct(compound.alias("canonical_analyte"), F.when(~below, ng).alias("value_ng_l"), level.alias("mcl_ng_l"), status.alias("status"), F.when(~below, ng >= level).alias("above_benchmark"))
