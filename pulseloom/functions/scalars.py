"""Column functions: labels, sizes, names, dates and the ECG interval formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN as null: averages then skip both."""
    return F.nanvl(x, F.lit(None).cast("double"))


def half_even(x: Column, places: int) -> Column:
    """A double with so many decimals as text; what lies exactly between two goes to the even one."""
    return F.format_string(f"%.{places}f", F.bround(x.cast("decimal(38,18)"), places).cast("double"))


def time_label(seconds: Column) -> Column:
    """Seconds below a minute, minutes below an hour, else hours, with one decimal."""
    part = lambda x, unit: F.concat(half_even(x, 1), F.lit(unit))
    return F.when(seconds < 60, part(seconds, " s")).when(seconds < 3600, part(seconds / 60, " m")).otherwise(part(seconds / 3600, " h"))


def count_label(n: Column) -> Column:
    """Whole number with _ between thousands and the suffix of its size; the number itself isn't scaled."""
    digits = F.translate(F.format_number(n, 0), ",", "_")
    return F.when(n >= 1_000_000, F.concat(digits, F.lit(" M"))).when(n >= 1_000, F.concat(digits, F.lit(" K"))).otherwise(digits)


def size_label(n: Column) -> Column:
    """Bytes as B, KB, MB, GB, else PB, with two decimals."""
    n = n.cast("double")
    out = None
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        limit, text = 1024.0 ** (power + 1), F.concat(half_even(n / 1024.0**power, 2), F.lit(f" {unit}"))
        out = F.when(n < limit, text) if out is None else out.when(n < limit, text)
    return out.otherwise(F.concat(half_even(n / 1024.0**4, 2), F.lit(" PB")))


def clean_name(name: Column) -> Column:
    """Whatever is no ASCII letter or digit becomes _."""
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


#: Letters folded in patient names (fixed values).
FOLDED = ("äöüÄÖÜß", "aouAOUs")


def fold_name(name: Column, most: int = 16) -> Column:
    """Umlauts folded, cut to ``most`` characters."""
    return F.substring(F.translate(name, *FOLDED), 1, most)


def reasons(text: Column) -> Column:
    """The trimmed reasons of a |-separated text, none empty."""
    return F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def valid_qrs(*peaks: Column) -> Column:
    """1 if all five peaks are there and above 0, else 0."""
    every = F.lit(True)
    for p in peaks:
        every = every & F.coalesce(p > 0, F.lit(False))
    return every.cast("int")


def interval_ms(a: Column, b: Column, fs: float) -> Column:
    """Whole milliseconds from sample b to sample a, towards 0; null if either is missing."""
    return (1000 * (a - b) / fs).cast("int")


def qtc(qt: Column, rr: Column, formula: str = "bazett") -> Column:
    """Corrected QT in whole ms from QT and RR in ms; 0 where QT or RR is missing or not positive."""
    rr_s = rr / 1000.0
    value = {"bazett": qt / F.sqrt(rr_s), "fridericia": qt / F.pow(rr_s, F.lit(1.0 / 3.0)), "framingham": qt + 154.0 * (1.0 - rr_s)}[formula]
    return F.when((qt > 0) & (rr > 0), F.floor(value)).otherwise(0).cast("int")


def shock_class(ebv: Column, most: Column) -> Column:
    """Class of haemorrhage from the estimated blood volume and its maximum."""
    r = ebv / most
    return F.when(r >= 1.0, "BL").when(r >= 0.85, "C1").when(r >= 0.70, "C2").when(r >= 0.60, "C3").when(r < 0.60, "C4")


def null_token(text: Column) -> Column:
    """Null for the words that stand for a missing label."""
    return F.when(text.isin("UNKNOWN", "nan", ""), None).otherwise(text)


def name_ratio(a: Column, b: Column) -> Column:
    """Similarity of two names, letters in either case: (length of the longer - distance) / that length."""
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, (longest - F.levenshtein(a, b)) / longest).otherwise(1.0)


def clock_corrected(position: Column, start: Column, error: Column) -> Column:
    """A position moved by the rate error since its block's start, rounded half away from zero."""
    return F.round(position - (position - start) * error).cast("long")
