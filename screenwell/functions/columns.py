"""Scalar columns of a score log: calibration, hits, classes, gates, time, text and JSON shaping."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

# Sources that mark a calibration row, and sources that count as novel.
REFERENCE_SOURCES = ("ref", "reference")
NOVEL_SOURCES = ("zinc15", "zinc15-fallback", "mutant", "generate", "pulse")

# Target families.
FAMILIES = {
    "kinase": ("EGFR", "HER2", "KRAS", "BRAF", "VEGFR2", "FGFR1", "RET", "ABL1", "CDK4", "FLT3",
               "JAK2", "NTRK1"),
    "cytokine": ("BCL2", "MDM2", "PDL1", "STAT3", "MYC"),
    "protease": ("PARP1", "HDAC1", "HDAC2"),
    "nuclear_receptor": ("AR", "ESR1"),
}

# Property windows, inclusive at both ends.
PROFILES = {
    "generate": {"between": {"mw": (200, 600), "rot_bonds": (None, 10)}, "flag_false": ("pains",)},
    "actives": {"between": {"mw": (200, 800)}, "min_length": {"smiles": 4}},
    "fragment": {"between": {"mw": (200, 300), "rot_bonds": (None, 5), "heavy_atoms": (None, 25)}},
    "sweep": {"between": {"heavy_atoms": (15, 55)}},
}

# Elements no scorer accepts; '*' is an open attachment point.
BANNED_ELEMENTS = ("Se", "Na", "Fe", "Zn", "B", "Si", "P", "*")

_ATOM = r"\[[^\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]|\*"
_SYMBOL = r"^\[?[0-9]*(\*|[A-Z][a-z]?|se|as|[a-z])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- scores -------------------------------------------------------------------------------

def to_affinity(score) -> Column:
    """Affinity of a model score: -30 times the score, three decimals, null stays null."""
    return F.round(col(score) * -30.0, 3)


def is_hit(affinity, threshold) -> Column:
    return F.coalesce(col(affinity) <= col(threshold), F.lit(False))


def source_class(source, novel=NOVEL_SOURCES, reference=REFERENCE_SOURCES) -> Column:
    s = col(source)
    return (F.when(s.isin(*reference), "reference").when(s.isin(*novel), "novel")
            .otherwise("other"))


def numeric_score(score) -> Column:
    """The score as a double, null when it is text that is no number, or NaN."""
    value = col(score).try_cast("double")
    return F.when(~F.isnan(value), value)


def valid_score(df: DataFrame, score: str, positive: bool = False) -> DataFrame:
    value = numeric_score(score)
    return df.filter(value.isNotNull() & (value > 0 if positive else F.lit(True)))


def proxy_score(heavy, logp, on_keys, safe=True) -> Column:
    """Cheap desirability of a molecule; 0 outside 15..55 heavy atoms or when unsafe."""
    ha, lp, p = col(heavy), col(logp), col(on_keys) / 167.0
    size = F.exp(-F.abs(ha / 30.0 - 1) / 0.3)
    lipo = F.exp(-F.abs(lp / 3.0 - 1) / 0.5)
    entropy = F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)
    score = 0.4 * size + 0.3 * lipo + F.lit(0.2) + 0.1 * F.least(F.lit(1.0), entropy / 0.5)
    ok = ha.between(15, 55) & (safe if isinstance(safe, Column) else F.lit(safe))
    return F.coalesce(F.when(ok, score), F.lit(0.0))


def with_baseline(score, source, curated, baseline: float = 0.5) -> Column:
    """A curated row whose score is not positive gets the baseline instead."""
    return F.when(col(source).isin(*curated) & (col(score) <= 0), baseline).otherwise(col(score))


def seed_score(qed, pchembl) -> Column:
    potency = F.least(F.coalesce(col(pchembl), F.lit(6.0)) / 9.0, F.lit(1.0))
    return F.coalesce(col(qed), F.lit(0.5)) * potency


def pct(part, whole) -> Column:
    """Percentage with two decimals, null over an empty whole."""
    return F.when(col(whole) > 0, F.round(col(part) * 100.0 / col(whole), 2))


def gauge(value, full: float) -> Column:
    """Percent of `full`, never above 100."""
    return F.least(F.lit(100.0), col(value) * 100.0 / full)


# --- classes and gates --------------------------------------------------------------------

def target_family(target, families=FAMILIES) -> Column:
    t, out = col(target), None
    for name, members in families.items():
        out = (F if out is None else out).when(t.isin(*members), name)
    return out


def target_kind(target, declared=None) -> Column:
    """'mRNA' by declared type or by name suffix, else 'protein'."""
    by_name = col(target).endswith("_mRNA")
    if declared is not None:
        by_name = F.coalesce(F.lower(col(declared)) == "mrna", F.lit(False)) | by_name
    return F.when(by_name, "mRNA").otherwise("protein")


def elements(smiles) -> Column:
    """Distinct element symbols written in a line notation; aromatic atoms under their element."""
    atoms = F.regexp_extract_all(col(smiles), F.lit(f"({_ATOM})"), F.lit(1))
    return F.array_distinct(F.transform(atoms, lambda a: F.initcap(F.regexp_extract(a, _SYMBOL, 1))))


def no_banned(smiles, banned=BANNED_ELEMENTS) -> Column:
    hits = F.arrays_overlap(elements(smiles), F.array(*[F.lit(b) for b in banned]))
    return F.coalesce((F.length(col(smiles)) > 0) & ~hits, F.lit(False))


def property_gate(df: DataFrame, profile: str | dict, columns: dict | None = None) -> DataFrame:
    """Keep rows inside every window of a named profile; `columns` renames the descriptors."""
    spec = PROFILES[profile] if isinstance(profile, str) else profile
    name = lambda c: F.col((columns or {}).get(c, c))
    tests = []
    for c, (low, high) in spec.get("between", {}).items():
        if low is not None:
            tests.append(name(c) >= low)
        if high is not None:
            tests.append(name(c) <= high)
    tests += [~name(c) for c in spec.get("flag_false", ())]
    tests += [F.length(name(c)) >= n for c, n in spec.get("min_length", {}).items()]
    return df.filter(functools.reduce(lambda a, b: a & b, tests))


# --- time ---------------------------------------------------------------------------------

def unix_seconds(ts) -> Column:
    """Seconds since 1970 with fraction, from a timestamp with or without zone (read as UTC)."""
    return F.unix_micros(col(ts).cast("timestamp")) / 1_000_000.0


def epoch_day(seconds) -> Column:
    return F.floor(col(seconds) / 86400).cast("long")


def iso_ts(seconds) -> Column:
    """ISO-8601 text in UTC with milliseconds."""
    stamp = F.timestamp_millis(F.floor(col(seconds) * 1000).cast("long"))
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def within(seconds, now, span: float) -> Column:
    return col(seconds) > (F.lit(now) if not isinstance(now, Column) else now) - span


# --- text ---------------------------------------------------------------------------------

def content_key(text) -> Column:
    return F.substring(F.md5(col(text)), 1, 16)


def method_label(method, prefix: str = "gen:", width: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(col(method), 1, width))


def or_general(family, default: str = "general") -> Column:
    return F.coalesce(col(family), F.lit(default))


def shown_id(text, width: int = 12) -> Column:
    """Trimmed, upper-case and shortened form of an identifier for a report."""
    return F.substring(F.upper(F.trim(col(text))), 1, width)


def ordinal(number) -> Column:
    n = col(number)
    last = n % 10
    suffix = (F.when((n % 100).between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd")
              .when(last == 3, "rd").otherwise("th"))
    return F.concat(n.cast("string"), suffix)


def discovery_name(number, target, day, label: str) -> Column:
    return F.concat(F.lit(f"{label} #"), col(number).cast("string"), F.lit(" — "), col(target),
                    F.lit(" "), col(day))


def metadata_json(name: Column, description: Column, traits: dict[str, Column], creator: Column,
                  symbol: str, image: Column | None = None, external_url: Column | None = None) -> Column:
    """Metadata document: name, symbol, description, links if given, trait list and one creator with full share."""
    attributes = F.array(*[F.struct(F.lit(k).alias("trait_type"), v.cast("string").alias("value"))
                           for k, v in traits.items()])
    creators = F.array(F.struct(creator.alias("address"), F.lit(100).alias("share")))
    links = {"image": image, "external_url": external_url}
    return F.to_json(F.struct(
        name.alias("name"), F.lit(symbol).alias("symbol"), description.alias("description"),
        *[v.alias(k) for k, v in links.items() if v is not None],
        attributes.alias("attributes"),
        F.struct(F.lit("image").alias("category"), creators.alias("creators")).alias("properties")))


def data_uri(json_text, media: str = "application/json") -> Column:
    return F.concat(F.lit(f"data:{media};base64,"),
                    F.base64(F.encode(col(json_text), "UTF-8")))


def is_address(text) -> Column:
    return col(text).rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$")


def strip_nulls(text) -> Column:
    return F.replace(col(text), F.lit("\x00"), F.lit(""))


def valid_alignment(text, least: int = 1024) -> Column:
    return F.coalesce((F.octet_length(col(text)) >= least) & col(text).startswith(">"), F.lit(False))


def json_get(text, *paths: str) -> Column:
    """First non-null value among several JSON paths."""
    return F.coalesce(*[F.get_json_object(col(text), p) for p in paths])


def to_map(df: DataFrame, key: str, value: str, by=()) -> DataFrame:
    """Fold key/value rows into one map per group; made for small dimensions, keys must be unique."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key), F.col(value))))
    return df.groupBy(*by).agg(F.map_from_entries(entries).alias("entries"))


def from_map(df: DataFrame, mapping: str, key: str = "key", value: str = "value") -> DataFrame:
    others = [c for c in df.columns if c != mapping]
    return df.select(*others, F.explode(mapping).alias(key, value))


def resolve_sequence(aligned, own) -> tuple[Column, Column]:
    """The alignment's query sequence, else the dimension's own; and whether the lengths differ."""
    a, o = col(aligned), col(own)
    return F.coalesce(a, o), F.coalesce(F.length(a) != F.length(o), F.lit(False))
