"""File, layer, area, image and species names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDERS = ("dateNotConfirmed", "dateUnknown")


def stem_date(stem: Column) -> Column:
    """B1: flight date from `..._DD-MM-YY...` or the older `D_M_YY`; null if there is none or it is no date."""
    parts = F.coalesce(F.nullif(F.regexp_extract(stem, r"(\d{2})-(\d{2})-(\d{2})(?!\d)", 0), F.lit("")), F.nullif(F.translate(F.regexp_extract(stem, r"(?:^|_)(\d{1,2}_\d{1,2}_\d{2})(?!\d)", 1), "_", "-"), F.lit("")))
    bits = F.split(parts, "-")
    text = F.concat(F.lit("20"), bits[2], F.lit("-"), F.lpad(bits[1], 2, "0"), F.lit("-"), F.lpad(bits[0], 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def stem_sort_key(stem: Column) -> Column:
    """B2: struct(tier, value, stem): dated stems, then `..._omN`, then the rest by name."""
    day, number = stem_date(stem), F.nullif(F.regexp_extract(F.lower(stem), r"om(\d+)", 1), F.lit("")).cast("long")
    tier = F.when(day.isNotNull(), 0).when(number.isNotNull(), 1).otherwise(2)
    return F.struct(tier.alias("tier"), F.coalesce(F.unix_date(day).cast("long"), number, F.lit(0).cast("long")).alias("value"), stem.alias("stem"))


def canonical_stem(stem: Column) -> Column:
    """One name for a stem whose date placeholder is written in either way."""
    return F.regexp_replace(stem, "|".join(PLACEHOLDERS), PLACEHOLDERS[1])


def threshold_tag(value: Column) -> Column:
    """0.45 -> conf_0p45, always with two decimals."""
    return F.concat(F.lit("conf_"), F.regexp_replace(F.format_string("%.2f", value.cast("double")), r"\.", "p"))


def tag_threshold(tag: Column) -> Column:
    """conf_0p45 or conf_0p2 -> number; null if the tag has another form."""
    return F.nullif(F.regexp_replace(F.regexp_extract(tag, r"^conf_(\d+p\d+)$", 1), "p", "."), F.lit("")).cast("double")


def first_integer(name: Column) -> Column:
    """The first run of digits."""
    return F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("long")


def area_of_file(name: Column) -> Column:
    """Survey area by the start of a file name: s1_..s4_, sit, mittal, aN_; else the name without its extension."""
    low = F.lower(name)
    return (
        F.when(low.rlike("^s[1-4]_"), F.concat(F.lit("SV_S"), F.substring(low, 2, 1)))
        .when(low.startswith("sit"), "SIT")
        .when(low.startswith("mittal"), "MITTAL")
        .when(low.rlike(r"^a\d+_"), F.upper(F.regexp_extract(low, r"^(a\d+)_", 1)))
        .otherwise(F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?<=.)\.[^.]*$", ""))
    )


def clean_species(raw: Column, aliases: dict[str, str], canonical: list[str], ambiguous: list[str]) -> Column:
    """struct(value, status).

    Trimmed with runs of white space as one; the bare genus `acacia` is kept as such; then lower-case aliases,
    canonical names, and ambiguity patterns are tried in this order, and any other name is kept.
    """
    name = F.nullif(F.trim(F.regexp_replace(raw, r"\s+", " ")), F.lit(""))
    low = F.lower(name)
    table = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv]) if aliases else F.lit(None).cast("map<string,string>")
    known = F.try_element_at(table, low)
    unsure = (low.rlike("|".join(f"(?:{p})" for p in ambiguous)) if ambiguous else F.lit(False)) & ~name.isin(canonical)
    case = lambda value, status: F.struct(value.cast("string").alias("value"), F.lit(status).alias("status"))
    return (
        F.when(name.isNull(), case(F.lit(None), "missing"))
        .when(low == "acacia", case(F.lit("Acacia unknown"), "acacia_unknown"))
        .when(known.isNotNull(), case(known, "clean"))
        .when(unsure, case(F.lit(None), "ambiguous_or_unknown"))
        .otherwise(case(name, "clean"))
    )


def label_from_rules(rows: DataFrame, rules: DataFrame, species: str, task: str, out: str, fallback: Column | None = None) -> DataFrame:
    """Label of a task by species from rules(task, species, label), else the fallback column, else -1."""
    own = rules.where(F.col("task") == task).select(F.col("species").alias("__s"), F.col("label").cast("int").alias("__l"))
    joined = rows.join(own, F.col(species) == F.col("__s"), "left")
    return joined.withColumn(out, F.coalesce("__l", *([fallback.cast("int")] if fallback is not None else []), F.lit(-1))).drop("__s", "__l")


def contains_any(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.reduce(F.array(*[F.lit(w) for w in words]), F.lit(False), lambda a, w: a | low.contains(w))


def leaf_shed_class(text: Column, deciduous: list[str], semi: list[str], evergreen: list[str]) -> Column:
    """2, 1, 0 or -1 from a trait text; deciduous words are tested first, then semi-evergreen, then evergreen."""
    return F.when(contains_any(text, deciduous), 2).when(contains_any(text, semi), 1).when(contains_any(text, evergreen), 0).otherwise(-1)


def showy(visibility: Column, words: tuple[str, ...] = ("showy", "visible")) -> Column:
    """The visibility text holds one of the words."""
    return contains_any(visibility, list(words))


def tree_type_label(value: Column) -> Column:
    """0 for names with both `non` and `acacia`, 1 for names with `acacia`, else null."""
    low = F.lower(value)
    return F.when(low.contains("non") & low.contains("acacia"), 0).when(low.contains("acacia"), 1)


def image_crown_uid(image: Column, offset: int = 0) -> Column:
    """s3_tree_12.tif -> SV_S3:crown_0012, the number moved by offset; null if the name has another form."""
    n = F.nullif(F.regexp_extract(F.lower(image), r"^s(\d+)_tree_(\d+)\.tif$", 2), F.lit("")).cast("int")
    return F.when(n.isNotNull(), F.concat(F.lit("SV_S"), F.regexp_extract(F.lower(image), r"^s(\d+)_", 1), F.lit(":crown_"), F.lpad((n + offset).cast("string"), 4, "0")))


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def renamed(rows: DataFrame, names: dict[str, str], labels: list[str] = ()) -> DataFrame:
    """Columns renamed by a map; label columns as int with -1 for null."""
    out = rows.withColumnsRenamed({k: v for k, v in names.items() if k in rows.columns})
    return out.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in labels}) if labels else out


def year_prefixed(rows: DataFrame, year: int, properties: list[str]) -> DataFrame:
    """Every column that is no property gets the prefix y{year}_."""
    return rows.withColumnsRenamed({c: f"y{year}_{c}" for c in rows.columns if c not in properties})


def feature_columns(rows: DataFrame, excluded: list[str] = (), pattern: str | None = None) -> list[str]:
    """Numeric columns that are not excluded and no label_*; with a pattern, the matching ones in numeric order."""
    import re

    found = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in excluded and not f.name.startswith("label_")]
    if pattern:
        found = sorted((c for c in found if re.fullmatch(pattern, c)), key=lambda c: int(re.sub(r"\D", "", c) or 0))
    return found


def labelled(rows: DataFrame, *labels: str) -> DataFrame:
    """Rows where any of the label columns is not -1 (and not null)."""
    cond = F.lit(False)
    for c in labels:
        cond = cond | F.coalesce(F.col(c) != -1, F.lit(False))
    return rows.where(cond)
