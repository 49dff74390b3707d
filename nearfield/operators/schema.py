"""Schema jobs: typing by name, copied fields, vector checks, document repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import payload_map

# Column name suffixes and the types they stand for.
SUFFIX_TYPES = {
    "_i": "int",
    "_is": "array<int>",
    "_s": "string",
    "_s_ns": "string",
    "_ss": "array<string>",
    "_l": "bigint",
    "_l_ns": "bigint",
    "_ls": "array<bigint>",
    "_t": "string",
    "_txt": "array<string>",
    "_en": "array<string>",
    "_b": "boolean",
    "_bs": "array<boolean>",
    "_f": "float",
    "_fs": "array<float>",
    "_d": "double",
    "_ds": "array<double>",
    "_dt": "timestamp",
    "_dts": "array<timestamp>",
}

# Languages with a text suffix of their own in the older layout, ``_txt_`` and the code.
TEXT_LANGUAGES = "en ar bg ca cz da de el es eu fa fi fr ga gl hi hu hy id it ja lv nl no pt ro ru sv th tr cjk rev en_split en_split_tight".split()

# The column names of the older layout, suffixes and prefixes, and the types they stand for.
OLDER_TYPES = {
    "_i": "int", "_is": "array<int>", "_pi": "int", "_pis": "array<int>", "_ti": "int", "_tis": "array<int>",
    "_l": "bigint", "_ls": "array<bigint>", "_pl": "bigint", "_pls": "array<bigint>", "_tl": "bigint", "_tls": "array<bigint>",
    "_f": "float", "_fs": "array<float>", "_pf": "float", "_pfs": "array<float>", "_tf": "float", "_tfs": "array<float>",
    "_d": "double", "_ds": "array<double>", "_pd": "double", "_pds": "array<double>", "_td": "double", "_tds": "array<double>",
    "_dt": "timestamp", "_dts": "array<timestamp>", "_pdt": "timestamp", "_pdts": "array<timestamp>", "_tdt": "timestamp", "_tdts": "array<timestamp>",
    "_b": "boolean", "_bs": "array<boolean>", "_s": "string", "_ss": "array<string>", "_s_lower": "string",
    "_t": "string", "_txt": "string", "_ws": "string", "_phon_en": "string", "_descendent_path": "string", "_ancestor_path": "string",
    "_dpf": "payload<float>", "_dpi": "payload<int>", "_dps": "payload<string>",
    "_p": "string", "_point": "string", "_srpt": "string", "_c": "string",
    "attr_": "array<string>", "ignored_": "drop", "random_": "drop",
    **{f"_txt_{code}": "string" for code in TEXT_LANGUAGES},
}

# The fields copied into the catch-all text field.
TEXT_SOURCES = (
    "cat name manu features includes title author description keywords content content_type resourcename url".split()
)
COPY_RULES = [(source, "text") for source in TEXT_SOURCES] + [("manu", "manu_exact"), ("author", "author_s")]

# What stands in for missing fields.
DUMMY_TITLE = "DUMMY_TITLE"
DUMMY_DESCRIPTION = "DUMMY_DESCRIPTION"
DUMMY_CATEGORY = "DUMMY_CATEGORY"


def type_of(name: str, rules: dict[str, str] | None = None) -> str | None:
    """Type by the longest suffix or prefix that fits the name: rules that begin with ``_`` are suffixes, others that end with it prefixes."""
    known = SUFFIX_TYPES if rules is None else rules
    fitting = [s for s in known if (name.endswith(s) if s.startswith("_") else name.startswith(s))]
    return known[max(fitting, key=len)] if fitting else None


def cast_by_suffix(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Cast every column whose name carries a type; a single value becomes a one-element array where asked.

    ``payload<kind>`` turns ``token|payload`` text into a map, ``drop`` leaves the
    column out. ``rules`` are SUFFIX_TYPES unless given; OLDER_TYPES are those of the
    older layout.
    """
    columns: list[Column] = []
    for field in df.schema.fields:
        wanted = type_of(field.name, rules)
        column = F.col(f"`{field.name}`")
        if wanted == "drop":
            continue
        if wanted is not None and wanted.startswith("payload<"):
            column = payload_map(column, wanted[len("payload<") : -1])
        elif wanted is not None:
            if wanted.startswith("array<") and field.dataType.typeName() != "array":
                column = F.when(column.isNotNull(), F.array(column))
            column = column.cast(wanted)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def copy_fields(df: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Copy source fields to their targets: one source as it is, several joined by a blank in rule order."""
    targets: dict[str, list[str]] = {}
    for source, target in COPY_RULES if rules is None else rules:
        if source in df.columns:
            targets.setdefault(target, []).append(source)
    out = df
    for target, sources in targets.items():
        if len(sources) == 1 and target != "text":
            out = out.withColumn(target, F.col(sources[0]))
        else:
            out = out.withColumn(target, F.concat_ws(" ", *[F.col(s) for s in sources]))
    return out


def vector_problem(vec: Column, dims: int) -> Column:
    """Why a vector cannot be stored, or null."""
    return (
        F.when(vec.isNull(), F.lit("missing"))
        .when(F.size(vec) != dims, F.lit("dimensions"))
        .when(F.exists(vec, lambda x: x.isNull()), F.lit("null component"))
        .when(F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("not finite"))
    )


def validate_vectors(df: DataFrame, dims: int, vec: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with a ``reason``."""
    checked = df.withColumn("reason", vector_problem(F.col(vec), dims))
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def repair_docs(df: DataFrame) -> DataFrame:
    """Title and description always present, categories as one flat list."""
    return (
        df.withColumn("title", F.coalesce("title", F.lit(DUMMY_TITLE)))
        .withColumn("description", F.coalesce("description", F.lit(DUMMY_DESCRIPTION)))
        .withColumn("categories", F.coalesce(F.flatten("categories"), F.array(F.lit(DUMMY_CATEGORY))))
    )


def normalise_dates(df: DataFrame, column: str = "release_date") -> DataFrame:
    """Plain dates get midnight UTC; missing dates stay missing."""
    return df.withColumn(column, F.concat(F.col(column), F.lit("T00:00:00Z")))
