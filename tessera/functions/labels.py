"""Label mappings. Unmapped labels become Unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

# Raw label to mapped label.
_BROAD = {
    "B_cell": "Lymphoid", "Endothelial": "Stromal", "Epithelial": "Epithelial", "Fibroblast": "Stromal", "Malignant": "Malignant", "Myeloid": "Myeloid",
    "Other_Stromal": "Stromal", "Plasma": "Lymphoid", "T_NK_cell": "Lymphoid", "Neural/Glial": "Stromal", "Unknown": "Unknown",
}
_RAW = ("B_cell", "Endothelial", "Epithelial", "Fibroblast", "Malignant", "Myeloid", "Other_Stromal", "Plasma", "T_NK_cell", "Unknown")
MAPPINGS: dict[str, dict[str, str]] = {
    "simplified_broad": _BROAD,
    "epithelial_malignant_vs_rest": {r: "epithelial_malignant" if r in ("Epithelial", "Malignant") else "non_epithelial_malignant" for r in _RAW},
    "identity": {r: r for r in _RAW},
    "malignant_vs_rest": {r: "epithelial_malignant" if r == "Malignant" else "non_malignant" for r in _RAW},
}


def register_mapping(name: str, mapping: dict[str, str]) -> None:
    """Adds a named mapping."""
    MAPPINGS[name] = dict(mapping)


def mapping(name: str) -> dict[str, str]:
    if name not in MAPPINGS:
        raise KeyError(f"no mapping {name!r}; known: {sorted(MAPPINGS)}")
    return MAPPINGS[name]


def mapping_table(spark: SparkSession, name: str) -> DataFrame:
    """raw, mapped."""
    return spark.createDataFrame(sorted(mapping(name).items()), "raw string, mapped string")


def map_label(raw: Column, name: str) -> Column:
    """The mapped label; a null or unmapped one is Unknown. A mapping is a handful of literals, so no join is needed."""
    pairs = [F.lit(x) for kv in sorted(mapping(name).items()) for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), raw), F.lit(UNKNOWN))


def drop_unknown(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) != UNKNOWN)


def label_codes(spark: SparkSession, name: str) -> DataFrame:
    """label, code: the mapping's distinct names but Unknown, coded from 0 in alphabetical order."""
    names = sorted(set(mapping(name).values()) - {UNKNOWN})
    return spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "label string, code int")


def label_encode(df: DataFrame, label: str = "label") -> DataFrame:
    """df with code: the place of its label among the distinct labels, from 0, Unknown aside (null)."""
    names = df.select(label).filter((F.col(label) != UNKNOWN) & F.col(label).isNotNull()).distinct()
    codes = names.withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)  # one row per class
    return df.join(codes, label, "left")
