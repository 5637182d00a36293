"""Makes, their spelling variants, and the group each belongs to."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_all_caps, strip, title_case

# Makes by group, and spelling variants by canonical make.
MAKES_BY_GROUP: dict[str, tuple[str, ...]] = {
    "Stellantis": ("Chrysler", "Dodge", "Jeep", "Ram", "Fiat", "Alfa Romeo", "Maserati"),
    "Volkswagen Group": ("Volkswagen", "Audi", "Porsche", "Bentley", "Lamborghini", "Bugatti"),
    "Hyundai Motor Group": ("Hyundai", "Kia", "Genesis"),
    "Toyota Motor Corporation": ("Toyota", "Lexus"),
    "Honda Motor": ("Honda", "Acura"),
    "Nissan": ("Nissan", "Infiniti"),
    "General Motors": ("Chevrolet", "GMC", "Cadillac", "Buick"),
    "Ford Motor": ("Ford", "Lincoln"),
    "BMW Group": ("BMW", "Mini", "Rolls-Royce"),
    "Mercedes-Benz Group": ("Mercedes-Benz", "Smart"),
    "Tata Motors": ("Land Rover", "Range Rover", "Jaguar"),
    "Geely": ("Volvo", "Polestar", "Lotus"),
    "Mazda": ("Mazda",),
    "Subaru": ("Subaru",),
    "Tesla": ("Tesla",),
    "Rivian": ("Rivian",),
    "Lucid": ("Lucid",),
}
ALIASES: dict[str, str] = {
    "CHEVY": "Chevrolet",
    "VW": "Volkswagen",
    "MB": "Mercedes-Benz",
    "MERCEDES BENZ": "Mercedes-Benz",
    "ALFA-ROMEO": "Alfa Romeo",
    "ROLLS ROYCE": "Rolls-Royce",
    "RANGE-ROVER": "Range Rover",
}


@dataclass(frozen=True)
class Taxonomy:
    groups: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: MAKES_BY_GROUP)
    aliases: Mapping[str, str] = field(default_factory=lambda: ALIASES)

    def lookup_rows(self) -> list[tuple[str, str | None, str | None]]:
        """``(upper-case name, canonical make if it is an alias, group)``, one row per name."""
        group_of = {make.lower(): group for group, makes in self.groups.items() for make in makes}
        rows = {make.upper(): (make.upper(), None, group) for make, group in group_of.items()}
        for alias, make in self.aliases.items():
            rows[alias.upper()] = (alias.upper(), make, group_of.get(make.lower()))
        return list(rows.values())

    def frame(self, spark: SparkSession) -> DataFrame:
        names, aliases, groups = zip(*self.lookup_rows(), strict=True)
        text = pa.string()
        return spark.createDataFrame(
            pa.table({"_name": pa.array(names, text), "_alias_of": pa.array(aliases, text), "_group": pa.array(groups, text)})
        )


DEFAULT_TAXONOMY = Taxonomy()


def resolve_make(
    df: DataFrame,
    raw: str,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    *,
    make: str = "make_norm",
    group: str = "oem_group",
) -> DataFrame:
    """Add the canonical make and its group.

    Aliases are replaced, other all-caps names get title case, unknown makes are kept with a
    NULL group, and empty ones give NULL for both. One join against the taxonomy, whose size Spark
    knows when it picks the join, instead of a Python call per row.
    """
    lookup = taxonomy.frame(df.sparkSession)
    # Trimmed below the join, once; above it the expression would be worked out for each of its uses.
    named = df.withColumn("_stripped", strip(F.col(raw)))
    joined = named.join(lookup, F.upper("_stripped") == F.col("_name"), "left")
    name = F.col("_stripped")
    present: Column = F.col(raw) != ""
    tidy = F.when(is_all_caps(name), title_case(name)).otherwise(name)
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.when(present, F.coalesce(F.col("_alias_of"), tidy)).alias(make),
        F.when(present, F.col("_group")).alias(group),
    )
