"""Names that are probed until one is free, as in an archive or a workbook.

A name that is taken gets a suffix, and the suffixed one may be taken by a third, so a
row's name depends on those of all rows before it. Rows can only meet within a class:
names that are equal without their trailing numbers. Each class is one fold over its rows in
order; classes of one row, by far the most, are not folded.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the folds reach workers that lack the package

# The endings that an archive keeps; a name with none of them is a picture.
ENDINGS = (".jpeg", ".jpg", ".png", ".webp", ".pdf", ".xlsx", ".txt")
MOST = 31  # characters of a sheet's title
CUT = 28  # of them kept before a number


def archive_name(name: str, n: int) -> str:
    """The n-th name that is tried for a file: its own, then base_1, base_2 before the ending."""
    dot = name.rfind(".")
    base, ending = (name[:dot], name[dot:]) if name[:dot].strip(".") else (name, "")
    return f"{base}_{n}{ending}" if n else name


def sheet_title(name: str, n: int) -> str:
    """The n-th title that is tried for a sheet."""
    return f"{name[:CUT]}_{n}"[:MOST] if n else name


def folded(names: list[str], tried: Callable[[str, int], str], fold: bool, spent: bool = False) -> list[str | None]:
    """The first free name of each, in order. Names that once were taken stay so: each base is tried on from where it stood.

    Where none is free there is an error or, with `spent`, None.
    """
    taken: set[str] = set()
    at: dict[str, int | None] = {}
    out = []
    for name in names:
        n = at.get(name, 0)
        if n is None:
            out.append(None)
            continue
        own = tried(name, n)
        while (own.lower() if fold else own) in taken:
            n += 1
            own = tried(name, n)
            if n > 9 and own == tried(name, n // 10):  # a title so long that the number is cut: none is free
                if not spent:
                    raise ValueError(f"no free name for {name}")
                n = own = None
                break
        at[name] = n
        if own is None:
            out.append(None)
            continue
        taken.add(own.lower() if fold else own)
        out.append(own)
    return out


def probed(rows: DataFrame, keys: list[str], name: str, order: list[str], kind: str) -> DataFrame:
    """`rows` with the name that each gets within `keys`, in `order`; kind: archive or sheet.

    Archive names get .jpeg where they have no known ending and meet whatever their case;
    sheet titles are cut to MOST characters and meet as they are. `order` must be unique
    within `keys`. Null names are ''. A row has null where every number that fits is taken.
    """
    own = F.coalesce(name, F.lit(""))
    if kind == "archive":
        known = F.lower(own).rlike("(" + "|".join(e.replace(".", "[.]") for e in ENDINGS) + ")$")
        own = F.when(known, own).otherwise(F.concat(own, F.lit(".jpeg")))
        kinship = F.lower(F.regexp_replace(own, r"(_[0-9]+)+(\.[^.]*)?$", "$2"))
    else:
        own = F.substring(own, 1, MOST)
        kinship = F.substring(F.regexp_replace(own, "[_0-9]+$", ""), 1, CUT)
    given = rows.withColumn(name, own).withColumn("name_class", kinship)
    schema = StructType([StructField(f.name, f.dataType, f.nullable or f.name == name) for f in given.schema])
    sizes = given.groupBy(*keys, "name_class").agg(F.count("*").alias("n_of_class"))
    given = given.join(sizes, [*keys, "name_class"]).select(*schema.names, "n_of_class")
    tried, fold = (archive_name, True) if kind == "archive" else (sheet_title, False)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, ignore_index=True)
        group[name] = folded(group[name].tolist(), tried, fold, spent=True)
        return group

    several = given.filter("n_of_class > 1").drop("n_of_class").groupBy(*keys, "name_class").applyInPandas(run, schema)
    return given.filter("n_of_class = 1").drop("n_of_class").unionByName(several).drop("name_class")
