"""Label schemes (L1-L7) and dictionary look-ups (J3, J4) as map
expressions / tiny broadcast dimensions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the original label schemes.
# ---------------------------------------------------------------------------
FAKEDDIT_6WAY = {
    0: "true",
    1: "satire/parody",
    2: "misleading content",
    3: "imposter content",
    4: "false connection",
    5: "manipulated content",
}
FAKEDDIT_3WAY = {0: "true", 1: "satire/parody", 2: "fake", 3: "fake", 4: "fake", 5: "fake"}
FAKEDDIT_2WAY = {0: "true", 1: "fake", 2: "fake", 3: "fake", 4: "fake", 5: "fake"}

LIAR_LABELS = ["pants-fire", "false", "barely-true", "half-true", "mostly-true", "true"]
LIAR_6WAY = {name: (i, name) for i, name in enumerate(LIAR_LABELS)}
LIAR_3WAY = {
    "pants-fire": (0, "unreliable"),
    "false": (0, "unreliable"),
    "barely-true": (1, "mixed"),
    "half-true": (1, "mixed"),
    "mostly-true": (2, "reliable"),
    "true": (2, "reliable"),
}
LIAR_2WAY = {
    "pants-fire": (0, "fake"),
    "false": (0, "fake"),
    "barely-true": (0, "fake"),
    "half-true": (1, "true"),
    "mostly-true": (1, "true"),
    "true": (1, "true"),
}
NELA_3WAY = {0: "reliable", 1: "mixed", 2: "unreliable"}

SYNTH_LABELS = {
    "2way": ["true", "fake"],
    "3way": ["true", "satire/parody", "fake"],
    "6way": ["true", "satire/parody", "misleading content", "imposter content",
             "false connection", "manipulated content"],
}
BINARY_NAMES = {0: "fake", 1: "true"}
# ---------------------------------------------------------------------------

LIAR_SCHEMES = {"6way": LIAR_6WAY, "3way": LIAR_3WAY, "2way": LIAR_2WAY}
FAKEDDIT_SCHEMES = {"6way": FAKEDDIT_6WAY, "3way": FAKEDDIT_3WAY, "2way": FAKEDDIT_2WAY}


# schemes whose class 0 is the true one
ZERO_IS_TRUE = ("fakeddit6", "fakeddit3", "fakeddit2", "sample6", "sample3", "sample2", "ternary")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def map_expr(mapping: dict) -> Column:
    """Literal MAP for a small, fixed dictionary (compiled into the plan)."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def name_for_id(id_col, mapping: dict) -> Column:
    """Class id -> name; ids outside the dictionary fall back to str(id)."""
    return F.coalesce(F.element_at(map_expr(mapping), _c(id_col)), _c(id_col).cast("string"))


def remap_liar(df: DataFrame, raw_col: str, scheme: str = "6way",
               id_col: str = "label_id", name_col: str = "label") -> DataFrame:
    """Raw LIAR label string (stripped) -> (label_id, label); unknown -> (-1, 'unknown')."""
    mapping = LIAR_SCHEMES[scheme]
    key = F.trim(_c(raw_col))
    ids = map_expr({k: v[0] for k, v in mapping.items()})
    names = map_expr({k: v[1] for k, v in mapping.items()})
    return (df.withColumn(id_col, F.coalesce(F.element_at(ids, key), F.lit(-1)).cast("int"))
              .withColumn(name_col, F.coalesce(F.element_at(names, key), F.lit("unknown"))))


def remap_fakeddit(df: DataFrame, id_col: str, scheme: str = "2way",
                   name_col: str = "label") -> DataFrame:
    """Fakeddit: only the *name* is mapped; the id stays the raw id (L1)."""
    return df.withColumn(name_col, F.element_at(map_expr(FAKEDDIT_SCHEMES[scheme]),
                                                _c(id_col).cast("int")))


def harmonise_binary(df: DataFrame, scheme: str, id_col: str = "label_id",
                     label_col: str = "label") -> DataFrame:
    """Map any supported scheme to binary (0 fake, 1 true).

    ``scheme`` is explicit: ``binary`` (ids kept), ``fakeddit6``,
    ``fakeddit3``, ``fakeddit2``, ``sample3``, ``sample2`` and ``ternary``
    (id 0 is the true class), ``liar6`` (<=2 -> 0).  ``auto`` reproduces the
    original detection rules with one small aggregate over the ids.
    """
    i = _c(id_col)
    if scheme == "auto":
        scheme = detect_scheme(df, id_col, label_col)
    if scheme == "binary":
        new = i
    elif scheme == "liar6":
        new = F.when(i <= 2, 0).otherwise(1)
    elif scheme in ZERO_IS_TRUE:
        new = F.when(i == 0, 1).otherwise(0)
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    return (df.withColumn(id_col, new.cast("int"))
              .withColumn(label_col, name_for_id(F.col(id_col), BINARY_NAMES)))


def detect_scheme(df: DataFrame, id_col: str = "label_id", label_col: str = "label") -> str:
    """Auto-detection rules on one tiny aggregate row:
    ids subset of {0,1} -> binary; max 5 and a label containing 'satire' ->
    fakeddit6; max 5 -> liar6; ids subset of {0,1,2} -> ternary; else error."""
    row = df.agg(
        F.min(id_col).alias("lo"), F.max(id_col).alias("hi"),
        F.bool_or(F.lower(F.col(label_col)).contains("satire")).alias("satire"),
    ).first()
    lo, hi, satire = row["lo"], row["hi"], bool(row["satire"])
    if lo is None:
        raise ValueError("empty label column")
    if lo >= 0 and hi <= 1:
        return "binary"
    if hi == 5 and satire:
        return "fakeddit6"
    if hi == 5:
        return "liar6"
    if lo >= 0 and hi <= 2:
        return "ternary"
    raise ValueError(f"cannot harmonise label ids in [{lo}, {hi}] to binary")
