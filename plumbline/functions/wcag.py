"""The success-criterion dimension and its text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Success criteria with their levels and names.
CRITERIA = [
    ("1.1.1", "A", "Non-text Content"),
    ("1.2.1", "A", "Audio-only and Video-only (Prerecorded)"),
    ("1.2.2", "A", "Captions (Prerecorded)"),
    ("1.2.3", "A", "Audio Description or Media Alternative (Prerecorded)"),
    ("1.2.4", "AA", "Captions (Live)"),
    ("1.2.5", "AA", "Audio Description (Prerecorded)"),
    ("1.3.1", "A", "Info and Relationships"),
    ("1.3.2", "A", "Meaningful Sequence"),
    ("1.3.3", "A", "Sensory Characteristics"),
    ("1.3.4", "AA", "Orientation"),
    ("1.3.5", "AA", "Identify Input Purpose"),
    ("1.4.1", "A", "Use of Color"),
    ("1.4.2", "A", "Audio Control"),
    ("1.4.3", "AA", "Contrast (Minimum)"),
    ("1.4.4", "AA", "Resize Text"),
    ("1.4.5", "AA", "Images of Text"),
    ("1.4.10", "AA", "Reflow"),
    ("1.4.11", "AA", "Non-text Contrast"),
    ("1.4.12", "AA", "Text Spacing"),
    ("1.4.13", "AA", "Content on Hover or Focus"),
    ("2.1.1", "A", "Keyboard"),
    ("2.1.2", "A", "No Keyboard Trap"),
    ("2.1.4", "A", "Character Key Shortcuts"),
    ("2.2.1", "A", "Timing Adjustable"),
    ("2.2.2", "A", "Pause, Stop, Hide"),
    ("2.3.1", "A", "Three Flashes or Below Threshold"),
    ("2.4.1", "A", "Bypass Blocks"),
    ("2.4.2", "A", "Page Titled"),
    ("2.4.3", "A", "Focus Order"),
    ("2.4.4", "A", "Link Purpose (In Context)"),
    ("2.4.5", "AA", "Multiple Ways"),
    ("2.4.6", "AA", "Headings and Labels"),
    ("2.4.7", "AA", "Focus Visible"),
    ("2.4.11", "AA", "Focus Not Obscured (Minimum)"),
    ("2.5.1", "A", "Pointer Gestures"),
    ("2.5.2", "A", "Pointer Cancellation"),
    ("2.5.3", "A", "Label in Name"),
    ("2.5.4", "A", "Motion Actuation"),
    ("2.5.7", "AA", "Dragging Movements"),
    ("2.5.8", "AA", "Target Size (Minimum)"),
    ("3.1.1", "A", "Language of Page"),
    ("3.1.2", "AA", "Language of Parts"),
    ("3.2.1", "A", "On Focus"),
    ("3.2.2", "A", "On Input"),
    ("3.2.3", "AA", "Consistent Navigation"),
    ("3.2.4", "AA", "Consistent Identification"),
    ("3.2.6", "A", "Consistent Help"),
    ("3.3.1", "A", "Error Identification"),
    ("3.3.2", "A", "Labels or Instructions"),
    ("3.3.3", "AA", "Error Suggestion"),
    ("3.3.4", "AA", "Error Prevention (Legal, Financial, Data)"),
    ("3.3.7", "A", "Redundant Entry"),
    ("3.3.8", "AA", "Accessible Authentication (Minimum)"),
    ("4.1.2", "A", "Name, Role, Value"),
    ("4.1.3", "AA", "Status Messages"),
]


def criteria(spark: SparkSession) -> DataFrame:
    """(number, level, name) of the known criteria; a fixed few dozen rows."""
    return spark.createDataFrame(CRITERIA, "number string, level string, name string")


def normalise_criterion(raw: Column) -> Column:
    """1.4.3 of ``1.4.3``, ``WCAG 1.4.3`` or ``143``; NULL for anything else."""
    bare = F.regexp_replace(F.lower(F.trim(raw)), r"^wcag\s*", "")
    dotted = F.when(bare.rlike(r"^\d\d\d+$"), F.regexp_replace(bare, r"^(\d)(\d)(\d+)$", "$1.$2.$3")).otherwise(bare)
    return F.when(dotted.rlike(r"^\d+\.\d+\.\d+$"), dotted)


def describe_criteria(rows: DataFrame, raw: str) -> DataFrame:
    """``rows`` with number, level, name and a description; unknown criteria describe themselves."""
    dim = F.broadcast(criteria(rows.sparkSession))
    out = rows.withColumn("number", normalise_criterion(F.col(raw))).join(dim, "number", "left")
    known = F.concat("number", F.lit(" "), "name", F.lit(" ("), "level", F.lit(")"))
    return out.withColumn("description", F.coalesce(known, F.col(raw)))


def numeric_order(number: Column) -> Column:
    """Sort key by which 1.4.3 comes before 1.4.10."""
    return F.transform(F.split(number, r"\."), lambda p: p.cast("int"))


def distinct_criteria(rows: DataFrame, criteria_col: str) -> DataFrame:
    """Known criteria named anywhere in an array column, once each, in numeric order."""
    found = rows.select(F.explode(criteria_col).alias("raw")).distinct()
    return describe_criteria(found, "raw").filter("name is not null").select("number", "level", "name").distinct().orderBy(numeric_order(F.col("number")))
