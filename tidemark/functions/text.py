"""Column expressions on texts: cases, phrases, durations, ranges and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of urgency, the sentence that names a patient's state, and the sentence that names what the nurse did.
URGENCIES = ("ASAP", "Critical", "Urgent", "Action", "Review", "Monitoring", "Ongoing assessment", "Follow-up")
STATE = r"(?i)The patient is (stable|in pain|dizzy|weak|restless|comfortable|improving)"
ACTION = r"(?i)The nurse (\w+) the ([^.]+)\."


def title_case(text: Column) -> Column:
    """Each word in lower case with a capital first letter, a word beginning after blanks and hyphens."""
    return F.array_join(F.transform(F.split(F.lower(text), "-"), lambda x: F.initcap(x)), "-")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_match(text: Column, pattern: str, missing: str) -> Column:
    """The first group of the pattern's first match in title case; ``missing`` where nothing matches."""
    return F.coalesce(title_case(F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))), F.lit(missing))


def note_urgency(note: Column) -> Column:
    """The word of urgency that comes first in the note, as a whole word and whatever its case; 'None' without one."""
    return first_match(note, r"(?i)\b(" + "|".join(URGENCIES) + r")\b", "None")


def note_status(note: Column) -> Column:
    """The state in a note's sentence on the patient; 'Unknown' without one."""
    return first_match(note, STATE, "Unknown")


def note_action(note: Column) -> Column:
    """'<verb> the <object>' of a note's sentence on the nurse, 'Unknown' without one."""
    return F.when(F.rlike(note, F.lit(ACTION)), F.concat(F.lower(F.regexp_extract(note, ACTION, 1)), F.lit(" the "), stripped(F.regexp_extract(note, ACTION, 2)))).otherwise("Unknown")


def contains_any_case(text: Column, term: str) -> Column:
    """1 where the text holds the term, whatever the case; 0 elsewhere and for null."""
    return F.coalesce(F.contains(F.lower(text), F.lit(term.lower())), F.lit(False)).cast("int")


def range_midpoint(text: Column, between: str = " TO ") -> Column:
    """Middle of a range such as '07 TO 09'; null where it is none."""
    parts = F.split(text, between)
    return F.when(F.size(parts) == 2, (F.trim(F.get(parts, F.lit(0))).try_cast("int") + F.trim(F.get(parts, F.lit(1))).try_cast("int")) / 2.0)


def years_of(text: Column) -> Column:
    """Years of a duration such as '61 years 04 months'; bare digits are years, a text without either is 0, null stays null."""
    number = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)\s*" + unit, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(text.isNull(), None).when(F.rlike(text, F.lit(r"^\s*\d+\s*$")), F.trim(text).try_cast("double")).otherwise(number("year") + number("month") / 12)


def number_in(text: Column) -> Column:
    """The first run of digits as a number, to sort by."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("bigint")


def word_count(text: Column) -> Column:
    trimmed = stripped(text)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
