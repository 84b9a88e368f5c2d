"""Column expressions over person, institution and lab names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acadspark.functions import constants as K
from acadspark.functions.text import alternation, clean_text


def display_name(col: Column) -> Column:
    """Name without leading titles, trailing degrees and stray commas."""
    out = F.regexp_replace(clean_text(col), rf"^(?:(?:{alternation(K.NAME_PREFIXES)})\s*)+", "")
    out = F.regexp_replace(out, rf"(?:\s*(?:{alternation(K.NAME_SUFFIXES)}))+$", "")
    out = F.regexp_replace(out, r",\s*,", ",")
    return F.trim(F.regexp_replace(out, r",\s*$", ""))


def person_key(col: Column) -> Column:
    """Lower-case name tokens without titles and punctuation, joined by '::'."""
    words = F.filter(F.split(F.trim(F.lower(F.coalesce(col, F.lit("")))), r"\s+"), lambda w: ~w.isin(*K.KEY_TITLES))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    return F.array_join(F.filter(bare, lambda w: w != ""), "::")


def institution_key(col: Column) -> Column:
    """Lower-case name without institution words, joined by '::'."""
    out = F.lower(F.coalesce(col, F.lit("")))
    for w in K.INSTITUTION_WORDS:
        out = F.replace(out, F.lit(w), F.lit(""))
    return F.regexp_replace(F.trim(out), r"\s+", "::")


def institution_slug(col: Column) -> Column:
    """Letters, digits, blanks, '-' and '_' only, blanks turned into '_'."""
    return F.replace(F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N} _-]", "")), F.lit(" "), F.lit("_"))


def dedup_key(name: Column, university: Column) -> Column:
    """university::first::last of the name without titles."""
    n = F.lower(display_name(name))
    words = F.filter(F.split(n, r"\s+"), lambda w: w != "")
    uni = F.lower(F.trim(F.coalesce(university, F.lit(""))))
    return F.when(
        F.size(words) >= 2, F.concat_ws("::", uni, F.element_at(words, 1), F.try_element_at(words, F.lit(-1)))
    ).otherwise(F.concat_ws("::", uni, n))


def lab_role(name: Column, lab_name: Column) -> Column:
    """Principal Investigator when the surname is part of the lab name, else member."""
    last = F.lower(F.try_element_at(F.split(F.trim(name), r"\s+"), F.lit(-1)))
    hit = F.lower(lab_name).contains(last)
    return F.when(F.coalesce(hit, F.lit(False)), F.lit("Principal Investigator")).otherwise(F.lit("member"))


def university_id(col: Column) -> Column:
    return F.concat(F.lit("univ_"), institution_key(F.coalesce(col, F.lit("Unknown University"))))


def department_id(university: Column, department: Column) -> Column:
    return F.concat(F.lit("dept_"), university_id(university), F.lit("_"),
                    institution_key(F.coalesce(department, F.lit("Unknown Department"))))


def lab_id(university: Column, lab_name: Column, lab_url: Column) -> Column:
    """Id by university and lab name, else by a hash of the web site; null without both."""
    named = F.when(F.coalesce(lab_name, F.lit("")) != "",
                   F.concat(F.lit("lab_"), university_id(university), F.lit("_"), institution_key(lab_name)))
    by_url = F.when(F.coalesce(lab_url, F.lit("")) != "", F.concat(F.lit("lab_"), F.substring(F.sha2(lab_url, 256), 1, 8)))
    return F.coalesce(named, by_url)


def person_id(key: Column) -> Column:
    return F.concat(F.lit("fac_"), F.substring(F.sha2(key, 256), 1, 16))
