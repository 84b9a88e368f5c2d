"""Column expressions over text: cleaning, contacts and labelled fields."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from acadspark.functions import constants as K
from acadspark.functions.steps import let

#: White space other than one blank, which is left as it is: a run of two and more, or one that begins with another character.
SPACE = r" [ \t\n\x0B\f\r\x{00A0}]+|[\t\n\x0B\f\r\x{00A0}][ \t\n\x0B\f\r\x{00A0}]*"
CONTROL = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"


def alternation(words) -> str:
    """Regular expression matching any of the literal words."""
    return "|".join(re.sub(r"([.\\+*?\[^\]$(){}|/~#-])", r"\\\1", w) if not w.isalnum() else w for w in words)


def contains_any(col: Column, words) -> Column:
    """True when ``col`` contains at least one of the words (one compiled alternation)."""
    return col.rlike(alternation(words))


def holds_any(col: Column, words) -> Column:
    """``contains_any`` by a search for each word, which costs less than the alternation where few words are long sought in vain."""
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def may_match(text: Column, pattern: str) -> Column | None:
    """True where ``text`` holds one of the words of which every match of the pattern has one; None for patterns without such words."""
    words = NEEDED.get(pattern)
    return holds_any(F.lower(text) if pattern.startswith("(?i") else text, words) if words else None


def count_containing(col: Column, words) -> Column:
    """How many of the words occur in ``col``."""
    return reduce(lambda a, b: a + b, [col.contains(w).cast("int") for w in words])


def list_containing(col: Column, words) -> Column:
    """Words found in lower-cased ``col``, in list order."""
    return let(F.lower(col), lambda low: F.array_compact(F.array(*[F.when(low.contains(w.lower()), F.lit(w)) for w in words])))


def clean_text(col: Column) -> Column:
    """Decode entities, collapse white space, drop control characters; null becomes ''."""
    raw = F.coalesce(col, F.lit(""))
    out = raw
    for entity, char in K.ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    # most texts hold no entity at all or only the last one
    name, char = K.ENTITIES[-1]
    out = F.when(~raw.contains("&"), raw).when(~raw.rlike(f"&(?!{name[1:]})"), F.replace(raw, F.lit(name), F.lit(char))).otherwise(out)
    out = F.trim(F.regexp_replace(out, SPACE, " "))
    return F.regexp_replace(out, CONTROL, "")


def strip_markup(col: Column) -> Column:
    """Remove comments, scripts, styles and tags."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(out, r"<[^>]*>", " ")


def clean_html(col: Column) -> Column:
    """Readable text of an HTML string."""
    return clean_text(strip_markup(col))


def emails(col: Column) -> Column:
    """Distinct lower-case e-mail addresses, sorted."""
    found = _all_matches(F.coalesce(col, F.lit("")), K.EMAIL, 0)
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def phones(col: Column) -> Column:
    """Distinct phone numbers as ``(ddd) ddd-dddd``, sorted."""
    text = F.coalesce(col, F.lit(""))

    def formatted(pattern):
        found = _all_matches(text, pattern, 0)
        return F.transform(found, lambda m: F.regexp_replace(m, pattern, "($1) $2-$3"))

    parts = [formatted(p) for p in K.PHONE_FORMATS]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def urls(col: Column) -> Column:
    """Distinct absolute URLs, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(K.URL), F.lit(0))))


def phone_context(col: Column) -> Column:
    """Struct(main, office, lab): dashed phone numbers told apart by the 50 characters on either side."""
    text = F.coalesce(col, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(K.DASHED_PHONE), F.lit(0))
    gaps = F.split(text, K.DASHED_PHONE, -1)
    numbered = F.transform(
        found,
        lambda p, i: F.struct(
            p.alias("phone"),
            # every number is 12 characters long, so its offset follows from the gaps before it
            (F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, s: a + F.length(s)) + 12 * i).alias("at"),
        ),
    )
    placed = F.transform(
        numbered,
        lambda s: F.struct(
            s["phone"].alias("phone"),
            F.lower(F.substring(text, F.greatest(s["at"] - 50, F.lit(0)) + 1,
                                s["at"] + 62 - F.greatest(s["at"] - 50, F.lit(0)))).alias("around"),
        ),
    )
    office = F.filter(placed, lambda s: s["around"].contains("office"))
    lab = F.filter(placed, lambda s: ~s["around"].contains("office") & s["around"].contains("lab"))
    other = F.filter(placed, lambda s: ~s["around"].contains("office") & ~s["around"].contains("lab"))
    return F.struct(
        F.get(other, F.lit(0))["phone"].alias("main"),
        F.try_element_at(office, F.lit(-1))["phone"].alias("office"),
        F.try_element_at(lab, F.lit(-1))["phone"].alias("lab"),
    )


def first_field(col: Column, patterns, min_len: int = 0, max_len: int | None = None, group: int = 1, cut=None) -> Column:
    """First pattern whose first match, cleaned, has an acceptable length; else null."""
    options = []
    for p in patterns:
        def accept(got):
            ok = F.length(got) > min_len
            if max_len is not None:
                ok = ok & (F.length(got) < max_len)
            return F.when(ok, F.substring(got, 1, cut) if cut else got)

        got = let(F.regexp_extract(F.coalesce(col, F.lit("")), ANCHORED.get(p, p), group), clean_text)  # names its text several times
        likely = may_match(col, p)
        options.append(let(got, accept) if likely is None else F.when(likely, let(got, accept)))  # an empty match is never accepted
    return F.coalesce(*options)


def _all_matches(text: Column, pattern: str, group: int) -> Column:
    """All matches of a pattern, which is not tried where the text can't have one."""
    found, likely = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), may_match(text, pattern)
    return found if likely is None else F.when(likely, found).otherwise(F.array().cast("array<string>"))


def all_fields(col: Column, patterns, min_len: int = 0, cap: int | None = None, cut: int | None = None) -> Column:
    """Every cleaned match of every pattern longer than ``min_len``, in pattern order."""
    text = F.coalesce(col, F.lit(""))
    got = F.concat(*[_all_matches(text, p, 1) for p in patterns])
    out = F.filter(F.transform(got, clean_text), lambda x: F.length(x) > min_len)
    if cut:
        out = F.transform(out, lambda x: F.substring(x, 1, cut))
    return F.slice(out, 1, cap) if cap else out


def named_before(col: Column, nouns: str, min_len: int) -> Column:
    """Runs of two-letter-or-longer words that stand right before one of the nouns.

    Letters that stand alone end a run, so they are turned into bars first. The text is then split into runs and
    only runs that hold a noun meet the (anchored) pattern, which keeps the work linear in the text.
    """
    text = F.coalesce(col, F.lit(""))
    spread = F.regexp_replace(text, r"([^A-Za-z])", "$1$1")
    barred = F.regexp_replace(spread, r"(^|[^A-Za-z])[A-Za-z]($|[^A-Za-z])", "|")
    runs = F.filter(F.split(barred, r"[^A-Za-z\s]+"), lambda r: r.rlike(rf"(?i)\s(?:{nouns})"))
    got = F.transform(runs, lambda r: clean_text(F.regexp_extract(r, rf"(?i)^\s*([A-Z][A-Z\s]*)\s+(?:{nouns})", 1)))
    found = F.filter(got, lambda x: F.length(x) > min_len)
    # texts without any of the nouns, which are most, are left alone
    return F.when(holds_any(F.lower(text), nouns.split("|")) & text.rlike(rf"(?i)\s(?:{nouns})"), found).otherwise(F.array().cast("array<string>"))


def normalize_title(col: Column) -> Column:
    """Spell out abbreviated ranks."""
    out = clean_text(col)
    for short, full in (("Prof", "Professor"), ("Asst", "Assistant"), ("Assoc", "Associate")):
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    return F.trim(out)


def title_from(context: Column, name: Column) -> Column:
    """First rank phrase by pattern order that is not the name itself."""
    # fixed values: rank phrase patterns
    patterns = (
        r"(?i)((?:Professor|Associate Professor|Assistant Professor|Lecturer|Instructor)[^,\n]*)",
        r"(?i)((?:Prof\.|Dr\.)[^,\n]*)",
        r"(?i)([^,\n]*(?:Professor|Chair|Director)[^,\n]*)",
    )
    text = F.coalesce(context, F.lit(""))
    options = [
        F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), normalize_title),
                       lambda t: (t != "") & (F.lower(t) != F.lower(name))), F.lit(0))
        for p in patterns
    ]
    return F.coalesce(*options)


# fixed values: labelled field patterns
LAB_NAME_PATTERNS = (
    r"(?i)Director,?\s*([^,\n]*(?:Lab|Laboratory|Center|Institute)[^,\n]*)",
    r"(?i)([^,\n]*(?:Lab|Laboratory|Center|Institute)[^,\n]*)",
    r"(?i)PI,?\s*([^,\n]*(?:Lab|Laboratory)[^,\n]*)",
)
#: Patterns whose first match always begins where a line or part begins, and the same patterns looked for only there: a text
#: without a match is read once instead of once for each of its characters.
ANCHORED = {LAB_NAME_PATTERNS[1]: r"(?<![^,\n])" + LAB_NAME_PATTERNS[1]}
PRONOUN_PATTERNS = (
    r"(?i)\b((?:He|She|They)/(?:Him|Her|Them))\b",
    r"(?i)\(([^)]*(?:he|she|they)/[^)]*)\)",
    r"(?i)Pronouns?\s*:\s*([^,\n.]+)",
)
OFFICE_PATTERNS = (
    r"(?i)Office[:\s]*([^,\n]+)", r"(?i)Room[:\s]*([^,\n]+)", r"(?i)Building[:\s]*([^,\n]+)",
    r"(?i)Location[:\s]*([^,\n]+)",
)
LOCATION_PATTERNS = (r"(?i)(?:Location|Address|Building)[:\s]*([^,\n]+)", r"(?i)Room\s+(\w+)", r"(?i)(\w+\s+Building)")
OFFICE_HOURS = r"(?i)(?:office\s+hours?|hours?)[\s:]*([^\n.]+)"
DESCRIPTION_PATTERNS = (
    r"(?is)(?:Program|Department)\s+Description[:\s]*[^\.]+\.", r"(?is)(?:About|Overview)[:\s]*[^\.]+\.",
    r"(?is)The\s+[\w\s]+\s+program[^\.]*\.", r"(?is)Our\s+[\w\s]+\s+department[^\.]*\.",
)
SPECIALIZATION_PATTERNS = (
    r"(?i)specialization[s]?[:\s]*([^\.]+)", r"(?i)track[s]?[:\s]*([^\.]+)", r"(?i)concentration[s]?[:\s]*([^\.]+)",
    r"(?i)area[s]? of study[:\s]*([^\.]+)", r"(?i)focus area[s]?[:\s]*([^\.]+)",
)
MEMBER_PATTERNS = (
    r"(?:PhD Student|Graduate Student|Postdoc|Research Assistant|Lab Manager)[:\s]*([^,\n]+)",
    r"([A-Z][a-z]+\s+[A-Z][a-z]+)(?:\s*[,-]\s*(?:PhD|MS|BS|Graduate|Postdoc))",
)
RESEARCH_TEXT_PATTERNS = (
    r"(?is)(?:Research|About|Overview)[:\s]*[^\.]+(?:\.[^\.]+){1,3}",
    r"(?is)Our\s+(?:research|lab|work)[^\.]*(?:\.[^\.]+){1,2}",
)
PROJECT_PATTERNS = (r"(?i)(?:Current Projects?|Ongoing Research)[:\s]*([^\.]+)", r"(?i)(?:Project|Study)[:\s]*([^,\n]+)")
EQUIPMENT_PATTERNS = (r"(?i)(?:Equipment|Instrumentation|Facilities)[:\s]*([^\.]+)",)
FACILITY_PATTERNS = (
    r"(?i)(?:Facilities|Rooms|Space)[:\s]*([^\.]+)", r"(?i)(\d+\s*sq\s*ft|square feet|laboratory space)",
)
DATASET_PATTERNS = (r"(?i)(?:Dataset|Database|Data)[:\s]*([^,\n]+)",)
OPPORTUNITY_PATTERNS = (
    r"(?i)(?:Opportunities|Positions|Openings)[:\s]*([^\.]+)", r"(?i)(?:Seeking|Looking for|Recruiting)[:\s]*([^,\n]+)",
)
COLLABORATION_PATTERNS = (
    r"(?i)(?:Collaboration|Partnership|Contact)[:\s]*[^\.]+", r"(?i)Interested in collaborating[^\.]*",
)
#: Words of which every match of a pattern holds one, in lower case if the pattern ignores case: a text without them is searched for
#: the words only.
NEEDED = {
    LAB_NAME_PATTERNS[0]: ("director",), LAB_NAME_PATTERNS[1]: ("lab", "center", "institute"), LAB_NAME_PATTERNS[2]: ("pi",),
    PRONOUN_PATTERNS[0]: ("/him", "/her", "/them"), PRONOUN_PATTERNS[1]: ("he/", "they/"), PRONOUN_PATTERNS[2]: ("pronoun",),
    OFFICE_PATTERNS[0]: ("office",), OFFICE_PATTERNS[1]: ("room",), OFFICE_PATTERNS[2]: ("building",), OFFICE_PATTERNS[3]: ("location",),
    LOCATION_PATTERNS[0]: ("location", "address", "building"), LOCATION_PATTERNS[1]: ("room",), LOCATION_PATTERNS[2]: ("building",),
    MEMBER_PATTERNS[0]: ("PhD Student", "Graduate Student", "Postdoc", "Research Assistant", "Lab Manager"),
    MEMBER_PATTERNS[1]: ("PhD", "MS", "BS", "Graduate", "Postdoc"),
    RESEARCH_TEXT_PATTERNS[0]: ("research", "about", "overview"), RESEARCH_TEXT_PATTERNS[1]: ("our",),
    PROJECT_PATTERNS[0]: ("current project", "ongoing research"), PROJECT_PATTERNS[1]: ("project", "study"),
    EQUIPMENT_PATTERNS[0]: ("equipment", "instrumentation", "facilities"),
    FACILITY_PATTERNS[0]: ("facilities", "rooms", "space"), FACILITY_PATTERNS[1]: ("sq", "square feet", "laboratory space"),
    DATASET_PATTERNS[0]: ("dataset", "database", "data"),
    OPPORTUNITY_PATTERNS[0]: ("opportunities", "positions", "openings"), OPPORTUNITY_PATTERNS[1]: ("seeking", "looking for", "recruiting"),
    COLLABORATION_PATTERNS[0]: ("collaboration", "partnership", "contact"), COLLABORATION_PATTERNS[1]: ("interested in collaborating",),
    K.EMAIL: ("@",), K.PHONE_FORMATS[0]: ("(",), K.PHONE_FORMATS[1]: ("-",), K.PHONE_FORMATS[2]: (".",),
}


def interests(col: Column) -> Column:
    """Interest list: labels removed, split by the first delimiter present, 4 to 79 characters each."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?i)research interests?:?\s*", "")
    text = F.regexp_replace(text, r"(?i)areas? of expertise:?\s*", "")
    split = F.coalesce(*[F.when(text.contains(d), F.split(text, d)) for d in (";", ",", "•", "·", "\n")], F.array())
    parts = F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: (F.length(x) > 3) & (F.length(x) < 80))
    whole = F.trim(text)
    single = F.when((F.length(whole) > 3) & (F.length(whole) < 200), F.array(whole)).otherwise(F.array())
    return F.when(F.size(parts) > 0, parts).otherwise(single)


def specializations(col: Column) -> Column:
    """Distinct specialisation names of more than three characters."""
    text = F.coalesce(col, F.lit(""))
    got = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in SPECIALIZATION_PATTERNS])
    parts = F.flatten(F.transform(got, lambda x: F.split(clean_text(x), r"[,;]|\sand\s")))
    named = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 3)
    return F.array_distinct(named)


def program_description(col: Column) -> Column:
    """Labelled description of more than 20 characters, else the first long enough paragraph."""
    labelled = first_field(col, DESCRIPTION_PATTERNS, min_len=20, group=0)
    paragraphs = F.filter(
        F.transform(F.split(F.coalesce(col, F.lit("")), "\n"), clean_text),
        lambda p: (F.length(p) > 50) & ~contains_any(F.lower(p), ("menu", "navigation", "cookie", "copyright")),
    )
    return F.coalesce(labelled, F.get(paragraphs, F.lit(0)), F.lit(""))


def degree_types(col: Column) -> Column:
    """Degree types named in the text."""
    low = F.lower(F.coalesce(col, F.lit("")))
    return F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(d)) for d, words in K.DEGREE_WORDS]))


def program_department(col: Column) -> Column:
    """Department name left after the degree words are taken out."""
    out = F.coalesce(col, F.lit(""))
    for w in K.PROGRAM_WORDS:
        out = F.replace(out, F.lit(w), F.lit(" "))
    return clean_text(out)


def preferred(items: Column, words) -> Column:
    """First item with one of the words, else the first item, else null."""
    return let(items, lambda i: F.coalesce(F.get(F.filter(i, lambda e: contains_any(e, words)), F.lit(0)), F.get(i, F.lit(0))))


def lab_type(col: Column) -> Column:
    """teaching, clinical, service or research, in that order of precedence."""
    low = F.lower(F.coalesce(col, F.lit("")))
    return F.coalesce(*[F.when(holds_any(low, words), F.lit(t)) for t, words in K.LAB_TYPE_WORDS], F.lit("research"))


def lab_fields(col: Column) -> Column:
    """Struct of the labelled fields of a lab page text."""
    keyed = list_containing(col, K.EQUIPMENT_WORDS)
    named = all_fields(col, EQUIPMENT_PATTERNS, 3)
    devices = named_before(col, "system|equipment|device|instrument", 3)
    corpora = named_before(col, "dataset|database|corpus", 5)
    return F.struct(
        F.array_distinct(all_fields(col, MEMBER_PATTERNS, 0)).alias("members"),
        first_field(col, RESEARCH_TEXT_PATTERNS, min_len=50, group=0).alias("description"),
        all_fields(col, PROJECT_PATTERNS, 10).alias("projects"),
        F.array_sort(F.array_distinct(F.concat(keyed, named, devices))).alias("equipment"),
        all_fields(col, FACILITY_PATTERNS, 3).alias("facilities"),
        F.concat(all_fields(col, DATASET_PATTERNS, 5), corpora).alias("datasets"),
        F.array_sort(list_containing(col, K.SOFTWARE_WORDS)).alias("software"),
        all_fields(col, OPPORTUNITY_PATTERNS, 10).alias("opportunities"),
        first_field(col, COLLABORATION_PATTERNS, min_len=20, group=0).alias("collaboration"),
    )


def member_role(col: Column) -> Column:
    """First matching role phrase by pattern order, else ''."""
    low = F.lower(F.coalesce(col, F.lit("")))
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in K.ROLE_PATTERNS], F.lit(""))


def area_phrases(col: Column) -> Column:
    """Distinct research area phrases, sorted."""
    low = F.lower(F.coalesce(col, F.lit("")))
    got = F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in K.AREA_PATTERNS])
    return F.array_sort(F.array_distinct(got))


def member_fields(col: Column) -> Column:
    """Struct(role, email, phone, office, interests) of one member text."""
    text = F.coalesce(col, F.lit(""))
    phone = F.regexp_extract(text, K.MEMBER_PHONE, 0)
    # fixed values: office patterns and words that mark a sentence about interests
    room = F.regexp_extract(text, r"(?i)(room|office|lab)\s+(\w+\s*\d+)", 0)
    parts = [
        F.when(room != "", F.concat_ws(" ", F.regexp_extract(text, r"(?i)(room|office|lab)\s+(\w+\s*\d+)", 1),
                                       F.regexp_extract(text, r"(?i)(room|office|lab)\s+(\w+\s*\d+)", 2))),
        F.when(F.regexp_extract(text, r"(?i)(building|bldg)\s+(\w+)", 0) != "",
               F.concat_ws(" ", F.regexp_extract(text, r"(?i)(building|bldg)\s+(\w+)", 1),
                           F.regexp_extract(text, r"(?i)(building|bldg)\s+(\w+)", 2))),
        F.nullif(F.regexp_extract(text, r"(?i)(\d+\s+\w+\s+(?:hall|building|center))", 1), F.lit("")),
        F.lit(""),
    ]
    marked = F.filter(
        F.split(text, r"\."),
        lambda s: contains_any(F.lower(s), ("research", "interests", "focus", "specialization", "expertise")),
    )
    return F.struct(
        member_role(text).alias("role"),
        F.regexp_extract(text, K.EMAIL, 0).alias("email"),
        F.when(phone == "", "").otherwise(F.concat_ws("-", *[F.regexp_extract(text, K.MEMBER_PHONE, g) for g in (1, 2, 3)])).alias("phone"),
        F.coalesce(*parts).alias("office"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(marked, area_phrases)))).alias("interests"),
    )


def project_fields(col: Column) -> Column:
    """Struct of funding, dates, status, keywords, methods and objectives of one project text."""
    text = F.coalesce(col, F.lit(""))
    low = F.lower(text)
    # fixed values: project patterns
    funded = r"(?i)(funded by|supported by|sponsored by)\s+([^,.]+)"
    amount = r"(?i)(\$[\d,]+(?:\.\d+)?(?:\s*(?:million|thousand|k|m))?)"
    agency = r"(?i)(nsf|nih|doe|darpa|nasa|onr|afosr)\s*([^,.]+)"
    years = r"(\d{4})\s*[-\x{2013}]\s*(\d{4})"
    started = r"(?i)(started|began|commenced)\s+(?:in\s+)?(\d{4})"
    ended = r"(?i)(ends|concludes|completed)\s+(?:in\s+)?(\d{4})"

    def got(p, g):
        return F.nullif(F.regexp_extract(text, p, g), F.lit(""))

    return F.struct(
        F.coalesce(got(agency, 2), got(funded, 2), F.lit("")).alias("funding_agency"),
        F.coalesce(got(amount, 1), F.lit("")).alias("funding_amount"),
        F.coalesce(got(started, 2), got(years, 1), F.lit("")).alias("start_date"),
        F.coalesce(got(ended, 2), got(years, 2), F.lit("")).alias("end_date"),
        F.coalesce(*[F.when(contains_any(low, w), F.lit(s)) for s, w in K.STATUS_WORDS], F.lit("unknown")).alias("status"),
        F.transform(F.filter(F.split(F.coalesce(got(r"(?i)(keywords?|tags?|topics?):\s*([^.]+)", 2), F.lit("")), ","),
                             lambda x: F.trim(x) != ""), lambda x: F.trim(x)).alias("keywords"),
        F.coalesce(got(r"(?i)(methodology|methods?|approach):\s*([^.]+)", 2), F.lit("")).alias("methodology"),
        F.coalesce(got(r"(?i)(objectives?|goals?):\s*([^.]+)", 2), F.lit("")).alias("objectives"),
    )
