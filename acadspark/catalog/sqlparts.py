"""Building blocks of the DuckDB oracle texts."""

from __future__ import annotations

from acadspark.functions import constants as K
from acadspark.functions import text as X
from acadspark.functions.text import alternation


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(col: str, words) -> str:
    """col contains any of the words."""
    return f"regexp_matches({col}, {q(alternation(words))})"


def arr(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def clean(col: str) -> str:
    out = f"coalesce({col}, '')"
    for entity, char in K.ENTITIES:
        out = f"replace({out}, {q(entity)}, {q(char)})"
    out = f"trim(regexp_replace({out}, {q(X.SPACE)}, ' ', 'g'))"
    return f"regexp_replace({out}, {q(X.CONTROL)}, '', 'g')"


def strip_markup(col: str) -> str:
    out = f"regexp_replace(coalesce({col}, ''), '(?s)<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    return f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"


def clean_html(col: str) -> str:
    return clean(strip_markup(col))


def emails(col: str) -> str:
    return (f"list_sort(list_distinct(list_transform(regexp_extract_all(coalesce({col}, ''), {q(K.EMAIL)}), "
            "lambda e: lower(e))))")


def phones(col: str) -> str:
    parts = ", ".join(
        f"list_transform(regexp_extract_all(coalesce({col}, ''), {q(p)}), lambda m: regexp_replace(m, {q(p)}, '(\\1) \\2-\\3'))"
        for p in K.PHONE_FORMATS
    )
    return f"list_sort(list_distinct(flatten([{parts}])))"


def joined(lst: str, sep: str = " | ") -> str:
    return f"coalesce(array_to_string({lst}, {q(sep)}), '')"


def first_field(col: str, patterns, min_len=0, max_len=None, group=1, cut=None) -> str:
    opts = []
    for p in patterns:
        got = clean(f"regexp_extract({col}, {q(p)}, {group})")
        cond = f"length({got}) > {min_len}" + (f" AND length({got}) < {max_len}" if max_len else "")
        opts.append(f"CASE WHEN {cond} THEN {f'substr({got}, 1, {cut})' if cut else got} END")
    return f"coalesce({', '.join(opts)})" if len(opts) > 1 else opts[0]


def all_fields(col: str, patterns, min_len=0, cap=None, cut=None) -> str:
    got = "flatten([" + ", ".join(f"regexp_extract_all(coalesce({col}, ''), {q(p)}, 1)" for p in patterns) + "])"
    out = f"list_filter(list_transform({got}, lambda x: {clean('x')}), lambda x: length(x) > {min_len})"
    if cut:
        out = f"list_transform({out}, lambda x: substr(x, 1, {cut}))"
    return f"({out})[1:{cap}]" if cap else out


def named_before(col: str, nouns: str, min_len: int) -> str:
    spread = f"regexp_replace(coalesce({col}, ''), '([^A-Za-z])', '\\1\\1', 'g')"
    barred = f"regexp_replace({spread}, '(^|[^A-Za-z])[A-Za-z]($|[^A-Za-z])', '|', 'g')"
    pat = rf"(?i)([A-Z][A-Z\s]*)\s+(?:{nouns})"
    return (f"list_filter(list_transform(regexp_extract_all({barred}, {q(pat)}, 1), lambda x: {clean('x')}), "
            f"lambda x: length(x) > {min_len})")


def display_name(col: str) -> str:
    out = f"regexp_replace({clean(col)}, {q(rf'^(?:(?:{alternation(K.NAME_PREFIXES)})\s*)+')}, '')"
    out = f"regexp_replace({out}, {q(rf'(?:\s*(?:{alternation(K.NAME_SUFFIXES)}))+$')}, '')"
    out = f"regexp_replace({out}, ',\\s*,', ',', 'g')"
    return f"trim(regexp_replace({out}, ',\\s*$', ''))"


def person_key(col: str) -> str:
    words = f"list_filter(regexp_split_to_array(trim(lower(coalesce({col}, ''))), '\\s+'), lambda w: w NOT IN ({', '.join(q(t) for t in K.KEY_TITLES)}))"
    bare = f"list_transform({words}, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))"
    return f"array_to_string(list_filter({bare}, lambda w: w <> ''), '::')"


def institution_key(col: str) -> str:
    out = f"lower(coalesce({col}, ''))"
    for w in K.INSTITUTION_WORDS:
        out = f"replace({out}, {q(w)}, '')"
    return f"regexp_replace(trim({out}), '\\s+', '::', 'g')"


def dedup_key(name: str, uni: str) -> str:
    n = f"lower({display_name(name)})"
    words = f"list_filter(regexp_split_to_array({n}, '\\s+'), lambda w: w <> '')"
    u = f"lower(trim(coalesce({uni}, '')))"
    return f"CASE WHEN len({words}) >= 2 THEN concat_ws('::', {u}, ({words})[1], ({words})[-1]) ELSE concat_ws('::', {u}, {n}) END"


def lab_role(name: str, lab: str) -> str:
    last = f"lower((regexp_split_to_array(trim({name}), '\\s+'))[-1])"
    return f"CASE WHEN contains(lower({lab}), {last}) THEN 'Principal Investigator' ELSE 'member' END"


def university_id(col: str) -> str:
    return f"concat('univ_', {institution_key(col)})"


def department_id(uni: str, dep: str) -> str:
    return f"concat('dept_', {university_id(uni)}, '_', {institution_key(dep)})"


def lab_id(uni: str, lab: str, url: str) -> str:
    return (f"CASE WHEN coalesce({lab}, '') <> '' THEN concat('lab_', {university_id(uni)}, '_', {institution_key(lab)}) "
            f"WHEN coalesce({url}, '') <> '' THEN concat('lab_', substr(sha256({url}), 1, 8)) END")


def person_id(key: str) -> str:
    return f"concat('fac_', substr(sha256({key}), 1, 16))"


def authority(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def path(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _class_rules(url: str, match: str = "suffix"):
    low = f"lower({url})"
    host = f"replace({authority(low)}, 'www.', '')"
    p = path(low)

    def hosts(names):
        if match == "substring":
            return rx(host, names)
        return f"regexp_matches({host}, {q(rf'(^|\.)({alternation(names)})(:\d+)?$')})"

    ac = f"regexp_matches({host}, {q(rf'\.({alternation(K.ACADEMIC_SUFFIXES)})$')})"
    lab, field = rx(p, K.LAB_PATH_WORDS), rx(p, K.FIELD_PATH_WORDS)
    return [
        (f"{url} IS NULL OR {url} = ''", "invalid", 0),
        (hosts(K.SOCIAL_HOSTS), "social_media", 90),
        (hosts((K.SCHOLAR_HOST,)), "google_scholar", 95),
        (hosts(K.PROFILE_HOSTS), "academic_profile", 90),
        (hosts(K.PUBLICATION_HOSTS), "publication", 80),
        (f"{ac} AND {lab} AND {field}", "lab_website", 90),
        (f"{ac} AND {lab}", "lab_website", 85),
        (f"{ac} AND {field} AND regexp_matches({p}, 'research|study')", "lab_website", 80),
        (f"{ac} AND {rx(p, K.PEOPLE_PATH_WORDS)}", "university_profile", 85),
        (f"{ac} AND {rx(p, K.PERSONAL_PATH_WORDS)}", "personal_website", 90),
        (ac, "university_profile", 60),
        (f"regexp_matches({host}, '\\.(com|org|net)$') AND length(split_part({host}, '.', 1)) <= 15", "personal_website", 70),
    ]


def link_type(url: str, match: str = "suffix") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in _class_rules(url, match)) + " ELSE 'unknown' END"


def link_pct(url: str, match: str = "suffix") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {p}" for c, _, p in _class_rules(url, match)) + " ELSE 30 END"


# long link table with class and confidence in hundredths; use after WITH
LINKS = f"""links AS (
  SELECT obs_id, person_key, name, university, department, field, url, {link_type('url')} AS link_type, {link_pct('url')} AS pct
  FROM (SELECT obs_id, person_key, name, university, department, 'profile_url' AS field, profile_url AS url FROM observations
        UNION ALL SELECT obs_id, person_key, name, university, department, 'personal_website', personal_website FROM observations
        UNION ALL SELECT obs_id, person_key, name, university, department, 'lab_website', lab_website FROM observations) u
  WHERE url IS NOT NULL AND url <> '')"""

# page anchors in order of appearance
def anchors(page_table: str = "profile_pages") -> str:
    body = f"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    pat = "(?is)<a\\s[^>]*href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
    return f"""anchors AS (
  SELECT page_id, page_url, pos, trim(regexp_extract(tag, '{pat}', 1)) AS href,
         {clean(f"regexp_replace(regexp_extract(tag, '{pat}', 2), '<[^>]*>', ' ', 'g')")} AS text
  FROM (SELECT page_id, page_url, unnest(tags) AS tag, CAST(unnest(range(len(tags))) AS BIGINT) AS pos
        FROM (SELECT page_id, url AS page_url, regexp_extract_all({body}, '{pat}') AS tags FROM {page_table}) a) b)"""
