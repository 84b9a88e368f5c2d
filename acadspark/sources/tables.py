"""Readers of crawled data, result files, directories and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acadspark.functions import urls as U

# --- fixed values: person fields of result files, envelope keys, codes of the institution directory ---
PERSON = ("name", "title", "university", "department", "email", "phone", "office", "profile_url", "personal_website", "lab_website",
          "lab_name", "research_interests")
ENVELOPES = ("faculty", "enhanced_faculty", "processed_faculty", "results")
OWNERSHIP = ((1, "public"), (2, "private-nonprofit"), (3, "private-for-profit"))
STATES = (
    ("01", "Alabama"), ("02", "Alaska"), ("04", "Arizona"), ("05", "Arkansas"), ("06", "California"), ("08", "Colorado"),
    ("09", "Connecticut"), ("10", "Delaware"), ("11", "District of Columbia"), ("12", "Florida"), ("13", "Georgia"), ("15", "Hawaii"),
    ("16", "Idaho"), ("17", "Illinois"), ("18", "Indiana"), ("19", "Iowa"), ("20", "Kansas"), ("21", "Kentucky"), ("22", "Louisiana"),
    ("23", "Maine"), ("24", "Maryland"), ("25", "Massachusetts"), ("26", "Michigan"), ("27", "Minnesota"), ("28", "Mississippi"),
    ("29", "Missouri"), ("30", "Montana"), ("31", "Nebraska"), ("32", "Nevada"), ("33", "New Hampshire"), ("34", "New Jersey"),
    ("35", "New Mexico"), ("36", "New York"), ("37", "North Carolina"), ("38", "North Dakota"), ("39", "Ohio"), ("40", "Oklahoma"),
    ("41", "Oregon"), ("42", "Pennsylvania"), ("44", "Rhode Island"), ("45", "South Carolina"), ("46", "South Dakota"), ("47", "Tennessee"),
    ("48", "Texas"), ("49", "Utah"), ("50", "Vermont"), ("51", "Virginia"), ("53", "Washington"), ("54", "West Virginia"),
    ("55", "Wisconsin"), ("56", "Wyoming"),
)
DIRECTORY_WORDS = ("faculty", "people", "staff", "directory", "our-people", "team", "members", "professors", "researchers")


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages with status and title; columns that a crawl did not store are filled with defaults."""
    df = spark.read.parquet(path)
    if "status" not in df.columns:
        df = df.withColumn("status", F.lit(200))
    if "load_ms" not in df.columns:
        df = df.withColumn("load_ms", F.lit(None).cast("double"))
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]+)</title>", 1)), F.lit(""))
    return df.select("page_id", "url", "status", title.alias("title"), "html", "load_ms")


def scan_result_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """People of result files: an object with one of the envelope keys (the first non-empty one) or a bare list.

    ``multi_line`` reads one document per file; without it every line is a document and files can be split.
    """
    person = T.StructType([T.StructField(c, T.StringType()) for c in PERSON])
    schema = T.StructType([*person.fields, *[T.StructField(e, T.ArrayType(person)) for e in ENVELOPES]])
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    filled = F.coalesce(*[F.when(F.size(e) > 0, F.col(e)) for e in ENVELOPES])
    bare = F.when(F.col("name").isNotNull(), F.array(F.struct(*PERSON)))
    return raw.select(F.col("_metadata.file_name").alias("file_name"), F.inline(F.coalesce(filled, bare)))


def scan_result_variant(spark: SparkSession, path: str) -> DataFrame:
    """People of result files of any shape, one document per line: an object with one of the envelope keys (the first that holds
    a list), a bare list, or a single record. Files can be split at lines.

    Returns the person fields, ``record`` (the record's whole JSON, unknown keys included) and ``issue``: null for a person,
    "missing name", "not a record" (a list entry that is no object) or "not JSON" (the line is in ``record`` then).
    """
    lines = spark.read.text(path).select("value", F.try_parse_json("value").alias("doc"))
    kind = F.schema_of_variant("doc")
    lists = F.coalesce(*[F.when(F.schema_of_variant(got := F.try_variant_get("doc", f"$.{e}", "variant")).startswith("ARRAY"), got) for e in ENVELOPES])
    single = F.try_parse_json(F.concat(F.lit("["), F.to_json("doc"), F.lit("]")))
    items = F.when(kind.startswith("ARRAY"), F.col("doc")).otherwise(F.coalesce(lists, single))
    read = lines.filter("doc IS NOT NULL").select(items.alias("items"))
    rows = read.lateralJoin(spark.tvf.variant_explode(F.col("items").outer())).select(F.col("value").alias("item"))
    name = F.trim(F.try_variant_get("item", "$.name", "string"))
    issue = F.when(~F.schema_of_variant("item").startswith("OBJECT"), "not a record").when(F.coalesce(name, F.lit("")) == "", "missing name")
    people = rows.select(*[F.try_variant_get("item", f"$.{c}", "string").alias(c) for c in PERSON], F.to_json("item").alias("record"), issue.alias("issue"))
    broken = lines.filter("doc IS NULL AND trim(value) <> ''").select(*[F.lit(None).cast("string").alias(c) for c in PERSON], F.col("value").alias("record"), F.lit("not JSON").alias("issue"))
    return people.unionByName(broken)


def load_targets(targets: DataFrame, university: str | None = None, department: str | None = None) -> DataFrame:
    """Programs of target universities, filtered case-insensitively. ``targets`` has university and programs."""
    df = targets
    if university:
        df = df.filter(F.lower("university") == university.lower())
    rows = df.select("university", F.inline("programs"))
    return rows.filter(F.lower("department") == department.lower()) if department else rows


def load_structures(spark: SparkSession, path: str) -> DataFrame:
    """Structure store: JSON objects keyed by slug, one object per line."""
    schema = ("map<string, struct<university_name:string, base_url:string, faculty_directory_paths:array<string>, "
              "departments:map<string,array<string>>, discovery_method:string, confidence_score:double, last_updated:double, discovery_count:bigint>>")
    raw = spark.read.text(path).select(F.from_json("value", schema).alias("m"))
    rows = raw.select(F.explode("m").alias("slug", "s")).select("slug", "s.*")
    return rows.withColumn("last_updated", F.timestamp_seconds("last_updated"))


def scan_discovery_cache(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Entries of a directory of cached discoveries with their file stem and age in hours."""
    schema = "university string, faculty_directory_paths array<string>, confidence_score double, cost_estimate double, discovery_timestamp double"
    raw = spark.read.schema(schema).json(path).withColumn("file_name", F.col("_metadata.file_name"))
    age = F.when(F.coalesce("discovery_timestamp", F.lit(0.0)) > 0, (F.unix_timestamp(now.cast("timestamp")) - F.col("discovery_timestamp")) / 3600.0).otherwise(0.0)
    return raw.withColumns({"cache_key": F.regexp_replace("file_name", r"\.json$", ""), "age_hours": age})


def _decode(col: Column, pairs, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), col), F.lit(default))


def load_institutions(raw: DataFrame, col: str = "payload") -> DataFrame:
    """Institutions of directory API exports, one JSON page per row; rows without name or state are left out."""
    schema = "results array<struct<id:bigint, school:struct<name:string, city:string, state:string, state_fips:string, school_url:string, ownership:int>>>"
    r = raw.select(F.inline(F.from_json(col, schema)["results"])).select("id", "school.*")
    kept = r.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("state", F.lit("")) != ""))
    return kept.select(
        F.col("id").cast("string").alias("id"), "name", "city", F.col("state").alias("state_code"), _decode(F.col("state_fips"), STATES, "Unknown").alias("state"),
        F.col("school_url").alias("website"), _decode(F.col("ownership"), OWNERSHIP, "unknown").alias("type"))


def scan_sitemap(xml: DataFrame, base_url: str, col: str = "xml") -> DataFrame:
    """Directory-like locations of sitemap files: url, relative path on the base host, or department subdomain.

    Locations are taken from the text, which also reads files that are not well-formed XML.
    """
    loc = F.regexp_extract_all(col, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    keep = [c for c in xml.columns if c != col]
    rows = xml.select(*keep, F.explode(loc).alias("url")).withColumn("url", F.replace(F.col("url"), F.lit("&amp;"), F.lit("&")))
    rows = rows.filter(F.lower("url").rlike("|".join(DIRECTORY_WORDS)))
    host, base = U.authority(F.col("url")), base_url.split("://", 1)[1].split("/", 1)[0]
    labels = F.split(host, r"\.")
    other = host != base
    return rows.withColumns({
        "relative_path": F.when(~other, F.regexp_replace(F.replace(F.col("url"), F.lit(base_url), F.lit("")), r"^/+", "")),
        "subdomain_base": F.when(other, F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)),
        "department": F.when(other & (F.size(labels) > 2), F.initcap(F.replace(F.get(labels, F.lit(0)), F.lit("-"), F.lit(" ")))),
    })


def lookup_by_key(df: DataFrame, **eq) -> DataFrame:
    """Rows with the given key values; on Parquet the filters reach the scan."""
    for k, v in eq.items():
        df = df.filter(F.col(k) == v)
    return df


def labelled_examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their label."""
    return docs.join(labels, "doc_id").select("doc_id", "text", "label")


def record_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Trim strings and fill declared defaults; missing columns are added."""
    out = df
    for name, value in defaults.items():
        if name not in df.columns:
            out = out.withColumn(name, F.lit(value))
        elif isinstance(value, str):
            out = out.withColumn(name, F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(value)))
        else:
            out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def with_empty_results(targets: DataFrame, results: DataFrame, on: str) -> DataFrame:
    """Results of every target; targets without any get an empty row with an error text."""
    r = results.withColumn("_hit", F.lit(True))
    j = targets.join(r, on, "left")
    return j.withColumns({"success": F.coalesce("_hit", F.lit(False)), "error": F.when(F.col("_hit").isNull(), "no results")}).drop("_hit")


def serialise_record(df: DataFrame, key: str, cols: tuple[str, ...]) -> DataFrame:
    """One JSON text per record; time stamps in ISO form, nulls kept."""
    parts = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(c) for c in cols]
    return df.select(key, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))
