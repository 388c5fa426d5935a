"""Other inputs: the XML action log, polygons, directory, history, run log, watchlists and
gold cases (S-9, S-10, S-13 .. S-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions import predicates as P
from tidemark.operators.places import with_box

# --- Fixed values ---------------------------------------------------------------------------
AREA_TYPES = {
    "CLASS_B": "B", "CLASS_C": "C", "CLASS_D": "D", "CLASS_E2": "E surface", "CLASS_E3": "E extension", "CLASS_E4": "E extension",
}
SITE_TYPES = {
    "A": "airport", "B": "balloonport", "C": "seaplane base", "G": "gliderport", "H": "heliport", "U": "ultralight", "V": "vertiport",
}
SLUG_FORM = r"^[a-z0-9][a-z0-9-]{2,39}$"
RESERVED_SLUGS = ("latest", "history", "assets", "watch", "list", "about", "guide", "docs", "changelog", "privacy", "terms")
LOG_RECORD = (
    "chart_code string, chart_name string, useraction string, amdtnum string, amdtdate string, pdf_name string, procuid string"
)
FIELD = "array<struct<field:string,old:string,new:string>>"
HISTORY_SCHEMA = (
    "schema_version int, airport string, first_cycle string, last_cycle string, entries array<struct<cycle:string,from_cycle:string,engine:string,"
    f"id:string,priority:string,category:string,kind:string,summary:string,source:string,original:string,untranslated:string,fields:{FIELD},details:array<string>>>"
)
CASE_SCHEMA = (
    "id string, source string, from_cycle string, cycle string, airport string, field string, old string, new string, kind string,"
    "expected struct<priority:string,category:string,summary_contains:array<string>,summary_lacks:array<string>,count:int>, verified_by string, known_failure string"
)
# --------------------------------------------------------------------------------------------


def action_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S-9: (chart records with their entity and position, root attributes). The reader splits
    the file by row tag, so a large log is never one row."""
    schema = f"_apt_ident string, record array<struct<{LOG_RECORD.replace(' string', ':string').replace(', ', ',')}>>"
    airports = spark.read.format("xml").option("rowTag", "airport_name").schema(schema).load(path)
    records = airports.select(F.upper("_apt_ident").alias("entity"), F.posexplode("record").alias("pos", "r")).select("entity", "pos", "r.*")
    root = spark.read.format("xml").option("rowTag", "digital_tpp").schema("_cycle string, _from_edate string").load(path)
    return records, root.select(F.col("_cycle").alias("edition"), F.col("_from_edate").alias("from_edate"))


def changed_documents(records: DataFrame) -> DataFrame:
    """S-9: the documents of changed charts' first pages."""
    from tidemark.operators.charts import CONTINUATION

    pdf = F.trim("pdf_name")
    return records.filter(
        (F.upper(F.trim("useraction")) == "C") & (pdf != "") & ~F.trim("chart_name").rlike(CONTINUATION) & ~F.contains(F.upper(pdf), F.lit("DELETED"))
    ).select(pdf.alias("pdf")).distinct()


def polygons(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-10: (pieces with layer label and box, idents) of a nested polygon table with the
    publisher's attributes and ``rings``."""
    get = lambda c: F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")
    ltype = F.regexp_replace(F.upper(get("LOCAL_TYPE")), " ", "_")
    low = geo.altitude(get("LOWER_VAL"), get("LOWER_CODE"), get("LOWER_UOM"))
    high = geo.altitude(get("UPPER_VAL"), get("UPPER_CODE"), get("UPPER_UOM"))
    kept = raw.withColumns({"ltype": ltype, "name": F.upper(get("NAME"))}).filter(F.col("ltype").isin(*AREA_TYPES) & (F.size("rings") > 0))
    cls = F.coalesce(*[F.when(F.col("ltype") == t, F.lit(c)) for t, c in AREA_TYPES.items()])
    pieces = with_box(kept.select("name", "ltype", cls.alias("cls"), geo.layer_label(low, high).alias("layer"), "rings"))
    ids = F.array(F.upper(get("IDENT")), F.upper(get("ICAO_ID")))
    short = F.transform(F.filter(ids, lambda i: i.rlike("^K...$")), lambda i: F.substring(i, 2, 3))
    idents = kept.select("name", "ltype", F.explode(F.array_distinct(F.concat(ids, short))).alias("entity")).filter(F.col("entity") != "").distinct()
    return pieces, idents


def directory(rows: DataFrame) -> DataFrame:
    """S-13: the entity directory from base rows ``row``."""
    row = F.col("row")
    get = lambda c: F.trim(P.cell(row, c))
    number = lambda c: F.round(get(c).try_cast("double"), 4)
    kind = F.coalesce(*[F.when(get("SITE_TYPE_CODE") == c, F.lit(t)) for c, t in SITE_TYPES.items()], F.lit("airport"))
    blank = lambda c: F.nullif(c, F.lit(""))
    return rows.select(
        F.upper(get("ARPT_ID")).alias("entity"), blank(F.upper(get("ICAO_ID"))).alias("icao"), blank(F.initcap(get("ARPT_NAME"))).alias("name"),
        blank(F.initcap(get("CITY"))).alias("city"), blank(get("STATE_CODE")).alias("state"), kind.alias("type"),
        number("LAT_DECIMAL").alias("lat"), number("LONG_DECIMAL").alias("lon"),
    ).filter(F.col("entity") != "")


def history(spark: SparkSession, path: str) -> DataFrame:
    """S-14: per-entity history documents as one row per entry."""
    docs = spark.read.schema(HISTORY_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return docs.filter(F.col("airport").isNotNull()).select(F.col("airport").alias("entity"), F.explode("entries").alias("e")).select("entity", "e.*")


def run_log(spark: SparkSession, path: str, schema: str, newest: int) -> DataFrame:
    """S-15: run records of the newest cycle folders (``cycle=...`` partitions)."""
    runs = spark.read.schema(schema).json(path)
    recent = runs.select("cycle").distinct().orderBy(F.desc("cycle")).limit(newest)
    return runs.join(F.broadcast(recent), "cycle", "left_semi")


def normal_id(value: Column) -> Column:
    a = F.upper(F.trim(value))
    return F.when(a.rlike("^K[A-Z]{3}$"), F.substring(a, 2, 3)).otherwise(a)


def watchlists(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-16: (members ``slug, name, description, entity, pos``, problems ``slug, problem``) from
    ``slug, name, description, airports``; a list with a problem is skipped. The first mention
    of an id decides its place."""
    bad_ids = F.filter(F.transform("airports", normal_id), lambda a: ~a.rlike(P.ENTITY_ID_FORM))
    checks = F.filter(
        F.array(
            F.when(~F.col("slug").rlike(SLUG_FORM), "link names are 3-40 lowercase letters, digits or dashes"),
            F.when(F.col("slug").isin(*RESERVED_SLUGS), "that name is reserved"),
            F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "needs a name"),
            F.when(F.coalesce(F.size("airports"), F.lit(0)) <= 0, "needs a non-empty list"),
            F.when(F.size(bad_ids) > 0, F.concat(F.lit("not ids: "), F.array_join(bad_ids, ", "))),
        ),
        lambda p: p.isNotNull(),
    )
    judged = raw.withColumn("problems", checks)
    good = judged.filter(F.size("problems") == 0).select("slug", F.trim("name").alias("name"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), F.posexplode("airports").alias("pos", "a"))
    members = good.groupBy("slug", "name", "description", normal_id(F.col("a")).alias("entity")).agg(F.min("pos").alias("pos"))
    return members, judged.select("slug", F.explode("problems").alias("problem"))


def watchlist_files(spark: SparkSession, path: str) -> DataFrame:
    schema = "name string, description string, airports array<string>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    slug = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", "")
    return raw.withColumn("slug", slug)


def gold_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S-17: (well-formed cases, problems ``id, problem``) of a JSON-lines file; lines that start
    with '#' or '//' are comments."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|//)") & (F.trim("value") != ""))
    cases = lines.select(F.from_json("value", CASE_SCHEMA).alias("c")).select("c.*")
    checks = F.filter(
        F.array(
            *[F.when(F.coalesce(F.col(c), F.lit("")) == "", f"no {c}") for c in ("id", "source", "cycle", "airport", "kind")],
            F.when(~F.col("kind").isin("added", "removed", "changed"), "unknown kind"),
            F.when(~F.coalesce(F.col("expected.priority").isin("action", "ifr", "fyi", "hidden"), F.lit(False)), "unknown expected priority"),
        ),
        lambda p: p.isNotNull(),
    )
    judged = cases.withColumn("problems", checks)
    return judged.filter(F.size("problems") == 0).drop("problems"), judged.select("id", F.explode("problems").alias("problem"))
