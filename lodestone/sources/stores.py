"""Index files and Markdown documents of the memory store.

Index files are read as VARIANT, so that a field of the wrong kind stays what it is instead of
being turned into text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from . import ranges

TEXTS = ["id", "type", "scope", "project", "title", "summary", "path", "status", "createdAt", "updatedAt", "validFrom", "validTo", "supersedes", "trust", "originDevice", "lastAccess", "archivedAt", "archivedReason"]
LISTS = ["sourceSessions", "sourceCommits", "sourceFiles", "entities"]
NUMBERS = ["confidence", "importance", "accessCount"]
ARRAYS = [*LISTS, "aliases", "sourceMemoryIds", "relatedEntities", "tags", "sources"]


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, name: str) -> Column:
    return F.when(_kind(v, f"$.{name}") == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def load_state(document: Column, field: str = "entries") -> Column:
    """STRUCT<state, reason>: absent, ok or corrupt."""
    v = F.try_parse_json(document)
    row = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    shaped = F.startswith(_kind(v, f"$.{field}"), F.lit("OBJECT"))
    return F.when(document.isNull(), row("absent", None)).when(v.isNull(), row("corrupt", "not JSON")).when(~fn.holds(F.try_variant_get(v, "$.version", "int") == 1), row("corrupt", "unknown version")).when(~fn.holds(shaped), row("corrupt", f"{field} is not an object")).otherwise(row("ok", None))


def entries(documents: DataFrame, field: str = "entries") -> DataFrame:
    """(key, entry VARIANT) of the readable documents (value); unreadable ones give no row."""
    good = documents.where(load_state(F.col("value"), field)["state"] == "ok").select(F.try_parse_json("value").alias("v"))
    return good.lateralJoin(good.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("v").outer(), f"$.{field}", "variant"))).select("key", F.col("value").alias("entry"))


def memory_rows(rows: DataFrame) -> DataFrame:
    """Typed memory rows of (key, entry); fields of the wrong kind are null, and ``defects`` names those lists."""
    v = F.col("entry")
    listed = lambda n: F.when(F.startswith(_kind(v, f"$.{n}"), F.lit("ARRAY")), F.try_variant_get(v, f"$.{n}", "array<string>"))
    number = lambda n: F.when(_kind(v, f"$.{n}").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(v, f"$.{n}", "double"))
    defects = F.array_compact(F.array(*[F.when(F.try_variant_get(v, f"$.{n}", "variant").isNotNull() & listed(n).isNull(), F.lit(n)) for n in LISTS]))
    typed = rows.where(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    return typed.select("key", *[_text(v, n).alias(n) for n in TEXTS], *[listed(n).alias(n) for n in LISTS], *[number(n).alias(n) for n in NUMBERS], defects.alias("defects"))


def rewrite_defect(rows: DataFrame) -> DataFrame:
    """(key, defect): the first field that keeps a typed row from being written again, in the order of the checks."""
    c = F.col
    checks = [("id", c("id").isNotNull() & (c("id") == c("key"))), ("type", c("type").isin(*fn.MEMORY_TYPES)), ("scope", c("scope").isNotNull()), ("title", c("title").isNotNull()), ("summary", c("summary").isNotNull()), ("status", c("status").isin("active", "superseded", "pinned", "archived")), *[(n, c(n).isNotNull()) for n in LISTS]]
    return rows.select("key", F.coalesce(*[F.when(~fn.holds(ok), F.lit(name)) for name, ok in checks]).alias("defect"))


def usage_rows(documents: DataFrame) -> DataFrame:
    """(id, n, last_access) of usage documents; malformed records go, counts are whole and not negative."""
    v = F.try_parse_json("value")
    flat = documents.select(v.alias("v")).where("v is not null")
    rows = flat.lateralJoin(flat.sparkSession.tvf.variant_explode(F.col("v").outer())).select("key", F.col("value").alias("entry"))
    n = F.when(_kind(F.col("entry"), "$.count").rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get("entry", "$.count", "double"))
    return rows.select(F.col("key").alias("id"), F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.floor(n).cast("double"))).alias("n"), _text(F.col("entry"), "lastAccess").alias("last_access")).where("n is not null")


def read_markdown(spark: SparkSession, root: str, leave_out: tuple[str, ...] = ("_primer", "entities", "qa"), pattern: str = "*.md") -> DataFrame:
    """(path, md) of the Markdown documents below ``root``, whose path there doesn't begin with a left-out folder.

    Tasks list the folders and read the documents; where only Spark reaches the folder, its reader does.
    """
    if ranges.reachable(root):
        return ranges.whole(ranges.walked(spark, root, pattern, leave_out), root).select("path", F.col("bytes").cast("string").alias("md"))
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    rel = F.regexp_replace("_metadata.file_path", r"^(file:)?/*", "/")
    at = F.substring_index(rel, root.split("://")[-1].rstrip("/") + "/", -1)
    return files.select(at.alias("path"), F.col("value").alias("md")).where(~F.split_part("path", F.lit("/"), F.lit(1)).isin(*leave_out))


def frontmatter(md: Column) -> Column:
    """MAP of the head's fields; null without a head, with a repeated key or a shape that no writer makes."""
    text = F.replace(md, F.lit("\r\n"), F.lit("\n"))
    block = r"(?s)^---\n(.*?)\n---"
    head = F.regexp_extract(text, block, 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    keys = F.transform(lines, lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1))))
    values = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    heading = text.rlike(r"(?m)^#( |$)")
    rest = F.substr(text, F.length(head) + 9)
    shaped = rest.rlike(r"\A\n\n#( |\n|\z)") & ~head.rlike(r"(?m)^(---|#( .*)?)$")
    return F.when(text.rlike(block) & (F.size(F.array_distinct(keys)) == F.size(keys)) & (~heading | shaped), F.map_from_arrays(keys, values))


def _unset(x: Column) -> Column:
    return F.when(~F.trim(x).isin("", "null", "undefined"), F.trim(x))


def list_field(x: Column) -> Column:
    inner = F.regexp_replace(F.trim(x), r"^\[|\]$", "")
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(_unset(x).isNull(), F.array().cast("array<string>")).otherwise(parts)


def json_list_field(x: Column) -> Column:
    """Lists written as JSON, or else comma-separated."""
    return F.coalesce(F.from_json(x, "array<string>"), list_field(x))


def memory_documents(docs: DataFrame) -> DataFrame:
    """Memory rows of (path, md); documents without an id or a type go. Trust of old documents follows their sources."""
    fm = F.col("fm")
    rows = docs.withColumn("fm", frontmatter(F.col("md"))).where("fm is not null and fm['id'] <> '' and fm['type'] <> ''")
    number = lambda n, default: F.coalesce(F.when(~F.isnan(_unset(fm[n]).try_cast("double")), _unset(fm[n]).try_cast("double")), F.lit(default))
    own = (F.size(list_field(fm["sourceSessions"])) > 0) | (F.size(list_field(fm["sourceCommits"])) > 0)
    placed = fm["scope"].isin("global", "user") | _unset(fm["project"]).isNotNull()
    trust = F.when(F.map_contains_key(fm, "trust"), F.when(F.trim(fm["trust"]).isin("trusted", "untrusted"), F.trim(fm["trust"])).otherwise("unknown")).when(fn.holds(own & placed), "trusted").otherwise("unknown")
    stamp = lambda n: F.when(F.trim(fm[n]).isin("undefined", "null"), F.lit("")).otherwise(F.coalesce(F.trim(fm[n]), F.lit("")))
    return rows.select("path", *[fm[n].alias(n) for n in ("id", "type", "scope", "title", "summary", "status")], *[_unset(fm[n]).alias(n) for n in ("project", "validFrom", "validTo", "supersedes", "originDevice", "archivedAt", "archivedReason")], stamp("createdAt").alias("createdAt"), stamp("updatedAt").alias("updatedAt"), number("confidence", 0.5).alias("confidence"), number("importance", 0.0).alias("importance"), trust.alias("trust"), *[list_field(fm[n]).alias(n) for n in LISTS])


def healed(md: Column, day: str) -> Column:
    """The document with literal undefined and null values of its head repaired; null if nothing is."""
    block = r"(?s)^(---\r?\n)(.*?)(\r?\n---)"
    head = F.regexp_extract(md, block, 2)
    fixed = head
    for names, value, word in (("project|validFrom|validTo|supersedes|originDevice|relatedTo", "null", "undefined"), ("status", "active", "undefined"), ("confidence", "0.5", "undefined|null"), ("importance", "0", "undefined|null"), ("|".join(ARRAYS), "[]", "undefined"), ("createdAt|updatedAt", day, "undefined|null")):
        fixed = F.regexp_replace(fixed, rf"(?m)^({names}):[ \t]*(?:{word})[ \t]*(\r?)$", f"$1: {value}$2")
    rest = F.regexp_replace(md, block, "")
    return F.when(md.rlike(block) & (fixed != head), F.concat(F.regexp_extract(md, block, 1), fixed, F.regexp_extract(md, block, 3), rest))


def body_of(md: Column) -> Column:
    """A document's text below its head and heading; null if it has another shape."""
    shape = r"(?s)^---\r?\n.*?\r?\n---\r?\n\r?\n#(?: [^\n]*)?(?:\n|$)"
    return F.when(md.rlike(shape), F.regexp_replace(F.regexp_replace(F.regexp_replace(md, shape, ""), r"^\n+", ""), r"\n+$", ""))


def set_field(md: Column, name: str, value: str) -> Column:
    """The document with one field of its head set, added at the end if it isn't there."""
    head = F.regexp_extract(md, r"(?s)^---\n(.*?)\n---", 1)
    line = rf"(?m)^{name}:.*$"
    new = F.when(head.rlike(line), F.regexp_replace(head, line, f"{name}: {value}")).otherwise(F.concat(head, F.lit(f"\n{name}: {value}")))
    return F.concat(F.lit("---\n"), new, F.lit("\n---"), F.regexp_replace(md, r"(?s)^---\n.*?\n---", ""))


def memory_markdown(rows: DataFrame) -> DataFrame:
    """(id, md) of memory rows with a body: fields in a fixed order, nulls as null, lists in brackets."""
    line = lambda x: fn.control_free(x)
    text = lambda n: F.concat(F.lit(f"{n}: "), F.coalesce(line(F.col(n)), F.lit("null")))
    number = lambda n: F.concat(F.lit(f"{n}: "), F.regexp_replace(F.col(n).cast("string"), r"\.0$", ""))
    listed = lambda n: F.concat(F.lit(f"{n}: ["), F.array_join(F.transform(fn.as_array(F.col(n)), line), ", "), F.lit("]"))
    head = [*[text(n) for n in ("id", "type", "scope", "project", "title", "summary", "status")], number("confidence"), number("importance"), *[text(n) for n in ("createdAt", "updatedAt", "validFrom", "validTo", "supersedes", "originDevice", "archivedAt", "archivedReason")], *[listed(n) for n in LISTS], text("trust")]
    return rows.select("id", F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n\n# "), line(F.col("title")), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("md"))


def rebuild(docs: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the index that the documents (path, md) make, the last path of an id winning, and what became of them."""
    fixed = healed(F.col("md"), day)
    seen = docs.select("path", F.coalesce(fixed, "md").alias("md"), fixed.isNotNull().alias("healed"))
    parsed = memory_documents(seen)
    names = [c for c in parsed.columns if c != "id"]
    rows = parsed.groupBy("id").agg(F.max_by(F.struct(*names), "path").alias("row")).select("id", "row.*")
    status = seen.join(parsed.select("path", F.lit(True).alias("good")), "path", "left")
    return rows, status.agg(F.count_if("good").alias("indexed"), F.count_if(F.col("healed") & F.coalesce("good", F.lit(False))).alias("healed"), F.count_if(F.col("good").isNull()).alias("skipped"))


def proposals(documents: DataFrame) -> DataFrame:
    """Queued proposals (name, value) in the order of their names; corrupt ones go."""
    v = F.try_parse_json("value")
    return documents.select("name", _text(v, "proposalId").alias("proposal_id"), _text(v, "targetKey").alias("target_key"), _text(v, "action").alias("action"), _text(v, "createdAt").alias("created_at")).where("target_key is not null").orderBy("name")


def session_rows(documents: DataFrame) -> DataFrame:
    """Rows of session indexes (value), paths with forward slashes; a bad version or shape gives none."""
    v = F.col("entry")
    names = ["sessionId", "shortId", "tool", "project", "projectRaw", "startedAt", "endedAt", "nameSlug", "displayName", "sourcePath", "sourceSha256"]
    number = F.when(_kind(v, "$.sourceMtimeMs").rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$.sourceMtimeMs", "double"))
    return entries(documents).select("key", *[_text(v, n).alias(n) for n in names], F.replace(_text(v, "relativePath"), F.lit("\\"), F.lit("/")).alias("relativePath"), number.alias("sourceMtimeMs"))


def skip_rows(documents: DataFrame) -> DataFrame:
    """(session_id, reason, at) of skip ledgers; a ledger whose sessions are no object gives none."""
    return entries(documents, "sessions").select(F.col("key").alias("session_id"), _text(F.col("entry"), "reason").alias("reason"), _text(F.col("entry"), "at").alias("at"))


def snapshot(entry: Column) -> Column:
    """The first 120 characters of an entry's JSON, for messages."""
    return F.substring(F.to_json(entry), 1, 120)
