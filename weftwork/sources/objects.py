"""Object kinds in XML dumps as typed tables: configuration, catalogs, documents, common modules, subsystems, roles, forms.

Each function takes the table of `metadata.read_objects` (or rows of that form) and reads the kind's own properties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metadata import _path, _text, property_columns
from .paths import form_owner, relative

#: Defaults of properties that a file lacks or that are no numbers.
PLATFORM, CODE_LENGTH, DESCRIPTION_LENGTH, NUMBER_LENGTH = "8.3.20", 9, 50, 9
FORM_DEPTH = 2
_OWN = "/*/*/" + _path("Properties")


def _property(name: str, default: str | None = None) -> Column:
    found = _text("xml", f"{_OWN}/{_path(name)}")
    return F.coalesce(found, F.lit(default)).alias(_snake(name)) if default is not None else found.alias(_snake(name))


def _number(name: str, default: int) -> Column:
    return F.coalesce(_text("xml", f"{_OWN}/{_path(name)}").try_cast("int"), F.lit(default)).alias(_snake(name))


def _flag(name: str, default: bool = False) -> Column:
    return F.coalesce(F.lower(_text("xml", f"{_OWN}/{_path(name)}")) == "true", F.lit(default)).alias(_snake(name))


def _items(name: str) -> Column:
    """Trimmed, non-empty texts of the Item elements below a property."""
    found = F.xpath("xml", F.lit(f"{_OWN}/{_path(name)}//*[local-name()='Item']/text()"))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def _names(tag: str) -> Column:
    found = F.xpath("xml", F.lit(f"/*/*/{_path('ChildObjects', tag)}/text()"))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() and i else c.lower() for i, c in enumerate(name))


def _of(objects: DataFrame, kind: str, *columns: Column) -> DataFrame:
    """(name, path, uuid, synonym, comment, columns...): the name in the file counts, else the file's own."""
    named = F.coalesce(_text("xml", f"{_OWN}/{_path('Name')}"), F.col("name")).alias("name")
    return objects.where((F.col("type") == kind) & F.col("well_formed")).select(named, "path", *property_columns(), *columns)


def configuration(spark: SparkSession, folder: str) -> DataFrame:
    """One row of the dump's Configuration.xml: name, synonym, version, vendor, platform, lock mode, language and how many
    objects of each type it lists. A compatibility mode that names no version gives the default platform."""
    rows = spark.read.text(f"{folder.rstrip('/')}/Configuration.xml", wholetext=True)
    bare = F.regexp_replace(F.regexp_replace("value", r"^\x{FEFF}", ""), r"(</?)[A-Za-z_][\w.-]*:", "$1")
    rows = rows.select(F.lit("Configuration").alias("type"), F.lit("Configuration").alias("name"), F.col("_metadata.file_path").alias("path"), F.regexp_replace(bare, r"\sxmlns(?::[\w.-]+)?=(?:\"[^\"]*\"|'[^']*')", "").alias("xml"))
    return configuration_of(rows)


def configuration_of(rows: DataFrame) -> DataFrame:
    """`configuration` of rows with the file's text in `xml`."""
    minor = F.regexp_extract(_text("xml", f"{_OWN}/{_path('CompatibilityMode')}"), r"^Version8_3_([0-9]+)", 1)
    language = F.regexp_extract(_text("xml", f"{_OWN}/{_path('DefaultLanguage')}"), r"^[^.]*\.(.*)$", 1)
    kinds = F.regexp_extract_all(F.regexp_extract("xml", r"(?s)<ChildObjects>(.*?)</ChildObjects>", 1), F.lit(r"<([A-Za-z]+)[\s>]"), 1)
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("kinds")), lambda k: F.struct(k, F.size(F.filter("kinds", lambda x: x == k)))))
    return (
        rows.withColumn("kinds", kinds)
        .select(
            F.coalesce(_text("xml", f"{_OWN}/{_path('Name')}"), F.lit("Unknown")).alias("name"),
            _text("xml", f"({_OWN}/{_path('Synonym')}//*[local-name()='content'][normalize-space()])[1]").alias("synonym"),
            _property("Version", "0.0.0.0"),
            _property("Vendor"),
            F.when(minor != "", F.concat(F.lit("8.3."), minor)).otherwise(PLATFORM).alias("platform_version"),
            _property("DataLockControlMode", "Managed"),
            F.when(language != "", language).otherwise("ru").alias("default_language"),
            counts.alias("object_counts"),
        )
    )


def child_objects(objects: DataFrame) -> DataFrame:
    """(type, name, child_type, children): all child objects of each object by their element's name, in order."""
    body = F.regexp_extract("xml", r"(?s)<ChildObjects>(.*)</ChildObjects>", 1)
    pairs = F.regexp_extract_all(body, F.lit(r"(?s)<([A-Za-z]+)>([^<]+)</\1>"), 0)
    rows = objects.where("well_formed").select("type", "name", F.posexplode(pairs).alias("pos", "x"))
    cut = rows.select("type", "name", "pos", F.regexp_extract("x", "^<([A-Za-z]+)>", 1).alias("child_type"), F.trim(F.regexp_extract("x", r"(?s)>([^<]+)<", 1)).alias("child")).where("child <> ''")
    return cut.groupBy("type", "name", "child_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "child"))), lambda s: s["child"]).alias("children"))


def catalogs(objects: DataFrame) -> DataFrame:
    """Catalogs with hierarchy, code and description lengths, owners (those with a namespace) and names of their parts."""
    owners = F.filter(_items("Owners"), lambda x: F.contains(x, F.lit(":"))).alias("owners")
    return _of(objects, "Catalog", _property("HierarchyType", "HierarchyItems"), _number("CodeLength", CODE_LENGTH), _property("CodeSeries", "WholeCatalog"), _number("DescriptionLength", DESCRIPTION_LENGTH), owners, _names("Form").alias("forms"), _names("Template").alias("templates"), _names("Command").alias("commands"))


def documents(objects: DataFrame) -> DataFrame:
    """Documents with number, posting and the registers that they write to."""
    return _of(objects, "Document", _number("NumberLength", NUMBER_LENGTH), _property("NumberType", "String"), _property("Posting", "Allow"), _property("RealTimePosting", "Deny"), _items("RegisterRecords").alias("register_records"), _names("Form").alias("forms"), _names("Template").alias("templates"), _names("Command").alias("commands"))


def common_modules(objects: DataFrame) -> DataFrame:
    """Common modules with the contexts that they run in; only `server` is on by default."""
    return _of(objects, "CommonModule", _flag("Server", True), *[_flag(x) for x in ("Global", "Client", "ClientManagedApplication", "ExternalConnection", "Privileged")])


def subsystems(objects: DataFrame) -> DataFrame:
    """Subsystems with the objects that they hold, as struct(type, name), and the names of their parts."""
    dotted = F.filter(_items("Content"), lambda x: x.rlike(r"^[^.]+\..+"))
    refs = F.transform(dotted, lambda x: F.struct(F.substring_index(x, ".", 1).alias("type"), F.regexp_extract(x, r"^[^.]+\.(.+)$", 1).alias("name")))
    return _of(objects, "Subsystem", refs.alias("content"), _items("ChildSubsystems").alias("child_subsystems"))


def roles(objects: DataFrame) -> DataFrame:
    """Roles: name, synonym and comment."""
    return _of(objects, "Role")


def read_forms(spark: SparkSession, folder: str) -> DataFrame:
    """(path, xml, ext) of every form of a dump: its own file, and the file of its layout where there is one."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").text(folder, wholetext=True)
    bare = F.regexp_replace(F.regexp_replace("value", r"^\x{FEFF}", ""), r"(</?)[A-Za-z_][\w.-]*:", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\sxmlns(?::[\w.-]+)?=(?:\"[^\"]*\"|'[^']*')", ""), r"(\s)[A-Za-z_][\w.-]*:([\w.-]+=[\"'])", "$1$2")
    rows = files.select(relative(F.col("_metadata.file_path"), folder).alias("path"), bare.alias("xml"))
    own = rows.where(F.col("path").rlike(r"(^|/)(Forms|CommonForms)/[^/]+\.xml$"))
    ext = rows.where(F.col("path").rlike(r"/Ext/Form\.xml$")).select(F.regexp_replace("path", r"/Ext/Form\.xml$", ".xml").alias("path"), F.col("xml").alias("ext"))
    return own.join(ext, "path", "left")


def forms(rows: DataFrame) -> DataFrame:
    """(path, parent_type, parent_name, name, form_type, title, events, attributes) of forms; without a layout the last
    two are empty and the title is the synonym. `events` maps an event to its handler."""
    owner = form_owner(F.col("path"))
    top = "/*"
    named = lambda x: f"{top}/{x}"
    keys = F.xpath("ext", F.lit(named(f"{_path('Events', 'Event')}/@name")))
    handlers = F.transform(F.xpath("ext", F.lit(named(f"{_path('Events', 'Event')}/text()"))), lambda x: F.trim(x))
    entries = F.filter(F.arrays_zip(keys.alias("k"), handlers.alias("v")), lambda e: (e["k"] != "") & (e["v"] != ""))
    title = F.nullif(F.trim(F.xpath_string("ext", F.lit(f"({named(_path('Title'))}//*[local-name()='content'][normalize-space()])[1]"))), F.lit(""))
    synonym = _text("xml", f"({_OWN}/{_path('Synonym')}//*[local-name()='content'][normalize-space()])[1]")
    return rows.select(
        "path",
        owner["type"].alias("parent_type"),
        owner["name"].alias("parent_name"),
        F.coalesce(_text("xml", f"{_OWN}/{_path('Name')}"), owner["form"]).alias("name"),
        _property("FormType"),
        F.coalesce(title, synonym).alias("title"),
        F.map_from_entries(F.coalesce(entries, F.array().cast("array<struct<k:string,v:string>>"))).alias("events"),
        F.coalesce(F.filter(F.xpath("ext", F.lit(named(f"{_path('Attributes', 'Attribute')}/@name"))), lambda x: x != ""), F.array().cast("array<string>")).alias("attributes"),
    )


def form_elements(rows: DataFrame, most_depth: int = FORM_DEPTH) -> DataFrame:
    """(path, depth, pos, element): the named elements of each form's layout, those in the form itself at depth 0, down to
    `most_depth`."""
    inside, each = "/*", []
    for depth in range(most_depth + 1):
        inside += f"/{_path('ChildItems')}/*"
        each.append(F.struct(F.lit(depth).alias("depth"), F.xpath("ext", F.lit(f"{inside}/@name")).alias("names")))
    levels = rows.where("ext is not null").select("path", F.explode(F.array(*each)).alias("x"))
    return levels.select("path", "x.depth", F.posexplode(F.filter("x.names", lambda n: n != "")).alias("pos", "element"))
