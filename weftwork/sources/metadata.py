"""Object metadata in XML files: listing, object properties, attributes and child names, by XPath expressions.

Paths go by local names, so that prefixes, bound or not, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .xml_repair import repaired

# Folders of a dump whose type isn't the folder's name without its last s.
IRREGULAR = {
    "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes",
    "ChartsOfAccounts": "ChartOfAccounts",
    "ChartsOfCalculationTypes": "ChartOfCalculationTypes",
    "FilterCriteria": "FilterCriterion",
    "FunctionalOptionsParameters": "FunctionalOptionsParameter",
    "HTTPServices": "HttpService",
    "BusinessProcesses": "BusinessProcess",
}
NUMBERS = "xs:decimal xs:integer xs:byte xs:short xs:int xs:long xs:negativeInteger xs:nonNegativeInteger xs:positiveInteger xs:nonPositiveInteger xs:unsignedByte xs:unsignedShort xs:unsignedInt xs:unsignedLong".split()
DATES = "xs:dateTime xs:date xs:time".split()
REFERENCES = {
    "CatalogRef": "СправочникСсылка",
    "DocumentRef": "ДокументСсылка",
    "EnumRef": "ПеречислениеСсылка",
    "InformationRegisterRef": "РегистрСведенийСсылка",
    "AccumulationRegisterRef": "РегистрНакопленияСсылка",
    "AccountingRegisterRef": "РегистрБухгалтерииСсылка",
    "CalculationRegisterRef": "РегистрРасчетаСсылка",
    "ChartOfCharacteristicTypesRef": "ПланВидовХарактеристикСсылка",
    "ChartOfAccountsRef": "ПланСчетовСсылка",
    "ChartOfCalculationTypesRef": "ПланВидовРасчетаСсылка",
    "DataProcessorRef": "ОбработкаСсылка",
    "ReportRef": "ОтчетСсылка",
    "TaskRef": "ЗадачаСсылка",
    "BusinessProcessRef": "БизнесПроцессСсылка",
    "ExchangePlanRef": "ПланОбменаСсылка",
    "SequenceRef": "ПоследовательностьСсылка",
    "DocumentJournalRef": "ЖурналДокументовСсылка",
    "FilterCriterionRef": "КритерийОтбораСсылка",
    "DefinedType": "ОпределяемыйТип",
}
UNKNOWN = "Неизвестно"


def _path(*names: str) -> str:
    return "/".join(f"*[local-name()='{n}']" for n in names)


def object_type(folder: Column) -> Column:
    """The type of the objects in a folder of the dump."""
    out = F.regexp_replace(folder, "s$", "")
    for name, kind in IRREGULAR.items():
        out = F.when(folder == name, kind).otherwise(out)
    return out


def read_objects(spark: SparkSession, folder: str, recover: bool = False) -> DataFrame:
    """(type, name, path, xml, well_formed) of every `*/*.xml` one level below a folder; the file's name is the object's name.

    Prefixes are taken off element names and attributes other than xmlns declarations, so that unbound ones do no harm.
    With `recover`, files that aren't well-formed are mended as far as that goes, and `repairs` says what was.
    """
    files = spark.read.text(f"{folder}/*/*.xml", wholetext=True)
    path = F.col("_metadata.file_path")
    parts = F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/")
    bare = F.regexp_replace(F.regexp_replace("value", r"^\x{FEFF}", ""), r"(</?)[A-Za-z_][\w.-]*:", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\sxmlns(?::[\w.-]+)?=(?:\"[^\"]*\"|'[^']*')", ""), r"(\s)[A-Za-z_][\w.-]*:([\w.-]+=[\"'])", "$1$2")
    found = files.select(object_type(F.element_at(parts, -2)).alias("type"), F.regexp_replace(F.element_at(parts, -1), r"\.xml$", "").alias("name"), path.alias("path"), bare.alias("xml")).withColumn("well_formed", well_formed(F.col("xml")))
    return repaired(found) if recover else found


def well_formed(xml: Column) -> Column:
    """Whether a text is well-formed XML."""
    return F.coalesce(F.from_xml(xml, "_corrupt_record string")["_corrupt_record"].isNull(), F.lit(False))


def _text(xml: Column | str, path: str) -> Column:
    """Trimmed text at a path; null where it is empty or absent."""
    return F.nullif(F.trim(F.xpath_string(xml, F.lit(path))), F.lit(""))


def property_columns() -> list[Column]:
    """uuid, synonym (the first non-empty `content`) and comment of an object."""
    own = "/*/*/" + _path("Properties")
    return [
        F.nullif(F.xpath_string("xml", F.lit("/*/*/@uuid")), F.lit("")).alias("uuid"),
        _text("xml", f"({own}/{_path('Synonym')}//*[local-name()='content'][normalize-space()])[1]").alias("synonym"),
        _text("xml", f"{own}/{_path('Comment')}").alias("comment"),
    ]


def properties(objects: DataFrame) -> DataFrame:
    """(type, name, path, uuid, synonym, comment). Well-formed files only."""
    return objects.where("well_formed").select("type", "name", "path", *property_columns())


def children(objects: DataFrame, tag: str) -> DataFrame:
    """(type, name, pos, child): trimmed, non-empty texts of the child objects with a tag, such as Form or Template. Well-formed files only."""
    names = F.xpath("xml", F.lit(f"/*/*/{_path('ChildObjects', tag)}/text()"))
    return objects.where("well_formed").select("type", "name", F.posexplode(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "child"))


def type_name(raw: Column) -> Column:
    """A declared type by its name: primitives and references are translated, others stay; unknown if none."""
    prefix = F.regexp_extract(raw, r"^cfg:([^.]*)\.", 1)
    named = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])
    ref = F.try_element_at(named, prefix)
    primitive = F.when(raw == "xs:string", "Строка").when(raw.isin(NUMBERS), "Число").when(raw == "xs:boolean", "Булево").when(raw.isin(DATES), "Дата")
    return F.coalesce(primitive, F.when(ref.isNotNull(), F.concat(ref, F.lit("."), F.regexp_replace(raw, r"^cfg:[^.]*\.", ""))), F.nullif(raw, F.lit("")), F.lit(UNKNOWN))


_ATTRIBUTE = "struct<Properties:struct<Name:string, Type:struct<Type:array<string>>, FillChecking:string>>"
_OBJECT = (
    f"Object struct<ChildObjects:struct<Attribute:array<{_ATTRIBUTE}>, "
    f"TabularSection:array<struct<Properties:struct<Name:string>, ChildObjects:struct<Attribute:array<{_ATTRIBUTE}>>>>>>"
)


def attributes(objects: DataFrame) -> DataFrame:
    """(type, name, tabular_section, attr_name, attr_type, required): attributes of the object, and those of its tabular
    sections; the first of several types counts. Attributes and sections without a name give no rows, nor do files that
    aren't well-formed XML."""
    # The element of the object is named by its type; one name for all makes one schema.
    same = F.regexp_replace(F.col("xml"), F.concat(F.lit("(</?)"), F.col("type"), F.lit(r"(?=[\s/>])")), F.lit("$1Object"))
    parsed = objects.where("well_formed").select("type", "name", F.from_xml(same, _OBJECT)["Object"]["ChildObjects"].alias("c"))
    own = parsed.select("type", "name", F.lit(None).cast("string").alias("tabular_section"), F.explode("c.Attribute").alias("a"))
    sections = parsed.select("type", "name", F.explode("c.TabularSection").alias("s")).select("type", "name", F.trim("s.Properties.Name").alias("tabular_section"), F.explode("s.ChildObjects.Attribute").alias("a"))
    p = F.col("a.Properties")
    first = F.try_element_at(F.filter(F.transform(p["Type"]["Type"], lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))
    rows = own.unionByName(sections.where("tabular_section <> ''"))
    out = rows.select("type", "name", "tabular_section", F.trim(p["Name"]).alias("attr_name"), type_name(first).alias("attr_type"), F.coalesce(F.trim(p["FillChecking"]) == "Show", F.lit(False)).alias("required"))
    return out.where("attr_name <> ''")
