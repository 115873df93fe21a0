"""Indexes built from sources: call graph, dependency graph, API reference and method chunks, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import lines, strip_line_comment

# Words of the source language that a bracket may follow, and objects of the platform that are no modules.
KEYWORDS = (
    "Если", "Иначе", "ИначеЕсли", "КонецЕсли", "Для", "Пока", "Цикл", "КонецЦикла", "Процедура", "КонецПроцедуры",
    "Функция", "КонецФункции", "Возврат", "Прервать", "Продолжить", "Попытка", "Исключение", "КонецПопытки", "Перем",
    "Новый", "И", "ИЛИ", "НЕ", "Тогда", "Экспорт", "Знач", "Неопределено", "Истина", "Ложь",
)
STANDARD_OBJECTS = (
    "ЭтотОбъект", "Объект", "Форма", "Элементы", "ЭтаФорма", "Справочники", "Документы", "Регистры", "Константы",
    "Метаданные", "Параметры", "ПараметрыСеанса", "Запрос", "Результат", "РезультатЗапроса", "Выборка", "СтрокаТаблицы",
    "Элемент", "Колонка", "Структура", "Массив", "ТаблицаЗначений", "ДеревоЗначений", "Справочник", "Документ",
    "РегистрСведений", "РегистрНакопления", "РегистрБухгалтерии", "РегистрРасчета", "ПланСчетов",
    "ПланВидовХарактеристик", "ПланВидовРасчета", "ПланОбмена", "Перечисление", "БизнесПроцесс", "Задача",
    "ДоставляемыеУведомления", "СредстваМультимедиа", "ФоновыеЗадания", "ИнформацияОбИнтернетСоединении",
    "ЖурналРегистрации", "Пользователи", "ПользователиИнформационнойБазы", "ДвоичныеДанные", "ХранилищеЗначения",
    "ЧтениеJSON", "ЗаписьJSON", "ЧтениеXML", "ЗаписьXML", "HTTPСоединение", "HTTPЗапрос", "HTTPОтвет",
    "КомпоновщикНастроек", "ПроцессорВывода", "ТабличныйДокумент", "ТекстовыйДокумент", "ОписаниеОповещения",
    "ДиалогВыбораФайла", "ЗащищенноеСоединениеOpenSSL",
)
# Prefixes of reference types in both spellings, and the type that each refers to.
REFERENCE_TYPES = {
    "CatalogRef": "Catalog",
    "DocumentRef": "Document",
    "EnumRef": "Enum",
    "ChartOfAccountsRef": "ChartOfAccounts",
    "ChartOfCharacteristicTypesRef": "ChartOfCharacteristicTypes",
    "ChartOfCalculationTypesRef": "ChartOfCalculationTypes",
    "ExchangePlanRef": "ExchangePlan",
    "BusinessProcessRef": "BusinessProcess",
    "TaskRef": "Task",
    "СправочникСсылка": "Catalog",
    "ДокументСсылка": "Document",
    "ПеречислениеСсылка": "Enum",
    "ПланСчетовСсылка": "ChartOfAccounts",
    "ПланВидовХарактеристикСсылка": "ChartOfCharacteristicTypes",
    "ПланВидовРасчетаСсылка": "ChartOfCalculationTypes",
    "ПланОбменаСсылка": "ExchangePlan",
    "БизнесПроцессСсылка": "BusinessProcess",
    "ЗадачаСсылка": "Task",
}
REGISTERS = ("AccumulationRegister", "InformationRegister", "AccountingRegister", "CalculationRegister")
WORD = r"[А-Яа-яЁё][А-Яа-яЁё\w]*"
DEFINITION = r"(?:Процедура|Функция)\s+([А-Яа-яЁё\w]+)"
MODULE_LEVEL = "<модуль>"


def call_sites(modules: DataFrame, path_col: str = "path", text_col: str = "text", word: str = WORD, definition: str = DEFINITION, top: str = MODULE_LEVEL) -> DataFrame:
    """(path, line_no, caller, object, method): every `object.method(` of a module's lines without comments, and every
    `method(`, whose object is null. The caller is the method whose definition stands last at or before the line."""
    rows = lines(modules.select(path_col, text_col), path_col, text_col)
    defined = F.regexp_extract("line", rf"(?U)^\s*{definition}", 1)
    w = Window.partitionBy(path_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    scoped = rows.select(path_col, "line_no", F.coalesce(F.last(F.nullif(defined, F.lit("")), ignorenulls=True).over(w), F.lit(top)).alias("caller"), strip_line_comment(F.col("line")).alias("code"))
    far = F.transform(F.regexp_extract_all("code", F.lit(rf"(?U)\b{word}\s*\.\s*{word}\s*\("), 0), lambda x: F.struct(F.regexp_extract(x, rf"(?U)^({word})", 1).alias("object"), F.regexp_extract(x, rf"(?U)\.\s*({word})", 1).alias("method")))
    near = F.transform(F.regexp_extract_all("code", F.lit(rf"(?U)\b({word})\s*\("), 1), lambda x: F.struct(F.lit(None).cast("string").alias("object"), x.alias("method")))
    return scoped.select(path_col, "line_no", "caller", F.explode(F.concat(far, near)).alias("c")).select(path_col, "line_no", "caller", "c.object", "c.method")


def call_graph(modules: DataFrame, exports: DataFrame, sites: DataFrame, keywords: tuple[str, ...] = KEYWORDS, standard: tuple[str, ...] = STANDARD_OBJECTS) -> DataFrame:
    """(src, src_method, dst, dst_method, line_no): calls of known modules' methods, and calls inside a module of its own
    exported methods, whose `dst` is null and which a method's call of itself isn't.

    `modules` has (path, module, ref), `exports` (module, method) and `sites` what `call_sites` gives. Known modules and
    exports are semi joins, keywords and objects of the platform plain tests.
    """
    calls = sites.where(~F.col("method").isin(*keywords) | F.col("object").isNotNull()).join(modules.select("path", "module", "ref").distinct(), "path")
    known = modules.select(F.col("module").alias("object")).distinct()
    far = calls.where(F.col("object").isNotNull() & ~F.col("object").isin(*standard, *keywords)).join(known, "object", "left_semi")
    far = far.select(F.col("ref").alias("src"), F.col("caller").alias("src_method"), F.concat(F.lit("CommonModule."), "object").alias("dst"), F.col("method").alias("dst_method"), "line_no")
    near = calls.where(F.col("object").isNull() & (F.col("method") != F.col("caller"))).join(exports.select("module", "method").distinct(), ["module", "method"], "left_semi")
    near = near.select(F.col("ref").alias("src"), F.col("caller").alias("src_method"), F.lit(None).cast("string").alias("dst"), F.col("method").alias("dst_method"), "line_no")
    return far.unionByName(near)


def call_totals(graph: DataFrame, modules: DataFrame, exports: DataFrame) -> DataFrame:
    """One row: calls, calls across modules, modules and exported methods."""
    calls = graph.agg(F.count("*").alias("calls"), F.count("dst").alias("cross_module"))
    return calls.crossJoin(modules.agg(F.count_distinct("path").alias("modules"))).crossJoin(exports.select("module", "method").distinct().agg(F.count("*").alias("exports")))  # one row each


def references(type_text: Column) -> Column:
    """array<string>: `Type.Name` of every reference type in a declared type."""
    table = F.create_map(*[F.lit(x) for pair in REFERENCE_TYPES.items() for x in pair])
    found = F.regexp_extract_all(type_text, F.lit(rf"(?U)(?:{'|'.join(REFERENCE_TYPES)})\.\w+"), 0)
    return F.transform(found, lambda x: F.concat_ws(".", F.element_at(table, F.substring_index(x, ".", 1)), F.substring_index(x, ".", -1)))


def dependency_graph(attributes: DataFrame, recorders: DataFrame | None = None) -> DataFrame:
    """(src, dst, edge_type, detail): from `attributes` (type, name, tabular_section, attr_name, attr_type) an edge to every
    referenced object but the own one, and from `recorders` (type, name, recorder) one to each register's recorder."""
    src = F.concat_ws(".", "type", "name").alias("src")
    detail = F.when(F.col("tabular_section").isNull(), F.concat(F.lit("реквизит "), "attr_name")).otherwise(F.concat(F.lit("ТЧ "), "tabular_section", F.lit("."), "attr_name"))
    used = attributes.select(src, F.explode(references(F.col("attr_type"))).alias("dst"), F.lit("uses_attribute").alias("edge_type"), detail.alias("detail")).where("src <> dst")
    if recorders is None:
        return used
    by = recorders.where(F.col("type").isin(*REGISTERS) & F.col("recorder").rlike(r"^[^.]+\..")).select(src, F.col("recorder").alias("dst"), F.lit("registered_by").alias("edge_type"), F.lit("регистратор").alias("detail"))
    return used.unionByName(by)


def dependency_totals(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: edges and nodes; objects (type, name) without edges are nodes too."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(objects.select(F.concat_ws(".", "type", "name").alias("node"))).agg(F.count_distinct("node").alias("nodes"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(nodes)  # one row each


def api_reference(methods: DataFrame, modules: DataFrame) -> DataFrame:
    """(ref, kind, methods): the exported methods of each module by line; modules without one are left out."""
    rows = methods.where("is_export").join(modules.select("path", "ref", "kind"), "path")
    return rows.groupBy("path", "ref", "kind").agg(F.array_sort(F.collect_list(F.struct("start_line", "name", "is_function", "parameters"))).alias("methods")).drop("path")


def method_chunks(modules: DataFrame, methods: DataFrame, prefix: str, separator: str = "_") -> DataFrame:
    """(chunk_id, ref, method_name, code_text): one for each exported method: its kind, name and parameters in the first
    line, then its lines. The id is made of `prefix`, the module's ref and the method's name."""
    heads = methods.where("is_export").select("path", "name", "is_function", "parameters", "start_line", "end_line")
    both = modules.select("path", "ref", F.split("text", "\n", -1).alias("code")).join(heads, "path")
    head = F.concat(F.when(F.col("is_function"), "Функция ").otherwise("Процедура "), "name", F.lit("("), F.array_join(F.transform("parameters", lambda p: p["name"]), ", "), F.lit(")"))
    body = F.array_join(F.slice("code", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return both.select(F.concat_ws(separator, F.lit(prefix), "ref", "name").alias("chunk_id"), "ref", F.col("name").alias("method_name"), F.concat_ws("\n", head, body).alias("code_text"))


def regions(line_rows: DataFrame, key: str, line: str = "line", at: str = "line_no") -> DataFrame:
    """(key, name, start_line, end_line, depth, parent): regions by their markers in a table of lines; the parent is the
    region around it."""
    from .text import pair_regions

    opens = F.regexp_extract(line, r"(?iu)^\s*#(?:Область|Region)\s+(\S+)", 1)
    closes = F.col(line).rlike(r"(?iu)^\s*#(?:КонецОбласти|EndRegion)\b")
    marks = line_rows.select(key, F.col(at).alias("at"), (opens != "").alias("opens"), opens.alias("name"), closes.alias("closes")).where("opens or closes").drop("closes")
    found = pair_regions(marks, key, "at", "opens", "name")
    # The parent is the last region that opened one level up and is still open: each region stands at its own level, as what
    # may be a parent, and at the one above, where it looks for the last before it.
    both = F.array(F.struct(F.col("depth").alias("level"), F.lit(True).alias("offers")), F.struct((F.col("depth") - 1).alias("level"), F.lit(False).alias("offers")))
    asked = found.select("*", F.explode(both).alias("at")).select("*", "at.level", "at.offers").drop("at")
    w = Window.partitionBy(key, "level").orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("offers"), F.struct("name", "end_line")), ignorenulls=True).over(w)
    above = asked.withColumn("above", last).where("not offers")
    return above.withColumn("parent", F.when(F.col("above.end_line") >= F.col("end_line"), F.col("above.name"))).drop("above", "level", "offers")
