"""The names of the functions of the 1C:Enterprise library, and keyword pairs of its two languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Russian/English names by group, in the order they are listed.
_NAMES = {
    "string": """
        СтрНайти/StrFind СтрДлина/StrLen СтрЗаменить/StrReplace Лев/Left Прав/Right Сред/Mid ВРег/Upper НРег/Lower СокрЛП/TrimAll СтрРазделить/StrSplit СтрСоединить/StrConcat
        СтрНачинаетсяС/StrStartsWith СтрЗаканчиваетсяНа/StrEndsWith СтрЧислоВхождений/StrOccurrenceCount СтрЧислоСтрок/StrLineCount СтрПолучитьСтроку/StrGetLine СокрЛ/TrimL
        СокрП/TrimR Символ/Char КодСимвола/CharCode
    """,
    "numeric": """
        Окр/Round Цел/Int Макс/Max Мин/Min
    """,
    "date": """
        ТекущаяДата/CurrentDate Год/Year Месяц/Month День/Day НачалоМесяца/BegOfMonth КонецМесяца/EndOfMonth Дата/Date Час/Hour Минута/Minute Секунда/Second НачалоДня/BegOfDay
        КонецДня/EndOfDay НачалоНедели/BegOfWeek КонецНедели/EndOfWeek НачалоКвартала/BegOfQuarter КонецКвартала/EndOfQuarter НачалоГода/BegOfYear КонецГода/EndOfYear
        ДобавитьМесяц/AddMonth ДеньНедели/WeekDay ДеньГода/DayOfYear НеделяГода/WeekOfYear
    """,
    "conversion": """
        Строка/String Число/Number
    """,
    "object": """
        ЗначениеЗаполнено/ValueIsFilled ТипЗнч/TypeOf Тип/Type XMLСтрока/XMLString XMLЗначение/XMLValue ПредопределенноеЗначение/PredefinedValue
    """,
    "transaction": """
        НачатьТранзакцию/BeginTransaction ЗафиксироватьТранзакцию/CommitTransaction ОтменитьТранзакцию/RollbackTransaction
    """,
    "formatting": """
        Формат/Format НСтр/NStr
    """,
    "query": """
        Запрос/Query
    """,
    "error": """
        ОписаниеОшибки/ErrorDescription ИнформацияОбОшибке/ErrorInfo ВызватьИсключение/Raise
    """,
    "message": """
        Сообщить/Message
    """,
    "mathematics": """
        Лог/Log Лог10/Log10 Pow/Pow Sqrt/Sqrt
    """,
    "boolean": """
        Булево/Boolean ПустаяСтрока/IsBlankString
    """,
    "collection": """
        Массив/Array Структура/Structure Соответствие/Map ТаблицаЗначений/ValueTable
    """,
    "file": """
        КопироватьФайл/FileCopy ПереместитьФайл/MoveFile УдалитьФайлы/DeleteFiles СоздатьКаталог/CreateDirectory НайтиФайлы/FindFiles ОбъединитьПути/CombinePath
        КаталогВременныхФайлов/TempFilesDir ПолучитьИмяВременногоФайла/GetTempFileName ЗаписьТекста/TextWriter ЧтениеТекста/TextReader
    """,
    "http": """
        HTTPЗапрос/HTTPRequest HTTPСоединение/HTTPConnection HTTPСервисОтвет/HTTPServiceResponse
    """,
    "xml_json": """
        ЗаписьXML/XMLWriter ЧтениеXML/XMLReader ЗаписьJSON/JSONWriter ЧтениеJSON/JSONReader ЗаписатьJSON/WriteJSON ПрочитатьJSON/ReadJSON
    """,
    "further_collection": """
        СписокЗначений/ValueList ДеревоЗначений/ValueTree ФиксированнаяСтруктура/FixedStructure ФиксированноеСоответствие/FixedMap
    """,
    "uuid": """
        НовыйУникальныйИдентификатор/NewUUID
    """,
    "system": """
        ИмяКомпьютера/ComputerName ИмяПользователя/UserName ОписаниеТипов/TypeDescription КаталогПрограммы/BinDir РабочийКаталогДанныхПользователя/UserDataWorkDir
    """,
    "encoding": """
        Base64Строка/Base64String Base64Значение/Base64Value
    """,
    "utility": """
        ОбработкаПрерыванияПользователя/UserInterruptProcessing ПолучитьФункциональнуюОпцию/GetFunctionalOption КомандаСистемы/System Спать/Sleep
        ТекущаяУниверсальнаяДата/CurrentUniversalDate МестноеВремя/ToLocalTime УниверсальноеВремя/ToUniversalTime ЧасовойПоясСеанса/SessionTimeZone
        ТранзакцияАктивна/TransactionActive ФиксированныйМассив/FixedArray ДвоичныеДанные/BinaryData ПолучитьДвоичныеДанныеИзСтроки/GetBinaryDataFromString
        ПолучитьСтрокуИзДвоичныхДанных/GetStringFromBinaryData ПолучитьДвоичныеДанныеИзBase64Строки/GetBinaryDataFromBase64String
        ПолучитьBase64СтрокуИзДвоичныхДанных/GetBase64StringFromBinaryData
    """,
    "value_table": """
        ТаблицаЗначений.НайтиСтроки/ValueTable.FindRows ТаблицаЗначений.Скопировать/ValueTable.Copy ТаблицаЗначений.Свернуть/ValueTable.GroupBy
        ТаблицаЗначений.Сортировать/ValueTable.Sort ТаблицаЗначений.ВыгрузитьКолонку/ValueTable.UnloadColumn ТаблицаЗначений.ЗагрузитьКолонку/ValueTable.LoadColumn
        ТаблицаЗначений.Добавить/ValueTable.Add ТаблицаЗначений.Удалить/ValueTable.Delete ТаблицаЗначений.Итог/ValueTable.Total ТаблицаЗначений.Количество/ValueTable.Count
        ТаблицаЗначений.Очистить/ValueTable.Clear ТаблицаЗначений.Колонки.Добавить/ValueTable.Columns.Add
    """,
    "array": """
        Массив.Добавить/Array.Add Массив.Вставить/Array.Insert Массив.Удалить/Array.Delete Массив.Найти/Array.Find Массив.Количество/Array.Count Массив.ВГраница/Array.UBound
    """,
    "structure": """
        Структура.Вставить/Structure.Insert Структура.Свойство/Structure.Property Структура.Количество/Structure.Count
    """,
    "map": """
        Соответствие.Вставить/Map.Insert Соответствие.Получить/Map.Get Соответствие.Удалить/Map.Delete
    """,
    "query_methods": """
        Запрос.Выполнить/Query.Execute Запрос.УстановитьПараметр/Query.SetParameter РезультатЗапроса.Выбрать/QueryResult.Select РезультатЗапроса.Выгрузить/QueryResult.Unload
    """,
    "catalogs": """
        Справочники.НайтиПоНаименованию/Catalogs.FindByDescription Справочники.НайтиПоКоду/Catalogs.FindByCode Справочники.ПустаяСсылка/Catalogs.EmptyRef
        Справочники.СоздатьЭлемент/Catalogs.CreateItem СправочникОбъект.Записать/CatalogObject.Write СправочникОбъект.Удалить/CatalogObject.Delete
        СправочникСсылка.ПолучитьОбъект/CatalogRef.GetObject СправочникСсылка.Пустая/CatalogRef.IsEmpty
    """,
    "documents": """
        Документы.СоздатьДокумент/Documents.CreateDocument Документы.НайтиПоНомеру/Documents.FindByNumber ДокументОбъект.Записать/DocumentObject.Write
        ДокументОбъект.Провести/DocumentObject.Post ДокументОбъект.ОтменитьПроведение/DocumentObject.UndoPosting ДокументСсылка.ПолучитьОбъект/DocumentRef.GetObject
    """,
    "registers": """
        РегистрыСведений.СоздатьМенеджерЗаписи/InformationRegisters.CreateRecordManager РегистрыСведений.СоздатьНаборЗаписей/InformationRegisters.CreateRecordSet
        МенеджерЗаписи.Записать/RecordManager.Write МенеджерЗаписи.Прочитать/RecordManager.Read НаборЗаписей.Записать/RecordSet.Write
    """,
    "enumeration": """
        Символы.ПС/Chars.LF Символы.Таб/Chars.Tab Символы.ВК/Chars.CR ВидДвиженияНакопления.Приход/AccumulationMovementType.Receipt
        ВидДвиженияНакопления.Расход/AccumulationMovementType.Expense РежимЗаписиДокумента/DocumentWriteMode КодировкаТекста.UTF8/TextEncoding.UTF8 ТипУзлаXML/XMLNodeType
    """,
    "pattern": """
        ОбщийМодуль/CommonModule СтрокаСоединенияИнформационнойБазы/InfoBaseConnectionString ПараметрыСеанса/SessionParameters
        ОбщегоНазначения.СообщитьПользователю/CommonModule.MessageToUser Движения/Movements
    """,}

# Keywords of the language and of its queries, Russian/English.
_KEYWORDS = """
    процедура/procedure конецпроцедуры/endprocedure функция/function конецфункции/endfunction если/if тогда/then иначе/else иначеесли/elsif конецесли/endif
    для/for каждого/each из/in по/to цикл/do пока/while конеццикла/enddo возврат/return попытка/try исключение/except конецпопытки/endtry новый/new перем/var экспорт/export знач/val
    не/not и/and или/or истина/true ложь/false неопределено/undefined выбрать/select где/where как/as левое/left внутреннее/inner соединение/join сгруппировать/group упорядочить/order
    имеющие/having различные/distinct объединить/union выразить/cast количество/count сумма/sum максимум/max минимум/min среднее/avg добавитьобработчик/addhandler
    вызватьисключение/raise выполнить/execute перейти/goto продолжить/continue прервать/break
"""

#: What a function is in Spark, where a built-in one does the same.
_SPARK = {
    "StrFind": "locate", "StrLen": "length", "StrReplace": "replace", "Left": "left", "Right": "right", "Mid": "substring", "Upper": "upper", "Lower": "lower", "TrimAll": "trim", "StrSplit": "split",
    "StrConcat": "array_join", "StrStartsWith": "startswith", "StrEndsWith": "endswith", "StrOccurrenceCount": "regexp_count", "StrLineCount": "size(split)", "StrGetLine": "element_at(split)",
    "TrimL": "ltrim", "TrimR": "rtrim", "Char": "char", "CharCode": "ascii", "Round": "round", "Int": "cast bigint", "Max": "greatest", "Min": "least", "CurrentDate": "current_timestamp", "Year": "year",
    "Month": "month", "Day": "day", "BegOfMonth": "date_trunc('month')", "BegOfDay": "date_trunc('day')", "BegOfWeek": "date_trunc('week')", "BegOfQuarter": "date_trunc('quarter')",
    "BegOfYear": "date_trunc('year')", "Date": "make_timestamp", "Hour": "hour", "Minute": "minute", "Second": "second", "AddMonth": "add_months", "WeekDay": "weekday + 1", "DayOfYear": "dayofyear",
    "WeekOfYear": "weekofyear", "String": "cast string", "Number": "cast decimal", "Format": "format_string", "Log": "ln", "Log10": "log10", "Pow": "power", "Sqrt": "sqrt", "Boolean": "cast boolean",
    "IsBlankString": "trim(s) = ''", "Array": "array", "Structure": "named_struct", "Map": "map", "WriteJSON": "to_json", "ReadJSON": "from_json", "NewUUID": "uuid", "Base64String": "base64",
    "Base64Value": "unbase64", "CurrentUniversalDate": "current_timestamp", "ToLocalTime": "from_utc_timestamp", "ToUniversalTime": "to_utc_timestamp", "SessionTimeZone": "current_timezone",
    "UserName": "current_user", "ValueIsFilled": "isnotnull", "TypeOf": "typeof", "ValueTable.GroupBy": "GROUP BY", "ValueTable.Sort": "ORDER BY", "ValueTable.FindRows": "WHERE", "ValueTable.Total": "sum",
    "ValueTable.Count": "count", "ValueTable.UnloadColumn": "collect_list", "Array.Add": "array_append", "Array.Insert": "array_insert", "Array.Find": "array_position", "Array.Count": "size", "Map.Get": "element_at",
}


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(word.split("/")) for word in text.split()]


#: (group, Russian, English, Spark or None) of every function.
FUNCTIONS = [(group, ru, en, _SPARK.get(en)) for group, text in _NAMES.items() for ru, en in _pairs(text)]


def _synonyms() -> dict[str, str]:
    """Lower-case words to their partners, both ways: keywords first, then functions of which neither name is taken."""
    found = {}
    for ru, en in _pairs(_KEYWORDS) + [(ru.lower(), en.lower()) for _, ru, en, _ in FUNCTIONS]:
        if ru != en and ru not in found and en not in found:
            found |= {ru: en, en: ru}
    return found


SYNONYMS = _synonyms()


def function_table(spark: SparkSession) -> DataFrame:
    """(no, function_group, name_ru, name_en, spark_equivalent) of every function."""
    return spark.createDataFrame([(n, *f) for n, f in enumerate(FUNCTIONS, 1)], "no int, function_group string, name_ru string, name_en string, spark_equivalent string")


def synonym_table(spark: SparkSession) -> DataFrame:
    """(term, partner), both ways."""
    return spark.createDataFrame(sorted(SYNONYMS.items()), "term string, partner string")


def function_help(spark: SparkSession, query: str) -> DataFrame:
    """The functions with ``query`` in either name, in any case; all for an empty query."""
    word = F.lit(query.lower())
    return function_table(spark).where(F.contains(F.lower("name_ru"), word) | F.contains(F.lower("name_en"), word))
