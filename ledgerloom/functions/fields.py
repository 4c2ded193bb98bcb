"""Column functions on field values. Accepted spellings, formats and marks are arguments."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNREADABLE = ("[unreadable]", "???")
NOT_APPLICABLE = ("n/a", "not applicable")


def parse_amount(text: Column, currencies: tuple[str, ...] = ("CNY", "USD", "EUR"), units: tuple[str, ...] = ("万元", "元")) -> Column:
    """STRUCT<value DECIMAL(18,2), currency, unit>. Nothing is converted; zero and minus stay;
    a blank, and text without a number, gives a null value. An amount of more than two decimals
    or too many digits is not rounded: its value is null."""
    number = F.regexp_replace(F.regexp_extract(text, r"-?[0-9][0-9,]*(\.[0-9]+)?", 0), ",", "")
    exact = F.when(number.rlike(r"^-?[0-9]{1,16}(\.[0-9]{1,2})?$"), number)

    def one_of(names: tuple[str, ...]) -> Column:
        return F.nullif(F.regexp_extract(text, "|".join(sorted(names, key=len, reverse=True)), 0), F.lit(""))

    return F.struct(exact.try_cast("decimal(18,2)").alias("value"), one_of(currencies).alias("currency"), one_of(units).alias("unit"))


def as_identifier(value: Column) -> Column:
    """Text; leading zeros and long numbers stay; a blank is null."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def blank_status(value: Column, unreadable: tuple[str, ...] = UNREADABLE, not_applicable: tuple[str, ...] = NOT_APPLICABLE) -> Column:
    """stated, not_stated, not_applicable or unreadable."""
    clean = F.lower(F.trim(value))
    return (
        F.when(clean.isin(*unreadable), "unreadable")
        .when(clean.isin(*not_applicable), "not_applicable")
        .when(F.coalesce(clean, F.lit("")) == "", "not_stated")
        .otherwise("stated")
    )


def stated_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy年M月d日")) -> Column:
    """STRUCT<date DATE, raw>: a date only where the text states one; the text beside it."""
    return F.struct(F.coalesce(*(F.try_to_date(text, f) for f in formats)).alias("date"), text.alias("raw"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def cell_lines(items: Column, template: str, fields: tuple[str, ...]) -> Column:
    """An ordered list of structs as one cell, a line each; a null field is left empty."""
    return F.array_join(F.transform(items, lambda x: F.format_string(template, *(F.coalesce(x[f].cast("string"), F.lit("")) for f in fields))), "\n")


def format_location(kind: Column, page: Column, para: Column, row: Column, col: Column) -> Column:
    """The source position in words: a page for PDF and image (null where no page is known), a
    paragraph, table cell, header or footer for Word, never a page there; a picture in a Word file
    is where the paragraph or cell is that holds it."""
    where = F.when(para.isNotNull(), F.format_string("picture in paragraph %d", para)).when(row.isNotNull(), F.format_string("picture in table row %d column %d", row, col))
    return (
        F.when(kind.isin("pdf", "image") & page.isNotNull(), F.format_string("page %d", page))
        .when(kind == "picture", F.coalesce(where, F.lit("picture")))
        .when(kind == "para", F.format_string("paragraph %d", para))
        .when(kind == "cell", F.format_string("table row %d column %d", row, col))
        .when(kind.isin("header", "footer"), kind)
    )


def parse_response(answer: Column, schema: str, required: tuple[str, ...]) -> Column:
    """STRUCT<value, reasons>: the answer by schema (DDL); what is broken or missing as reasons."""
    def judged(value: Column) -> Column:
        broken = answer.isNull() | value.isNull() | value["_broken"].isNotNull()
        missing = [F.when(~broken & value[f].isNull(), F.lit(f"missing {f}")) for f in required]
        reasons = F.array_compact(F.array(F.when(broken, F.lit("unreadable answer")), *missing))
        return F.struct(value.alias("value"), reasons.alias("reasons"))

    # as an element of an array the answer is parsed once, however often it is read
    parsed = F.from_json(answer, schema + ", _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return F.get(F.transform(F.array(parsed), judged), F.lit(0))


def whole_elements(answer: Column, key: str) -> Column:
    """STRUCT<elements ARRAY<STRING>, ended BOOLEAN>: the objects that stand whole in the first array
    of an answer, or in that under the key where the answer is an object; whether the array's end
    is there. Text around the JSON does no harm; brackets within strings don't count. Null without
    such an array."""
    # up to the array's own bracket; of what stands before, only the kind of the first bracket matters
    first = F.regexp_extract(answer, r"[\[{]", 0)
    array = F.when(first == "[", F.regexp_extract(answer, r"(?s)\[.*", 0)).otherwise(F.regexp_extract(answer, f'(?s)"{re.escape(key)}"\\s*:\\s*(\\[.*)', 1))
    # strings (the last may be broken off), brackets, and what lies between: together the whole text
    tokens = F.regexp_extract_all(array, F.lit(r'(?s)"(?:[^"\\]|\\.)*+"?|[{}\[\]]|[^"{}\[\]]++'), F.lit(0))
    none = F.array().cast("array<struct<a:int,n:int>>")
    begin = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit(False).alias("ended"), none.alias("cuts"))

    def read(was: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        depth = was["depth"] + F.when(was["ended"], 0).when(opens, 1).when(closes, -1).otherwise(0)
        whole = ~was["ended"] & (token == "}") & (depth == 1)
        cut = F.array(F.struct(was["start"].alias("a"), (was["at"] + 1 - was["start"]).alias("n")))
        return F.struct(
            (was["at"] + F.length(token)).alias("at"), depth.alias("depth"), F.when((token == "{") & (was["depth"] == 1), was["at"]).otherwise(was["start"]).alias("start"),
            (was["ended"] | (closes & (depth == 0))).alias("ended"), F.when(whole, F.concat(was["cuts"], cut)).otherwise(was["cuts"]).alias("cuts"),
        )

    def cut(text: Column) -> Column:
        found = F.aggregate(tokens, begin, read, lambda x: F.struct(x["cuts"].alias("cuts"), x["ended"].alias("ended")))
        return F.get(F.transform(F.array(found), lambda x: F.struct(F.transform(x["cuts"], lambda c: F.substring(text, c["a"], c["n"])).alias("elements"), x["ended"].alias("ended"))), F.lit(0))

    return F.when(F.length(array) > 0, cut(array))


def salvage_response(answer: Column, schema: str, required: tuple[str, ...], key: str = "candidates") -> Column:
    """STRUCT<candidates ARRAY<STRUCT<value, reasons>>, reasons>: every candidate that stands whole
    in an answer, each by schema (DDL) and with what is broken or missing in it (see parse_response),
    and reasons of the answer itself: it was broken off, or has no array of candidates."""

    def judged(found: Column) -> Column:
        candidates = F.transform(found["elements"], lambda x: parse_response(F.when(F.try_parse_json(x).isNotNull(), x), schema, required))
        n = F.size(found["elements"]).cast("string")
        reason = F.when(found.isNull(), F.lit("unreadable answer")).when(~found["ended"], F.concat(F.lit("answer broken off after "), n, F.lit(" whole candidates")))
        return F.struct(F.coalesce(candidates, F.filter(F.transform(F.array(F.lit("{}")), lambda x: parse_response(x, schema, required)), lambda _: F.lit(False))).alias("candidates"), F.array_compact(F.array(reason)).alias("reasons"))

    return F.get(F.transform(F.array(whole_elements(answer, key)), judged), F.lit(0))


def config_fingerprint(**conditions: Column) -> Column:
    """Identity of what a batch runs under. An access key is no condition and can't be passed."""
    if "access_key" in conditions:
        raise ValueError("the access key is not part of a batch's identity")
    return F.sha2(F.to_json(F.struct(*(conditions[k].cast("string").alias(k) for k in sorted(conditions))), {"ignoreNullFields": "false"}), 256)


def field_lookup(fields: Column, names: list[str]) -> list[Column]:
    """The map's values under these names, null where there is none."""
    return [F.try_element_at(fields, F.lit(n)).alias(n) for n in names]
