"""License scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, once with and once without line ends as
boundaries (a notice may be one line, or wrapped over several).  Sentences are
normalised (ASCII letters and digits in lower case, one space between runs) and
mapped to identifiers of known licence sentences; the identifiers, in order,
are matched against rules, each an ordered sequence of identifiers.  The
tables are constants, so there is no join and no shuffle.

Cases: null and empty texts have no sentences and no licence; repeated rows are
scanned each; an empty table gives an empty result; further columns are
ignored; the whole of a long text is scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised.
SENTENCES = {
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache2-notice": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "this project is licensed under the apache license version 2 0"],
    "apache2-header": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gnu gpl v3"],
    "gpl2-notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "licensed under the gnu gpl v2"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd-redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl2-form": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-4": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-4": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-4": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
#: Ordered rules, (licence, class, sentence identifiers that follow each other, others may lie between).
RULES = [
    ("MIT", "permissive", ["mit-notice"]),
    ("MIT", "permissive", ["mit-grant", "mit-keep", "as-is"]),
    ("Apache-2.0", "permissive", ["apache2-notice"]),
    ("Apache-2.0", "permissive", ["apache2-header", "apache2-copy"]),
    ("GPL-3.0", "copyleft", ["gpl3-notice"]),
    ("GPL-3.0", "copyleft", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0", "copyleft", ["gpl2-notice"]),
    ("GPL-2.0", "copyleft", ["gpl2-free", "gpl-hope"]),
    ("BSD-2-Clause", "permissive", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", "permissive", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("MPL-2.0", "weak copyleft", ["mpl2-form"]),
    ("CC-BY-4.0", "attribution", ["cc-by-4"]),
    ("CC-BY-SA-4.0", "share alike", ["cc-by-sa-4"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc-by-nc-4"]),
    ("Unlicense", "public domain", ["unlicense"]),
]
#: Every known sentence has one of these; a text without any is not cut up.
STEMS = ["licen", "permission", "redistribut", "copyright", "warranty", "public domain"]
#: Also looked for in raw text, where "public domain" may be wrapped over lines or have two blanks.
ONE_WORD = "unencumbered"
#: Sentence ends, with and without line ends.
LINES, FLOW = r"[.!?:]([ \t\n\r\f]+|$)|\n+", r"[.!?:]([ \t\n\r\f]+|$)|\n[ \t\r]*\n"


def by_sentence() -> dict[str, str]:
    return {s: k for k, known in SENTENCES.items() for s in known}


def identifiers(text: Column, boundary: str) -> Column:
    """<id><id>... of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in by_sentence().items() for x in pair])
    normal = F.transform(F.split(text, boundary), lambda s: F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " "))))
    return F.array_join(F.transform(F.filter(normal, lambda s: F.array_contains(F.map_keys(known), s)), lambda s: F.concat(F.lit("<"), F.try_element_at(known, s), F.lit(">"))), "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, n_sentences (known ones), licenses, license_classes (joined by `,`) for each row."""
    text = F.coalesce("text", F.lit(""))
    folded = F.lower(text)
    worth = folded.contains(ONE_WORD)
    for stem in STEMS:
        worth |= folded.contains(stem)
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(worth, text).otherwise("").alias("text"))
    found = found.select("doc_id", identifiers(F.col("text"), LINES).alias("by_line"), identifiers(F.col("text"), FLOW).alias("by_flow"))

    def fits(ids: list[str]) -> Column:
        pattern = "%" + "%".join(f"<{i}>" for i in ids) + "%"
        return F.col("by_line").like(pattern) | F.col("by_flow").like(pattern)

    def joined(of) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(fits(r[2]), F.lit(of(r))).otherwise("") for r in RULES]), lambda x: x != ""))), ",")

    ids = F.when(F.length("by_line") >= F.length("by_flow"), F.col("by_line")).otherwise(F.col("by_flow"))
    return found.select(
        "doc_id", ids.alias("sentence_ids"), (F.length(ids) - F.length(F.replace(ids, F.lit("<"), F.lit("")))).cast("bigint").alias("n_sentences"),
        joined(lambda r: r[0]).alias("licenses"), joined(lambda r: r[1]).alias("license_classes"),
    )


def scan_sql() -> str:
    """The same in DuckDB's SQL."""
    known = "map {" + ", ".join(f"'{s}': '{k}'" for s, k in by_sentence().items()) + "}"
    worth = " or ".join(f"contains(lower(coalesce(text, '')), '{s}')" for s in STEMS)

    def ids(boundary):
        normal = f"list_transform(string_split_regex(text, '{boundary}'), lambda s: trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))))"
        return f"coalesce(array_to_string(list_transform(list_filter({normal}, lambda s: list_contains(map_keys({known}), s)), lambda s: '<' || {known}[s] || '>'), ''), '')"

    def fits(r):
        pattern = "%" + "%".join(f"<{i}>" for i in r[2]) + "%"
        return f"(by_line like '{pattern}' or by_flow like '{pattern}')"

    def joined(i):
        return "coalesce(array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"case when {fits(r)} then '{r[i]}' else '' end" for r in RULES) + "], lambda x: x <> ''))), ','), '')"

    return f"""
with d as (select doc_id, case when {worth} then text else '' end as text from documents),
f as (select doc_id, {ids(LINES)} as by_line, {ids(FLOW)} as by_flow from d),
g as (select *, case when length(by_line) >= length(by_flow) then by_line else by_flow end as sentence_ids from f)
select doc_id, sentence_ids, (length(sentence_ids) - length(replace(sentence_ids, '<', '')))::bigint as n_sentences,
  {joined(0)} as licenses, {joined(1)} as license_classes
from g"""
