"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised to lower-case words, and known licence sentences get
identifiers. A sentence may go on over line breaks and comment signs; as notices of one line often end
without punctuation, each line may begin a sentence. The sequence of identifiers of a document is then matched against ordered licence rules:
a rule takes the sentences it matches out of the sequence, so a licence made of several sentences wins
over the rules for single ones that follow it. What no rule takes stays as *unmatched*.

Everything is an expression over the row, so nothing is shuffled; a text without any of the words that
the known sentences need is not cut at all.

Defined results: null and empty texts have no sentences; repeated rows come out as they are; ids may
be null; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every known sentence has one of these words, whole and in any case, so a text without them has none.
WORDS = (
    r"(?i)licen|permission|redistribution|copyright|reserved|cc0|domain|provided|endorse|applicable"
    r"|software|distributed|gnu|released|available"
)
# A sentence ends at punctuation, a line without a letter or digit, or before a list item; the text is in
# lower case by then. The GPL has a semicolon inside its sentence; how far it is looked for is bounded,
# so that a text of nothing but semicolons takes linear time.
ENDS = (
    r"(?:[.!?]|;(?![^a-z0-9;]{1,64}+(?:(?:rem|dnl)\s{1,64}+)?you\s{1,64}+can\s{1,64}+redistribute))[\x20\x09-\x0D]+"
    r"|\n[^a-z0-9]*\n|\n[^a-z0-9\n]*(?:rem|dnl)[\x20\x09]*(?=\n)|\n(?=[^a-z0-9\n]*(?:[0-9]{1,3}|[a-z])[.)][\x20\x09])|\n(?=[\x20\x09]*-[\x20\x09])"
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Known sentences, as patterns over normalised words: the first that fits names the sentence.
SENTENCES = [
    ("SpdxMIT", r"^spdx license identifier mit$"),
    ("SpdxApache2", r"^spdx license identifier apache 2 0$"),
    ("SpdxGPL2", r"^spdx license identifier gpl 2 0( only| or later)?$"),
    ("SpdxGPL3", r"^spdx license identifier gpl 3 0( only| or later)?$"),
    ("SpdxBSD", r"^spdx license identifier bsd [23] clause$"),
    ("MITGrant", r"^permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MITNotice", r"^the above copyright notice and this permission notice shall be included in all copies"),
    ("ISCGrant", r"^permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("AsIsSoftware", r"^the software is provided as is"),
    ("MITLiability", r"^in no event shall the authors or copyright holders be liable"),
    ("BSDPre", r"^redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSDSource", r"^(1 |a )?redistributions of source code must retain the above copyright notice"),
    ("BSDBinary", r"^(2 |b )?redistributions in binary form must reproduce the above copyright notice"),
    ("BSDEndorse", r"^(3 |c )?neither the name of .* may be used to endorse or promote products"),
    ("BSDAsIs", r"^this software is provided by the copyright holders and contributors as is"),
    ("BSDLiability", r"^in no event shall the copyright (holder|owner)s? or contributors be liable"),
    ("ApacheCompliance", r"^you may not use this file except in compliance with the license"),
    ("ApacheObtain", r"^you may obtain a copy of the license at"),
    ("ApacheAsIs", r"^unless required by applicable law or agreed to in writing"),
    ("ApacheGoverning", r"^see the license for the specific language governing permissions"),
    ("ApacheHead2", r"^licensed under the apache license version 2 0 the license"),
    ("ApacheRef2", r"(licen[sc]ed|released|distributed|available) under the (terms of the )?apache license( version)? 2 0$"),
    ("GPLFree", r"^this (program|library|software) is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("GPLHope", r"^this (program|library|software) is distributed in the hope that it will be useful"),
    ("GPLCopy", r"^you should have received a copy of the gnu"),
    ("AGPLRef", r"(licen[sc]ed|released|distributed|available) under the (terms of the )?gnu affero general public license"),
    ("LGPLRef", r"(licen[sc]ed|released|distributed|available) under the (terms of the )?gnu (lesser|library) general public license"),
    ("GPLRef3", r"(licen[sc]ed|released|distributed|available) under the (terms of the )?gnu general public license( version| v)? ?3( 0)?( or later| or any later version)?$"),
    ("GPLRef2", r"(licen[sc]ed|released|distributed|available) under the (terms of the )?gnu general public license( version| v)? ?2( 0)?( or later| or any later version)?$"),
    ("GPLRef", r"(licen[sc]ed|released|distributed|available) under the (terms of the )?gnu general public license$"),
    ("MITRef", r"(licen[sc]ed|released|distributed|available) under the (terms of the )?mit licen[sc]e$"),
    ("BSDRef", r"(licen[sc]ed|released|distributed|available) under the (terms of the )?([23] clause |new |simplified )?bsd licen[sc]e$"),
    ("MPLRef", r"(licen[sc]ed|released|distributed|available) under the (terms of the )?mozilla public license"),
    ("CCByNcSaRef", r"(licen[sc]ed|released|available) under (a |the )?(cc|creative commons)( attribution| by) (nc|noncommercial) (sa|sharealike)"),
    ("CCByNcNdRef", r"(licen[sc]ed|released|available) under (a |the )?(cc|creative commons)( attribution| by) (nc|noncommercial) (nd|noderivatives)"),
    ("CCByNcRef", r"(licen[sc]ed|released|available) under (a |the )?(cc|creative commons)( attribution| by) (nc|noncommercial)"),
    ("CCBySaRef", r"(licen[sc]ed|released|available) under (a |the )?(cc|creative commons)( attribution| by) (sa|sharealike)"),
    ("CCByRef", r"(licen[sc]ed|released|available) under (a |the )?(cc|creative commons)( attribution| by)"),
    ("CC0Ref", r"(cc0|dedicated to the public domain|released into the public domain)"),
    ("Rights", r"^all rights reserved$"),
    ("OtherRef", r"(licen[sc]ed|released|distributed|available) under (the |a )?.*licen[sc]e"),
]

# Ordered rules over the sequence of sentences: ``a|b`` is either, ``a?`` may be missing. Earlier rules
# take their sentences first.
RULES = [
    ("MIT", "MITGrant MITNotice? AsIsSoftware? MITLiability?"),
    ("ISC", "ISCGrant AsIsSoftware?"),
    ("BSD-3-Clause", "BSDPre BSDSource BSDBinary BSDEndorse BSDAsIs? BSDLiability?"),
    ("BSD-2-Clause", "BSDPre BSDSource BSDBinary BSDAsIs? BSDLiability?"),
    ("Apache-2.0", "ApacheHead2|ApacheRef2 ApacheCompliance ApacheObtain? ApacheAsIs? ApacheGoverning?"),
    ("GPL-header", "GPLFree GPLHope? GPLCopy?"),
    ("Apache-2.0", "ApacheHead2|ApacheRef2|SpdxApache2"),
    ("MIT", "MITRef|SpdxMIT"),
    ("BSD", "BSDRef|SpdxBSD"),
    ("AGPL", "AGPLRef"),
    ("LGPL", "LGPLRef"),
    ("GPL-3.0", "GPLRef3|SpdxGPL3"),
    ("GPL-2.0", "GPLRef2|SpdxGPL2"),
    ("GPL", "GPLRef"),
    ("MPL", "MPLRef"),
    ("CC-BY-NC-SA", "CCByNcSaRef"),
    ("CC-BY-NC-ND", "CCByNcNdRef"),
    ("CC-BY-NC", "CCByNcRef"),
    ("CC-BY-SA", "CCBySaRef"),
    ("CC-BY", "CCByRef"),
    ("CC0", "CC0Ref"),
]


def pattern(rule: str) -> str:
    """A rule over a sequence in which each sentence stands between commas of its own."""
    steps = [(step.rstrip("?"), step.endswith("?")) for step in rule.split()]
    return "".join(f"(?:,(?:{names}),)" + "?" * may_miss for names, may_miss in steps)


def sentences(text: Column) -> Column:
    """Normalised sentences of a text that may be known, in order, their lines kept apart by line breaks."""
    plain = F.translate(F.regexp_replace(text, r"\r\n?", "\n"), UPPER + "|", LOWER + " ")
    plain = F.regexp_replace(plain, ENDS, "|")
    plain = F.regexp_replace(plain, r"[^a-z0-9|\n]+", " ")
    plain = F.regexp_replace(plain, r"([|\n]|^)[ \n]*(?:(?:rem|dnl) )?| *(?=[|\n]|$)", "$1")
    return F.filter(F.split(plain, r"\|"), lambda s: s.rlike(WORDS))


def over_lines(known: str) -> str:
    """The pattern of a known sentence for one that begins in this line and may go on in the next ones.

    Lines stand behind ``|`` (the first of a sentence) or a line break, and those already named behind
    a sign; a sentence that ends with its pattern ends at the end of a line.
    """
    anchored, ended = known.startswith("^"), known.endswith("$")
    body = known.removeprefix("^").removesuffix("$").replace(".*", "[^|]*?")
    body = body.replace(" ", r"(?: |\n(?:=[A-Za-z0-9]+=)?)")
    begin = "" if anchored else r"[^|\n=]*?"
    return rf"([|\n])(?={begin}(?:{body})" + (r"[|\n])" if ended else ")")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences, in order: at most one for each line, that of the first that fits."""
    marked = F.concat(F.lit("|"), F.array_join(sentences(text), "|"), F.lit("|"))
    for name, known in SENTENCES[:-1]:
        marked = F.regexp_replace(marked, over_lines(known), f"$1={name}=")
    # The rest of a sentence that is known by its beginning may mention a licence, which is no notice.
    name, known = SENTENCES[-1]
    begun = "|".join(n for n, p in SENTENCES if p.startswith("^") and not p.endswith("$"))
    marked = F.regexp_replace(marked, over_lines(known), "$1~")
    marked = F.regexp_replace(marked, rf"(\G(?!^)|=(?:{begun})=)([^|~]*)~", "$1$2")
    marked = F.regexp_replace(marked, "~", f"={name}=")
    return F.regexp_extract_all(marked, F.lit("=([A-Za-z0-9]+)="), F.lit(1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licenses, unmatched`` for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.when(
            F.col("text").rlike(WORDS),
            sentence_ids(F.col("text")),
        )
        .otherwise(none)
        .alias("ids"),
    )
    # What a rule takes is replaced by the licence, behind a sign that no rule knows.
    left = F.array_join(F.transform("ids", lambda s: F.concat(F.lit(","), s, F.lit(","))), "")
    for name, rule in RULES:
        left = F.regexp_replace(left, pattern(rule), f",={name},")
    rows = rows.withColumn("parts", F.filter(F.split(left, ","), lambda s: s != ""))
    taken = F.transform(
        F.filter("parts", lambda s: s.startswith("=")), lambda s: F.substring(s, 2, 99)
    )
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.sort_array(F.array_distinct(taken)), ",").alias("licenses"),
        F.array_join(F.filter("parts", lambda s: ~s.startswith("=")), ",").alias("unmatched"),
    )


def sql() -> str:
    """The same in SQL: sentences as lists of lines, and for each line the first known sentence that
    begins in it and goes on in as many lines as it takes."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    space = r"[\x20\x09-\x0D]"
    # What ends a sentence becomes a bar, one kind of end after the other.
    cut = "regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\\r', chr(10), 'g')"
    cut = f"translate({cut}, '{UPPER}|', '{LOWER} ')"
    for pattern_, to in [
        (rf";([^a-z0-9]+(?:(?:rem|dnl){space}+)?you{space}+can{space}+redistribute)", r" \1"),
        (r"\n([^a-z0-9\n]*(?:[0-9]{1,3}|[a-z])[.)][\x20\x09])", r"|\1"),
        (r"\n([\x20\x09]*-[\x20\x09])", r"|\1"),
        (rf"[.!?;]{space}+", "|"),
        (r"\n[^a-z0-9|]*\n", "|"),
        (r"\n[^a-z0-9\n|]*(?:rem|dnl)[\x20\x09]*(\n)", r"|\1"),
    ]:
        cut = f"regexp_replace({cut}, {quote(pattern_)}, {quote(to)}, 'g')"
    cases = []
    for name, known in SENTENCES:
        body = known.removeprefix("^").removesuffix("$").replace(" ", r"[ \n]").replace(".*", r"(?:.|\n)*?")
        begin = "^" if known.startswith("^") else r"^[^\n]*?"
        end = r"(?:\n|\z)" if known.endswith("$") else ""
        cases.append(f"WHEN regexp_matches(s, {quote(f'{begin}(?:{body}){end}')}) THEN {quote(name)}")
    begun = ", ".join(quote(n) for n, p in SENTENCES if p.startswith("^") and not p.endswith("$"))
    left = "array_to_string(list_transform(ids, lambda x: ',' || x || ','), '')"
    for name, rule in RULES:
        left = f"regexp_replace({left}, {quote(pattern(rule))}, ',={name},', 'g')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, string_split({cut}, '|') AS sentences FROM documents
), s AS (
  SELECT doc, doc_id, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) AS nth FROM d
), l AS (
  SELECT doc, nth, list_filter(list_transform(string_split(sentence, chr(10)), lambda x:
    regexp_replace(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), '^(?:rem|dnl) ', '')), lambda x: x <> '') AS lines
  FROM s
), b AS (
  SELECT doc, nth, lines, unnest(range(1, len(lines) + 1)) AS line FROM l
), n AS (
  SELECT doc, nth, line, CASE {" ".join(cases)} END AS name
  FROM (SELECT doc, nth, line, array_to_string(lines[line:], chr(10)) AS s FROM b)
), k AS (
  SELECT doc, nth, line, name,
         bool_or(name IN ({begun})) OVER (PARTITION BY doc, nth ORDER BY line) AS begun
  FROM n WHERE name IS NOT NULL
), i AS (
  SELECT d.doc_id, d.doc, coalesce(list(name ORDER BY nth, line) FILTER (WHERE name IS NOT NULL), []) AS ids
  FROM d LEFT JOIN (SELECT * FROM k WHERE name <> {quote(SENTENCES[-1][0])} OR NOT begun) AS k ON k.doc = d.doc
  GROUP BY d.doc_id, d.doc
), r AS (
  SELECT doc_id, ids, list_filter(string_split({left}, ','), lambda x: x <> '') AS parts FROM i
)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct(list_transform(
         list_filter(parts, lambda x: x[1] = '='), lambda x: x[2:]))), ',') AS licenses,
       array_to_string(list_filter(parts, lambda x: x[1] <> '='), ',') AS unmatched
FROM r
"""
