"""License scans by sentence rules.

A text is cut into sentences, each is normalised and mapped to the identifier of the licence sentence it is (its
version included), and the sequence of identifiers is matched against ordered rules: the first rule that finds its
identifiers side by side takes them out and names a licence, then the next rule looks at what is left. A sentence
about a licence that no pattern knows has the identifier UNKNOWN and takes part in no rule.

Everything is column expressions within a row: no shuffle, whatever the size or skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The known sentences in the order they are tried, as identifier, pattern over normalised sentences
#: (lower case, words of letters, digits, dots and plus signs, one space apart).
#: A pattern's first group, if any, is appended to the identifier.
SENTENCES = (
    ("SPDX-", r"spdx license identifier (apache 2\.0|mit|isc|bsd [23] clause|a?gpl 3\.0 or later|a?gpl 3\.0|gpl 2\.0 or later|gpl 2\.0|lgpl (?:2\.1|3\.0) or later|lgpl (?:2\.1|3\.0)|mpl 2\.0|cc0 1\.0)"),
    ("LGPL-LATER-", r"gnu (?:lesser|library) general public license.{0,160} (?:version|v\.?) ?(2\.1|2|3)(?:\.0)?\b.{0,160}any later version"),
    ("LGPL-", r"gnu (?:lesser|library) general public license.{0,160} (?:version|v\.?) ?(2\.1|2|3)(?:\.0)?(?: |$)"),
    ("AGPL-LATER-", r"gnu affero general public license.{0,160} (?:version|v\.?) ?(3)(?:\.0)?\b.{0,160}any later version"),
    ("AGPL-", r"gnu affero general public license.{0,160} (?:version|v\.?) ?(3)(?:\.0)?(?: |$)"),
    ("GPL-LATER-", r"gnu general public license.{0,160} (?:version|v\.?) ?([1-3])(?:\.0)?\b.{0,160}any later version"),
    ("GPL-", r"gnu general public license.{0,160} (?:version|v\.?) ?([1-3])(?:\.0)?(?: |$)"),
    ("LGPL-ANY", r"gnu (?:lesser|library) general public license|\blgpl\b"),
    ("AGPL-ANY", r"gnu affero general public license|\bagpl\b"),
    ("GPL-ANY", r"gnu general public license|\bgpl\b"),
    ("LATER", r"any later version"),
    ("APACHE-", r"apache license (?:version |v\.? ?)?(1\.1|2\.0)"),
    ("APACHE-ANY", r"under apache license"),
    ("CC-", r"(?:cc|creative commons) ((?:by nc nd|by nc sa|by nc|by nd|by sa|by) (?:2\.0|2\.5|3\.0|4\.0))"),
    ("CC0", r"\bcc0\b"),
    ("MPL-", r"mozilla public license (?:version |v\.? ?)?(1\.1|2\.0)"),
    ("MIT-NAME", r"\bmit license\b"),
    ("BSD-", r"\bbsd ([23]) clause license\b"),
    ("BSD-NAME", r"\bbsd license\b"),
    ("ISC-GRANT", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("MIT-GRANT", r"permission is hereby granted free of charge to any person obtaining copy"),
    ("MIT-NOTICE", r"above copyright notice and this permission notice shall be included"),
    ("BSD-GRANT", r"redistribution and use in source and binary forms"),
    ("BSD-SOURCE", r"redistributions of source code must retain"),
    ("BSD-BINARY", r"redistributions in binary form must reproduce"),
    ("BSD-ENDORSE", r"neither name of .* may be used to endorse"),
    ("AS-IS", r"software is provided .*as is"),
    ("PUBLIC-DOMAIN", r"\bpublic domain\b"),
    ("RESERVED", r"\ball rights reserved\b"),
    ("UNKNOWN", r"licen[sc]e"),
)
#: The rules in the order they are tried, longer ones first; a licence and its identifiers in sequence.
RULES = (
    ("BSD-3-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY BSD-ENDORSE AS-IS"),
    ("BSD-3-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY BSD-ENDORSE"),
    ("BSD-2-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY AS-IS"),
    ("BSD-2-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY"),
    ("MIT", "MIT-GRANT MIT-NOTICE AS-IS"),
    ("MIT", "MIT-GRANT MIT-NOTICE"),
    ("ISC", "ISC-GRANT AS-IS"),
    ("ISC", "ISC-GRANT"),
    ("GPL-3.0-or-later", "GPL-LATER-3"),
    ("GPL-3.0-or-later", "GPL-3 LATER"),
    ("GPL-2.0-or-later", "GPL-LATER-2"),
    ("GPL-2.0-or-later", "GPL-2 LATER"),
    ("GPL-1.0-or-later", "GPL-LATER-1"),
    ("GPL-1.0-or-later", "GPL-1 LATER"),
    ("LGPL-3.0-or-later", "LGPL-LATER-3"),
    ("LGPL-3.0-or-later", "LGPL-3 LATER"),
    ("LGPL-2.1-or-later", "LGPL-LATER-2.1"),
    ("LGPL-2.1-or-later", "LGPL-2.1 LATER"),
    ("LGPL-2.0-or-later", "LGPL-LATER-2"),
    ("LGPL-2.0-or-later", "LGPL-2 LATER"),
    ("AGPL-3.0-or-later", "AGPL-LATER-3"),
    ("AGPL-3.0-or-later", "AGPL-3 LATER"),
    ("GPL-3.0-only", "GPL-3"),
    ("GPL-2.0-only", "GPL-2"),
    ("GPL-1.0-only", "GPL-1"),
    ("LGPL-3.0-only", "LGPL-3"),
    ("LGPL-2.1-only", "LGPL-2.1"),
    ("LGPL-2.0-only", "LGPL-2"),
    ("AGPL-3.0-only", "AGPL-3"),
    ("Apache-2.0", "APACHE-2.0"),
    ("Apache-1.1", "APACHE-1.1"),
    ("Apache-2.0", "SPDX-apache-2.0"),
    ("MIT", "SPDX-mit"),
    ("ISC", "SPDX-isc"),
    ("BSD-2-Clause", "SPDX-bsd-2-clause"),
    ("BSD-3-Clause", "SPDX-bsd-3-clause"),
    ("GPL-3.0-or-later", "SPDX-gpl-3.0-or-later"),
    ("GPL-3.0-only", "SPDX-gpl-3.0"),
    ("GPL-2.0-or-later", "SPDX-gpl-2.0-or-later"),
    ("GPL-2.0-only", "SPDX-gpl-2.0"),
    ("LGPL-3.0-or-later", "SPDX-lgpl-3.0-or-later"),
    ("LGPL-3.0-only", "SPDX-lgpl-3.0"),
    ("LGPL-2.1-or-later", "SPDX-lgpl-2.1-or-later"),
    ("LGPL-2.1-only", "SPDX-lgpl-2.1"),
    ("AGPL-3.0-or-later", "SPDX-agpl-3.0-or-later"),
    ("AGPL-3.0-only", "SPDX-agpl-3.0"),
    ("MPL-2.0", "SPDX-mpl-2.0"),
    ("CC0-1.0", "SPDX-cc0-1.0"),
    ("MIT", "MIT-NAME"),
    ("BSD-3-Clause", "BSD-3"),
    ("BSD-2-Clause", "BSD-2"),
    ("MPL-2.0", "MPL-2.0"),
    ("MPL-1.1", "MPL-1.1"),
    ("CC-BY-NC-ND-4.0", "CC-by-nc-nd-4.0"),
    ("CC-BY-NC-ND-3.0", "CC-by-nc-nd-3.0"),
    ("CC-BY-NC-ND-2.5", "CC-by-nc-nd-2.5"),
    ("CC-BY-NC-ND-2.0", "CC-by-nc-nd-2.0"),
    ("CC-BY-NC-SA-4.0", "CC-by-nc-sa-4.0"),
    ("CC-BY-NC-SA-3.0", "CC-by-nc-sa-3.0"),
    ("CC-BY-NC-SA-2.5", "CC-by-nc-sa-2.5"),
    ("CC-BY-NC-SA-2.0", "CC-by-nc-sa-2.0"),
    ("CC-BY-NC-4.0", "CC-by-nc-4.0"),
    ("CC-BY-NC-3.0", "CC-by-nc-3.0"),
    ("CC-BY-NC-2.5", "CC-by-nc-2.5"),
    ("CC-BY-NC-2.0", "CC-by-nc-2.0"),
    ("CC-BY-ND-4.0", "CC-by-nd-4.0"),
    ("CC-BY-ND-3.0", "CC-by-nd-3.0"),
    ("CC-BY-ND-2.5", "CC-by-nd-2.5"),
    ("CC-BY-ND-2.0", "CC-by-nd-2.0"),
    ("CC-BY-SA-4.0", "CC-by-sa-4.0"),
    ("CC-BY-SA-3.0", "CC-by-sa-3.0"),
    ("CC-BY-SA-2.5", "CC-by-sa-2.5"),
    ("CC-BY-SA-2.0", "CC-by-sa-2.0"),
    ("CC-BY-4.0", "CC-by-4.0"),
    ("CC-BY-3.0", "CC-by-3.0"),
    ("CC-BY-2.5", "CC-by-2.5"),
    ("CC-BY-2.0", "CC-by-2.0"),
    ("CC0-1.0", "CC0"),
    ("LGPL", "LGPL-ANY"),
    ("AGPL", "AGPL-ANY"),
    ("GPL", "GPL-ANY"),
    ("Apache", "APACHE-ANY"),
    ("BSD", "BSD-NAME"),
    ("Public-Domain", "PUBLIC-DOMAIN"),
)
#: Before cutting: the stop of a "v." before a number goes, and line breaks go that wrap a sentence, with the marks of
#: comments after them: those before a small letter or a parenthesis, and those after a comma or a word that needs another.
UNWRAP = (
    (r"\b([vV])\.[ \t]*([0-9])", "1 2"),
    (r"(,|\bGNU|\bGNU General|\bGeneral Public|\bPublic|\bMozilla|\bApache|\bCreative|\bFree|\bthe|\bof|\bunder)[ \t\r]*\n[ \t*#/]*([A-Za-z0-9(])", "1 2"),
    (r"\n[ \t\r*#/]*([a-z(])", " 1"),
)
SPLIT = r"[.!?;]+[ \t\r\n]+|\n"
#: Substrings of a lower-cased sentence without which it is no licence sentence.
NEEDS = ("licen", "gpl", "later version", "permission", "redistribution", "neither", "public domain", "rights reserved", "as is", "cc")


def _has_any(text: Column) -> Column:
    found = F.lit(False)
    for x in NEEDS:
        found = found | F.contains(text, F.lit(x))
    return found


def unwrapped(text: Column) -> Column:
    """The text by :data:`UNWRAP`."""
    for pattern, keep in UNWRAP:
        text = F.regexp_replace(text, pattern, "".join(f"${x}" if x.isdigit() else x for x in keep))
    return text


def normal_sentence(sentence: Column) -> Column:
    """Lower case; commas, quotes, hyphens and other marks as spaces; no articles; no stop at the end; one space."""
    words = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.+]+", " ")
    words = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), r" (?:the |a )+", " ")
    return F.regexp_replace(words, r"^[ .]+|[ .]+$", "")


def sentence_id(sentence: Column) -> Column:
    """The identifier of a normalised sentence, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        if name.endswith("-"):
            group = F.replace(F.regexp_extract(sentence, pattern, 1), F.lit(" "), F.lit("-"))
            out = F.when(sentence.rlike(pattern), F.concat(F.lit(name), group)).otherwise(out)
        else:
            out = F.when(sentence.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def matched(ids: Column) -> Column:
    """The licences that the ordered rules find in a sequence of identifiers, in the order of the rules."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(f" {seq} ").alias("seq")) for name, seq in RULES))
    # Each identifier has a space of its own on both sides, so that neighbours can be taken out one by one.
    spaced = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    start = F.struct(spaced.alias("left"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["seq"])
        return F.struct(F.when(hit, F.replace(state["left"], rule["seq"], F.lit(" | "))).otherwise(state["left"]).alias("left"), F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    return F.array_distinct(F.aggregate(rules, start, apply)["found"])


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sentence_ids, licenses)`` for every row, both arrays; empty ones where no licence sentence is found.

    The whole text is read, however long. Null and empty texts have no sentences; rows come back as often as they came
    in; other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    candidates = F.filter(F.split(unwrapped(text), SPLIT), lambda x: _has_any(F.lower(x)))
    ids = F.filter(F.transform(candidates, lambda x: sentence_id(normal_sentence(x))), lambda x: x.isNotNull())
    rows = rows.select("id", F.when(_has_any(F.lower(text)), ids).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    return rows.withColumn("licenses", F.when(F.size("sentence_ids") > 0, matched(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    needs = lambda x: " or ".join(f"contains({x}, {quote(n)})" for n in NEEDS)
    normal = "regexp_replace(regexp_replace(' ' || regexp_replace(lower(x), '[^a-z0-9.+]+', ' ', 'g') || ' ', ' (?:the |a )+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    cases = " ".join(
        f"when regexp_matches(x, {quote(p)}) then " + (f"{quote(n)} || replace(regexp_extract(x, {quote(p)}, 1), ' ', '-')" if n.endswith("-") else quote(n)) for n, p in SENTENCES
    )
    whole = "coalesce(text, '')"
    for pattern, keep in UNWRAP:
        whole = f"regexp_replace({whole}, {quote(pattern)}, {quote(''.join(chr(92) + x if x.isdigit() else x for x in keep))}, 'g')"
    ids = f"list_filter(list_transform(list_transform(list_filter(string_split_regex({whole}, {quote(SPLIT)}), lambda x: {needs('lower(x)')}), lambda x: {normal}), lambda x: case {cases} end), lambda x: x is not null)"
    sql = f"select doc_id, ids, ' ' || array_to_string(ids, ' ') || ' ' as left_, '' as found from (select doc_id, {ids} as ids from {table})"
    for name, seq in RULES:
        hit = f"contains(left_, {quote(f' {seq} ')})"
        again = f"contains(',' || found || ',', {quote(f',{name},')})"
        added = f"case when {hit} and not {again} then case when found = '' then {quote(name)} else found || {quote(',' + name)} end else found end"
        sql = f"select doc_id, ids, replace(left_, {quote(f' {seq} ')}, ' | ') as left_, {added} as found from ({sql})"
    return f"select doc_id, array_to_string(ids, ' ') as sentence_ids, found as licenses from ({sql})"
