"""Licences recognised from their sentences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, spare

# SPDX identifier, family, names besides the identifier.
LICENSES = (
    ("MIT", "permissive", ("expat", "mit expat")),
    ("MIT-0", "permissive", ("mit no attribution",)),
    ("X11", "permissive", ("mit x11",)),
    ("ISC", "permissive", ()),
    ("0BSD", "permissive", ("bsd zero clause", "zero clause bsd")),
    ("BSD-2-Clause", "permissive", ("2 clause bsd", "simplified bsd", "freebsd")),
    ("BSD-3-Clause", "permissive", ("3 clause bsd", "new bsd", "modified bsd", "revised bsd")),
    ("BSD-4-Clause", "permissive", ("4 clause bsd", "original bsd")),
    ("Apache-1.1", "permissive", ("apache software license version 1 1",)),
    ("Apache-2.0", "permissive", ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache version 2 0", "apache license version 2")),
    ("Zlib", "permissive", ("zlib libpng",)),
    ("BSL-1.0", "permissive", ("boost software license version 1 0", "boost software license 1 0", "boost software")),
    ("PSF-2.0", "permissive", ("python software foundation license version 2", "python software foundation")),
    ("Artistic-1.0", "permissive", ("artistic license 1 0",)),
    ("Artistic-2.0", "permissive", ("artistic license 2 0", "artistic license version 2 0")),
    ("NCSA", "permissive", ("university of illinois ncsa open source",)),
    ("PostgreSQL", "permissive", ()),
    ("curl", "permissive", ()),
    ("OpenSSL", "permissive", ()),
    ("AFL-3.0", "permissive", ("academic free license version 3 0", "academic free license 3 0")),
    ("ECL-2.0", "permissive", ("educational community license version 2 0",)),
    ("MS-PL", "permissive", ("microsoft public",)),
    ("MS-RL", "copyleft", ("microsoft reciprocal",)),
    ("MPL-1.1", "copyleft", ("mozilla public license version 1 1", "mozilla public license 1 1")),
    ("MPL-2.0", "copyleft", ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0")),
    ("EPL-1.0", "copyleft", ("eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0")),
    ("EPL-2.0", "copyleft", ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license v 2 0", "eclipse public license 2 0")),
    ("CPL-1.0", "copyleft", ("common public license version 1 0", "common public license v1 0")),
    ("CDDL-1.0", "copyleft", ("common development and distribution license version 1 0",)),
    ("CDDL-1.1", "copyleft", ("common development and distribution license version 1 1",)),
    ("EUPL-1.1", "copyleft", ("european union public licence version 1 1", "european union public licence v 1 1")),
    ("EUPL-1.2", "copyleft", ("european union public licence version 1 2", "european union public licence v 1 2")),
    ("OSL-3.0", "copyleft", ("open software license version 3 0", "open software license 3 0")),
    ("OFL-1.1", "permissive", ("sil open font license version 1 1", "sil open font license 1 1")),
    ("GFDL-1.3", "copyleft", ("gnu free documentation license version 1 3",)),
    ("SSPL-1.0", "source-available", ("server side public license version 1", "server side public license")),
    ("BUSL-1.1", "source-available", ("business source license 1 1", "business source license version 1 1")),
    ("Elastic-2.0", "source-available", ("elastic license 2 0", "elastic license v2")),
    ("Unlicense", "public-domain", ("the unlicense",)),
    ("CC0-1.0", "public-domain", ("cc0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal")),
    ("WTFPL", "public-domain", ("do what the fuck you want to public",)),
)
# Abbreviation, name, versions.
GNU = (("GPL", "gnu general public license", ("2.0", "3.0")), ("LGPL", "gnu lesser general public license", ("2.1", "3.0")), ("AGPL", "gnu affero general public license", ("3.0",)))
# What may follow "CC-BY", its name, its family; versions.
COMMONS = (("", "", "permissive"), ("-SA", " sharealike", "copyleft"), ("-ND", " noderivatives", "no-derivatives"), ("-NC", " noncommercial", "noncommercial"), ("-NC-SA", " noncommercial sharealike", "noncommercial"), ("-NC-ND", " noncommercial noderivatives", "noncommercial"))
COMMONS_VERSIONS = ("3.0", "4.0")

# Sentence identifier, normalised sentence.
TEXTS = (
    ("apache-title", "apache license"),
    ("apache-version", "version 2 0 january 2004"),
    ("apache-obey", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("mit-title", "mit license"),
    ("mit-title", "the mit license"),
    ("mit-title", "the mit license mit"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-condition", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit0-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("gpl-title", "gnu general public license"),
    ("lgpl-title", "gnu lesser general public license"),
    ("agpl-title", "gnu affero general public license"),
    ("gnu2-version", "version 2 june 1991"),
    ("gnu21-version", "version 2 1 february 1999"),
    ("gnu3-version", "version 3 29 june 2007"),
    ("agpl3-version", "version 3 19 november 2007"),
    ("gpl-2.0-notice", "gnu general public license version 2 june 1991"),
    ("gpl-3.0-notice", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1-notice", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0-notice", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0-notice", "gnu affero general public license version 3 19 november 2007"),
    ("apache-2.0-notice", "apache license version 2 0 january 2004"),
    ("gnu-either-2", "either version 2 of the license or at your option any later version"),
    ("gnu-either-21", "either version 2 1 of the license or at your option any later version"),
    ("gnu-either-3", "either version 3 of the license or at your option any later version"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("postgresql-grant", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense-grant", "this is free and unencumbered software released into the public domain"),
    ("wtfpl-title", "do what the fuck you want to public license"),
    ("reserved", "all rights reserved"),
)

# Fixed values, first match first: licence, family, sequence of sentence identifiers.
SEQUENCES = (
    ("AGPL-3.0", "copyleft", ("agpl-title", "agpl3-version")),
    ("AGPL-3.0", "copyleft", ("agpl-title", "gnu3-version")),
    ("LGPL-3.0", "copyleft", ("lgpl-title", "gnu3-version")),
    ("LGPL-2.1", "copyleft", ("lgpl-title", "gnu21-version")),
    ("GPL-3.0", "copyleft", ("gpl-title", "gnu3-version")),
    ("GPL-2.0", "copyleft", ("gpl-title", "gnu2-version")),
    ("GPL-2.0", "copyleft", ("gpl-free", "gnu-either-2")),
    ("GPL-3.0", "copyleft", ("gpl-free", "gnu-either-3")),
    ("LGPL-2.1", "copyleft", ("lgpl-free", "gnu-either-21")),
    ("LGPL-3.0", "copyleft", ("lgpl-free", "gnu-either-3")),
    ("AGPL-3.0", "copyleft", ("agpl-free", "gnu-either-3")),
    ("Apache-2.0", "permissive", ("apache-title", "apache-version")),
    ("Apache-2.0", "permissive", ("apache-2.0-notice", "apache-obey", "apache-copy")),
    ("MIT", "permissive", ("mit-title", "mit-grant", "mit-condition")),
    ("MIT", "permissive", ("mit-grant", "mit-condition")),
    ("BSD-4-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
)
# Licences that one sentence of their text tells.
SINGLES = (
    ("MIT-0", "mit0-grant"), ("ISC", "isc-grant"), ("0BSD", "0bsd-grant"), ("Zlib", "zlib-grant"), ("BSL-1.0", "boost-grant"),
    ("PostgreSQL", "postgresql-grant"), ("MPL-2.0", "mpl-notice"), ("Unlicense", "unlicense-grant"), ("WTFPL", "wtfpl-title"),
)


def _plain(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def _tables() -> tuple[tuple[tuple[str, str], ...], tuple[tuple[str, str, tuple[str, ...]], ...]]:
    """Sentences (identifier, sentence), and rules (licence, family, identifiers), from the values above. A sentence that
    names a licence is "under" and a name; a GNU or Creative Commons licence has names by a rule."""
    named: dict[str, tuple[str, set[str]]] = {i: (family, {_plain(i), *names}) for i, family, names in LICENSES}
    texts = list(TEXTS)
    for short, full, versions in GNU:
        for v in versions:
            spoken = [_plain(v), *([v[0]] if v.endswith(".0") else [])]
            named[f"{short}-{v}"] = "copyleft", {f"{n}{between}{s}" for n in (full, short.lower(), f"gnu {short.lower()}") for between in (" ", " v", "v", " version ") for s in spoken}
            later = f"version {spoken[-1]} of the license or at your option any later version"
            texts += [(f"{short.lower()}-{v}-notice", f"you can redistribute it and or modify it under the terms of the {full} as published by the free software foundation either {later}")]
        texts.append((f"{short.lower()}-free", f"you can redistribute it and or modify it under the terms of the {full} as published by the free software foundation"))
    for code, words, family in COMMONS:
        for v in COMMONS_VERSIONS:
            full = f"creative commons attribution{words} {_plain(v)}"
            named[f"CC-BY{code}-{v}"] = family, {_plain(f"cc by{code} {v}"), full, f"{full} international", f"{full} unported"}
    texts += [(f"{i.lower()}-notice", f"under {n}") for i, (_, names) in named.items() for n in sorted(names)]
    families = {i: family for i, (family, _) in named.items()}
    rules = [*SEQUENCES, *((i, families[i], (s,)) for i, s in SINGLES), *((i, f, (f"{i.lower()}-notice",)) for i, f in families.items())]
    return tuple(texts), tuple(rules)


SENTENCES, RULES = _tables()

#: Every sentence has one of these, so texts without any (whatever stands between its words) need not be cut up.
ANCHORS = (
    "licen", "spdx", "permission", "copyright", "version", "public domain", "redistribution", "rights reserved", "subject to the terms", "except in compliance", "advertising materials",
    "released under", "distributed under", "available under", "provided under", "published under",
)

# Patterns that Java and RE2 read alike. Marks of comments before a line, and at its end.
_MARKS = r"^[ \t]*(?:(?:/\*+|\*+/?|//+|#+|--+|;+|%+|>+|<!--|dnl|REM)(?:[ \t]+|$))*"
_CLOSING = r"[ \t]*(?:\*+/|-->)?[ \t]*$"
# The same for Java, which calls itself for each repeat of a group that is not possessive, and would try each of a run's spaces as its first.
_MARKS_JAVA, _CLOSING_JAVA = _MARKS + "+", r"(?:(?<![ \t])[ \t]++(?:\*+/|-->)?|(?<!\*)\*+/|-->)[ \t]*+$"
_ITEM = r"^(?:\(?(?:[0-9]{1,2}|[a-z])[.)]|-)[ \t]+"
_UNDER = r"^(?:(?:this|the) (?:[a-z0-9]+ ){1,4}(?:is|are) )?(?:licensed|released|distributed|made available|available|provided|published) under (?:an? |the )?(?:terms (?:and conditions )?of (?:the )?)?"
_ENDS = r"(?: the license)?(?: licen[cs]e)?(?: or at your option any later version| or any later version| or later| only)?$"
_NEITHER = r"^neither the name of .+ nor the names of (?:its|any) contributors may"
_FREE = r"^(?:[a-z0-9]+ ){1,4}is free software you can "
_OWNER = r"^(?:copyright |copyright c |c )(?:19|20)[0-9]{2}|^copyright c |^copyright .*(?:19|20)[0-9]{2}$"
_SPDX = "spdx license identifier "


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentences(text: Column, known: Column) -> Column:
    """Sentences of a text. Comment marks and indents go; wrapped lines are joined, but a line that is a known sentence, or
    tells the copyright's year or begins with an SPDX tag, stands alone, and so do empty lines and the items of lists. Sentences end at
    a semicolon, at . ! ? before white space and no small letter, at a colon or semicolon that ends a line, and at a colon before the first item of a list."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, _MARKS_JAVA, ""), _CLOSING_JAVA, ""))

    def placed(line: Column) -> Column:
        own = _norm(line)
        alone = (own == "") | own.rlike(_OWNER) | own.startswith(_SPDX) | F.map_contains_key(known, _framed(own))
        item = F.when(line.rlike(_ITEM), F.concat(F.lit("\n"), F.regexp_replace(line, _ITEM, ""))).otherwise(line)
        return F.when(alone, F.concat(F.lit("\n"), line, F.lit("\n"))).when(line.rlike("[:;]$"), F.concat(item, F.lit("\n"))).otherwise(F.concat(item, F.lit(" ")))

    whole = F.array_join(F.transform(lines, placed), "")
    whole = F.regexp_replace(whole, r"\b([vV])\.[ \t]?([0-9])", "$1 $2")
    whole = F.regexp_replace(whole, r":[ \t]+(\(?[0-9a-z]{1,2}[.)][ \t])", ":\n$1")
    whole = F.regexp_replace(F.regexp_replace(whole, r";[ \t\n]+", "\n"), r"([.!?])[ \t\n]+([^a-z \t\n])", "$1\n$2")
    return F.split(whole, "\n")


def _framed(own: Column) -> Column:
    """A normalised sentence that names a licence as "under" and its name; the holder of a BSD licence, and what
    a GNU notice calls the work, left out."""
    named = own.rlike(_UNDER)
    name = F.regexp_replace(F.regexp_replace(own, _UNDER, "under "), _ENDS, "")
    other = F.regexp_replace(own, _NEITHER, "neither the name of the copyright holder nor the names of its contributors may")
    return F.when(named, name).otherwise(F.regexp_replace(other, _FREE, "you can "))


def _ids(sentence: Column, known: Column) -> Column:
    """Identifiers of a sentence: one or none, or for an SPDX tag one for each licence of its expression."""
    own = _norm(sentence)
    tag = F.regexp_replace(F.regexp_replace(F.substring(own, F.lit(len(_SPDX) + 1), F.length(own)), " or later\\b", ""), " only\\b", "")
    parts = F.transform(F.split(tag, " (?:or|and|with) "), lambda p: F.try_element_at(known, F.concat(F.lit("under "), p)))
    return F.when(own.startswith(_SPDX), parts).otherwise(F.array(F.try_element_at(known, _framed(own))))


def scan(docs: DataFrame, text: str = "text", table=SENTENCES, rules=RULES) -> DataFrame:
    """docs and sentence_ids, licenses, families (arrays; where docs has such columns, the names with underscores before
    them).

    The identifiers of the text's known sentences, in order, are matched with the rules, in the rules' order: where a
    rule's sequence of identifiers stands, it gives its licence and uses the identifiers up. licenses and families
    are distinct and in the order of the rules. Between the sentences of a rule others that are unknown may stand. A null or
    empty text, or one without a known sentence, has three empty arrays. Repeated rows and ties need no rule: each
    row stands for itself. Very long texts are scanned whole, and no pattern repeats a group without a bound. Nothing is shuffled; an empty table gives an empty result.
    """
    ids, licenses, families, chain = spare(docs, "sentence_ids", "licenses", "families", "chain")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in ((s, i) for i, s in table) for x in pair])
    own = F.filter(F.flatten(F.transform(sentences(body, known), lambda s: _ids(s, known))), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    out = docs.withColumn(ids, F.when(body.rlike("(?i)" + "|".join(a.replace(" ", "[^a-z0-9]+") for a in ANCHORS)), own).otherwise(none))
    # the chain of identifiers as text, each between bars; what a rule has used becomes a gap
    state = F.struct(F.concat(F.lit("|"), F.array_join(F.col(ids), "||"), F.lit("|")).alias("left"), none.alias("found"), none.alias("kinds"))

    def step(state: Column, rule: Column) -> Column:
        there = F.instr(state["left"], rule["ids"]) > 0
        return F.when(
            there,
            F.struct(
                F.replace(state["left"], rule["ids"], F.lit("|-|")).alias("left"),
                F.array_union(state["found"], F.array(rule["license"])).alias("found"),
                F.array_union(state["kinds"], F.array(rule["family"])).alias("kinds"),
            ),
        ).otherwise(state)

    steps = F.array(*[F.struct(F.lit(f"|{'||'.join(seq)}|").alias("ids"), F.lit(a).alias("license"), F.lit(b).alias("family")) for a, b, seq in rules])
    out = out.withColumn(chain, F.when(F.size(ids) > 0, F.aggregate(steps, state, step)))
    return out.withColumns({licenses: F.coalesce(F.col(f"{chain}.found"), none), families: F.coalesce(F.col(f"{chain}.kinds"), none)}).drop(chain)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents; arrays joined by commas."""
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses", "families")]
    return out.select("doc_id", F.size("sentence_ids").alias("n_sentences"), *joined)


def _sql() -> str:
    """Lines and sentences as rows, known sentences by a join; sequences of identifiers used up one after another, and then
    what single identifiers are left."""
    quoted = lambda x: x.replace("'", "''")
    table = ", ".join(f"('{s}', '{i}')" for i, s in dict((s, i) for i, s in SENTENCES).items() for s, i in [(i, s)])
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    framed = lambda x: f"CASE WHEN regexp_matches({x}, '{_UNDER}') THEN regexp_replace(regexp_replace({x}, '{_UNDER}', 'under '), '{_ENDS}', '') ELSE regexp_replace(regexp_replace({x}, '{_NEITHER}', 'neither the name of the copyright holder nor the names of its contributors may'), '{_FREE}', 'you can ') END"
    several = [(k, r) for k, r in enumerate(RULES) if len(r[2]) > 1]
    steps = []
    for n, (_, (_, _, seq)) in enumerate(several):
        chain = f"|{'||'.join(seq)}|"
        steps.append(f"s{n} AS (SELECT r, replace(l, '{chain}', '|-|') AS l, hits || CASE WHEN instr(l, '{chain}') > 0 THEN [{several[n][0]}] ELSE [] END AS hits FROM {f's{n - 1}' if n else 'b'})")
    rules = ", ".join(f"({k}, '{i}', '{f}', '{seq[0] if len(seq) == 1 else ''}')" for k, (i, f, seq) in enumerate(RULES))
    return rf"""
WITH known(sentence, id) AS (VALUES {table}),
rules(k, license, family, id) AS (VALUES {rules}),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM documents),
raw AS (SELECT r, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM d),
stripped AS (SELECT r, i, regexp_replace(regexp_replace(x, '{quoted(_MARKS)}', ''), '{quoted(_CLOSING)}', '') AS line FROM raw),
lined AS (SELECT r, i, line, {norm("line")} AS own FROM stripped),
placed AS (SELECT r, i, CASE WHEN own = '' OR regexp_matches(own, '{_OWNER}') OR starts_with(own, '{_SPDX}') OR ({framed("own")}) IN (SELECT sentence FROM known) THEN chr(10) || line || chr(10)
    ELSE CASE WHEN regexp_matches(line, '{_ITEM}') THEN chr(10) || regexp_replace(line, '{_ITEM}', '') ELSE line END || CASE WHEN regexp_matches(line, '[:;]$') THEN chr(10) ELSE ' ' END END AS part FROM lined),
whole AS (SELECT r, string_agg(part, '' ORDER BY i) AS x FROM placed GROUP BY r),
cut AS (SELECT r, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\b([vV])\.[ \t]?([0-9])', '\1 \2', 'g'), ':[ \t]+(\(?[0-9a-z]{{1,2}}[.)][ \t])', ':' || chr(10) || '\1', 'g'), ';[ \t\n]+', chr(10), 'g'), '([.!?])[ \t\n]+([^a-z \t\n])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS parts FROM whole),
p AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
n AS (SELECT r, i, {norm("part")} AS own FROM p),
tags AS (SELECT r, i, string_split_regex(regexp_replace(regexp_replace(substring(own, {len(_SPDX) + 1}), ' or later\b', '', 'g'), ' only\b', '', 'g'), ' (?:or|and|with) ') AS names FROM n WHERE starts_with(own, '{_SPDX}')),
said AS (SELECT r, i, 0 AS j, {framed("own")} AS sentence FROM n WHERE own <> '' AND NOT starts_with(own, '{_SPDX}')
    UNION ALL SELECT r, i, generate_subscripts(names, 1) AS j, 'under ' || unnest(names) AS sentence FROM tags),
k AS (SELECT r, i, j, id FROM said JOIN known USING (sentence)),
a AS (SELECT r, string_agg(id, '||' ORDER BY i, j) AS bars, string_agg(id, ',' ORDER BY i, j) AS ids, count(*) AS n FROM k GROUP BY r),
b AS (SELECT r, '|' || bars || '|' AS l, []::INTEGER[] AS hits FROM a),
{', '.join(steps)},
singles AS (SELECT DISTINCT r, k FROM (SELECT r, unnest(string_split(l, '|')) AS id FROM s{len(steps) - 1}) JOIN rules USING (id) WHERE id <> ''),
hit AS (SELECT r, unnest(hits) AS k FROM s{len(steps) - 1} UNION SELECT r, k FROM singles),
named AS (SELECT r, string_agg(license, ',' ORDER BY k) AS licenses FROM (SELECT r, license, min(k) AS k FROM hit JOIN rules USING (k) GROUP BY ALL) GROUP BY r),
kinds AS (SELECT r, string_agg(family, ',' ORDER BY k) AS families FROM (SELECT r, family, min(k) AS k FROM hit JOIN rules USING (k) GROUP BY ALL) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::INT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, coalesce(families, '') AS families
FROM d LEFT JOIN a USING (r) LEFT JOIN named USING (r) LEFT JOIN kinds USING (r)
"""


SQL = _sql()
