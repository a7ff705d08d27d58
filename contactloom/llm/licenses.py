"""Licence scan: whole texts and whole lines against digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.tables import small, table, text_key

# Public short licences and the notices that stand for longer ones.
KNOWN = {
    "0BSD": """Zero-Clause BSD
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
}

# Spellings taken as equal, from the public matching guidelines for licences.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "copyright holder": "copyright owner",
    "copyright holders": "copyright owners",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "licence": "license",
    "licenced": "licensed",
    "modelling": "modeling",
    "non commercial": "noncommercial",
    "non infringement": "noninfringement",
    "offence": "offense",
    "organisation": "organization",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
_COPYRIGHT = "^(copyright  |c  [0-9]{4}|all  rights  reserved$)"


def canonical_lines(text: Column) -> Column:
    """Lines of a text in lower case, letters and digits only, two spaces between words
    (so that each word has a space of its own on either side).

    Copyright lines and empty lines go; equivalent spellings are made one. NULL for NULL.
    """
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", "  ")
    plain = F.concat(F.lit(" "), F.replace(plain, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for other, usual in SPELLINGS.items():
        wanted = f" {usual} ".replace(" ", "  ")[1:-1]
        plain = F.replace(plain, F.lit(f" {other} ".replace(" ", "  ")[1:-1]), F.lit(wanted))
    lines = F.transform(F.split(plain, "\n"), lambda line: F.trim(line))
    return F.filter(lines, lambda line: (line != "") & ~line.rlike(_COPYRIGHT))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(known: DataFrame) -> DataFrame:
    """``digest, license_id`` of licence texts (``license_id, text``); equal texts take the least id."""
    return (
        known.select("license_id", F.array_join(canonical_lines(F.col("text")), "  ").alias("_text"))
        .filter("license_id IS NOT NULL AND _text <> ''")
        .groupBy(digest(F.col("_text")).alias("digest"))
        .agg(F.min("license_id").alias("license_id"))
    )


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN.items()), "license_id string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Licences of each document: ``doc_id, digest, license_id, notices``.

    ``license_id`` is the licence that the whole text is, ``notices`` the sorted ids of the
    licences that single lines are (comma-joined, empty if none). A NULL text has a NULL
    digest and no licence; an empty one has the digest of nothing, which no licence has.
    Every row gives a row, repeated rows repeated ones; other columns are left out.

    Licences are found once per distinct line and whole text: a line that a third of the
    documents carry is looked up from partial counts, never gathered. Lines of a text are
    never joined back by document id but by a key of the text, so ids need not be unique.
    """
    licences = small(known_digests(known))
    texts = docs.select(
        "doc_id", *text_key(F.col("text")), canonical_lines(F.col("text")).alias("_lines")
    )
    whole = texts.withColumn("digest", digest(F.array_join("_lines", "  ")))
    lines = whole.select(
        "text_a", "text_b", F.explode(F.array_distinct("_lines")).alias("_line")
    ).select("text_a", "text_b", digest(F.col("_line")).alias("digest"))
    notices = (
        lines.join(licences, "digest")
        .groupBy("text_a", "text_b")
        .agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices"))
    )
    return (
        whole.select("doc_id", "text_a", "text_b", "digest")
        .join(licences, "digest", "left")
        .join(notices, ["text_a", "text_b"], "left")
        .select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"), known_licenses(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    plain = "' ' || replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\n]+', '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for other, usual in SPELLINGS.items():
        a, b = (f" {x} ".replace(" ", "  ")[1:-1] for x in (other, usual))
        plain = f"replace({plain}, '{a}', '{b}')"
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in KNOWN.items())
    lines = """
      SELECT id, k, trim(line, ' ') AS line FROM (
        SELECT id, unnest(string_split(plain, chr(10))) AS line,
               generate_subscripts(string_split(plain, chr(10)), 1) AS k
        FROM (SELECT id, {plain} AS plain FROM {source}) p) q
      WHERE trim(line, ' ') <> '' AND NOT regexp_matches(trim(line, ' '), '{mark}')"""
    of = lambda source: lines.format(plain=plain, source=source, mark=_COPYRIGHT)
    return f"""
WITH known AS (SELECT id, text FROM (VALUES {known}) v(id, text)),
known_line AS ({of("known")}),
licence AS (
  SELECT sha256(body) AS digest, min(id) AS license_id
  FROM (SELECT id, string_agg(line, '  ' ORDER BY k) AS body FROM known_line GROUP BY id) b
  GROUP BY 1),
doc AS (SELECT doc_id AS id, text FROM documents),
doc_line AS ({of("doc")}),
body AS (SELECT id, string_agg(line, '  ' ORDER BY k) AS body FROM doc_line GROUP BY id),
found AS (
  SELECT d.id, string_agg(DISTINCT l.license_id, ',' ORDER BY l.license_id) AS notices
  FROM doc_line d JOIN licence l ON sha256(d.line) = l.digest GROUP BY d.id)
SELECT doc.id AS doc_id,
       CASE WHEN doc.text IS NOT NULL THEN sha256(coalesce(body.body, '')) END AS digest,
       licence.license_id, coalesce(found.notices, '') AS notices
FROM doc LEFT JOIN body ON body.id = doc.id
LEFT JOIN licence ON licence.digest = sha256(coalesce(body.body, '')) AND doc.text IS NOT NULL
LEFT JOIN found ON found.id = doc.id"""


ORACLE = _sql()
