"""Licence scan by canonical digests, with built-in functions only.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation and white space), and
the SHA-256 of the whole form is joined to the digests of known texts.  Whole documents are looked up, and so is every
whole line of them, which finds one-line notices.  Known texts come as a table (license_id, text).  By default
these are ``KNOWN``, the whole texts in the folder ``licence_texts`` (a file each, named by its id) with their usual
variants, and one-line notices of ``NAMES``.  The known side is broadcast up to ``MAX_BROADCAST`` texts and joined by exchange beyond.

Defined cases: null text counts as empty; a form without any word matches nothing; of several known texts with one
form the least id is given; each row of ``docs`` gives a row, repeated ids included; texts of any length are read whole;
columns other than doc_id and text play no part; an empty table gives no rows, no known text no licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST = 50_000

#: Spellings that count as equal, after the matching guidelines of public licence lists.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("organisation", "organization"), ("favour", "favor"),
    ("behaviour", "behavior"), ("honour", "honor"), ("whilst", "while"), ("wilful", "willful"), ("programme", "program"), ("acknowledgement", "acknowledgment"),
    ("fulfil", "fulfill"), ("modernise", "modernize"), ("authorisation", "authorization"), ("artefact", "artifact"),
]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: Published licence texts and one-line notices (copyright lines play no part).
KNOWN = [
    ("MIT", "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]

#: Ids of the SPDX list, and the names that notices give them.  A notice has the id with "-notice" behind it.
NAMES = {
    "MIT": ("MIT License", "MIT"), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"), "MPL-1.1": ("Mozilla Public License, version 1.1", "MPL 1.1"), "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL version 2", "GPLv2"), "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL version 3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL version 2.1", "LGPLv2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL version 3", "AGPLv3"), "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0",), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",), "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    **{f"CC-{k}-4.0": (f"CC {k} 4.0", f"Creative Commons {n} 4.0 International License") for k, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
SUBJECTS = ("", "This work is ", "This project is ", "This software is ", "This program is ", "This file is ", "This code is ")
VERBS = ("licensed under", "released under", "distributed under")

#: A line that says who holds the rights: a sign or a year tells it from a line of the text that begins with the word.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright[ \t:]*(?:\(c\)|©|[<\[{(]?(?:yyyy|year|19xx|20xx)\b)|(?:copyright\b|\(c\)|©)[^\n]*\b(?:19|20)[0-9][0-9]\b|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form: lower-case words of letters and digits, one blank between them."""
    form = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    form = F.concat(F.lit(" "), F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for spelling, as_ in SPELLINGS:
        form = F.replace(form, F.lit(f" {spelling} "), F.lit(f" {as_} "))
    return F.trim(form)


def variants(text: str) -> set[str]:
    """The text and its usual forms: without appendix, other addresses and links, other holders, bullets for numbers."""
    import re

    def also(own: set[str], f) -> set[str]:
        return own | {f(t) for t in own}

    address = r"(?m)^[ \t]*51 Franklin St.*\n?"
    own = also({text}, lambda t: re.sub(r"(END OF TERMS AND CONDITIONS)[\s\S]*", r"\1", t))
    own = also(own, lambda t: t.replace("https://", "http://"))
    own = also(own, lambda t: re.sub(address, "", t, count=1)) | {re.sub(address, "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA\n", t, count=1) for t in own}
    if "Redistribution and use" in text:
        holder = lambda t: t.replace("the University nor", "the copyright holder nor").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
        own = also(own, holder)
        own = also(own, lambda t: t.replace("THE COPYRIGHT HOLDER OR", "THE COPYRIGHT OWNER OR"))
        own = also(own, lambda t: t.replace("provided that the following conditions\nare met", "provided that the following conditions are met"))
        own = also(also(own, lambda t: re.sub(r"(?m)^[123]\. ", "* ", t)), lambda t: re.sub(r"(?m)^All rights reserved\.\n", "", t))
        own |= {f"{title}\n\n{t}" for t in own for title in ("BSD 3-Clause License" if "Neither the name" in text else "BSD 2-Clause License",)}
    return own


def default_licences() -> list[tuple[str, str]]:
    """``KNOWN``, the shipped texts and the notices."""
    from pathlib import Path

    out = list(KNOWN)
    for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        out += [(f.stem, t) for t in sorted(variants(f.read_text(encoding="utf-8")))]
    for i, names in NAMES.items():
        spdx = [i, f"{i}-only", f"{i}-or-later", f"{i}+"] if "GPL" in i else [i]
        lines = [f"SPDX-License-Identifier: {x}" for x in spdx] + [f"{s}{v} {the}{n}" for n in names for s in SUBJECTS for v in VERBS for the in ("the ", "a ", "")]
        out += [(f"{i}-notice", x) for x in lines]
    return out


def known_licences(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(default_licences() if known is None else known, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, license_id (of the whole text, or null), notices (ids of whole lines, comma-joined) of each row."""
    forms = known.select("license_id", canonical(F.col("text")).alias("form")).filter("form <> ''")
    digests = forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    side = F.broadcast(digests) if digests.count() <= MAX_BROADCAST else digests
    text = F.coalesce("text", F.lit(""))
    units = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"))
    units = units.select("doc_id", "row", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))), F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))).alias("u"))
    rows = units.select("doc_id", "row", "u.whole", canonical(F.col("u.unit")).alias("form")).select("doc_id", "row", "whole", F.sha2("form", 256).alias("digest"))
    found = rows.join(side, "digest", "left").filter("whole OR license_id IS NOT NULL")
    return (
        found.groupBy("doc_id", "row")
        .agg(F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"), F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"), F.collect_set(F.when(~F.col("whole"), F.col("license_id"))).alias("ids"))
        .select("doc_id", "text_digest", "license_id", F.array_join(F.sort_array("ids"), ",").alias("notices"))
    )


def _sql_form(text: str) -> str:
    form = f"' ' || trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') || ' '"
    for spelling, as_ in SPELLINGS:
        form = f"replace({form}, ' {spelling} ', ' {as_} ')"
    return f"trim({form}, ' ')"


def oracle() -> str:
    """The same scan in DuckDB's SQL, over ``KNOWN``: for documents that have no other known text."""
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
WITH known AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql_form('text')} AS form FROM (VALUES {values}) AS k(license_id, text)) WHERE form <> '' GROUP BY 1),
docs AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
lines AS (SELECT r, sha256({_sql_form('line')}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
notices AS (SELECT r, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM (SELECT DISTINCT r, license_id FROM lines JOIN known USING (digest)) GROUP BY r),
whole AS (SELECT doc_id, r, sha256({_sql_form('text')}) AS text_digest FROM docs)
SELECT doc_id, text_digest, license_id, coalesce(notices, '') AS notices FROM whole LEFT JOIN known ON known.digest = whole.text_digest LEFT JOIN notices USING (r)
"""
