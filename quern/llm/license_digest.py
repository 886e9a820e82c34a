"""License scans: the digest of a whole canonical text is looked up among those of known license texts.

The canonical form drops copyright lines, lower-cases A-Z, settles equivalent spellings and turns punctuation and white
space into single spaces. Known are the whole texts in the folder licenses and those of KNOWN, each with and without its
usual titles, and with and without an appendix on how to apply it. Both the known texts and the scanned ones pass through the same column expression; the join
is on the digest, and the known table's size is that of a constant, so it is broadcast. DataFrame functions only.

Defined results: null counts as empty text; an empty canonical text has a digest but no license; of known names with
one digest the first by name is reported; repeated rows are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.text_stats import kept_apart, LOWER, UPPER

#: Public license texts and the usual one-line notices.
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = {
    "MIT": f"{_PERMISSION}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_MIT_WARRANTY}",
    "MIT (titled)": f"MIT License\n{_PERMISSION}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_MIT_WARRANTY}",
    "MIT-0": f"{_PERMISSION}.\n{_MIT_WARRANTY}",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_WARRANTY}",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}

#: Usual titles of texts that have none of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0", "MIT-0 License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC", "ISC License (ISCL)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD", "BSD-0-Clause"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License", "The Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD-3-Clause", "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause-Regents": ("BSD License", "The BSD License", "BSD 3-Clause License"),
    "Unlicense": ("The Unlicense", "Unlicense", "UNLICENSE", "The Unlicense (Unlicense)"),
    "Apache-2.0": ("Apache License 2.0", "The Apache License 2.0", "Apache-2.0"),
    "MPL-2.0": ("Mozilla Public License 2.0", "MPL-2.0", "Mozilla Public License, version 2.0"),
    "BSL-1.0": ("Boost Software License 1.0", "BSL-1.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "CC0-1.0"),
}
#: Lines, without blank ones, that a text's own title takes; copyright lines don't count here.
TITLE_LINES = {"Apache-2.0": 3, "MPL-2.0": 2, "MPL-1.1": 3, "BSL-1.0": 1, "CC0-1.0": 2, "Artistic": 1, **dict.fromkeys(("GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "GFDL-1.2", "GFDL-1.3"), 2)}
#: How appendices that many copies leave out begin; the line stays out, too.
APPENDIX = re.compile(r"(?m)^\s*(?:APPENDIX: How to apply|Appendix: How to Apply|How to Apply These Terms|ADDENDUM: How to use|Exhibit [AB] -|EXHIBIT A )")
_LIST_MARK = re.compile(r"(?m)^\s*(?:\(?[0-9a-c][.)]|[*-])\s+")


@lru_cache(maxsize=1)
def known_texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of KNOWN, the folder licenses and their variants."""
    texts = {k: v for k, v in KNOWN.items() if k in TITLES}
    texts |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    out = list(KNOWN.items())
    for name, text in texts.items():
        whole = [text]
        if a := APPENDIX.search(text):
            whole.append(text[: a.start()])
            if name == "Apache-2.0":
                whole.append(whole[-1].replace("END OF TERMS AND CONDITIONS", ""))
        if name.startswith("BSD-"):
            whole.append(_LIST_MARK.sub("", text))
            whole += [w.replace("1. ", "a) ").replace("2. ", "b) ").replace("3. ", "c) ") for w in whole[:1]]
        for w in whole:
            lines = [x for x in w.split("\n") if x.strip()]
            bare = "\n".join(lines[TITLE_LINES.get(name, 0) :])
            out += [(name, w), (name, bare), *((f"{name} (titled)" if name in KNOWN else name, f"{t}\n{bare}") for t in TITLES.get(name, ()))]
    return tuple(dict.fromkeys(out))


#: Equivalent spellings of licence texts, as whole words after lower-casing.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("per cent", "percent"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("https", "http"),
)

_COPYRIGHT_LINE = r"(?m)^[ \t]*(?:©|\([cC]\)|[cC][oO][pP][yY][rR][iI][gG][hH][tT][ \t]*(?:©|\([cC]\)|[0-9])|[aA][lL][lL] [rR][iI][gG][hH][tT][sS] [rR][eE][sS][eE][rR][vV][eE][dD])[^\n]*$"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©«»‘’“”–—•·]+"


def canonical(text: Column) -> Column:
    """The canonical form of a whole text."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _COPYRIGHT_LINE, "")
    plain = F.regexp_replace(F.translate(plain, UPPER, LOWER), _BREAKS, " ")
    padded = F.concat(F.lit(" "), F.replace(F.trim(plain), F.lit(" "), F.lit("  ")), F.lit(" "))  # each word between blanks of its own
    for other, usual in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} "))
    return F.trim(F.replace(padded, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(license, digest), one row per digest; as many rows as known texts at most."""
    texts = known_texts() if known is None else known.items()
    rows = [F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in texts]
    if not rows:
        return spark.range(0).select(F.lit("").alias("license"), F.lit("").alias("digest"))
    table = spark.range(1).select(F.inline(F.array(*rows)))
    return table.select("license", digest(F.col("body")).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), known: dict[str, str] | None = None) -> DataFrame:
    """The columns `keep` of df with digest (of the canonical whole text), n_canonical (its code points) and license."""
    df, keep = kept_apart(df, keep, ("digest", "n_canonical", "license", "__c", "__d"))
    rows = df.select(*keep, canonical(F.col(text)).alias("__c"))
    rows = rows.select(*keep, F.length("__c").cast("long").alias("n_canonical"), F.sha2(F.col("__c"), 256).alias("digest"))
    table = known_digests(df.sparkSession, known).select(F.col("digest").alias("__d"), F.col("license").alias("license"))
    return rows.join(F.broadcast(table), (F.col("digest") == F.col("__d")) & (F.col("n_canonical") > 0), "left").drop("__d")
