"""Licence scans: canonical digests of whole texts and of their lines, joined to the digests of known licences.

Canonical form: lower case; statements of a copyright go; equivalent spellings become one; anything
but letters and digits becomes one space. Equal canonical texts have equal SHA-256 digests, so the search is a
hash join. The known digests are a parameter-sized table (some lines a licence) and are broadcast; lines of the
documents are not shuffled. A whole text is one unit beside its lines.

Defined cases: a null or empty text has no licence; repeated lines and rows count each time; units without letters or digits
never match; an empty table gives an empty result; columns beyond key and text don't matter, whatever their names.
"""
from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching treats as equal (from, to), applied in this order.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("labelled", "labeled"),
    ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("copyright owner", "copyright holder"), ("cc by", "ccby"), ("creative commons attribution", "ccby"), ("ccby nc", "ccbync"), ("ccby noncommercial", "ccbync"),
    ("ccby sa", "ccbysa"), ("ccby sharealike", "ccbysa"), ("ccby share alike", "ccbysa"), ("the gnu", "gnu"), ("the apache", "apache"), ("the mit", "mit"),
    ("version ", "v"), ("v 2 0", "v2 0"),
)

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:"
)
_MIT_2 = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_3 = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies."
)
#: Licence texts and notices as their publishers word them, by SPDX identifier.
KNOWN = {
    "MIT": (f"MIT License\n{_MIT}\n{_MIT_2}\n{_MIT_3}", f"{_MIT}\n{_MIT_2}\n{_MIT_3}", _MIT, "Licensed under the MIT License.", "This work is licensed under the MIT License.", "Released under the MIT License.", "SPDX-License-Identifier: MIT"),
    "ISC": (_ISC, f"ISC License\n{_ISC}", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "This work is licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Licensed under CC0 1.0.", "Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}
_ISC_2 = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
    "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def _titled(title: str, *bodies: str) -> tuple[str, ...]:
    return (*bodies, *(f"{title}\n\n{b}" for b in bodies))


def _bsd(*items: str) -> tuple[str, ...]:
    """Items with numbers, and with bullets."""
    numbered = [f"{i}. {t}" for i, t in enumerate(items, 1)]
    return tuple("\n\n".join((_BSD, *own, _BSD_END)) for own in (numbered, [f"* {t}" for t in items]))


#: Entire licences beside KNOWN; the long ones are files named by SPDX identifier.
WHOLE = {
    "ISC": _titled("ISC License", f"{_ISC}\n\n{_ISC_2}"),
    "BSD-2-Clause": _titled("BSD 2-Clause License", *_bsd(_BSD_1, _BSD_2)),
    "BSD-3-Clause": _titled("BSD 3-Clause License", *_bsd(_BSD_1, _BSD_2, _BSD_3)),
    "Unlicense": (_UNLICENSE, f"{_UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org>", f"{_UNLICENSE}\n\nFor more information, please refer to <http://unlicense.org/>"),
} | {p.stem: (p.read_text(),) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: A mark with a sign, a year or a holder, or a short paragraph that begins with the word; up to what licenses the work, else to the end of the line.
COPYRIGHT = (
    r"(?m)^[^\p{L}\p{N}\n(©]*+(?:copyright\b[\x20\t:]*+(?:\(c\)|©|(?=[\[<(]?(?:(?:19|20)[0-9]{2}|yyyy|year)|by\b))|\(c\)[\x20\t]*+(?=(?:19|20)[0-9]{2}|copyright\b)|©)"
    r"[^\n]*?(?=$|(?<=[.,;])[\x20\t]+(?:this\b|licen[sc]ed\b|released\b|dedicated\b|permission\b|spdx-))"
    r"|(?:(?<![\s\S])|(?<=\n\n))[^\p{L}\p{N}\n]*+copyright\b(?:[\x20\t]+[^\s]+){1,6}[\x20\t]*+(?=\n[\x20\t]*+(?:\n|\z)|\z)"
)


def _marked(low: Column) -> Column:
    return F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))


def _without_copyright(low: Column) -> Column:
    return F.when(_marked(low), F.regexp_replace(low, COPYRIGHT, "")).otherwise(low)


def _head(plain: Column) -> Column:
    """Up to three letters of the first word."""
    return F.substring(F.regexp_extract(plain, r"[\p{L}\p{N}]+", 0), 1, 3)


def may_be_known(text: Column, heads: list[str]) -> Column:
    """False only where the canonical form can't be that of a known text: it begins neither like one nor like a spelling that is replaced, and has no copyright mark before."""
    begins = sorted({*heads, *(old.split()[0][:3] for old, _ in SPELLINGS)})
    low = F.lower(text)
    return _marked(low) | _head(low).isin(begins)


def canonical(text: Column) -> Column:
    """Words stand apart by two spaces, so that each brings its own to a replacement, whatever its neighbours are."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(_without_copyright(F.lower(text)), r"[^\p{L}\p{N}]++", "  ")), F.lit(" "))
    for old, new in SPELLINGS:
        words, end = "  ".join(old.split()), "  " if old[-1] == " " else " "  # with a space at its end: joined to the next word
        out = F.replace(out, F.lit(f" {words}{end}"), F.lit(f" {'  '.join(new.split())}{'' if old[-1] == ' ' else ' '}"))
    return F.trim(out)


def known_digests(spark: SparkSession, known: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    rows = [(k, t) for part in ([known] if known else [KNOWN, WHOLE]) for k, texts in part.items() for t in texts]
    frame = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("text")) for k, t in rows])).alias("x"))
    return frame.select(canonical(F.col("x.text")).alias("plain"), "x.license").select(F.sha2("plain", 256).alias("digest"), _head(F.col("plain")).alias("head"), "license").groupBy("digest", "head").agg(F.min("license").alias("license"))


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", known: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A row for each whole text or line that is a known licence: key, line (0: the whole text, else from 1), license."""
    digests = known_digests(df.sparkSession, known)
    heads = [r["head"] for r in digests.select("head").distinct().collect()]  # a parameter's size
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(F.split(body, "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    units = F.concat(F.array(F.struct(F.lit(0).alias("line"), body.alias("text"))), lines)
    held = F.filter(units, lambda u: may_be_known(u.text, heads))
    units = df.select(key, F.explode(F.transform(held, lambda u: F.struct(u.line.alias("line"), canonical(u.text).alias("plain")))).alias("u")).filter("u.plain <> ''")
    units = units.select(key, "u.line", F.sha2(F.col("u.plain"), 256).alias("digest"))
    return units.join(F.broadcast(digests.drop("head")), "digest").select(key, "line", "license")
