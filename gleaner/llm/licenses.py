"""License scans by canonical digests.

A text is brought to a canonical form: copyright lines go, letters are lower-cased, everything but
letters and digits becomes one space, and equivalent spellings become one.  The SHA-256 of the form
is joined to the digests of known licence texts.  The known table has a fixed number of rows (those
in this module, and what a caller adds within ``MOST_KNOWN``), so it is broadcast.  The same form, with
copyright lines kept, tells which known notices ("Released under the ... License") stand anywhere in a text,
within a line of any length or over several.

Everything is a DataFrame expression.  Defined cases: a null text counts as empty; an empty form has
no licence; repeated rows and other columns don't matter, whatever their names; long texts are read whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.blocks import dealt

MOST_KNOWN = 10_000

#: Lines that state a copyright and nothing else.
COPYRIGHT = r"(?im)^[ \t*#/;-]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|(\(c\)|©)[ \t]*[0-9]{4}|all rights reserved\.?[ \t]*$)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: Spellings that count as equal, in canonical form.
EQUIVALENT = [("licences?|licenses", "license"), ("licenced", "licensed"), ("sub ?licen[cs]e", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("whilst", "while"), ("favour", "favor"), ("organisation", "organization"), ("authorised", "authorized"), ("copyright (?:owner|holder)s?", "copyright holder")]

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_CONDITION = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."

#: Known licence texts, public, by identifier; several forms may share one.
KNOWN: list[tuple[str, str]] = [
    ("MIT", f"MIT License\n{_MIT_GRANT}, subject to the following conditions:\n{_CONDITION}\n{_AS_IS}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT_GRANT}, subject to the following conditions:\n{_CONDITION}\n{_AS_IS}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n{_CONDITION}\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n{_MIT_GRANT}.\n{_AS_IS}"),
    ("ISC", f"ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_TAIL}"),
    ("Apache-2.0", _APACHE_NOTICE),
]
#: SHA-256 of the canonical forms of longer public texts, with what may follow the terms and, where it's set apart, without it.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "cc3dbc3d9c9cd1e38d397f2f907b87612564431cdf2e6f9a315e7da9056fe964"),
    ("Apache-2.0", "00a72d2c197772f2d0b065c5abddbf645cc01fc748e04097fb6a74ce07467fba"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "689de607e171fe5521f41f62dea04557423a9d99f24f973688311041901ecd33"),
    ("GFDL-1.3", "d16bab35ebf1ffc87c5807e5636a42d29e02216f9492994a73675ff2520997b2"),
    ("GPL-1.0", "79a0640b5b958ae9c12954439e599eacc685716b4161c0dc0ad4c12cf231b83b"),
    ("GPL-1.0", "7404837cbd0f598c5a3f9de3f1381d24b7ce9d57c1331d71b6e0e077dcb8cb42"),
    ("GPL-2.0", "73ddc8e1e14f7cc45c0d48aa370ae0eeb704fafe17943ab3a281bf7be6a70336"),
    ("GPL-2.0", "43b7819bfd2bc47075e71b743f3ba588f1dd982e6790a684d126cf97b0a439a5"),
    ("GPL-3.0", "900cd3f2f980a537f002f5b34e17804f81dec0a547870fd438ff6d67c4e70c0f"),
    ("GPL-3.0", "e803e00c1885979258ce2c5b6cd615f337fdcb36e9d567b8e7bddcc549044c25"),
    ("LGPL-2.0", "4d94ee29ba6e5639eadf7f6fc328abc5e0cc332eab88b811cf868e33a2745c2e"),
    ("LGPL-2.0", "228b3403c00989dffe9407addfff25888433aaedefa15f6a03c19ac58652b79e"),
    ("LGPL-2.1", "f4d399ebd9d7287cf7f609a5c405cb1a59eb08741ba673a535b0fdaccabb3b23"),
    ("LGPL-2.1", "8067458db63604bc56f00b8567908ca6236ae9595288f9f66a45e0a329297247"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "e9b1410222504e4bd0c76ac0e06143eb0a333c93a74af4948696a7136d7076e9"),
    ("MPL-2.0", "a975c79c4e706e8418d3869e1b4193888eeabd618c0014a6e60b49d59de2ab2f"),
]
#: Names of licences in notices.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"],
    "MIT": ["the MIT License"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0"],
    "GPL-2.0": ["the GNU General Public License, version 2"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC0-1.0": ["CC0 1.0"],
}
_KNOWN_IDS = sorted({*NAMES, *(i for i, _ in KNOWN), *(i for i, _ in DIGESTS)})
#: Identifiers in SPDX lines; those of GNU licences have two more forms, each an identifier of its own.
SPDX = [*_KNOWN_IDS, *(f"{i}{form}" for i in _KNOWN_IDS if i.startswith(("GPL-", "LGPL-", "GFDL-")) for form in ("-only", "-or-later"))]
OPENINGS = ["Licensed under", "Released under", "This work is licensed under", "This software is licensed under", "This file is licensed under", "Distributed under", "Available under"]
#: A text without one of these holds no notice.
LIKELY = "(?i)licen[cs]e|released|distributed|available"

_PLAIN = re.compile(r"[\W_]+")


def plain_canonical(text: str, lines: bool = True) -> str:
    """The canonical form, computed in Python for the known texts."""
    text = re.sub(COPYRIGHT, "", text) if lines else text
    text = " " + _PLAIN.sub(" ", text.lower()).strip() + " "
    for spelling, one in EQUIVALENT:
        text = re.sub(f" (?:{spelling}) ", f" {one} ", text)
    return text.strip()


def canonical(text: Column, lines: bool = True) -> Column:
    """The canonical form as an expression."""
    text = F.coalesce(text, F.lit(""))
    text = F.regexp_replace(text, COPYRIGHT, "") if lines else text
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), PUNCTUATION, " ")), F.lit(" "))
    for spelling, one in EQUIVALENT:
        text = F.regexp_replace(text, f" (?:{spelling}) ", f" {one} ")
    return F.trim(text)


def _spread(form: str) -> str:
    """A canonical form with every space doubled, so that neighbouring matches can each have the space between them."""
    return form.replace(" ", "  ")


def notice_ids() -> dict[str, str]:
    """What stands after an opening, or is an SPDX line, with the identifier meant; spread canonical forms."""
    found = {_spread(plain_canonical(n, lines=False)): i for i, names in NAMES.items() for n in names}
    return found | {_spread(plain_canonical(f"SPDX-License-Identifier: {i}", lines=False)): i for i in SPDX}


def notice_pattern() -> str:
    """One group: the key of ``notice_ids``.  Longer alternatives come first, as the first that fits is taken."""
    names, lines = {_spread(plain_canonical(n, lines=False)) for own in NAMES.values() for n in own}, {k for k in notice_ids() if k.startswith("spdx")}
    openings = "|".join(sorted({_spread(plain_canonical(o, lines=False)) for o in OPENINGS}, key=lambda x: (-len(x), x)))
    either = "|".join(sorted(names, key=lambda x: (-len(x), x)))
    return f"(?: (?:{openings})  ({either}) )|(?: ({'|'.join(sorted(lines, key=lambda x: (-len(x), x)))}) )"


def digest(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def known_digests(more: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(digest, identifier) of every known text."""
    return sorted({(digest(plain_canonical(t)), i) for i, t in KNOWN + (more or [])} | {(d, i) for i, d in DIGESTS})


def scan_licenses(docs: DataFrame, more: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest of the canonical form, license_id of the whole text (null if none), notices (comma-separated ids of known lines, null if none)."""
    known = known_digests(more)
    if len(known) > MOST_KNOWN or len({d for d, _ in known}) < len(known):
        raise ValueError("too many known texts, or one text with two identifiers")
    spark = docs.sparkSession
    table = spark.createDataFrame(known, "known string, license_id string")
    lookup = F.create_map(*(F.lit(x) for pair in sorted(notice_ids().items()) for x in pair))
    rows = dealt(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    spread = F.concat(F.lit(" "), F.replace(canonical(F.col("text"), lines=False), F.lit(" "), F.lit("  ")), F.lit(" "))
    pattern = F.lit(notice_pattern())
    ids = F.concat(*(F.regexp_extract_all(spread, pattern, F.lit(group)) for group in (1, 2)))
    # Few texts name a licence, so few are brought to this form.
    found = F.when(F.col("text").rlike(LIKELY), F.array_sort(F.array_distinct(F.transform(F.filter(ids, lambda x: x != ""), lambda x: F.try_element_at(lookup, x)))))
    rows = rows.select("doc_id", F.sha2(F.encode(canonical(F.col("text")), "UTF-8"), 256).alias("digest"), F.nullif(F.array_join(found, ","), F.lit("")).alias("notices"))
    return rows.join(F.broadcast(table), rows["digest"] == table["known"], "left").select("doc_id", "digest", "license_id", "notices")


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str, lines: bool) -> str:
        sql = f"regexp_replace({text}, {quote(COPYRIGHT)}, '', 'g')" if lines else text
        sql = rf"' ' || trim(regexp_replace(lower({sql}), '{PUNCTUATION}', ' ', 'g')) || ' '"
        for spelling, one in EQUIVALENT:
            sql = f"regexp_replace({sql}, ' (?:{spelling}) ', ' {one} ', 'g')"
        return f"trim({sql})"

    known = ", ".join(f"({quote(d)}, {quote(i)})" for d, i in known_digests())
    ids = ", ".join(f"({quote(c)}, {quote(i)})" for c, i in sorted(notice_ids().items()))
    pattern = quote(notice_pattern())
    return f"""
WITH known(k, license_id) AS (VALUES {known}), notice(c, i) AS (VALUES {ids}),
d AS (SELECT doc_id, text, sha256({form("coalesce(text, '')", True)}) AS digest FROM documents),
s AS (SELECT doc_id, ' ' || replace({form("text", False)}, ' ', '  ') || ' ' AS c FROM d WHERE regexp_matches(text, '{LIKELY}')),
l AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(c, {pattern}, 1), regexp_extract_all(c, {pattern}, 2))) AS c FROM s),
n AS (SELECT doc_id, string_agg(DISTINCT i, ',' ORDER BY i) AS notices FROM l JOIN notice USING (c) GROUP BY doc_id)
SELECT d.doc_id, d.digest, known.license_id, n.notices FROM d LEFT JOIN known ON d.digest = known.k LEFT JOIN n ON d.doc_id = n.doc_id
"""


ORACLE = _oracle()
