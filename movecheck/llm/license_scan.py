"""License scan: canonical digests of whole texts, looked up among known licences."""

from __future__ import annotations

import hashlib
import pkgutil
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from movecheck.session import sized

_WORD = re.compile(r"[^\W_]+")
#: Blanks and ASCII punctuation, which may stand around a notice.
_MARKS = r"[ \t\r!-/:-@\[-`{-~]*"
_YEAR = r"[\[<{(]?(?:\d{4}|yyyy|year)\b"
#: Notices that licence texts have inside, dropped wherever they stand, so that a line's ends
#: do not count: the Free Software Foundation's own, and the forms to be filled in.
_INNER = (
    r"copyright\s+(?:(?:\(c\)|©)\s+)?(?:\d{4}(?:,\s*\d{4})*,?\s+free\s+software\s+foundation,\s+inc\b"
    r"|[\[<{]?(?:year|yyyy|19yy)[\]>}]?\s+[\[<{]?name\s+of\s+(?:copyright\s+owner|author)\b)"
)
#: Those, and lines that are a notice: copyright with a sign or a year, a sign with a year, or
#: nothing but reserved rights. Only what Python and RE2 read alike, the SQL has it too.
_COPYRIGHT = re.compile(
    f"^{_MARKS}{_INNER}|{_INNER}|^" + _MARKS + r"(?:copyright[ \t:,.-]*(?:\(c\)|©|" + _YEAR + r")|\(c\)[ \t]*(?:copyright[ \t]*)?" + _YEAR + r"|©).*$"
    "|^" + _MARKS + r"all[ \t]+rights[ \t]+reserved" + _MARKS + "$",
    re.M,
)

#: Spellings that licence texts use interchangeably, each with the one kept.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "sublicences": "sublicenses", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "https": "http", "noncommercial": "non commercial", "owners": "holders", "owner": "holder",
}

#: Licence texts and notices as their authors publish them.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later-notice": """This program is free software: you can redistribute it and/or modify it under the
terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
}

BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_bsd = LICENSES["BSD-2-Clause"].split("\n\n")
LICENSES["BSD-3-Clause"] = "\n\n".join([*_bsd[:-1], BSD_3, _bsd[-1]])
LICENSES["BSD-3-Clause-Regents"] = (
    LICENSES["BSD-3-Clause"]
    .replace("name of the copyright holder", "name of the University")
    .replace("COPYRIGHT HOLDERS", "REGENTS")
    .replace("COPYRIGHT HOLDER", "REGENTS")
)
LICENSES["GPL-3.0-notice"] = "This work is licensed under the GNU General Public License, version 3."
LICENSES["CC-BY-NC-4.0-notice"] = "Licensed under CC BY-NC 4.0."

#: Licences that are too long for a source file, in the folder ``licenses`` beside it.
LONG = (
    "Apache-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-2.0-spdx", "GPL-3.0", "LGPL-2.1", "LGPL-3.0",
    "MPL-2.0", "Unlicense",
)
for _name in LONG:
    LICENSES[_name] = (pkgutil.get_data(__package__, f"licenses/{_name}.txt") or b"").decode()
#: The terms alone, as many projects keep them, without the part on how to apply them.
_END = "END OF TERMS AND CONDITIONS"
for _name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1"):
    LICENSES[f"{_name}-terms"] = LICENSES[_name].split(_END)[0] + _END

#: Title lines under which licences without one of their own are kept.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License"),
    "Zlib": ("zlib License", "The zlib License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International",),
}
for _name, _titles in TITLES.items():
    LICENSES |= {f"{_name}-titled-{k}": f"{title}\n\n{LICENSES[_name]}" for k, title in enumerate(_titles, 1)}


def canonical(text: str | None) -> str:
    """The text without case, punctuation, copyright notices and differences of spelling."""
    lower = (text or "").lower()
    if "©" in lower or "(c)" in lower or "copyright" in lower or "all rights" in lower:
        lower = _COPYRIGHT.sub("", lower)
    kept = SPELLINGS.get
    return " ".join([kept(w, w) for w in _WORD.findall(lower)])


def digest(text: str | None) -> str:
    return hashlib.sha256(canonical(text).encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(StringType())
def canonical_digest(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([digest(t) for t in batch], dtype=object)


def known_digests(spark, texts: dict[str, str] | None = None) -> DataFrame:
    """Rows (license_id, digest) of licence texts, by default those listed here."""
    listed = LICENSES if texts is None else texts
    rows = [(name, digest(text)) for name, text in sorted(listed.items())]
    return spark.createDataFrame(rows, "license_id string, digest string")


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``digest`` and ``license_id``, null where no known text has this digest.

    The ids of known texts name their form: ``MIT`` is the bare text, ``MIT-titled-1`` the one
    under its first title line, ``-notice``, ``-header`` and ``-terms`` are parts that stand alone.
    ``known`` has rows (license_id, digest) and is broadcast only after its size was measured;
    of several ids with one digest the first in order is given. The digest is of the whole
    text, so a licence that is only quoted isn't found. Null texts and texts without a word
    have the digest of nothing and are no licence. Other columns pass through, rows may
    repeat; columns named ``digest`` or ``license_id`` are replaced.
    """
    if known is None:
        names = F.broadcast(known_digests(docs.sparkSession))  # the list above: some dozens of rows
    else:
        names = sized(known)
    names = names.filter(F.col("digest") != digest("")).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    plain = docs.drop("digest", "license_id").withColumn("digest", canonical_digest(F.col(text)))
    return plain.join(F.broadcast(names) if known is None else names, "digest", "left")
