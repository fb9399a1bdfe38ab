"""Licence recognition by sentences. DataFrame functions only; no shuffle.

A text is split into sentences; each normalised sentence (lower case, letters and digits only) that equals a known licence sentence
becomes that sentence's identifier. The identifiers of a text, in order, are then matched against the rules, in their order: a rule that finds its
sequence names its licence and takes those identifiers away, so a longer rule shuts out the shorter ones that follow.

A sentence ends at one of . ! ? ; before white space, at a colon before a line's end, or at an empty line. A sentence that isn't known as a whole is looked at line by
line as well, for lines without a full stop. Copyright lines and sentences that name a holder are recognised by pattern. An SPDX line gives the licences
of its expression. Sentences are compared in normal form only, whatever their length or spacing.

Edge cases: null and empty texts have no sentences and no licences; a licence that is stated twice is named once; repeated rows each get
their result; other columns of the input are carried through, but for sentence_ids and licenses, which are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import text_of

#: Known sentences of public licences, as identifier and text. Case, punctuation and spacing don't matter.
SENTENCES = """
mit-short | Released under the MIT License.
mit-short | Licensed under the MIT License.
mit-short | This project is licensed under the MIT License.
mit-short | Distributed under the MIT License.
mit-short | This software is released under the MIT License.
mit-name | The MIT License (MIT)
mit-name | MIT License
mit-grant | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
mit-notice | The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
mit-warranty | THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
mit-liability | IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
apache2-short | Licensed under the Apache License, Version 2.0.
apache2-short | Released under the Apache License, Version 2.0.
apache2-short | This project is licensed under the Apache License 2.0.
apache2-head | Licensed under the Apache License, Version 2.0 (the "License");
apache2-comply | you may not use this file except in compliance with the License.
apache2-copy | You may obtain a copy of the License at
apache2-url | http://www.apache.org/licenses/LICENSE-2.0
apache2-asis | Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
apache2-see | See the License for the specific language governing permissions and limitations under the License.
gpl3-short | This work is licensed under the GNU General Public License, version 3.
gpl3-short | This program is licensed under the GNU General Public License, version 3.
gpl3-short | Licensed under the GNU General Public License, version 3.
gpl2-short | This work is licensed under the GNU General Public License, version 2.
gpl2-short | Licensed under the GNU General Public License, version 2.
gpl-free | This program is free software;
gpl3-later | This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
gpl-redistribute | you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;
gpl2-later | either version 2 of the License, or (at your option) any later version.
gpl-hope | This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
gpl-implied | without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
gpl-see | See the GNU General Public License for more details.
gpl-copy | You should have received a copy of the GNU General Public License along with this program.
bsd-grant | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
bsd-source | Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
bsd-binary | Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
bsd-name | Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
bsd3-short | Licensed under the BSD 3-Clause License.
bsd2-short | Licensed under the BSD 2-Clause License.
isc-grant | Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
mpl2 | This Source Code Form is subject to the terms of the Mozilla Public License, v.
ccby-short | Licensed under CC BY 4.0.
ccby-short | This work is licensed under a Creative Commons Attribution 4.0 International License.
ccbysa-short | Licensed under CC BY-SA 4.0.
ccbysa-short | This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
ccbync-short | Licensed under CC BY-NC 4.0.
ccbync-short | This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
cc0-short | To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
reserved | All rights reserved.
apache2-name | Apache License
apache2-version | Version 2.0, January 2004 http://www.apache.org/licenses/
apache2-terms | TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
apache2-license-def | "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.
apache2-licensor-def | "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.
apache2-copyright-grant | Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.
apache2-trademarks | This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.
apache2-end | END OF TERMS AND CONDITIONS
gpl-name | GNU GENERAL PUBLIC LICENSE
lgpl-name | GNU LESSER GENERAL PUBLIC LICENSE
agpl-name | GNU AFFERO GENERAL PUBLIC LICENSE
gpl3-version | Version 3, 29 June 2007
agpl3-version | Version 3, 19 November 2007
gpl2-version | Version 2, June 1991
lgpl21-version | Version 2.1, February 1999
gpl-verbatim | Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
gpl3-preamble | The GNU General Public License is a free, copyleft license for software and other kinds of works.
agpl3-preamble | The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.
lgpl3-incorporates | This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.
gpl2-preamble | The licenses for most software are designed to take away your freedom to share and change it.
gpl2-only | you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.
lgpl-short | This library is licensed under the GNU Lesser General Public License.
lgpl3-short | Licensed under the GNU Lesser General Public License, version 3.
lgpl21-short | Licensed under the GNU Lesser General Public License, version 2.1.
lgpl-free | This library is free software;
lgpl-redistribute | you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;
lgpl21-later | either version 2.1 of the License, or (at your option) any later version.
lgpl3-later | either version 3 of the License, or (at your option) any later version.
lgpl-hope | This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
lgpl-see | See the GNU Lesser General Public License for more details.
agpl3-later | This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
agpl3-short | Licensed under the GNU Affero General Public License, version 3.
mpl2-short | Licensed under the Mozilla Public License, Version 2.0.
mpl2-short | Licensed under the Mozilla Public License 2.0.
mpl2-name | Mozilla Public License Version 2.0
mpl2-copy | If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
mpl2-copy | If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
epl2-name | Eclipse Public License - v 2.0
epl2-short | This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/
epl2-short | Licensed under the Eclipse Public License 2.0.
bsl1-name | Boost Software License - Version 1.0 - August 17th, 2003
bsl1-short | Distributed under the Boost Software License, Version 1.0.
bsl1-grant | Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
unlicense-domain | This is free and unencumbered software released into the public domain.
unlicense-free | Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
zlib-asis | This software is provided 'as-is', without any express or implied warranty.
zlib-damages | In no event will the authors be held liable for any damages arising from the use of this software.
zlib-grant | Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
isc-warranty | THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
isc-short | Licensed under the ISC License.
wtfpl-do | You just DO WHAT THE FUCK YOU WANT TO.
psf2-grant | Subject to the terms and conditions of this License Agreement, PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly, prepare derivative works, distribute, and otherwise use Python alone or in any derivative version, provided, however, that PSF's License Agreement and PSF's notice of copyright are retained in Python alone or in any derivative version prepared by Licensee.
bsd-warranty | THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
bsd-short | Licensed under the BSD License.
bsd3-name | BSD 3-Clause License
bsd2-name | BSD 2-Clause License
ccby-short | This work is licensed under the Creative Commons Attribution 4.0 International License.
ccbysa-short | This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.
ccbync-short | This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.
cc0-name | CC0 1.0 Universal
"""

#: The rules in order, as licence and sequence of sentence identifiers.
RULES = """
MIT | mit-grant mit-notice mit-warranty mit-liability
MIT | mit-grant mit-notice mit-warranty
MIT | mit-grant mit-notice
MIT | mit-short
Apache-2.0 | apache2-head apache2-comply apache2-copy apache2-url apache2-asis apache2-see
Apache-2.0 | apache2-head apache2-comply apache2-copy
Apache-2.0 | apache2-head apache2-comply
Apache-2.0 | apache2-license-def apache2-licensor-def
Apache-2.0 | apache2-copyright-grant
Apache-2.0 | apache2-short
AGPL-3.0-or-later | agpl3-later
AGPL-3.0 | agpl-name agpl3-version
AGPL-3.0 | agpl3-preamble
AGPL-3.0 | agpl3-short
LGPL-2.1-or-later | lgpl-free lgpl-redistribute lgpl21-later
LGPL-3.0-or-later | lgpl-free lgpl-redistribute lgpl3-later
LGPL-3.0 | lgpl-name gpl3-version gpl-verbatim lgpl3-incorporates
LGPL-3.0 | lgpl-name gpl3-version
LGPL-2.1 | lgpl-name lgpl21-version
LGPL-3.0 | lgpl3-incorporates
LGPL-3.0 | lgpl3-short
LGPL-2.1 | lgpl21-short
LGPL | lgpl-short
GPL-3.0-or-later | gpl3-later gpl-hope gpl-implied gpl-see gpl-copy
GPL-3.0-or-later | gpl3-later
GPL-2.0-or-later | gpl-free gpl-redistribute gpl2-later gpl-hope gpl-implied gpl-see gpl-copy
GPL-2.0-or-later | gpl-free gpl-redistribute gpl2-later
GPL-3.0-or-later | gpl-free gpl-redistribute lgpl3-later
GPL-2.0-only | gpl-free gpl2-only
GPL-3.0 | gpl-name gpl3-version
GPL-2.0 | gpl-name gpl2-version
GPL-3.0 | gpl3-preamble
GPL-3.0 | gpl3-short
GPL-2.0 | gpl2-short
BSD-3-Clause | bsd-grant bsd-source bsd-binary bsd-name
BSD-3-Clause | bsd3-short
BSD-2-Clause | bsd-grant bsd-source bsd-binary
BSD-2-Clause | bsd2-short
BSD | bsd-short
ISC | isc-grant isc-warranty
ISC | isc-grant
ISC | isc-short
MPL-2.0 | mpl2 mpl2-copy
MPL-2.0 | mpl2
MPL-2.0 | mpl2-name
MPL-2.0 | mpl2-short
EPL-2.0 | epl2-name
EPL-2.0 | epl2-short
BSL-1.0 | bsl1-name bsl1-grant
BSL-1.0 | bsl1-grant
BSL-1.0 | bsl1-short
Unlicense | unlicense-domain unlicense-free
Unlicense | unlicense-domain
Zlib | zlib-asis zlib-damages zlib-grant
Zlib | zlib-grant
WTFPL | wtfpl-do
PSF-2.0 | psf2-grant
CC-BY-SA-4.0 | ccbysa-short
CC-BY-NC-4.0 | ccbync-short
CC-BY-4.0 | ccby-short
CC0-1.0 | cc0-short
CC0-1.0 | cc0-name
MIT | mit-name
BSD-3-Clause | bsd3-name
BSD-2-Clause | bsd2-name
proprietary | copyright reserved
"""

#: Sentences that name a holder, as identifier, first words and pattern of the normal form.
PATTERNS = """
bsd-name | neither the name | neither the names? of .+ nor the names of (its|any|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-name | the name of | the name of .+ may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-warranty | this software is provided | this software is provided by .+ as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
"""


#: Where a sentence ends.
SENTENCE_END = r"(?<=[.!?;])\s+|(?<=:)\s*\n\s*|\n\s*\n"


def _rows(table: str) -> list[tuple[str, str]]:
    return [tuple(x.strip() for x in line.split("|", 1)) for line in table.strip().splitlines()]


def normal_form(sentence: str) -> str:
    """The form in which sentences are compared; as the column expression below."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normal form to identifier. A sentence with an inner ; is listed as the parts it is split into."""
    return {normal_form(text): name for name, text in _rows(SENTENCES)}


def rules() -> list[tuple[str, list[str]]]:
    return [(licence, sequence.split()) for licence, sequence in _rows(RULES)]


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_ids(text: Column, known: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order. An SPDX line gives spdx:ID for each licence of its expression."""
    known = known or known_sentences()
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    sizes = sorted({len(x) for x in known})
    patterns = [tuple(x.strip() for x in line.split("|", 2)) for line in PATTERNS.strip().splitlines()]

    def formed(sentences: Column) -> Column:
        return F.transform(sentences, lambda x: F.struct(x.alias("raw"), _normal(x).alias("form")))

    def names_of(s: Column) -> Column:
        form, raw = s["form"], s["raw"]
        found = F.when(F.length(form).isin(sizes), F.element_at(names, form))  # lengths first, by hash: few sentences reach the map
        for name, head, pattern in patterns:
            found = F.coalesce(found, F.when(form.startswith(head) & form.rlike(f"^{pattern}$"), F.lit(name)))
        found = F.coalesce(found, F.when((form.startswith("copyright ") | form.startswith("c ")) & raw.rlike(r"(?i)^\W*(copyright|\(c\)|©)\W.*\b(19|20)\d\d\b"), F.lit("copyright")))
        expression = F.regexp_extract(raw, r"(?i)SPDX-License-Identifier:\s*([^\n]+)", 1)
        spdx = F.transform(F.filter(F.split(expression, r"[\s()*/#;,<>]+"), lambda x: x.rlike(r"^[A-Za-z0-9][A-Za-z0-9.+-]*$") & ~F.upper(x).isin("AND", "OR", "WITH")), lambda x: F.concat(F.lit("spdx:"), x))
        return F.when(found.isNotNull(), F.array(found)).when(form.contains("spdx license identifier"), spdx)

    def lines_of(s: Column) -> Column:
        whole = names_of(s)
        return F.when(whole.isNotNull() | ~s["raw"].contains("\n"), whole).otherwise(F.flatten(F.filter(F.transform(formed(F.split(s["raw"], "\n")), names_of), lambda x: x.isNotNull())))

    sentences = formed(F.split(text, SENTENCE_END))
    return F.flatten(F.filter(F.transform(sentences, lines_of), lambda x: x.isNotNull()))


def match_rules(ids: Column, ordered: list[tuple[str, list[str]]] | None = None) -> Column:
    """Licences that the rules find in a sequence of identifiers, then those that SPDX lines name."""
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("".join(f"<{x}>" for x in seq)).alias("seq")) for licence, seq in ordered or rules()])
    start = F.struct(F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        hit = acc["left"].contains(rule["seq"])
        return F.struct(
            F.when(hit, F.replace(acc["left"], rule["seq"], F.lit("|"))).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.array_union(acc["found"], F.array(rule["licence"]))).otherwise(acc["found"]).alias("found"),
        )

    spdx = F.transform(F.filter(ids, lambda x: x.startswith("spdx:")), lambda x: F.substring(x, F.lit(6), F.length(x)))
    return F.array_union(F.aggregate(table, start, step, lambda acc: acc["found"]), spdx)


def scan_licenses(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with sentence_ids and licenses (arrays of text), in place of input columns of these names."""
    out = docs.withColumn("sentence_ids", sentence_ids(text_of(text_col)))
    return out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, match_rules(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")))
